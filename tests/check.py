"""Compare registered queries with their SQL: python tests/check.py [sf] [name part ...]"""

import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from harness import compare, duck  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from gitstrata.plans import ORACLES, QUERIES  # noqa: E402

sf, parts = (sys.argv[1:2] or ["0.001"])[0], sys.argv[2:]
spark = (
    SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    .config("spark.ui.showConsoleProgress", "false").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
folder = f"/root/testdata/sf{sf}"
con = duck(folder)
bad = 0
for name, fn in QUERIES.items():
    if parts and not any(p in name for p in parts):
        continue
    t = time.time()
    try:
        df = fn(spark, folder)
        if name in ORACLES:
            msg = compare(df, con, ORACLES[name])
        else:
            msg = None if df.count() else "EMPTY"
    except Exception as e:  # noqa: BLE001
        msg = f"{type(e).__name__}: {str(e)[:700]}"
    took = round(time.time() - t, 2)
    if msg:
        bad += 1
        print(f"BAD {name} {took}s {msg}", flush=True)
    elif took > 6:
        print(f"slow {name} {took}s", flush=True)
print("bad:", bad, "of", len(QUERIES), "oracles:", len(ORACLES))
