"""Aligned nodes of line ranges and the interval join they carry."""

import random

from pyspark.sql import functions as F

from gitstrata.operators import hunks as H
from gitstrata.operators import origins as E


def test_nodes_cover_a_range_exactly(spark):
    rng = random.Random(8)
    ranges = [(a, a + rng.randrange(0, 200)) for a in (rng.randrange(0, 300) for _ in range(150))] + [(0, 0), (1, 1), (0, 63), (5, 5), (7, 2_000_000_006)]
    df = spark.createDataFrame(ranges, "first long, last long").withColumn("nodes", H.aligned(F.col("first"), F.col("last")))
    for r in df.collect():
        assert len(r.nodes) < 64
        spans = sorted((n.node << n.level, ((n.node + 1) << n.level) - 1) for n in r.nodes)
        assert spans[0][0] == r["first"] and spans[-1][1] == r["last"]
        assert all(b[0] == a[1] + 1 for a, b in zip(spans, spans[1:], strict=False))


def test_lines_meet_all_ranges_that_hold_them(spark):
    rng = random.Random(2)
    lines = [(f, n) for f in "ab" for n in range(1, 120)] + [("c", 5)]
    ranges = [(rng.choice("abz"), i, x := rng.randrange(1, 150), x + rng.randrange(-3, 60)) for i in range(60)] + [("a", 90, 1, 2_000_000_000), ("b", 91, -4, 3)]
    got = H.in_ranges(spark.createDataFrame(lines, "f string, line_no int"), spark.createDataFrame(ranges, "f string, i int, first long, last long"), ["f"])
    rows = [(r["f"], r["line_no"], r["i"]) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(f, n, i) for f, n in lines for g, i, a, b in ranges if f == g and 0 <= a <= n <= b}


def test_a_huge_header_blames_the_lines_there_are(spark):
    fixes = spark.createDataFrame([("r", "f1", ["p"], "x", "m", 1)], "repo_id string, id string, parent_ids array<string>, author_name string, message string, created_at int")
    diffs = spark.createDataFrame([("r", "f1", "a.c", "MODIFY", "@@ -2,2000000000 +2 @@\n-x")], "repo_id string, commit_id string, path string, change_type string, unified_diff string")
    blame = spark.createDataFrame([("r", "p", "a.c", n, "dev", "c") for n in (1, 2, 3, 900)], "repo_id string, commit_id_at string, path string, line_no int, author_name string, commit_id string")
    got = E.blamed_lines(E.fixed_ranges(fixes, diffs), blame)
    assert sorted(r["line_no"] for r in got.collect()) == [2, 3, 900]
