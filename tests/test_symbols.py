"""Symbol resolution against the plain rule, and the number of rows it makes."""

import random

from gitstrata.operators import callgraph as K

SYMBOLS = "repo_id string, kind string, name string, qualified_name string, file string, ord int"


def plain(symbols, requests):
    out = {}
    for repo, symbol in set(requests):
        if not symbol:
            continue
        cls, dot, method = symbol.rpartition(".")
        best = None
        for r, kind, name, qn, file, o in symbols:
            if r != repo or kind != "Function" or name != method or qn is None:
                continue
            if not dot or qn.endswith(symbol):
                step = 0
            elif "." + method in qn and (cls in (file or "") or cls in qn):
                step = 1
            else:
                continue
            best = min(best or (step, o, qn), (step, o, qn))
        if best:
            out[repo, symbol] = best[2]
    return out


def test_resolution_equals_the_plain_rule(spark):
    rng = random.Random(6)
    classes = ["Order", "OrderService", "BigOrderService", "a.b.Order", "User", "X", "Order.Inner"]
    symbols = []
    for i in range(250):
        cls, method = rng.choice(classes), rng.choice(["run", "get", "set"])
        qn = rng.choice([f"src/{cls}.java::{cls}.{method}", f"{cls}.{method}", f"src/{i % 9}::{method}", f"{cls}.{method}.lambda", None])
        symbols.append((rng.choice("pq"), rng.choice(["Function", "Function", "Class"]), method, qn, rng.choice([f"src/{cls}.java", "other", None]), i))
    wanted = [f"{c}.{m}" for c in [*classes, "Service", "er", "Nowhere", ""] for m in ("run", "get", "none")] + ["run", "get", "none", "", None]
    requests = [(r, s) for r in "pq" for s in wanted]
    got = K.resolve_symbols(
        spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(requests * 2, "repo_id string, symbol string")
    ).collect()
    assert len(got) == len({(r["repo_id"], r["symbol"]) for r in got})
    assert {(r["repo_id"], r["symbol"]): r["target"] for r in got} == plain(symbols, [q for q in requests if q[1]])


def test_one_method_of_many_classes_makes_no_pairs(spark, monkeypatch):
    n = 300
    rows = [("r", "Function", "run", f"src/C{i}.java::C{i}.run", f"src/C{i}.java", i) for i in range(n)]
    symbols = spark.createDataFrame(rows, SYMBOLS)
    requests = spark.createDataFrame([("r", f"C{i}.run") for i in range(n)] + [("r", f"Lost{i}.run") for i in range(n)], "repo_id string, symbol string")
    asked = K.split_symbol(requests)
    assert K.suffix_index(symbols, asked).count() == n
    assert K.method_candidates(symbols, requests).count() == n
    sizes = []
    monkeypatch.setattr(K, "cut", lambda df, real=K.cut: (lambda x: (sizes.append(x.count()), x)[1])(real(df)))
    found = K.resolve_symbols(symbols, requests)
    assert {r["symbol"]: r["target"] for r in found.collect()} == {f"C{i}.run": f"src/C{i}.java::C{i}.run" for i in range(n)}
    assert max(sizes) <= 2 * n
