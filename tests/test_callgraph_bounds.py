from gitstrata.operators import callgraph as K


def test_callers_and_flows_have_no_bound_between_operators(spark):
    calls = [("o.c", f"m.s{i}") for i in range(12)] + [(f"o.d{j}", f"m.s{i}") for i in range(11) for j in range(2)]
    names = sorted({x for c in calls for x in c})
    edges = spark.createDataFrame([("r", *c) for c in calls], "repo_id string, source string, target string")
    symbols = spark.createDataFrame(
        [("r", q, q[2:], "Function", f"f{q[3:]}" if q[0] == "m" else "g", n) for n, q in enumerate(names)],
        "repo_id string, qualified_name string, name string, kind string, file string, ord long",
    )
    modules = spark.createDataFrame([("r", "m", f"f{i}") for i in range(15)] + [("r", "o", "g")], "repo_id string, module string, path string")
    flows = spark.createDataFrame([("r", i, f"w{i}", 1.0 - i / 10) for i in range(7)], "repo_id string, id long, name string, criticality double")
    on = spark.createDataFrame([("r", i, "f0" if i < 6 else "f12") for i in range(7)], "repo_id string, id long, file string")
    none = spark.createDataFrame([], "repo_id string, id long, name string, size long")

    def core(**bounds):
        return {r.file for r in K.core_files(edges, symbols, modules, flows, on, **bounds).collect() if r.module == "m" and r.part == "core"}

    assert {"f11", "f12"} <= core() and not {"f13", "f14"} & core()
    assert not {"f11", "f12"} & core(called_hubs=5, n_flows=5)
    row = next(r for r in K.module_summary(edges, symbols, modules, flows, on, none).collect() if r.module == "m")
    assert row.external_callers == len(calls) and row.flows == 7
