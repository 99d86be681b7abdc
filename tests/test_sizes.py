"""Plans and steps whose cost must follow the rows, not the size of packed files."""

import pytest

from gitstrata.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["blame_shares", "module_hubs", "external_callers", "module_community", "path_match", "impact_radius_1"])
def test_no_table_is_broadcast_by_a_guess(spark, name):
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastHashJoin" not in plan


def test_diffs_of_other_commits_go_at_the_scan(spark):
    """The subquery sits below the window that numbers all line items, so their diffs are never built."""
    from gitstrata.operators import origins as E
    from gitstrata.plans import history_queries as h
    from gitstrata.plans.registry import Source

    src = Source(spark, FOLDER)
    plan = E.fixed_ranges(h.fixing(src), src.diffs)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = {word: min((len(line) - len(line.lstrip(" :|+-")) for line in plan if word in line), default=None) for word in ("Window [", "Join LeftSemi")}
    assert depth["Join LeftSemi"] is not None and depth["Join LeftSemi"] > depth["Window ["]


def test_every_line_of_a_range_lies_in_one_node(spark):
    from pyspark.sql import functions as F

    from gitstrata.operators import hunks as H

    ranges = [(0, 0), (0, 7), (1, 8), (5, 5), (6, 70), (63, 64), (1, 4096), (4095, 8192), (7, 2_000_000_000)]
    rows = spark.createDataFrame(ranges, "first int, last int").select("first", "last", F.explode(H.aligned(F.col("first"), F.col("last"))).alias("n")).select("first", "last", "n.*").collect()
    for first, last in ranges:
        at = first
        for low, high in sorted((r.node << r.level, (r.node + 1) << r.level) for r in rows if (r.first, r.last) == (first, last)):
            assert low == at
            at = high
        assert at == last + 1


def test_running_without_and_with_chunks(spark):
    """Narrow keys take a plain window without a checkpoint; with ``most`` 0 the same rows come chunk by chunk."""
    from pyspark.sql import functions as F

    from gitstrata.functions import scale

    df = spark.range(400).select((F.col("id") % 7).alias("k"), "id")
    outs = {"s": ("sum", F.col("id")), "m": ("last", F.when(F.col("id") % 5 == 0, F.col("id")))}
    whole, cut = (scale.running(df, ["k"], [F.col("id")], outs, inclusive=False, most=most) for most in (100, 0))
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))
    assert "ExistingRDD" not in whole._jdf.queryExecution().executedPlan().toString()
    assert scale.widest(df, ["k"]) >= 58


def test_turns_hold_the_events_of_a_line(spark):
    from pyspark.sql import functions as F

    from gitstrata.operators import churn as X

    rows = [(i, o, oc, n, nc) for i, (o, oc, n, nc) in enumerate([(5, 3, 5, 1), (5, 0, 6, 2), (9, 2, 9, 0), (4, 1, 8, 2), (7, 0, 7, 0)])]
    hunks = spark.createDataFrame(rows, "hunk_no int, old_start int, old_count int, new_start int, new_count int").selectExpr(
        "*", "'r' AS repo_id", "'p' AS path", "1L AS seq", "'c' AS commit_id", "'a' AS author_name", "1 AS created_at", "1 AS line_start", "1 AS line_end"
    )
    from gitstrata.operators import hunks as H

    hunks = H.with_kind(hunks)
    want = X.line_events(hunks).groupBy("hunk_no", "line_no").agg(F.max(F.col("step") == 0).alias("checked"), F.max("step").alias("step"))
    got = X.line_turns(hunks).select("hunk_no", "line_no", "checked", "step")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_large_batches_of_a_stream_are_many_files(spark):
    from pyspark.sql import functions as F

    from gitstrata.plans import stream_queries as S
    from gitstrata.plans.registry import Source

    rows = spark.range(4000).select("id", (F.col("id") % 4).alias("part"))
    stream = S.in_batches(Source(spark, FOLDER), rows, F.col("part"), F.col("id") % 5 == 0, files=3, many=500)
    seen = []
    stream.writeStream.foreachBatch(lambda df, k: seen.append((len(df.inputFiles()), df.select("part").distinct().count(), df.count()))).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and sum(s[2] for s in seen) == 4800
    assert [s[1] for s in seen] == [1, 2, 2, 2]


def test_links_of_calls_are_worked_out_once(spark):
    """The last of two steps reads written links, no line items."""
    assert not [f for f in QUERIES["impact_radius_2"](spark, FOLDER).inputFiles() if "lineitem" in f]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlaps_are_merged_behind_one_shuffle_by_file(spark):
    from test_traps import merge_rows

    from gitstrata.operators import findings as N

    rows = merge_rows(spark).unionByName(merge_rows(spark).selectExpr("* EXCEPT (file, ord)", "CAST(NULL AS STRING) AS file", "ord + 9 AS ord"))
    merged = N.merge_overlaps(rows)
    assert plan_of(merged).count("Exchange hashpartitioning") == 1 and "Join" not in plan_of(merged)
    assert sorted(map(str, merged.collect())) == sorted(map(str, N.merge_overlaps(rows, most=0).select(*merged.columns).collect()))


def test_owners_are_traced_without_spreading_ranges(spark):
    from gitstrata.operators import findings as N

    rows = [("r", "f", 1, 4, "P0"), ("r", "f", 4, 4, "P1"), ("r", "f", 7, 2, "P2"), ("r", "f", 9, 2_000_000_000, "P0"), ("r", "f", None, 9, "P0"),
            ("r", "f", 1, 4, "P3"), ("r", "g", 1, 4, "P0"), ("r", None, 1, 4, "P0"), ("r", "f", 10, 10, None), ("r", "f", 10, 12, "P1")]
    df = spark.createDataFrame(rows, "repo_id string, file string, start_line int, end_line int, severity string")
    df = df.selectExpr("*", "'old' AS candidate_handler", "'old' AS owner")
    lines = [("r", "f", 3, "b"), ("r", "f", 3, "a"), ("r", "f", 7, "c"), ("r", "f", 10, None), ("r", "f", 12, "d"), ("r", "h", 1, "z")]
    blame = spark.createDataFrame(lines, "repo_id string, path string, line_no int, author_name string")
    last = spark.createDataFrame([("r", "f", "last")], "repo_id string, path string, author_name string")
    want = {(1, 4, "P0"): "a", (4, 4, "P1"): "last", (7, 2, "P2"): "c", (9, 2_000_000_000, "P0"): "d", (None, 9, "P0"): "last",
            (1, 4, "P3"): "old", (10, 10, None): "old", (10, 12, "P1"): "d"}
    for width in (None, 2_000_000):
        out = N.trace_owner(df, blame, last, width=width)
        assert "Generate" not in plan_of(out)
        assert {(r.start_line, r.end_line, r.severity): r.owner for r in out.where("file = 'f'").collect()} == want
        assert {r.candidate_handler for r in out.where("file IS NULL OR file = 'g'").collect()} == {"old"}


def test_checked_lines_go_to_the_merge_without_another_shuffle(spark):
    from gitstrata.operators import findings as N
    from gitstrata.operators import verify as V
    from gitstrata.plans.fixtures import view

    found, sources = view(spark, FOLDER, "findings_small"), view(spark, FOLDER, "sources").withColumnRenamed("n", "_n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    checked = V.check_lines(found, sources)
    assert plan_of(N.merge_overlaps(checked)).count("Exchange") == plan_of(checked).count("Exchange")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reviewed_findings_are_a_packed_table(spark):
    assert all("FileScan parquet" in plan_of(QUERIES[q](spark, FOLDER)) and "ExistingRDD" not in plan_of(QUERIES[q](spark, FOLDER))
               for q in ("review_chain_reviewed", "review_chain_merged"))


def test_core_files_read_written_calls(spark):
    """Seeds and neighbours come from numbered calls that were written once, no line items."""
    assert not [f for f in QUERIES["core_edge_split_all"](spark, FOLDER).inputFiles() if "lineitem" in f]


def test_numbers_keep_the_order_of_names_and_every_call(spark):
    from gitstrata.operators import callgraph as K

    names = [f"n{i * 37 % 100:02}" for i in range(100)]
    symbols = spark.createDataFrame([(r, n) for r in "ab" for n in [*names, "n05", None]], "repo_id string, qualified_name string").repartition(7)
    edges = spark.createDataFrame([("a", "n01", "n02"), ("a", "n01", "lost"), ("b", None, "n03"), ("c", "n01", "n01")], "repo_id string, source string, target string")
    calls, known = K.numbered_calls(edges, symbols)
    rows = [r for r in known.collect() if r.repo_id == "a"]
    assert len(rows) == 102 and sum(r.qualified_name is None for r in rows) == 1
    ranked = sorted({(r.qualified_name, r.full_name) for r in rows if r.full_name})
    assert len(ranked) == 100 and [n for _, n in ranked] == sorted(set(names))
    of = {(r.repo_id, r.full_name): r.qualified_name for r in known.collect()}
    assert sorted(map(str, calls.collect())) == sorted(
        f"Row(repo_id='{e.repo_id}', source={of.get((e.repo_id, e.source))}, target={of.get((e.repo_id, e.target))})" for e in edges.collect())


def test_changes_are_spread_to_lines_behind_the_shuffle(spark):
    from gitstrata.operators import churn as X
    from gitstrata.plans.history_queries import changes
    from gitstrata.plans.registry import Source

    hunks = changes(Source(spark, FOLDER))
    found, spread = X.repeated_changes(hunks), X.repeated_changes(hunks, most=0)
    assert plan_of(found).count("Exchange") == 1 < plan_of(spread).count("Exchange")
    assert sorted(map(str, found.collect())) == sorted(map(str, spread.collect()))


def test_shares_of_owners_take_one_shuffle_by_file(spark):
    from gitstrata.operators import findings as N

    ranges = [("r", "f", a, b) for a, b in [(1, 4), (1, 4), (60, 70), (64, 127), (1, 2_000_000_000), (9, 3), (None, 4), (200, 300)]]
    df = spark.createDataFrame([*ranges, ("r", None, 1, 4), ("r", "g", 1, 4)], "repo_id string, file string, start_line int, end_line int")
    lines = [("r", "f", n, f"d{n % 3}") for n in (1, 2, 2, 3, 5, 63, 64, 66, 70, 100, 127, 128, 199)]
    blame = spark.createDataFrame([*lines, ("r", "f", 4, None), ("r", None, 1, "z")], "repo_id string, path string, line_no int, author_name string")
    at_once, spread = N.owner_shares(df, blame), N.owner_shares(df, blame, most=0)
    assert plan_of(at_once).count("Exchange") == 1 < plan_of(spread).count("Exchange")
    got = sorted(map(str, at_once.collect()))
    assert got == sorted(map(str, spread.collect())) and len(got) == 10
