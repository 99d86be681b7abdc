"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from gitstrata.functions import scale
from gitstrata.operators import callgraph as K
from gitstrata.operators import commits as C
from gitstrata.operators import findings as N
from gitstrata.plans import QUERIES
from gitstrata.plans.fixtures import view
from gitstrata.sources import commits as S

FOLDER = "/root/testdata/sf0.001"
PYTHON = "ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", [
    "label_precedence", "blame_lookup", "blame_shares", "merge_overlaps", "line_check", "verify_outcome", "cycle_evidence",
    "module_community", "path_match", "search_ladder", "core_edge_split", "evidence_window", "rules_as_data", "fix_dedupe",
])
def test_joins_are_equi_joins_without_python(no_broadcast, name):
    text = plan(QUERIES[name](no_broadcast, FOLDER))
    assert not re.search(f"CartesianProduct|BroadcastNestedLoopJoin|{PYTHON}", text)


def test_the_only_broadcast_hint_is_the_carry(no_broadcast):
    text = plan(QUERIES["contributor_ranking"](no_broadcast, FOLDER))
    assert text.count("BroadcastHashJoin") == 1


def test_top_rows_are_limited_before_the_shuffle(spark):
    commits = view(spark, FOLDER, "commits")
    edges = view(spark, FOLDER, "call_edges")
    for df in (S.newest(commits), C.dedupe_by_message(commits), K.hubs(edges), N.dedupe_exact(view(spark, FOLDER, "findings"))):
        text = plan(df)
        assert "Partial" in text and "WindowGroupLimit" in text


def test_scan_reads_only_what_is_needed(spark):
    text = plan(S.by_author(view(spark, FOLDER, "commits"), "dev0").select("id"))
    assert "o_totalprice" not in text and "o_orderstatus" not in text


def test_window_filter_reaches_the_scan(spark):
    text = plan(S.time_window(view(spark, FOLDER, "commits"), "1996-01-01", "1996-12-31").select("id"))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThanOrEqual(o_" in text


def test_checkpoints_go_to_the_named_folder(spark, tmp_path):
    named = scale.shared_dir(spark)
    scale.cut(spark.range(3).withColumn("x", F.lit(1)))
    assert named == spark.conf.get("spark.checkpoint.dir", None) or named.startswith(("file:/tmp/spark-", "/tmp/spark-"))
