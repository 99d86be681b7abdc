"""Replies with odd values, findings without a file or category, and marks that move back."""

from pyspark.sql import functions as F

from gitstrata.operators import commits as C
from gitstrata.operators import findings as N
from gitstrata.operators import verify as V
from gitstrata.streaming import tracker as T


def replies(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "response_id long, body string")


def test_odd_numbers_cost_a_value_not_the_reply(spark):
    got = N.comments(replies(
        spark, '{"comments":[{"path":"a","startLine":"12","endLine":3.0},{"path":"b","startLine":"x","endLine":null}]}',
        r'{"comments":[{"path":"c","content":"matches \d+ here","startLine":4}]}', "no document",
    )).orderBy("response_id", "pos").collect()
    assert [(r.path, r.startLine, r.endLine) for r in got] == [("a", 12, 3), ("b", None, None), ("c", 4, None)]
    direct = N.findings_from_json(replies(spark, '{"findings":[{"file":"a","line":"7","confidence":"0.9"},{"file":"b","confidence":true}]}'))
    assert [(r.start_line, r.confidence) for r in direct.orderBy("pos").collect()] == [(7, 0.9), (1, 0.7)]


def test_unreadable_replies_are_kept_apart(spark):
    got = N.rejected(replies(spark, '{"comments":[]}', "no document", '{"comments": [{]}')).collect()
    assert sorted(r.response_id for r in got) == [1, 2]


def test_merged_findings_without_a_file_keep_their_texts(spark):
    rows = [("r", None, 1, 5, "P1", "BUG", 0.5, "UNREVIEWED", "e1", "m", 0), ("r", None, 3, 8, "P0", "BUG", 0.6, "UNREVIEWED", "e2", "m", 1)]
    df = spark.createDataFrame(
        rows, "repo_id string, file string, start_line int, end_line int, severity string, category string, confidence double, "
        "status string, evidence string, module_name string, ord long")
    (got,) = N.merge_overlaps(df).collect()
    assert got.file is None and got.evidence == "e1\n---\ne2" and (got.start_line, got.end_line) == (1, 8)


def test_a_secret_in_an_uncategorised_finding_is_reported(spark):
    df = spark.createDataFrame([("r", 'password = "hunter2hunter2"', None, 1)], "repo_id string, evidence string, category string, ord long")
    df = df.withColumns({"severity": F.lit("P3"), "confidence": F.lit(0.1), "status": F.lit("UNREVIEWED")})
    assert [r.category for r in N.secret_findings(df).collect()] == ["SECRET_EXPOSURE"]


def test_blank_section_reply_has_defaults_in_all_three_fields(spark):
    (got,) = V.parse_sections(replies(spark, "  ")).collect()
    assert got.conclusion and got.risk_level and got.key_findings


def test_feedback_of_one_repository_stays_there(spark):
    commits = spark.createDataFrame([("a", "1", "update"), ("b", "2", "update")], "repo_id string, id string, message string")
    feedback = spark.createDataFrame([("a", "update", "perf")], "repo_id string, message string, category string")
    none = spark.createDataFrame([], "repo_id string, message string, reply string")
    got = {r.id: r.source for r in C.label(commits, feedback, none).collect()}
    assert got == {"1": "feedback", "2": "rule"}


def test_mark_moves_to_an_older_tip(spark):
    mark = spark.sql("SELECT 'r' AS repo_id, 'b' AS branch, 'new' AS last_hash, timestamp'2024-01-02' AS updated_at")
    batch = spark.sql("SELECT 'r' AS repo_id, 'b' AS branch, 'old' AS id, timestamp'2024-01-01' AS created_at, 1L AS ord")
    assert [r.last_hash for r in T.advance(mark, batch).collect()] == ["old"]
    assert [r.last_hash for r in T.advance(mark, batch.where("false")).collect()] == ["new"]


def test_a_range_has_no_more_pieces_than_its_file(spark):
    ranges = spark.createDataFrame([("r", "f", 1, 2_000_000_000), ("r", "f", 5, 9)], "repo_id string, file string, first int, last int")
    blame = spark.range(1, 301).selectExpr("'r' AS repo_id", "'f' AS path", "int(id) AS line_no", "'a' AS author_name")
    assert N._pieces(ranges, N._blamed(blame, ranges)).count() < 200
    df = ranges.selectExpr("repo_id", "file", "first AS start_line", "last AS end_line")
    assert {(r.end_line, r.lines) for r in N.owner_shares(df, blame).collect()} == {(2_000_000_000, 300), (9, 5)}
