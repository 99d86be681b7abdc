"""Small hand-made rows for the corner cases the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from gitstrata.functions import dims, paths, scale, text
from gitstrata.functions.grams import containing
from gitstrata.operators import churn as X
from gitstrata.operators import commits as C
from gitstrata.operators import findings as N
from gitstrata.operators import hunks as H
from gitstrata.operators import origins as E
from gitstrata.operators import prep as P
from gitstrata.operators import reports as R
from gitstrata.operators import search as Q
from gitstrata.operators import structure as G
from gitstrata.operators import verify as V
from gitstrata.sources import commits as S


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw, clean", [
    ("fix: a", "a"), ("fix：a", "a"), ("FIX: a", "a"), ("docs: a", "docs: a"), ("fix(core)： a", "a"), ("【修复】 a", "a"),
    ("[Feature] a", "a"), ("x add y", "x y"), ("--user=bob a", "a"), ("", ""),
])
def test_clean_message(spark, raw, clean):
    assert one(spark, raw, text.clean_message) == clean


@pytest.mark.parametrize("message, category", [
    ("fix: a", "bugfix"), ("新增 a", "feature"), ("修复：a", "bugfix"), ("feat: 修复", "feature"), ("a 优化 b", "perf"),
    ("代码优化", "refactor"), ("ci", "other"), ("CI x", "ci"), ("", "other"), (None, "other"),
])
def test_rule_category(spark, message, category):
    assert one(spark, message, text.rule_category) == category


def test_cleaned_message_loses_plain_fix(spark):
    rows = spark.createDataFrame([("r", "a", "fix: x", 1), ("r", "b", "bug: y", 2)], "repo_id string, id string, message string, ord long")
    got = {r["id"]: r["category"] for r in C.classify(C.dedupe_by_message(rows)).collect()}
    assert got == {"a": "other", "b": "bugfix"}


def test_dedupe_is_idempotent(spark):
    rows = spark.createDataFrame([("r", "a", "fix: x", 1), ("r", "b", "x", 2), ("r", "c", None, 3)], "repo_id string, id string, message string, ord long")
    once = C.dedupe_by_message(rows).select("repo_id", "id", "message", "ord")
    assert [r["id"] for r in once.collect()] == ["a"]
    assert C.dedupe_by_message(once).count() == 1


def test_time_formats_are_strict(spark):
    got = [one(spark, t, lambda c: text.parse_time(c).cast("string")) for t in ("2024-01-02T03:04:05", "2024-01-02 03:04", "2024-01-02", "2024-01-02 junk")]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:00", "2024-01-02 00:00:00", None]


def test_half_up(spark):
    got = spark.createDataFrame([(1.005,), (2.345,), (33.333,)], "x double").select(text.half_up2(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in got] == [1.0, 2.35, 33.33]


@pytest.mark.parametrize("raw, masked", [
    ("pass" + "word = abc x", "pass" + "word =*** x"), ("token: abc", "token:***"), ("jdbc://u:p@h", "jdbc://***:***@h"),
    ("Bearer a.b-c", "Bearer ***"), ("nothing", "nothing"),
    ("-----BEGIN RSA PRIVATE KEY-----\nab=\n-----END RSA PRIVATE KEY-----", "***"),
])
def test_mask(spark, raw, masked):
    assert one(spark, raw, text.mask_secrets) == masked


def test_module_of_path(spark):
    cases = {"src/main/java/com/acme/Billing/dao/A.java": "Billing", "src/main/A.java": "other", "A.java": "other", None: "other"}
    assert {p: one(spark, p, paths.module_of) for p in cases} == cases


def test_hunks(spark):
    diff = (
        "diff --git a/x.java b/x.java\n--- a/x.java\n+++ b/x.java\n@@ -1,7 +1,6 @@ class X\n c1\n c2\n c3\n c4\n c5\n c6\n-old\n after\n"
        "@@ -20 +19,2 @@\n+a\n+b\n@@ -30,2 +31,0 @@\n-p\n-q\n"
    )
    rows = spark.createDataFrame(
        [("r", "c", None, diff), ("r", "c", "e", ""), ("r", "c", "n", None), ("r", "c", "b", "Binary files a and b differ")],
        "repo_id string, commit_id string, path string, unified_diff string",
    )
    got = H.bodies(H.with_kind(H.hunks(rows))).orderBy("hunk_no").collect()
    assert [(r["path"], r["old_start"], r["old_count"], r["new_start"], r["new_count"], r["kind"]) for r in got] == [
        ("x.java", 1, 7, 1, 6, "MODIFY"), ("x.java", 20, 1, 19, 2, "MODIFY"), ("x.java", 30, 2, 31, 0, "DELETE")]
    assert got[0]["context_before"] == "c2\nc3\nc4\nc5\nc6"
    assert (got[0]["change_text"], got[0]["context_after"]) == ("-old", "after")
    assert got[1]["change_text"] == "+a\n+b"


def test_line_check(spark):
    src = spark.createDataFrame([("r", "f", "\n".join(f"line number {i}" for i in range(1, 31)))], "repo_id string, path string, content string")
    rows = [(1, -3, 9, None), (2, 9, 4, None), (3, 99, 101, "line number 25"), (4, 99, 101, "absent text"), (5, 3, 4, "line number 30"), (6, 29, 29, "line number 30")]
    f = spark.createDataFrame([("r", "f", *r) for r in rows], "repo_id string, file string, ord long, start_line int, end_line int, evidence string")
    got = {r["ord"]: (r["start_line"], r["end_line"]) for r in V.check_lines(f, src).collect()}
    assert got == {1: (1, 1), 2: (4, 9), 3: (25, 27), 4: (1, 1), 5: (30, 31), 6: (29, 29)}


FIELDS = ("repo_id string, file string, ord long, start_line int, end_line int, severity string, category string, confidence double, "
          "status string, evidence string, owner string, blame_commit_ids array<string>")


def merge_rows(spark):
    return spark.createDataFrame([
        ("r", "f", 1, 1, 5, "P2", "NPE", 0.7, "UNREVIEWED", "abc", None, ["c1"]),
        ("r", "f", 2, 5, 6, "P1", "OTHER", 0.9, "FALSE_POSITIVE", "b", "x", ["c2", "c1"]),
        ("r", "f", 3, 3, 3, "P3", "STYLE", 0.9, "CONFIRMED", "zabcz", "y", []),
        ("r", "f", 4, 8, 9, "P3", "STYLE", 0.1, "UNREVIEWED", "", None, None),
        ("r", "g", 5, 5, 6, "P3", "STYLE", 0.1, "UNREVIEWED", "q", "x", ["c9"]),
    ], FIELDS)


def test_merge_overlaps(spark):
    got = {(r["file"], r["start_line"]): r for r in N.merge_overlaps(merge_rows(spark)).collect()}
    assert sorted(got) == [("f", 1), ("f", 8), ("g", 5)]
    m = got[("f", 1)]
    assert (m["end_line"], m["severity"], m["confidence"], m["category"], m["status"]) == (6, "P1", 0.9, "STYLE", "CONFIRMED")
    assert (m["evidence"], m["owner"], m["blame_commit_ids"]) == ("zabcz", "y\n---\nx", ["c1", "c2"])


def test_merge_does_not_depend_on_partitioning(spark):
    key = lambda df: sorted(map(str, df.collect()))
    rows = merge_rows(spark)
    assert key(N.merge_overlaps(rows.repartition(7))) == key(N.merge_overlaps(rows.coalesce(1)))


def test_split_merged(spark):
    rows = spark.createDataFrame([("a --- b", "t"), ("x", None)], "evidence string, trigger_text string")
    got = sorted((r["evidence"], r["trigger_text"]) for r in N.split_merged(rows.fillna("n")).collect())
    assert got == [("a", "t"), ("b", "t"), ("x", "n")]


def test_broken_json_is_repaired_or_rejected(spark):
    good = '{"comments":[{"path":"a","content":"x"}]}'
    raw = '{"comments":[{"path":"a","content":"say "hi" now\nplease"}]}'
    rows = spark.createDataFrame([(1, good), (2, raw), (3, '{"comments": [{]}'), (4, "no json")], "id int, body string")
    got = {r["id"]: (r["rejected"], r["parsed"]["comments"][0]["content"] if not r["rejected"] else None)
           for r in N.parse_replies(rows, N.COMMENT_SCHEMA).collect()}
    assert got == {1: (False, "x"), 2: (False, 'say "hi" now\nplease'), 3: (True, None), 4: (True, None)}


def test_owner_shares_sum_to_one_on_long_ranges(spark):
    blame = spark.range(1, 1001).select(F.lit("r").alias("repo_id"), F.lit("f").alias("path"), F.col("id").cast("int").alias("line_no"),
                                        F.concat(F.lit("a"), F.col("id") % 3).alias("author_name"))
    f = spark.createDataFrame([("r", "f", 1, 1000), ("r", "f", 60, 70), ("r", "f", 64, 127), ("r", "f", 5, 5)], "repo_id string, file string, start_line int, end_line int")
    got = N.owner_shares(f, blame).groupBy("start_line", "end_line").agg(F.sum("lines").alias("n"), F.sum("share").alias("s")).collect()
    assert {(r["start_line"], r["end_line"]): r["n"] for r in got} == {(1, 1000): 1000, (60, 70): 11, (64, 127): 64, (5, 5): 1}
    assert all(abs(r["s"] - 1) < 1e-9 for r in got)


def test_owner_text_counts_every_owner(spark):
    f = spark.createDataFrame([("r", "CONFIRMED", "A(50%), B(50%)"), ("r", "UNREVIEWED", "A"), ("r", "CONFIRMED", None)], "repo_id string, status string, owner string")
    got = {r["author"]: (r["open_confirmed"], r["open_total"]) for r in E.open_by_owner(f).collect()}
    assert got == {"A": (1, 2), "B": (1, 1)}


def test_deadline_skips_weekends(spark):
    row = spark.createDataFrame([("2024-03-08",)], "d string").select(
        *[R.deadline(F.lit(s), F.col("d").cast("timestamp")).alias(s) for s in ("P0", "P1", "P2", "P3")]).first()
    assert tuple(row) == ("immediate", "2024-03-13", "2024-03-19", "-")


def test_format_gate_rejects_fail(spark):
    c = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "batch int, position int")
    r = spark.createDataFrame([(1, "ok:\n通过\n不通过")], "batch int, reply string")
    assert sorted(x["position"] for x in C.format_gate(c, r).collect()) == [0, 2]


def test_churn_matches_a_plain_fold(spark):
    """Random hunks, folded by brute force in Python."""
    import random

    rng = random.Random(5)
    rows = []
    for i in range(120):
        oc, nc = rng.randint(0, 3), rng.randint(0, 3)
        kind = "ADD" if oc == 0 and nc > 0 else "DELETE" if oc > 0 and nc == 0 else "MODIFY"
        rows.append(("r", rng.choice("fg"), f"{i:04d}", i, 0, rng.randint(1, 12), oc, rng.randint(1, 12), nc, kind, rng.choice("abc"), i, 0, 0))
    owners, want = {}, []
    for _, path, cid, _, _, os_, oc, ns, nc, kind, who, *_ in rows:
        if kind != "ADD":
            for n in range(os_, os_ + max(oc, 1)):
                if owners.get((path, n), (who,))[0] != who:
                    want.append((path, cid, n, owners[(path, n)][0], who))
                    break
        for n in range(os_, os_ + oc):
            owners.pop((path, n), None)
        for n in range(ns, ns + nc):
            owners[(path, n)] = (who, cid)
    h = spark.createDataFrame(rows, "repo_id string, path string, commit_id string, seq long, hunk_no int, old_start int, old_count int, new_start int, "
                                    "new_count int, kind string, author_name string, created_at int, line_start int, line_end int")
    got = [(r["path"], r["commit_id"], r["line_no"], r["prev"]["author_name"], r["cur"]["author_name"]) for r in X.repeated_changes(h).collect()]
    assert sorted(got) == sorted(want) and want
    held = {(r["path"], r["line_no"]): (r["owner"], r["commit_id"]) for r in X.line_owners(h).collect()}
    assert held == owners


def test_intent(spark):
    got = X.parse_intent(spark.createDataFrame([("fix|HIGH|why",), ("",), ("x",), ("- 增强 | 中",)], "reply string")).collect()
    assert [(r["intent"], r["confidence"], r["reason"]) for r in got] == [
        ("FIX", "HIGH", "why"), ("UNCERTAIN", "LOW", None), ("UNCERTAIN", "LOW", None), ("ENHANCE", "MEDIUM", "")]


def test_reachable_through_nested_merges(spark):
    import random

    rng = random.Random(3)
    parents = {f"c{i}": sorted({f"c{rng.randint(max(0, i - 6), i - 1)}" for _ in range(rng.choice([1, 1, 2, 3]))}) if i else [] for i in range(80)}

    def ancestors(c):
        seen, todo = set(), [c]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += parents[x]
        return seen

    df = spark.createDataFrame([("r", k, v) for k, v in parents.items()], "repo_id string, id string, parent_ids array<string>")
    ranges = spark.createDataFrame([("r", "c40", "c75", "c79")], "repo_id string, since string, until string, tip string")
    got = {r["id"] for r in S.hash_range(df, ranges).collect()}
    assert got == ancestors("c75") - ancestors("c40")


def test_cycles_of_a_dense_graph(spark):
    e = [("r", a, b) for a in "abcd" for b in "abcd" if a != b] + [("r", "x", "a"), ("r", "d", "y")]
    got = {tuple(r["modules"]) for r in G.module_cycles(spark.createDataFrame(e, "repo_id string, source string, target string")).collect()}
    assert len(got) == 6 + 8 + 6 and all(c[0] == min(c) for c in got)


def test_chunks_match_a_greedy_walk(spark):
    import random

    rng = random.Random(9)
    sizes = [rng.choice([0, 1, 3, 10, 25]) for _ in range(200)]
    want, used, chunk = [], 0, 1
    for i, n in enumerate(min(s, 20) for s in sizes):
        if i and used + n > 30:
            chunk, used = chunk + 1, 0
        used += n
        want.append(chunk)
    df = spark.createDataFrame([("r", i, "x" * n) for i, n in enumerate(sizes)], "repo_id string, ord long, content string")
    got = P.chunks(df, ["repo_id"], limit=30, cap=20).orderBy("ord").collect()
    assert [r["chunk"] for r in got] == want


def test_running_over_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    got = scale.running(df, ["k"], [F.col("id")], {"s": ("sum", F.col("id")), "m": ("last", F.when(F.col("id") % 7 == 0, F.col("id")))}, inclusive=False)
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("s", F.sum("id").over(w)).withColumn("m", F.last(F.when(F.col("id") % 7 == 0, F.col("id")), True).over(w))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    ranks = scale.rank_within(df, ["k"], [F.col("id").desc()], "rn").where("k = 'hot'").orderBy("rn").collect()
    assert [r["rn"] for r in ranks] == list(range(1, 2001)) and ranks[0]["id"] == 2999


def test_methods(spark):
    src = "\n".join([
        "class A {", "  /* doc */", "  @Override", "  public int f(int x) {", '    String s = "}{"; // }', "    if (x > 0) {", "      return 1;", "    }", "    return 0;", "  }",
        "  abstract void g(int y);", "  private void f(String z) {", "  }", "}",
    ])
    rows = spark.createDataFrame([("r", "A.java", src)], "repo_id string, path string, content string")
    got = {(r["name"], r["line_no"]): (r["end_line"], r["text"]) for r in Q.methods(rows).collect()}
    assert got[("f", 4)][0] == 10 and got[("f", 4)][1].startswith("  /* doc */\n  @Override\n")
    assert got[("f", 12)][0] == 13 and got[("g", 11)][1].endswith("// (abstract, no body)")


def test_signatures(spark):
    src = "\n".join(["@Transactional", "public void a(int x)", "    throws E {", "}", "@Other", "private int b(int y);", "static C c(int", " x) {", "@Async", "", "public D d() {"])
    rows = spark.createDataFrame([("r", "A.java", src)], "repo_id string, path string, content string")
    assert [r["signature"] for r in P.method_signatures(rows).orderBy("pos").collect()] == [
        "@Transactional public void a(int x) throws E", "@Async public D d()"]


def test_containing_matches_brute_force(spark):
    texts = {"a": "x.call(y)", "b": "public getName()", "c": "->", "d": "Foo.get bar", "e": ""}
    words = ["call", "getNa", "->", "Foo.get", "o.g", "zz", "a", "l(y"]
    t = spark.createDataFrame([("r", k, v) for k, v in texts.items()], "repo_id string, path string, body string")
    w = spark.createDataFrame([("r", x) for x in words], "repo_id string, word string")
    got = {(r["path"], r["word"]) for r in containing(t, w, ["repo_id"], ["path"]).collect()}
    assert got == {(k, x) for k, v in texts.items() for x in words if x in v}


def test_code_link(spark):
    f = lambda r, a, b: spark.range(1).select(R.code_link(F.lit(r), F.lit("m"), F.lit("p/A.java"), F.lit(a), F.lit(b))).first()[0]
    assert f("git@github.com:o/r.git", 9, 3) == "https://github.com/o/r/blob/m/p/A.java#L3-L9"
    assert f("https://git.x.org/o/r.git", 3, 3) == "https://git.x.org/o/r/-/blob/m/p/A.java#L3"


def test_rules_from_table_is_bounded(spark):
    rows = spark.createDataFrame([("b", "B", "b:,", "bee", 2), ("a", "A", None, "ay,bee", 1)], "code string, label string, prefixes string, keywords string, priority int")
    assert C.rules_from_table(rows) == [("a", "A", [], ["ay", "bee"]), ("b", "B", ["b:"], ["bee"])]
    with pytest.raises(ValueError):
        C.rules_from_table(rows.crossJoin(spark.range(600)).drop("id"))


def test_fixed_values_have_no_repeats():
    assert len(set(dims.FRAMEWORK_DIRS)) == len(dims.FRAMEWORK_DIRS)
    assert sorted(dims.DISPLAY_ORDER) == sorted(dims.REPLY_ORDER)
