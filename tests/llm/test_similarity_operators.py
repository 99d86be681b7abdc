"""Joins and searches against brute force, with awkward rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from cases import empty, frame, odd, prose
from pyspark.sql import functions as F

from gitstrata.llm import contamination, embeddings, jaccard, lines, meetings, passages
from gitstrata.llm.graph import components

SF = "/root/testdata/sf0.001"


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(words: list[str], k: int, rng: random.Random) -> list[str]:
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(2000, 2001), (2001, 2002), (2002, 2000)]
    rng.shuffle(pairs)
    sets = Sets({x for p in pairs for x in p})
    for p in pairs:
        sets.join(*p)
    df = spark.createDataFrame([*pairs, (5, 5), (None, 7)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {x: sets.find(x) for x in sets.up}
    assert components(df.where("false")).count() == 0


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard_groups_equal_brute_force(spark, words, percent):
    rng = random.Random(words)
    base = [prose(20, 150).split(), prose(21, 40).split(), prose(22, 700).split()]
    texts = [" ".join(edited(b, rng.randrange(0, 9), rng)) for b in base for _ in range(25)]
    texts += [None, "", "\x1c", "one", "One", "one two", "ONE  two", "é É", "É é", base and " ".join(base[0]), *["same few words here"] * 4]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = frame(spark, texts)
    made = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        n = min(words, len(w))
        made.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set())
    sets, by = Sets(range(len(texts))), defaultdict(list)
    for i, a in enumerate(made):
        common = Counter(j for x in a for j in by[x])
        for x in a:
            by[x].append(i)
        for j, c in common.items():
            if 100 * c >= percent * (len(a) + len(made[j]) - c):
                sets.join(i, j)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(docs, jaccard.Rule(words, percent)).collect()}
    assert got == {i: (len(made[i]), sets.find(i)) for i in range(len(texts))}


def test_jaccard_chunks_of_a_large_group_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    rng = random.Random(5)
    base = prose(30, 120).split()
    texts = [" ".join(edited(base, rng.randrange(2, 8), rng)) for _ in range(120)]
    docs = frame(spark, texts)
    made = [{tuple(t.split()[i:i + 3]) for i in range(118)} for t in texts]
    sets = Sets(range(120))
    for i in range(120):
        for j in range(i):
            c = len(made[i] & made[j])
            if 100 * c >= 90 * (len(made[i]) + len(made[j]) - c):
                sets.join(i, j)
    assert {r.doc_id: r.component_id for r in jaccard.groups(docs).collect()} == {i: sets.find(i) for i in range(120)}


def test_sketch_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        b = np.union1d(a[rng.random(len(a)) < 0.95], rng.integers(0, 2**63, 9, dtype=np.uint64))
        bits = int(np.bitwise_count((jaccard.short_sketch(a) ^ jaccard.short_sketch(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))


def test_long_sketches_and_shared_keys_rule_out_only_what_is_not_linked():
    rng, rule = np.random.default_rng(2), jaccard.Rule(5, 80)
    for _ in range(40):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(20, 3000)), dtype=np.uint64))
        b = np.union1d(a[rng.random(len(a)) < rng.uniform(0.88, 1)], rng.integers(0, 2**63, len(a) // 20, dtype=np.uint64))
        differ, most = len(np.setxor1d(a, b)), rule.differing(len(a) + len(b))
        assert jaccard.sketches_apart([jaccard.long_sketch(a, rule)], [jaccard.long_sketch(b, rule)])[0] <= differ
        if differ <= most:
            sizes = sorted([len(a), len(b)])
            assert len(np.intersect1d(rule.keys(a), rule.keys(b))) >= rule.least_common(np.array(sizes[:1]), np.array(sizes[1:]))[0]
    # Sets of three thousand that share two thirds: 512 bits let such a pair through, the long sketch does not.
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2000], rng.integers(0, 2**63, 1000, dtype=np.uint64)])
    most = rule.differing(6000)
    assert np.bitwise_count((jaccard.short_sketch(a) ^ jaccard.short_sketch(b)).view(np.uint64)).sum() <= most
    assert jaccard.sketches_apart([jaccard.long_sketch(a, rule)], [jaccard.long_sketch(b, rule)])[0] > most


def test_a_meeting_names_fewer_pairs_than_it_has_components():
    n = 60
    a, b = np.triu_indices(n, 1)
    pairs = pd.DataFrame({"a": a, "b": b, "ca": a, "cb": b, "apart": (b - a)})
    named = jaccard.forest(pairs)
    assert len(named) == n - 1 and set(named["apart"]) == {1}


def test_jaccard_stands_odd_rows(spark):
    got = jaccard.groups(odd(spark)).toPandas()
    assert len(got) == 10 and set(got[got.doc_id.isin([4, 5])].component_id) == {4}
    assert set(got[got.doc_id.isin([1, 2, 3])].n_shingles) == {0}
    assert jaccard.groups(empty(spark)).count() == 0
    left = jaccard.one_of_each(odd(spark), jaccard.Rule(5, 80))
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 6, 7, 8] and left.columns == odd(spark).columns


def test_cap_filters_find_links_and_count_copies(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((40, 32))
    x = np.concatenate([c + rng.standard_normal((30, 32)) * s for c, s in zip(centers, np.linspace(0.05, 0.4, 40), strict=True)])
    x = np.concatenate([x, x[:50], x[:1].repeat(40, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [None, [0.0] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [1.0, None], [], [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame([*rows, *[(10_000 + i, v) for i, v in enumerate(bad)], (None, x[3].tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near(df).collect()}
    assert len(got) == len(rows) + 9
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    want, have = link.sum(), sum(got[i].n_links for i in range(len(x)))
    assert have >= 0.95 * want
    extra = link[:, 3].astype(int)  # the row with a null id repeats vector 3
    extra[3] = 1
    assert all(got[i].n_links <= link[i].sum() + extra[i] for i in range(len(x)))
    assert all(got[10_000 + i].n_links == 0 and got[10_000 + i].kept for i in range(6))
    assert got[10_007].component_id == 10_006 and not got[10_007].kept
    assert embeddings.near(df.where("false")).count() == 0


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(300):
        a = [rng.choice("abé") for _ in range(rng.randint(4, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b))
            b[at:at + rng.choice([0, 1])] = rng.choice(["", "a", "b", "é"])
        if b and abs(len(a) - len(b)) <= edits:
            rows.append(("".join(a), "".join(b)))
    got = spark.createDataFrame(rows, "p string, t string").select("p", "t", lines.within(F.col("p"), F.col("t"), edits).alias("w")).collect()
    assert all(r.w == (distance(r.p, r.t) <= edits) for r in got)


def test_edits_beyond_a_long_equal_start(spark):
    base = prose(3, 20)[:128]
    rows = [(base[:n] + a, base[:n] + b) for n in (31, 32, 33, 64, 128) for a, b in [("", "x"), ("x", ""), ("x", "y"), ("xy", "zw"), ("ab", "b"), ("", "xy")]]
    df = spark.createDataFrame(rows, "p string, t string").withColumn("skip", lines.same_start(F.col("p"), F.col("t")))
    rest = [F.expr(f"substring({c}, skip + 1, length({c}))").alias(c) for c in "pt"]
    cut = df.select(F.col("p").alias("whole_p"), F.col("t").alias("whole_t"), *rest).where("abs(length(p) - length(t)) <= 1")
    for r in cut.withColumns({"w": lines.within(F.col("p"), F.col("t"), 1), "v": lines.within(F.col("p"), F.col("t"), 1, 64)}).collect():
        assert r.w == (distance(r.whole_p, r.whole_t) <= 1) and (r.v or not r.w)


@pytest.mark.parametrize("edits", [1, 2])
def test_repeated_lines_equal_brute_force(spark, edits):
    rng = random.Random(edits + 10)
    pool = [prose(40 + i, 3)[:rng.randint(20, 34)] for i in range(12)]

    def change(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(s))
            s[at:at + rng.choice([0, 1])] = rng.choice(["", "x", "q"])
        return "".join(s)

    texts = ["\n".join(change(rng.choice(pool)) if rng.random() < 0.7 else rng.choice(["", "Of.", "Oe.", pool[0]]) for _ in range(6)) for _ in range(40)]
    order = [(d, n, s) for d, t in enumerate(texts) for n, s in enumerate(t.split("\n")) if s.strip()]
    sets = Sets(sorted({s for *_, s in order}))
    names = sorted(sets.up)
    for i, a in enumerate(names):
        for b in names[:i]:
            if min(len(a), len(b)) >= lines.LEAST_CHARS and distance(a, b) <= edits:
                sets.join(a, b)
    seen, gone = set(), defaultdict(set)
    for d, n, s in order:
        root = sets.find(s)
        if root in seen:
            gone[d].add(n)
        seen.add(root)
    got = {r.doc_id: r for r in lines.clean(frame(spark, texts), edits).collect()}
    for d, t in enumerate(texts):
        assert got[d].text == "\n".join(s for n, s in enumerate(t.split("\n")) if n not in gone[d])
        assert got[d].n_removed == len(gone[d])


def test_lines_stand_odd_rows(spark):
    got = lines.clean(odd(spark))
    assert got.columns[:-2] == odd(spark).columns
    rows = got.orderBy("doc_id", "removed").collect()
    assert len(rows) == 9  # of the doubled row one is left
    assert [r.text for r in rows if r.doc_id in (1, 2, 3)] == [None, "", " \n\t "]
    assert [r.n_removed for r in rows if r.doc_id == 5] == [1]
    assert lines.clean(empty(spark)).count() == 0


def test_benchmark_passages_equal_brute_force(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, re.findall(r"[^\W_]+", r.text.lower())) for r in bench.collect()]
    rng = random.Random(6)
    more = []
    for _, w in items[:12]:
        near = list(w)
        near[rng.randrange(len(near))] = "changed"
        more += [f"{prose(70, 9)} {' '.join(w)} {prose(71, 9)}", f"{prose(72, 3)} {'!! '.join(near).upper()}"]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))

    def grams(w):
        return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))

    want = set()
    for r in docs.collect():
        w = re.findall(r"[^\W_]+", (r.text or "").lower())
        here = set(grams(w))
        for item, words in items:
            theirs = grams(words)
            if not here & set(theirs):
                continue
            for s in range(max(0, len(w) - len(words)) + 1):
                mine = grams(w[s:s + len(words)])
                if len(w) >= len(words) and sum((mine & theirs).values()) >= 0.8 * sum((mine | theirs).values()):
                    want.add((r.doc_id, item))
    got = {(r.doc_id, r.item_id) for r in contamination.find(docs, bench).collect()}
    assert len(want) > 12 and got == want
    left = contamination.decontaminate(docs, bench)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_documents_shorter_than_a_benchmark_item_are_compared(spark):
    items = [prose(300 + i, 38 + i).split() for i in range(8)] + ["four words make this".split()]
    texts = []
    for w in items[:8]:
        texts += [w[1:], w[:-1], w[2:-1], w[:20] + w[21:], w[:-9], w[:12], w]
    texts += [items[8], items[8][:3]]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")

    def grams(w, n):
        return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))

    want = {}
    for d, w in enumerate(texts):
        for i, item in enumerate(items):
            n = min(5, len(item))
            a, b = grams(w, n), grams(item, n)
            if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                want[d, i] = len(w)
    docs = frame(spark, [" ".join(w) for w in texts])
    got = {(r.doc_id, r.item_id): r.n_words for r in contamination.find(docs, bench).collect()}
    assert len(want) > 24 and got == want
    left = {r.doc_id for r in contamination.decontaminate(docs, bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in want}


def test_decontamination_stands_odd_rows(spark):
    bench = spark.createDataFrame([(1, prose(1, 80)), (2, prose(1, 80)), (3, None), (4, ""), (5, "two words"), (None, prose(2, 40))], "item_id long, text string")
    got = contamination.find(odd(spark), bench).collect()
    assert {(r.doc_id, r.item_id, r.copies) for r in got} == {(4, 1, 2), (5, 1, 2), (None, None, 1)}
    assert sorted(r.doc_id for r in contamination.decontaminate(odd(spark), bench).collect()) == [1, 2, 3, 6, 7, 8]
    assert contamination.decontaminate(odd(spark), bench.where("false")).count() == 10
    assert contamination.find(empty(spark), bench).count() == 0


def test_shared_passages_are_found_whatever_surrounds_them(spark, monkeypatch):
    monkeypatch.setattr(passages, "CHUNK", 4)
    rng = random.Random(8)
    texts, planted = [], set()
    for i in range(30):
        shared = prose(500 + i, 51)
        for k in range(2):
            planted.add(len(texts))
            texts.append(f"{prose(600 + 2 * i + k, rng.randrange(0, 90))} {shared}\n{prose(700 + 2 * i + k, rng.randrange(0, 90))}".strip())
    base = prose(900, 200).split()
    for _ in range(12):
        planted.add(len(texts))
        texts.append(" ".join(edited(base, 3, rng)))
    clean = [prose(1000 + i, 150) for i in range(60)]
    got = passages.repeats(frame(spark, [*texts, *clean])).toPandas()
    assert set(got.doc_id) == planted
    assert (got.first_doc_id <= got.doc_id).all() and got.kept.any()
    assert (got.n_words >= passages.LENGTH).all()


def test_whole_paragraphs_with_changed_words_are_found(spark):
    rng, texts, pairs, rest = random.Random(12), [], [], iter(range(2000, 9000))
    for i in range(120):
        size, sep = rng.randrange(60, 101), "\n" if i % 2 else "\n\n"
        words = prose(next(rest), size).split()
        near = list(words)
        for at in rng.sample(range(5, size - 5), 1 if size < 96 or i % 3 else 2):
            near[at] = "changed"
        # Every second one stands as a wrapped block between blank lines.
        wrapped = lambda w: " ".join(w) if i % 2 else " ".join(w[:9]) + "\n" + " ".join(w[9:])  # noqa: B023, E731
        pairs.append((len(texts), len(texts) + 1))
        texts += [f"{prose(next(rest), 40)}{sep}{wrapped(w)}{sep}{prose(next(rest), 40)}" for w in (words, near)]
    short = prose(next(rest), 31).split()
    pairs.append((len(texts), len(texts) + 1))
    texts += [" ".join(short), " ".join([*short[:-1], "changed"])]
    got = {(r.doc_id, r.first_doc_id, r.kept) for r in passages.repeats(frame(spark, texts)).collect()}
    assert len({p for p in pairs if (p[1], p[0], False) in got}) >= 0.95 * len(pairs) and (240, 240, True) in got
    assert all(d // 2 == f // 2 for d, f, _ in got)


def test_paragraphs_of_a_text_do_not_depend_on_its_neighbours():
    texts = [None, "", "a b c", prose(3001, 300), "x " * 100, prose(3002, 31), "five words of a heading\n\n" + prose(3003, 60), " ", prose(3004, 32)]

    def told(some):
        p = passages.Paragraphs(some)
        kinds = [p.starts(), p.words, p.hashes()]
        made = [passages.parted(k, p.offsets) for k in kinds] + [passages.parted(k, o) for k, o in p.keys()]
        return [[k[i].tolist() for k in made] for i in range(len(some))]

    together = told(texts)
    assert together == [told([t])[0] for t in texts]
    assert [len(t[0]) > 0 for t in together] == [False, False, False, True, True, True, True, False, True]
    assert list(passages.pieces([None, "a" * passages.CHARACTERS, "b"])) == [(0, 2), (2, 3)]


def test_a_line_is_no_repeat_of_its_own_block(spark):
    line = prose(77, 60)
    got = passages.repeats(frame(spark, [f"five words of a heading\n{line}\n\n{prose(78, 40)}", line])).collect()
    assert {(r.doc_id, r.kept) for r in got} == {(0, True), (1, False)}


def test_passages_stand_odd_rows(spark):
    got = passages.repeats(odd(spark)).toPandas()
    assert set(got.doc_id) == {4, 5} and set(got[got.kept].doc_id) == {4}
    assert passages.repeats(empty(spark)).count() == 0


def test_meetings_bring_every_two_rows_together_once(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)], "key long, h long")
    parts = spark.createDataFrame([(1, 6)], "key long, parts int")
    got = meetings.arrange(rows.union(spark.createDataFrame([(2, 1)], "key long, h long")), parts, "h").toPandas()
    assert len(got[got.key == 2]) == 1
    got = got[got.key == 1]
    met = Counter()
    for (_, i, j), g in got.groupby(["key", "i", "j"]):
        m = list(zip(g.h, g.part, strict=True))
        met.update((a, b) for x, (a, p) in enumerate(m) for b, q in m[x + 1:] if i == j or p != q)
    assert len(met) == 50 * 49 // 2 and set(met.values()) == {1}


def test_shuffles_of_a_settled_table_go_while_its_plan_is_held(spark):
    import gc
    import time

    from gitstrata.llm.sized import settled

    def shuffles():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()

    def fewer(n):
        for _ in range(40):
            if shuffles() <= n:
                return True
            time.sleep(0.25)
        return False

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = shuffles()
    held = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    assert len(settled(held).collect()) == 7 and fewer(before) and held.columns
