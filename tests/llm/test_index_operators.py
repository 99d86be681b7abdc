"""Hard negatives, centroid clusters and fingerprints against plain versions, with awkward rows."""

import hashlib
import random

import numpy as np
import pytest
from cases import empty, frame, odd, prose
from harness import compare, duck

from gitstrata.llm import centroids, fingerprints, negatives
from gitstrata.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, label int, embedding array<float>, anchor boolean"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_pca_clusters"])
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None


def whole(v, scale):
    return [int(np.floor(float(np.float32(x)) * scale)) for x in v]


def plain_negatives(rows, low=80, high=100):
    taken = {}
    for i, label, v, anchor in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        key = (i, label, tuple(whole(v, 256)))
        taken[key] = taken.get(key, False) or bool(anchor)
    size = max(len(k[2]) for k in taken)
    keys = list(taken)
    x = np.asarray([[*k[2], *[0] * (size - len(k[2]))] for k in keys], dtype=np.int64)
    out = set()
    for a, k in enumerate(keys):
        if not taken[k]:
            continue
        order = sorted(range(len(keys)), key=lambda j: (-int(x[a] @ x[j]), keys[j][0]))
        scores = {j: int(x[a] @ x[j]) for j in order}
        same = [j for j in order if keys[j][1] == k[1] and keys[j][0] != k[0]]
        first = list(dict.fromkeys((scores[j], keys[j][0]) for j in same))[:5]
        for s, found in first:
            fits = list(dict.fromkeys((scores[j], keys[j][0]) for j in order if keys[j][1] != k[1] and low * s <= 100 * scores[j] <= high * s))[:5]
            out |= {(k[0], found, n, i, s, t) for n, (t, i) in enumerate(fits, 1)}
    return out


def vectors(n: int, size: int, seed: int):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((12, size))
    v = middle[rng.integers(0, 12, n)] + rng.standard_normal((n, size)) * rng.choice([0.02, 0.3, 1.0], (n, 1))
    v[n // 2:n // 2 + n // 6] = v[0]  # one very common vector
    v[-40:] = np.round(v[-40:] * 2) / 2  # ties
    return v.astype(np.float32)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 60)
    monkeypatch.setattr(negatives, "PIVOTS", 9)
    monkeypatch.setattr(negatives, "QUERIES", 13)
    v = vectors(900, 6, 1)
    rows = [(i, i * 7 % 5 if i % 3 else 0, [float(x) for x in v[i]], i % 12 == 0) for i in range(len(v))]
    rows += [
        (2000, None, [1.0] * 6, True), (2001, 1, None, True), (2002, 1, [1.0, None] * 3, True), (2003, 1, [float("nan")] * 6, True),
        (2004, 1, [float("inf")] * 6, False), (None, 1, [1.0] * 6, True), (2005, 2, [0.0] * 6, True), (2006, 2, [], True),
        (2007, 2, [1.0, 2.0], True), (2008, 9, [1.0] * 6, True), rows[0], rows[0], rows[24],
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{VECTORS}, pivot int, kind string")
    got = [tuple(r) for r in negatives.mine(df).collect()]
    want = plain_negatives(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200
    assert negatives.mine(df.where("false")).count() == 0
    assert negatives.mine(df.where("vec_id >= 2000 and vec_id < 2005")).count() == 0


def test_cover_tree_skips_and_stays_exact(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 4)
    monkeypatch.setattr(negatives, "FANOUT", 5)
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((20, 5))[rng.integers(0, 20, 700)] * 60 + rng.standard_normal((700, 5)) * 3).astype(np.int64)
    sphere = negatives.Sphere(float(np.sqrt((x**2).sum(axis=1).max())))
    tree = negatives.CoverTree(x, [[i] for i in range(len(x))], sphere).opened()
    kids = tree.children > 0
    for node in np.flatnonzero(kids):  # every level's covering radius holds all below it, and shrinks or is split
        below, seen = [node], []
        while below:
            k = below.pop()
            seen += list(range(tree.first[k], tree.end[k])) if not tree.children[k] else []
            below += list(range(tree.child[k], tree.child[k] + tree.children[k]))
        far = np.sqrt(((tree.x[seen] - tree.centres[node]) ** 2).sum(axis=1)).max()
        assert far <= tree.plain[node] * (1 + 1e-9)
    looked = []
    class Counted(np.ndarray):
        def __matmul__(self, other):
            looked.append(len(self))
            return np.asarray(self) @ other
    tree.x = tree.x.view(Counted)
    for q in x[:20] + 1:
        scores = x @ q
        windows = [(negatives.NONE, -negatives.NONE), (int(np.quantile(scores, 0.3)), int(np.quantile(scores, 0.6)))]
        for (low, high), found in zip(windows, tree.search(q, *zip(*windows), 7), strict=True):
            fits = sorted((-int(s), i) for i, s in enumerate(scores) if low <= s <= high)[:7]
            assert found == fits
    assert sum(looked) < 0.5 * 20 * len(x)


def plain_clusters(rows, size, count, rounds):
    kept = [(i, whole(v, 64)) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centres = [q for _, q in named[:count]]
    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        centres = [[sum(col) // len(groups[k]) for col in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(centres)]
    last = [(i, *near(q)[::-1]) for i, q in kept]
    own = {k: sum(d for _, c, d in last if c == k) for k in range(len(centres))}
    return sorted(
        ((i, k, d, own[k], sum(own.values()), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for i, k, d in last), key=repr
    )


def test_clusters_equal_brute_force(spark):
    v = vectors(400, 8, 3)
    rows = [(i, [float(x) for x in v[i]]) for i in range(len(v))]
    rows += [(900, None), (901, [1.0] * 7), (902, [None] * 8), (903, [float("nan")] * 8), (None, [0.5] * 8), rows[7], rows[7], (904, [-0.0] * 8), (905, [1e30] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, cluster int")
    got = sorted((tuple(r) for r in centroids.cluster(df, size=8).collect()), key=repr)
    assert got == plain_clusters([r for r in rows if r[0] != 905], 8, 16, 3)
    few = df.where("vec_id < 5")
    assert centroids.cluster(few, size=8).select("cluster").distinct().count() == 5
    assert centroids.cluster(df.where("vec_id = 900"), size=8).count() == 0


def test_projected_bounds_leave_few_pairs_and_no_wrong_one():
    rng = np.random.default_rng(2)
    x = np.floor(rng.standard_normal((2000, 64)) * np.geomspace(80, 1, 64)).astype(np.int64)
    centres = x[:16]
    turn = np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
    number, far, measured = centroids.nearest(x, *centroids.projected(x, turn, 12), centres, turn)
    d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (number == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
    assert measured < 0.4 * d.size


def shingle_set(text, words=5):
    w = text.lower().split()
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_equal_a_plain_pass(spark):
    rng = random.Random(4)
    texts = [prose(i, rng.choice([3, 30, 200, 900])) for i in range(60)]
    texts += [None, "", "one", "é" * 9, "x" * 30_000, texts[5], texts[5], "a b c d e f", " \n "]
    docs = frame(spark, texts).repartition(7)
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        k = len(t) // 4
        changed = t[:len(t) - k] + following[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.fold(t), fingerprints.fold(changed))
        assert r.near_edited == pytest.approx(fingerprints.near(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(fingerprints.near(r.fingerprint, fingerprints.fold(following)))
        assert abs(r.near_edited - jaccard(t, changed)) < 0.15
        assert abs(r.near_next - jaccard(t, following)) < 0.15


def test_likeness_is_unbiased():
    for share in (0.0, 0.2, 0.5, 0.8, 0.95):
        off = []
        for seed in range(40):
            rng = random.Random(f"{share}-{seed}")
            n = rng.choice([60, 300, 3000])
            a = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            b = a[:int(n * share)] + [f"w{rng.randrange(10**9)}" for _ in range(n - int(n * share))]
            a, b = " ".join(a), " ".join(b)
            off.append(fingerprints.near(fingerprints.fold(a), fingerprints.fold(b)) - jaccard(a, b))
        assert abs(np.mean(off)) < 0.02 and np.abs(off).max() < 0.16


def test_packed_bits_round_trip():
    values = np.random.default_rng(0).integers(0, 16, 512).astype(np.uint8)
    text = fingerprints.packed(values).hex()
    assert len(text) == 512 and (fingerprints.unpacked(text) == values).all()
    assert fingerprints.packed(None) == b"" and fingerprints.unpacked("") is None


def test_awkward_documents(spark):
    rows = fingerprints.fingerprints(odd(spark)).collect()
    assert len(rows) == odd(spark).count()
    by = sorted((r for r in rows if r.doc_id == 4), key=lambda r: r.near_next)
    assert by[0].fingerprint == by[1].fingerprint and by[1].near_next == 1.0
    assert next(r for r in rows if r.doc_id is None).n_chars > 0
    assert fingerprints.fingerprints(empty(spark)).count() == 0
    only = fingerprints.fingerprints(frame(spark, ["just one text of some words"])).collect()
    assert len(only) == 1 and only[0].near_next == 1.0
