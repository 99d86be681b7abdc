"""Strongly connected components and shortest cycles against plain searches."""

import random
import time

import pytest

from gitstrata.operators import structure as G

SCHEMA = "repo_id string, source string, target string"


def reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        for b in edges.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def plain_shortest(edges):
    """Per edge inside a component the least of the shortest ways back, turned to its smallest node."""
    out = set()
    for u, targets in edges.items():
        for v in targets:
            level, ways, seen = [[v]], None, {v}
            while level and ways is None:
                hits = sorted(w for w in level if w[-1] == u)
                if hits:
                    ways = hits[0]
                    break
                grown = {}
                for w in level:
                    for b in edges.get(w[-1], ()):
                        if b not in seen:
                            grown[b] = min(grown.get(b, w + [b]), w + [b])
                seen |= set(grown)
                level = list(grown.values())
            if ways:
                i = ways.index(min(ways))
                out.add(tuple(ways[i:] + ways[:i]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_and_shortest_cycles(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(30)]
    edges = {}
    for _ in range(45):
        edges.setdefault(rng.choice(nodes), set()).add(rng.choice(nodes))
    rows = [(r, a, b) for r in ("one", "two") for a, t in edges.items() for b in t if r == "one" or a < b]
    df = spark.createDataFrame([*rows, ("one", None, "n01"), ("one", "n01", None)], SCHEMA)
    got = {(r["repo_id"], r["node"]): r["component"] for r in G.strong_components(df).collect()}
    far = {n: reach(edges, n) for n in nodes}
    want = {("one", n): max(m for m in far[n] if n in far[m]) for n in nodes if n in far[n]}
    assert got == want
    apart = {a: {b for b in t if b != a} for a, t in edges.items()}
    cycles = {tuple(r["modules"]) for r in G.shortest_cycles(df.where("source <> target")).where("repo_id = 'one'").collect()}
    assert cycles == plain_shortest(apart)


def test_a_complete_graph_ends_soon(spark):
    names = [f"m{i:02d}" for i in range(40)]
    df = spark.createDataFrame([("r", a, b) for a in names for b in names if a != b] + [("r", "x", "m00"), ("q", "a", "b")], SCHEMA)
    start = time.time()
    assert [tuple(r) for r in G.cycle_flags(df).collect()] == [("r", 1, 40)]
    assert G.shortest_cycles(df).count() == 40 * 39 / 2  # pairs
    assert time.time() - start < 60


def test_a_long_cycle_and_no_edges(spark):
    n = 25
    df = spark.createDataFrame([("r", f"{i:02d}", f"{(i + 1) % n:02d}") for i in range(n)], SCHEMA)
    assert [r["length"] for r in G.shortest_cycles(df).collect()] == [n]
    assert G.shortest_cycles(df.where("false")).count() == 0
    assert G.strong_components(df.where("false")).count() == 0
