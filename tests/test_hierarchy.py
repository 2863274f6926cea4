import random
from collections import defaultdict, deque

import pytest

from quillspan.operators.components import connected_components
from quillspan.operators.hierarchy import Hierarchy
from quillspan.operators.ranking import positions, spread_positions


def brute(edges):
    """(roots with fewest steps, cycles) by search from every node."""
    up, nodes = defaultdict(set), set()
    for c, p in edges:
        up[c].add(p)
        nodes |= {c, p}
    dist = {}
    for n in nodes:
        seen, todo = {}, deque((p, 1) for p in up[n])
        while todo:
            x, d = todo.popleft()
            if x not in seen:
                seen[x] = d
                todo.extend((p, d + 1) for p in up[x])
        dist[n] = seen
    roots = {(n, r, d) for n in nodes for r, d in dist[n].items() if not up[r]}
    cycles = {(n, min(x for x in dist[n] if n in dist[x])) for n in nodes if n in dist[n]}
    return roots, cycles


def build(spark, edges):
    return Hierarchy(spark.createDataFrame([("k", c, p) for c, p in edges], "kind string, child long, parent long"))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = {(r.randrange(40), r.randrange(40)) for _ in range(45)}
    h = build(spark, sorted(edges))
    roots, cycles = brute(edges)
    assert {(x.node, x.root, x.depth) for x in h.roots().collect()} == roots
    assert {(x.node, x.cycle) for x in h.cycles.collect()} == cycles


@pytest.mark.parametrize("seed", [3, 4])
def test_descendants_over_several_parents_and_cycles(spark, seed):
    r = random.Random(seed)
    edges = {(r.randrange(40), r.randrange(40)) for _ in range(50)} | {(101, 100), (101, 102), (103, 101), (200, 201), (201, 202),
        (202, 200), (300, 300)} | {(400 + i, 401 + i) for i in range(11)}
    up = defaultdict(set)
    for c, p in edges:
        up[c].add(p)
    want = set()
    for n in list(up):
        seen, todo = {}, deque((p, 1) for p in up[n])
        while todo:
            x, d = todo.popleft()
            if x not in seen:
                seen[x] = d
                todo.extend((p, d + 1) for p in up.get(x, ()))
        want |= {(x, n, d) for x, d in seen.items()}
    got = [(x.node, x.descendant, x.depth) for x in build(spark, sorted(edges)).descendants().collect()]
    assert len(got) == len(set(got)) and set(got) == want and (102, 103, 2) in want


def test_a_long_chain_of_two_parents_takes_few_rounds(spark, monkeypatch):
    from quillspan.operators import hierarchy

    rounds = []
    staged = hierarchy.stage_counted
    monkeypatch.setattr(hierarchy, "stage_counted", lambda df, label, **c: rounds.append(label) or staged(df, label, **c))
    n = 400
    edges = [(i, i + 1) for i in range(n)] + [(i, i + 2) for i in range(n - 1)]  # the longest shortest way has n / 2 steps
    h = build(spark, edges)
    assert {(x.node, x.root, x.depth) for x in h.roots().collect()} == {(i, n, -(-(n - i) // 2)) for i in range(n)}
    assert rounds.count("closure") <= 10 and rounds.count("double") <= 10


def test_tree_ranges_and_paths(spark):
    #       1
    #     2   3
    #   4 5     6 - 7
    h = build(spark, [(2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, 6), (2, 1)])
    f = {x.node: x for x in h.forest.collect()}
    assert {n: (x.depth, x.size, x.top) for n, x in f.items()} == {1: (0, 7, 1), 2: (1, 3, 1), 3: (1, 3, 1), 4: (2, 1, 1),
        5: (2, 1, 1), 6: (2, 2, 1), 7: (3, 1, 1)}
    inside = lambda a, b: f[a].pre <= f[b].pre < f[a].pre + f[a].size
    assert [n for n in f if inside(2, n)] and {n for n in f if inside(3, n)} == {3, 6, 7}
    assert {x.node: x.path for x in h.paths().collect()}[7] == [6, 3, 1]
    assert {(x.node, x.descendant, x.depth) for x in h.descendants().collect()} == {
        (1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 2), (1, 6, 2), (1, 7, 3), (2, 4, 1), (2, 5, 1), (3, 6, 1), (3, 7, 2), (6, 7, 1),
    }


def test_hot_parent_is_numbered_across_partitions(spark):
    edges = [(i, 1) for i in range(2, 60)] + [(100 + i, i) for i in range(2, 60)]
    h = Hierarchy(spark.createDataFrame([("k", c, p) for c, p in edges], "kind string, child long, parent long"), window_rows=10)
    f = h.forest.collect()
    assert sorted(x.pre for x in f) == list(range(len(f)))


def test_empty_null_and_clashing_columns(spark):
    h = Hierarchy(spark.createDataFrame([], "kind string, child long, parent long"))
    assert h.roots().count() == 0 and h.cycles.count() == 0
    df = spark.createDataFrame([("k", 1, None, "x"), ("k", 2, 1, "y"), (None, 3, 1, "z")], "kind string, child long, parent long, top string")
    assert [(x.node, x.root, x.depth) for x in Hierarchy(df).roots().collect()] == [(2, 1, 1)]


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("d", "e"), ("f", "f"), (None, "g"), ("b", "a")] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[x] for x in "abc"} == {"a"} and {got[x] for x in "de"} == {"d"} and got["f"] == "f"
    assert {v for k, v in got.items() if k.startswith("n")} == {"n000"}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_positions(spark):
    from pyspark.sql import functions as F

    rows = [(g, i * 7 % 50) for g in ("x", "y", None) for i in range(50)] + [("z", 1)]
    df = spark.createDataFrame(rows, "g string, v int")
    want = {(g, v): sorted(x for y, x in rows if y == g).index(v) + 1 for g, v in rows}
    for limit in (10, 1000):
        assert {(x.g, x.v): x.n for x in positions(df, ["g"], [F.col("v").asc()], "n", limit).collect()} == want
    run = {(x.g, x.v): x.s for x in spread_positions(df, ["g"], [F.col("v").asc()], "s", weight="v").collect()}
    assert run[("x", 49)] == sum(range(50))
