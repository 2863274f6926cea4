"""Nearest vectors and rank fusion against brute force on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import knn, rank_fusion


def brute_knn(rows, k, dim, floor=-1.0):
    have = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == dim and np.isfinite(v).all() and any(v):
            have.setdefault(i, np.asarray(v, np.float64) / np.linalg.norm(v))
    out = {}
    for a, x in have.items():
        best = sorted(((b, round(float(x @ y), 6)) for b, y in have.items() if b != a), key=lambda t: (-t[1], t[0]))[:k]
        out[a] = [b for b, c in best if c >= floor]
    return out


@pytest.mark.parametrize("floor,blocks", [(-1.0, 1), (-1.0, 5), (0.6, 5)])
def test_neighbours_equal_brute_force(spark, floor, blocks):
    r = np.random.default_rng(1)
    base = r.normal(size=(300, 16)).astype(np.float32)
    base[150:250] = base[:100] + r.normal(scale=0.4, size=(100, 16)).astype(np.float32)
    rows = [(f"v{i:03d}", [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(f"copy{i:02d}", rows[5][1]) for i in range(30)] + [("double", [2 * x for x in rows[5][1]])]
    rows += [("v000", rows[0][1]), ("zero", [0.0] * 16), ("nan", [float("nan")] * 16), ("short", [1.0]), ("none", None), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "id string, vec array<float>").withColumn("class", F.lit("clash")).withColumn("item", F.lit(0))
    got = {}
    for x in knn.nearest_vectors(df, "id", "vec", k=10, dim=16, min_cosine=floor, block_rows=max(1, 331 // blocks), min_blocks=blocks).collect():
        got.setdefault(x.item, {})[x["rank"]] = x.neighbor
    want = brute_knn(rows, 10, 16, floor)
    for a, best in want.items():
        assert [got.get(a, {}).get(i + 1) for i in range(len(best))] == best and len(got.get(a, {})) == len(best)
    assert set(got) <= set(want)


def test_dense_vectors_give_no_more_than_k_rows_a_tile(spark):
    from quillspan.llm.knn import _Block, _scaled, _tile
    from quillspan.operators.topk import Heaps

    r = np.random.default_rng(5)
    given = (r.normal(size=(5000, 64)) * 0.25 + 1).astype(np.float32)  # cosines over 0.9 throughout

    class Made(_Block):
        def __init__(self, rows):
            self.items, self.unit = np.asarray([f"v{i:05d}" for i in rows]), _scaled(given[rows])
            self.scale = np.abs(self.unit).max(axis=1) / 127
            self.codes = np.round(self.unit / self.scale[:, None]).astype(np.int8)
            self.err = np.linalg.norm(self.unit - self.codes * self.scale[:, None], axis=1)

    a, b = Made(np.arange(2500)), Made(np.arange(2500, 5000))
    heaps = Heaps(len(a), 10, 0.8)
    for other, same in ((a, True), (b, False)):
        _tile(a, other, same, heaps)
    cos = _scaled(given) @ _scaled(given).T
    np.fill_diagonal(cos, -9)
    assert cos[0, 1:].min() > 0.8 and heaps.item.shape == (2500, 10)
    for i in range(0, 2500, 97):
        assert sorted(heaps.score[i]) == pytest.approx(sorted(cos[i])[-10:], abs=1e-9)


def test_a_vector_with_a_null_part_takes_no_part(spark):
    rows = [("a", [1.0, 0.0, 1.0, 0.0]), ("b", [1.0, 0.1, 1.0, 0.0]), ("c", [1.0, None, 0.0, 1.0, 0.0]), ("d", [1.0, None, 1.0, 0.0])]
    got = knn.nearest_vectors(spark.createDataFrame(rows, "id string, vec array<float>"), "id", "vec", k=3, dim=4).collect()
    assert {(x.item, x.neighbor) for x in got} == {("a", "b"), ("b", "a")}


def test_an_id_of_several_vectors_counts_once(spark):
    r = np.random.default_rng(9)
    rows = [(f"v{i % 40:02d}", [float(x) for x in r.normal(size=8)]) for i in range(60)]
    got = knn.nearest_vectors(spark.createDataFrame(rows, "id string, vec array<float>"), "id", "vec", k=5, dim=8, min_blocks=3).collect()
    assert len(got) == 40 * 5 and all(x.item != x.neighbor for x in got) and len({(x.item, x.neighbor) for x in got}) == 200


def test_no_vectors(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0])], "id string, vec array<float>")
    assert knn.nearest_vectors(df, "id", "vec", dim=2).count() == 0 and knn.nearest_vectors(df.limit(0), "id", "vec", dim=2).count() == 0


def brute_ranking(rows):
    by = {}
    for g, i, *s in rows:
        if i is not None:
            old = by.setdefault(g, {}).setdefault(i, [None, None])
            by[g][i] = [max((x for x in (o, n) if x is not None and x == x), default=None) for o, n in zip(old, s)]
    out = {}
    for g, items in by.items():
        ranks = {i: [] for i in items}
        for c in (0, 1):
            if all(v[c] is None for v in items.values()):
                continue
            for i, v in items.items():
                key = lambda x: float("-inf") if x is None else x
                better = sum(key(w[c]) > key(v[c]) for w in items.values())
                same = sum(key(w[c]) == key(v[c]) for w in items.values())
                ranks[i].append(better + (same + 1) / 2)
        order = sorted(items, key=lambda i: (sum(ranks[i]) / len(ranks[i]) if ranks[i] else 0, i))
        out[g] = order
    return out


@pytest.mark.parametrize("window", [10, 1000])
def test_fused_ranking(spark, window):
    r = random.Random(3)
    score = lambda: r.choice([None, float("nan"), r.random() * 10 ** r.randrange(6), 1.0, 1.0])
    rows = [(g, f"i{i:02d}", score(), score() if g != 2 else None) for g in range(4) for i in range(40)]
    rows += rows[:10] + [(None, "n1", 1.0, 2.0), (None, "n2", 2.0, 1.5), (5, None, 1.0, 1.0), (6, "x", None, None), (6, "w", None, None)]
    df = spark.createDataFrame(rows, "g int, item string, s double, h double").withColumn("position", F.lit("clash"))
    got = {}
    for x in rank_fusion.fuse_scores(df, ["g"], "item", ["s", "h"], window_rows=window).orderBy("position").collect():
        got.setdefault(x.g, []).append(x.item)
    assert got == brute_ranking(rows)
    assert rank_fusion.fuse_scores(df.limit(0), ["g"], "item", ["s", "h"]).count() == 0
