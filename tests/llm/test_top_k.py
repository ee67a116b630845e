"""Top-k search against all inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coterie.llm import top_k


def plain(rows, k, every):
    """Multiset of (query_id, rank, vec_id, score) by comparing every query row with every other row."""
    out = []
    for i, (q, v) in enumerate(rows):
        if q is None or q % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), p is None, p or 0, j) for j, (p, w) in enumerate(rows) if j != i and len(w) == len(v))
        out += [(q, r + 1, rows[s[3]][0], -s[0]) for r, s in enumerate(scored[:k])]
    return out


def check(spark, rows, k=3, every=5):
    df = spark.createDataFrame(rows, "vec_id long, v array<int>").repartition(4)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted(map(tuple, top_k.top_k(df, F.col("vec_id") % every == 0, k).collect()), key=key)
    assert got == sorted(plain(rows, k, every), key=key)


@pytest.fixture
def small(monkeypatch):
    """Many cells, blocks and groups from few rows."""
    for name, value in {"TOP": 64, "CELLS": 12, "BLOCK": 40, "GROUP": 9}.items():
        monkeypatch.setattr(top_k, name, value)


def test_clustered_vectors_over_many_blocks(spark, small):
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (9, 5))
    check(spark, [(i, (centres[i % 9] + rng.integers(-6, 7, 5)).tolist()) for i in range(500)])


def test_ties_repeats_sizes_and_missing_ids(spark, small):
    rng = np.random.default_rng(2)
    rows = [(i // 2, rng.integers(-1, 2, 3).tolist()) for i in range(200)]
    rows += [(1000 + i, [5, 5, 5]) for i in range(150)] + [(None, [5, 5, 5]), (None, [1, 0, 0])]  # a hot vector, which is a query many times over
    rows += [(2000, [1, 2]), (2005, [3, 4]), (2010, []), (2015, []), (2020, [7])]
    check(spark, rows)


def test_far_blocks_are_not_searched(spark, small, monkeypatch):
    rng = np.random.default_rng(3)
    centres = np.eye(8, dtype=int) * 1000
    rows = [(i, (centres[i % 8] + rng.integers(-9, 10, 8)).tolist()) for i in range(400)]
    searched, search = [], top_k._search
    monkeypatch.setattr(top_k, "_search", lambda q, p, pairs, *a: (searched.extend((r.group, r.block) for r in pairs.collect()), search(q, p, pairs, *a))[1])
    check(spark, rows)
    groups, blocks = {g for g, _ in searched}, {b for _, b in searched}
    assert len(searched) == len(set(searched)) < len(groups) * len(blocks) / 2


def test_node_pairs_are_pruned_inside_a_block():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 6))
    centres = np.rint(4000 * centres / np.linalg.norm(centres, axis=1)[:, None]).astype(int)  # of one length, so that near means similar
    p = (centres[:, None] + rng.integers(-20, 21, (40, 50, 6))).reshape(-1, 6)
    q = p[::10] + 1
    ids = rng.permutation(len(p))
    floor = np.full(len(q), np.iinfo(np.int64).min)
    r, c, s, computed = top_k.search_block(q, p, ids, 4, floor, leaf=4)
    assert computed < len(q) * len(p) / 4
    scores = q @ p.T
    for i in range(len(q)):
        want = sorted(zip(-scores[i], ids))[:4]
        assert sorted(zip(-s[r == i], ids[c[r == i]])) == want


def test_cover_tree_levels_are_nested_separated_and_covering():
    x = np.unique(np.random.default_rng(6).integers(-50, 50, (300, 3)), axis=0)
    tree = top_k.CoverTree(x, leaf=4)
    assert len(tree.levels) > 2 and len(tree.parents) == len(tree.levels) - 1
    for k, (centres, radius, place) in enumerate(tree.levels):
        away = np.sqrt(((x - centres[place]) ** 2).sum(1))
        assert (away <= radius[place]).all()
        if k:
            coarse, _, above = tree.levels[k - 1]
            assert (coarse == centres[: len(coarse)]).all() and (tree.parents[k - 1][place] == above).all()
            apart = np.sqrt(((centres[:, None] - centres) ** 2).sum(2))[np.triu_indices(len(centres), 1)]
            assert apart.min() > 0


def test_products_beyond_floats_are_exact():
    a = np.array([[2**29 + 1, 2**28 + 3]]), np.array([[2**29 - 1, 1 - 2**28], [2**29, 7]])
    assert top_k.products(*a).tolist() == [[sum(int(x) * int(y) for x, y in zip(a[0][0], b)) for b in a[1]]]


def test_empty_table_and_bad_vectors(spark, tmp_path):
    rows = [(0, None), (50, [1.0, None]), (100, [float("nan"), 1.0]), (150, [0.5, 0.25]), (7, [-0.1, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    df.write.parquet(str(tmp_path / "a/embeddings.parquet"))
    df.limit(0).write.parquet(str(tmp_path / "b/embeddings.parquet"))
    assert [tuple(r) for r in top_k.query(spark, str(tmp_path / "a")).collect()] == [(150, 1, 7, 128 * -26 + 64 * 256)]
    assert top_k.query(spark, str(tmp_path / "b")).count() == 0
