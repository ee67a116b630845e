"""Centroid clustering against plain Lloyd rounds over all centroids."""

import hashlib

import numpy as np
import pytest

from coterie.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label string, cluster string"


def plain(vectors, k, rounds):
    """(cluster, distance) of each vector and the final centroids, every centroid compared."""
    order = sorted(vectors, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), i) for i, x in enumerate(c))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in vectors]
        for i in range(len(c)):
            mine = [v for (_, v), f in zip(vectors, found) if f == i]
            if mine:
                c[i] = [sum(x) // len(mine) for x in zip(*mine)]
    return [near(v) for _, v in vectors], c


def test_nearest_equals_a_full_comparison_and_skips_most_centroids():
    rng = np.random.default_rng(3)
    c = rng.integers(-40, 40, (200, 8)) + rng.integers(-300, 300, (200, 1))
    x = np.vstack([c[rng.integers(0, 200, 3000)] + rng.integers(-3, 4, (3000, 8)), c[:5]])
    c[7] = c[3]  # a tie goes to the smaller number
    found, best, compared = centroids.nearest(x, c)
    d = ((x[:, None] - c) ** 2).sum(2)
    assert (found == d.argmin(1)).all() and (best == d.min(1)).all()
    assert compared < len(x) * len(c) / 20


@pytest.mark.parametrize("big", [1, 2**24])
def test_nearest_is_exact_for_large_components(big):
    rng = np.random.default_rng(4)
    c = rng.integers(-big, big + 1, (30, 4))
    x = np.vstack([rng.integers(-big, big + 1, (500, 4)), c, c + 1])
    found, best, _ = centroids.nearest(x, c)
    d = ((x[:, None] - c) ** 2).sum(2)
    assert (found == d.argmin(1)).all() and (best == d.min(1)).all()


def test_rounds_equal_plain_ones_with_repeats_ties_and_bad_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i // 2, [float(x) for x in rng.integers(-9, 9, 3) / 4]) for i in range(60)] + [(None, [0.25, 0.5, -0.25])] + [(100 + i, [1.0, 1.0, 1.0]) for i in range(40)]
    bad = [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 0.0]), (203, [float("inf"), 0.0, 0.0]), (204, [1.0, 2.0]), (205, [])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in good + bad], SCHEMA).repartition(5)
    whole = centroids.whole_vectors(df, 4, 3)
    assigned, found = centroids.centroid_clusters(whole, k=6, rounds=3)
    vectors = [(i, [int(np.floor(4 * x)) for x in v]) for i, v in good]
    want, c = plain(vectors, 6, 3)
    assert found.tolist() == c
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, assigned.collect()), key=key) == sorted(((i, k, d) for (i, _), (d, k) in zip(vectors, want)), key=key)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "", ""), (2, [3.0, 4.0], "", "")], SCHEMA)
    assigned, found = centroids.centroid_clusters(centroids.whole_vectors(df, 1, 2))
    assert len(found) == 2 and {r.distance for r in assigned.collect()} == {0}
    assigned, found = centroids.centroid_clusters(centroids.whole_vectors(df, 1, 3))
    assert len(found) == 0 and assigned.collect() == [] and assigned.columns == ["vec_id", "cluster", "distance"]


def test_empty_table_and_too_large_components(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert centroids.query(spark, str(tmp_path)).count() == 0
    df = spark.createDataFrame([(1, [2.0**30, 0.0, 0.0], "", "")], SCHEMA)
    with pytest.raises(Exception, match="beyond"):
        centroids.centroid_clusters(centroids.whole_vectors(df, 1, 3))[0].collect()
