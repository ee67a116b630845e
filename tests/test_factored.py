"""The graph in groups equals the graph in pairs, and a crowd on one value stays linear."""

import random

import pytest
from pyspark.sql import functions as F

from coterie.functions.storage import stored
from coterie.operators import cluster, factored, features, graph


def shared(spark, rows, signal="shared_device", weight=3.0):
    return factored.shared_groups(spark.createDataFrame(rows, "id long, value string"), signal, weight)


@pytest.fixture(scope="module")
def both(spark):
    """Groups of two signals and some referrals, and the same as merged pair edges."""
    rnd = random.Random(4)
    rows = [[(rnd.randrange(24), f"{k}{rnd.randrange(10)}") for _ in range(36)] for k in "ab"]
    rows[0] += [(i, "crowd") for i in range(0, 24, 2)] + [(7, None), (8, " "), (9, "nan"), (70, "alone")]
    ends = sorted({tuple(sorted(rnd.sample(range(30), 2))) for _ in range(8)})
    referral = spark.createDataFrame([(a, b, 0.8) for a, b in ends], "src long, dst long, weight double").withColumn("signals", F.array(F.lit("referral_link")))
    df = [spark.createDataFrame(r, "id long, value string") for r in rows]
    groups = factored.shared_groups(df[0], "shared_device", 3.0).unionByName(factored.shared_groups(df[1], "ip_subnet_overlap", 2.0)).unionByName(factored.edge_groups(referral)).persist()
    pairs = graph.merge_edges(graph.shared_attribute_edges(df[0], "shared_device", 3.0), graph.shared_attribute_edges(df[1], "ip_subnet_overlap", 2.0), referral).persist()
    return groups, pairs


def rows_of(df):
    return sorted((tuple(tuple(x) if isinstance(x, list) else round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_pairs_degrees_density_signals_and_modularity_equal_those_of_pairs(spark, both):
    groups, pairs = both
    assert rows_of(factored.pair_edges(groups)) == rows_of(pairs)
    both_ways = pairs.select("src", "weight").unionByName(pairs.select(F.col("dst").alias("src"), "weight"))
    assert rows_of(factored.weighted_degrees(groups)) == rows_of(both_ways.groupBy("src").agg(F.sum("weight").alias("k")))
    member = spark.createDataFrame([(i % 7, i) for i in range(66)] + [(99, 500)], "cluster_key long, member long")
    assert rows_of(factored.density(groups, member)) == rows_of(features.density(pairs, member))
    assert rows_of(factored.signals_present(groups, member)) == rows_of(features.signals_present(pairs, member))
    for some in (member, member.filter("member % 3 > 0"), member.limit(0)):
        assert rows_of(factored.modularity(groups, some)) == rows_of(cluster.modularity(pairs, some))


def test_communities_equal_those_of_pairs_and_are_single_blocks(spark, both):
    groups, pairs = both
    found = factored.communities(groups, choices=100).persist()
    assert rows_of(found) == rows_of(cluster.louvain(pairs))
    assert features.validity(pairs, found).filter("not single_block").count() == 0
    alone = found.limit(0)
    assert cluster.modularity(pairs, found).first()[0] > cluster.modularity(pairs, alone).first()[0]


def test_a_crowd_of_5000_on_one_value_takes_linear_rows(spark):
    crowd = [(i, "crowd") for i in range(5000)]
    rest = [(5000 + i, f"v{i // 5}") for i in range(200)] + [(i, f"v{i}") for i in range(3)]
    groups = shared(spark, crowd + rest).persist()
    assert groups.count() == 5203
    level = None

    def spy(self, up, choices, moves=factored._Level.moves):
        nonlocal level
        level = max(level or 0, self.counts.count())
        return moves(self, up, choices)

    original, factored._Level.moves = factored._Level.moves, spy
    try:  # at a resolution above one, a crowd that is nearly the whole graph is better left apart
        found = factored.communities(groups, gamma=0.9).persist()
    finally:
        factored._Level.moves = original
    assert level <= 5203
    sizes = {frozenset(r.m) for r in found.groupBy("cluster_key").agg(F.collect_set("member").alias("m")).collect()}
    assert any(len(s) >= 4990 for s in sizes) and sum(map(len, sizes)) >= 5190
    members = spark.range(5200).select(F.lit(1).alias("cluster_key"), F.col("id").alias("member"))
    row = factored.density(groups, members).first()
    assert (row["size"], row.n_edges) == (5200, 5000 * 4999 // 2 + 40 * 10 + 3 * 5)


def test_a_community_that_falls_apart_is_split(spark):
    rows = [(i, "x") for i in range(4)] + [(i, "y") for i in range(10, 14)]
    groups = shared(spark, rows).select("value", F.col("member").alias("node"), "m", F.col("weight").alias("w"))
    state = spark.createDataFrame([(i, 0, 9.0) for i in [*range(4), *range(10, 14)]], "node long, label long, k double")
    level = factored._Level(groups, state, 72.0, -24.0, 1.3)
    before = level.q
    level.split()
    assert {r.node: r.label for r in level.state.collect()} == {**{i: 0 for i in range(4)}, **{i: 10 for i in range(10, 14)}}
    assert level.q > before


def test_no_groups(spark):
    none = shared(spark, [(1, "a"), (2, "b")])
    assert none.count() == 0 and factored.communities(none).count() == 0
    member = spark.createDataFrame([(1, 1), (1, 2)], "cluster_key long, member long")
    assert [tuple(r) for r in factored.density(none, member).collect()] == [(1, 2, 0, 0.0)]


def random_level(spark, wide=False):
    """A level whose nodes are alone: 300 nodes with 2000 random links and, if wanted, two values of 40 holders."""
    edges = spark.range(2000).selectExpr("pmod(xxhash64(id, 1), 300) as src", "pmod(xxhash64(id, 2), 300) as dst").filter("src < dst").distinct().withColumn("weight", F.lit(1.0))
    groups = factored.edge_groups(edges).select("value", "member", "m", "weight")
    if wide:
        crowd = spark.range(80).select(F.concat(F.lit("crowd"), F.col("id") % 2).alias("value"), (F.col("id") * 3).alias("member"), F.lit(2.0).alias("m"), F.lit(0.1).alias("weight"))
        groups = groups.unionByName(crowd)
    groups = stored(groups)
    state = stored(factored.weighted_degrees(groups).select(F.col("member").alias("node"), F.col("member").alias("label"), "k"))
    own, m2 = groups.agg(F.sum(F.col("weight") * F.col("m") * F.col("m"))).first()[0], state.agg(F.sum("k")).first()[0]
    return factored._Level(groups.select("value", F.col("member").alias("node"), "m", F.col("weight").alias("w")), state, m2, -own, 1.3)


@pytest.mark.parametrize("wide", [False, True])
def test_one_part_adds_exactly_what_it_says_and_leaves_little(spark, wide):
    level = random_level(spark, wide)
    before = level.q
    added = level.settle(1)
    assert added > 0.2 and level.q - before > added - 1e-9 and level.hope < 0.01
    assert wide or abs(level.q - before - added) < 1e-9


def test_parts_raise_modularity_and_communities_of_too_many_rows_keep_their_nodes(spark, monkeypatch):
    level = random_level(spark, wide=True)
    before, nodes = level.q, level.state.count()
    for _ in range(3):
        level.settle(4)
    assert level.q > before + 0.1 and level.state.count() == level.state.select("node").distinct().count() == nodes
    monkeypatch.setattr(factored, "ROWS_PER_PART", 0)
    kept = {r.node: r.label for r in level.state.collect()}
    assert level.settle(4) == 0 and {r.node: r.label for r in level.state.collect()} == kept


def test_values_of_the_same_two_communities_become_one_and_modularity_stays(spark):
    level = random_level(spark, wide=True)
    level.settle(1)
    found, labels = level.q, level.state.select("label").distinct().count()
    coarse = level.coarser()
    per = coarse.rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).collect()
    two = [(r.a, r.b) for r in per if r.n == 2]
    assert len(two) == len(set(two)) < 1000 and len(per) - len(two) <= 2 and coarse.state.count() <= labels
    assert abs(coarse.q - found) < 1e-9


def test_search_in_parts_ends_near_the_search_in_one(spark, monkeypatch):
    groups = stored(random_level(spark).rows.select("value", F.col("node").alias("member"), "m", F.col("w").alias("weight")))
    found = [factored.modularity(groups, factored.communities(groups, min_size=1)).first().q]
    monkeypatch.setattr(factored, "ROWS_PER_PART", groups.count() // 3)
    found.append(factored.modularity(groups, factored.communities(groups, min_size=1)).first().q)
    assert found[0] > 0.2 and found[1] > 0.85 * found[0]
