import datetime
import hashlib
import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from coterie.functions.storage import stored
from coterie.operators import cluster, evaluate, factored, features, graph, rules, scoring
from coterie.plans.bindings import Tables, day_of, key_of, numbered_value


def test_negative_pace_that_rounds_to_zero_keeps_its_sign_in_the_text(spark):
    seconds = lambda name, rows: spark.createDataFrame(rows, "user_id long, s double").select("user_id", F.timestamp_seconds("s").alias(name))
    membership = spark.createDataFrame([(1, 1), (1, 2)], "cluster_key long, member long")
    signup, claim, ts = seconds("signup_ts", [(1, 1000.0), (2, 2000.0)]), seconds("claim_ts", [(1, 998.0)]), seconds("ts", [(1, 998.0)])
    values = spark.createDataFrame([], "member long, value string")
    edges = spark.createDataFrame([(1, 2, 1.0, ["x"])], "src long, dst long, weight double, signals array<string>")
    orders = spark.createDataFrame([], "user_id long, order_value double")
    judged = rules.verdict(features.cluster_features(edges, membership, values, values, signup, claim, ts, orders))
    assert "claims: 50%, -0.00 hours after signup" in rules.evidence_text(judged).first().evidence_text
    assert str(features.claims(membership, signup, claim, ts).first().bonus_claim_velocity_hours) == "-0.0"


@pytest.mark.parametrize("least", [500_000, 40])
def test_pairs_by_cells_are_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(graph, "PAIRS_PER_CELL", least)
    rng = random.Random(3)
    rows = [(rng.randrange(60), rng.choice("abcdefgh")) for _ in range(200)] + [(rng.randrange(60), f"v{i % 40}") for i in range(80)] + [(None, "a"), (3, None)]
    want = {}
    for i, (a, v) in enumerate(rows):
        for b, w in rows[i + 1 :]:
            if v and v == w and a is not None and b is not None and a != b:
                want[min(a, b), max(a, b)] = want.get((min(a, b), max(a, b)), 0) + 3.0
    edges = graph.shared_attribute_edges(spark.createDataFrame(rows, "id long, value string"), "shared_device", 3.0)
    got = edges.collect()
    assert {(r.src, r.dst): r.weight for r in got} == want and len(got) == len(want)


def test_pairs_of_one_popular_value_are_made_by_many_tasks_and_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS_PER_CELL", 1000)
    edges = graph.shared_attribute_edges(spark.range(300).select("id", F.lit("x").alias("value")), "shared_device", 3.0)
    per = edges.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per) == 300 * 299 // 2 and len(per) >= 15 and max(r["count"] for r in per) < 15_000
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Generate", 1)[0].count("Exchange") == 0


def test_entity_graph_by_cells_equals_merged_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS_PER_CELL", 30)
    rng = random.Random(5)
    inc = lambda: spark.createDataFrame([(rng.randrange(40), rng.choice("abcdefghij")) for _ in range(90)], "id long, value string")
    referral = spark.createDataFrame([(1, 2, 1.3, ["referral_link"]), (3, 41, 0.8, ["referral_link"])], "src long, dst long, weight double, signals array<string>")
    parts = {"shared_device": inc(), "shared_instrument": inc(), "ip_subnet_overlap": inc()}
    want = graph.merge_edges(*[graph.shared_attribute_edges(v, k, graph.WEIGHTS[k]) for k, v in parts.items()], referral)
    got = graph.build_entity_graph(*parts.values(), referral)
    rows = lambda df: sorted((r.src, r.dst, round(r.weight, 9), r.signals) for r in df.collect())
    assert rows(got) == rows(want)
    assert got._jdf.queryExecution().executedPlan().toString().split("Generate", 1)[0].count("Exchange") == 0


def test_destinations_by_cells(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS_PER_CELL", 20)
    rng = random.Random(7)
    rows = [(rng.choice(["w1", "w2"]), f"s{rng.randrange(12)}", rng.choice("xyz"), str(rng.randrange(4))) for _ in range(80)] + [(None, "s1", "x", "0"), (None, "s2", "x", "0")]
    held = {}
    for c, s, d, p in rows:
        if c:
            held.setdefault((c, s), set()).add(f"{d}:{p}")
    want = {(c, a, b): sorted(v & w) for (c, a), v in held.items() for (k, b), w in held.items() if c == k and a < b and v & w}
    edges = graph.co_destination_edges(spark.createDataFrame(rows, "capture string, src string, dst string, port string"))
    assert {(r.capture, r.src, r.dst): r.destinations for r in edges.collect()} == want
    assert all(r.weight == len(r.destinations) for r in edges.collect())
    assert edges._jdf.queryExecution().executedPlan().toString().split("Generate", 1)[0].count("Exchange") == 0


def test_shared_keys_are_the_shared_values_by_number_and_shuffle_once(spark):
    b = Tables(spark, "/root/testdata/sf0.001")
    n = b.incidence("l_suppkey").groupBy("value").agg(F.collect_set("id").alias("ids")).filter("size(ids) >= 2")
    want = sorted(sorted(r.ids) for r in n.collect())
    keys = b.keys("l_suppkey")
    assert keys.schema["value"].dataType.simpleString() == "bigint"
    assert sorted(sorted(r.ids) for r in keys.groupBy("value").agg(F.collect_list("id").alias("ids")).collect()) == want


def test_one_round_of_moves_between_halves_adds_what_it_hopes(spark):
    edges = spark.range(2000).selectExpr("pmod(xxhash64(id, 1), 300) as a", "pmod(xxhash64(id, 2), 300) as b").filter("a != b").selectExpr("least(a, b) as src", "greatest(a, b) as dst").distinct().withColumn("weight", F.lit(1.0))
    rows = stored(factored.edge_groups(edges).select("value", F.col("member").alias("node"), "m", F.col("weight").alias("w")))
    state = stored(rows.groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("k")).select("node", F.col("node").alias("label"), "k"))
    n = float(rows.count())
    level = factored._Level(rows, state, n, -n, 1.3)
    before, hope = level.q, level.hope
    assert hope > 0.05 and level.take() and level.q - before > 0.7 * hope


def test_edges_of_several_attributes_are_those_merged_in_two_parts(spark):
    rng = random.Random(5)
    parts = {signal: stored(spark.createDataFrame([(rng.randrange(40), rng.randrange(25)) for _ in range(150)], "id long, value long")) for signal in ("shared_device", "ip_subnet_overlap")}
    merged = graph.merge_edges(*[graph.shared_attribute_edges(df, signal, graph.WEIGHTS[signal]) for signal, df in parts.items()])
    rows = lambda df: sorted((r.src, r.dst, r.weight, tuple(r.signals)) for r in df.collect())
    assert rows(graph.attribute_edges(parts)) == rows(merged)


def test_a_fit_reads_as_many_tasks_as_its_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(scoring, "ROWS_PER_TASK", 10)
    rows = spark.createDataFrame([([float(i % 7), float(i % 3)], int(i % 2)) for i in range(95)], "features array<double>, label int").coalesce(1)
    seen = []

    def stages(ready, point):
        seen.append(ready.rdd.getNumPartitions())
        return [LogisticRegression(featuresCol="vector", weightCol="weight", maxIter=2)]

    scoring._fitted(rows, rows, None, (1,), stages)
    assert seen == [10]


def test_holdout_is_the_first_share_in_md5_order_without_a_global_sort(spark):
    for n in (1, 2, 700):
        order = sorted(range(n), key=lambda i: (hashlib.md5(f"{i}|7".encode()).hexdigest(), i))
        split = evaluate.holdout_split(spark.range(n))
        assert {r.id for r in split.filter("split = 'holdout'").collect()} == set(order[: max(1, int(n * 0.3))]) and split.count() == n
    assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_key_and_day_give_both_back(spark):
    rows = [(k, d) for k in (0, 7, 10**9) for d in (datetime.date(1, 1, 1), datetime.date(1969, 12, 31), datetime.date(1997, 1, 1), datetime.date(9999, 12, 31))]
    value = spark.createDataFrame(rows, "k long, d date").select(numbered_value("k", "d").alias("v"))
    assert sorted(map(tuple, value.select(key_of(F.col("v")), day_of(F.col("v"))).collect())) == rows


def test_confounders_are_the_shared_incidences(spark):
    b = Tables(spark, "/root/testdata/sf0.001")
    want = b.incidence("l_suppkey").groupBy("value").agg(F.collect_list("id").alias("ids")).filter("size(ids) >= 2").select("value", F.explode("ids"))
    assert sorted(map(tuple, b.confounders().collect())) == sorted(map(tuple, want.collect()))
    assert set(b.kept) == {"keys l_suppkey None"}


def _lines_and_orders(spark, folder, orders: list, lines: list) -> Tables:
    day = lambda n: datetime.datetime(1997, 1, n) if n else None
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    rows = [(o, p, p, day(d), x) for o, p, d, x in lines]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_shipdate timestamp, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    return Tables(spark, str(folder))


@pytest.mark.parametrize("twice", [False, True])
def test_keys_are_those_of_all_lines_if_orders_repeat_or_lack_customers(spark, tmp_path, twice):
    rng = random.Random(11)
    orders = [(o, rng.choice([1, 2, 3, 4, 5, None])) for o in range(40)] + ([(7, 90), (8, 91), (8, 92), (None, 5), (None, 6)] if twice else [])
    lines = [(rng.choice([*range(44), None]), rng.choice([*range(30), None]), rng.choice([1, 2, 3, None]), rng.choice([0.01, 0.095])) for _ in range(160)] + [(7, 77, 1, 0.01), (8, 78, 1, 0.01)]
    b = _lines_and_orders(spark, tmp_path / "t", orders, lines)
    assert b.single_orders() is not twice
    for key, most in (("l_partkey", None), ("l_partkey", 0.09), ("l_suppkey", None)):
        held = {}
        for o, p, d, x in lines:
            for k, c in orders:
                if o is not None and o == k and p is not None and d is not None and (most is None or x < most):
                    held.setdefault((p, d), set()).add(c)
        want = sorted((str(c), p, d) for (p, d), ids in held.items() if len(ids) >= 2 for c in ids)
        got = b.keys(key, most).select("id", key_of(F.col("value")).alias("p"), F.dayofmonth(day_of(F.col("value"))).alias("d")).collect()
        assert sorted((str(r.id), r.p, r.d) for r in got) == want
        known = {v: ids - {None} for v, ids in held.items() if len(ids - {None}) >= 2}
        if most is None:
            rows = b.held(key).filter("n >= 2 and id is not null").groupBy("value").agg(F.collect_set("id").alias("ids"))
            assert sorted(sorted(r.ids) for r in rows.collect()) == sorted(map(sorted, known.values()))


def test_only_lines_of_shared_values_meet_orders_and_groups_are_not_shuffled(spark, tmp_path):
    b = _lines_and_orders(spark, tmp_path / "t", [(o, o % 50) for o in range(500)], [(o, o // 2 if o < 20 else o, 1, 0.01) for o in range(500)])
    b.truth()
    b.membership()
    assert b.kept["lines l_partkey"].count() == 20 and sum(k.startswith("lines") for k in b.kept) == 1
    groups = b.groups()
    assert groups.schema["value"].dataType.simpleString() == "bigint" and "groups" not in b.kept
    assert "Exchange" not in groups._jdf.queryExecution().executedPlan().toString()
    assert groups.count() == groups.select("value", "member").distinct().count() == 40


def test_modularity_of_numbered_groups_keeps_alone_members_and_clusters_apart(spark):
    rng = random.Random(4)
    parts = {s: spark.createDataFrame(sorted({(rng.randrange(30), v) for v in range(25) for _ in range(4)}), "id long, value long") for s in ("shared_device", "ip_subnet_overlap")}
    groups = factored.numbered_groups(parts, graph.WEIGHTS)
    pairs = stored(factored.pair_edges(groups))
    merged = graph.merge_edges(*[graph.shared_attribute_edges(df, s, graph.WEIGHTS[s]) for s, df in parts.items()])
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, merged.collect()))
    members = [(m % 4, m) for m in range(20)]  # no cluster has the number of a member of its own among 20 to 29
    for kind, rows in (("long", members), ("string", [(f"c{c}", m) for c, m in members]), ("long", [(c + 25, m) for c, m in members])):
        found = spark.createDataFrame(rows, f"cluster_key {kind}, member long")
        assert abs(factored.modularity(groups, found).first().q - cluster.modularity(pairs, found).first().q) < 1e-12
    named = spark.createDataFrame([(f"c{c}", m) for c, m in members], "cluster_key string, member long")
    got, want = (sorted(map(tuple, f(g, named).collect())) for f, g in ((factored.density, groups), (features.density, pairs)))
    assert got == want
