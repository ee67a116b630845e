import math
import random

import pytest
from pyspark.sql import functions as F

from coterie.functions import components as links
from coterie.functions.order import global_row_number, running_sums
from coterie.operators import cluster, evaluate, graph, rules
from coterie.sources import tables


def components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def test_components_equal_union_find(spark):
    rnd = random.Random(5)
    edges = [tuple(sorted(rnd.sample(range(120), 2))) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)]
    got = cluster.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.member: r.cluster_key for r in got} == components(edges)


@pytest.mark.parametrize("most", [0, 500_000])
def test_components_in_one_task_equal_those_of_rounds_also_for_text(spark, monkeypatch, most):
    monkeypatch.setattr(links, "LINKS_PER_TASK", most)
    rnd = random.Random(9)
    edges = [(f"n{rnd.randrange(80)}", f"n{rnd.randrange(80)}") for _ in range(50)] + [("é", "z"), ("z", "𝄞"), (None, "n1"), ("n1", "n1")] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)]
    got = links.components(spark.createDataFrame(edges, "a string, b string")).collect()
    assert {r.node: r.label for r in got} == components([e for e in edges if e[0] and e[0] != e[1]]) and len(got) == len({r.node for r in got})
    assert links.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_two_cliques_with_a_bridge_are_one_component_and_two_communities(spark):
    edges = [(a + o, b + o, 1.0) for o in (0, 10) for a in range(5) for b in range(a + 1, 5)] + [(4, 10, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    assert cluster.connected_components(df).select("cluster_key").distinct().count() == 1
    found = {frozenset(r.m) for r in cluster.louvain(df, gamma=1.0).groupBy("cluster_key").agg(F.collect_set("member").alias("m")).collect()}
    assert found == {frozenset(range(5)), frozenset(range(10, 15))}


def test_blank_values_make_no_edges_and_the_cap_skips_groups(spark):
    blank = spark.createDataFrame([(i, v) for i in range(5) for v in (None, " ", "NaN")], "id long, value string")
    assert graph.shared_attribute_edges(blank, "s", 1.0).count() == 0
    crowd = spark.createDataFrame([(i, "d") for i in range(200)] + [(1, "e"), (2, "e")], "id long, value string")
    assert graph.shared_attribute_edges(crowd, "s", 1.0, cap=100).count() == 1
    assert graph.shared_attribute_edges(crowd, "s", 1.0, cap=None).count() == 200 * 199 // 2


def test_malformed_rows_are_dropped_and_reported(spark):
    rows = [("1", "NOT_A_NUMBER", "2024-01-01"), ("2", "", "2024-01-01"), ("3", "-999.00", "2024-01-01"), ("", "5", "2024-01-01"), ("5", "5", "not-a-date"), ("6", "7", "2024-01-01")]
    df = spark.createDataFrame(rows, "id string, value string, ts string")
    clean = tables.safe_timestamp(tables.safe_number(tables.drop_missing_id(df, "id"), "value"), "ts")
    assert [r.id for r in clean.collect()] == ["6"]
    report = tables.quality_report(df, "t", "id", {"id": ~tables.has_text("id"), "value": F.coalesce(F.expr("try_cast(value as double)") < 0, F.lit(True)), "ts": F.expr("try_cast(ts as timestamp)").isNull()})
    assert {r.reason: r.rows_dropped for r in report.collect()} == {"id": 1, "value": 3, "ts": 1}


def test_global_order(spark):
    df = spark.createDataFrame([(i, i % 7) for i in random.Random(1).sample(range(500), 500)], "id long, v long")
    assert all(r.n == r.id + 1 for r in global_row_number(df, [F.col("id")], "n").collect())
    run = {r.id: r.s for r in running_sums(df, [F.col("id")], {"s": "v"}).collect()}
    assert run[499] == sum(i % 7 for i in range(500)) and run[10] == sum(i % 7 for i in range(11))


@pytest.mark.parametrize(("row", "rule"), [((True, True, 30.0, 0.5, 2.0), "instrument"), ((True, False, 30.0, 0.5, 2.0), "household"), ((True, False, 1.0, 0.5, 2.0), "device"), ((False, False, 30.0, 0.5, 0.0), "organic"), ((False, False, 1.0, 0.1, 0.0), "pattern"), ((False, False, 10.0, 0.2, 0.0), "weak")])
def test_rules(spark, row, rule):
    device, instrument, span, cv, engaged = row
    df = spark.createDataFrame([(device, instrument, span, cv, engaged, 0.9, 1.0)], "shared_device boolean, shared_instrument boolean, signup_span_days double, order_value_cv double, post_signup_engagement double, claim_then_dormant_frac double, bonus_claim_velocity_hours double")
    assert rules.verdict(df).first().rule == rule


def test_planted_block_is_found_first(spark):
    rnd = random.Random(2)
    rows = [(u, f"v{rnd.randrange(3000)}") for u in range(2000)] + [(u, f"ring{k}") for u in range(30) for k in range(5)]
    first = cluster.top_k_blocks(spark.createDataFrame(rows, "row_id long, col_id string"), k=1).collect()
    assert set(range(30)) <= {r.row_id for r in first}


def weighed(rows):
    degree = {}
    for _, c in rows:
        degree[c] = degree.get(c, 0) + 1
    return {(u, c): 1 / math.log(degree[c] + 5) for u, c in rows}


def peeled(rows):
    """The largest density when the node of least weight goes one by one."""
    live, best = weighed(rows), 0.0
    while live:
        weight = {}
        for (u, c), w in live.items():
            weight["r", u] = weight.get(("r", u), 0) + w
            weight["c", c] = weight.get(("c", c), 0) + w
        best = max(best, sum(live.values()) / len(weight))
        side, gone = min(weight, key=lambda n: (weight[n], str(n)))
        live = {e: w for e, w in live.items() if e[side == "c"] != gone}
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_block_is_not_below_one_by_one_peeling_and_not_above_its_bound(spark, seed):
    rnd = random.Random(seed)
    rows = {(rnd.randrange(60), f"v{rnd.randrange(60)}") for _ in range(150)} | {(u, f"b{k}") for u in range(8 + seed) for k in range(6) if rnd.random() < 0.8}
    found = cluster.densest_block(spark.createDataFrame(sorted(rows), "row_id long, col_id string")).collect()
    score, bound = found[0].score, found[0].bound
    weights = weighed(rows)
    inside = sum(weights[r.row_id, r.col_id] for r in found) / (len({r.row_id for r in found}) + len({r.col_id for r in found}))
    assert abs(inside - score) < 1e-9 and peeled(rows) - 1e-9 <= score <= bound + 1e-9 and bound < 1.5 * score


def test_best_match_ties_go_to_the_smallest_key(spark):
    truth = spark.createDataFrame([(1, m) for m in "abcd"] + [(2, "z")], "set_id long, member string")
    found = spark.createDataFrame([(8, "a"), (8, "b"), (7, "c"), (7, "d")], "set_id long, member string")
    assert {r.set_id: r.cluster_key for r in evaluate.best_match(truth, found).collect()} == {1: 7, 2: None}
