"""Evaluation, what-if, reports and stores, each against a result counted by hand."""

from pyspark.sql import functions as F

from coterie.operators import evaluate, features, reports, rules, whatif
from coterie.sources import sinks

SETS = "set_id long, member long"


def sets(spark, groups, schema=SETS):
    return spark.createDataFrame([(k, m) for k, members in groups.items() for m in members], schema)


def one(df):
    return df.collect()[0].asDict()


def tagged(spark):
    """Four rings, two hard and two soft, and two look-alikes."""
    rings = {"h1": [1, 2, 3, 4], "h2": [5, 6, 7, 8], "s1": [11, 12], "s2": [13, 14]}
    r = spark.createDataFrame([(k, "hard" if k[0] == "h" else "soft", m) for k, v in rings.items() for m in v], "set_id string, type string, member long")
    c = spark.createDataFrame([("c1", "office", m) for m in (21, 22, 23)] + [("h1", "household", m) for m in (31, 32)], "set_id string, type string, member long")
    return evaluate.tagged_sets(r, c)


def splits(spark):
    rows = [("ring", "h1", "dev"), ("ring", "h2", "holdout"), ("ring", "s1", "dev"), ("ring", "s2", "dev"), ("confounder", "c1", "dev"), ("confounder", "h1", "holdout")]
    return spark.createDataFrame(rows, "kind string, set_id string, split string")


# Flagged: 100 is ring h1 and one more, 101 a quarter of h2, 102 look-alike c1 whole, 103 touches look-alike h1 only, 104 nothing known.
FLAGGED = {100: [1, 2, 3, 4, 90], 101: [5, 91, 92, 93], 102: [21, 22, 23], 103: [31, 94, 95], 104: [96, 97]}


def test_largest_overlap_is_recall_of_the_set_and_precision_of_the_block(spark):
    got = one(evaluate.largest_overlap(sets(spark, {1: [1, 2, 3, 4]}), sets(spark, {7: range(1, 11), 8: [1, 2]})))
    assert got == {"set_id": 1, "match_id": 7, "overlap": 4, "recall": 0.4, "precision": 1.0}


def test_holdout_has_one_at_least(spark):
    ids = spark.createDataFrame([(i,) for i in (3, 5, 9)], "id long")
    assert sorted(r.split for r in evaluate.holdout_split(ids).collect()) == ["dev", "dev", "holdout"]
    assert evaluate.holdout_split(ids.limit(0)).count() == 0
    by_kind = evaluate.split_sets(tagged(spark)).groupBy("kind", "split").count().collect()
    assert {(r.kind, r.split): r["count"] for r in by_kind} == {("ring", "holdout"): 1, ("ring", "dev"): 3, ("confounder", "holdout"): 1, ("confounder", "dev"): 1}


def test_report_by_split_counts_rings_and_look_alikes(spark):
    report = {r.split: r.asDict() for r in evaluate.eval_report(tagged(spark), sets(spark, FLAGGED), splits(spark)).collect()}
    dev = {"split": "dev", "n_hard": 1, "hard_recall": 1.0, "n_soft": 2, "soft_recall": 0.0, "n_rings": 3, "recall": 1 / 3, "n_confounders": 1, "false_positive_rate": 1.0, "relevant": 2, "true_clusters": 1, "false_clusters": 1, "precision": 0.5}
    held = {"split": "holdout", "n_hard": 1, "hard_recall": 0.0, "n_soft": 0, "soft_recall": None, "n_rings": 1, "recall": 0.0, "n_confounders": 1, "false_positive_rate": 0.0, "relevant": 2, "true_clusters": 0, "false_clusters": 2, "precision": 0.0}
    overall = {"split": "overall", "n_hard": 2, "hard_recall": 0.5, "n_soft": 2, "soft_recall": 0.0, "n_rings": 4, "recall": 0.25, "n_confounders": 2, "false_positive_rate": 0.5, "relevant": 4, "true_clusters": 1, "false_clusters": 3, "precision": 0.25}
    assert report == {"dev": dev, "holdout": held, "overall": overall}
    detail = {(r.kind, r.set_id): (r.type, r["size"], r.cluster_key) for r in evaluate.set_outcomes(tagged(spark), sets(spark, FLAGGED)).collect()}
    assert detail[("ring", "h1")] == ("hard", 4, 100) and detail[("confounder", "c1")] == ("office", 3, 102) and detail[("confounder", "h1")] == ("household", 2, None)


def test_a_false_alarm_on_a_look_alike_lowers_precision(spark):
    got = {r.split: (r.relevant, r.precision) for r in evaluate.cluster_precision(sets(spark, {102: [21, 22, 23]}), tagged(spark), splits(spark)).collect()}
    assert got == {"dev": (1, 0.0), "overall": (1, 0.0)}


def test_look_alikes_with_reason_and_share(spark):
    flagged, candidates = sets(spark, {102: [21, 22, 23]}), sets(spark, {102: [21, 22, 23], 105: [31, 32]})
    reasons = spark.createDataFrame([(102, "device"), (105, "household")], "cluster_key long, reason string")
    conf = sets(spark, {1: [21, 22, 23], 2: [31, 32], 3: [41, 42]})
    got = {r.set_id: (r.wrongly_flagged, r.surfaced, r.cluster_key, r.reason, r.rate) for r in evaluate.false_positive_rate(conf, flagged, candidates, reasons).collect()}
    assert got == {1: (True, True, 102, "device", 1 / 3), 2: (False, True, 105, "household", 1 / 3), 3: (False, False, None, None, 1 / 3)}


def test_only_members_of_unflagged_clusters_are_recovered(spark):
    edges = spark.createDataFrame([(1, 2), (3, 4), (5, 6), (4, 5)], "src long, dst long")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 0), (5, 0), (6, 1)], "id long, label int")
    membership = spark.createDataFrame([(10, 1), (10, 2), (11, 3), (11, 4), (11, 1)], "cluster_key long, member long")
    flags = spark.createDataFrame([(10, True), (11, False)], "cluster_key long, flagged boolean")
    # 5 has a positive neighbour but is in no cluster; 1 is in a flagged one too; 3 has no positive neighbour.
    assert [tuple(r) for r in evaluate.neighbor_flag(edges, labels, membership, flags).collect()] == [(4, False)]
    got = one(evaluate.dilution_recovery(edges, labels, membership, flags))
    assert got == {"checked": 2, "near": 1, "recovered": 0, "cluster_recall": 0.5, "cluster_precision": 1.0, "combined_recall": 0.5, "combined_precision": 0.6667}


def test_two_way_agreement(spark):
    blocks = sets(spark, {0: [1, 2, 3], 1: [21, 22, 23, 24], 2: [5]})
    got = {r.measure: r.n for r in evaluate.two_way_agreement(blocks, sets(spark, FLAGGED), tagged(spark)).collect()}
    assert got == {"blocks": 3, "blocks_in_flagged": 2, "blocks_in_rings": 1, "blocks_in_confounders": 1, "hard_rings": 2, "hard_rings_found": 1, "flagged_in_blocks": 2, "confounders_in_blocks": 1}


FEATURES = "cluster_key long, size long, edge_density double, signals_present array<string>, shared_device boolean, shared_device_frac double, shared_instrument boolean, shared_instrument_frac double, signup_span_days double, avg_gap_hours double, claim_frac double, bonus_claim_velocity_hours double, claim_then_dormant_frac double, n_orders long, order_value_cv double, post_signup_engagement double"


def clusters(spark):
    rows = [
        (1, 4, 1.0, ["ip_subnet_overlap", "shared_device"], True, 0.75, False, 0.25, 2.5, 20.0, 1.0, 3.5, 0.5, 8, 0.05, 0.0),
        (2, 3, 0.6667, [], False, 0.0, False, 0.0, 30.0, 360.0, 0.0, None, None, 0, None, 2.25),
        (3, 2, 1.0, ["referral_link"], False, 0.5, False, 0.5, 5.0, 120.0, 0.5, 40.0, 0.0, 2, 0.1, 0.0),
    ]
    return spark.createDataFrame(rows, FEATURES)


def test_action_evidence_and_text(spark):
    judged = rules.verdict(clusters(spark))
    acts = {r.cluster_key: (r.action, r.confidence, r.evidence) for r in rules.recommended_action(judged).collect()}
    assert acts[1] == ("HOLD_BONUS", 0.85, ["75% share one device", "a subnet is shared", "all signed up within 2.50 days", "order values vary by only 0.0500", "50% went silent after their claim"])
    assert acts[2][0:2] == ("MANUAL_REVIEW", 0.4) and acts[2][2] == [judged.filter("cluster_key = 2").first().reason]
    texts = {r.cluster_key: r.evidence_text.split("\n") for r in rules.evidence_text(judged).collect()}
    assert len(texts[1]) == len(texts[2]) == 12
    assert texts[1][1] == "members: 4, density 1.0000" and texts[1][3] == "one device: yes, 75%" and texts[1][11] == "scores: organic 0 of 3, suspicion 4 of 4"
    assert texts[2][0] == "stage: n/a" and texts[2][2] == "signals: none" and texts[2][6] == "claims: 0%, n/a hours after signup" and texts[2][7] == "silent after the claim: n/a" and texts[2][8] == "orders: 0, values vary by n/a"


def test_impact_counts_rings_and_look_alikes(spark):
    membership = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (3, 21), (3, 22)], "cluster_key long, member long")
    got = {r.kind: (r.total, r.before, r.after, r.delta) for r in whatif.impact(clusters(spark), membership, tagged(spark), "soft_flag_suspicion_threshold", 2.0).collect()}
    assert got == {"ring": (4, 1, 1, 0), "confounder": (2, 0, 1, 1)}


def test_reports(spark):
    rows = spark.createDataFrame([(1, 5, True, "HOLD_BONUS", 0.9), (2, 5, False, "MANUAL_REVIEW", None), (3, 2, False, "HOLD_BONUS", 0.4)], "cluster_key long, size long, flagged boolean, action string, confidence double")
    assert [r.cluster_key for r in reports.list_clusters(rows).collect()] == [1, 3, 2]
    assert [r.cluster_key for r in reports.list_clusters(rows, actions=["HOLD_BONUS"]).collect()] == [1, 3]
    assert [r.cluster_key for r in reports.list_clusters(rows, flagged=False, actions=["HOLD_BONUS"]).collect()] == [3]
    assert {r["size"]: (r.clusters, r.flagged) for r in reports.size_distribution(rows).collect()} == {5: (2, 1), 2: (1, 0)}
    assert [r.cluster_key for r in reports.largest(rows, 2).collect()] == [1, 2]
    got = {r.measure: r.n for r in reports.summary_counts(spark.range(7), spark.range(4), spark.range(2), rows).collect()}
    assert got == {"nodes": 7, "edges": 4, "hard_edges": 2, "candidates": 3, "flagged": 1}


def test_a_snapshot_taken_twice_is_one(spark, tmp_path):
    df = spark.range(5)
    for version in ("v1", "v1", "2"):
        sinks.snapshot(df if version == "v1" else df.limit(2), str(tmp_path), version)
    assert sinks.restore(spark, str(tmp_path), "v1").count() == 5 and sinks.restore(spark, str(tmp_path), "2").count() == 2


def test_diameters_of_any_size_and_none_for_pieces(spark):
    path = [(i, i + 1) for i in range(12)]
    ring = [(100 + i, 100 + (i + 1) % 9) for i in range(9)]
    edges = spark.createDataFrame([tuple(sorted(e)) for e in path + ring + [(200, 201), (202, 203)]], "src long, dst long").withColumn("weight", F.lit(1.0)).withColumn("signals", F.array())
    groups = {1: range(13), 2: range(100, 109), 3: range(200, 204), 4: [300], 5: [0, 1, 2]}
    got = {r.cluster_key: r.diameter for r in features.diameters(edges, sets(spark, groups).withColumnRenamed("set_id", "cluster_key"), sources=4).collect()}
    assert got == {1: 12, 2: 4, 3: None, 4: None, 5: 2}
