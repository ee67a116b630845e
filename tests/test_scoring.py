"""Models on columns with categories and missing values, threshold grids, and the whole pipeline on planted rings."""

import math
import random

from pyspark.sql import functions as F

from coterie.operators import factored, scoring
from coterie.operators.detect import detect

SCHEMA = "id long, label int, amount double, kind string, `odd name` string"


def rows(n, seed, kinds="abcd"):
    """Label 1 where the kind is b, or where the amount is missing and the kind is not a; noise in one of ten."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        kind, amount = rnd.choice([*kinds, None]), rnd.choice([None, float("nan"), rnd.random(), rnd.random(), rnd.random()])
        missing = amount is None or math.isnan(amount)
        label = int(kind == "b" or (missing and kind != "a"))
        out.append((i, label if rnd.random() > 0.1 else 1 - label, amount, kind, rnd.choice("xy")))
    return out


def auc(scored):
    pos, neg = [[r.score for r in scored if r.label == k] for k in (1, 0)]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_columns_with_categories_and_missing_values_are_fitted_saved_and_loaded(spark, tmp_path):
    train, dev, test = (spark.createDataFrame(rows(n, s, k), SCHEMA) for n, s, k in ((600, 1, "abcd"), (200, 2, "abcd"), (200, 3, "abcdz")))
    inputs = scoring.fit_inputs(train, ["amount"], ["kind", "odd name"])
    assert inputs.transform(test).count() == 200  # the unseen kind z is scored as a missing one
    for fit, grid, least in ((scoring.fit_logistic, (0.01, 1.0), 0.75), (scoring.fit_boosted_trees, ((3, 5), (3, 10)), 0.85)):
        model = fit(train, dev, grid, inputs)
        scored = scoring.score(model, test).collect()
        assert auc(scored) > least and all(0 <= r.score <= 1 for r in scored) and model.chosen in [g if isinstance(g, tuple) else (g,) for g in grid]
        model.save(spark, str(tmp_path / fit.__name__))
        again = scoring.Scorer.load(spark, str(tmp_path / fit.__name__))
        assert (again.chosen, again.auc) == (model.chosen, model.auc)
        assert {r.id: r.score for r in scoring.score(again, test).collect()} == {r.id: r.score for r in scored}
    assert scoring.score(model, test).columns == [*test.columns, "score"]


def test_unseen_null_and_rare_categories_share_an_index_and_absent_columns_have_median_zero(spark):
    train = spark.createDataFrame([(1, 1, None, "a", None), (2, 0, None, "a", None), (3, 0, None, "b", None)], SCHEMA)
    inputs = scoring.fit_inputs(train, ["amount"], ["kind", "odd name"], most=1)
    got = {r.kind: r.vector.toArray().tolist() for r in inputs.transform(spark.createDataFrame([(1, 0, None, k, "q") for k in ("a", "b", "z", None)], SCHEMA)).collect()}
    assert got["b"] == got["z"] == got[None] != got["a"] and got["a"][:2] == [0.0, 1.0]


def test_arrays_of_numbers_are_fitted_by_dev_auc(spark):
    rnd = random.Random(5)
    data = [(i, i % 2, [rnd.gauss(i % 2, 1.0), rnd.random()]) for i in range(600)]
    df = spark.createDataFrame(data, "id long, label int, features array<double>")
    train, dev, test = df.filter("id < 400"), df.filter("id >= 400 and id < 500"), df.filter("id >= 500")
    model = scoring.fit_logistic(train, dev)
    assert auc(scoring.score(model, test).collect()) > 0.65 and model.chosen[0] in scoring.PENALTIES
    quality = scoring.ranking_quality(scoring.score(model, test)).first()
    assert abs(quality.roc_auc - auc(scoring.score(model, test).collect())) < 1e-9


def test_quantile_grid_and_sweeps_equal_plain_ones(spark):
    rnd = random.Random(6)
    data = [(i, rnd.choice(["dev", "test"]), rnd.randrange(40) / 40, rnd.randrange(2)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, split string, score double, label int")
    values = sorted(s for _, _, s, _ in data)
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    lower = [values[int(q * 299)] for q in at]
    upper = [values[min(int(q * 299) + 1, 299)] for q in at]
    want = {round(a + (b - a) * (q * 299 % 1), 9) for a, b, q in zip(lower, upper, at)}
    grid = scoring.quantile_grid(df.unionByName(df.limit(1).withColumn("score", F.lit(None).cast("double"))), at)
    assert {r.threshold for r in grid.collect()} == want
    for thresholds in (sorted(want), None):
        got = {r.threshold: (r.alerts, r.tp) for r in scoring.sweep_at(df, grid if thresholds else None).collect()}
        expected = {t: (sum(s >= t for _, _, s, _ in data), sum(s >= t and y for _, _, s, y in data)) for t in thresholds or set(values)}
        assert got == expected
    assert scoring.quantile_grid(df.limit(0), at).count() == 0
    assert scoring.dev_then_test(df.limit(0), None, 0.5).count() == 0


def test_planted_rings_are_flagged_and_look_alikes_are_not(spark):
    """A device ring, an instrument ring, a household on one device with organic behaviour, an office on one subnet, and unlinked accounts."""
    rnd = random.Random(7)
    ring, paid, home, office, free = range(0, 6), range(10, 15), range(20, 24), range(30, 42), range(100, 130)
    device = [(u, "d-ring") for u in ring] + [(u, "d-home") for u in home] + [(u, f"d{u}") for u in (*paid, *office, *free)]
    instrument = [(u, "i-paid") for u in paid] + [(u, f"i{u}") for u in (*ring, *home, *office, *free)]
    subnet = [(u, "10.0.0") for u in office] + [(u, f"10.1.{u}") for u in (*ring, *paid, *home, *free)]
    tight = {*ring, *paid}
    signup = [(u, f"2024-03-01 0{i % 9}:00:00" if u in tight else f"2024-0{1 + i % 6}-1{i % 9} 00:00:00") for i, u in enumerate([*ring, *paid, *home, *office, *free])]
    claim = [(u, t[:-5] + "30:00") for u, t in signup if u in tight]
    sessions = [(u, t) for u, t in signup] + [(u, f"2024-1{k}-01 00:00:00") for u in (*home, *office) for k in (0, 1, 2)]
    orders = [(u, 100.0 + (rnd.random() if u in tight else rnd.randrange(400))) for u in (*ring, *paid, *home, *office) for _ in range(4)]
    df = lambda r, c: spark.createDataFrame(r, c)
    time = lambda d, c: d.withColumn(c, F.col(c).cast("timestamp"))
    none = df([], "src long, dst long, weight double, signals array<string>")
    groups = factored.entity_groups(*[df(r, "id long, value string") for r in (device, instrument, subnet)], none)
    found = detect(groups, df(device, "member long, value string"), df(instrument, "member long, value string"), time(df(signup, "user_id long, signup_ts string"), "signup_ts"), time(df(claim, "user_id long, claim_ts string"), "claim_ts"), time(df(sessions, "user_id long, ts string"), "ts"), df(orders, "user_id long, order_value double"))
    got = {tuple(r.members): (r.stage, r.rule, r.flagged) for r in found.collect()}
    assert got.pop(tuple(ring)) == ("hard", "device", True) and got.pop(tuple(paid)) == ("hard", "instrument", True)
    assert got.pop(tuple(home)) == ("hard", "household", False)
    assert {m for members in got for m in members} <= set(office) and not any(flagged for *_, flagged in got.values())
