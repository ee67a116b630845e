"""What-if replay and cost (I)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.storage import stored
from coterie.operators.evaluate import tagged_pairs
from coterie.operators.rules import PARAMETERS, parameters, verdict


def replay(features: DataFrame, name: str, values: list[float]) -> DataFrame:
    """The rules on stored features for each value of one parameter; adds ``value``."""
    grid = features.withColumn("value", F.explode(F.array(*map(F.lit, map(float, values)))))
    return verdict(grid, parameters(**{name: F.col("value")}))


def missed_cost(truth: DataFrame, referrals: DataFrame) -> DataFrame:
    """(set_id, cost, mean_cost): paid bonuses that touch a set, each once, 0 without any; and their mean over all sets.

    truth(set_id, member), referrals(referral_id, referrer, referred, bonus, status).
    """
    paid = referrals.filter("status = 'paid'")
    ends = paid.select("referral_id", "bonus", F.explode(F.array("referrer", "referred")).alias("member"))
    cost = truth.join(ends.hint("merge"), "member").dropDuplicates(["set_id", "referral_id"]).groupBy("set_id").agg(F.sum("bonus").alias("cost"))
    every = stored(truth.select("set_id").distinct().join(cost, "set_id", "left").select("set_id", F.coalesce("cost", F.lit(0.0)).alias("cost")))
    mean = every.agg(F.round(F.avg("cost"), 4).alias("mean_cost"))
    return every.crossJoin(F.broadcast(mean)).select("set_id", F.round("cost", 2).alias("cost"), "mean_cost")


def fp_cost_scenarios(orders: DataFrame, review: float = 150.0) -> DataFrame:
    """Cost of one false positive: review plus lost customers times orders times mean order value."""
    mean = orders.agg(F.avg("order_value").alias("mean"))
    scenario = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(p).alias("p"), F.lit(k).alias("k")) for n, p, k in (("none", 0.0, 0), ("some", 0.05, 5), ("many", 0.15, 10))]))
    return mean.select("mean", scenario.alias("s")).select("s.scenario", F.round(review + F.col("s.p") * F.col("s.k") * F.col("mean"), 4).alias("fp_cost"))


def cost_table(sweep: DataFrame, scenarios: DataFrame, missed: float) -> DataFrame:
    """sweep(value, missed, false_positives): total cost for each value and scenario, the cheapest marked (lowest value on ties)."""
    all_ = sweep.crossJoin(F.broadcast(scenarios)).withColumn("cost", F.round(F.col("missed") * missed + F.col("false_positives") * F.col("fp_cost"), 2))
    place = F.row_number().over(Window.partitionBy("scenario").orderBy("cost", "value"))
    return all_.withColumn("cheapest", place == 1).select("scenario", "value", "cost", "cheapest")


def sweep_finding(sweep: DataFrame, columns: list[str]) -> DataFrame:
    return sweep.agg(*[(F.min(c) == F.max(c)).alias(f"{c}_flat") for c in columns])


def impact(features: DataFrame, membership: DataFrame, truth: DataFrame, name: str, value: float) -> DataFrame:
    """(kind, total, before, after, delta): rings caught and look-alikes wrongly flagged with the production value of a parameter and with another.

    truth: evaluate.tagged_sets. A set counts if a flagged cluster matches it.
    """
    runs = stored(replay(features, name, [PARAMETERS[name][0], value]).filter("flagged").select("value", "cluster_key"))
    flagged = membership.join(runs, "cluster_key").select(F.struct("value", "cluster_key").alias("set_id"), "member")
    good = tagged_pairs(truth, flagged).filter((F.col("recall") >= 0.5) & (F.col("precision") >= 0.5))
    hit = lambda v: F.count_if(F.col("value") == float(v))
    hits = good.select("a_id", "b_id.value").distinct().groupBy("a_id.kind").agg(hit(PARAMETERS[name][0]).alias("before"), hit(value).alias("after"))
    total = truth.select("kind", "set_id").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    counts = total.join(hits.hint("merge"), "kind", "left").fillna(0, ["before", "after"])
    return counts.withColumn("delta", F.col("after") - F.col("before"))


CHECKS = [("spread_out_days", "signup_span_days"), ("diverse_order_cv", "order_value_cv"), ("engaged_sessions", "post_signup_engagement")]


def parameter_gap(judged: DataFrame) -> DataFrame:
    """For each cluster that was not flagged: its passing organic checks and, where losing one of them would end
    its clearance, the one with the smallest margin over its threshold."""
    p = parameters()
    clear = judged.filter("not flagged")
    checks = F.array(*[F.struct((F.col(c).cast("double") - p[n]).alias("margin"), F.lit(k).alias("place"), F.lit(n).alias("parameter"), F.col(c).cast("double").alias("value")) for k, (n, c) in enumerate(CHECKS)])
    passing = F.filter(checks, lambda x: x["margin"] >= 0)
    least = F.when(F.col("organic_score") - 1 < p["soft_clear_organic_threshold"], F.array_min("checks"))
    out = clear.select("cluster_key", "organic_score", passing.alias("checks"))
    return out.select("cluster_key", F.size("checks").alias("passing"), least["parameter"].alias("parameter"), least["value"].alias("value"), F.round(least["margin"], 4).alias("margin"))


def propose_value(gaps: DataFrame) -> DataFrame:
    """The threshold raised one step past the cluster's value, on the parameter's grid and inside its range; null where that changes nothing."""
    of = lambda k: F.create_map(*[F.lit(x) for n, v in PARAMETERS.items() for x in (n, v[k])])[F.col("parameter")]
    j = gaps.filter("parameter is not null").select("cluster_key", "parameter", "value", *[of(k).alias(c) for k, c in enumerate(("now", "least", "most", "step"))])
    wanted = F.greatest("least", F.least("most", F.round(F.rint((F.col("value") + F.col("step")) / F.col("step")) * F.col("step"), 6)))
    return j.select("cluster_key", "parameter", F.when(F.abs(wanted - F.col("now")) > 1e-6, wanted).alias("proposed"))


def side_by_side(baseline: DataFrame, proposed: DataFrame, key: str = "split", measures: tuple[str, ...] = ("hard_recall", "soft_recall", "recall", "false_positive_rate", "precision")) -> DataFrame:
    """Each measure of two evaluate.eval_report runs and its change, a row a split that both have."""
    old = baseline.select(key, *[F.col(m).alias(f"{m}_old") for m in measures])
    new = proposed.select(key, *[F.col(m).alias(f"{m}_new") for m in measures])
    shown = [c for m in measures for c in (F.col(f"{m}_old"), F.col(f"{m}_new"), F.round(F.col(f"{m}_new") - F.col(f"{m}_old"), 6).alias(f"{m}_delta"))]
    return old.join(new, key).select(key, *shown)
