"""Explainable rules (G). Parameters are columns, so a grid can be joined in (I01)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Production thresholds as (value, least, most, step).
PARAMETERS = {
    "spread_out_days": (21.0, 7.0, 45.0, 1.0),
    "diverse_order_cv": (0.28, 0.10, 0.50, 0.01),
    "engaged_sessions": (1.5, 0.5, 4.0, 0.1),
    "templated_order_cv": (0.15, 0.05, 0.30, 0.01),
    "burst_days": (7.0, 2.0, 14.0, 1.0),
    "fast_claim_hours": (12.0, 4.0, 48.0, 1.0),
    "dormant_frac": (0.4, 0.1, 0.8, 0.05),
    "device_clear_organic_threshold": (3.0, 1.0, 3.0, 1.0),
    "soft_clear_organic_threshold": (2.0, 1.0, 3.0, 1.0),
    "soft_flag_suspicion_threshold": (3.0, 1.0, 4.0, 1.0),
}


def parameters(**changed: Column | float) -> dict[str, Column]:
    return {k: (changed[k] if isinstance(changed.get(k), Column) else F.lit(float(changed.get(k, v[0])))) for k, v in PARAMETERS.items()}


def _points(*conditions: Column) -> Column:
    out = F.lit(0)
    for c in conditions:
        out = out + F.coalesce(c, F.lit(False)).cast("int")
    return out


def organic_score(p: dict[str, Column]) -> Column:
    return _points(F.col("signup_span_days") >= p["spread_out_days"], F.col("order_value_cv") >= p["diverse_order_cv"], F.col("post_signup_engagement") >= p["engaged_sessions"])


def suspicion_score(p: dict[str, Column]) -> Column:
    return _points(F.col("signup_span_days") <= p["burst_days"], F.col("order_value_cv") < p["templated_order_cv"], F.col("claim_then_dormant_frac") >= p["dormant_frac"], F.col("bonus_claim_velocity_hours") <= p["fast_claim_hours"])


def verdict(features: DataFrame, p: dict[str, Column] | None = None) -> DataFrame:
    """Adds organic_score, suspicion_score, flagged, reason."""
    p = p or parameters()
    df = features.withColumn("organic_score", organic_score(p)).withColumn("suspicion_score", suspicion_score(p))
    rule = (
        F.when(F.col("shared_instrument"), "instrument")
        .when(F.col("shared_device") & (F.col("organic_score") >= p["device_clear_organic_threshold"]), "household")
        .when(F.col("shared_device"), "device")
        .when(F.col("organic_score") >= p["soft_clear_organic_threshold"], "organic")
        .when(F.col("suspicion_score") >= p["soft_flag_suspicion_threshold"], "pattern")
        .otherwise("weak")
    )
    reason = (
        F.when(F.col("rule") == "instrument", "members pay with one instrument, which organic behaviour does not excuse")
        .when(F.col("rule") == "household", "one device, but spread out, diverse and engaged: a household")
        .when(F.col("rule") == "device", "one device without enough organic behaviour")
        .when(F.col("rule") == "organic", "no shared device or instrument, and organic behaviour prevails")
        .when(F.col("rule") == "pattern", "burst, templated orders, fast claims or dormancy come together")
        .otherwise("evidence too weak either way")
    )
    return df.withColumn("rule", rule).withColumn("flagged", F.col("rule").isin("instrument", "device", "pattern")).withColumn("reason", reason)


def cod_verdict(features: DataFrame, normal: float = 0.45, high: float = 0.60, share: float = 0.75) -> DataFrame:
    rate, cod = F.col("refusal_rate"), F.col("cod_fraction")
    flagged = F.when(rate.isNull(), False).when(F.col("shared_address"), (rate >= high) | ((rate > normal) & (cod >= share))).otherwise((rate >= high) & (cod >= share))
    shown = F.format_string("%.0f%%", F.round(rate * 100).cast("double"))
    reason = F.when(rate.isNull(), F.lit("no cash orders to judge by")).otherwise(F.concat(F.when(F.col("shared_address"), "shared address").otherwise("phone block"), F.lit(", refusal rate "), shown))
    return features.withColumn("flagged", flagged).withColumn("reason", reason)


def flag_by_density(rows: DataFrame, threshold: float = 0.5, min_labeled: int = 2) -> DataFrame:
    """rows(cluster_key, labeled, positives, density): one row with flagged clusters, members and positives captured."""
    hit = (F.col("density") > threshold) & (F.col("labeled") >= min_labeled)
    return rows.agg(F.count_if(hit).alias("flagged"), F.sum(F.when(hit, F.col("labeled")).otherwise(0)).alias("flagged_labeled"), F.sum(F.when(hit, F.col("positives")).otherwise(0)).alias("captured"), F.sum("positives").alias("positives"))


def _percent(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.format_string("%.0f%%", F.round(F.col(c) * 100).cast("double")))


def _decimal(c: str, digits: int = 2) -> Column:
    return F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c).cast("double")))


def _shown(c: Column) -> Column:
    return F.coalesce(c, F.lit("n/a"))


def recommended_action(clusters: DataFrame) -> DataFrame:
    """(cluster_key, action, confidence, evidence) of judged clusters; without any evidence the verdict's reason stands in."""
    s = F.col("suspicion_score")
    strong = F.col("shared_instrument") | (F.col("shared_device") & (s >= 2))
    action = F.when(strong | (s >= 3), "HOLD_BONUS").otherwise("MANUAL_REVIEW")
    confidence = F.when(strong, 0.85).when(s >= 3, 0.72).when(s >= 2, 0.55).otherwise(0.4)
    said = [
        F.when(F.col("shared_instrument"), F.concat(_percent("shared_instrument_frac"), F.lit(" share one instrument"))),
        F.when(F.col("shared_device"), F.concat(_percent("shared_device_frac"), F.lit(" share one device"))),
        F.when(F.array_contains("signals_present", "ip_subnet_overlap"), F.lit("a subnet is shared")),
        F.when(F.col("signup_span_days") <= 7, F.concat(F.lit("all signed up within "), _decimal("signup_span_days"), F.lit(" days"))),
        F.when(F.col("order_value_cv") < 0.15, F.concat(F.lit("order values vary by only "), _decimal("order_value_cv", 4))),
        F.when(F.col("claim_then_dormant_frac") >= 0.4, F.concat(_percent("claim_then_dormant_frac"), F.lit(" went silent after their claim"))),
    ]
    evidence = F.array_compact(F.array(*said))
    evidence = F.when(F.size(evidence) == 0, F.array("reason")).otherwise(evidence)
    return clusters.select("cluster_key", action.alias("action"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"), evidence.alias("evidence"))


def evidence_text(clusters: DataFrame, stage: str = "stage") -> DataFrame:
    """(cluster_key, evidence_text): twelve lines of a cluster's aggregates, without ids of members; what is unknown reads n/a."""
    found = F.col(stage) if stage in clusters.columns else F.lit(None).cast("string")
    signals = F.when(F.size(F.coalesce("signals_present", F.array())) > 0, F.array_join("signals_present", ", ")).otherwise("none")
    whole = lambda c: _shown(F.col(c).cast("string"))
    share = lambda c: F.concat(F.when(F.col(f"shared_{c}"), "yes").otherwise("no"), F.lit(", "), _shown(_percent(f"shared_{c}_frac")))
    lines = {
        "stage": _shown(found),
        "members": F.concat(whole("size"), F.lit(", density "), _shown(_decimal("edge_density", 4))),
        "signals": signals,
        "one device": share("device"),
        "one instrument": share("instrument"),
        "signups": F.concat(F.lit("over "), _shown(_decimal("signup_span_days")), F.lit(" days, "), _shown(_decimal("avg_gap_hours")), F.lit(" hours apart on average")),
        "claims": F.concat(_shown(_percent("claim_frac")), F.lit(", "), _shown(_decimal("bonus_claim_velocity_hours")), F.lit(" hours after signup")),
        "silent after the claim": _shown(_percent("claim_then_dormant_frac")),
        "orders": F.concat(whole("n_orders"), F.lit(", values vary by "), _shown(_decimal("order_value_cv", 4))),
        "late sessions a member": _shown(_decimal("post_signup_engagement", 3)),
        "reason": _shown(F.col("reason")),
        "scores": F.concat(F.lit("organic "), whole("organic_score"), F.lit(" of 3, suspicion "), whole("suspicion_score"), F.lit(" of 4")),
    }
    return clusters.select("cluster_key", F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in lines.items()]).alias("evidence_text"))
