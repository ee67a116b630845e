"""Per-entity derivations (C)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Three-digit prefixes of the two upper tiers.
TIER1 = ["110", "400", "411", "560", "600", "500", "700", "380"]
TIER2 = ["302", "226", "682", "641", "452", "440", "395", "530", "462", "800", "160"]


def first_action(sessions: DataFrame, action: str, name: str) -> DataFrame:
    return sessions.filter(F.col("action_type") == action).groupBy("user_id").agg(F.min("ts").alias(name))


def signup_ts(accounts: DataFrame, sessions: DataFrame) -> DataFrame:
    """First signup event, else the signup date."""
    first = first_action(sessions, "signup", "first_signup")
    return accounts.join(first, "user_id", "left").select("user_id", F.coalesce("first_signup", F.col("signup_date").cast("timestamp")).alias("signup_ts"))


def claim_ts(sessions: DataFrame) -> DataFrame:
    return first_action(sessions, "referral_claim", "claim_ts")


def latest_instrument(instruments: DataFrame) -> DataFrame:
    return instruments.groupBy("user_id").agg(F.max_by("instrument_hash", F.struct("first_seen", "instrument_hash")).alias("instrument_hash"))


def user_event_lists(sessions: DataFrame, orders: DataFrame) -> DataFrame:
    times = sessions.groupBy("user_id").agg(F.sort_array(F.collect_list("ts")).alias("times"))
    values = orders.groupBy("user_id").agg(F.sort_array(F.collect_list("order_value")).alias("order_values"))
    return times.join(values, "user_id", "full")


def composite_uid(card: Column, seconds: Column, since: Column) -> Column:
    return F.concat_ws("_", card.cast("string"), (F.floor(seconds / 86400) - F.coalesce(since, F.lit(-999))).cast("bigint").cast("string"))


def host_labels(flows: DataFrame) -> DataFrame:
    """1 for hosts with a botnet flow, 0 for normal ones without, others unlabeled."""
    seen = flows.groupBy("host").agg(F.max(F.col("is_botnet").cast("int")).alias("b"), F.max(F.col("is_normal").cast("int")).alias("n"))
    return seen.select("host", F.when(F.col("b") == 1, 1).when(F.col("n") == 1, 0).alias("label"))


def host_features(flows: DataFrame) -> DataFrame:
    mean = lambda c: F.avg(c).alias(f"{c}_mean")
    std = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std")
    return flows.groupBy("host").agg(F.count(F.lit(1)).alias("n_flows"), F.countDistinct("dst").alias("n_dst"), F.countDistinct("port").alias("n_port"), F.countDistinct("proto").alias("n_proto"), *[f(c) for c in ("dur", "pkts", "bytes") for f in (mean, std)], mean("src_bytes"), (F.sum("bytes") / F.nullif(F.sum("pkts"), F.lit(0))).alias("bytes_per_pkt"))


def tier_of(prefix: Column) -> Column:
    return F.when(prefix.isin(TIER1), "tier1_metro").when(prefix.isin(TIER2), "tier2_city").otherwise("tier3_other")
