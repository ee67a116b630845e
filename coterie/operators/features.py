"""Cluster features, one row per cluster (F). membership(cluster_key, member)."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.storage import stored
from coterie.operators import factored
from coterie.operators.cluster import connected_components
from coterie.operators.graph import induced_edges, valid_value


def sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("size"))


def density(edges: DataFrame, membership: DataFrame) -> DataFrame:
    n = induced_edges(edges, membership).groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n_edges"))
    out = sizes(membership).join(n, "cluster_key", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return out.withColumn("edge_density", F.when(F.col("size") > 1, F.round(F.col("n_edges") / (F.col("size") * (F.col("size") - 1) / 2), 4)).otherwise(0.0))


def signals_present(edges: DataFrame, membership: DataFrame) -> DataFrame:
    return induced_edges(edges, membership).groupBy("cluster_key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("signals")))).alias("signals_present"))


def shared_value(membership: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """shared_<name>, shared_<name>_frac: whether, and which share of members, hold the commonest value. values(member, value)."""
    counts = membership.join(values.filter(valid_value(F.col("value"))), "member").groupBy("cluster_key", "value").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("cluster_key").agg(F.max("n").alias("top"))
    out = sizes(membership).join(top, "cluster_key", "left").withColumn("top", F.coalesce("top", F.lit(0)))
    return out.select("cluster_key", (F.col("top") >= 2).alias(f"shared_{name}"), F.round(F.col("top") / F.col("size"), 3).alias(f"shared_{name}_frac"))


def _hours(a: str | Column, b: str | Column) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)) / 3.6e9


def _signed_round(c: Column, digits: int) -> Column:
    """round, but what is below zero and rounds to it stays -0.0, as in SQL; texts then show the sign."""
    rounded = F.round(c, digits)
    return F.when((rounded == 0) & (c < 0), F.lit(-0.0)).otherwise(rounded)


def signup_timing(membership: DataFrame, signup: DataFrame) -> DataFrame:
    one = membership.join(signup.select(F.col("user_id").alias("member"), "signup_ts"), "member", "left").groupBy("cluster_key").agg(F.min("signup_ts").alias("lo"), F.max("signup_ts").alias("hi"), F.count("signup_ts").alias("n"))
    span = F.when(F.col("n") >= 2, _hours("hi", "lo"))
    return one.select("cluster_key", F.round(F.coalesce(span / 24, F.lit(0.0)), 2).alias("signup_span_days"), F.round(F.coalesce(span / (F.col("n") - 1), F.lit(0.0)), 2).alias("avg_gap_hours"))


def claims(membership: DataFrame, signup: DataFrame, claim: DataFrame, sessions: DataFrame) -> DataFrame:
    """claim_frac, bonus_claim_velocity_hours, claim_then_dormant_frac."""
    last = sessions.groupBy(F.col("user_id").alias("member")).agg(F.max("ts").alias("last"))
    rows = membership.join(signup.select(F.col("user_id").alias("member"), "signup_ts"), "member", "left").join(claim.select(F.col("user_id").alias("member"), "claim_ts"), "member", "left").join(last, "member", "left")
    both = F.col("claim_ts").isNotNull() & F.col("signup_ts").isNotNull()
    dormant = F.when(both, F.coalesce((F.col("last") <= F.col("claim_ts") + F.expr("interval 3 days")).cast("int"), F.lit(1)))
    return rows.groupBy("cluster_key").agg(F.round(F.count_if(both) / F.count(F.lit(1)), 3).alias("claim_frac"), _signed_round(F.avg(F.when(both, _hours("claim_ts", "signup_ts"))), 2).alias("bonus_claim_velocity_hours"), F.round(F.avg(dormant), 3).alias("claim_then_dormant_frac"))


def order_values(membership: DataFrame, orders: DataFrame) -> DataFrame:
    rows = membership.join(orders.select(F.col("user_id").alias("member"), "order_value"), "member", "left")
    cv = F.when((F.count("order_value") >= 2) & (F.avg("order_value") > 0), F.round(F.stddev_samp("order_value") / F.avg("order_value"), 4))
    return rows.groupBy("cluster_key").agg(F.count("order_value").alias("n_orders"), cv.alias("order_value_cv"))


def engagement(membership: DataFrame, signup: DataFrame, sessions: DataFrame) -> DataFrame:
    late = sessions.join(signup, "user_id").filter(F.col("ts") > F.col("signup_ts") + F.expr("interval 7 days")).groupBy(F.col("user_id").alias("member")).agg(F.count(F.lit(1)).alias("late"))
    rows = membership.join(late, "member", "left").groupBy("cluster_key").agg(F.round(F.coalesce(F.sum("late"), F.lit(0)) / F.count(F.lit(1)), 3).alias("post_signup_engagement"))
    return rows


def member_facts(membership: DataFrame, signup: DataFrame, claim: DataFrame, sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """A row per membership row with what its member did: signup and claim, last and late sessions, and orders as count, mean and squared spread."""
    user = F.col("user_id").alias("member")
    acts = sessions.join(signup, "user_id", "left").groupBy(user).agg(F.max("ts").alias("last"), F.count_if(F.col("ts") > F.col("signup_ts") + F.expr("interval 7 days")).alias("late"))
    money = orders.groupBy(user).agg(F.count("order_value").alias("bought"), F.avg("order_value").alias("mean"), (F.var_pop("order_value") * F.count("order_value")).alias("spread"))
    facts = [signup.select(user, "signup_ts"), claim.select(user, "claim_ts"), acts, money]
    return reduce(lambda a, b: a.join(b, "member", "left"), facts, membership.select("cluster_key", "member"))


def _behaviour(facts: DataFrame) -> DataFrame:
    """Size, timing, claims, orders and engagement of each cluster in one aggregate over member_facts."""
    span = F.when(F.count("signup_ts") >= 2, _hours(F.max("signup_ts"), F.min("signup_ts")))
    both = F.col("claim_ts").isNotNull() & F.col("signup_ts").isNotNull()
    dormant = F.when(both, F.coalesce((F.col("last") <= F.col("claim_ts") + F.expr("interval 3 days")).cast("int"), F.lit(1)))
    n = F.sum("bought")
    mean = F.sum(F.col("bought") * F.col("mean")) / n
    squares = F.sum(F.col("spread") + F.col("bought") * F.col("mean") * F.col("mean")) - n * mean * mean
    return facts.groupBy("cluster_key").agg(
        F.count(F.lit(1)).alias("size"),
        F.round(F.coalesce(span / 24, F.lit(0.0)), 2).alias("signup_span_days"),
        F.round(F.coalesce(span / (F.count("signup_ts") - 1), F.lit(0.0)), 2).alias("avg_gap_hours"),
        F.round(F.count_if(both) / F.count(F.lit(1)), 3).alias("claim_frac"),
        _signed_round(F.avg(F.when(both, _hours("claim_ts", "signup_ts"))), 2).alias("bonus_claim_velocity_hours"),
        F.round(F.avg(dormant), 3).alias("claim_then_dormant_frac"),
        F.coalesce(n, F.lit(0)).alias("n_orders"),
        F.when((n >= 2) & (mean > 0), F.round(F.sqrt(F.greatest(squares, F.lit(0.0)) / (n - 1)) / mean, 4)).alias("order_value_cv"),
        F.round(F.coalesce(F.sum("late"), F.lit(0)) / F.count(F.lit(1)), 3).alias("post_signup_engagement"),
    )


FEATURES = "cluster_key size n_edges edge_density signals_present shared_device shared_device_frac shared_instrument shared_instrument_frac signup_span_days avg_gap_hours claim_frac bonus_claim_velocity_hours claim_then_dormant_frac n_orders order_value_cv post_signup_engagement".split()


def _assembled(links: DataFrame, membership: DataFrame, device: DataFrame, instrument: DataFrame, facts: DataFrame) -> DataFrame:
    """All features from links(cluster_key, n_edges, signals_present) and members' facts and values."""
    out = _behaviour(facts).join(links, "cluster_key", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    out = out.withColumn("edge_density", F.when(F.col("size") > 1, F.round(F.col("n_edges") / (F.col("size") * (F.col("size") - 1) / 2), 4)).otherwise(0.0))
    for name, values in (("device", device), ("instrument", instrument)):
        counts = membership.join(values.filter(valid_value(F.col("value"))), "member").groupBy("cluster_key", "value").agg(F.count(F.lit(1)).alias("n"))
        out = out.join(counts.groupBy("cluster_key").agg(F.max("n").alias("top")), "cluster_key", "left").withColumn("top", F.coalesce("top", F.lit(0)))
        out = out.withColumn(f"shared_{name}", F.col("top") >= 2).withColumn(f"shared_{name}_frac", F.round(F.col("top") / F.col("size"), 3)).drop("top")
    return out.select(*FEATURES)


def cluster_features(edges: DataFrame, membership: DataFrame, device: DataFrame, instrument: DataFrame, signup: DataFrame, claim: DataFrame, sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """All features, rounded as the rules read them, from one pass over each cluster's edges and one over its members."""
    inside = induced_edges(edges, membership).groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n_edges"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("signals")))).alias("signals_present"))
    return _assembled(inside, membership, device, instrument, member_facts(membership, signup, claim, sessions, orders))


def cluster_features_of_groups(groups: DataFrame, membership: DataFrame, device: DataFrame, instrument: DataFrame, signup: DataFrame, claim: DataFrame, sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """cluster_features where links are groups (see factored), so that no group is written out in pairs."""
    links = factored.density(groups, membership).select("cluster_key", "n_edges").join(factored.signals_present(groups, membership), "cluster_key", "left")
    return _assembled(links, membership, device, instrument, member_facts(membership, signup, claim, sessions, orders))


def cod_features(edges: DataFrame, membership: DataFrame, accounts: DataFrame, orders: DataFrame) -> DataFrame:
    """edges(src, dst, signals); accounts(user_id, address); orders(user_id, order_value, is_cod, is_refused)."""
    address = shared_value(membership, accounts.select(F.col("user_id").alias("member"), F.col("address").alias("value")), "address")
    rows = membership.join(orders.withColumnRenamed("user_id", "member"), "member", "left")
    n, cod = F.count("order_value"), F.count_if(F.expr("is_cod"))
    money = rows.groupBy("cluster_key").agg(n.alias("n_orders"), cod.alias("n_cod_orders"), F.coalesce(F.round(cod / F.nullif(n, F.lit(0)), 3), F.lit(0.0)).alias("cod_fraction"), F.round(F.count_if(F.col("is_cod") & F.col("is_refused")) / F.nullif(cod, F.lit(0)), 3).alias("refusal_rate"), F.round(F.round(F.avg("order_value"), 6), 2).alias("avg_order_value"), F.when((n >= 2) & (F.avg("order_value") > 0), F.round(F.stddev_samp("order_value") / F.avg("order_value"), 4)).alias("order_value_cv"))
    return density(edges, membership).join(signals_present(edges, membership), "cluster_key", "left").join(money, "cluster_key").join(address, "cluster_key")


def validity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Whether each cluster is one connected block: internal edges, pieces, average degree, share of the largest piece."""
    inside = induced_edges(edges, membership)
    node = lambda c: F.concat_ws("|", F.col("cluster_key").cast("string"), F.col(c).cast("string")).alias(c)
    pieces = connected_components(inside.select(node("src"), node("dst")))
    named = membership.select("cluster_key", F.concat_ws("|", F.col("cluster_key").cast("string"), F.col("member").cast("string")).alias("node")).join(pieces.select(F.col("member").alias("node"), F.col("cluster_key").alias("piece")), "node", "left")
    per = named.groupBy("cluster_key", F.coalesce("piece", "node").alias("piece")).agg(F.count(F.lit(1)).alias("n")).groupBy("cluster_key").agg(F.count(F.lit(1)).alias("pieces"), F.max("n").alias("largest"), F.sum("n").alias("size"))
    count = inside.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("internal_edges"))
    out = per.join(count, "cluster_key", "left").withColumn("internal_edges", F.coalesce("internal_edges", F.lit(0)))
    return out.select("cluster_key", "internal_edges", "pieces", (F.col("pieces") == 1).alias("single_block"), F.round(2 * F.col("internal_edges") / F.col("size"), 2).alias("avg_degree"), F.round(F.col("largest") / F.col("size"), 3).alias("largest_share"))


def validity_summary(checked: DataFrame) -> DataFrame:
    """One row over validity's: groups, those of one block, fragmented ones, and the share of the former."""
    solid = F.count_if("single_block")
    return checked.agg(F.count(F.lit(1)).alias("groups"), solid.alias("single_blocks"), F.count_if(~F.col("single_block")).alias("fragmented"), F.round(solid / F.nullif(F.count(F.lit(1)), F.lit(0)), 4).alias("single_block_share"))


def _steps(ways: DataFrame, sources: DataFrame) -> DataFrame:
    """(cluster_key, source, at, steps): breadth first inside each cluster from all of its sources (cluster_key, source) at once."""
    edge = reached = stored(sources.select("cluster_key", "source", F.col("source").alias("at"), F.lit(0).alias("steps")))
    step = 0
    while not edge.isEmpty():
        step += 1
        wider = edge.withColumnRenamed("at", "src").join(ways, ["cluster_key", "src"]).select("cluster_key", "source", F.col("dst").alias("at"), F.lit(step).alias("steps")).distinct()
        edge = stored(wider.join(reached, ["cluster_key", "source", "at"], "left_anti"))
        reached = reached.unionByName(edge)
    return stored(reached)


def diameters(edges: DataFrame, membership: DataFrame, sources: int = 32) -> DataFrame:
    """(cluster_key, diameter): the longest shortest path inside each cluster of any size; null unless its members are one block of two or more.

    Searching from s bounds every member v: ecc(s) + d(s, v) is not below v's eccentricity. A round searches from up to
    ``sources`` members a cluster, those of the highest bound first (at the start, of the most links), and members whose
    bound is not above the longest path found are settled; rounds go on while a cluster has others. A round makes
    ``sources`` rows a member, and a cluster of that size is done in one.
    """
    inside = induced_edges(edges, membership).select("cluster_key", "src", "dst")
    ways = stored(inside.unionByName(inside.select("cluster_key", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    links = ways.groupBy("cluster_key", F.col("src").alias("member")).agg(F.count(F.lit(1)).alias("links"))
    members = membership.select("cluster_key", "member").join(links, ["cluster_key", "member"], "left")
    per = Window.partitionBy("cluster_key")
    left = stored(members.withColumn("size", F.count(F.lit(1)).over(per)).filter("size > 1").withColumn("bound", F.lit(None).cast("int")))
    longest = left.select("cluster_key", F.lit(0).alias("found"), F.lit(True).alias("whole")).limit(0)
    while not left.isEmpty():
        order = per.orderBy(F.desc_nulls_first("bound"), F.desc_nulls_last("links"), "member")
        chosen = left.withColumn("p", F.row_number().over(order)).filter(F.col("p") <= sources).select("cluster_key", F.col("member").alias("source"), "size")
        reached = _steps(ways, chosen.select("cluster_key", "source"))
        ecc = stored(reached.groupBy("cluster_key", "source").agg(F.max("steps").alias("ecc"), F.count(F.lit(1)).alias("n")).join(chosen, ["cluster_key", "source"]).select("cluster_key", "source", "ecc", (F.col("n") == F.col("size")).alias("whole")))
        now = ecc.groupBy("cluster_key").agg(F.max("ecc").alias("found"), F.min("whole").alias("whole"))
        longest = stored(longest.unionByName(now).groupBy("cluster_key").agg(F.max("found").alias("found"), F.min("whole").alias("whole")))
        bounds = reached.join(ecc.select("cluster_key", "source", "ecc"), ["cluster_key", "source"]).groupBy("cluster_key", F.col("at").alias("member")).agg(F.min(F.col("ecc") + F.col("steps")).alias("new"))
        tighter = left.join(bounds, ["cluster_key", "member"], "left").join(longest, "cluster_key").withColumn("bound", F.least("bound", "new"))
        left = stored(tighter.filter("whole and bound > found").select("cluster_key", "member", "links", "size", "bound"))
    return sizes(membership).join(longest, "cluster_key", "left").select("cluster_key", F.when(F.col("whole"), F.col("found")).alias("diameter"))


def timing_tightness(membership: DataFrame, steps: DataFrame) -> DataFrame:
    """steps(member, step): distinct steps, share in the commonest, whether all share one."""
    per = membership.join(steps, "member").groupBy("cluster_key", "step").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n_steps"), F.round(F.max("n") / F.sum("n"), 4).alias("modal_share"), (F.count(F.lit(1)) == 1).alias("one_step"))


def label_density(membership: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(id, label)."""
    rows = membership.join(labels.withColumnRenamed("id", "member"), "member", "left")
    return rows.groupBy("cluster_key").agg(F.count("label").alias("labeled"), F.coalesce(F.sum("label"), F.lit(0)).alias("positives"), F.avg("label").alias("density"))


def mean_member_score(membership: DataFrame, scores: DataFrame, split: str) -> DataFrame:
    """scores(id, score, split)."""
    rows = membership.join(scores.filter(F.col("split") == split).withColumnRenamed("id", "member"), "member")
    return rows.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("scored"), F.avg("score").alias("mean_score"))


def uid_homogeneity(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Groups of two rows or more by key: all 1, all 0, mixed, and the share of all-1 among those with any 1."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p")).filter("n >= 2")
    return g.agg(F.count_if(F.expr("p = n")).alias("all_one"), F.count_if(F.expr("p = 0")).alias("all_zero"), F.count_if(F.expr("p > 0 and p < n")).alias("mixed"), (F.count_if(F.expr("p = n")) / F.nullif(F.count_if(F.expr("p > 0")), F.lit(0))).alias("pure_share"))
