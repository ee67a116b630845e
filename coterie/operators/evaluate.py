"""Overlap joins and evaluation (H). Sets are long tables (set_id, member)."""

from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.storage import stored
from coterie.operators.cluster import illicit_structures


def overlap_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, overlap, recall of a, precision of b) for overlapping sets: an equi-join on members."""
    sa, sb = (df.groupBy(F.col("set_id").alias(n)).agg(F.count(F.lit(1)).alias(f"n_{n}")) for df, n in ((a, "a_id"), (b, "b_id")))
    both = a.select(F.col("set_id").alias("a_id"), "member").join(b.select(F.col("set_id").alias("b_id"), "member"), "member").groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("overlap"))
    return both.join(sa, "a_id").join(sb, "b_id").select("a_id", "b_id", "overlap", (F.col("overlap") / F.col("n_a_id")).alias("recall"), (F.col("overlap") / F.col("n_b_id")).alias("precision"))


def _first(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    return df.withColumn("_p", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter("_p = 1").drop("_p")


def best_match(truth: DataFrame, flagged: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(set_id, cluster_key) for every truth set: the cluster of the largest smaller share, null if none reaches threshold."""
    good = overlap_pairs(truth, flagged).filter((F.col("recall") >= threshold) & (F.col("precision") >= threshold))
    best = _first(good, "a_id", [F.desc(F.least("recall", "precision")), F.asc("b_id")])
    return truth.select("set_id").distinct().join(best.select(F.col("a_id").alias("set_id"), F.col("b_id").alias("cluster_key")), "set_id", "left")


def largest_overlap(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """(set_id, match_id, overlap, recall, precision): each block's set of the largest overlap; recall is the share of that set, precision of the block."""
    return _largest(overlap_pairs(blocks, sets))


def _largest(pairs: DataFrame) -> DataFrame:
    best = _first(pairs, "a_id", [F.desc("overlap"), F.asc("b_id")])
    return best.select(F.col("a_id").alias("set_id"), F.col("b_id").alias("match_id"), "overlap", F.round("precision", 3).alias("recall"), F.round("recall", 3).alias("precision"))


def landed_in(members: DataFrame, candidates: DataFrame, flagged: DataFrame, share: float = 0.5) -> DataFrame:
    """For each new group the candidate that holds max(2, floor(n * share)) of it, and its status. flagged(cluster_key, flagged)."""
    n = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    held = overlap_pairs(members, candidates).join(n, F.col("a_id") == F.col("set_id")).filter(F.col("overlap") >= F.greatest(F.lit(2), F.floor(F.col("n") * share)))
    best = _first(held, "a_id", [F.desc("overlap"), F.asc("b_id")]).select(F.col("a_id").alias("set_id"), F.col("b_id").alias("cluster_key"))
    out = n.join(best, "set_id", "left").join(flagged, "cluster_key", "left")
    status = F.when(F.col("cluster_key").isNull(), "not_clustered").when(F.coalesce("flagged", F.lit(False)), "flagged").otherwise("clustered_not_flagged")
    return out.select("set_id", "cluster_key", status.alias("status"))


def _holdout(ids: DataFrame, fraction: float, seed: int) -> Column:
    """Which split an ``id`` of ids(id), each there once, falls in: those up to a place in md5 order are holdout.

    The hashes' first four digits are counted, 65,536 counts at most, and only those that have the place's are put in order.
    """
    h = F.md5(F.concat(F.col("id").cast("string"), F.lit(f"|{seed}")))
    start = F.substring(h, 1, 4)
    counts = sorted(map(tuple, ids.groupBy(start).count().collect()))
    left = max(1, floor(sum(n for _, n in counts) * fraction))
    for digits, n in counts:
        if left <= n:
            break
        left -= n
    else:
        return F.lit("dev")
    near = ids.filter(start == digits).select(h.alias("h"), "id").orderBy("h", "id").limit(left)
    last = near.agg(F.max(F.struct("h", "id")).alias("last")).first().last
    return F.when((h < last.h) | ((h == last.h) & (F.col("id") <= last.id)), "holdout").otherwise("dev")


def holdout_split(ids: DataFrame, fraction: float = 0.3, seed: int = 7) -> DataFrame:
    """(id, split): the first share of ids(id), each there once, in md5 order is holdout, at least one."""
    return ids.select("id", _holdout(ids, fraction, seed).alias("split"))


def tagged_sets(rings: DataFrame, confounders: DataFrame) -> DataFrame:
    """(kind, set_id, type, member) of rings and look-alikes (set_id, type, member); set ids become text, so both kinds may use the same ones."""
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("set_id").cast("string").alias("set_id"), "type", "member")
    return tag(rings, "ring").unionByName(tag(confounders, "confounder"))


def split_sets(truth: DataFrame, fraction: float = 0.3, seed: int = 7) -> DataFrame:
    """(kind, set_id, split): rings and look-alikes are split apart, each with a holdout share of its own."""
    ids = stored(truth.select("kind", F.col("set_id").alias("id")).distinct())
    ring, other = (_holdout(ids.filter(F.col("kind") == kind).select("id"), fraction, seed) for kind in ("ring", "confounder"))
    return ids.select("kind", F.col("id").alias("set_id"), F.when(F.col("kind") == "ring", ring).otherwise(other).alias("split"))


def tagged_pairs(truth: DataFrame, flagged: DataFrame) -> DataFrame:
    """overlap_pairs of tagged sets, whose a_id is (kind, set_id)."""
    return overlap_pairs(truth.select(F.struct("kind", "set_id").alias("set_id"), "member"), flagged)


def set_outcomes(truth: DataFrame, flagged: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(kind, set_id, type, size, cluster_key, matched): the detail of every tagged set, with its best flagged cluster if one reaches threshold."""
    return _outcomes(truth, tagged_pairs(truth, flagged), threshold)


def _outcomes(truth: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    good = pairs.filter((F.col("recall") >= threshold) & (F.col("precision") >= threshold))
    best = good.groupBy("a_id.kind", "a_id.set_id").agg(F.min_by("b_id", F.struct(-F.least("recall", "precision"), "b_id")).alias("cluster_key"))
    sets = truth.groupBy("kind", "set_id", "type").agg(F.count(F.lit(1)).alias("size"))
    return sets.join(best, ["kind", "set_id"], "left").withColumn("matched", F.col("cluster_key").isNotNull())


def ring_recall(outcomes: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, kind, type, n, found, rate): shares of tagged sets that a flagged cluster matches, per split and overall, per type and over all types.

    For rings that is recall, for look-alikes the false-positive rate; all in one pass over outcomes, by grouping sets.
    """
    rows = outcomes.join(splits, ["kind", "set_id"])
    sets = [[F.col("split"), F.col("kind"), F.col("type")], [F.col("split"), F.col("kind")], [F.col("kind"), F.col("type")], [F.col("kind")]]
    per = rows.groupingSets(sets, "split", "kind", "type").agg(F.grouping("split").alias("_s"), F.grouping("type").alias("_t"), F.count(F.lit(1)).alias("n"), F.count_if("matched").alias("found"))
    split = F.when(F.col("_s") == 1, "overall").otherwise(F.col("split")).alias("split")
    return per.select(split, "kind", F.when(F.col("_t") == 1, "all").otherwise(F.col("type")).alias("type"), "n", "found", (F.col("found") / F.col("n")).alias("rate"))


def false_positive_rate(confounders: DataFrame, flagged: DataFrame, candidates: DataFrame, reasons: DataFrame) -> DataFrame:
    """Each look-alike (set_id, member) with whether it was flagged or came up as a candidate at all, by which cluster, and why that one was or
    was not flagged (reasons: cluster_key, reason); ``rate`` is the share flagged of all."""
    hit = best_match(confounders, flagged).withColumnRenamed("cluster_key", "hit")
    seen = best_match(confounders, candidates).withColumnRenamed("cluster_key", "seen")
    rows = stored(hit.join(seen, "set_id").select("set_id", F.col("hit").isNotNull().alias("wrongly_flagged"), F.col("seen").isNotNull().alias("surfaced"), F.coalesce("hit", "seen").alias("cluster_key")))
    rate = rows.agg((F.count_if("wrongly_flagged") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("rate"))
    return rows.join(reasons.select("cluster_key", "reason"), "cluster_key", "left").crossJoin(F.broadcast(rate)).select("set_id", "wrongly_flagged", "surfaced", "cluster_key", "reason", "rate")


def cluster_precision(flagged: DataFrame, truth: DataFrame, splits: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(split, relevant, true_clusters, false_clusters, precision) over tagged sets: of the flagged clusters that touch a ring or
    look-alike of the split, those that match one of its rings, and the others; per split and overall."""
    return _precision(tagged_pairs(truth, flagged), splits, threshold)


def _precision(pairs: DataFrame, splits: DataFrame, threshold: float) -> DataFrame:
    good = (F.col("a_id.kind") == "ring") & (F.col("recall") >= threshold) & (F.col("precision") >= threshold)
    rows = pairs.select(F.col("a_id.kind").alias("kind"), F.col("a_id.set_id").alias("set_id"), "b_id", good.cast("int").alias("good")).join(splits, ["kind", "set_id"])
    per = rows.groupingSets([[F.col("split"), F.col("b_id")], [F.col("b_id")]], "split", "b_id").agg(F.grouping("split").alias("_s"), F.max("good").alias("good"))
    named = per.select(F.when(F.col("_s") == 1, "overall").otherwise(F.col("split")).alias("split"), "good")
    return named.groupBy("split").agg(F.count(F.lit(1)).alias("relevant"), F.sum("good").alias("true_clusters"), F.sum(1 - F.col("good")).alias("false_clusters"), F.avg("good").alias("precision"))


def eval_report(truth: DataFrame, flagged: DataFrame, splits: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for dev, holdout and overall: rings and recall by type (hard, soft), look-alikes and their false-positive rate, and precision.

    truth: tagged_sets, flagged(set_id, member), splits: split_sets. A rate over no sets is null.
    """
    pairs = stored(tagged_pairs(truth, flagged))
    rates = ring_recall(_outcomes(truth, pairs, threshold), splits)
    of = lambda kind, type_, c: F.max(F.when((F.col("kind") == kind) & (F.col("type") == type_), F.col(c)))
    count = lambda kind, type_: F.coalesce(of(kind, type_, "n"), F.lit(0))
    wide = rates.groupBy("split").agg(count("ring", "hard").alias("n_hard"), of("ring", "hard", "rate").alias("hard_recall"), count("ring", "soft").alias("n_soft"), of("ring", "soft", "rate").alias("soft_recall"), count("ring", "all").alias("n_rings"), of("ring", "all", "rate").alias("recall"), count("confounder", "all").alias("n_confounders"), of("confounder", "all", "rate").alias("false_positive_rate"))
    out = wide.join(_precision(pairs, splits, threshold).hint("merge"), "split", "left")
    return out.fillna(0, ["relevant", "true_clusters", "false_clusters"])


def rate_by(rows: DataFrame, dims: list[str], flag: str, listed: DataFrame | None = None) -> DataFrame:
    """Totals, hits and rate; groups of ``listed`` appear even when empty."""
    out = rows.groupBy(*dims).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(flag)).alias("hits"), F.avg(F.col(flag).cast("int")).alias("rate"))
    return out.join(listed, dims, "right").fillna(0, ["total", "hits"]) if listed is not None else out


def tag_cluster_tier(membership: DataFrame, tiers: DataFrame) -> DataFrame:
    """tiers(member, tier 1..3): the best tier and the count of each."""
    return membership.join(tiers, "member").groupBy("cluster_key").agg(F.min("tier").alias("best_tier"), *[F.count_if(F.col("tier") == k).alias(f"tier{k}") for k in (1, 2, 3)])


def threshold_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """rows(labeled, positives, density): flagged, captured, recall, precision, lift per threshold, of rows above it.

    Rows are counted once by how many thresholds they pass; a threshold's figures are the sums from its place on.
    """
    grid = sorted(set(map(float, thresholds)))
    passed = F.coalesce(F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t < F.col("density"))), F.lit(0))
    per = rows.groupBy(passed.alias("passed")).agg(F.count(F.lit(1)).alias("n"), F.sum("positives").alias("positives"), F.sum("labeled").alias("labeled"))
    marks = rows.sparkSession.createDataFrame(list(enumerate(grid)), "place int, threshold double")
    each = marks.crossJoin(F.broadcast(per))  # thresholds times thresholds
    hit = F.col("passed") > F.col("place")
    part = lambda c: F.sum(F.when(hit, F.col(c)).otherwise(0))
    t = each.groupBy("threshold").agg(part("n").alias("flagged"), part("positives").alias("captured"), part("labeled").alias("in_flagged"), F.sum("positives").alias("all_positives"), F.sum("labeled").alias("all_labeled"))
    zero = lambda c: F.nullif(F.col(c), F.lit(0))
    precision = F.col("captured") / zero("in_flagged")
    return t.select("threshold", "flagged", "captured", (F.col("captured") / zero("all_positives")).alias("recall"), precision.alias("precision"), (precision / (F.col("all_positives") / zero("all_labeled"))).alias("lift"))


def neighbor_flag(edges: DataFrame, labels: DataFrame, membership: DataFrame, flags: DataFrame) -> DataFrame:
    """(member, positive): members of clusters that were not flagged, and of none that was, with a positive neighbour in edges.

    labels(id, label), membership(cluster_key, member), flags(cluster_key, flagged).
    """
    judged = membership.join(flags, "cluster_key").groupBy("member").agg(F.max(F.coalesce("flagged", F.lit(False))).alias("flagged"))
    diluted = judged.filter("not flagged").select("member")
    ways = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    positive = labels.filter("label = 1").select(F.col("id").alias("dst")).distinct()
    near = ways.join(positive, "dst", "left_semi").select(F.col("src").alias("member")).distinct()
    known = labels.groupBy(F.col("id").alias("member")).agg((F.max("label") == 1).alias("positive"))
    return diluted.join(near, "member", "left_semi").join(known, "member", "left").select("member", F.coalesce("positive", F.lit(False)).alias("positive"))


def dilution_recovery(edges: DataFrame, labels: DataFrame, membership: DataFrame, flags: DataFrame) -> DataFrame:
    """One row: members checked outside flagged clusters, those flagged by a neighbour and the positives among them, and recall and
    precision over members of flagged clusters alone and of both together."""
    judged = membership.join(flags, "cluster_key").groupBy("member").agg(F.max(F.coalesce("flagged", F.lit(False))).alias("flagged"), F.lit(True).alias("listed"))
    near = neighbor_flag(edges, labels, membership, flags).select("member", F.lit(True).alias("near"))
    known = labels.groupBy(F.col("id").alias("member")).agg((F.max("label") == 1).alias("positive"))
    rows = judged.join(near.hint("merge"), "member", "left").join(known, "member", "full").fillna(False, ["flagged", "listed", "near", "positive"])
    counted = {"checked": "listed and not flagged", "near": "near", "recovered": "near and positive", "positives": "positive", "members": "flagged", "captured": "flagged and positive"}
    total = rows.agg(*[F.count_if(F.expr(c)).alias(name) for name, c in counted.items()])
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 4)
    c, m, p = F.col("captured"), F.col("members"), F.col("positives")
    return total.select("checked", "near", "recovered", share(c, p).alias("cluster_recall"), share(c, m).alias("cluster_precision"), share(c + F.col("recovered"), p).alias("combined_recall"), share(c + F.col("recovered"), m + F.col("near")).alias("combined_precision"))


def structural_coverage(edges: DataFrame, labels: DataFrame, flagged: DataFrame, threshold: float = 0.5) -> DataFrame:
    """How many true structures a single flagged group covers."""
    truth = illicit_structures(edges, labels).select(F.col("cluster_key").alias("set_id"), "member")
    best = overlap_pairs(truth, flagged).groupBy("a_id").agg(F.max("recall").alias("recall"))
    every = truth.select("set_id").distinct().join(best, F.col("set_id") == F.col("a_id"), "left")
    return every.agg(F.count(F.lit(1)).alias("structures"), F.count_if(F.col("recall") >= threshold).alias("covered"))


def member_recall(truth: DataFrame, flagged: DataFrame) -> DataFrame:
    caught = flagged.select("member").distinct().withColumn("caught", F.lit(True))
    pieces = truth.join(flagged.select("member", F.col("set_id").alias("c")), "member").groupBy("set_id").agg(F.countDistinct("c").alias("pieces"))
    per = truth.join(caught, "member", "left").groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), F.count("caught").alias("caught"))
    return per.join(pieces, "set_id", "left").select("set_id", (F.col("caught") / F.col("n")).alias("member_recall"), F.coalesce("pieces", F.lit(0)).alias("pieces"))


def two_way_agreement(blocks: DataFrame, flagged: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(measure, n) of a cross-check of dense blocks (set_id, member) with flagged clusters and tagged sets.

    blocks_in_*: blocks whose set of the largest overlap matches both ways; hard_rings_found: different hard rings so matched, of
    hard_rings; flagged_in_blocks and confounders_in_blocks: those that any block matches.
    """
    sets = lambda kind: truth.filter(F.col("kind") == kind)
    good = (F.col("recall") >= threshold) & (F.col("precision") >= threshold)
    pairs = {name: stored(overlap_pairs(blocks, sets_.select("set_id", "member"))) for name, sets_ in (("flagged", flagged), ("ring", sets("ring")), ("confounder", sets("confounder")))}
    match = lambda name: _largest(pairs[name]).filter(good)
    both = lambda name: pairs[name].filter(good)
    hard = sets("ring").filter("type = 'hard'").select("set_id").distinct()
    in_rings = stored(match("ring"))
    counts = {
        "blocks": blocks.select("set_id").distinct(),
        "blocks_in_flagged": match("flagged"),
        "blocks_in_rings": in_rings,
        "blocks_in_confounders": match("confounder"),
        "hard_rings": hard,
        "hard_rings_found": hard.join(in_rings.select(F.col("match_id").alias("set_id")), "set_id", "left_semi"),
        "flagged_in_blocks": both("flagged").select("b_id").distinct(),
        "confounders_in_blocks": both("confounder").select("b_id").distinct(),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n") for name, df in counts.items()])


def new_false_positives(now: DataFrame, control: DataFrame, key: str) -> DataFrame:
    return now.select(key).distinct().join(control.select(key), key, "left_anti")


def period_trend(metrics: DataFrame) -> DataFrame:
    """metrics(series, period, recall): decaying if the last period is below the first, flat if all agree, else inconclusive."""
    t = metrics.groupBy("series").agg(F.min_by("recall", "period").alias("first"), F.max_by("recall", "period").alias("last"), F.min("recall").alias("least"), F.max("recall").alias("most"), F.count_if(F.col("recall").isNull()).alias("unknown"))
    same = (F.col("most") - F.col("first") < 1e-9) & (F.col("first") - F.col("least") < 1e-9)
    trend = F.when(F.col("unknown") > 0, "inconclusive").when(F.col("last") < F.col("first") - 1e-9, "decaying").when(same, "flat").otherwise("inconclusive")
    return t.select("series", "first", "last", trend.alias("trend"))


def effect_decomposition(variants: DataFrame) -> DataFrame:
    """variants(variant A/B/C, value): both steps' effects and the larger one."""
    p = variants.groupBy().pivot("variant", ["A", "B", "C"]).agg(F.first("value"))
    e = p.select((F.col("B") - F.col("A")).alias("first_effect"), (F.col("C") - F.col("B")).alias("second_effect"))
    return e.withColumn("dominant", F.when(F.abs("first_effect") > F.abs("second_effect"), "first").when(F.abs("first_effect") < F.abs("second_effect"), "second").otherwise("equal"))


def calibration_buckets(rows: DataFrame, n: int = 10, least: int = 5) -> DataFrame:
    """rows(confidence, correct): accuracy per bucket, all listed; insufficient below ``least`` negatives overall."""
    bucket = F.least(F.floor(F.col("confidence") * n), F.lit(n - 1)).cast("int")
    per = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr("correct")).alias("correct"))
    listed = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    out = listed.join(per, "bucket", "left").fillna(0, ["total", "correct"])
    bad = rows.agg(F.count_if(~F.col("correct")).alias("negatives"))
    status = F.when(F.col("negatives") < least, "insufficient").otherwise("ok")
    return out.crossJoin(F.broadcast(bad)).select("bucket", "total", "correct", (F.col("correct") / F.nullif(F.col("total"), F.lit(0))).alias("accuracy"), status.alias("status"))


def spurious_edge_check(edges: DataFrame, blank_ids: DataFrame) -> DataFrame:
    ids = blank_ids.select("id").distinct()
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inside.agg(F.count(F.lit(1)).alias("spurious_edges"))
