"""Clustering as joins that repeat until nothing changes (E)."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.functions.components import components
from coterie.functions.order import global_row_number, running_sums
from coterie.functions.storage import stored
from coterie.operators import factored


def connected_components(edges: DataFrame, min_size: int = 2) -> DataFrame:
    """(cluster_key, member) of components with min_size nodes or more, keyed by their smallest node.

    Star edges value -> member give the same components as cliques.
    """
    labels = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("label").alias("cluster_key"), F.col("node").alias("member"))
    if min_size <= 2:  # a node with a link is never alone
        return labels
    big = labels.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size).select("cluster_key")
    return labels.join(big, "cluster_key", "left_semi")


def modularity(edges: DataFrame, membership: DataFrame, gamma: float = 1.3) -> DataFrame:
    """One row: Q = sum over clusters of inside / m - gamma (degree / 2m)^2; nodes without cluster are their own."""
    ends = edges.select("src", "dst", "weight")
    a = membership.select(F.col("member").alias("src"), F.col("cluster_key").alias("ca"))
    b = membership.select(F.col("member").alias("dst"), F.col("cluster_key").alias("cb"))
    named = ends.join(a, "src", "left").join(b, "dst", "left").withColumn("ca", F.coalesce(F.col("ca").cast("string"), F.concat(F.lit("n"), "src"))).withColumn("cb", F.coalesce(F.col("cb").cast("string"), F.concat(F.lit("n"), "dst")))
    halves = named.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), "weight", F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0).alias("inside")), F.struct(F.col("cb").alias("c"), "weight", F.lit(0.0).alias("inside")))).alias("h"))
    per = halves.groupBy("h.c").agg(F.sum("h.weight").alias("degree"), F.sum("h.inside").alias("inside"))
    total = per.agg(F.sum("degree").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("degree") * F.col("degree")).alias("squares"))
    return total.select((F.col("inside") / (F.col("m2") / 2) - gamma * F.col("squares") / (F.col("m2") * F.col("m2"))).alias("q"))


def louvain(edges: DataFrame, gamma: float = 1.3, min_size: int = 3) -> DataFrame:
    """(cluster_key, member): communities of min_size or more of edges(src, dst, weight), each a group of two; see factored.communities."""
    return factored.communities(factored.edge_groups(edges), gamma, min_size)


def dedupe_candidates(hard: DataFrame, soft: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(stage, cluster_key, member): all hard clusters and the soft ones that cover less than threshold of every hard one."""
    size = hard.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("size"))
    both = hard.select(F.col("cluster_key").alias("h"), "member").join(soft.select(F.col("cluster_key").alias("s"), "member"), "member").groupBy("h", "s").agg(F.count(F.lit(1)).alias("n"))
    covered = both.join(size, F.col("h") == F.col("cluster_key")).filter(F.col("n") >= threshold * F.col("size")).select(F.col("s").alias("cluster_key")).distinct()
    kept = soft.join(covered, "cluster_key", "left_anti")
    tag = lambda df, stage: df.select(F.lit(stage).alias("stage"), F.concat(F.lit(f"{stage}:"), F.col("cluster_key").cast("string")).alias("cluster_key"), "member")
    return tag(hard, "hard").unionByName(tag(kept, "soft"))


def cluster_by_partition(edges: DataFrame, part: str, min_size: int = 2) -> DataFrame:
    """Components of each partition on its own: the partition is part of the node."""
    node = lambda c: F.concat_ws("|", F.col(part).cast("string"), F.col(c).cast("string")).alias(c)
    return connected_components(edges.select(node("src"), node("dst")), min_size)


def illicit_structures(edges: DataFrame, labels: DataFrame, min_size: int = 2) -> DataFrame:
    """Components among the nodes labelled 1."""
    bad = labels.filter("label = 1").select("id")
    inside = edges.join(bad.withColumnRenamed("id", "src"), "src", "left_semi").join(bad.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return connected_components(inside, min_size)


def _densest_prefix(incidence: DataFrame, loads: DataFrame) -> tuple[DataFrame, float]:
    """The incidences (r, c, w, ...) among the nodes of largest load, as many as make them densest, and their density."""
    ranked = stored(global_row_number(loads, [F.desc("load"), F.col("side"), F.col("id")], "rank").select("side", "id", "rank"))
    at = lambda side, c, name: ranked.filter(F.col("side") == side).select(F.col("id").alias(c), F.col("rank").alias(name))
    placed = stored(incidence.join(at("row", "r", "rr"), "r").join(at("col", "c", "rc"), "c").withColumn("rank", F.greatest("rr", "rc")).drop("rr", "rc"))
    run = running_sums(placed.groupBy("rank").agg(F.sum("w").alias("w")), [F.col("rank")], {"inside": "w"})
    most = run.select("rank", (F.col("inside") / F.col("rank")).alias("density")).orderBy(F.desc("density"), "rank").first()
    return placed.filter(F.col("rank") <= most.rank).drop("rank"), most.density


def densest_block(incidence: DataFrame, eps: float = 0.1, passes: int = 4) -> DataFrame:
    """(row_id, col_id, score, bound): a dense block of incidence(row_id, col_id), its density and a bound that no block is above.

    Columns weigh 1 / ln(degree + 5), so popular values hide nothing. A pass drops, round by round, every node whose load and
    weight in what is left are at most 1 + eps times their mean; dropped incidences go to the load of the end that was
    dropped, half to each if both were. The next pass starts from all incidences with these loads, which hold back nodes
    that went early; the densest rest of any round of any pass is the block, or the densest set of nodes of the largest
    loads in the end, whatever is denser. The first pass has no loads and is batch peeling. Loads share out every incidence once a pass, so after any pass the largest load divided by the
    passes bounds all densities.
    """
    weights = incidence.groupBy("col_id").agg((1 / F.log(F.count(F.lit(1)) + 5.0)).alias("w"))
    text = lambda c: F.col(c).cast("string")
    all_ = stored(incidence.join(weights, "col_id").select("row_id", "col_id", text("row_id").alias("r"), text("col_id").alias("c"), "w"))
    ends = lambda df, row, col: df.select(F.explode(F.array(F.struct(F.lit("row").alias("side"), F.col("r").alias("id"), row.alias("w")), F.struct(F.lit("col").alias("side"), F.col("c").alias("id"), col.alias("w")))).alias("e")).select("e.*")
    best, kept, loads, bound = -1.0, all_, None, float("inf")
    for done in range(1, passes + 1):
        live, shares = all_, []
        while True:
            nodes = ends(live, F.col("w"), F.col("w")).groupBy("side", "id").agg(F.sum("w").alias("degree"))
            nodes = nodes.withColumn("load", F.lit(0.0)) if loads is None else nodes.join(loads, ["side", "id"], "left").fillna(0.0, ["load"])
            nodes = stored(nodes)
            n, total, mean = nodes.agg(F.count(F.lit(1)), F.sum(F.when(F.col("side") == "row", F.col("degree"))), F.avg(F.col("degree") + F.col("load"))).first()
            if not n:
                break
            if total / n > best:
                best, kept = total / n, live
            cut = nodes.filter(F.col("degree") + F.col("load") <= (1 + eps) * mean)
            side = lambda s, c, flag: cut.filter(F.col("side") == s).select(F.col("id").alias(c), F.lit(True).alias(flag))  # noqa: E731, B023
            marked = stored(live.join(side("row", "r", "rx"), "r", "left").join(side("col", "c", "cx"), "c", "left").fillna(False, ["rx", "cx"]))
            share = lambda mine, other: F.when(F.col(mine), F.when(F.col(other), F.col("w") / 2).otherwise(F.col("w"))).otherwise(0.0)
            shares.append(ends(marked.filter("rx or cx"), share("rx", "cx"), share("cx", "rx")))
            live = marked.filter("not rx and not cx").drop("rx", "cx")
        before = [] if loads is None else [loads.withColumnRenamed("load", "w")]
        if shares or before:
            loads = stored(reduce(DataFrame.unionByName, [*before, *shares]).groupBy("side", "id").agg(F.sum("w").alias("load")))
            bound = min(bound, loads.agg(F.max("load")).first()[0] / done)
    if loads is not None:
        first, density = _densest_prefix(all_, loads)
        if density > best:
            best, kept = density, first
    return stored(kept.select("row_id", "col_id", F.lit(float(best)).alias("score"), F.lit(float(bound)).alias("bound")))


def top_k_blocks(incidence: DataFrame, k: int = 3, min_users: int = 2, passes: int = 4) -> DataFrame:
    """(block, row_id, score, bound): dense blocks found one after another; a block's own incidences are removed before the next."""
    left, out = stored(incidence.select("row_id", "col_id").distinct()), None
    for b in range(k):
        if left.isEmpty():
            break
        block = densest_block(left, passes=passes)
        users = block.select("row_id", "score", "bound").distinct()
        if users.count() < min_users:
            break
        named = users.select(F.lit(b).alias("block"), "row_id", "score", "bound")
        out = named if out is None else out.unionByName(named)
        left = stored(left.join(block.select("row_id", "col_id"), ["row_id", "col_id"], "left_anti"))
    return out if out is not None else incidence.select(F.lit(0).alias("block"), "row_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("bound")).limit(0)
