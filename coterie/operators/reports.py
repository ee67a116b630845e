"""Report queries (K)."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def list_clusters(clusters: DataFrame, flagged: bool | None = None, stage: str | None = None, search: str | None = None, actions: list[str] | None = None) -> DataFrame:
    """The clusters that every given filter keeps, the most confident first, those without confidence last."""
    out = clusters
    if flagged is not None:
        out = out.filter(F.col("flagged") == flagged)
    if stage:
        out = out.filter(F.col("stage") == stage)
    if actions is not None:
        out = out.filter(F.col("action").isin(actions))
    if search:
        out = out.filter(F.contains(F.col("cluster_key").cast("string"), F.lit(search)))
    return out.orderBy(F.desc_nulls_last("confidence"), "cluster_key")


def audit_tail(audit: DataFrame, n: int = 20, cluster_key=None) -> DataFrame:
    rows = audit if cluster_key is None else audit.filter(F.col("cluster_key") == cluster_key)
    return rows.orderBy(F.desc("audit_id")).limit(n)


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def evidence_chain(clusters: DataFrame, audit: DataFrame) -> DataFrame:
    """The first flagged cluster with the newest audit row of each event kind."""
    one = clusters.filter("flagged").orderBy("cluster_key").limit(1).select("cluster_key")
    rows = audit.join(F.broadcast(one), "cluster_key")
    newest = rows.withColumn("p", F.row_number().over(Window.partitionBy("event").orderBy(F.desc("audit_id")))).filter("p = 1")
    return newest.select("cluster_key", "event", "audit_id")


def closest_by_size(sets: DataFrame, target: int) -> DataFrame:
    return sets.orderBy(F.abs(F.col("size") - target), "set_id").limit(1)


def confounder_table(rows: DataFrame, **wanted: list) -> DataFrame:
    for c, v in wanted.items():
        rows = rows.filter(F.col(c).isin(v))
    return rows


def size_distribution(clusters: DataFrame) -> DataFrame:
    """(size, clusters, flagged): how many clusters (cluster_key, size, flagged) have each size, and how many of those are flagged."""
    return clusters.groupBy("size").agg(F.count(F.lit(1)).alias("clusters"), F.count_if("flagged").alias("flagged"))


def largest(clusters: DataFrame, n: int = 15) -> DataFrame:
    """The n largest clusters, ties by key."""
    return clusters.orderBy(F.desc("size"), "cluster_key").limit(n)


def summary_counts(nodes: DataFrame, edges: DataFrame, hard: DataFrame, clusters: DataFrame) -> DataFrame:
    """(measure, n) of a run: nodes, edges, hard edges, candidates (cluster_key, flagged) and flagged ones."""
    per = clusters.groupBy("cluster_key").agg(F.max(F.coalesce("flagged", F.lit(False))).alias("flagged"))
    parts = {"nodes": nodes, "edges": edges, "hard_edges": hard, "candidates": per, "flagged": per.filter("flagged")}
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n") for name, df in parts.items()])
