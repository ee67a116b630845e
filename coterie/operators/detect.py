"""The whole pipeline over entity groups: both clusterings, features and verdicts of every candidate (G05)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.functions.storage import stored
from coterie.operators import cluster, factored, features, graph, rules


def detect(groups: DataFrame, device: DataFrame, instrument: DataFrame, signup: DataFrame, claim: DataFrame, sessions: DataFrame, orders: DataFrame, hard: list[str] = graph.HARD, gamma: float = 1.3) -> DataFrame:
    """Candidates with stage, members, features, scores, rule, flagged and reason.

    groups: factored.entity_groups; device and instrument(member, value), the others (user_id, ...) as for features.cluster_features.
    Components of the hard groups come first; communities of all groups are added unless they cover most of one of those.
    """
    groups = stored(groups)
    linked = cluster.connected_components(graph.star_edges(factored.hard_groups(groups, hard).select(F.col("member").alias("id"), "value")))
    named = stored(cluster.dedupe_candidates(stored(linked), factored.communities(groups, gamma)))
    f = features.cluster_features_of_groups(groups, named.select("cluster_key", "member"), device, instrument, signup, claim, sessions, orders)
    members = named.groupBy("cluster_key", "stage").agg(F.sort_array(F.collect_list("member")).alias("members"))
    return rules.verdict(f).join(members, "cluster_key")
