"""Scoring new arrivals with Structured Streaming (L01)."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from coterie.functions.storage import stored
from coterie.operators import evaluate, factored, features, rules
from coterie.streaming.index import ComponentIndex


def membership_of(touched: DataFrame, min_size: int = 2) -> DataFrame:
    """(cluster_key, member, is_new) of touched rows, components of min_size or more."""
    members = touched.groupBy("cluster_key", F.col("id").alias("member")).agg(F.max("is_new").alias("is_new"))
    big = members.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size).select("cluster_key")
    return members.join(big, "cluster_key", "left_semi")


def judge_touched(touched: DataFrame, signal: str, device: DataFrame, instrument: DataFrame, signup: DataFrame, claim: DataFrame, sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """Features and verdict of the components that a batch touched; every table is cut to their members first.

    touched(cluster_key, id, value, is_new) as ComponentIndex.absorb returns it, its links of kind ``signal``;
    device and instrument(member, value), the others (user_id, ...) as for features.cluster_features.
    """
    membership = stored(membership_of(touched).select("cluster_key", "member"))
    groups = stored(factored.shared_groups(touched.select("id", "value"), signal, 1.0))
    only = lambda df, c: df.join(membership.select(F.col("member").alias(c)).distinct(), c, "left_semi")
    f = features.cluster_features_of_groups(groups, membership, only(device, "member"), only(instrument, "member"), *[only(df, "user_id") for df in (signup, claim, sessions, orders)])
    return rules.verdict(f)


def arrival_status(touched: DataFrame, verdicts: DataFrame, sets: DataFrame, share: float = 0.5) -> DataFrame:
    """(set_id, cluster_key, status) of groups that arrived together, sets(set_id, member): evaluate.landed_in over what they touched."""
    return evaluate.landed_in(sets, membership_of(touched).select(F.col("cluster_key").alias("set_id"), "member"), verdicts.select("cluster_key", "flagged"), share)


def score_arrivals(spark: SparkSession, folder: str, schema: str, known: DataFrame, report: Callable[[DataFrame, int], None], checkpoint: str, store: str, delay: str = "1 day", compact_every: int = 50) -> StreamingQuery:
    """Reads arriving incidence files (id, value, ts), drops repeats within the delay, and reports the components each batch touches.

    report gets (cluster_key, id, value, is_new), the rows of all components that a batch touched, and the batch number;
    membership_of, judge_touched and arrival_status take it from there. ``known`` is the incidence before the stream; it is
    indexed once, in ``store``, a shared folder that belongs to ``checkpoint``. A query started anew goes on with the index;
    a batch run again replaces its part and reports the same. A batch without rows is not reported. Every
    ``compact_every`` batches the index is written as one part; earlier bases in ``store`` may then be removed.
    """
    index = ComponentIndex(spark, store, known.schema["id"].dataType.simpleString(), value_type=known.schema["value"].dataType.simpleString())
    index.build(known)

    def each(batch: DataFrame, number: int) -> None:
        new = stored(batch.select("id", "value"))
        if new.isEmpty():
            return
        report(index.absorb(new, number), number)
        if (number + 1) % compact_every == 0:
            index.compact(number)

    arriving = spark.readStream.schema(schema).json(folder).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id", "value"])
    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
