"""Global row numbers and running sums without a window over one partition."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.storage import stored


def _ranged(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``df`` in stored range partitions of ``keys``; ``_part`` ascends with the keys."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))


def _offsets(parts: DataFrame, *sums: str) -> DataFrame:
    """Exclusive prefix sums over ``_part``: as many rows as there are partitions."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_before_{c}") for c in sums])


def global_row_number(df: DataFrame, keys: list[Column], name: str = "row_number") -> DataFrame:
    """Adds 1, 2, 3, ... in the order of ``keys``.

    Rows are ranged by the keys and numbered inside their partition; the only
    rows that meet in one task are the partitions' counts. Equal keys are
    numbered in no particular order, so end ``keys`` with a unique column.
    """
    ranged = _ranged(df, keys)
    before = _offsets(ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")), "n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    numbered = ranged.withColumn(name, inside).join(F.broadcast(before), "_part")
    return numbered.withColumn(name, F.col(name) + F.col("_before_n")).drop("_part", "_before_n")


def running_sums(df: DataFrame, keys: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds inclusive running sums in the order of ``keys``: {new column: summed column}."""
    ranged = _ranged(df, keys)
    before = _offsets(ranged.groupBy("_part").agg(*[F.sum(c).alias(c) for c in set(sums.values())]), *set(sums.values()))
    w = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(F.broadcast(before), "_part")
    out = reduce(lambda d, x: d.withColumn(x[0], F.sum(x[1]).over(w) + F.col(f"_before_{x[1]}")), sums.items(), joined)
    return out.drop("_part", *[f"_before_{c}" for c in set(sums.values())])
