"""Stores as Parquet tables (B)."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def upsert(new: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """The store with rows of ``new`` in place of those of the same key; write it to a new path."""
    return store.join(new.select(key), key, "left_anti").unionByName(new)


class BucketStore:
    """A keyed table in hash buckets, with a version per write; an upsert rewrites the buckets of its keys and no others.

    ``data/version=v/bucket=b`` holds what version v wrote; ``manifest/version=v`` names for every bucket the version that holds
    it, and is written last, so a version is there as a whole or not at all, and every version can be read again. A version
    written by a job that failed is written anew by the retry; one that is complete is left as it is.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str, buckets: int = 256):
        self.spark, self.folder, self.key, self.schema, self.buckets = spark, folder.rstrip("/"), key, schema, buckets

    def _manifest(self) -> list[Row]:
        """(version, bucket, written): as many rows as there are versions and buckets."""
        try:
            return self.spark.read.schema("bucket int, written int, version int").parquet(f"{self.folder}/manifest").collect()
        except AnalysisException:
            return []

    def versions(self) -> list[int]:
        return sorted({r.version for r in self._manifest()})

    def _places(self, version: int | None) -> dict[int, int]:
        rows = self._manifest()
        wanted = version if version is not None else max((r.version for r in rows), default=None)
        if version is not None and version not in {r.version for r in rows}:
            raise ValueError(f"no version {version}")
        return {r.bucket: r.written for r in rows if r.version == wanted}

    def _of(self, places: dict[int, int]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/version={v}/bucket={b}" for b, v in sorted(places.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is given."""
        return self._of(self._places(version))

    def upsert(self, new: DataFrame, version: int) -> None:
        """Version ``version``: the newest rows with those of ``new`` in place of rows of the same key. Rows of ``new`` that share a key all stay."""
        if version in self.versions():
            return
        places = self._places(None)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows = new.select(*self.spark.createDataFrame([], self.schema).columns).withColumn("bucket", bucket)
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # as many as there are buckets
        old = self._of({b: v for b, v in places.items() if b in touched}).withColumn("bucket", bucket)
        merged = old.join(rows.select(self.key), self.key, "left_anti").unionByName(rows)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/version={version}")
        now = places | dict.fromkeys(touched, version)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, written int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")


def audit_events(clusters: DataFrame, event: str, inputs: list[str], outputs: list[str], at: Column) -> DataFrame:
    """One audit row per decision, with evidence and outcome as JSON."""
    return clusters.select("cluster_key", F.lit(event).alias("event"), F.to_json(F.struct(*inputs)).alias("input_json"), F.to_json(F.struct(*outputs)).alias("output_json"), at.alias("at"))


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    df.write.mode("overwrite").format(form).save(path)


def snapshot(df: DataFrame, path: str, version: str) -> None:
    """Writes ``df`` as that version alone: taken again, or by a job that is retried, it is the same snapshot and not a second one."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/snapshot_id={version}")


def restore(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/snapshot_id={version}")
