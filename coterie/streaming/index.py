"""Connected components that grow with arriving rows: a versioned index of labels and of each member's rows (L01).

Four tables stand in a shared folder, all in hash buckets:

    holders  (value, id, lead)   of every value its members; the first that was known stands for it, is the others' lead and has none; by value
    rows     (id, value)         of every member its incidences; by id
    labels   (id, label)         of every member the label of its component, its smallest member; by id
    members  (label, id)         of every component its members; by label

A batch reads the buckets of its own values in ``holders`` and of their leads and its own members in ``labels``, joins the labels it
connects by contraction, and reads the buckets of those components in ``members`` and of their members in ``rows``. Incidences are
written once, when they arrive; components that are merged write their members anew, not their rows. What a batch writes is its own
part. A part is replaced when its batch is run again, and a batch reads earlier parts only, so a replay gives the same. Of a member's
labels the latest holds; a label that was merged into a smaller one is never looked up again. ``compact`` writes the newest state as
one part; which one readers start from is a row of the table ``bases``, written last.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coterie.functions.components import components
from coterie.functions.storage import stored
from coterie.operators.graph import valid_rows

BUCKETS = 64
BEFORE = -1  # the part of the rows that were known before the first batch


class ComponentIndex:
    def __init__(self, spark: SparkSession, folder: str, id_type: str, buckets: int = BUCKETS, value_type: str = "string"):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.id_type, self.value_type = id_type, value_type
        self.schemas = {"holders": f"value {value_type}, id {id_type}, lead {id_type}", "rows": f"id {id_type}, value {value_type}", "labels": f"id {id_type}, label {id_type}", "members": f"label {id_type}, id {id_type}"}

    def _base(self, number: int) -> int | None:
        """The newest compaction before a batch; None if there is no index yet."""
        try:
            bases = self.spark.read.schema("batch int").parquet(f"{self.folder}/bases")
        except AnalysisException:
            return None
        return bases.filter(F.col("batch") < number).agg(F.max("batch")).first()[0]

    def _read(self, table: str, number: int, buckets: list[int] | None = None) -> DataFrame:
        """What batches before ``number`` wrote, with the batch; of some buckets or all."""
        schema = StructType.fromDDL(self.schemas[table]).add("batch", "integer").add("bucket", "integer")
        df = self.spark.read.schema(schema).parquet(f"{self.folder}/{table}/base={self._base(number)}").filter(F.col("batch") < number)
        return (df if buckets is None else df.filter(F.col("bucket").isin(buckets))).drop("bucket")

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _key(self, table: str) -> str:
        return StructType.fromDDL(self.schemas[table]).names[0]

    def _dealt(self, table: str, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", self._bucket(self._key(table))).repartition("bucket")

    def _write(self, table: str, df: DataFrame, base: int, batch: int) -> None:
        self._put(table, self._dealt(table, df.select(*StructType.fromDDL(self.schemas[table]).names)), base, batch)

    def _put(self, table: str, dealt: DataFrame, base: int, batch: int) -> None:
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{table}/base={base}/batch={batch}")

    def _began(self, base: int) -> None:
        self.spark.createDataFrame([(base,)], "batch int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/bases/part={base}")

    def _of(self, table: str, number: int, keys: DataFrame) -> DataFrame:
        """What batches before ``number`` wrote of the stored, distinct ``keys``, a column named as the table's key."""
        key = self._key(table)
        buckets = [r.b for r in keys.select(self._bucket(key).alias("b")).distinct().collect()]  # as many as there are buckets
        return self._read(table, number, buckets).join(keys, key, "left_semi")

    @staticmethod
    def _latest(labels: DataFrame) -> DataFrame:
        return labels.groupBy("id").agg(F.max_by("label", "batch").alias("label"))

    def _incidence(self, df: DataFrame) -> DataFrame:
        """Valid rows in the types of the index; rows may repeat."""
        return valid_rows(df).select(F.col("id").cast(self.id_type).alias("id"), F.col("value").cast(self.value_type).alias("value"))

    def build(self, known: DataFrame) -> None:
        """Indexes the rows known before the first batch, unless that was done."""
        if self._base(BEFORE + 1) is not None:
            return
        once = self._dealt("holders", self._incidence(known)).distinct()
        # Dealt by bucket, all rows of a value are in one task, so neither their distinct ones nor their first need a shuffle.
        first = F.min("id").over(Window.partitionBy("bucket", "value"))
        self._put("holders", once.withColumn("lead", F.nullif(first, F.col("id"))), BEFORE, BEFORE)
        part = lambda table: self.spark.read.schema(self.schemas[table]).parquet(f"{self.folder}/{table}/base={BEFORE}/batch={BEFORE}").drop("bucket")
        self._write("rows", part("holders"), BEFORE, BEFORE)
        found = components(part("holders").filter("lead is not null").select(F.col("lead").alias("a"), F.col("id").alias("b")))
        ids = stored(part("rows").select("id").distinct())
        self._write("labels", ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("label")), BEFORE, BEFORE)
        self._write("members", part("labels"), BEFORE, BEFORE)
        self._began(BEFORE)

    def absorb(self, new: DataFrame, number: int) -> DataFrame:
        """Adds a batch of incidences (id, value) and returns all rows of the components it touches, each once: (cluster_key, id, value, is_new)."""
        new = stored(self._incidence(new).distinct())
        leads = stored(self._of("holders", number, stored(new.select("value").distinct())).filter("lead is null").select("value", F.col("id").alias("lead")))
        asked = stored(new.select("id").unionByName(leads.select(F.col("lead").alias("id"))).distinct())
        known = stored(self._latest(self._of("labels", number, asked)))
        of = lambda c, name: known.select(F.col("id").alias(c), F.col("label").alias(name))
        placed = stored(new.join(leads, "value", "left").join(of("id", "of_id"), "id", "left").join(of("lead", "of_value"), "lead", "left"))
        # A value seen before stands for its component, a new one for the smallest node among its holders.
        nodes = placed.select("value", F.coalesce("of_id", "id").alias("node"), "of_value")
        links = nodes.withColumn("at", F.coalesce("of_value", F.min("node").over(Window.partitionBy("value")))).filter("node != at").select(F.col("node").alias("a"), F.col("at").alias("b"))
        root = stored(components(links).select(F.col("node").alias("was"), F.col("label").alias("root")))
        before = self._of("members", number, stored(known.select("label").distinct())).select(F.col("label").alias("was"), "id")
        unseen = placed.filter("of_id is null").select(F.lit(None).cast(self.id_type).alias("was"), "id").distinct()
        joined = before.unionByName(unseen).withColumn("node", F.coalesce("was", "id"))
        arrived = new.select("id").distinct().withColumn("is_new", F.lit(True))
        now = joined.join(root.withColumnRenamed("was", "node"), "node", "left").join(arrived, "id", "left")
        now = stored(now.select("id", "was", F.coalesce("root", "node").alias("label"), F.coalesce("is_new", F.lit(False)).alias("is_new")))
        labelled = now.select("id", F.col("label").alias("cluster_key"), "is_new")
        earlier = stored(now.filter("was is not null").select("id"))
        old = stored(self._of("rows", number, earlier).join(labelled, "id").select("cluster_key", "id", "value", "is_new"))
        again = stored(placed.filter("of_id is not null and lead is not null").select("id", "value"))  # no other row can be known
        again = stored(again.join(old.select("id", "value"), ["id", "value"], "left_semi"))
        first = F.coalesce("lead", F.nullif(F.min("id").over(Window.partitionBy("value")), F.col("id")))
        fresh = placed.join(again, ["id", "value"], "left_anti").select("id", "value", first.alias("lead"))
        fresh = stored(fresh.join(labelled, "id"))
        moved = now.filter("was is null or was != label")
        base = self._base(number)
        for table, rows in (("holders", fresh), ("rows", fresh), ("labels", moved), ("members", moved)):
            self._write(table, rows, base, number)
        return old.unionByName(fresh.drop("lead"))

    def membership(self, number: int, min_size: int = 2) -> DataFrame:
        """(cluster_key, member) of all components of min_size or more after the batches before ``number``."""
        members = self._latest(self._read("labels", number)).select(F.col("label").alias("cluster_key"), F.col("id").alias("member"))
        big = members.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size).select("cluster_key")
        return members.join(big, "cluster_key", "left_semi")

    def compact(self, number: int) -> None:
        """Writes the state after batch ``number`` as one part that later batches start from."""
        labels = stored(self._latest(self._read("labels", number + 1)))
        for table in ("holders", "rows"):
            self._write(table, self._read(table, number + 1), number, number)
        for table in ("labels", "members"):
            self._write(table, labels, number, number)
        self._began(number)
