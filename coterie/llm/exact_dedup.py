"""Exact deduplication by two passes over a Bloom filter.

The first pass folds every row's hash into the 64-bit words of a blocked Bloom
filter and keeps, for each word, the bits that at least two different rows or
hashes have set. The second pass asks that filter: only rows all of whose bits
were set twice can have an equal, so only they are shuffled by their hash; the
rest are their own groups and pass straight through.

Null text counts as empty, and empty texts equal one another. A row without
doc_id never represents a group that has one. Rows that repeat a doc_id are one
document each, and get the same decision if their texts are equal. Extra
columns are ignored by ``exact_groups`` and returned by ``drop_exact_copies``.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.llm.common import FEW_GONE, SPACES, read, stored

BITS_PER_ROW = 12
FILTER_ROWS_TO_BROADCAST = 4_000_000  # 16 bytes each, some 20 million documents; a larger filter is joined by a shuffle


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _places(words: int) -> list[Column]:
    """The filter word of a row's hash and its four bits in that word."""
    h, g = F.xxhash64("sha"), F.xxhash64(F.lit("bits"), F.col("sha"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return [F.pmod(h, F.lit(words)).alias("word"), bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3)).alias("mask")]


def repeated_bits(digests: DataFrame, words: int) -> DataFrame:
    """(word, twice): the bits of each filter word that two rows have set; words without any are left out.

    Equal hashes meet in the map-side count, so a hash that a third of the rows
    share still sends one row a task; a word then gathers only distinct hashes.
    """
    counted = digests.select(*_places(words)).groupBy("word", "mask").count()
    state = "struct<once:bigint,twice:bigint>"

    def put(acc: Column, x: Column) -> Column:
        again = F.when(x["count"] > 1, x["mask"]).otherwise(acc["once"].bitwiseAND(x["mask"]))
        return F.struct(acc["once"].bitwiseOR(x["mask"]).alias("once"), acc["twice"].bitwiseOR(again).alias("twice")).cast(state)

    zero = F.struct(F.lit(0).alias("once"), F.lit(0).alias("twice")).cast(state)
    folded = counted.groupBy("word").agg(F.aggregate(F.collect_list(F.struct("mask", "count")), zero, put)["twice"].alias("twice"))
    return folded.filter("twice != 0")


def _asked(rows: DataFrame, filtered: DataFrame, words: int) -> DataFrame:
    """Adds maybe to rows with sha: whether the filter says that the hash may occur twice."""
    how = "broadcast" if filtered.count() <= FILTER_ROWS_TO_BROADCAST else "merge"
    asked = rows.select("*", *_places(words)).join(filtered.hint(how), "word", "left")
    return asked.withColumn("maybe", F.coalesce(F.col("mask").bitwiseAND(F.col("twice")) == F.col("mask"), F.lit(False))).drop("word", "mask", "twice")


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """exact_groups, and the filter with its number of words."""
    digests = stored(docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("sha")))
    words = max(1, digests.count() * BITS_PER_ROW // 64)
    filtered = stored(repeated_bits(digests, words))
    asked = _asked(digests, filtered, words)
    # Written first, so that a hash that a third of the rows share is one long run of the left side, which Spark splits.
    groups = stored(asked.filter("maybe").groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    columns = ["doc_id", "keep_id", "group_size", "sha"]
    together = asked.filter("maybe").join(groups.hint("merge"), "sha").select(columns)
    alone = asked.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    out = together.unionByName(alone)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")), filtered, words


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return _groups(docs)[0]


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id stays. Of rows that repeat a doc_id with the same text, all stay."""
    groups, filtered, words = _groups(docs)
    gone = stored(groups.filter("not kept and doc_id is not null").select(F.col("doc_id").alias("gone"), F.unhex("text_sha256").alias("gone_sha")).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("sha"))
    asked = _asked(rows, filtered, words)
    few = gone.count() <= FEW_GONE
    some = asked.filter("maybe").join(gone.hint("broadcast" if few else "shuffle_hash"), (F.col("row.doc_id") == F.col("gone")) & (F.col("sha") == F.col("gone_sha")), "left_anti")
    return some.select("row.*").unionByName(asked.filter("not maybe").select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH hashed AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
grouped AS (SELECT doc_id, text_sha256, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM hashed)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
"""
