"""Mixing sources to target weights by systematic sampling.

Every source gets a target of words: its share of all words by weight, at most
``max_repeat`` times its own words, the excess reshared by weight among the rest.
A document then expects target / source words copies. Within its source,
documents stand in the order of their size; the prefix sum of expected copies,
moved by one random offset per source, crosses an integer boundary once for
every copy that the mix takes. Neighbours in that order are of nearly one size,
so the words taken stay within about one document of the target.

Prefix sums are made of three counts, none of which gathers a source in one
task: documents by size within the source, by bucket within the size, and one
by one within the bucket. Sources without name are one source, ordered last.
A null text has no words; documents without words have no share and are taken
as often as any other of their source, which adds nothing. A source without
words has target 0. Rows that repeat a doc_id are documents of their own; which of
them a copy repeats is open only among rows of equal id, text and source.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coterie.functions.order import global_row_number
from coterie.llm.common import WORD, read, stored, text_key

BUCKETS = 1024
MAX_REPEAT = 3
SEED = 17
UNIT = 10_000_000  # expected copies and offsets are whole multiples of 1 / UNIT, so that reruns agree exactly


def source_key(source: Column) -> Column:
    """A name for every source: null sorts last, all others by code point."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(totals: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds target to (source_key, source_size); weights 1, 2, 3 repeat in the order of the sources.

    ``level`` is the words a unit of weight gets. It rises as sources reach their
    limit and leave their excess to the rest, until no further source is above.
    """
    ranked = stored(global_row_number(totals, [F.col("source_key")], "rank").withColumn("weight", (F.col("rank") - 1) % 3 + 1))
    limit = F.col("source_size") * max_repeat
    words = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = 0.0, -1
    while True:
        at_limit = limit <= F.col("weight") * level if full >= 0 else F.lit(False)
        taken, weight, count = ranked.agg(F.coalesce(F.sum(F.when(at_limit, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~at_limit, F.col("weight"))), F.lit(0)), F.count_if(at_limit)).first()
        if count == full or not weight:
            break
        level, full = (words - taken) / weight, count
    return ranked.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(float(level)))).drop("rank")


def copies(docs: DataFrame, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, source_key, size, source_size, target, copies."""
    key = source_key(F.col("source"))
    bucket = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(BUCKETS)).cast("int")
    sizes = stored(docs.select("doc_id", text_key().alias("text_key"), key.alias("source_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), bucket.alias("bucket")))
    by_bucket = stored(sizes.groupBy("source_key", "size", "bucket").agg(F.count(F.lit(1)).alias("n")))
    by_size = by_bucket.groupBy("source_key", "size").agg(F.sum("n").alias("n"))
    totals = source_targets(by_size.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), max_repeat)
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    shorter = by_size.withColumn("shorter", F.coalesce(F.sum("n").over(earlier("source_key", "size")), F.lit(0))).drop("n")
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT + 0.5)).otherwise(F.lit(0))
    offset = F.floor(F.conv(F.substring(F.md5(F.concat("source_key", F.lit(f":{seed}"))), 1, 6), 16, 10).cast("long") * UNIT / 2**24)
    shorter = shorter.join(stored(totals).hint("shuffle_hash"), "source_key").withColumn("rate", rate.cast("long")).withColumn("offset", offset.cast("long"))
    before = by_bucket.withColumn("lower", F.coalesce(F.sum("n").over(earlier("source_key", "size", "bucket")), F.lit(0))).drop("n")
    before = stored(before.join(shorter.hint("merge"), ["source_key", "size"]))
    inside = F.row_number().over(Window.partitionBy("source_key", "size", "bucket").orderBy("doc_id"))
    placed = sizes.withColumn("inside", inside).join(before.hint("shuffle_hash"), ["source_key", "size", "bucket"])
    place = F.col("shorter") + F.col("lower") + F.col("inside")
    return placed.withColumn("place", place).selectExpr("doc_id", "text_key", "source_key", "size", "source_size", "target", f"(offset + rate * place) div {UNIT} - (offset + rate * (place - 1)) div {UNIT} as copies")


def mix(docs: DataFrame, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, all columns, once for every copy the mix takes; ``copy`` counts them from 1.

    If ``docs`` has a column of that name, it stays and the count's name gets an underscore more.
    """
    name = "copy"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    key = ["doc_id", "text_key", "source_key"]
    counted = stored(copies(docs, max_repeat, seed).groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies")).filter("copies > 0").select(*[F.col(c).alias(f"_m_{c}") for c in key], "rows", "copies"))
    here = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_doc"), text_key().alias("_text"), source_key(F.col("source")).alias("_source"))

    def joined(some: DataFrame) -> DataFrame:
        same = here["_doc"].eqNullSafe(some["_m_doc_id"]) & (here["_text"] == some["_m_text_key"]) & (here["_source"] == some["_m_source_key"])
        return here.join(some.hint("shuffle_hash"), same)

    out = joined(counted.filter("rows = 1")).select("row", F.col("copies").alias("times"))
    repeated = counted.filter("rows > 1")
    if not repeated.isEmpty():  # rows equal in id, text and source share their copies as evenly as whole numbers allow
        place = F.row_number().over(Window.partitionBy("_doc", "_text", "_source").orderBy("_text"))
        out = out.unionByName(joined(repeated).withColumn("place", place).selectExpr("row", "(copies * place) div rows - (copies * (place - 1)) div rows as times"))
    return _repeated(out, name)


def _repeated(rows: DataFrame, name: str) -> DataFrame:
    """Each row's columns as often as ``times`` says."""
    each = rows.filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy_of_row"))
    return each.select("row.*", F.col("copy_of_row").alias(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = copies(read(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = rf"""
WITH sized AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source_key,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ((coalesce(doc_id, 0) % {BUCKETS}) + {BUCKETS}) % {BUCKETS} AS bucket FROM documents),
totals AS (SELECT source_key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source_key),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source_key) - 1) % 3 + 1 AS weight FROM totals),
steps AS (SELECT *, {MAX_REPEAT} * source_size / weight AS bound,
        (sum(source_size) OVER () - coalesce(sum({MAX_REPEAT} * source_size) OVER below, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS level
    FROM weighed WINDOW below AS (ORDER BY {MAX_REPEAT} * source_size / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT level FROM steps WHERE level <= bound ORDER BY bound, source_key LIMIT 1),
targets AS (SELECT source_key, source_size, least(CAST({MAX_REPEAT} * source_size AS DOUBLE), weight * level) AS target FROM weighed, chosen),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * {UNIT} + 0.5) AS BIGINT) ELSE 0 END AS rate,
        CAST(floor(CAST('0x' || substr(md5(source_key || ':{SEED}'), 1, 6) AS BIGINT) * {UNIT} / 16777216) AS BIGINT) AS "offset" FROM targets),
placed AS (SELECT doc_id, source_key, size, row_number() OVER (PARTITION BY source_key ORDER BY size, bucket, doc_id NULLS FIRST) AS place FROM sized)
SELECT doc_id, size, source_size, round(target, 6) AS target,
    CAST((("offset" + rate * place) // {UNIT} - ("offset" + rate * (place - 1)) // {UNIT}) * size AS BIGINT) AS taken
FROM placed JOIN rated USING (source_key)
"""
