"""Line deduplication with levelled sorted runs of line hashes.

A corpus arrives in batches. Each batch's line keys are merge-anti-joined with
the keys that the runs already hold often enough, and what is left becomes a
sorted run of (key hash, documents) of its own. When a level has ``FAN_IN`` runs
they are compacted into one run of the next level, so that n batches leave
about log n runs. At the end, keys found in ``min_docs`` documents lose all
their lines everywhere.

Null and empty texts are one empty line. A key with fewer than ``min_chars``
code points is never dropped. Rows that repeat a doc_id, or have none, count as
documents of their own and are cut by their own text. Extra columns are ignored
by ``cut_lines`` and returned by ``drop_common_lines``.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.llm.common import BLANKS, read, stored, text_key

FAN_IN = 2
BATCHES = 4
MIN_DOCS, MIN_CHARS = 10, 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(text: Column, min_chars: int) -> Column:
    """For each line two hashes of its key, together 128 bits; null where the key is too short to count."""

    def hashed(line: Column) -> Column:
        key = F.btrim(line, F.lit(BLANKS))
        return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit("line"), key).alias("g")))

    return F.transform(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "\n"), hashed)


class LineRuns:
    """Sorted runs of (h, g, docs) in the shared folder, by level."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.levels: list[list[DataFrame]] = []

    def _sorted_run(self, counts: DataFrame) -> DataFrame:
        return stored(counts.sortWithinPartitions("h", "g"))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("h", "g").agg(F.sum("docs").alias("docs"))

    def common(self) -> DataFrame | None:
        """Keys that the runs hold from min_docs documents."""
        runs = [r for level in self.levels for r in level]
        return self._merged(runs).filter(F.col("docs") >= self.min_docs).select("h", "g") if runs else None

    def absorb(self, counts: DataFrame) -> None:
        """Adds a batch's (h, g, docs). Keys already common need no more counting and are left out."""
        if (common := self.common()) is not None:
            counts = counts.join(common.hint("merge"), ["h", "g"], "left_anti")
        self._put(0, self._sorted_run(counts))

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FAN_IN:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._sorted_run(self._merged(full)))


def common_line_positions(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """(doc_id, text_key, positions) of the lines to drop, for documents that have any; one row per doc_id and text."""
    keys = stored(docs.select("doc_id", text_key().alias("text_key"), line_keys(F.col("text"), min_chars).alias("keys"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch")), "batch")
    runs = LineRuns(min_docs)
    for batch in range(batches):
        own = keys.filter(F.col("batch") == batch).select(F.explode(F.array_distinct("keys")).alias("k")).filter("k is not null")
        runs.absorb(own.groupBy("k.h", "k.g").agg(F.count(F.lit(1)).alias("docs")))
    found = keys.select("doc_id", "text_key", F.posexplode("keys").alias("at", "k")).filter("k is not null").select("doc_id", "text_key", "at", "k.h", "k.g")
    # A key that a third of the documents share is one long run of the left side, which a skewed semi join splits.
    hit = found.join(stored(runs.common()).hint("merge"), ["h", "g"], "left_semi")
    return hit.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("positions"))


def _with_positions(docs: DataFrame, positions: DataFrame) -> DataFrame:
    p = stored(positions.select(F.col("doc_id").alias("_p_doc"), F.col("text_key").alias("_p_text"), F.col("positions").alias("_p_at")))
    here = docs.withColumn("_p_key", text_key())
    return here.join(p.hint("shuffle_hash"), here["doc_id"].eqNullSafe(p["_p_doc"]) & (here["_p_key"] == p["_p_text"]), "left")


def _kept(text: str = "text") -> Column:
    all_lines = lines(F.col(text))
    places = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.coalesce(F.col("_p_at"), F.array().cast("array<int>")))
    return F.array_join(F.transform(places, lambda i: F.get(F.col("_p_lines"), i)), "\n")


def cut_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, text (what is left)."""
    joined = _with_positions(docs.select("doc_id", "text"), common_line_positions(docs, min_docs, min_chars))
    joined = joined.withColumn("_p_lines", lines(F.col("text")))
    return joined.select("doc_id", F.size("_p_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_p_at"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("_p_at").isNull(), F.coalesce("text", F.lit(""))).otherwise(_kept()).alias("text"))


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with all columns and the common lines gone from text."""
    here = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    joined = _with_positions(here, common_line_positions(docs, min_docs, min_chars)).withColumn("_p_lines", lines(F.col("text")))
    text = F.when(F.col("_p_at").isNull(), F.col("text")).otherwise(_kept())
    return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_lines(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
numbered AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM numbered),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
marked AS (SELECT keyed.*, common.k IS NOT NULL AS gone FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""
