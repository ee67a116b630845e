"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers with their signs and units, units after numbers,
and names (capitalised words of two letters or more) turn into typed
placeholders, all other words into their lower-case form without punctuation at
the ends. Windows of ``WINDOW`` template words are hash-joined with the
benchmark's, so a question asked again with other numbers or names still meets.
Hits of an item at nearly one place of a document are an occurrence. In it a
window counts only if its slots are consistent: one benchmark value always
stands for one value of the document and the other way round. A document is
contaminated by an item if consistent windows of one occurrence cover ``COVER``
of the item's windows.

Items shorter than a window are one window of their own length. Windows with
fewer than ``LITERALS`` literal words say too little with their slots open (all
must be literal in shorter ones); an item that has no other is compared by the
words themselves. Documents are scanned once against a bitmap of the benchmark's
window hashes, which tasks fill and whose size is bounded; only hits leave the
scan. Null and empty texts match nothing, nor do null or empty items, and items
that repeat an item_id count as one item of several texts. Rows that repeat a
doc_id are found each by its own text. Extra columns are ignored by
``contaminated`` and returned by ``drop_contaminated``.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coterie.llm.common import bytes_of, fold, hash_words, mix, pieces, read, stored, text_key, without, word_bounds

WINDOW, LITERALS, COVER = 8, 4, 0.5
BITMAP = 1 << 27  # bits at most, 16 megabytes
NEAR = 8  # words that hits of one occurrence may shift by, as slots of several words do
WINDOWS_TO_BROADCAST = 500_000
# Units that become a placeholder after a number.
UNITS = ["mm", "cm", "m", "km", "in", "ft", "mi", "g", "kg", "mg", "lb", "oz", "t", "s", "ms", "min", "h", "hr", "ml", "l", "km/h", "mph", "m/s", "%", "€", "$", "£", "usd", "eur", "dollars", "euros", "cents", "percent", "meters", "metres", "miles", "hours", "minutes", "seconds", "days", "kilograms", "grams", "liters", "litres"]
# Signs before a number.
SIGNS = ["$", "€", "£"]

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), ord("%"), ord("$")]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[ord(c) for c in ".,:/-+"]] = True
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x11, 0x12, 0x13))


def _hashes(names: list[str]) -> np.ndarray:
    words = [u.encode() for u in names]
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.sort(hash_words(raw, ends - [len(w) for w in words], ends))


def _numbers(raw: np.ndarray, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each word is a number, with a sign before or a unit after it."""
    digits, numeric = np.r_[0, np.cumsum(_DIGIT[raw])], np.r_[0, np.cumsum(_NUMERIC[raw])]
    out = digits[end] > digits[begin]
    some = np.flatnonzero(out)
    places = np.flatnonzero(_DIGIT[raw])
    first, last = places[digits[begin[some]]], places[digits[end[some]] - 1]
    sign = (first == begin[some]) | np.isin(hash_words(low, begin[some], first), _hashes(SIGNS)) | (numeric[first] - numeric[begin[some]] == first - begin[some])
    unit = (last + 1 == end[some]) | np.isin(hash_words(low, last + 1, end[some]), _hashes(UNITS)) | (numeric[end[some]] - numeric[last + 1] == end[some] - last - 1)
    out[some] = sign & unit & (numeric[last + 1] - numeric[first] == last + 1 - first)
    return out


def _capital(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each word is a capital letter and a small one after it, Latin, Greek or Cyrillic."""
    at = lambda i: raw[np.minimum(begin + i, len(raw) - 1)].astype(np.int64)
    one, two, three = at(0), at(1), at(2)
    ascii_ = (one >= 65) & (one <= 90) & (end - begin > 1) & (two >= 97)
    two_bytes = ((one == 0xC3) & (two >= 0x80) & (two <= 0x9E)) | ((one == 0xCE) & (two >= 0x91) & (two <= 0xA9)) | ((one == 0xD0) & (two >= 0x80) & (two <= 0xAF))
    return ascii_ | (two_bytes & (end - begin > 2) & (three >= 97))


def template(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Template words: (hash, hash of the word itself, is slot, begin, end, row)."""
    begin, end, row = word_bounds(raw, starts)
    while len(begin):  # punctuation off both ends, a byte at a time
        loose = (begin < end) & ~_ALNUM[raw[np.minimum(begin, len(raw) - 1)]]
        if not loose.any():
            break
        begin = begin + loose
    while len(begin):
        loose = (begin < end) & ~_ALNUM[raw[end - 1]]
        if not loose.any():
            break
        end = end - loose
    some = begin < end
    begin, end, row = begin[some], end[some], row[some]
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), some[:0], begin, end, row
    low = fold(raw)
    h = hash_words(low, begin, end)
    number = _numbers(raw, low, begin, end)
    unit = np.r_[False, (row[1:] == row[:-1]) & number[:-1]] & np.isin(h, _hashes(UNITS))
    name = _capital(raw, begin, end) & ~number
    return np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, h))), h, number | unit | name, begin, end, row


def windows(h: np.ndarray, word: np.ndarray, slot: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and openness of each window of ``length`` template words inside one row; those with few literals are hashed by their words."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    step, out, literal = np.uint64(0x9FB21C651E98DF25), np.zeros((2, n), np.uint64), np.zeros(n, np.int64)
    for k in range(length):
        out = out * step + np.stack([h[k : k + n], word[k : k + n]])
        literal += ~slot[k : k + n]
    at = np.flatnonzero(row[:n] == row[length - 1 :])
    rich = literal[at] >= min(LITERALS, length)
    return at, np.where(rich, mix(out[0, at] + np.uint64(length)), mix(out[1, at] + np.uint64(length + (1 << 32)))), rich


def _slots(raw: np.ndarray, slot: np.ndarray, begin: np.ndarray, end: np.ndarray, at: int, length: int) -> list[str]:
    return [raw[begin[i] : end[i]].tobytes().decode("utf8", "replace").lower() for i in range(at, at + length) if slot[i]]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, item_id, place, length, of, item_slots): each item's windows; ``of`` counts them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for k in range(batch.num_rows):
                raw, starts = bytes_of(batch.column("text").slice(k, 1))
                h, word, slot, begin, end, row = template(raw, starts)
                length = min(window, len(h))
                if length:
                    at, hashes, rich = windows(h, word, slot, row, length)
                    if rich.any():
                        at, hashes = at[rich], hashes[rich]
                    for p, x in zip(at, hashes.view(np.int64), strict=True):
                        for c, v in zip(out, (int(x), batch.column("item_id")[k].as_py(), int(p), length, len(at), _slots(raw, slot, begin, end, p, length)), strict=True):
                            c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["h", "item_id", "place", "length", "of", "item_slots"])

    return benchmark.select("item_id", "text").mapInArrow(cut, "h bigint, item_id bigint, place bigint, length bigint, of bigint, item_slots array<string>")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """(doc_id, text_key, item_id, covered) for each document and item whose consistent windows cover ``cover`` of the item."""
    items = stored(benchmark_windows(benchmark, window))
    size = 1 << int(min(BITMAP, max(1 << 16, 16 * items.count()))).bit_length() - 1
    bit = F.pmod("h", F.lit(size))
    words = items.groupBy(F.floor(bit / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))).alias("bits")).toPandas()
    bitmap = np.zeros(size // 64, np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    bitmap = bitmap.astype("<i8").view(np.uint8)
    lengths = {r[0] for r in items.select("length").distinct().collect()}  # at most ``window`` numbers
    shared = docs.sparkSession.sparkContext.broadcast((bitmap, sorted(lengths)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes = shared.value
        for batch in batches:
            for piece in pieces(batch):
                raw, starts = bytes_of(piece.column("text"))
                h, word, slot, begin, end, row = template(raw, starts)
                first = np.searchsorted(row, np.arange(piece.num_rows))
                rows, hashes, places, slots = [], [], [], []
                for length in sizes:
                    at, x, _ = windows(h, word, slot, row, length)
                    bit = (x % np.uint64(size)).astype(np.int64)
                    hit = np.flatnonzero(bits[bit >> 3] >> (bit & 7) & 1)
                    rows.append(row[at[hit]])
                    hashes.append(x[hit])
                    places.append(at[hit] - first[row[at[hit]]])
                    slots += [_slots(raw, slot, begin, end, p, length) for p in at[hit]]
                of = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                found = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
                where = np.concatenate(places) if places else of
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(of)), piece.column("text_key").take(pa.array(of)), pa.array(found.view(np.int64)), pa.array(where, pa.int64()), pa.array(slots, pa.list_(pa.string()))], names=["doc_id", "text_key", "h", "at", "doc_slots"])

    hits = docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(scan, "doc_id bigint, text_key bigint, h bigint, at bigint, doc_slots array<string>")
    how = "broadcast" if items.count() <= WINDOWS_TO_BROADCAST else "merge"
    met = hits.join(items.hint(how), "h").select("doc_id", "text_key", "item_id", "place", "of", "item_slots", "doc_slots", (F.col("at") - F.col("place")).alias("shift"))
    # Hits whose places differ by nearly the same number of words are one occurrence. A group here is of one text.
    along = Window.partitionBy("doc_id", "text_key", "item_id").orderBy("shift")
    apart = (F.col("shift") - F.lag("shift").over(along) > NEAR).cast("int")
    met = met.withColumn("apart", F.coalesce(apart, F.lit(0))).withColumn("occurrence", F.sum("apart").over(along)).drop("apart", "shift")
    met = stored(met)
    who = ["doc_id", "text_key", "item_id", "occurrence"]
    # The usual partner of each slot value, in both directions; windows that say otherwise are inconsistent.
    pairs = met.filter(F.size("item_slots") > 0).select(*who, "place", F.posexplode(F.arrays_zip("item_slots", "doc_slots")).alias("k", "s")).select(*who, "place", F.col("s.item_slots").alias("x"), F.col("s.doc_slots").alias("y"))
    votes = stored(pairs.groupBy(*who, "x", "y").agg(F.count(F.lit(1)).alias("n")))
    chosen = votes.groupBy(*who, "x").agg(F.max_by("y", F.struct("n", "y")).alias("y")).groupBy(*who, "y").agg(F.min("x").alias("x"))
    table = chosen.groupBy(*who).agg(F.map_from_entries(F.collect_list(F.struct("x", "y"))).alias("partner"))
    named = [F.col(c).alias(f"_{c}") for c in who]
    both = met.join(table.select(*named, "partner").hint("merge"), met["doc_id"].eqNullSafe(F.col("_doc_id")) & (met["text_key"] == F.col("_text_key")) & met["item_id"].eqNullSafe(F.col("_item_id")) & (met["occurrence"] == F.col("_occurrence")), "left")
    same = F.forall(F.arrays_zip("item_slots", "doc_slots"), lambda s: F.coalesce(F.element_at(F.col("partner"), s["item_slots"]) == s["doc_slots"], F.lit(False)))
    covered = both.filter((F.size("item_slots") == 0) | same).groupBy(*who).agg((F.countDistinct("place") / F.max("of")).alias("covered"))
    return covered.filter(F.col("covered") >= cover).groupBy("doc_id", "text_key", "item_id").agg(F.max("covered").alias("covered"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that no item contaminates."""
    return without(docs, contaminated(docs, benchmark))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "covered")
