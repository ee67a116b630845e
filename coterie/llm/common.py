"""What the corpus operators share: reading, keys and text as flat byte arrays."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.functions.storage import stored

__all__ = ["BLANKS", "SPACES", "WORD", "bytes_of", "fold", "hash_words", "mix", "numbered_pieces", "pieces", "read", "stored", "text_key", "without", "word_bounds"]

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_key() -> Column:
    """Beside doc_id, tells apart rows that repeat a doc_id or have none."""
    return F.xxhash64(F.lit("text"), F.col("text"))


FEW_GONE = 500_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows that gone(doc_id, text_key) names, all columns; a null doc_id is a value like any other.

    The list is written and counted first: up to ``FEW_GONE`` it is broadcast and texts stay where they are, a longer one is joined by a shuffle.
    """
    listed = stored(gone.select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_text")).distinct())
    few = listed.count() <= FEW_GONE
    same = docs["doc_id"].eqNullSafe(listed["_gone"]) & (F.xxhash64(F.lit("text"), docs["text"]) == listed["_gone_text"])
    return docs.join(listed.hint("broadcast" if few else "shuffle_hash"), same, "left_anti")


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and where each row starts (one more than rows).

    A null row has no bytes. Nothing is copied unless the column is sliced or chunked.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def fold(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _FOLD[raw]


def word_bounds(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of non-blank bytes, and its row; runs end at row bounds."""
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = starts[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


def hash_words(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of bytes: equal slices have equal hashes, wherever they stand."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    length = end - begin
    total = np.zeros(len(begin), np.uint64)
    # Byte j of every slice that has one, longest slices first: as many steps as the longest slice has bytes.
    order = np.argsort(-length, kind="stable")
    at, left = begin[order], length[order]
    live = len(order) - np.searchsorted(left[::-1], np.arange(1, int(left[0]) + 1), side="left")
    summed = np.zeros(len(order), np.uint64)
    for j, n in enumerate(live):
        summed[:n] = summed[:n] * _ODD + _RANDOM[raw[at[:n] + j]]
    total[order] = summed
    return mix(total + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pieces(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, one row at least, so that arrays stay small."""
    if not batch.num_rows:
        return
    part = np.cumsum(np.diff(bytes_of(batch.column("text"))[1])) // most
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def numbered_pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces of a task, each with a number from its place and content: a task that reads other rows gives other numbers."""
    task, k = TaskContext.get().partitionId(), 0
    for piece in (p for b in batches for p in pieces(b, most)):
        raw, starts = bytes_of(piece.column("text"))
        content = hashlib.blake2b(f"{task} {k}".encode(), digest_size=8)
        content.update(raw.tobytes())
        content.update(starts.tobytes())
        yield int.from_bytes(content.digest(), "little", signed=True), piece
        k += 1
