"""Fill-in-middle transformation by displacement scatter.

A text is cut into units, a run of ASCII letters or any other single code point,
at two places drawn from a hash of the document's id: what stands before the
first cut is the prefix, between them the middle, behind them the suffix. The
output is the whole text (plain) or, with a sentinel before each part,

    psm  <P>prefix<S>suffix<M>middle
    spm  <S>suffix<P>prefix<M>middle

A batch is one array of bytes. A scan finds all units' starts and with them the
cuts; every part's shift is added to a difference array where the part begins
and taken off where it ends, so the running sum gives each byte its displacement
and one scatter writes all outputs. Restoring scans outputs for the sentinels,
builds the opposite difference array and gathers; it sees nothing but the output
and its form. A text that holds a sentinel stays plain, so the first sentinel of
each kind in a rearranged output is the one written.

A null or empty text has no units and an empty plain output. A null doc_id
hashes as the empty string. Rows that repeat a doc_id are transformed alike, row
by row. Other columns are ignored; an empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from coterie.llm.common import bytes_of, pieces, read

# The sentinels and the form shares in percent.
SENTINELS = (b"<P>", b"<S>", b"<M>")
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = 1
ORDER = {"psm": (0, 2, 1), "spm": (2, 0, 1)}  # the parts prefix 0, middle 1, suffix 2 as they are written
_MARK = {0: SENTINELS[0], 1: SENTINELS[2], 2: SENTINELS[1]}  # before each part

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def _of_rows(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row of each byte offset."""
    return np.searchsorted(starts, at, side="right") - 1


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of ``values`` (ascending offsets) stand before each of ``starts``."""
    return np.searchsorted(values, starts, side="left")


def units(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The offset of every unit's first byte, row after row."""
    letter = _LETTER[raw]
    begins = ~letter & ((raw & 0xC0) != 0x80)
    begins |= letter
    begins[1:] &= ~(letter[1:] & letter[:-1])
    first = starts[:-1][np.diff(starts) > 0]
    begins[first] = True
    return np.flatnonzero(begins)


def sentinels(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, row, which) of every sentinel that stands inside one row."""
    at = np.flatnonzero((raw[:-2] == SENTINELS[0][0]) & (raw[2:] == SENTINELS[0][2])) if len(raw) > 2 else np.zeros(0, np.int64)
    kind = np.full(len(at), -1)
    for k, mark in enumerate(SENTINELS):
        kind[raw[at + 1] == mark[1]] = k
    row = _of_rows(starts, at)
    inside = (kind >= 0) & (at + 3 <= starts[row + 1])
    return at[inside], row[inside], kind[inside]


def _moved(size: int, begins: list[np.ndarray], ends: list[np.ndarray], shifts: list[np.ndarray]) -> np.ndarray:
    """Where each byte goes, -1 for bytes of no part: the running sum of what begins and ends at each offset."""
    shift, live = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    for begin, end, by in zip(begins, ends, shifts, strict=True):
        full = end > begin
        np.add.at(shift, begin[full], by[full])
        np.add.at(shift, end[full], -by[full])
        np.add.at(live, begin[full], 1)
        np.add.at(live, end[full], -1)
    return np.where(np.cumsum(live)[:-1] > 0, np.arange(size) + np.cumsum(shift)[:-1], -1)


def scatter(raw: np.ndarray, starts: np.ndarray, cut1: np.ndarray, cut2: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All outputs as one byte array and where each begins, from the cuts' byte offsets and each row's form."""
    length = np.diff(starts) + np.where(form == "plain", 0, sum(map(len, SENTINELS)))
    out_starts = np.r_[0, np.cumsum(length)]
    part = [(starts[:-1], cut1), (cut1, cut2), (cut2, starts[1:])]
    out = np.zeros(out_starts[-1], np.uint8)
    begins, ends, shifts = [starts[:-1][form == "plain"]], [starts[1:][form == "plain"]], [(out_starts[:-1] - starts[:-1])[form == "plain"]]
    for name, order in ORDER.items():
        chosen = np.flatnonzero(form == name)
        at = out_starts[:-1][chosen]
        for p in order:
            mark = np.frombuffer(_MARK[p], np.uint8)
            out[at[:, None] + np.arange(len(mark))] = mark
            begin, end = part[p][0][chosen], part[p][1][chosen]
            at = at + len(mark)
            begins.append(begin)
            ends.append(end)
            shifts.append(at - begin)
            at = at + end - begin
    to = _moved(len(raw), begins, ends, shifts)
    out[to] = raw
    return out, out_starts


def gather(out: np.ndarray, starts: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of outputs: each output's sentinels give its parts, whose bytes are gathered in the order of the text."""
    at, row, kind = sentinels(out, starts)
    place = np.full((3, len(starts) - 1), -1, np.int64)
    for k in range(3):
        mine = kind == k
        first_row, first = np.unique(row[mine], return_index=True)
        place[k][first_row] = at[mine][first]
    p, s, m = place
    length = np.diff(starts) - np.where(form == "plain", 0, sum(map(len, SENTINELS)))
    text_starts = np.r_[0, np.cumsum(length)]
    begins, ends, shifts = [starts[:-1][form == "plain"]], [starts[1:][form == "plain"]], [(text_starts[:-1] - starts[:-1])[form == "plain"]]
    for name in ORDER:
        chosen = np.flatnonzero(form == name)
        stop = starts[1:][chosen]
        prefix = (p[chosen] + 3, s[chosen] if name == "psm" else m[chosen])
        suffix = (s[chosen] + 3, m[chosen] if name == "psm" else p[chosen])
        to = text_starts[:-1][chosen]
        for begin, end in (prefix, (m[chosen] + 3, stop), suffix):
            begins.append(begin)
            ends.append(end)
            shifts.append(to - begin)
            to = to + end - begin
    to = _moved(len(out), begins, ends, shifts)
    inverse = np.zeros(text_starts[-1], np.int64)
    inverse[to[to >= 0]] = np.flatnonzero(to >= 0)
    return out[inverse], text_starts


def _strings(raw: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())).cast(pa.string())


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in (p for b in batches for p in pieces(b)):
        raw, starts = bytes_of(piece.column("text"))
        h1, h2, h3, h4 = (piece.column(f"h{k}").to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
        begin = units(raw, starts)
        first = _sums(begin, starts)
        n = np.diff(first)
        low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
        begin = np.r_[begin, len(raw)]
        cut1, cut2 = (np.where(k < n, begin[first[:-1] + k], starts[1:]) for k in (low, high))
        form = np.where(h4 % 100 < SPM_BELOW, "spm", "psm").astype("U5")
        form[(n == 0) | (h3 % 100 >= PLAIN_FROM)] = "plain"
        form[sentinels(raw, starts)[1]] = "plain"
        out, out_starts = scatter(raw, starts, cut1, cut2, form)
        points = np.flatnonzero((raw & 0xC0) != 0x80)
        chars = [_sums(points, b) - _sums(points, a) for a, b in ((starts[:-1], cut1), (cut1, cut2))]
        plain = form == "plain"
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(form.tolist(), pa.string()), *(pa.array(c.astype(np.int64), mask=plain) for c in chars), _strings(out, out_starts)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in (p for b in batches for p in pieces(b)):
        out, starts = bytes_of(piece.column("text"))
        text = _strings(*gather(out, starts, np.array(piece.column("form").to_pylist(), dtype="U5")))
        yield pa.RecordBatch.from_arrays([*piece.columns, text], [*piece.schema.names, "restored"])


def drawn(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four 32-bit draws of a document, h1 to h4."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *drawn(F.col("doc_id"), seed))
    return rows.mapInArrow(_transformed, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame) -> DataFrame:
    """outputs with ``restored``, each row's text, read from its output and form alone."""
    rows = outputs.withColumnRenamed("output", "text")
    schema = StructType([*rows.schema.fields, StructField("restored", StringType())])
    return rows.mapInArrow(_restored, schema).withColumnRenamed("text", "output")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    rows = restore(fill_in_middle(read(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


ORACLE = rf"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM cut),
parts AS (SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix, array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle, array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts
"""
