"""Removal of repeated passages by merging shard Burrows-Wheeler transforms.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a
document of smaller doc_id. Every window of that length is represented by its
smallest hashed ``GRAM``-byte gram, so equal windows have equal grams, whichever
documents they come from; a segment is a run of windows with one gram.

Texts are read in pieces of about ``PIECE`` bytes, in two turns. First each
piece sends the hashes of its grams to parts, dealt by gram, and learns which
occur elsewhere too. Then it sends the segments of those grams, equal ones once
with their smallest doc_id, and learns which of their windows start in a smaller
document. Short forms of hashes only let through segments that need not be.

A part holds the segments of all pieces; those of some pieces are a shard, whose
transform is built from its own suffixes. Windows whose hash occurs in one
document only are left out, and equal runs of the rest are held once.
The shards' transforms are then merged by iterative interleave refinement: the
interleave sorted by h symbols (pairs of bytes) follows from the one sorted by
h - 1 by a stable pass over the transforms' symbols, and the blocks of suffixes
with a common prefix of h split where symbols or the blocks before them differ. No suffix is
sorted again. After DEPTH passes each block is a repeated interval, whose
smallest document decides for every window in it.

The input is read once a turn; rows that come back in other pieces than before
stop the job with an error, so store a shuffled input first. Null and empty
texts have no bytes. A row without doc_id comes after all others
and gives none of them a reason to lose bytes. Rows that repeat a doc_id are one
document for this purpose and lose nothing to each other. Extra columns are
ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.llm.common import bytes_of, mix, numbered_pieces, read, stored

LENGTH, GRAM = 50, 16
DEPTH = LENGTH // 2  # of pairs of bytes, the symbols of the transforms
PIECE = 4 << 20
PART_BYTES = 4 << 20  # of text for each part
CHUNK = 1 << 15  # windows hashed at a time, to stay in the processor's cache
LAST = np.iinfo(np.int64).max
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(50).integers(0, 2**63, 256, dtype=np.uint64)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place, by doubling."""
    h, size = _TABLE[raw], 1
    while size < GRAM:
        h = mix(h[:-size] * (_ODD + np.uint64(2 * size)) + h[size:])
        size *= 2
    return h


def segments(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, row, first window, windows) of each run of windows that one gram represents."""
    if len(raw) < LENGTH:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    n = len(raw) - LENGTH + 1
    low = np.concatenate([_lowest(raw[a : a + CHUNK + LENGTH - 1]) for a in range(0, n, CHUNK)])
    fine = np.ones(len(raw), bool)  # windows that end in the row they start in; between two rows there always is another
    tail = np.minimum(np.diff(starts), LENGTH - 1)
    fine[_ranges(starts[1:] - tail, tail)] = False
    fine = fine[:n]
    turn = low[1:] != low[:-1]
    first = np.flatnonzero(fine & np.r_[True, turn | ~fine[:-1]])
    last = np.flatnonzero(fine & np.r_[turn | ~fine[1:], True])
    return low[first], np.searchsorted(starts, first, side="right") - 1, first, last - first + 1


def _lowest(raw: np.ndarray) -> np.ndarray:
    """The smallest gram hash of each window."""
    low, size, wide = gram_hashes(raw), 1, LENGTH - GRAM + 1
    n = len(raw) - LENGTH + 1
    while size * 2 <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[:n], low[wide - size : wide - size + n])


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for each range, flat."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def _planed(x: np.ndarray) -> bytes:
    """Non-negative numbers as their count, width and byte planes, which compresses small ones well."""
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    rows = np.ascontiguousarray(x.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)[:, :width]
    return len(x).to_bytes(8, "little") + bytes([width]) + rows.T.tobytes()


def _blob(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(map(_planed, arrays)))


def _unblob(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n, width = int.from_bytes(raw[at : at + 8], "little"), raw[at + 8]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 9).reshape(width, n).T
        out.append(wide.view("<u8").ravel())
        at += 9 + n * width
    return out


class Segments:
    """The segments of a piece of texts by part, and the piece's distinct grams, sorted by part and short hash."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, doc: np.ndarray, parts: int):
        gram, row, at, windows = segments(raw, starts)
        spread = mix(gram)
        part = ((spread >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        key = part.astype(np.uint64) << np.uint64(32) | (spread & np.uint64(0xFFFFFFFF))
        keys, self.gram = np.unique(key, return_inverse=True)
        self.part, self.short = (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF)
        self.cuts = np.searchsorted(self.part, self.part[np.r_[True, self.part[1:] != self.part[:-1]]]) if len(keys) else np.zeros(0, np.int64)
        self.raw, self.starts, self.row, self.at, self.windows = raw, starts, row, at, windows
        self.doc = doc[row]
        low, high = np.full(len(keys), LAST), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.gram, self.doc)
        np.maximum.at(high, self.gram, self.doc)
        self.several = low != high

    def grams(self) -> Iterator[tuple[int, bytes]]:
        """(part, data): the short hashes of the piece's grams and whether several of its documents have them."""
        for a, b in zip(self.cuts, np.r_[self.cuts[1:], len(self.part)], strict=True):
            yield int(self.part[a]), _blob(np.diff(self.short[a:b], prepend=np.uint64(0)), np.packbits(self.several[a:b]))

    def keep(self, answers: dict[int, bytes]) -> None:
        """Leaves the segments whose gram the parts have seen elsewhere, equal ones as one, in the order of their parts."""
        again = np.zeros(len(self.part), bool)
        for a, b in zip(self.cuts, np.r_[self.cuts[1:], len(self.part)], strict=True):
            again[a:b] = np.unpackbits(_unblob(answers[int(self.part[a])])[0].astype(np.uint8), count=b - a)
        live = np.flatnonzero(again[self.gram])
        live = live[np.argsort(self.part[self.gram[live]], kind="stable")]
        self.row, self.at, self.windows, self.doc, of_part = self.row[live], self.at[live], self.windows[live], self.doc[live], self.part[self.gram[live]]
        number: dict[bytes, int] = {}
        whole = self.raw.tobytes()
        self.of = np.array([number.setdefault(whole[a : a + n], len(number)) for a, n in zip(self.at.tolist(), (self.windows + LENGTH - 1).tolist(), strict=True)], np.int64)
        self.text = list(number)  # equal segments have one gram, so a part's are together
        self.owner = np.full(len(number), LAST)
        np.minimum.at(self.owner, self.of, self.doc)
        self.text_part = np.zeros(len(number), np.int64)
        self.text_part[self.of] = of_part

    def texts(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(part, facts, content) of the segments left."""
        packer = zstandard.ZstdCompressor(level=3)
        edges = np.flatnonzero(np.r_[True, self.text_part[1:] != self.text_part[:-1]]) if len(self.text) else np.zeros(0, np.int64)
        for a, b in zip(edges, np.r_[edges[1:], len(self.text)], strict=True):
            size = np.array([len(t) for t in self.text[a:b]])
            yield int(self.text_part[a]), _blob(self.owner[a:b].view(np.uint64), size), packer.compress(b"".join(self.text[a:b]))

    def removed(self, answers: dict[int, bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each row of the piece the begins and ends of the byte ranges to remove, merged, in order."""
        offset = {int(p): int(a) for p, a in zip(*np.unique(self.text_part, return_index=True), strict=True)}
        found = [(x[0].astype(np.int64) + offset[part], *(y.astype(np.int64) for y in x[1:])) for part, x in ((p, _unblob(d)) for p, d in answers.items())]
        text, first, n = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
        order = np.argsort(text, kind="stable")
        text, first, n = text[order], first[order], n[order]
        # A place in the segment's smallest document loses what the parts say; in another, all of it.
        later = np.flatnonzero(self.doc > self.owner[self.of])
        same = np.flatnonzero(self.doc == self.owner[self.of])
        a, b = np.searchsorted(text, self.of[same], "left"), np.searchsorted(text, self.of[same], "right")
        run = _ranges(a, b - a)
        place = np.repeat(same, b - a)
        begin = np.r_[self.at[later], self.at[place] + first[run]]
        end = np.r_[self.at[later] + self.windows[later], self.at[place] + first[run] + n[run]] + LENGTH - 1
        row = np.r_[self.row[later], self.row[place]]
        order = np.argsort(begin, kind="stable")
        begin, end, row = begin[order], np.maximum.accumulate(end[order]) if len(order) else end, row[order]
        new = np.flatnonzero(np.r_[True, (begin[1:] > end[:-1]) | (row[1:] != row[:-1])]) if len(begin) else np.zeros(0, np.int64)
        last = np.r_[new[1:], len(begin)] - 1 if len(new) else new
        begin, end, row = begin[new], end[last], row[new]
        cuts = np.searchsorted(row, np.arange(len(self.starts)))
        return [(begin[x:y] - s, end[x:y] - s) for x, y, s in zip(cuts[:-1], cuts[1:], self.starts[:-1], strict=True)]


def _seen_elsewhere(table: pa.Table) -> pa.Table:
    """Answers each piece which of its grams of a part several documents have."""
    sent = [_unblob(x) for x in table.column("data").to_pylist()]
    short = [np.cumsum(x[0], dtype=np.uint64).astype(np.uint32) for x in sent]
    several = np.concatenate([np.unpackbits(x[1].astype(np.uint8), count=len(s)) for x, s in zip(sent, short, strict=True)]).astype(bool)
    _, of, n = np.unique(np.concatenate(short), return_inverse=True, return_counts=True)
    again = n > 1
    again[of[several]] = True
    cuts = np.cumsum([len(s) for s in short])[:-1]
    out = [_blob(np.packbits(x)) for x in np.split(again[of], cuts)]
    return pa.table({"piece": table.column("piece"), "part": table.column("part"), "data": pa.array(out, pa.binary())})


def window_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the LENGTH bytes from each place: joined gram hashes, the last two overlapping."""
    h = gram_hashes(raw)
    h = mix(h[:-GRAM] * (_ODD + np.uint64(2 * GRAM)) + h[GRAM:])
    rest = LENGTH - 2 * GRAM
    return mix(h[:-rest] * (_ODD + np.uint64(4 * GRAM)) + h[rest:])


def paired(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of two bytes (1 to 65536), string and offset of each: every string once from its first byte and once
    from its second, each time closed by 0. The suffix at any offset thus is a suffix of pairs."""
    size = np.array([len(s) for s in strings])
    raw = np.frombuffer(b"".join([*strings, b"\0\0"]), np.uint8).astype(np.int64)
    pairs = np.stack([size // 2, (size - 1) // 2], axis=1).ravel()
    begin = np.cumsum(size) - size
    place = np.arange(len(pairs)) // 2
    last = np.cumsum(pairs + 1)
    j = np.arange(int(last[-1])) - np.repeat(last - pairs - 1, pairs + 1)
    string = np.repeat(place, pairs + 1)
    offset = 2 * j + np.repeat(np.arange(len(pairs)) % 2, pairs + 1)
    at = begin[string] + offset
    symbols = raw[at] * 256 + raw[at + 1] + 1
    symbols[last - 1] = 0
    return symbols, string, offset


def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and Burrows-Wheeler transform of a shard of closed strings of pairs.

    The order holds for DEPTH pairs or more, which is as deep as the merge looks; it counts the suffixes with a
    prefix, so that ties beyond are free. Prefix doubling starts from four pairs in one number.
    """
    n, h = len(text), 4
    text = text.astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(h):
        key = key << np.uint64(16)
        key[: max(0, n - k)] |= text[k:]
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
        if h >= DEPTH:
            return order, text[order - 1].astype(np.uint16)
        key = rank * (n + 1)
        key[: max(0, n - h)] += rank[h:] + 1
        h *= 2


def merge(shards: list[np.ndarray], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, rank in shard, block) of all suffixes, in the merged order of their first ``depth`` symbols.

    Suffixes of one block have those symbols in common; a terminator equals no other. A block is named by its first
    place. A suffix alone in its block keeps its place from then on, so later passes leave it out (Egidi and
    Manzini, 2017), and with it the suffix that led to it.
    """
    sizes = np.array([len(b) for b in shards])
    symbols, first = np.concatenate(shards), np.r_[0, np.cumsum(sizes)[:-1]]
    n = len(symbols)
    z, block = np.repeat(np.arange(len(shards), dtype=np.int8), sizes), np.zeros(n, np.int32)  # SHARDS fit in a byte
    place = np.arange(n, dtype=np.int32)  # of each merged suffix in the concatenated transforms: its shard's next rank
    near, goal, slots = place.copy(), place.copy(), place.copy()  # places that may be read, places written, ranks not yet final
    moving, wanted = np.ones(n, bool), np.ones(n, bool)  # places not final; suffixes, by rank, that lead to such a place
    for _ in range(depth):
        if not len(goal):
            break
        at = place[near]
        read_here = wanted[at]
        lead, at, near = near[read_here], at[read_here], near[read_here | moving[near]]
        c = symbols[at]
        order = np.argsort(c, kind="stable")
        c, source = c[order], lead[order]
        b, shard = block[source], z[source]
        new = np.r_[True, (c[1:] != c[:-1]) | (b[1:] != b[:-1]) | (c[1:] == 0) | (goal[1:] != goal[:-1] + 1)]
        head = np.flatnonzero(new)
        block[goal] = np.repeat(goal[head], np.diff(np.r_[head, len(goal)]))
        z[goal] = shard
        by_shard = np.argsort(shard, kind="stable")
        ranks = np.empty(len(goal), np.int32)
        ranks[by_shard] = slots  # the k-th suffix of a shard in the interleave is its k-th symbol
        place[goal] = ranks
        more = ~(new & np.r_[new[1:], True])
        wanted[at[order[~more]]] = False
        moving[goal[~more]] = False
        slots, goal = slots[more[by_shard]], goal[more]
    return z, place - first[z], block


SHARDS = 8


def _repeated_runs(live: np.ndarray, doc: np.ndarray, windows: np.ndarray, content: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """(segment, first window, windows) of the runs of windows whose hash occurs in several documents.

    Equal windows have equal hashes, so no repeated window is lost; which of the rest are equal the merge decides.
    """
    hashes, length = [], windows[live] + LENGTH - 1
    part = np.cumsum(length) // CHUNK
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(live)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        h = window_hashes(content[_ranges(begin[live[a:b]], length[a:b])])
        hashes.append(h[_ranges(np.cumsum(length[a:b]) - length[a:b], windows[live[a:b]])])
    h = np.concatenate(hashes)
    n = windows[live]
    segment = np.repeat(np.arange(len(live)), n)
    order = np.argsort(h)
    edges = np.flatnonzero(np.r_[True, h[order[1:]] != h[order[:-1]]])
    d = doc[live][segment[order]]
    several = np.minimum.reduceat(d, edges) != np.maximum.reduceat(d, edges)
    repeated = np.empty(len(h), bool)
    repeated[order] = np.repeat(several, np.diff(np.r_[edges, len(h)]))
    first = np.r_[True, segment[1:] != segment[:-1]]
    opens = np.flatnonzero(repeated & (first | np.r_[True, ~repeated[:-1]]))
    closes = np.flatnonzero(repeated & np.r_[first[1:] | ~repeated[1:], True])
    s = segment[opens]
    return live[s], opens - (np.cumsum(n) - n)[s], closes - opens + 1


def covered_windows(doc: np.ndarray, windows: np.ndarray, content: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every segment and window, flat, the smallest document of an equal window; and where each segment's begin."""
    at = np.r_[0, np.cumsum(windows)]
    answer = np.repeat(doc, windows)
    length = windows + LENGTH - 1
    begin = np.cumsum(length) - length
    live, start, count = _repeated_runs(np.arange(len(doc)), doc, windows, content, begin)
    if not len(live):
        return answer, at
    # Equal runs once, with their smallest document, in the shard where they were first seen.
    source = begin[live] + start
    names = [content[a : a + c + LENGTH - 1].tobytes() for a, c in zip(source, count, strict=True)]
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(s, len(number)) for s in names])
    owner, home = np.full(len(number), LAST), np.full(len(number), LAST)
    np.minimum.at(owner, of, doc[live])
    np.minimum.at(home, of, shard[live] % SHARDS)
    unique = list(number)
    suffixes, transforms, places = [], [], []
    for s in np.unique(home):
        mine = np.flatnonzero(home == s)
        text, string, inside = paired([unique[i] for i in mine])
        order, bwt = transform(text)
        suffixes.append(order)
        transforms.append(bwt)
        places.append((mine[string], inside))
    z, rank, block = merge(transforms)
    segment, offset = np.empty(len(z), np.int64), np.empty(len(z), np.int64)
    for k, (order, (seg, inside)) in enumerate(zip(suffixes, places, strict=True)):
        here = np.flatnonzero(z == k)
        segment[here], offset[here] = seg[order[rank[here]]], inside[order[rank[here]]]
    least = np.full(len(block), LAST)
    np.minimum.at(least, block, owner[segment])
    size = np.array([len(u) for u in unique])
    first = np.r_[0, np.cumsum(size - LENGTH + 1)]
    whole = offset + LENGTH <= size[segment]
    result = np.empty(first[-1], np.int64)
    result[first[segment[whole]] + offset[whole]] = least[block[whole]]
    answer[_ranges(at[live] + start, count)] = result[_ranges(first[of], count)]
    return answer, at


def _answered(table: pa.Table) -> pa.Table:
    """Answers each piece which windows of its segments of a part start in a smaller document: (segment, first window, windows)."""
    unpack = zstandard.ZstdDecompressor().decompress
    facts = [_unblob(x) for x in table.column("facts").to_pylist()]
    sizes = np.array([len(f[0]) for f in facts])
    doc = np.concatenate([f[0] for f in facts]).view(np.int64)
    windows = np.concatenate([f[1] for f in facts]).astype(np.int64) - LENGTH + 1
    content = np.frombuffer(b"".join(unpack(x) for x in table.column("content").to_pylist()), np.uint8)
    shard = np.repeat(np.arange(len(sizes)), sizes)
    answer, at = covered_windows(doc, windows, content, shard)
    segment = np.repeat(np.arange(len(doc)), windows)
    gone = answer < doc[segment]
    other = np.r_[True, segment[1:] != segment[:-1]]
    opens = np.flatnonzero(gone & (other | np.r_[True, ~gone[:-1]]))
    closes = np.flatnonzero(gone & np.r_[other[1:] | ~gone[1:], True])
    s = segment[opens]
    first = np.cumsum(sizes) - sizes
    cuts = np.searchsorted(shard[s], np.arange(len(sizes) + 1))
    out = [_blob(s[a:b] - f, opens[a:b] - at[s[a:b]], closes[a:b] - opens[a:b] + 1) for a, b, f in zip(cuts[:-1], cuts[1:], first, strict=True)]
    return pa.table({"piece": table.column("piece"), "part": table.column("part"), "data": pa.array(out, pa.binary())})


CARRIED = "piece bigint, doc_ids array<bigint>, sizes array<bigint>, texts binary"
DATA = "piece bigint, part int, data binary"


def _documents(piece: pa.RecordBatch) -> np.ndarray:
    return piece.column("doc_id").fill_null(LAST).to_numpy()


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces themselves, compressed, one row each."""
    for number, piece in numbered_pieces(batches, PIECE):
        raw, starts = bytes_of(piece.column("text"))
        lists = [pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), x) for x in (piece.column("doc_id"), pa.array(np.diff(starts)))]
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([zstandard.ZstdCompressor(level=3).compress(raw.tobytes())], pa.binary())], names=["piece", "doc_ids", "sizes", "texts"])


def _read_back(carried: pa.Table, answers: pa.Table, parts: int) -> tuple[pa.Array, Segments]:
    if carried.num_rows != 1:
        raise RuntimeError("the input gave other rows when it was read again")
    ids, sizes = carried.column("doc_ids").combine_chunks().flatten(), carried.column("sizes").combine_chunks().flatten().to_numpy()
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(carried.column("texts")[0].as_py()), np.uint8)
    found = Segments(raw, np.r_[0, np.cumsum(sizes)].astype(np.int64), ids.fill_null(LAST).to_numpy(), parts)
    found.keep(_by_part(answers))
    return ids, found


def _by_part(answers: pa.Table) -> dict[int, bytes]:
    return dict(zip(answers.column("part").to_pylist(), answers.column("data").to_pylist(), strict=True))


def remove_repeats(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (bytes that remain)."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_bytes))
    rows = docs.select("doc_id", "text")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece in numbered_pieces(batches, PIECE):
            out = list(Segments(*bytes_of(piece.column("text")), _documents(piece), parts).grams())
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["piece", "part", "data"])

    def texts(carried: pa.Table, answers: pa.Table) -> pa.Table:
        _, found = _read_back(carried, answers, parts)
        out = list(found.texts())
        number = carried.column("piece")[0].as_py()
        return pa.table([pa.array([number] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in (1, 2))], names=["piece", "part", "facts", "content"])

    def cut(carried: pa.Table, answers: pa.Table) -> pa.Table:
        windows = pa.compute.equal(answers.column("turn"), 2)
        ids, found = _read_back(carried, answers.filter(pa.compute.invert(windows)), parts)
        spans = found.removed(_by_part(answers.filter(windows)))
        kept = []
        for a, b, (begin, end) in zip(found.starts[:-1], found.starts[1:], spans, strict=True):
            text, edges = found.raw[a:b].tobytes(), [0, *np.stack([begin, end], axis=1).ravel().tolist(), b - a]
            kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
        longs = [np.diff(found.starts), np.array([int((e - b).sum()) for b, e in spans], np.int64), np.array([len(b) for b, _ in spans], np.int64)]
        return pa.table([ids, *(pa.array(x, pa.int64()) for x in longs), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    elsewhere = stored(rows.mapInArrow(send, DATA).groupBy("part").applyInArrow(lambda t: _seen_elsewhere(t), DATA))
    carried = rows.mapInArrow(_carry, CARRIED)
    sent = carried.groupBy("piece").cogroup(elsewhere.groupBy("piece")).applyInArrow(texts, "piece bigint, part int, facts binary, content binary")
    windows = stored(sent.groupBy("part").applyInArrow(lambda t: _answered(t), DATA))
    answers = elsewhere.withColumn("turn", F.lit(1)).unionByName(windows.withColumn("turn", F.lit(2)))
    return carried.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
