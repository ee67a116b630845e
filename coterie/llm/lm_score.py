"""Language-model scoring by a weighted backoff automaton that grows with the input.

All training documents are counted. A state is a context of one or two words
that some word follows ``least`` times or more. Each such word is an arc with its absolutely
discounted, interpolated log-probability; it leads to the longest state that the words read
so far end in. A failure arc leads from a state to its shorter context and carries the mass
that discounting freed. The root has an arc for every word, with add-one unigrams
of all tokens, so the model sums to one. Nothing is kept by its share of the corpus.

The automaton as a whole lies in parts, dealt by context, whose number grows with the input.
Texts are read in pieces. A piece sends its distinct n-grams to the parts; a part adds
up the pieces' counts and answers each piece with its n-grams' counts and its contexts'
sums. From them the piece builds the states and arcs that its texts can reach, and walks
its texts from left to right once: the walk carries a state, takes the word's arc or fails
to the shorter context until there is one, and adds up log-probabilities. Texts step side
by side. A long text is walked in stretches, each from two words before it, which
fix its state whatever came earlier.

N-grams after a hot word or a hot pair of words, one with a large share of a part's tokens, are
dealt one by one; the sums of these contexts, at most as many as parts, are broadcast.
How often a context occurs follows from the counts of its own words.
The most frequent words, ``HEAD`` at most, have short numbers in what is sent;
other words are sent with their hashes, so this bound changes no score.

A null text is empty and has the end token alone. A row without doc_id is scored
but not learned from. Without training documents every token has probability
one. Rows that repeat a doc_id are scored each. Extra columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.llm.common import bytes_of, fold, hash_words, mix, numbered_pieces, pieces, read, stored, word_bounds
from coterie.llm.language_id import held_out

HEAD, LEAST, DISCOUNT = 1 << 20, 2, 0.75  # a word of the head has 24 bytes in what is broadcast
PIECE, PART = 1 << 22, 1 << 23  # bytes of text
TASK, TASKS = 1 << 23, 20_000  # bytes of text for each task of a shuffle, until there are TASKS; then tasks have more groups, one after the other
STRETCH = 512  # tokens of a text that one walk reads
BITS = 21  # of a word's number in a piece, so that three fit in one key
FOLDS, FOLD = 7, 2
END = np.uint64(0x0E0D)  # stands for the end of a text; no word's hash, but for one chance in 2 ** 64
TOP = np.uint64(1 << 63)
_STEP = np.uint64(0x9E3779B97F4A7C15)
NONE = np.zeros(0, np.uint64)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row closed by END, and where each row starts."""
    return tokens_of(*bytes_of(column))


def tokens_of(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = fold(raw)
    begin, end, row = word_bounds(raw, starts)
    n = np.bincount(row, minlength=len(starts) - 1) + 1
    first = np.r_[0, np.cumsum(n)]
    out = np.full(first[-1], END, np.uint64)
    out[np.arange(len(row)) + row] = hash_words(raw, begin, end)
    return out, first


def _counted(keys: Iterator[np.ndarray], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(key, n) of all keys, merged while they fit in ``most`` entries."""

    def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
        k, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        u, of = np.unique(k, return_inverse=True)
        return u, np.bincount(of, weights=n, minlength=len(u)).astype(np.int64)

    parts, held = [], 0
    for x in keys:
        parts.append(np.unique(x, return_counts=True))
        held += len(parts[-1][0])
        if held > 2 * most:
            parts = [merge(parts)]
            held = len(parts[0][0])
            if held > most:
                yield pa.RecordBatch.from_arrays([pa.array(parts[0][0]), pa.array(parts[0][1])], names=["key", "n"])
                parts, held = [], 0
    if parts:
        k, n = merge(parts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"])


def _numbers(h: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The head's number of each token, -1 for others."""
    if not len(head):
        return np.full(len(h), -1, np.int64)
    at = np.minimum(np.searchsorted(head, h), len(head) - 1)
    return np.where(head[at] == h, at, -1)


def _hot_pairs(column: pa.Array, hashes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Keys of neighbouring tokens that are both among the hot words, whose sorted hashes and numbers are given."""
    h, first = tokens(column)
    at = _numbers(np.r_[END, h], hashes)
    w = np.where(at >= 0, rank[np.maximum(at, 0)], 0)
    end, w = w[0], w[1:]
    u = np.r_[0, w[:-1]]
    u[first[:-1]] = end
    return (w << 32 | u)[(w > 0) & (u > 0)]


def _planed(x: np.ndarray) -> bytes:
    """Non-negative numbers as their count, width and byte planes, which compresses small ones well."""
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    rows = np.ascontiguousarray(x.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)[:, :width]
    return len(x).to_bytes(8, "little") + bytes([width]) + rows.T.tobytes()


def _blob(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(map(_planed, arrays)))


def _unblob(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n, width = int.from_bytes(raw[at : at + 8], "little"), raw[at + 8]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 9).reshape(width, n).T
        out.append(wide.view("<u8").ravel())
        at += 9 + n * width
    return out


def _split(v: np.ndarray, u: np.ndarray, hot: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Which contexts have their n-grams dealt one by one: no word, a hot word, a hot pair."""
    small = (v < TOP) & (u < TOP)
    out = (u == 0) & ((v == 0) | hot[np.where(small, v, 0).astype(np.int64)])
    at = np.flatnonzero(small & (u > 0))
    at = at[hot[v[at].astype(np.int64)] & hot[u[at].astype(np.int64)]]  # a pair occurs no oftener than its words
    out[at] = np.isin(v[at] << np.uint64(32) | u[at], pairs)
    return out


class Grams:
    """The distinct n-grams of a piece of texts, sorted by part, middle word, first word and last word.

    Words have numbers from 1, frequent ones first, if they are in the head, else their hash with the
    top bit set; 0 stands for no word. Order 3 has both context words, order 2
    the middle one, order 1 (only of words outside the head) none. All n-grams
    of a context are in one part, but for those after a hot word or a hot pair."""

    def __init__(self, h: np.ndarray, first: np.ndarray, head: np.ndarray, rank: np.ndarray, hot: np.ndarray, parts: int, pairs: np.ndarray = NONE):
        distinct, local = np.unique(np.r_[END, h], return_inverse=True)
        number = _numbers(distinct, head)
        words = np.r_[np.uint64(0), np.where(number >= 0, rank[np.maximum(number, 0)].astype(np.uint64) if len(rank) else TOP, distinct | TOP)]
        order = np.argsort(words)  # words[0] is 0, no word, and stays first
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.number = np.r_[-1, number][order]
        words, local = words[order], place[local + 1]
        end, w = local[0], local[1:]
        self.end, self.w = end, w.astype(np.int32)
        rare = np.flatnonzero(self.number[w] < 0)
        v = np.r_[0, w[:-1]]
        v[first[:-1]] = end
        u = np.r_[0, v[:-1]]
        u[first[:-1]] = 0
        three = np.flatnonzero(u)
        none = np.zeros(len(rare), np.int64)
        before, middle, last = np.concatenate([u[three], np.zeros(len(w), np.int64), none]), np.concatenate([v[three], v, none]), np.concatenate([w[three], w, w[rare]])
        bits = len(words).bit_length()
        if bits <= BITS:
            keys, inverse = np.unique(middle << 2 * bits | before << bits | last, return_inverse=True)
            mask = (1 << bits) - 1
            middle, before, last = keys >> 2 * bits, keys >> bits & mask, keys & mask
        else:  # three numbers do not fit in 63 bits
            contexts, of = np.unique(middle << 32 | before, return_inverse=True)
            keys, inverse = np.unique(of << 32 | last, return_inverse=True)
            context = contexts[keys >> 32]
            middle, before, last = context >> 32, context & 0xFFFFFFFF, keys & 0xFFFFFFFF
        self.V, self.U, self.W = words[middle], words[before], words[last]
        self.split = _split(self.V, self.U, hot, pairs)
        route = mix(mix(self.V) + self.U * _STEP)
        route = np.where(self.split, mix(route + self.W * _STEP), route)
        part = (route % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        self.parts, self.cuts = part[begin].tolist(), np.r_[begin, len(part)]  # only those the piece has n-grams for
        self.V, self.U, self.W, self.split = self.V[order], self.U[order], self.W[order], self.split[order]
        self.middle, self.before, self.last = (x[order].astype(np.int32) for x in (middle, before, last))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        place = back[inverse]
        self.three, self.rare = three, rare
        self.at3, self.at2, self.at1 = np.split(place, [len(three), len(three) + len(w)])

    def opens(self, a: int, b: int) -> np.ndarray:
        """Where a new context begins among n-grams a to b of a part."""
        v, u = self.V[a:b], self.U[a:b]
        return np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (u[1:] != u[:-1])])


def _sent(grams: Grams, learn: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, data) of a piece: its contexts, how many n-grams each has, their last words and counts in training texts."""
    n = np.zeros(len(grams.V), np.int64)
    for at, rows in ((grams.at3, learn[grams.three]), (grams.at2, learn), (grams.at1, learn[grams.rare])):
        n += np.bincount(at[rows], minlength=len(n))
    for part, a, b in zip(grams.parts, grams.cuts[:-1], grams.cuts[1:], strict=True):
        at = grams.opens(a, b)
        v = grams.V[a:b][at]
        yield part, _blob(np.r_[v[:1], np.diff(v)], grams.U[a:b][at], np.diff(np.r_[at, b - a]), grams.W[a:b], n[a:b])


def _alike(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and each key's number among the distinct ones."""
    order = np.argsort(key)
    new = np.r_[True, key[order[1:]] != key[order[:-1]]]
    number = np.empty(len(key), np.uint32)
    number[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return order[new], number


def _part_counts(shared: Broadcast, least: int):
    """Adds up all pieces' n-grams of a part and answers each piece in the order in which it sent them."""

    def one(table: pa.Table) -> pa.Table:
        *_, hot, pairs = shared.value
        sent = [_unblob(x) for x in table.column("data").to_pylist()]
        sizes = [(len(x[3]), len(x[0])) for x in sent]
        v = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in sent])
        u, w = (np.concatenate([x[k] for x in sent]) for k in (1, 3))
        each, n = (np.concatenate([x[k].astype(np.uint32) for x in sent]) for k in (2, 4))
        del sent
        key = mix(mix(v) + u * _STEP)
        of = np.repeat(np.arange(len(v), dtype=np.uint32), each)
        first_context, context = _alike(key)
        key = key[of] * _STEP
        key += w
        del w, each
        first, gram = _alike(mix(key))
        del key
        total = np.bincount(gram, weights=n).astype(np.int64)
        owner = context[of[first]]
        del n, of, first
        kept = np.where(total >= least, total, 0)
        sums = [np.bincount(owner, weights=x, minlength=len(first_context)).astype(np.int64) for x in (kept, kept > 0)]
        told = np.where(v[first_context][owner] > 0, kept, total)  # what is no arc has no count to tell, but for single words
        data, a, c = [], 0, 0
        for grams, contexts in sizes:
            b, d = a + grams, c + contexts
            data.append(_blob(told[gram[a:b]], *(s[context[c:d]] for s in sums)))
            a, c = b, d
        v, u = v[first_context], u[first_context]
        wide = np.flatnonzero((v > 0) & _split(v, u, hot, pairs))
        more = len(wide)
        pieces = table.column("piece").combine_chunks().cast(pa.int64()).to_pylist()
        columns = [pieces + [None] * more, table.column("part").to_pylist() + [None] * more, data + [None] * more]
        stats = [[None] * len(data) + x[wide].astype(np.int64).tolist() for x in (v << np.uint64(32) | u, *sums)]
        kinds = [pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 3]
        return pa.table([pa.array(x, k) for x, k in zip(columns + stats, kinds, strict=True)], names=["piece", "part", "data", "context", "k", "t"])

    return one


def _found(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key lies among sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return at, keys[at] == key


class Automaton:
    """The states and arcs that the texts of a piece can reach. State 0 is the root.

    Arcs are numbered, the root's by word and the others by n-gram; ``weight`` and ``to`` are theirs, ``freed`` and ``fail`` those of the
    states' failure arcs. ``ahead`` has the arc of each place's word from contexts of no, one and two words, -1 where there is none.
    A context that no word follows often enough passes all its mass on, so it needs no state. If a pair is
    a state, so is its last word, and its first word has an arc to it: n-grams occur no oftener than what they contain.
    """

    def __init__(self, grams: Grams, answers: dict[int, bytes], hot_sums: list, counts: np.ndarray, scale: float, least: int):
        size = len(grams.V)
        n, kept, kinds = (np.zeros(size, np.int64) for _ in range(3))
        for part, a, b in zip(grams.parts, grams.cuts[:-1], grams.cuts[1:], strict=True):
            got = _unblob(answers[part])
            each = np.diff(np.r_[grams.opens(a, b), b - a])
            n[a:b] = got[0]
            for out, x in zip((kept, kinds), got[1:], strict=True):
                out[a:b] = np.repeat(x, each)
        wide = np.flatnonzero(grams.split & (grams.V > 0))
        at, seen = _found(hot_sums[0], (grams.V[wide] << np.uint64(32) | grams.U[wide]).view(np.int64))
        for out, x in zip((kept, kinds), hot_sums[1:], strict=True):
            out[wide[seen]] = x[at[seen]]

        self.count = counts[np.maximum(grams.number, 0)] if len(counts) else np.zeros(len(grams.number), np.int64)
        self.count[grams.number < 0] = 0
        self.count[grams.w[grams.rare]] = n[grams.at1]
        root = (self.count + 1) / scale
        self.words = len(root)
        self.root = np.log10(root)

        # Every word in training texts has one token after it, so a context occurs as often as its last word or pair is counted.
        rows = np.flatnonzero((grams.middle > 0) & (kinds > 0))
        context = _pair(grams.middle[rows], grams.before[rows])
        states, one, of = np.unique(context, return_index=True, return_inverse=True)
        v, u = grams.middle[rows[one]], grams.before[rows[one]]
        kept, kinds = kept[rows[one]], kinds[rows[one]]
        arc = n[rows] >= least
        rows, of = rows[arc], of[arc]
        n, middle, before, last = n[rows], grams.middle[rows], grams.before[rows], grams.last[rows]

        alone = u == 0
        after = np.zeros(self.words, np.int64)  # the state of each word
        after[v[alone]] = 1 + np.flatnonzero(alone)
        self.fail = np.r_[0, np.where(alone, 0, after[v])]
        two = np.flatnonzero(before == 0)
        key = _pair(middle[two], last[two])
        order = np.argsort(key)
        two, key = two[order], key[order]
        below = np.where(alone, self.count[v], 0)
        below[~alone] = n[two[_found(key, _pair(u[~alone], v[~alone]))[0]]]
        freed = (below - kept + DISCOUNT * kinds) / below
        self.freed = np.r_[0, np.log10(freed)]

        p = (n - DISCOUNT) / below[of]
        p[two] += freed[of[two]] * root[last[two]]
        three = np.flatnonzero(before > 0)
        p[three] += freed[of[three]] * p[two[_found(key, _pair(middle[three], last[three]))[0]]]
        at, longer = _found(states, _pair(last, middle))
        self.weight = np.r_[self.root, np.log10(p)]
        self.to = np.r_[after, np.where(longer, 1 + at, after[last])]
        self.start = after[grams.end]
        self.length = np.r_[0, np.where(alone, 1, 2)].astype(np.int8)  # of each state's context
        arc = np.full(size + 1, -1, np.int64)  # of each n-gram, -1 if it is none; the last stands for no n-gram
        arc[rows] = self.words + np.arange(len(rows))
        three = np.full(len(grams.w), size, np.int64)
        three[grams.three] = grams.at3
        # A state's context is what was just read, so its arc for the next word, if it has one, is that of the n-gram there.
        self.ahead = np.stack([grams.w.astype(np.int64), arc[grams.at2], arc[three]])

    def step(self, state: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state and the log-probability of the word at a place from each state: failure arcs until there is an arc for the word."""
        arc = self.ahead[self.length[state], at]
        freed = np.zeros(len(at))
        left = np.flatnonzero(arc < 0)
        state = state[left]
        while len(left):
            freed[left] += self.freed[state]
            state = self.fail[state]
            arc[left] = self.ahead[self.length[state], at[left]]
            more = np.flatnonzero(arc[left] < 0)  # never at the root, which has an arc for every word
            left, state = left[more], state[more]
        return self.to[arc], freed + self.weight[arc]

    def walk(self, first: np.ndarray) -> np.ndarray:
        """The log-probability of each text: all stretches take a step at a time, longest ones first."""
        cuts = -(-np.diff(first) // STRETCH)
        text = np.repeat(np.arange(len(cuts)), cuts)
        begin = first[text] + STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        end = np.minimum(begin + STRETCH, first[text + 1])
        warm = np.minimum(2, begin - first[text])  # words that fix the state at the stretch's start
        order = np.argsort(begin - warm - end, kind="stable")
        begin, end, warm = begin[order] - warm[order], end[order], warm[order]
        state = np.where(begin == first[text[order]], self.start, 0)
        total = np.zeros(len(order))
        steps = int((end - begin).max())
        live = len(order) - np.searchsorted((end - begin)[::-1], np.arange(steps), side="right")
        for j, m in enumerate(live):
            state, p = self.step(state[:m], begin[:m] + j)
            total[:m] += np.where(warm[:m] > j, 0, p)
        return np.bincount(text[order], weights=total, minlength=len(cuts))


def _pair(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.int64) << 32 | low


def score_texts(docs: DataFrame, training: Column, part_bytes: int = PART, least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    training: which rows are learned from. least: how often a pair or triple of words occurs to be an arc; 1 keeps all.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(training, F.lit(False)).alias("learn"), "text")
    texts = rows.filter("learn").select("text")
    count = texts.mapInArrow(lambda batches: _counted(tokens(p.column("text"))[0].view(np.int64) for b in batches for p in pieces(b)), "key bigint, n bigint")
    counts = stored(count.groupBy("key").agg(F.sum("n").alias("n")))
    # A row for each power of two: how many words occur so often, at least, and less than twice that.
    powers = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    total, distinct = (sum(r[x] for r in powers) for x in ("n", "words"))
    enough = next(k for k in range(1, 65) if sum(r["words"] for r in powers if r["power"] >= k) <= HEAD)
    frequent = counts.filter(F.col("n") >= F.lit(1 << min(enough, 62))).toArrow()
    h, n = frequent["key"].to_numpy().view(np.uint64), frequent["n"].to_numpy()
    head, n = h[np.argsort(h)], n[np.argsort(h)]
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(-n, kind="stable")] = 1 + np.arange(len(n))
    tasks = min(TASKS, max(1, -(-size // TASK)))
    hot = np.r_[False, np.sort(n)[::-1] * parts > 2 * total]
    scale = float(total + distinct + 1)
    often = hot[rank]
    pairs = NONE
    if often.any():
        alike = spark.sparkContext.broadcast((head[often], rank[often]))
        paired = texts.mapInArrow(lambda batches: _counted(_hot_pairs(p.column("text"), *alike.value) for b in batches for p in pieces(b)), "key bigint, n bigint")
        many = paired.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") * parts > 2 * total).select("key").toPandas()  # fewer than parts / 2
        pairs = np.sort(many["key"].to_numpy(np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast((head, rank, n, hot, pairs))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ranks, _, often, both = shared.value
        for number, piece in numbered_pieces(batches, PIECE):
            h, first = tokens(piece.column("text"))
            learn = np.repeat(piece.column("learn").to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
            out = list(_sent(Grams(h, first, words, ranks, often, parts, both), learn))
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["piece", "part", "data"])

    sent = rows.mapInArrow(send, "piece bigint, part int, data binary").repartition(tasks, "part")
    answered = stored(sent.groupBy("part").applyInArrow(_part_counts(shared, least), "piece bigint, part int, data binary, context bigint, k bigint, t bigint"))
    wide = answered.filter("context is not null").groupBy("context").agg(*[F.sum(x).alias(x) for x in "kt"]).toPandas().sort_values("context")
    sums = spark.sparkContext.broadcast([wide[x].to_numpy(np.int64) for x in ("context", "k", "t")])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece in numbered_pieces(batches, PIECE):
            raw, starts = bytes_of(piece.column("text"))
            ids = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column("doc_id"))
            sizes = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), pa.array(np.diff(starts)))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, sizes, pa.array([zstandard.ZstdCompressor(level=3).compress(raw.tobytes())], pa.binary())], names=["piece", "doc_ids", "sizes", "texts"])

    def score(carried: pa.Table, answers: pa.Table) -> pa.Table:
        if carried.num_rows != 1 or not answers.num_rows:
            raise RuntimeError("the input gave other rows when it was read again")
        words, ranks, often_n, often, both = shared.value
        ids, sizes = carried.column("doc_ids").combine_chunks().flatten(), carried.column("sizes").combine_chunks().flatten().to_numpy()
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(carried.column("texts")[0].as_py()), np.uint8)
        h, first = tokens_of(raw, np.r_[0, np.cumsum(sizes)].astype(np.int64))
        data = dict(zip(answers.column("part").to_pylist(), answers.column("data").to_pylist(), strict=True))
        grams = Grams(h, first, words, ranks, often, parts, both)
        model = Automaton(grams, data, sums.value, often_n, scale, least)
        known = (model.count > 0)[grams.w].astype(np.int64)
        each = [np.diff(first), np.add.reduceat(known, first[:-1]), np.full(len(ids), total), np.add.reduceat(model.root[grams.w], first[:-1]), model.walk(first)]
        return pa.table([ids, *map(pa.array, each)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    carried = rows.mapInArrow(carry, "piece bigint, doc_ids array<bigint>, sizes array<bigint>, texts binary").repartition(tasks, "piece")
    answers = answered.filter("piece is not null").select("piece", "part", "data").repartition(tasks, "piece")
    return carried.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(score, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), FOLDS, FOLD)
    scored = score_texts(docs, F.col("doc_id").isNotNull() & ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
