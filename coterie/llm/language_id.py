"""Language identification of words in code-switched text with a linear-chain CRF.

Each word is labelled with a language. A word's features are hashed: affixes of
one to three bytes, byte trigrams, and the word itself as its entry in a learned
lexicon. Transitions between labels are learned too. Forward-backward gives each
word's posterior over languages; a document's language has the largest mean.
``label_words`` gives the runs of words of one language inside each text.

The CRF is fitted on a bounded sample: ``PER_LANGUAGE`` labelled documents of
each language (the smallest hashes), ``WINDOWS`` windows of ``CHAIN`` words from
each, cut and joined into chains that switch language, since documents carry one
label only. Texts to predict are read whole, as chains of ``CHAIN`` words.

A null text, or one without a letter, is ``und`` with score 0, as is every text
if no row has a label. Languages with equal means go to the first by code point.
A row without doc_id is neither held out nor learned from. Extra columns are
ignored by ``predict`` and returned by ``keep_identified``.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coterie.llm.common import bytes_of, fold, hash_words, mix, pieces, read, stored, text_key, without, word_bounds

PER_LANGUAGE, WINDOWS, CHAIN = 300, 2, 64
SPARE = 3  # texts that may enter the choice of a language's sample, for each one chosen
FEATURES, STEPS, PENALTY, RATE = 1 << 15, 50, 1e-3, 0.5
MIN_SCORE = 0.5
FOLDS = 5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id: Column, folds: int = FOLDS, at: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == at, F.lit(False))


def word_features(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each word, flat, and where each word's begin."""
    length = end - begin
    parts = [words]
    for n in (1, 2, 3):
        cut = np.minimum(length, n)
        parts += [mix(hash_words(raw, begin, begin + cut) + np.uint64(n)), mix(hash_words(raw, end - cut, end) + np.uint64(16 + n))]
    grams = np.maximum(length - 2, 0)
    of = np.repeat(np.arange(len(begin)), grams)
    at = np.arange(len(of)) - np.repeat(np.cumsum(grams) - grams, grams) + begin[of]
    gram = raw[at].astype(np.uint64) << np.uint64(16) | raw[at + 1].astype(np.uint64) << np.uint64(8) | raw[at + 2].astype(np.uint64) if len(at) else np.zeros(0, np.uint64)
    starts = np.r_[0, np.cumsum(grams + len(parts))]
    flat = np.zeros(starts[-1], np.int64)
    for k, p in enumerate(parts):
        flat[starts[:-1] + k] = (p % np.uint64(FEATURES)).astype(np.int64)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(grams) - grams, grams)
    flat[starts[of] + len(parts) + inside] = (mix(gram + np.uint64(1 << 40)) % np.uint64(FEATURES)).astype(np.int64)
    return flat, starts


def posteriors(emission: np.ndarray, live: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains: emission (chains, steps, labels) in logs, live (chains, steps).

    Returns each word's label posteriors and the expected transitions, summed.
    """
    chains, steps, labels = emission.shape
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    e[~live] = 1.0
    t = np.exp(transition)
    forward, backward = np.empty_like(e), np.ones_like(e)
    a = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    forward[:, 0] = a
    for k in range(1, steps):
        b = (a @ t) * e[:, k]
        a = np.where(live[:, k, None], b / b.sum(axis=1, keepdims=True), a)
        forward[:, k] = a
    pairs = np.zeros((labels, labels))
    b = np.ones((chains, labels))
    for k in range(steps - 1, 0, -1):
        x = e[:, k] * b
        both = forward[:, k - 1][:, :, None] * t[None] * x[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        pairs += both[live[:, k]].sum(axis=0)
        n = x @ t.T
        b = np.where(live[:, k, None], n / n.sum(axis=1, keepdims=True), b)
        backward[:, k - 1] = b
    p = forward * backward
    return p / p.sum(axis=2, keepdims=True), pairs


def fit(windows: list[tuple[str, str]]) -> dict | None:
    """A CRF from (language, window of words): labels, weights (features, labels), transition (labels, labels)."""
    labels = sorted({lang for lang, _ in windows})
    if not labels:
        return None
    rng = np.random.default_rng(5)
    runs = []
    for lang, text in sorted(windows):
        words = text.split(" ")
        cuts = sorted(rng.integers(0, len(words) + 1, int(rng.integers(0, 3))))
        runs += [(labels.index(lang), words[a:b]) for a, b in zip([0, *cuts], [*cuts, len(words)], strict=True) if b > a]
    order = rng.permutation(len(runs))
    tokens = [(y, w) for i in order for y, ws in [runs[i]] for w in ws]
    n = -(-len(tokens) // CHAIN)
    live = np.arange(n * CHAIN).reshape(n, CHAIN) < len(tokens)
    gold = np.zeros(n * CHAIN, np.int64)
    gold[: len(tokens)] = [y for y, _ in tokens]
    starts = np.cumsum([0, *(len(w.encode()) for _, w in tokens)])
    raw = fold(np.frombuffer("".join(w for _, w in tokens).encode(), np.uint8))
    begin, end = starts[:-1], starts[1:]
    flat, at = word_features(raw, begin, end, hash_words(raw, begin, end))
    k = len(labels)
    weights, transition = np.zeros((FEATURES, k)), np.zeros((k, k))
    sums, sums_t = np.full((FEATURES, k), 1e-8), np.full((k, k), 1e-8)
    gold_pairs = np.zeros((k, k))
    grid = gold.reshape(n, CHAIN)
    both = live[:, 1:]
    np.add.at(gold_pairs, (grid[:, :-1][both], grid[:, 1:][both]), 1)
    owner = np.repeat(np.arange(len(tokens)), np.diff(at))
    for _ in range(STEPS):
        emission = np.zeros((n * CHAIN, k))
        emission[: len(tokens)] = np.add.reduceat(weights[flat], at[:-1], axis=0)
        p, pairs = posteriors(emission.reshape(n, CHAIN, k), live, transition)
        error = np.eye(k)[gold[: len(tokens)]] - p.reshape(-1, k)[: len(tokens)]
        g = np.stack([np.bincount(flat, weights=error[owner, j], minlength=FEATURES) for j in range(k)], axis=1) - PENALTY * weights
        g_t = gold_pairs - pairs - PENALTY * transition
        sums += g * g
        sums_t += g_t * g_t
        weights += RATE * g / np.sqrt(sums)
        transition += RATE * g_t / np.sqrt(sums_t)
    return {"labels": labels, "weights": weights.astype(np.float32), "transition": transition}


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cuts = []
        for text in batch.column("text").to_pylist():
            words = text.split()
            most = max(0, len(words) - CHAIN)
            starts = [most * (2 * k + 1) // (2 * WINDOWS) for k in range(WINDOWS if most else 1)]
            cuts.append([" ".join(words[at : at + CHAIN]) for at in starts])
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array(cuts, pa.list_(pa.string()))], names=["lang", "doc_id", "windows"])


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, window) of the per_language documents of each language that come first by a hash of doc_id.

    Only documents outside the held-out fold count. A hash below a bound that keeps SPARE * per_language of a language's
    documents on average decides before the shuffle, so that a language's task reads so many windows at any size of the
    input and whole texts never move. If fewer than per_language of these have letters, the sample is as much smaller.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = stored(rows.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_rows")))
    share = F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5
    # The model has weights for each language, so there are few, and the counts' real size is known from their files.
    near = rows.select("lang", "doc_id", "text").join(counts, F.col("lang") == F.col("_lang")).filter(share * F.col("_rows") <= SPARE * per_language)
    cut = near.filter(F.col("text").rlike(r"\p{L}")).select("lang", "doc_id", "text").mapInArrow(_windows, "lang string, doc_id bigint, windows array<string>")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "windows")
    chosen = cut.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= per_language)
    return chosen.select("lang", F.explode("windows").alias("window"))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict | None:
    """Fits on documents (doc_id, text, lang) outside the held-out fold; the driver sees the sample's windows only."""
    return fit([(r[0], r[1]) for r in sample(docs, per_language).collect() if r[1].strip()])


def _words(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes of the piece's texts, and start, end and row of each word with a letter."""
    raw, starts = bytes_of(piece.column("text"))
    raw = fold(raw)
    begin, end, row = word_bounds(raw, starts)
    letters = np.r_[0, np.cumsum(_LETTER[raw])]
    spoken = letters[end] > letters[begin]
    return raw, begin[spoken], end[spoken], row[spoken]


def _word_posteriors(m: dict, rows: int, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(words, labels): the posterior of each word's language, texts being read as chains of CHAIN words."""
    k = len(m["labels"])
    words = hash_words(raw, begin, end)
    _, one, of = np.unique(words, return_index=True, return_inverse=True)
    flat, at = word_features(raw, begin[one], end[one], words[one])
    emission = np.add.reduceat(m["weights"][flat], at[:-1], axis=0)[of]
    n = np.bincount(row, minlength=rows)
    place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    chains = -(-n // CHAIN)
    chain = (np.cumsum(chains) - chains)[row] + place // CHAIN
    grid, live = np.zeros((chains.sum(), CHAIN, k), np.float32), np.zeros((chains.sum(), CHAIN), bool)
    grid[chain, place % CHAIN] = emission
    live[chain, place % CHAIN] = True
    p, _ = posteriors(grid, live, m["transition"])
    return p[chain, place % CHAIN]


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for piece in pieces(batch):
                raw, begin, end, row = _words(piece)
                pred, score = np.full(piece.num_rows, "und", object), np.zeros(piece.num_rows)
                if len(begin) and m:
                    each = _word_posteriors(m, piece.num_rows, raw, begin, end, row)
                    n = np.bincount(row, minlength=piece.num_rows)
                    total = np.stack([np.bincount(row, weights=x, minlength=piece.num_rows) for x in each.T], axis=1)
                    some = (n > 0) & piece.column("has_letter").to_numpy(zero_copy_only=False)
                    best = total.argmax(axis=1)
                    pred[some] = np.array(m["labels"], object)[best[some]]
                    score[some] = np.clip(total[some, best[some]] / n[some], 0, 1)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_key"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "text_key", "lang_pred", "score"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter")
    return docs.select("doc_id", F.xxhash64(F.lit("text"), "text").alias("text_key"), "text", letter).mapInArrow(tag, "doc_id bigint, text_key bigint, lang_pred string, score double")


RUNS = "array<struct<start:int,end:int,lang:string,n_words:int,score:double>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("n_words", pa.int32()), ("score", pa.float64())]))


def label_words(docs: DataFrame, model: dict | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, runs: where the language switches within a text.

    A run is a maximal row of words with one most probable language: start and end in code points of the text, from its first
    word's start to its last word's end, and its words' mean posterior. Words without a letter belong to no run and
    break none. A null text, one without letters, or any text without a model has no runs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for piece in pieces(batch):
                raw, begin, end, row = _words(piece)
                runs, cuts = pa.array([], _RUN_TYPE.value_type), np.zeros(piece.num_rows + 1, np.int32)
                if len(begin) and m:
                    each = _word_posteriors(m, piece.num_rows, raw, begin, end, row)
                    best = each.argmax(axis=1)
                    first = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (row[1:] != row[:-1])])
                    last = np.r_[first[1:], len(best)] - 1
                    points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]  # code points before each byte
                    before = points[bytes_of(piece.column("text"))[1][:-1]][row[first]]
                    n = last - first + 1
                    mean = np.add.reduceat(each[np.arange(len(best)), best], first) / n
                    lang = np.array(m["labels"], object)[best[first]]
                    values = [points[begin[first]] - before, points[end[last]] - before, lang, n, np.clip(mean, 0, 1)]
                    fields = list(_RUN_TYPE.value_type)
                    runs = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(values, fields, strict=True)], fields=fields)
                    cuts = np.r_[0, np.cumsum(np.bincount(row[first], minlength=piece.num_rows))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_key"), pa.ListArray.from_arrays(pa.array(cuts), runs, type=_RUN_TYPE)], names=["doc_id", "text_key", "runs"])

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(tag, f"doc_id bigint, text_key bigint, runs {RUNS}")


def keep_identified(docs: DataFrame, model: dict | None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, with a language whose mean posterior is min_score or more."""
    return without(docs, predict(docs, model).filter((F.col("lang_pred") == "und") | (F.col("score") < min_score)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
