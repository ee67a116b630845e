"""The model against one counted in plain Python; n-grams of any share of the corpus are kept."""

import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coterie.llm import lm_score

D = lm_score.DISCOUNT


def brute(texts, train, least=2):
    """Scores by an interpolated model of all n-grams that occur ``least`` times or more."""
    words = lambda t: ["\0", *t.lower().split(), "\0"]
    one, two, three = Counter(), Counter(), Counter()
    for w in map(words, train):
        one.update(w[1:])
        two.update(zip(w, w[1:]))
        three.update(zip(w, w[1:], w[2:]))
    scale = sum(one.values()) + len(one) + 1

    def sums(grams):
        total, kept, kinds = Counter(), Counter(), Counter()
        for g, n in grams.items():
            total[g[:-1]] += n
            if n >= least:
                kept[g[:-1]] += n
                kinds[g[:-1]] += 1
        return lambda g: (((grams[g] - D) / total[g[:-1]] if grams[g] >= least else 0), 1 - (kept[g[:-1]] - D * kinds[g[:-1]]) / max(1, total[g[:-1]]))

    s2, s3 = sums(two), sums(three)
    for t in texts:
        w, out = words(t), 0
        for k in range(1, len(w)):
            arc, freed = s2((w[k - 1], w[k]))
            p = arc + freed * (one[w[k]] + 1) / scale
            if k > 1:
                arc, freed = s3((w[k - 2], w[k - 1], w[k]))
                p = arc + freed * p
            out += math.log10(p)
        yield out


@pytest.mark.parametrize("part", [1 << 24, 4000])
def test_rare_ngrams_of_a_large_corpus_are_kept(spark, part):
    texts = [" ".join(f"w{(i * i + 7 * j * j + i * j) % 997}" for j in range(900)) for i in range(300)]
    texts += ["Quite rare words meet here", "quite rare words meet here", "", "rare words never seen meet"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3, "doc_id").cache()
    got = {r.doc_id: r.score for r in lm_score.score_texts(df, F.col("doc_id") % 5 != 2, part).collect()}
    train = [t for i, t in enumerate(texts) if i % 5 != 2]
    assert len(got) == len(texts)
    for i, x in enumerate(brute(texts, train)):
        assert abs(got[i] - x) < 1e-6 * max(1, -x), i


def test_pieces_of_very_many_words_are_cut_alike(monkeypatch):
    h, first = lm_score.tokens(pa.array(["a b a b c", "", "c a b", None, "a b c d"]))
    head, rank, hot = np.sort(np.unique(h)[:3]), np.array([2, 3, 1]), np.array([False, True, False, False])
    narrow = lm_score.Grams(h, first, head, rank, hot, 3)
    monkeypatch.setattr(lm_score, "BITS", 0)
    wide = lm_score.Grams(h, first, head, rank, hot, 3)
    for name in ("V", "U", "W", "split", "cuts", "at1", "at2", "at3"):
        assert np.array_equal(getattr(narrow, name), getattr(wide, name)), name


@pytest.mark.parametrize("least", [1, 2, 3])
def test_hot_pairs_long_texts_null_and_repeated_ids(spark, least):
    """A third of all pairs is one pair, whose n-grams are dealt one by one; long texts are walked in many stretches."""
    texts = [" ".join(f"of the x{(i * j) % 37} y{(i + j * j) % 11}" for j in range(40 + i)) for i in range(20)]
    texts += [" ".join(f"z{j % 13} of the z{j * j % 7}" for j in range(900)), "of", "", None, "The OF the of", "\n"]
    ids = [i if i % 6 else 6 for i in range(len(texts))]
    rows = [*zip(ids, texts), (None, "of the only here of the only here"), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2, "doc_id").cache()
    got = lm_score.score_texts(df, F.col("doc_id") % 5 != 2, 1000, least).collect()
    train = [t or "" for i, t in rows if i is not None and i % 5 != 2]
    want = sorted((-1 if i is None else i, round(x, 6)) for (i, _), x in zip(rows, brute([t or "" for _, t in rows], train, least)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {sum(len(t.split()) + 1 for t in train)}


def test_without_training_every_token_has_probability_one(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (2, "")], "doc_id bigint, text string")
    got = lm_score.score_texts(df, F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 4, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert lm_score.score_texts(df.limit(0), F.lit(True)).count() == 0


def test_hot_pairs_are_split_and_others_are_not():
    h, first = lm_score.tokens(pa.array(["of the a", "of the b c d", "the of"]))
    of, the = lm_score.tokens(pa.array(["of"]))[0][0], lm_score.tokens(pa.array(["the"]))[0][0]
    head = np.sort(np.array([of, the]))
    rank = np.where(head == of, 2, 1)
    pairs = np.unique(lm_score._hot_pairs(pa.array(["x of the y", "the of of"]), head, rank))
    assert sorted(pairs.tolist()) == sorted([1 << 32 | 2, 2 << 32 | 1, 2 << 32 | 2])
    grams = lm_score.Grams(h, first, head, rank, np.array([False, True, True]), 50, np.array([1 << 32 | 2], np.uint64))
    contexts = {(int(v), int(u)): bool(s) for v, u, s in zip(grams.V, grams.U, grams.split)}
    assert contexts[1, 2] and contexts[1, 0] and contexts[2, 0] and contexts[0, 0]
    assert not any(s for (v, u), s in contexts.items() if v > 2 or u > 2)


def test_the_walk_takes_arcs_by_place_and_searches_none(monkeypatch):
    texts = pa.array(["a b c d a b c", "a b c", "", "b c d x", "a b " * 700])
    h, first = lm_score.tokens(texts)
    none, hot = np.zeros(0, np.int64), np.array([False])
    grams = lm_score.Grams(h, first, lm_score.NONE, none, hot, 1)
    ((part, data),) = lm_score._sent(grams, np.ones(len(h), bool))
    count = lm_score._part_counts(SimpleNamespace(value=(hot, lm_score.NONE)), 2)
    answers = {part: count(pa.table({"piece": [0], "part": pa.array([part], pa.int32()), "data": [data]})).column("data")[0].as_py()}
    model = lm_score.Automaton(grams, answers, [none] * 3, none, float(len(h) + len(np.unique(h)) + 1), 2)
    monkeypatch.setattr(lm_score, "_found", None)
    whole = model.walk(first)
    plain = []
    for a, b in zip(first[:-1], first[1:]):  # word by word, without stretches
        state, total = np.array([model.start]), 0.0
        for place in range(a, b):
            state, p = model.step(state, np.array([place]))
            total += p[0]
        plain.append(total)
    assert np.allclose(whole, plain) and (whole < 0).all() and (model.ahead[2] >= 0).any() and (model.ahead[2] < 0).any()
