"""Words of code-switched texts, and forward-backward against all paths."""

from itertools import pairwise, product

import numpy as np
import pytest

from coterie.llm import language_id

A = "the house stands where water runs through green hills".split()
B = "der hügel steht über dem großen wasser während straßen führen".split()


def test_forward_backward_equals_the_sum_over_all_paths():
    rng = np.random.default_rng(3)
    emission, transition = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    live = np.array([[True] * 4, [True, True, False, False]])
    got, pairs = language_id.posteriors(emission, live, transition)
    wanted_pairs = np.zeros((3, 3))
    for c, steps in enumerate(live.sum(axis=1)):
        paths = list(product(range(3), repeat=int(steps)))
        weight = np.exp([sum(emission[c, k, y] for k, y in enumerate(p)) + sum(transition[x, y] for x, y in pairwise(p)) for p in paths])
        weight /= weight.sum()
        wanted = np.zeros((steps, 3))
        for p, x in zip(paths, weight, strict=True):
            for k, y in enumerate(p):
                wanted[k, y] += x
            for x1, y in pairwise(p):
                wanted_pairs[x1, y] += x
        assert np.allclose(got[c, :steps], wanted)
    assert np.allclose(pairs, wanted_pairs)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    return language_id.fit([(lang, " ".join(rng.choice(words, 40))) for lang, words in (("de", B), ("en", A)) for _ in range(60)])


def test_switches_inside_a_text_are_found(spark, model):
    """Texts whose switches are known; runs cover whole texts, also beyond one chain of words."""
    rng = np.random.default_rng(2)
    texts, wanted = [], []
    for _ in range(30):
        runs = [(lang, list(rng.choice(words, int(rng.integers(6, 90))))) for lang, words in (("en", A), ("de", B), ("en", A))]
        texts.append(" ".join(w for _, ws in runs for w in ws))
        wanted.append([lang for lang, ws in runs for _ in ws])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3, "doc_id")
    right = words = 0
    for r in language_id.label_words(df, model).collect():
        text, labels = texts[r.doc_id], []
        for x in r.runs:
            part = text[x.start : x.end]
            assert part.strip() == part and len(part.split()) == x.n_words and 0.5 <= x.score <= 1
            labels += [x.lang] * x.n_words
        assert " ".join(text[x.start : x.end] for x in r.runs) == text
        assert all(x.lang != y.lang for x, y in pairwise(r.runs))
        right += sum(x == y for x, y in zip(labels, wanted[r.doc_id], strict=True))
        words += len(labels)
    assert right > 0.99 * words


def test_texts_without_words_have_no_runs(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (2, "12 34", "y"), (None, " über 12 wasser", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    got = sorted(language_id.label_words(df, model).collect(), key=lambda r: r.doc_id or 9)
    assert [len(r.runs) for r in got] == [0, 0, 0, 1]
    assert (got[3].runs[0].start, got[3].runs[0].end, got[3].runs[0].lang, got[3].runs[0].n_words) == (1, 15, "de", 2)
    assert [r.runs for r in language_id.label_words(df, None).collect()] == [[]] * 4
    assert language_id.label_words(df.limit(0), model).count() == 0
