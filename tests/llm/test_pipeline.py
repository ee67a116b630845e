"""Every stage of the pipeline on the smallest tables against a plain computation over the rows it was given."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from coterie.llm.common import read, stored
from test_near_dedup import classes

SF = "/root/testdata/sf0.001"
LETTER = re.compile(r"[^\W\d_]")


@pytest.fixture(scope="module")
def steps(spark):
    """{stage: (rows it was given, rows it returned, their columns)}"""
    docs, out = read(spark, SF, "documents"), {}
    given = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        rows = docs.collect()
        out[name] = (given, rows, docs.columns)
        given = rows
    return out


def ids(rows):
    return {r.doc_id for r in rows}


def windows(text, n=5):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_stages_and_columns(spark, steps):
    assert list(steps) == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "mix"]
    columns = read(spark, SF, "documents").columns
    assert all(c == columns for name, (_, _, c) in steps.items() if name != "mix")
    assert steps["mix"][2] == [*columns, "copy"]


def test_language_drops_texts_without_letters_and_keeps_labelled_prose(steps):
    given, kept, _ = steps["language_id"]
    assert all(LETTER.search(r.text or "") for r in kept)
    prose = {r.doc_id for r in given if r.lang and len(LETTER.findall(r.text or "")) >= 100}
    assert len(prose) > 50 and len(prose & ids(kept)) >= 0.98 * len(prose)


def test_exact_keeps_the_smallest_id_of_equal_texts(steps):
    given, kept, _ = steps["exact_dedup"]
    first = {}
    for r in given:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[key] = min(first.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in kept) == sorted(first.values())


def test_near_keeps_one_of_each_class(steps):
    given, kept, _ = steps["near_dedup"]
    of = classes([(r.doc_id, r.text) for r in given])
    assert Counter(of[r.doc_id] for r in kept) == Counter(set(of.values()))


def test_decontamination_drops_items_and_leaves_clean_documents(spark, steps):
    given, kept, _ = steps["decontaminate"]
    items = [r.text for r in read(spark, SF, "benchmark").collect()]
    shared = set().union(*(windows(t) for t in items))
    clean = {r.doc_id for r in given if not windows(r.text) & shared}
    words = lambda t: " " + " ".join((t or "").split()) + " "
    whole = {r.doc_id for r in given if any(words(t) in words(r.text) for t in items if len(windows(t)) > 0)}
    assert clean <= ids(kept) and not whole & ids(kept)


def test_mix_comes_near_its_targets(steps):
    given, taken, _ = steps["mix"]
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in given}
    sizes, got = defaultdict(int), defaultdict(int)
    for r in given:
        sizes[r.source] += size[r.doc_id]
    for r in taken:
        got[r.source] += size[r.doc_id]
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        target |= {s: 3 * sizes[s] for s in full} if full else {s: weight[s] * level for s in open_}
        left -= sum(3 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    assert max(Counter(r.doc_id for r in taken).values()) <= 3
    longest = max(size.values())
    assert all(abs(got[s] - target[s]) <= longest for s in names)
