import hashlib
import random

from coterie.llm import repeats


def brute(docs):
    first = {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    out = {}
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcde é") for _ in range(n))
    passage, base = text(180), text(400)
    docs = [(0, base), (1, base), (2, base[:200] + "X" + base[200:]), (3, None), (4, ""), (5, "short"), (6, "ab" * 200), (7, "ab" * 90), (8, base[100:149]), (9, base[100:150])]
    docs += [(10 + i, text(rnd.randrange(120)) + passage[rnd.randrange(60) :] + text(rnd.randrange(120))) for i in range(30)]
    rnd.shuffle(docs)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, spans string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in repeats.remove_repeats(df).collect()}
    assert got == brute(docs)


def test_empty_table_and_missing_ids(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    t = "abcdefghij" * 9
    df = spark.createDataFrame([(None, t), (5, t), (5, t)], "doc_id bigint, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in repeats.remove_repeats(df).collect()) == [(-1, 90), (5, 0), (5, 0)]
