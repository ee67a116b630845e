"""Fill-in-middle outputs against slices of each text's units, and exact round trips."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from coterie.llm import fim
from coterie.llm.common import bytes_of

TEXTS = [None, "", "a", "don't stop\n  now", "<P>", "x <S> y", "<", "P>", "<P", "a<P b<S c<M", "ä€𝄞 z 𝄞𝄞", "é" * 7, "one two three four five six", "<<P>>", "\x00\x7f z", "<M", ">S<"]


def plain(doc_id, text):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equals_slices_of_units_and_restores(spark):
    long = " ".join(f"word{i} é" for i in range(200_000))
    rows = [(i, t, "en") for i, t in enumerate(TEXTS * 12)] + [(None, "no id here", "en"), (3, "repeated id", "en"), (3, "repeated id", "en"), (9000, long, "en"), (9001, long + "<M>", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(3)
    got = [tuple(r) for r in fim.restore(fim.fill_in_middle(df)).collect()]
    want = [(i, *plain(i, t), t or "") for i, t, _ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.restore(fim.fill_in_middle(df.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="aZ<>PSM é\n𝄞", max_size=12), st.floats(0, 1), st.floats(0, 1), st.sampled_from(["psm", "spm", "plain"])), max_size=6))
def test_scatter_and_gather_are_inverse(rows):
    import pyarrow as pa

    raw, starts = bytes_of(pa.array([t for t, *_ in rows], pa.string()))
    form = np.array([f for *_, f in rows], dtype="U5")
    form[fim.sentinels(raw, starts)[1]] = "plain"
    size = np.diff(starts)
    cuts = [np.sort(np.array([[int(a * n), int(b * n)] for (_, a, b, _), n in zip(rows, size)], np.int64).reshape(-1, 2), axis=1)[:, k] + starts[:-1] for k in (0, 1)]
    out, out_starts = fim.scatter(raw, starts, *cuts, form)
    back, back_starts = fim.gather(out, out_starts, form)
    assert back.tobytes() == raw.tobytes() and (back_starts == starts).all()
