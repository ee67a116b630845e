"""Contamination against a search that compares every item with every document in plain Python."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from coterie.llm import decontaminate as d
from coterie.llm.common import BLANKS, read

EDGE = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) not in "%$")
NUMERIC = r"[0-9.,:/+-]*"
NUMBER = re.compile(rf"(?:{NUMERIC}|{'|'.join(map(re.escape, d.SIGNS))})[0-9](?:{NUMERIC}[0-9])?(?:{NUMERIC}|{'|'.join(map(re.escape, d.UNITS))})")
CAPITAL = re.compile(r"[A-ZÀ-ÞΑ-ΩЀ-Я]")


def low(word):
    return "".join(c.lower() if c.isascii() else c for c in word)


def words(text):
    """(template word, word, whether it is a slot) of each word."""
    out, before = [], False
    for w in re.split(f"[{BLANKS}]+", text or ""):
        if w := w.strip(EDGE):
            x = low(w)
            number = NUMBER.fullmatch(x) is not None
            rest = w.encode()[len(w[0].encode()) :]
            if number:
                out.append(("<number>", x, True))
            elif before and x in d.UNITS:
                out.append(("<unit>", x, True))
            elif CAPITAL.match(w) and rest and rest[0] >= 97:
                out.append(("<name>", x, True))
            else:
                out.append((x, x, False))
            before = number
    return out


def cut(ws, length):
    """(place, what must be equal, slot values, whether slots are open) of each window."""
    for at in range(len(ws) - length + 1):
        part = ws[at : at + length]
        rich = sum(not slot for *_, slot in part) >= min(d.LITERALS, length)
        yield at, (rich, *(t if rich else w for t, w, _ in part)), [w for _, w, slot in part if slot], rich


def covered(doc, item):
    length = min(d.WINDOW, len(item))
    if not length:
        return 0
    own = list(cut(item, length))
    own = [x for x in own if x[3]] or own
    places = defaultdict(list)
    for at, key, slots, _ in cut(doc, length):
        places[key].append((at, slots))
    hits = sorted(((at - place, place, slots, other) for place, key, slots, _ in own for at, other in places[key]), key=lambda x: x[0])
    best, group = 0, []
    for k, hit in enumerate(hits):
        group.append(hit)
        if k + 1 == len(hits) or hits[k + 1][0] - hit[0] > d.NEAR:
            votes = Counter(pair for _, _, a, b in group for pair in zip(a, b, strict=True))
            usual = {x: max((n, y) for (z, y), n in votes.items() if z == x)[1] for x, _ in votes}
            partner = {min(x for x in usual if usual[x] == y): y for y in usual.values()}
            good = {place for _, place, a, b in group if all(partner.get(x) == y for x, y in zip(a, b, strict=True))}
            best, group = max(best, len(good) / len(own)), []
    return best


def asked_again(text, rng):
    """The text with each number and each later name replaced, the same one always by the same."""
    new = {}
    swap = lambda m: new.setdefault(m[0], str(rng.randrange(100, 999)))
    name = lambda m: new.setdefault(m[0], "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)).title())
    return re.sub(r"(?<= )[A-Z][a-z]+\b", name, re.sub(r"\b\d+\b", swap, text))


def test_equals_a_search_of_every_item_in_every_document(spark):
    rng = random.Random(7)
    folder = "/root/testdata/sf0.001"
    docs, bench = read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark").select("item_id", "text")
    rows, items = [tuple(r) for r in docs.collect()], {r.item_id: r.text for r in bench.collect()}
    more = [(900, "Ada walked 12 km from Oslo to Bergen and then 15 km back with Tom before 18:30 on day 7."), (901, "If Ben buys 4 kg of rice for $3 each and sells 2 kg to Eve, how much has Ben left?"), (902, "Who wrote Emma in 1815?"), (903, "one two"), (904, None)]
    bench = bench.unionByName(spark.createDataFrame(more, "item_id bigint, text string"))
    items |= dict(more)
    texts = [(10_000 + k, f"{rng.choice(rows)[1] or ''} {asked_again(t, rng)} {rng.choice(rows)[1] or ''}") for k, t in enumerate(t for t in items.values() if t)]
    texts += [(20_000, "If Ben buys 4 kg of rice for $3 each and sells 5 kg to Ben, how much has Eve left?"), (20_001, more[0][1].replace("Tom", "Oslo").replace("15", "12")), (20_002, "one two"), (20_003, "one  TWO."), (20_004, "Who wrote Faust in 1808?"), (20_005, "")]
    docs = docs.unionByName(spark.createDataFrame(texts, "doc_id bigint, text string"))
    rows += texts
    split = {i: words(t) for i, t in items.items()}
    wanted = {}
    for doc_id, text in rows:
        ws = words(text)
        wanted |= {(doc_id, i): round(c, 9) for i, item in split.items() if (c := covered(ws, item)) >= d.COVER}
    got = {(r.doc_id, r.item_id): round(r.covered, 9) for r in d.contaminated(docs, bench).select("doc_id", "item_id", F.col("covered").cast("double").alias("covered")).collect()}
    assert got == wanted
    planted = {(10_000 + k, i) for k, i in enumerate(i for i, t in items.items() if t)}
    assert len(planted & set(got)) >= 0.95 * len(planted)
