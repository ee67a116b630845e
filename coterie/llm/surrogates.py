"""Personal data replaced by keyed, type-consistent surrogates.

Found are e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment card and
bank account numbers (IBAN, by its check digits), tax numbers of the form 3-2-4, secrets
(``password=`` and the like, access keys), given names of a lexicon, in any case, and
other names by their context: one or two capitalised words after a title, and a capitalised word after
a given name of the lexicon. A run of numbers is read by the grammar of each type in that order:
addresses, cards, phones; what is left of it is a phone or card by its digits. Digits without
separators are a phone after a word for one. Names that neither stand in the lexicon nor in
such a context are not found.
Every distinct entity (type and canonical form: digits of a phone or card, lower
case of an address or name, letters and digits of an account) gets one surrogate from a keyed hash, so all its
mentions, however written, are replaced alike. A surrogate keeps the form: kinds
of characters, separators, a card's first digit and check digit, a phone's
country code, an account's country with right check digits, a private address's network,
the public suffix of a domain, all of whose other labels change; given names keep gender, script and case, by a
keyed permutation of the lexicon's names of that gender and script; other names keep length, script and case.

A collision check follows: of entities with one surrogate all but the first, and
entities whose surrogate occurs as an entity, draw again, until none is left.
A format with too few free values is widened after some draws: surrogates of addresses and secrets grow.
Texts are searched once and written with what was found; those without entities
then pass straight through, and only texts with some are shuffled.

The key is the caller's and has no default: who knows it can recompute surrogates.
Dates and ISBNs are no numbers of a person and stay.

A null text stays null. Rows that repeat a doc_id, or have none, are each
rewritten by their own text. Texts of any length are read whole. Extra columns are ignored.
"""

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.llm.common import read, stored, text_key

ATTEMPTS, WIDEN = 64, 8  # draws at most, and after how many a format is widened by a character
# Given names by gender and script.
NAMES = {
    ("f", "latin"): ["Maria", "Anna", "Emma", "Sophie", "Laura", "Julia", "Sarah", "Olivia", "Isabel", "Claire", "Elena", "Charlotte"],
    ("m", "latin"): ["James", "Peter", "Thomas", "Michael", "Lucas", "Daniel", "Carlos", "Pierre", "Johann", "William", "Antonio", "Robert"],
    ("f", "cyrillic"): ["Мария", "Анна", "Елена", "Ольга", "Наталья", "Татьяна"],
    ("m", "cyrillic"): ["Иван", "Сергей", "Дмитрий", "Алексей", "Николай", "Михаил"],
    ("f", "greek"): ["Μαρία", "Ελένη", "Κατερίνα", "Σοφία"],
    ("m", "greek"): ["Γιώργος", "Νίκος", "Δημήτρης", "Κώστας"],
}
# Titles before a name, words before a phone number, second-level labels that belong to a public suffix.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Sr", "Sra", "Madame", "Monsieur", "Mme"]
PHONE_WORDS = ["call", "phone", "telephone", "tel", "mobile", "cell", "fax", "whatsapp"]
SUFFIXES = ["ac", "co", "com", "edu", "gov", "net", "org"]
# Letters by script, consonants and vowels, for names outside the lexicon.
LETTERS = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρτφ", "αειου")}
GROUP = {n.lower(): (g, n) for g, names in NAMES.items() for n in names}

_LOCAL, _DOMAIN = re.compile(r"[\w.+%-]"), re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_DIGITS = re.compile(r"(?<![\w.])\+?\(?\d[\d().\- ]{5,24}\d(?!\w)")
_SECRET = re.compile(r"(?<!\w)(?:AKIA[0-9A-Z]{16}(?!\w)|(?:password|passwd|secret|token|api_key)[=:]\s?(?P<v>[^\s,;]{6,}))")
_NAME = re.compile(r"(?<!\w)(?:" + "|".join(sorted((n for x in NAMES.values() for n in x), key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
_FOLDED = {n.casefold(): n.lower() for x in NAMES.values() for n in x}
# What every writing of a name has in lower case: all but a last sigma, whose form depends on what follows.
_PLAIN = [n.rstrip("ς") for n in _FOLDED.values()]
# A run of numbers of any length, and what has a grammar of its own inside it.
_RUN = re.compile(r"(?<![\w.])\+?\(?\d[\d().\- ]{5,}\d(?!\w)")
_ADDRESS = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")
_CARD = re.compile(r"(?<![\w.+])(?=(\d{13,19}(?!\w|\.\d)|\d{4}([ -])\d{4}\2\d{4}\2\d{4}(?!\w)|\d{4}([ -])\d{6}\3\d{4,5}(?!\w)))")
_LONG = re.compile(r"(?<![\w.+])\d{4}([ -])\d{4}\1\d{4}\1\d{4}\1\d{1,3}(?!\w)")
_PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?|\d{1,3}[.-]|1 )?(?:\(\d{3}\)[ .-]?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}(?!\w)")
_GROUP = re.compile(r"[+(]{0,2}\d+")
_TAX = re.compile(r"(?<![\w.+-])(?!000|666|9)\d{3}([- ])(?!00)\d{2}\1(?!0000)\d{4}(?![\w-])")
_CALLED = re.compile(r"(?<!\w)(?:" + "|".join(PHONE_WORDS) + r")(?:[.:]{1,2} ?| (?:me |us )?(?:at |on )?)(\d{9,15})(?![\w-])(?!\.\d)", re.IGNORECASE)
_SIX = re.compile(r"(?<![\w:.])(?=[0-9a-fA-F:]*\d)[0-9a-fA-F]{1,4}(?::{1,2}[0-9a-fA-F]{1,4}){2,7}(?:::)?(?![\w:])")
_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)")
_CAPITAL = r"[A-ZÀ-ÞΑ-ΩА-Я][a-zß-ÿα-ωά-ώа-яё]+"
_TITLED = re.compile(r"(?<!\w)(?:" + "|".join(TITLES) + rf")\.? (?P<a>{_CAPITAL})(?: (?P<b>{_CAPITAL}))?(?!\w)")
_AFTER = re.compile(rf" (?P<a>{_CAPITAL})(?!\w)")
_PRIVATE = re.compile(r"(?:10|127)\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.")
# Dates, with a time's hour, and ISBNs.
_OTHER = re.compile(r"(?<![\w.+-])(?:(?:19|20)\d\d([-.])\d\d\1\d\d(?: \d\d)?|\d{1,2}([-.])\d{1,2}\2(?:19|20)\d\d(?: \d\d)?|97[89]([- ]?)\d{1,5}\3\d{1,7}\3\d{1,6}\3\d)(?![\w-])")
_IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}\Z")


def _luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def _account_rest(account: str) -> int:
    """An IBAN's remainder, 1 if its check digits are right."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _is_six(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


def _numeric(mention: str) -> tuple[str, str] | None:
    digits = re.sub(r"\D", "", mention)
    if _IP.match(mention):
        return ("ip", mention) if all(int(x) < 256 for x in mention.split(".")) else None
    if 13 <= len(digits) <= 19 and not re.search(r"[().+]", mention):
        return "card", digits
    if 9 <= len(digits) <= 15 and re.search(r"[+() -]", mention):
        return "phone", digits
    return None


def _numbers(text: str, start: int, end: int) -> list[tuple[int, int, str, str]]:
    """Addresses, cards and phones of a run of numbers: what has a grammar of its own first, then what is left."""
    out: list[tuple[int, int, str, str]] = []

    def take(a: int, b: int, kind: str, canonical: str) -> None:
        if all(b <= x[0] or a >= x[1] for x in out):
            out.append((a, b, kind, canonical))

    for m in _ADDRESS.finditer(text, start, end):
        if kind := _numeric(m[0]):
            take(m.start(), m.end(), *kind)
    for m in _TAX.finditer(text, start, end):
        take(m.start(), m.end(), "tax", re.sub(r"\D", "", m[0]))
    cards = [(*m.span(1), re.sub(r"\D", "", m[1])) for m in _CARD.finditer(text, start, end)]
    longer = [(*m.span(), re.sub(r"\D", "", m[0])) for m in _LONG.finditer(text, start, end)]
    # Groups of four can be read from several places: first those with a right check digit, others after the phones.
    for a, b, digits in sorted(x for x in [*cards, *longer] if _luhn(x[2])):
        take(a, b, "card", digits)
    for m in _PHONE.finditer(text, start, end):
        if re.search(r"[+() .-]", m[0]):
            take(m.start(), m.end(), "phone", re.sub(r"\D", "", m[0]))
    skipped = [m.span() for m in _OTHER.finditer(text, start, end)]
    out += [(a, b, "", "") for a, b in skipped if all(b <= x[0] or a >= x[1] for x in out)]
    groups = list(_GROUP.finditer(text, start, end))
    for i, g in enumerate(groups):  # after a country code: the longest number that is a phone
        if g[0].startswith("+"):
            for h in reversed(groups[i:]):
                if (kind := _numeric(text[g.start() : h.end()])) and "+" not in text[g.start() + 1 : h.end()]:
                    take(g.start(), h.end(), *kind)
                    break
    for a, b, digits in cards:
        take(a, b, "card", digits)
    at = start
    for a, b in [*sorted(x[:2] for x in out), (end, end)]:
        for m in _DIGITS.finditer(text, at, a):
            if kind := _numeric(m[0]):
                take(m.start(), m.end(), *kind)
        at = b
    return [x for x in out if x[2]]


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical) of each entity, in order, none overlapping."""
    found = []
    at = text.find("@")
    while at >= 0:
        start, domain = at, _DOMAIN.match(text, at + 1)
        while domain and start and _LOCAL.match(text[start - 1]):
            start -= 1
        if domain and start < at:
            found.append((start, domain.end(), "email", text[start : domain.end()].lower()))
        at = text.find("@", at + 1)
    for m in _SECRET.finditer(text):
        s, e = m.span("v") if m["v"] else m.span()
        found.append((s, e, "secret", text[s:e]))
    for m in _ACCOUNT.finditer(text):
        account = m[0].replace(" ", "")
        if 15 <= len(account) <= 34 and _account_rest(account) == 1:
            found.append((*m.span(), "account", account))
    if text.count(":") > 1:
        found += [(*m.span(), "ipv6", m[0].lower()) for m in _SIX.finditer(text) if _is_six(m[0])]
    found += [(*m.span(1), "phone", m[1]) for m in _CALLED.finditer(text)]
    for m in _TITLED.finditer(text):
        found += [(*m.span(g), "surname", m[g].lower()) for g in "ab" if m[g] and m[g].casefold() not in _FOLDED]
    for m in _RUN.finditer(text):
        found += _numbers(text, *m.span())
    low = text.lower()
    if len(low) > len(text) or any(n in low for n in _PLAIN):  # few texts have a name, and looking for one is faster than the expression
        for m in _NAME.finditer(text):
            if m[0].casefold() in _FOLDED:
                found.append((m.start(), m.end(), "name", _FOLDED[m[0].casefold()]))
                after = _AFTER.match(text, m.end()) if m[0].istitle() else None
                if after and after["a"].casefold() not in _FOLDED:
                    found.append((*after.span("a"), "surname", after["a"].lower()))
    out: list = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


class _Stream:
    """Numbers from the keyed hash of an entity and attempt."""

    def __init__(self, key: bytes, *of: object):
        self.key, self.of, self.left, self.k = key, "\x1f".join(map(str, of)), b"", 0

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, f"{self.of}\x1f{self.k}".encode(), hashlib.sha256).digest()
            self.k += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x % n


def _shaped(text: str, r: _Stream) -> str:
    hexadecimal = len(text) >= 6 and re.fullmatch(r"(?=.*\d)(?=.*[a-f])[0-9a-f]+", text) is not None
    pick = lambda c: "0123456789abcdef"[r.below(16)] if hexadecimal else chr(48 + r.below(10)) if c.isdigit() else chr(97 + r.below(26)) if c.islower() else chr(65 + r.below(26)) if c.isupper() else c
    return "".join(map(pick, text))


def surrogate(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    """The canonical surrogate of an entity."""
    r = _Stream(key, kind, canonical, attempt)
    more = "".join(chr(97 + r.below(26)) for _ in range(attempt // WIDEN))
    if kind == "email":
        local, _, domain = canonical.partition("@")
        labels = domain.split(".")
        keep = 2 if len(labels) > 2 and labels[-2] in SUFFIXES else 1
        return f"{_shaped(local, r)}{more}@{'.'.join([*(_shaped(x, r) for x in labels[:-keep]), *labels[-keep:]])}"
    if kind == "ip":
        while True:
            network = _PRIVATE.match(canonical)
            rest = 4 - network[0].count(".") if network else 4
            value = (network[0] if network else "") + ".".join(str(r.below(256)) for _ in range(rest))
            if network or not _PRIVATE.match(value):
                return value
    if kind == "ipv6":
        digits = "0123456789abcdef"
        drawn = "".join(c if c == ":" else digits[r.below(16)] if i and canonical[i - 1] != ":" else digits[1 + r.below(15)] for i, c in enumerate(canonical))
        return drawn if re.search(r"\d", drawn) else re.sub(r"[a-f](?=[^a-f]*\Z)", str(1 + r.below(9)), drawn, count=1)
    if kind == "account":
        body = "".join(str(r.below(10)) if c.isdigit() else chr(65 + r.below(26)) for c in canonical[4:])
        return f"{canonical[:2]}{98 - _account_rest(f'{canonical[:2]}00{body}'):02d}{body}"
    if kind == "tax":
        area = 1 + r.below(898)
        return f"{area + (area >= 666):03d}{1 + r.below(99):02d}{1 + r.below(9999):04d}"
    if kind == "surname":
        script = "greek" if "α" <= unicodedata.normalize("NFD", canonical)[0] <= "ω" else "cyrillic" if "а" <= canonical[0] <= "я" else "latin"
        sounds = LETTERS[script]
        drawn = ""
        while not drawn or drawn in GROUP:
            turn = r.below(2)
            drawn = "".join(sounds[(k + turn) % 2][r.below(len(sounds[(k + turn) % 2]))] for k in range(len(canonical) + attempt // WIDEN))
        return drawn
    if kind == "phone":
        keep = max(0, len(canonical) - 10)
        return canonical[:keep] + str(2 + r.below(8)) + "".join(str(r.below(10)) for _ in canonical[keep + 1 :])
    if kind == "card":
        body = canonical[0] + "".join(str(r.below(10)) for _ in canonical[1:-1])
        wanted = _luhn(canonical)
        return next(body + str(d) for d in range(10) if _luhn(body + str(d)) == wanted)
    if kind == "name":
        group, _ = GROUP[canonical]
        names = NAMES[group]
        # A keyed order of the group; each name is replaced by the one after it, so no two share one and none stays.
        order = sorted(names, key=lambda n: hmac.new(key, n.encode(), hashlib.sha256).digest())
        return order[(order.index(GROUP[canonical][1]) + 1) % len(order)].lower()
    prefix = 4 if canonical.startswith("AKIA") else 0
    return canonical[:prefix] + _shaped(canonical[prefix:], r) + more


def rendered(kind: str, mention: str, value: str) -> str:
    """A canonical surrogate in the form of a mention."""
    if kind == "account":
        letters = iter(value)
        return "".join(c if c == " " else next(letters) for c in mention)
    if kind == "ipv6":
        return value.upper() if mention.isupper() else value
    if kind == "surname":
        return value.title()
    if kind in ("phone", "card", "tax"):
        digits = iter(value)
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "name":
        name = GROUP[value][1]
        return name.upper() if mention.isupper() else name.lower() if mention.islower() else name
    if kind == "email" and len(value) == len(mention):
        return "".join(v.upper() if c.isupper() else v for c, v in zip(mention, value, strict=True))
    return value


SPANS = "array<struct<start:int,end:int,kind:string,canonical:string>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("canonical", pa.string())]))


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text, spans) of every row; offsets in code points."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("start", "end", "kind", "canonical"), x, strict=True)) for x in entities(t)] if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _SPAN_TYPE)], names=[*batch.schema.names, "spans"])

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(find, f"doc_id bigint, text_key bigint, text string, spans {SPANS}")


def surrogate_table(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, value) for the distinct entities of (kind, canonical): no two of a kind share a value, none is an entity."""

    @F.pandas_udf("string")
    def draw(kind: pd.Series, canonical: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(*x, key) for x in zip(kind, canonical, attempt, strict=True)], dtype=object)

    open_ = stored(found.distinct().withColumn("attempt", F.lit(0)))
    known = open_.select(F.col("kind").alias("k"), F.col("canonical").alias("c"))
    done: DataFrame | None = None
    for _ in range(ATTEMPTS):
        drawn = stored(open_.withColumn("value", draw("kind", "canonical", "attempt")))
        # Names are permuted within their group, where every value is an entity too and none can collide.
        clash = drawn.join(known.hint("shuffle_hash"), (F.col("kind") == F.col("k")) & (F.col("value") == F.col("c")) & (F.col("kind") != "name"), "left").withColumn("taken", F.col("c").isNotNull()).drop("k", "c")
        if done is not None:
            before = done.select(F.col("kind").alias("k"), F.col("value").alias("v"))
            clash = clash.join(before.hint("shuffle_hash"), (F.col("kind") == F.col("k")) & (F.col("value") == F.col("v")), "left").withColumn("taken", F.col("taken") | F.col("v").isNotNull()).drop("k", "v")
        first = clash.filter("not taken").groupBy("kind", "value").agg(F.min("canonical").alias("canonical"))
        settled = stored(first)
        done = settled if done is None else done.unionByName(settled)
        again = drawn.join(settled.select("kind", "canonical").hint("shuffle_hash"), ["kind", "canonical"], "left_anti")
        open_ = stored(again.select("kind", "canonical", (F.col("attempt") + 1).alias("attempt")))
        if open_.isEmpty():
            return done
    raise RuntimeError(f"surrogates still collide after {ATTEMPTS} attempts: the format has too few values")


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            parts, at = [], 0
            for s in sorted(spans, key=lambda s: s["start"]):
                parts += [text[at : s["start"]], rendered(s["kind"], text[s["start"] : s["end"]], s["value"])]
                at = s["end"]
            out.append("".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(out, pa.string()), batch.column("n_entities")], names=["doc_id", "text_key", "text", "n_entities"])


def surrogate_texts(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key (of the text before), text, n_entities."""
    if not key:
        raise ValueError("surrogates need a key")
    found = stored(mentions(docs).withColumn("some", F.size("spans") > 0), "some")
    some, none = found.filter("some").drop("some"), found.filter("not some")
    spans = some.select("doc_id", "text_key", F.explode("spans").alias("s")).select("doc_id", "text_key", "s.*").distinct()
    table = stored(surrogate_table(spans.select("kind", "canonical"), key))
    filled = spans.join(table.hint("merge"), ["kind", "canonical"])
    each = filled.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "end", "kind", "value")).alias("spans"), F.count(F.lit(1)).alias("n_entities"))
    each = stored(each.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text"), "spans", "n_entities"))
    texts = some.drop("spans")
    joined = texts.join(each.hint("shuffle_hash"), texts["doc_id"].eqNullSafe(each["_doc"]) & (texts["text_key"] == each["_text"]))
    changed = joined.select("doc_id", "text_key", "text", "spans", "n_entities").mapInArrow(_replace, "doc_id bigint, text_key bigint, text string, n_entities bigint")
    return changed.unionByName(none.select("doc_id", "text_key", "text", F.lit(0).cast("long").alias("n_entities")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is this query's own, for comparable results; nobody else should use it."""
    return surrogate_texts(read(spark, sf_dir, "documents"), b"op4 on the test tables").select("doc_id", "text", "n_entities")
