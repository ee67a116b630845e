"""Numbers that stand beside each other, and names in any case."""

import random
import re

import pytest

from coterie.llm import surrogates


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("415-555-1234 415-555-9876", [("phone", "4155551234"), ("phone", "4155559876")]),
        ("4111111111111111 2024", [("card", "4111111111111111")]),
        ("2024 4111 1111 1111 1111", [("card", "4111111111111111")]),
        ("192.168.100.200 8080", [("ip", "192.168.100.200")]),
        ("192.168.10.20 443", [("ip", "192.168.10.20")]),
        ("917-555-2670. 2 people", [("phone", "9175552670")]),
        ("2021-05-04 415-555-1234", [("phone", "4155551234")]),
        ("+44 20 7946 0958 2021 1234", [("phone", "442079460958")]),
        ("415-555-1234 4111 1111 1111 1111 10.1.2.3", [("phone", "4155551234"), ("card", "4111111111111111"), ("ip", "10.1.2.3")]),
        ("MARIA and maria, ΓΙΏΡΓΟΣ", [("name", "maria"), ("name", "maria"), ("name", "γιώργος")]),
        ("at 2024-01-15 10:20:33 or 15.01.2024, ISBN 978-0-306-40615-7", []),
        ("2024-01-15 415-555-1234", [("phone", "4155551234")]),
        ("x" * 70 + "@mail.example.com", [("email", "x" * 70 + "@mail.example.com")]),
        ("12 apples, 3.1415926 and 300.300.300.300", []),
        ("Dr. Ada Lovelace met Maria Robertson; Anna. The end", [("surname", "ada"), ("surname", "lovelace"), ("name", "maria"), ("surname", "robertson"), ("name", "anna")]),
        ("Frau Müller, Мария Иванова", [("surname", "müller"), ("name", "мария"), ("surname", "иванова")]),
        ("tax 123-45-6789, not 000-45-6789x", [("tax", "123456789")]),
        ("call 4155551234 or Phone: 4155551235, order 4155551236", [("phone", "4155551234"), ("phone", "4155551235")]),
        ("DE89 3704 0044 0532 0130 00 but not DE88370400440532013000", [("account", "DE89370400440532013000")]),
        ("2001:db8::ff00:42:8329 at 10:20:33 in std::vector or a::b", [("ipv6", "2001:db8::ff00:42:8329")]),
    ],
)
def test_each_entity_is_found_beside_others(text, wanted):
    assert [x[2:] for x in surrogates.entities(text)] == wanted


def test_names_keep_their_case():
    assert surrogates.rendered("name", "MARIA", "anna") == "ANNA" and surrogates.rendered("name", "maria", "anna") == "anna" and surrogates.rendered("name", "Maria", "anna") == "Anna"


def test_short_formats_are_widened_until_no_surrogate_is_an_entity(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{a}@{b}.com") for i, (a, b) in enumerate((a, b) for a in letters for b in letters)]
    got = surrogates.surrogate_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), b"k").collect()
    texts = {r.text for r in got}
    assert len(got) == len(texts) == 676 and not texts & {t for _, t in rows}


def test_a_key_is_needed_and_decides(spark):
    df = spark.createDataFrame([(1, "joe.01@mail8.example.com")], "doc_id bigint, text string")
    with pytest.raises(ValueError):
        surrogates.surrogate_texts(df, b"")
    assert len({surrogates.surrogate_texts(df, k).first().text for k in (b"k", b"l")}) == 2


def test_surrogates_keep_what_their_format_needs():
    new = lambda kind, x, k=0: surrogates.surrogate(kind, x, k, b"k")
    local, domain = new("email", "joe@mail.janedoe.com").split("@")
    assert domain.endswith(".com") and not {"joe", "mail", "janedoe"} & {local, *domain.split(".")}
    assert re.fullmatch(r"[a-z]{3}@[a-z]{4}\.com", new("email", "bea@cafe.com")) and new("email", "x@abc.co.uk").endswith(".co.uk")
    assert new("ip", "10.1.2.3").startswith("10.") and new("ip", "192.168.1.2").startswith("192.168.") and not surrogates._PRIVATE.match(new("ip", "8.8.8.8"))
    account = new("account", "GB82WEST12345698765432")
    assert surrogates._account_rest(account) == 1 and re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", account)
    for kind, x in (("tax", "123456789"), ("ipv6", "2001:db8::ff00:42:8329"), ("surname", "robertson"), ("surname", "иванова")):
        assert len(new(kind, x)) == len(x) and new(kind, x) != x
    assert [x[2] for x in surrogates.entities(new("ipv6", "2001:db8::ff00:42:8329"))] == ["ipv6"]


def test_a_planted_corpus_keeps_nothing_planted_and_clean_words(spark):
    rng = random.Random(4)
    clean = "the quick report covers rivers, 12 bridges and 3.5 km of roads built by 1987".split()
    some = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def planted(i):
        body = some(18)
        return [
            f"user{i}x@host{some(4)}.net", f"+1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{some(4)}", f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
            f"DE{98 - surrogates._account_rest('DE00' + body):02d}{body}", f"2001:db8:{rng.randrange(10, 99)}::{rng.randrange(10, 99)}", f"{rng.randrange(11, 99)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}",
        ]

    people = [planted(i) for i in range(40)]
    rows, left = [], {}
    for i in range(200):
        words, marked = [clean[(i + k) % len(clean)] for k in range(60)], rng.sample(range(60), 4)
        for at in marked:
            words[at] = f"<{rng.choice(rng.choice(people))}>" if i % 4 else words[at]
        rows.append((i, " ".join(words)))
        left[i] = re.sub(r"<[^>]*>", "<>", rows[-1][1])
    got = {r.doc_id: r.text for r in surrogates.surrogate_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), b"k").collect()}
    every = {x for p in people for x in p}
    assert not any(x in t for t in got.values() for x in every)
    assert {i: re.sub(r"<[^>]*>", "<>", t) for i, t in got.items()} == left
    pairs = {(a, b) for i, t in rows for a, b in zip(re.findall(r"<([^>]*)>", t), re.findall(r"<([^>]*)>", got[i]), strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
