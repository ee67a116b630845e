"""Nulls, empty texts, repeats, empty tables and clashing columns for the other operators."""

from pyspark.sql import functions as F

from coterie.llm import chat, decontaminate, exact_dedup, language_id, line_dedup, lm_score, mixing, surrogates

SCHEMA = "doc_id bigint, text string, lang string, source string, keep_id string"
ROWS = [(1, "Same  text", "en", "a", "x"), (2, "Same\ttext", "en", "a", None), (2, "Same\ttext", "en", "a", None), (3, None, None, None, "x"), (4, "", "fr", "b", "x"), (None, "", "fr", None, "x")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def test_exact_groups(spark):
    got = sorted(((r.doc_id or -1), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs(spark)).collect())
    assert got == [(-1, 3, 3, False), (1, 1, 3, True), (2, 1, 3, False), (2, 1, 3, False), (3, 3, 3, True), (4, 3, 3, False)]
    left = exact_dedup.drop_exact_copies(docs(spark))
    assert left.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_lines(spark):
    rows = [(i, f"Common line\nown {i}\n", "", "", "") for i in range(10)] + [(10, None, "", "", ""), (11, "  COMMON LINE ", "", "", "")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.cut_lines(docs(spark, rows)).collect()}
    assert got[3] == (3, 1, "own 3\n") and got[10] == (1, 0, "") and got[11] == (1, 1, "")
    assert line_dedup.drop_common_lines(docs(spark, rows)).columns == docs(spark).columns
    assert line_dedup.cut_lines(docs(spark, [])).count() == 0


def test_mixing_reaches_targets_and_repeats_exactly(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 4}" if i % 11 else None, "") for i in range(2000)]
    one, two = ([(r.doc_id, r.copies) for r in mixing.copies(docs(spark, rows)).orderBy("doc_id").collect()] for _ in range(2))
    assert one == two and max(c for _, c in one) <= 3
    per = mixing.copies(docs(spark, rows)).groupBy("source_key").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r.t - r.target) <= 14 for r in per)
    assert mixing.copies(docs(spark, [])).count() == 0


def test_chat_round_trip_and_folding(spark):
    said = "<|end|> </s>[INST] <~|x [~/INST] \\ <s>"
    log = [("c", 0, 0, "message", "user", said), ("c", 1, 1, "message", "assistant", "dra"), ("c", 1, 2, "delta", None, "ft"), ("c", 1, 3, "regenerate", None, None), ("c", 1, 4, "delta", None, said), ("c", 0, 5, "edit", None, None), ("d", 0, 0, "delta", "user", "alone")]
    df = spark.createDataFrame(log, "conv_id string, turn int, seq int, kind string, role string, text string")
    got = {r.conv_id: [(t.role, t.text, t.loss) for t in r.t] for r in chat.format_log(df).select("conv_id", chat.parsed(F.col("formatted")).alias("t")).collect()}
    assert got == {"c": [("user", "", False), ("assistant", said, True)], "d": [("user", "alone", False)]}
    assert chat.format_log(df.limit(0)).count() == 0


def test_language_sample_is_bounded_and_first_by_hash(spark):
    rows = [(i, f"word{i} " * 70, "en" if i % 3 else "de", "", "") for i in range(300)]
    d = docs(spark, [*rows, (1000, None, "en", "", ""), (1001, "12", "de", "", ""), (None, "no key", "en", "", ""), (1002, "x", None, "", "")])
    got = language_id.sample(d, 10).collect()
    free = d.filter(~language_id.held_out(F.col("doc_id")) & F.col("text").rlike("[a-z]"))
    for lang in ("de", "en"):
        want = [r.text.split()[0] for r in free.filter(F.col("lang") == lang).orderBy(F.xxhash64("doc_id")).limit(10).collect()]
        found = [r.window.split() for r in got if r.lang == lang]
        assert sorted({w[0] for w in found}) == sorted(want) and len(found) == 2 * 10 and all(len(w) == 64 for w in found)
    assert language_id.sample(d.limit(0)).count() == 0 and language_id.learn(d.limit(0)) is None


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.predict(d, language_id.learn(d)).join(d.select("doc_id", "lang"), "doc_id").filter(language_id.held_out(F.col("doc_id")))
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    odd = language_id.predict(docs(spark, [(1, None, "en", "", ""), (2, "12 34", "en", "", "")]), None).collect()
    assert [(r.lang_pred, r.score) for r in odd] == [("und", 0.0)] * 2


def test_reparameterised_question_is_found_and_clean_text_left(spark):
    item = "A train leaves Boston at 9 and drives 60 km before it meets the truck that Anders sent out at 7 with 60 boxes of fresh fruit"
    again = "Before. A train leaves Denver at 8 and drives 75 km before it meets the truck that Sophie sent out at 5 with 75 boxes of fresh fruit"
    broken = again.replace("75 boxes", "31 boxes").replace("drives 75", "drives 75")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string")
    rows = [(1, again, "", "", ""), (2, "Quite another text about nothing in particular that shares no words with it", "", "", ""), (3, None, "", "", ""), (4, broken, "", "", "")]
    found = {r.doc_id: r.covered for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert found[1] > 0.9 and 2 not in found and 3 not in found and found.get(4, 0) < found[1]


def test_base_score_equals_brute_force(spark):
    import math
    import zlib
    from collections import Counter

    rows = [(i, ["the cat sat", "The dog sat down", None, "", "the cat ran off"][i % 5], "", "", "") for i in range(60)]
    train = [t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in [*(t or "").lower().split(), "\0"])
    n, v = sum(c.values()), len(c)
    out = language_id.held_out(F.col("doc_id"), 7, 2)
    for r in lm_score.score_texts(docs(spark, rows), ~out).collect():
        words = [*(rows[r.doc_id][1] or "").lower().split(), "\0"]
        assert r.n_tokens == len(words) and r.train_tokens == n and r.n_known == sum(w in c for w in words)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)) < 1e-9
        assert r.base_score <= r.score + 3 * len(words) and r.score <= 0


def test_surrogates_keep_form_distinctness_and_coreference(spark):
    t = "Mail joe.01@mail8.example.com or JOE.01@mail8.example.com, call +1 (917) 555-2670 or 1-917-555-2670, card 4111 1111 1111 1111, at 12.71.76.174, Maria."
    rows = [(1, t, "", "", ""), (2, "nothing here 12 apples", "", "", ""), (3, None, "", "", ""), (4, "joe.02@mail8.example.com", "", "", "")]
    got = {r.doc_id: r for r in surrogates.surrogate_texts(docs(spark, rows), b"k").collect()}
    new = got[1].text
    assert got[1].n_entities == 7 and got[2].text == rows[1][1] and got[3].text is None
    assert not any(x in new for x in ("joe.01", "JOE.01", "555-2670", "4111 1111", "12.71.76.174", "Maria"))
    a = [e for e in surrogates.entities(new)]
    by = {}
    for _, _, kind, value in a:
        by.setdefault(kind, set()).add(value)
    assert {k: len(v) for k, v in by.items()} == {"email": 1, "phone": 1, "card": 1, "ip": 1, "name": 1}
    assert surrogates._luhn(next(iter(by["card"]))) and got[4].text.lower() not in by["email"]


def test_short_items_with_slots_are_found_word_by_word(spark):
    bench = spark.createDataFrame([(1, "What is 7 times 8?"), (2, "Who wrote Faust in 1808 ?"), (3, "Compute 12 + 34 * 56 - 78 / 90")], "item_id bigint, text string")
    rows = [(1, "So. What is 7 times 8? Nobody knows", "", "", ""), (2, "they ask: Who wrote Faust in 1808 ? and more", "", "", ""), (3, "Compute 12 + 34 * 56 - 78 / 90", "", "", ""), (4, "What is 9 times 8? Who wrote Emma in 1815 ?", "", "", ""), (None, "What is 7 times 8?", "", "", ""), (1, "So. What is 7 times 8? Nobody knows", "", "", "")]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert found == {(1, 1), (2, 2), (3, 3), (None, 1)}
    left = decontaminate.drop_contaminated(docs(spark, rows), bench)
    assert [r.doc_id for r in left.collect()] == [4] and left.columns == docs(spark).columns
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0 and decontaminate.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def test_two_variants_of_a_question_in_one_document_are_judged_apart(spark):
    q = "if a box holds {} red balls and every child takes {} of them away from it how many are left in the box at the end"
    bench = spark.createDataFrame([(1, q.format("$3", "60%"))], "item_id bigint, text string")
    rows = [(1, f"{q.format('$9', '1%')} some words between them and then again we ask {q.format('$2', '5%')}", "", "", "")]
    assert [r.covered for r in decontaminate.contaminated(docs(spark, rows), bench).collect()] == [1.0]


def test_stages_keep_columns_of_any_name(spark):
    schema = "doc_id bigint, text string, lang string, source string, copy string, word string, mask string, maybe string, row string, _m_key string, gone string, label string, text_key string"
    rows = [(i, f"quite a few plain words stand here for document {i % 3} of them all", "en", f"s{i % 2}", *"abcdefghi") for i in range(6)] + [(None, None, None, None, *[None] * 9)]
    df = spark.createDataFrame(rows, schema)
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "2", "None"]
    mixed = mixing.mix(kept)
    assert mixed.columns == [*df.columns, "copy_"] and {r.copy for r in mixed.collect()} <= {"a", None}
    assert line_dedup.drop_common_lines(kept, 2).columns == df.columns
    assert language_id.keep_identified(kept, None).count() == 0


def test_mix_takes_the_copies_due_to_repeated_and_missing_ids(spark):
    rows = [(7 if i % 2 else None, f"word{i % 5} two three", "en", "a" if i % 3 else None, str(i)) for i in range(40)] + [(100 + i, "x y", "en", f"s{i % 4}", "") for i in range(60)]
    d = docs(spark, rows)
    due = mixing.copies(d).groupBy("source_key", "size").agg(F.sum("copies").alias("n")).collect()
    taken = mixing.mix(d).withColumn("source_key", mixing.source_key(F.col("source"))).groupBy("source_key", F.size(F.split("text", " ")).cast("long").alias("size")).count().collect()
    assert sorted(map(tuple, taken)) == sorted((r.source_key, r["size"], r.n) for r in due if r.n)
    per_row = mixing.mix(d).groupBy("doc_id", "text", "source", "keep_id").count().collect()
    assert max(r["count"] for r in per_row) <= 3 * max(1, sum(1 for r in rows if r[4] == ""))
    assert mixing.mix(d).filter("keep_id != ''").groupBy("keep_id").count().filter("count > 3").count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    d = docs(spark, [(i, f"Common\nown {i}", "en", "a", "k") for i in range(12)])
    for c in ("_p_key", "_p_lines", "_p_at", "_p_doc", "row", "text_key", "keys"):
        d = d.withColumn(c, F.lit("keep"))
    got = line_dedup.drop_common_lines(d)
    assert got.columns == d.columns
    assert {(r.doc_id, r.text) for r in got.collect()} == {(i, f"own {i}") for i in range(12)}
    assert got.filter(" and ".join(f"{c} = 'keep'" for c in ("_p_key", "_p_lines", "_p_at", "_p_doc", "row", "text_key", "keys"))).count() == 12
