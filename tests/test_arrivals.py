"""Arrivals over several batches, a replay and a restart equal one clustering of all rows that came."""

import json
import random

from coterie.operators.cluster import connected_components
from coterie.operators.graph import star_edges
from coterie.streaming.arrivals import arrival_status, judge_touched, membership_of, score_arrivals
from coterie.streaming.index import ComponentIndex


def arrive(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"id": i, "value": v, "ts": "2024-01-01T00:00:00Z"}) for i, v in rows))


def run(spark, tmp_path, known):
    got = {}

    def report(df, number):
        got[number] = sorted((r.cluster_key, r.member, r.is_new) for r in membership_of(df).collect())

    query = score_arrivals(spark, str(tmp_path / "in"), "id bigint, value string, ts timestamp", known, report, str(tmp_path / "check"), str(tmp_path / "store"), compact_every=2)
    assert query.awaitTermination(240)
    return [got[n] for n in sorted(got)]


def test_a_restart_remembers_earlier_batches(spark, tmp_path):
    known = spark.createDataFrame([(1, "a"), (2, "a"), (8, "z"), (9, "z")], "id bigint, value string")
    arrive(tmp_path / "in", "1.json", [(3, "a"), (3, "b"), (3, "b")])
    assert run(spark, tmp_path, known) == [[(1, 1, False), (1, 2, False), (1, 3, True)]]
    arrive(tmp_path / "in", "2.json", [(4, "b"), (3, "b")])
    assert run(spark, tmp_path, known) == [[(1, 1, False), (1, 2, False), (1, 3, False), (1, 4, True)]]
    arrive(tmp_path / "in", "3.json", [(0, "z"), (0, "b")])
    assert run(spark, tmp_path, known) == [[(0, 0, True), (0, 1, False), (0, 2, False), (0, 3, False), (0, 4, False), (0, 8, False), (0, 9, False)]]
    assert run(spark, tmp_path, known) == []


def test_five_batches_a_replay_and_compaction_equal_one_clustering(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(rnd.randrange(90), f"v{rnd.randrange(70)}") for _ in range(150)] + [(200, " "), (201, None)]
    parts = [rows[:60], *[rows[60 + 18 * k : 78 + 18 * k] for k in range(5)]]
    frame = lambda r: spark.createDataFrame(r or [], "id bigint, value string")
    index = ComponentIndex(spark, str(tmp_path / "index"), "bigint", buckets=8)
    index.build(frame(parts[0]))
    whole = lambda upto: sorted(map(tuple, connected_components(star_edges(frame(sum(parts[:upto], [])))).collect()))
    got = lambda upto: sorted(map(tuple, index.membership(upto).select("cluster_key", "member").collect()))
    assert got(0) == whole(1)
    for n in range(5):
        touched = index.absorb(frame(parts[n + 1]), n)
        if n == 2:  # the same batch again, as after a failure
            again = index.absorb(frame(parts[n + 1]), n)
            assert sorted(map(tuple, again.collect())) == sorted(map(tuple, touched.collect()))
        if n == 3:
            index.compact(n)
        expected = [(c, m) for c, m in whole(n + 2)]
        assert got(n + 1) == expected
        seen = {i for i, v in parts[n + 1] if v and v.strip()}
        labels = {c for c, m in expected if m in seen}
        assert sorted((r.cluster_key, r.member) for r in membership_of(touched).collect()) == [(c, m) for c, m in expected if c in labels]
        assert {r.member for r in membership_of(touched).filter("is_new").collect()} == {m for _, m in expected if m in seen}
    assert sorted({(r.id, r.value) for r in index._read("rows", 5).collect()}) == sorted({(i, v) for i, v in rows if v and v.strip()})


def test_touched_components_are_judged(spark, tmp_path):
    index = ComponentIndex(spark, str(tmp_path / "index"), "bigint", buckets=4)
    index.build(spark.createDataFrame([(1, "d1"), (7, "d9"), (8, "d9")], "id bigint, value string"))
    touched = index.absorb(spark.createDataFrame([(2, "d1"), (3, "d1"), (5, "d5")], "id bigint, value string"), 0)
    at = lambda days: f"2024-01-{days:02d} 00:00:00"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    users = (1, 2, 3, 5, 7, 8)
    ts = lambda df, *cs: df.withColumns({c: df[c].cast("timestamp") for c in cs})
    device = frame([(u, "d1") for u in (1, 2, 3)] + [(7, "d9"), (8, "d9")], "member bigint, value string")
    signup = ts(frame([(u, at(1)) for u in users], "user_id bigint, signup_ts string"), "signup_ts")
    claim = ts(frame([(u, at(2)) for u in users], "user_id bigint, claim_ts string"), "claim_ts")
    sessions = ts(frame([(u, at(1)) for u in users], "user_id bigint, ts string"), "ts")
    orders = frame([(u, 10.0) for u in users], "user_id bigint, order_value double")
    judged = judge_touched(touched, "shared_device", device, device.limit(0), signup, claim, sessions, orders)
    (row,) = judged.collect()
    assert (row.cluster_key, row["size"], row.n_edges, row.rule, row.flagged) == (1, 3, 3, "device", True)
    sets = frame([("ring", 2), ("ring", 3), ("lone", 5)], "set_id string, member bigint")
    assert {(r.set_id, r.cluster_key, r.status) for r in arrival_status(touched, judged, sets).collect()} == {("ring", 1, "flagged"), ("lone", None, "not_clustered")}


def test_merged_components_write_members_and_no_rows(spark, tmp_path):
    index = ComponentIndex(spark, str(tmp_path / "index"), "bigint", buckets=4, value_type="bigint")
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, value bigint")
    index.build(frame([(i, 7) for i in range(10, 40)] + [(i, 100 + i) for i in range(10, 40)] + [(1, 8)]))
    touched = index.absorb(frame([(1, 7), (10, 7), (50, None)]), 0)
    assert touched.schema["value"].dataType.simpleString() == "bigint"
    rows = {(r.cluster_key, r.id, r.value, r.is_new) for r in touched.collect()}
    assert len(rows) == touched.count() == 62 and {r[0] for r in rows} == {1} and {r[1] for r in rows if r[3]} == {1, 10}
    assert index._read("rows", 1).filter("batch = 0").select("id", "value").collect() == [(1, 7)]
    assert {(r.cluster_key, r.member) for r in index.membership(1).collect()} == {(1, i) for i in [1, *range(10, 40)]}
