"""All queries of the entity-graph operators, with their SQL.

Names carry the operator's number in the survey. Array results are joined to
text so that both engines print them alike. Trained and parallel-search results
have no SQL and are tested by their invariants.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coterie.operators import cluster, derive, evaluate, factored, features, graph, reports, rules, scoring, whatif
from coterie.operators.detect import detect
from coterie.plans.bindings import PRELUDE, Tables, day_of, evaluated
from coterie.sources import sinks, tables
from coterie.functions.storage import shared_folder, stored
from coterie.streaming.arrivals import judge_touched, membership_of
from coterie.streaming.index import ComponentIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = PRELUDE + sql


def text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers linked by one part on one ship day: groups with size, density, order span and order CV."""
    b = Tables(spark, sf_dir)
    edges = stored(b.strong())
    members = stored(cluster.connected_components(edges))
    span = members.join(b.orders().withColumnRenamed("user_id", "member"), "member", "left").groupBy("cluster_key").agg(F.datediff(F.max("order_date"), F.min("order_date")).cast("long").alias("order_span_days"))
    out = features.density(edges, members).join(span, "cluster_key").join(features.order_values(members, b.orders()), "cluster_key")
    return out.orderBy(F.desc("size"), "cluster_key")


QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = PRELUDE + """, es AS (SELECT a.cluster_key, count(*) AS n FROM strong e JOIN comp a ON e.src = a.member GROUP BY 1),
sp AS (SELECT cluster_key, date_diff('day', min(o_orderdate), max(o_orderdate)) AS order_span_days FROM comp LEFT JOIN orders ON member = o_custkey GROUP BY 1)
SELECT cluster_key, size, n AS n_edges, round(n / (size * (size - 1) / 2), 4) AS edge_density, order_span_days, n_orders, order_value_cv FROM sz JOIN es USING (cluster_key) JOIN sp USING (cluster_key) JOIN f07 USING (cluster_key)"""

# A: sources and cleaning. Every 97th event gets a bad timestamp, every 89th a negative value, every 83rd no user.
BAD = {"user": "case when event_id % 83 = 0 then '' else cast(user_id as string) end as uid", "ts": "case when event_id % 97 = 0 then 'not-a-date' else cast(ts as string) end as ts", "value": "case when event_id % 89 = 0 then '-999' else cast(value as string) end as value"}


def raw(b: Tables) -> DataFrame:
    return b.t("events").selectExpr("event_id", *BAD.values(), "event_type")


def written(b: Tables, frames: dict[str, DataFrame]) -> str:
    """A new folder with each frame as CSV files with a header, as a caller hands them over."""
    folder = shared_folder(b.spark)
    for name, df in frames.items():
        df.write.option("header", True).csv(f"{folder}/{name}.csv")
    return folder


def _entity_tables(b: Tables) -> dict[str, DataFrame]:
    """The five activity tables from customers, events and orders, absent facts null; every 83rd event has no user."""
    sources = {
        "accounts": b.t("customer").selectExpr("c_custkey as user_id", "c_name as email", "c_nationkey as home_pincode"),
        "sessions": raw(b).selectExpr("event_id as session_id", "uid as user_id", "ts as timestamp", "event_type as action_type"),
        "referrals": b.referrals().selectExpr("referred_user_id as referral_id", "referrer_user_id", "referred_user_id"),
        "payment_instruments": b.t("orders").selectExpr("o_custkey as user_id", "sha2(o_orderpriority, 256) as instrument_hash"),
        "orders": b.t("orders").selectExpr("o_custkey as user_id", "o_orderkey as order_id", "o_totalprice as order_value", "o_orderdate as order_date"),
    }
    return {name: df.select([(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in tables.TABLES[name]]) for name, df in sources.items()}


def _read_entity_tables(b: Tables) -> DataFrame:
    read = tables.read_entity_tables(b.spark, written(b, _entity_tables(b)))
    user = {"referrals": "referred_user_id"}
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), F.count(user.get(name, "user_id")).alias("with_user"), F.count_distinct(user.get(name, "user_id")).alias("users")) for name, df in read.items()]
    return reduce(DataFrame.unionByName, parts)


add("a01_read_entity_tables", _read_entity_tables, """SELECT 'accounts' AS table_name, count(*) AS n, count(*) AS with_user, count(DISTINCT c_custkey) AS users FROM customer
    UNION ALL SELECT 'sessions', count(*), count(*) FILTER (WHERE event_id % 83 <> 0), count(DISTINCT user_id) FILTER (WHERE event_id % 83 <> 0) FROM events
    UNION ALL SELECT 'referrals', count(DISTINCT user_id), count(DISTINCT user_id), count(DISTINCT user_id) FROM events
    UNION ALL SELECT 'payment_instruments', count(*), count(*), count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'orders', count(*), count(*), count(DISTINCT o_custkey) FROM orders""")
add("a02_drop_missing_id", lambda b: tables.drop_missing_id(raw(b), "uid").select("event_id"), "SELECT event_id FROM events WHERE event_id % 83 <> 0")
add("a03_safe_timestamp", lambda b: tables.safe_timestamp(raw(b), "ts").select("event_id", "ts"), "SELECT event_id, ts FROM events WHERE event_id % 97 <> 0")
add("a04_safe_number", lambda b: tables.safe_number(raw(b), "value").select("event_id", "value"), "SELECT event_id, value FROM events WHERE event_id % 89 <> 0 AND value >= 0")
EVENTS_FAIL = lambda: {"missing id": ~tables.has_text("uid"), "bad timestamp": F.expr("try_cast(ts as timestamp)").isNull(), "bad value": F.coalesce(F.expr("try_cast(value as double)") < 0, F.lit(True))}
DROPPED = """SELECT 'events' AS table_name, reason, count(*) AS rows_dropped, string_agg(k, ',' ORDER BY k) FILTER (WHERE p <= 3) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY k) AS p FROM
    (SELECT CAST(event_id AS VARCHAR) AS k, CASE WHEN event_id % 83 = 0 THEN 'missing id' WHEN event_id % 97 = 0 THEN 'bad timestamp' WHEN event_id % 89 = 0 OR value < 0 THEN 'bad value' END AS reason FROM events) WHERE reason IS NOT NULL) GROUP BY reason"""
add("a05_quality_report", lambda b: tables.quality_report(raw(b), "events", "event_id", EVENTS_FAIL()), DROPPED)


def _cleaned(b: Tables) -> DataFrame:
    """The report of a cleaning pass, and how many rows it kept."""
    kept, report = tables.clean(raw(b), "events", "event_id", EVENTS_FAIL())
    return report.unionByName(kept.agg(F.lit("events").alias("table_name"), F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("rows_dropped"), F.lit("").alias("examples")))


add("a05_clean", _cleaned, DROPPED + " UNION ALL SELECT 'events', 'kept', count(*), '' FROM events WHERE event_id % 83 <> 0 AND event_id % 97 <> 0 AND event_id % 89 <> 0 AND value >= 0")
EVENT_CHECKS = {"key": "event_id", "required": ["event_id", "uid"], "dates": ["ts"], "numbers": ["value"], "enums": {"event_type": ["click", "view", "purchase", "signup"]}}


def _validated(b: Tables) -> DataFrame:
    """Events, events without ``value``, a table without a spec and orders, against customers who have an order."""
    given = {
        "accounts": b.t("orders").selectExpr("o_custkey as user_id").distinct(),
        "events": raw(b),
        "narrow": raw(b).drop("value"),
        "other": raw(b),
        "users": b.t("customer").selectExpr("c_custkey as user_id"),
    }
    narrow = EVENT_CHECKS | {"required": ["event_id", "value"]}
    return tables.validate_tables(given, {"accounts": {"key": "user_id", "required": ["user_id"]}, "events": EVENT_CHECKS, "narrow": narrow, "users": {"key": "user_id", "required": ["user_id"]}}, "accounts", "user_id")


add("a06_validate_tables", _validated,
    """SELECT 'other' AS table_name, NULL AS row_key, 'unknown table' AS error UNION ALL SELECT 'narrow', NULL, 'missing column value' UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), 'bad date in ts' FROM events WHERE event_id % 97 = 0
    UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), 'bad value in event_type' FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')
    UNION ALL SELECT DISTINCT 'users', CAST(c_custkey AS VARCHAR), 'user_id not in accounts' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
add("a07_orphan_keys", lambda b: tables.orphan_keys(b.t("customer").select(F.col("c_custkey").alias("user_id")), b.t("events"), "user_id", "user_id"), "SELECT DISTINCT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
add("a08_overlay", lambda b: tables.overlay(b.t("nation").select("n_nationkey", "n_name"), b.t("supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_acctbal")).groupBy("n_nationkey").agg(F.count("n_name").alias("base"), F.count("s_acctbal").alias("extra")),
    "SELECT n_nationkey, count(DISTINCT n_name) AS base, count(s_suppkey) AS extra FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")


def _nested(b: Tables) -> DataFrame:
    """A record a customer with orders: orders and events as parallel arrays, a nation as device, order priorities as instruments."""
    o = b.orders().groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("order_id", "order_value", "order_date"))).alias("o"))
    e = b.t("events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type", "ts"))).alias("e"))
    p = b.t("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("instruments"))
    c = b.t("customer").selectExpr("c_custkey as user_id", "cast(c_nationkey as string) as device", "if(c_custkey % 3 = 0, c_custkey div 3, null) as referred_by")
    df = c.join(o, "user_id").join(p, "user_id").join(e, "user_id", "left")
    each = lambda items, field: F.transform(items, lambda x: x[field])
    return df.select("user_id", "device", F.lit(None).cast("timestamp").alias("signup_ts"), "instruments", each("e", "event_type").alias("action_types"), each("e", "ts").alias("action_times"), each("o", "order_value").alias("order_values"), each("o", "order_date").alias("order_dates"), "referred_by")


def _expanded(b: Tables) -> DataFrame:
    """All five tables as (table_name, user_id, at, value)."""
    out = tables.expand_nested_accounts(stored(_nested(b)))
    value = {"accounts": ("-1", "device"), "payment_instruments": ("-1", "instrument_hash"), "sessions": ("at", "action_type"), "orders": ("at", "cast(cast(round(order_value * 100) as bigint) as string)"), "referrals": ("-1", "cast(referrer_user_id as string)")}
    user = {"referrals": "referred_user_id"}
    return reduce(DataFrame.unionByName, [out[t].selectExpr(f"'{t}' as table_name", f"{user.get(t, 'user_id')} as user_id", f"cast({at} as int) as at", f"{v} as value") for t, (at, v) in value.items()])


add("a09_expand_nested_accounts", _expanded, """, act AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))
    SELECT 'accounts' AS table_name, c_custkey AS user_id, -1 AS at, CAST(c_nationkey AS VARCHAR) AS value FROM act
    UNION ALL SELECT DISTINCT 'payment_instruments', o_custkey, -1, o_orderpriority FROM orders JOIN act ON c_custkey = o_custkey
    UNION ALL SELECT 'sessions', user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1, event_type FROM events JOIN act ON c_custkey = user_id
    UNION ALL SELECT 'orders', o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) FROM orders JOIN act ON c_custkey = o_custkey
    UNION ALL SELECT 'referrals', c_custkey, -1, CAST(c_custkey // 3 AS VARCHAR) FROM act WHERE c_custkey % 3 = 0""")


def _truth_json(b: Tables) -> DataFrame:
    sets = b.truth().groupBy("set_id").agg(F.sort_array(F.collect_list(F.col("member").cast("string"))).alias("members"))
    one = sets.select(F.to_json(F.create_map(F.col("set_id").cast("string"), F.struct(F.when(F.col("set_id") % 2 == 0, "hard").otherwise("soft").alias("type"), F.lit("easy").alias("difficulty"), "members", F.lit("x").alias("description")))).alias("value"))
    path = shared_folder(b.spark)
    one.write.text(path)
    return tables.read_truth(b.spark, path, lines=True)


add("a10_read_truth", _truth_json, "SELECT CAST(set_id AS VARCHAR) AS set_id, CASE WHEN set_id % 2 = 0 THEN 'hard' ELSE 'soft' END AS type, 'easy' AS difficulty, CAST(member AS VARCHAR) AS member FROM truth")
CLASS = "case c_mktsegment when 'FURNITURE' then 'unknown' when 'MACHINERY' then '1' else '2' end"
add("a11_read_labeled_nodes", lambda b: tables.read_labeled_nodes(b.t("customer").selectExpr("c_custkey as id", f"{CLASS} as class"), b.t("orders").select(F.col("o_custkey").alias("id"))), "SELECT id, label FROM nl WHERE id IN (SELECT o_custkey FROM orders)")
add("a12_restrict_edges", lambda b: tables.restrict_edges(b.strong(), b.node_labels()).select("src", "dst", "weight"), "SELECT src, dst, weight FROM strong WHERE src IN (SELECT id FROM nl) AND dst IN (SELECT id FROM nl)")


def _read_flows(b: Tables) -> DataFrame:
    """One CSV folder a capture (a calendar week, 53 at most), read back through the reader's own columns."""
    flows = b.flows().selectExpr("capture", "src as SrcAddr", "dst as DstAddr", "port as Dport", "proto as Proto", "dur as Dur", "pkts as TotPkts", "bytes as TotBytes", "src_bytes as SrcBytes", "label as Label")
    flows, folder = stored(flows), shared_folder(b.spark)
    flows.write.partitionBy("capture").option("header", True).csv(folder)
    captures = [r.capture for r in flows.select("capture").distinct().collect()]
    return tables.read_flows(b.spark, {c: f"{folder}/capture={c}" for c in captures})


add("a13_read_flows", lambda b: _read_flows(b).groupBy("host").agg(F.count_if(F.expr("is_botnet")).alias("botnet"), F.count_if(F.expr("is_normal")).alias("normal"), F.count_if(F.expr("is_background")).alias("background")), "SELECT host, count(*) FILTER (WHERE label = 'From-Botnet') AS botnet, count(*) FILTER (WHERE label = 'From-Normal') AS normal, count(*) FILTER (WHERE label = 'Background') AS background FROM hosts GROUP BY 1")
add("a14_join_identity", lambda b: tables.join_identity(b.t("customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), b.device(), "id"), "SELECT c_custkey AS id, c_mktsegment, value FROM customer LEFT JOIN dev ON c_custkey = id")
add("a15_assert_columns", lambda b: tables.assert_columns(b.scores(), ["id", "score", "label"], "label").groupBy("label").agg(F.count(F.lit(1)).alias("n")), "SELECT label, count(*) AS n FROM sc GROUP BY 1")
add("a16_ip_subnet", lambda b: b.events().select("event_id", tables.ip_subnet(F.concat_ws(".", F.lit("10"), "user_id", "k", F.when(F.col("event_id") % 5 != 0, F.lit("9")))).alias("subnet")), "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN '10.' || user_id || '.' || k END AS subnet FROM ev")
add("a17_next_entity_index", lambda b: tables.next_entity_index(b.t("customer"), "c_name"), "SELECT max(CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT)) + 1 AS next_index FROM customer")
def _read_cod(b: Tables) -> DataFrame:
    """Orders as read from CSV whose account was read too; every fifth order date is no date and goes."""
    accounts = b.t("customer").selectExpr("c_custkey as user_id", "date'2020-01-01' as signup_date", "cast(null as string) as phone_number", "sha2(c_name, 256) as delivery_address_hash", "c_nationkey as home_pincode")
    orders = b.t("orders").selectExpr("o_orderkey as order_id", "o_custkey as user_id", "o_totalprice as order_value", "if(o_orderkey % 5 = 0, 'soon', cast(o_orderdate as string)) as order_date", "if(o_orderpriority in ('1-URGENT', '2-HIGH'), 'COD', 'CARD') as payment_method", "if(o_orderstatus = 'F', 'refused', 'delivered') as delivery_status")
    read = tables.read_cod_tables(b.spark, written(b, {"accounts": accounts, "orders": orders}))
    kept = read["orders"].join(read["accounts"].select("user_id"), "user_id", "left_semi")
    return kept.select((F.col("payment_method") == "COD").alias("is_cod"), (F.col("delivery_status") == "refused").alias("is_refused"))


add("a18_read_cod_tables", lambda b: _read_cod(b).groupBy("is_cod", "is_refused").agg(F.count(F.lit(1)).alias("n")), "SELECT o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_cod, o_orderstatus = 'F' AS is_refused, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1, 2")

# B: stores.
def _changed(b: Tables) -> DataFrame:
    """New balances of customers with orders, and suppliers under keys that the store does not know."""
    spent = b.t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("c_acctbal"))
    return spent.unionByName(b.t("supplier").select((-F.col("s_suppkey")).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal")))


def _bucket_store(b: Tables) -> sinks.BucketStore:
    store = sinks.BucketStore(b.spark, shared_folder(b.spark), "c_custkey", "c_custkey bigint, c_acctbal double", 16)
    store.upsert(b.t("customer"), 1)
    for _ in range(2):  # the second time as by a retried job
        store.upsert(_changed(b), 2)
    return store


UPSERTED = "SELECT c_custkey, coalesce(p, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS p FROM orders GROUP BY 1) USING (c_custkey) UNION ALL SELECT -s_suppkey, s_acctbal FROM supplier"
add("b01_upsert_clusters", lambda b: sinks.upsert(_changed(b), b.t("customer").select("c_custkey", "c_acctbal"), "c_custkey"), UPSERTED)
add("b01_bucket_store", lambda b: _bucket_store(b).read(), UPSERTED)
add("b04_earlier_version", lambda b: _bucket_store(b).read(1), "SELECT c_custkey, c_acctbal FROM customer")
add("b02_audit_events", lambda b: sinks.audit_events(b.judged(), "rule", ["size", "n_orders"], ["flagged", "rule"], F.lit("t0")), """SELECT cluster_key, 'rule' AS event, '{"size":' || size || ',"n_orders":' || n_orders || '}' AS input_json, '{"flagged":' || flagged || ',"rule":"' || rule || '"}' AS output_json, 't0' AS at FROM judged""")


def _report(b: Tables) -> DataFrame:
    path = shared_folder(b.spark)
    sinks.write_report(features.density(b.strong(), b.membership()), path)
    return b.spark.read.schema("cluster_key bigint, size bigint, n_edges bigint, edge_density double").json(path)


def _snapshot(b: Tables) -> DataFrame:
    """Version v1 taken twice, as by a job that is retried, and another one; v1 as it reads back."""
    path = shared_folder(b.spark)
    for version in ("v1", "v1"):
        sinks.snapshot(b.t("supplier").select("s_suppkey", "s_acctbal"), path, version)
    sinks.snapshot(b.t("customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("s_acctbal")), path, "v2")
    return sinks.restore(b.spark, path, "v1")


add("b03_write_report", _report, "SELECT cluster_key, size, n AS n_edges, round(n / (size * (size - 1) / 2), 4) AS edge_density FROM sz JOIN (SELECT a.cluster_key, count(*) AS n FROM strong e JOIN comp a ON e.src = a.member GROUP BY 1) USING (cluster_key)")
add("b04_snapshot", _snapshot, "SELECT s_suppkey, s_acctbal FROM supplier")

# C: derivations.
add("c01_signup_ts", lambda b: derive.signup_ts(b.accounts(), b.sessions()), "SELECT c_custkey AS user_id, coalesce(signup_ts, TIMESTAMP '2024-01-01') AS signup_ts FROM customer LEFT JOIN su ON c_custkey = user_id")
add("c02_claim_ts", lambda b: b.claim(), "SELECT * FROM cl")
add("c03_latest_instrument", lambda b: derive.latest_instrument(b.events().filter("event_type = 'purchase'").select("user_id", F.col("k").alias("instrument_hash"), F.col("ts").alias("first_seen"))), "SELECT user_id, arg_max(k, (ts, k)) AS instrument_hash FROM ev WHERE event_type = 'purchase' GROUP BY 1")
add("c04_user_event_lists", lambda b: derive.user_event_lists(b.sessions(), b.orders()).select("user_id", F.size("times").alias("n_times"), F.element_at("times", 1).alias("first_time"), F.size("order_values").alias("n_orders"), F.element_at("order_values", -1).alias("largest")), "SELECT coalesce(s.user_id, o.user_id) AS user_id, n_times, first_time, n_orders, largest FROM (SELECT user_id, CAST(count(*) AS INT) AS n_times, min(ts) AS first_time FROM sess GROUP BY 1) s FULL JOIN (SELECT o_custkey AS user_id, CAST(count(*) AS INT) AS n_orders, max(o_totalprice) AS largest FROM orders GROUP BY 1) o ON s.user_id = o.user_id")
add("c05_composite_uid", lambda b: b.t("orders").select("o_orderkey", derive.composite_uid(F.col("o_custkey"), F.col("o_orderkey") * 1000, F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 50)).alias("uid")), "SELECT o_orderkey, o_custkey || '_' || CAST(floor(o_orderkey * 1000 / 86400) - coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 50 END, -999) AS BIGINT) AS uid FROM orders")
add("c06_host_labels", lambda b: derive.host_labels(tables.flow_flags(b.flows())), "SELECT host, CASE WHEN bool_or(label = 'From-Botnet') THEN 1 WHEN bool_or(label = 'From-Normal') THEN 0 END AS label FROM hosts GROUP BY 1")
add("c07_host_features", lambda b: derive.host_features(tables.flow_flags(b.flows())), "SELECT host, count(*) AS n_flows, count(DISTINCT dst) AS n_dst, count(DISTINCT port) AS n_port, count(DISTINCT proto) AS n_proto, avg(dur) AS dur_mean, coalesce(stddev_samp(dur), 0) AS dur_std, avg(pkts) AS pkts_mean, coalesce(stddev_samp(pkts), 0) AS pkts_std, avg(bytes) AS bytes_mean, coalesce(stddev_samp(bytes), 0) AS bytes_std, avg(src_bytes) AS src_bytes_mean, sum(bytes) / nullif(sum(pkts), 0) AS bytes_per_pkt FROM hosts GROUP BY 1")
add("c08_tier_of", lambda b: b.t("customer").select("c_custkey", derive.tier_of((F.col("c_custkey") % 900 + 100).cast("string")).alias("tier")), f"SELECT c_custkey, CASE WHEN CAST(c_custkey % 900 + 100 AS VARCHAR) IN ({str(derive.TIER1)[1:-1]}) THEN 'tier1_metro' WHEN CAST(c_custkey % 900 + 100 AS VARCHAR) IN ({str(derive.TIER2)[1:-1]}) THEN 'tier2_city' ELSE 'tier3_other' END AS tier FROM customer")

# D: graph.
REFERRED = """refs AS (SELECT least(r.a, r.b) AS src, greatest(r.a, r.b) AS dst, sum(CASE WHEN (epoch_us(claim_ts) - epoch_us(s.signup_ts)) / 3.6e9 <= 6 THEN 2.0 WHEN (epoch_us(claim_ts) - epoch_us(s.signup_ts)) / 3.6e9 <= 48 THEN 1.3 ELSE 0.8 END) AS weight
    FROM (SELECT DISTINCT CAST(floor(user_id / 2) AS BIGINT) AS a, user_id AS b FROM events) r JOIN su s ON r.b = s.user_id LEFT JOIN cl ON r.b = cl.user_id WHERE a <> b AND a IN (SELECT user_id FROM su) GROUP BY 1, 2)"""
referral = lambda b: graph.referral_edges(b.referrals(), b.signup(), b.claim())
add("d01_valid_value", lambda b: b.events().select("event_id", graph.valid_value(F.when(F.col("event_id") % 7 == 0, " ").when(F.col("event_id") % 5 == 0, "NaN").otherwise(F.col("k"))).alias("valid")), "SELECT event_id, event_id % 7 <> 0 AND event_id % 5 <> 0 AS valid FROM ev")
add("d02_shared_attribute_edges", lambda b: text(b.strong(), "signals"), "SELECT src, dst, weight, signal AS signals FROM strong")
add("d03_referral_edges", lambda b: text(referral(b), "signals"), f", {REFERRED} SELECT src, dst, weight, 'referral_link' AS signals FROM refs")
add("d04_merge_edges", lambda b: text(b.edges(), "signals"), "SELECT * FROM edges")


def _pairs(name: str, inc: str, weight: float) -> str:
    return f"{name} AS (SELECT a.id AS src, b.id AS dst, count(*) * {weight} AS weight FROM {inc} a JOIN {inc} b ON a.value = b.value AND a.id < b.id GROUP BY 1, 2)"


add("d05_build_entity_graph", lambda b: text(graph.build_entity_graph(b.device(), b.instrument(), b.keys("l_suppkey"), referral(b)), "signals"),
    f""", {_pairs('pd', 'dev', 3.0)}, {_pairs('pi', 'ins', 4.0)}, {REFERRED} SELECT src, dst, sum(weight) AS weight, array_to_string(list_sort(list_distinct(list(s))), ',') AS signals FROM (SELECT *, 'shared_device' AS s FROM pd UNION ALL SELECT *, 'shared_instrument' FROM pi
    UNION ALL SELECT src, dst, weight, signal FROM weak UNION ALL SELECT *, 'referral_link' FROM refs) GROUP BY 1, 2""")
add("d06_hard_subgraph", lambda b: text(graph.hard_subgraph(b.edges()), "signals"), "SELECT src, dst, weight, 'shared_device' AS signals FROM edges WHERE signals LIKE '%shared_device%'")
add("d07_prefix_edges", lambda b: text(graph.prefix_edges(b.t("customer").select(F.col("c_custkey").alias("id"), F.lpad(F.floor(F.col("c_acctbal") * 100).cast("long").cast("string"), 10, "5").alias("phone"))), "signals"),
    f", ph AS (SELECT c_custkey AS id, substr(lpad(CAST(CAST(floor(c_acctbal * 100) AS BIGINT) AS VARCHAR), 10, '5'), 1, 9) AS value FROM customer), {_pairs('pp', 'ph', 2.0)} SELECT *, 'phone_prefix' AS signals FROM pp")
add("d08_address_edges", lambda b: text(graph.address_edges(b.device().withColumnRenamed("value", "address")), "signals"), f", {_pairs('pd', 'dev', 4.0)} SELECT *, 'shared_address' AS signals FROM pd")
add("d09_co_destination_edges", lambda b: text(graph.co_destination_edges(b.flows()), "destinations"),
    ", o AS (SELECT DISTINCT capture, src, dst || ':' || port AS value FROM flows) SELECT a.capture, a.src, b.src AS dst, count(*) AS weight, string_agg(a.value, ',' ORDER BY a.value) AS destinations FROM o a JOIN o b ON a.capture = b.capture AND a.value = b.value AND a.src < b.src GROUP BY 1, 2, 3")
relations = lambda b: b.strong().select(F.lit("part").alias("relation"), "src", "dst", F.col("weight").alias("value")).unionByName(b.weak().select(F.lit("supplier").alias("relation"), "src", "dst", F.col("weight").alias("value")))
add("d10_combine_relations", lambda b: graph.combine_relations(relations(b), {"part": 1.0, "supplier": 0.4}), "SELECT src, dst, sum(w) AS weight FROM (SELECT src, dst, weight AS w FROM strong UNION ALL SELECT src, dst, weight * 0.4 FROM weak) GROUP BY 1, 2")
incidence = lambda b: graph.bipartite_incidence({"device": b.device(), "instrument": b.instrument()})
add("d11_bipartite_incidence", incidence, "SELECT id AS row_id, 'device:' || value AS col_id FROM dev UNION SELECT id, 'instrument:' || value FROM ins")
add("d12_degrees", lambda b: graph.drop_isolated(b.t("customer").select(F.col("c_custkey").alias("id")), b.edges()).join(graph.degrees(b.edges()).hint("merge"), "id"), "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1")
add("d12_weighted_degrees", lambda b: factored.weighted_degrees(b.groups()), "SELECT member, sum(weight) AS k FROM (SELECT src AS member, weight FROM edges UNION ALL SELECT dst, weight FROM edges) GROUP BY 1")
add("d04_pair_edges", lambda b: text(factored.pair_edges(b.groups()), "signals"), "SELECT * FROM edges")
add("d13_induced_edges", lambda b: graph.induced_edges(b.edges(), b.membership()).select("cluster_key", "src", "dst", "weight"), "SELECT cluster_key, src, dst, weight FROM ind")
add("d14_linkage_profile", lambda b: graph.linkage_profile(b.t("customer"), ["c_mktsegment", "c_nationkey"]), "SELECT field, count(*) AS n_values, max(n) AS largest, arg_max(value, (n, value)) AS largest_value, count(*) FILTER (WHERE n BETWEEN 2 AND 10) AS small_groups FROM (SELECT field, value, count(*) AS n FROM (SELECT 'c_mktsegment' AS field, c_mktsegment AS value FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer) GROUP BY 1, 2) GROUP BY 1")
add("d15_cap_report", lambda b: graph.cap_report(b.keys("l_suppkey"), [2, 3, 4]), "SELECT cap, count(*) FILTER (WHERE n <= cap) AS groups_kept, count(*) FILTER (WHERE n > cap) AS groups_dropped, CAST(coalesce(sum(n * (n - 1) // 2) FILTER (WHERE n <= cap), 0) AS BIGINT) AS pairs_kept, CAST(coalesce(sum(n * (n - 1) // 2) FILTER (WHERE n > cap), 0) AS BIGINT) AS pairs_dropped FROM (SELECT value, count(*) AS n FROM wi GROUP BY 1 HAVING count(*) >= 2), (SELECT unnest([2, 3, 4]) AS cap) GROUP BY 1")
add("d16_edge_label", lambda b: graph.edge_label(b.edges()), "SELECT src, dst, CASE WHEN signals LIKE '%shared_device%' THEN 'shared_device' ELSE 'ip_subnet_overlap' END AS dominant, CASE WHEN signals LIKE '%shared_device%' THEN 'hard' ELSE 'soft' END AS width FROM edges")

# E: clustering.
add("e01_connected_components", lambda b: b.membership(), "SELECT cluster_key, member FROM comp")
add("e02_louvain", lambda b: cluster.louvain(b.edges()))
MODULARITY = "SELECT round(inside / (m2 / 2) - 1.3 * sq / (m2 * m2), 9) AS q FROM (SELECT sum(d) AS m2, sum(i) AS inside, sum(d * d) AS sq FROM (SELECT c, sum(w) AS d, sum(i) AS i FROM (SELECT coalesce(CAST(a.cluster_key AS VARCHAR), 'n' || src) AS c, weight AS w, CASE WHEN a.cluster_key = b.cluster_key THEN weight ELSE 0 END AS i FROM edges LEFT JOIN comp a ON src = a.member LEFT JOIN comp b ON dst = b.member UNION ALL SELECT coalesce(CAST(b.cluster_key AS VARCHAR), 'n' || dst), weight, 0 FROM edges LEFT JOIN comp b ON dst = b.member) GROUP BY 1))"
add("e03_modularity", lambda b: cluster.modularity(b.edges(), b.membership()).select(F.round("q", 9).alias("q")), MODULARITY)
add("e03_modularity_of_groups", lambda b: factored.modularity(b.groups(), b.membership()).select(F.round("q", 9).alias("q")), MODULARITY)
add("e04_dedupe_candidates", lambda b: cluster.dedupe_candidates(b.membership(), b.truth().select(F.col("set_id").alias("cluster_key"), "member")),
    "SELECT 'hard' AS stage, 'hard:' || cluster_key AS cluster_key, member FROM comp UNION ALL SELECT 'soft', 'soft:' || set_id, member FROM truth WHERE set_id NOT IN (SELECT t.set_id FROM comp c JOIN truth t USING (member) JOIN sz ON sz.cluster_key = c.cluster_key GROUP BY t.set_id, c.cluster_key HAVING count(*) >= 0.7 * any_value(size))")
parted = lambda b: b.strong().withColumn("part", F.col("src") % 2)
add("e05_cluster_by_partition", lambda b: cluster.cluster_by_partition(parted(b), "part"),
    ", padj AS (SELECT (src % 2) || '|' || src AS a, (src % 2) || '|' || dst AS b FROM strong), pb AS (SELECT a, b FROM padj UNION ALL SELECT b, a FROM padj), pre AS (SELECT DISTINCT a AS n, a AS m FROM pb UNION SELECT pre.n, pb.b FROM pre JOIN pb ON pre.m = pb.a) SELECT min(m) AS cluster_key, n AS member FROM pre GROUP BY n")
add("e06_densest_block", lambda b: cluster.densest_block(incidence(b)))
add("e07_top_k_blocks", lambda b: cluster.top_k_blocks(incidence(b)))
add("e08_illicit_structures", lambda b: cluster.illicit_structures(b.edges(), b.node_labels()),
    ", iadj AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM nl WHERE label = 1) AND dst IN (SELECT id FROM nl WHERE label = 1)), ib AS (SELECT src, dst FROM iadj UNION ALL SELECT dst, src FROM iadj), ir AS (SELECT DISTINCT src AS n, src AS m FROM ib UNION SELECT ir.n, ib.dst FROM ir JOIN ib ON ir.m = ib.src) SELECT min(m) AS cluster_key, n AS member FROM ir GROUP BY n")

# F: features.
add("f01_density", lambda b: features.density(b.edges(), b.membership()), "SELECT * FROM f01")
add("f01_density_of_groups", lambda b: factored.density(b.groups(), b.membership()), "SELECT * FROM f01")
add("f02_signals_of_groups", lambda b: text(factored.signals_present(b.groups(), b.membership()), "signals_present"), "SELECT * FROM f02")
add("f02_signals_present", lambda b: text(features.signals_present(b.edges(), b.membership()), "signals_present"), "SELECT * FROM f02")
add("f03_shared_value", lambda b: features.shared_value(b.membership(), b.member(b.device()), "device"), "SELECT * FROM f03d")
add("f04_signup_timing", lambda b: features.signup_timing(b.membership(), b.signup()), "SELECT * FROM f04")
add("f05_claims", lambda b: features.claims(b.membership(), b.signup(), b.claim(), b.sessions()).select("cluster_key", "claim_frac", "bonus_claim_velocity_hours"), "SELECT cluster_key, claim_frac, bonus_claim_velocity_hours FROM f05")
add("f06_dormant", lambda b: features.claims(b.membership(), b.signup(), b.claim(), b.sessions()).select("cluster_key", "claim_then_dormant_frac"), "SELECT cluster_key, claim_then_dormant_frac FROM f05")
add("f07_order_values", lambda b: features.order_values(b.membership(), b.orders()), "SELECT * FROM f07")
add("f08_engagement", lambda b: features.engagement(b.membership(), b.signup(), b.sessions()), "SELECT * FROM f08")
add("f09_cluster_features", lambda b: text(b.features(), "signals_present"), "SELECT * FROM f09")
cod = lambda b: features.cod_features(b.edges(), b.membership(), b.device().select(F.col("id").alias("user_id"), F.col("value").alias("address")), b.cod_orders())
add("f10_cod_features", lambda b: text(cod(b), "signals_present"), "SELECT * FROM f10")
# Components taken a hundred keys together, so that most groups are fragmented and some are one block.
merged = lambda b: b.membership().select(F.floor(F.col("cluster_key") / 100).cast("long").alias("cluster_key"), "member")
VAL = "mg AS (SELECT cluster_key // 100 AS cluster_key, cluster_key AS piece, count(*) AS n FROM comp GROUP BY 1, 2), me AS (SELECT c.cluster_key // 100 AS cluster_key, count(*) AS e FROM strong JOIN comp c ON src = c.member GROUP BY 1), val AS (SELECT cluster_key, any_value(e) AS internal_edges, count(*) AS pieces, count(*) = 1 AS single_block, round(2 * any_value(e) / sum(n), 2) AS avg_degree, round(max(n) / sum(n), 3) AS largest_share FROM mg JOIN me USING (cluster_key) GROUP BY 1)"
add("f11_validity", lambda b: features.validity(b.strong(), merged(b)), f", {VAL} SELECT * FROM val")
add("f11_validity_summary", lambda b: features.validity_summary(features.validity(b.strong(), merged(b))), f", {VAL} SELECT count(*) AS groups, count(*) FILTER (WHERE single_block) AS single_blocks, count(*) FILTER (WHERE NOT single_block) AS fragmented, round(count(*) FILTER (WHERE single_block) / count(*), 4) AS single_block_share FROM val")
# Components, and taken a hundred keys together under a negative key.
both = lambda b: b.membership().unionByName(merged(b).withColumn("cluster_key", -1 - F.col("cluster_key")))
add("f12_diameters", lambda b: features.diameters(b.strong(), both(b)),
    ", bfs AS (SELECT DISTINCT src AS s, src AS t, 0 AS d FROM adj UNION SELECT bfs.s, adj.dst, bfs.d + 1 FROM bfs JOIN adj ON bfs.t = adj.src WHERE bfs.d < 11), sp AS (SELECT s, t, min(d) AS d FROM bfs GROUP BY 1, 2), dm AS (SELECT cluster_key, max(d) AS diameter FROM sp JOIN comp ON s = member GROUP BY 1) SELECT * FROM dm UNION ALL SELECT -1 - cluster_key // 100, CASE WHEN count(*) = 1 THEN max(diameter) END FROM dm GROUP BY 1")
add("f13_timing_tightness", lambda b: features.timing_tightness(b.membership(), b.orders().select(F.col("user_id").alias("member"), F.year("order_date").alias("step"))), "SELECT cluster_key, count(*) AS n_steps, round(max(n) / sum(n), 4) AS modal_share, count(*) = 1 AS one_step FROM (SELECT cluster_key, year(o_orderdate) AS y, count(*) AS n FROM comp JOIN orders ON member = o_custkey GROUP BY 1, 2) GROUP BY 1")
add("f14_label_density", lambda b: b.density_rows(), "SELECT * FROM ld")
add("f15_mean_member_score", lambda b: features.mean_member_score(b.membership(), b.t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"), F.when(F.col("c_custkey") % 2 == 0, "test").otherwise("dev").alias("split")), "test"), "SELECT cluster_key, count(*) AS scored, avg(c_acctbal) AS mean_score FROM comp JOIN customer ON member = c_custkey WHERE c_custkey % 2 = 0 GROUP BY 1")
add("f16_uid_homogeneity", lambda b: features.uid_homogeneity(b.t("orders").select("o_custkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("label")), ["o_custkey", "o_orderpriority"], "label"), "SELECT count(*) FILTER (WHERE p = n) AS all_one, count(*) FILTER (WHERE p = 0) AS all_zero, count(*) FILTER (WHERE p > 0 AND p < n) AS mixed, count(*) FILTER (WHERE p = n) / nullif(count(*) FILTER (WHERE p > 0), 0) AS pure_share FROM (SELECT count(*) AS n, sum(CAST(o_orderstatus = 'F' AS INT)) AS p FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) >= 2)")

# G: rules.
add("g01_organic_score", lambda b: b.features().select("cluster_key", rules.organic_score(rules.parameters()).alias("organic_score")), "SELECT cluster_key, organic_score FROM g0")
add("g02_suspicion_score", lambda b: b.features().select("cluster_key", rules.suspicion_score(rules.parameters()).alias("suspicion_score")), "SELECT cluster_key, suspicion_score FROM g0")
add("g03_verdict", lambda b: b.judged().select("cluster_key", "organic_score", "suspicion_score", "rule", "flagged"), "SELECT cluster_key, organic_score, suspicion_score, rule, flagged FROM judged")
add("g04_cod_verdict", lambda b: rules.cod_verdict(cod(b)).select("cluster_key", "flagged"), "SELECT cluster_key, CASE WHEN refusal_rate IS NULL THEN false WHEN shared_address THEN refusal_rate >= 0.6 OR (refusal_rate > 0.45 AND cod_fraction >= 0.75) ELSE refusal_rate >= 0.6 AND cod_fraction >= 0.75 END AS flagged FROM f10")


add("g05_detect", lambda b: detect(b.groups(), b.member(b.device()), b.member(b.instrument()), b.signup(), b.claim(), b.sessions(), b.orders()))
add("g06_flag_by_density", lambda b: rules.flag_by_density(b.density_rows(), 0.3), "SELECT count(*) FILTER (WHERE h) AS flagged, CAST(coalesce(sum(labeled) FILTER (WHERE h), 0) AS BIGINT) AS flagged_labeled, CAST(coalesce(sum(positives) FILTER (WHERE h), 0) AS BIGINT) AS captured, CAST(sum(positives) AS BIGINT) AS positives FROM (SELECT *, density > 0.3 AND labeled >= 2 AS h FROM ld)")
WHY = """, why AS (SELECT *, CASE rule WHEN 'instrument' THEN 'members pay with one instrument, which organic behaviour does not excuse' WHEN 'household' THEN 'one device, but spread out, diverse and engaged: a household' WHEN 'device' THEN 'one device without enough organic behaviour'
    WHEN 'organic' THEN 'no shared device or instrument, and organic behaviour prevails' WHEN 'pattern' THEN 'burst, templated orders, fast claims or dormancy come together' ELSE 'evidence too weak either way' END AS reason FROM judged)"""
add("g07_recommended_action", lambda b: text(rules.recommended_action(b.judged()), "evidence"), WHY + """, said AS (SELECT *, concat_ws(',', CASE WHEN shared_instrument THEN printf('%.0f%%', round(shared_instrument_frac * 100)) || ' share one instrument' END, CASE WHEN shared_device THEN printf('%.0f%%', round(shared_device_frac * 100)) || ' share one device' END, CASE WHEN signals_present LIKE '%ip_subnet_overlap%' THEN 'a subnet is shared' END,
    CASE WHEN signup_span_days <= 7 THEN 'all signed up within ' || printf('%.2f', signup_span_days) || ' days' END, CASE WHEN order_value_cv < 0.15 THEN 'order values vary by only ' || printf('%.4f', order_value_cv) END, CASE WHEN claim_then_dormant_frac >= 0.4 THEN printf('%.0f%%', round(claim_then_dormant_frac * 100)) || ' went silent after their claim' END) AS e, shared_instrument OR (shared_device AND suspicion_score >= 2) AS s FROM why)
    SELECT cluster_key, CASE WHEN s OR suspicion_score >= 3 THEN 'HOLD_BONUS' ELSE 'MANUAL_REVIEW' END AS action, CASE WHEN s THEN 0.85 WHEN suspicion_score >= 3 THEN 0.72 WHEN suspicion_score >= 2 THEN 0.55 ELSE 0.4 END AS confidence, CASE WHEN e = '' THEN reason ELSE e END AS evidence FROM said""")
add("g08_evidence_text", lambda b: rules.evidence_text(b.judged().withColumn("stage", F.lit("hard"))), WHY + """, t AS (SELECT *, coalesce(printf('%.2f', signup_span_days), 'n/a') AS span, coalesce(printf('%.2f', avg_gap_hours), 'n/a') AS gap, coalesce(printf('%.0f%%', round(claim_frac * 100)), 'n/a') AS claims, coalesce(printf('%.2f', bonus_claim_velocity_hours), 'n/a') AS pace, coalesce(printf('%.0f%%', round(claim_then_dormant_frac * 100)), 'n/a') AS silent, coalesce(printf('%.4f', order_value_cv), 'n/a') AS cv FROM why)
    SELECT cluster_key, concat_ws(chr(10), 'stage: hard', 'members: ' || size || ', density ' || printf('%.4f', edge_density), 'signals: ' || replace(coalesce(signals_present, 'none'), ',', ', '), 'one device: ' || CASE WHEN shared_device THEN 'yes' ELSE 'no' END || ', ' || printf('%.0f%%', round(shared_device_frac * 100)), 'one instrument: ' || CASE WHEN shared_instrument THEN 'yes' ELSE 'no' END || ', ' || printf('%.0f%%', round(shared_instrument_frac * 100)),
    'signups: over ' || span || ' days, ' || gap || ' hours apart on average', 'claims: ' || claims || ', ' || pace || ' hours after signup', 'silent after the claim: ' || silent, 'orders: ' || n_orders || ', values vary by ' || cv, 'late sessions a member: ' || printf('%.3f', post_signup_engagement), 'reason: ' || reason, 'scores: organic ' || organic_score || ' of 3, suspicion ' || suspicion_score || ' of 4') AS evidence_text FROM t""")

# H: evaluation.
add("h01_overlap_pairs", lambda b: evaluate.overlap_pairs(b.truth(), b.flagged_sets()), "SELECT * FROM ov")
add("h02_best_match", lambda b: evaluate.best_match(b.truth(), b.flagged_sets()), "SELECT * FROM best")
add("h03_largest_overlap", lambda b: evaluate.largest_overlap(b.truth(), b.flagged_sets()), """SELECT a_id AS set_id, b_id AS match_id, overlap, round(overlap / m, 3) AS recall, round(overlap / n, 3) AS "precision" FROM (SELECT a_id, b_id, overlap, (SELECT count(*) FROM fl WHERE set_id = b_id) AS m, (SELECT count(*) FROM truth WHERE set_id = a_id) AS n, row_number() OVER (PARTITION BY a_id ORDER BY overlap DESC, b_id) AS p FROM ov) WHERE p = 1""")
add("h04_landed_in", lambda b: evaluate.landed_in(b.truth(), b.sets(b.membership()), b.flags()),
    "SELECT n.set_id, b.cluster_key, CASE WHEN b.cluster_key IS NULL THEN 'not_clustered' WHEN b.cluster_key IN (SELECT cluster_key FROM ld WHERE density > 0.3) THEN 'flagged' ELSE 'clustered_not_flagged' END AS status FROM (SELECT set_id, count(*) AS n FROM truth GROUP BY 1) n LEFT JOIN (SELECT set_id, cluster_key, row_number() OVER (PARTITION BY set_id ORDER BY c DESC, cluster_key) AS p FROM (SELECT t.set_id, cluster_key, count(*) AS c FROM truth t JOIN comp USING (member) GROUP BY 1, 2) JOIN (SELECT set_id, count(*) AS n FROM truth GROUP BY 1) USING (set_id) WHERE c >= greatest(2, n // 2)) b ON b.set_id = n.set_id AND b.p = 1")
SPLIT = "sp AS (SELECT id, CASE WHEN row_number() OVER (ORDER BY md5(id || '|7'), id) <= greatest(1, floor(count(*) OVER () * 0.3)) THEN 'holdout' ELSE 'dev' END AS split FROM (SELECT DISTINCT set_id AS id FROM truth))"
ids = lambda b: stored(b.truth().select(F.col("set_id").alias("id")).distinct())
add("h05_holdout_split", lambda b: evaluate.holdout_split(ids(b)), f", {SPLIT} SELECT * FROM sp")
EV = evaluated("ev", "fl")
outcomes = lambda b: evaluate.set_outcomes(b.tagged(), b.flagged_sets())
add("h06_set_outcomes", outcomes, f", {EV} SELECT *, cluster_key IS NOT NULL AS matched FROM ev_o")
add("h06_ring_recall", lambda b: evaluate.ring_recall(outcomes(b), b.splits()), f", {EV} SELECT part AS split, kind, coalesce(type, 'all') AS type, count(*) AS n, count(cluster_key) AS found, avg(CAST(cluster_key IS NOT NULL AS INT)) AS rate FROM ev_s GROUP BY GROUPING SETS ((part, kind, type), (part, kind))")
reasons = lambda b: b.flags().select("cluster_key", F.when(F.col("flagged"), "many positives").otherwise("few positives").alias("reason"))
add("h07_false_positive_rate", lambda b: evaluate.false_positive_rate(b.confounders(), b.flagged_sets(), b.sets(b.membership()), reasons(b)), f""", {EV}, cs AS (SELECT cluster_key AS set_id, member FROM comp), {evaluated("al", "cs")} SELECT set_id, ev_o.cluster_key IS NOT NULL AS wrongly_flagged, al_o.cluster_key IS NOT NULL AS surfaced, coalesce(ev_o.cluster_key, al_o.cluster_key) AS cluster_key,
    CASE WHEN coalesce(ev_o.cluster_key, al_o.cluster_key) IN (SELECT set_id FROM fl) THEN 'many positives' WHEN al_o.cluster_key IS NOT NULL THEN 'few positives' END AS reason, avg(CAST(ev_o.cluster_key IS NOT NULL AS INT)) OVER () AS rate FROM ev_o JOIN al_o USING (kind, set_id) WHERE kind = 'confounder'""")
add("h08_cluster_precision", lambda b: evaluate.cluster_precision(b.flagged_sets(), b.tagged(), b.splits()), f", {EV} SELECT * FROM ev_t")
add("h09_eval_report", lambda b: evaluate.eval_report(b.tagged(), b.flagged_sets(), b.splits()), f", {EV} SELECT * REPLACE (coalesce(relevant, 0) AS relevant, coalesce(true_clusters, 0) AS true_clusters, coalesce(false_clusters, 0) AS false_clusters) FROM ev_e LEFT JOIN ev_t USING (split)")
add("h10_rate_by", lambda b: evaluate.rate_by(b.t("customer").withColumn("hit", F.col("c_acctbal") > 5000), ["c_mktsegment"], "hit"), "SELECT c_mktsegment, count(*) AS total, count(*) FILTER (WHERE c_acctbal > 5000) AS hits, avg(CAST(c_acctbal > 5000 AS INT)) AS rate FROM customer GROUP BY 1")
add("h11_tag_cluster_tier", lambda b: evaluate.tag_cluster_tier(b.membership(), b.t("customer").select(F.col("c_custkey").alias("member"), (F.col("c_nationkey") % 3 + 1).alias("tier"))), "SELECT cluster_key, min(c_nationkey % 3 + 1) AS best_tier, count(*) FILTER (WHERE c_nationkey % 3 = 0) AS tier1, count(*) FILTER (WHERE c_nationkey % 3 = 1) AS tier2, count(*) FILTER (WHERE c_nationkey % 3 = 2) AS tier3 FROM comp JOIN customer ON member = c_custkey GROUP BY 1")
SWEEP = """sw AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE density > threshold) AS flagged, coalesce(sum(positives) FILTER (WHERE density > threshold), 0) AS captured, coalesce(sum(labeled) FILTER (WHERE density > threshold), 0) AS inf, sum(positives) AS ap, sum(labeled) AS al FROM ld, (SELECT unnest([0.1, 0.3, 0.5, 0.7]) AS threshold) GROUP BY 1)"""
add("h12_threshold_sweep", lambda b: evaluate.threshold_sweep(b.density_rows(), [0.1, 0.3, 0.5, 0.7]), f', {SWEEP} SELECT threshold, flagged, CAST(captured AS BIGINT) AS captured, captured / nullif(ap, 0) AS recall, captured / nullif(inf, 0) AS "precision", captured / nullif(inf, 0) / (ap / nullif(al, 0)) AS lift FROM sw')
NEAR = "unf AS (SELECT member FROM comp WHERE cluster_key NOT IN (SELECT set_id FROM fl)), nb AS (SELECT DISTINCT src AS member FROM adj WHERE dst IN (SELECT id FROM nl WHERE label = 1) AND src IN (SELECT member FROM unf))"
add("h13_neighbor_flag", lambda b: evaluate.neighbor_flag(b.edges().filter("array_contains(signals, 'shared_device')"), b.node_labels(), b.membership(), b.flags()), f", {NEAR} SELECT member, coalesce(label = 1, false) AS positive FROM nb LEFT JOIN nl ON id = member")
add("h13_dilution_recovery", lambda b: evaluate.dilution_recovery(b.strong(), b.node_labels(), b.membership(), b.flags()), f""", {NEAR}, x AS (SELECT (SELECT count(*) FROM unf) AS checked, (SELECT count(*) FROM nb) AS near, (SELECT count(*) FROM nb JOIN nl ON id = member WHERE label = 1) AS recovered, (SELECT count(*) FROM nl WHERE label = 1) AS p, (SELECT count(*) FROM fl) AS m, (SELECT count(*) FROM fl JOIN nl ON id = member WHERE label = 1) AS c)
    SELECT checked, near, recovered, round(c / p, 4) AS cluster_recall, round(c / nullif(m, 0), 4) AS cluster_precision, round((c + recovered) / p, 4) AS combined_recall, round((c + recovered) / nullif(m + near, 0), 4) AS combined_precision FROM x""")
add("h14_structural_coverage", lambda b: evaluate.structural_coverage(b.strong(), b.node_labels(), b.flagged_sets()),
    ", ib AS (SELECT src, dst FROM adj WHERE src IN (SELECT id FROM nl WHERE label = 1) AND dst IN (SELECT id FROM nl WHERE label = 1)), ir AS (SELECT DISTINCT src AS n, src AS m FROM ib UNION SELECT ir.n, ib.dst FROM ir JOIN ib ON ir.m = ib.src), st AS (SELECT min(m) AS s, n AS member FROM ir GROUP BY n), cov AS (SELECT s, f.set_id, count(*) AS c FROM st JOIN fl f USING (member) GROUP BY 1, 2), n AS (SELECT s, count(*) AS n FROM st GROUP BY 1) SELECT count(*) AS structures, count(*) FILTER (WHERE r >= 0.5) AS covered FROM (SELECT n.s, max(c / n) AS r FROM n LEFT JOIN cov USING (s) GROUP BY 1)")
add("h15_member_recall", lambda b: evaluate.member_recall(b.truth(), b.flagged_sets()), "SELECT t.set_id, count(f.member) / count(*) AS member_recall, count(DISTINCT f.set_id) AS pieces FROM truth t LEFT JOIN fl f USING (member) GROUP BY 1")
# Blocks here are the holders of one device, which SQL can name; the next query takes the dense blocks of the search.
device_blocks = lambda b: b.device().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("value"))).filter("n >= 2").select(F.col("value").alias("set_id"), F.col("id").alias("member"))
add("h16_two_way_agreement", lambda b: evaluate.two_way_agreement(device_blocks(b), b.flagged_sets(), b.tagged()), """, bl AS (SELECT value AS set_id, id AS member FROM dev WHERE value IN (SELECT value FROM dev GROUP BY 1 HAVING count(*) >= 2)), bn AS (SELECT set_id, count(*) AS n FROM bl GROUP BY 1),
    al AS (SELECT 'flagged' AS kind, '' AS type, CAST(set_id AS VARCHAR) AS t, set_id AS k, member FROM fl UNION ALL SELECT kind, type, set_id, NULL, member FROM tg), an AS (SELECT kind, t, count(*) AS n FROM al GROUP BY 1, 2),
    po AS (SELECT bl.set_id AS b, kind, t, any_value(k) AS k, any_value(type) AS type, count(*) / any_value(an.n) AS r, count(*) / any_value(bn.n) AS p, count(*) AS o FROM bl JOIN al USING (member) JOIN an USING (kind, t) JOIN bn ON bn.set_id = bl.set_id GROUP BY 1, 2, 3),
    la AS (SELECT *, row_number() OVER (PARTITION BY b, kind ORDER BY o DESC, k, t) AS q FROM po), ok AS (SELECT * FROM la WHERE q = 1 AND round(r, 3) >= 0.5 AND round(p, 3) >= 0.5), hit AS (SELECT DISTINCT kind, t FROM po WHERE r >= 0.5 AND p >= 0.5)
    SELECT 'blocks' AS measure, count(*) AS n FROM bn UNION ALL SELECT 'blocks_in_flagged', count(*) FROM ok WHERE kind = 'flagged' UNION ALL SELECT 'blocks_in_rings', count(*) FROM ok WHERE kind = 'ring' UNION ALL SELECT 'blocks_in_confounders', count(*) FROM ok WHERE kind = 'confounder' UNION ALL SELECT 'hard_rings', count(*) FROM tn WHERE type = 'hard'
    UNION ALL SELECT 'hard_rings_found', count(DISTINCT t) FROM ok WHERE type = 'hard' UNION ALL SELECT 'flagged_in_blocks', count(*) FROM hit WHERE kind = 'flagged' UNION ALL SELECT 'confounders_in_blocks', count(*) FROM hit WHERE kind = 'confounder'""")
add("h16_agreement_of_dense_blocks", lambda b: evaluate.two_way_agreement(cluster.top_k_blocks(incidence(b)).select(F.col("block").alias("set_id"), F.col("row_id").alias("member")), b.flagged_sets(), b.tagged()))
add("h17_new_false_positives", lambda b: evaluate.new_false_positives(b.flagged_sets(), b.truth(), "member"), "SELECT DISTINCT member FROM fl WHERE member NOT IN (SELECT member FROM truth)")
add("h18_period_trend", lambda b: evaluate.period_trend(b.t("orders").groupBy(F.col("o_orderpriority").alias("series"), F.year("o_orderdate").alias("period")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("recall"))), """, m AS (SELECT o_orderpriority AS series, year(o_orderdate) AS period, avg(CAST(o_orderstatus = 'F' AS INT)) AS recall FROM orders GROUP BY 1, 2), t AS (SELECT series, arg_min(recall, period) AS "first", arg_max(recall, period) AS "last", min(recall) AS least, max(recall) AS most FROM m GROUP BY 1) SELECT series, "first", "last", CASE WHEN "last" < "first" - 1e-9 THEN 'decaying' WHEN most - "first" < 1e-9 AND "first" - least < 1e-9 THEN 'flat' ELSE 'inconclusive' END AS trend FROM t""")
add("h19_effect_decomposition", lambda b: evaluate.effect_decomposition(b.t("lineitem").groupBy(F.when(F.col("l_returnflag") == "N", "B").when(F.col("l_returnflag") == "R", "C").otherwise("A").alias("variant")).agg(F.round(F.avg("l_quantity"), 6).alias("value"))).select(F.round("first_effect", 6).alias("first_effect"), F.round("second_effect", 6).alias("second_effect"), "dominant"), ", v AS (SELECT l_returnflag AS r, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY 1), e AS (SELECT round((SELECT v FROM v WHERE r = 'N') - (SELECT v FROM v WHERE r = 'A'), 6) AS first_effect, round((SELECT v FROM v WHERE r = 'R') - (SELECT v FROM v WHERE r = 'N'), 6) AS second_effect) SELECT *, CASE WHEN abs(first_effect) > abs(second_effect) THEN 'first' WHEN abs(first_effect) < abs(second_effect) THEN 'second' ELSE 'equal' END AS dominant FROM e")
add("h20_calibration_buckets", lambda b: evaluate.calibration_buckets(b.scores().select(F.col("score").alias("confidence"), (F.col("label") == 1).alias("correct"))), "SELECT CAST(r.b AS INT) AS bucket, count(score) AS total, count(*) FILTER (WHERE label = 1) AS correct, count(*) FILTER (WHERE label = 1) / nullif(count(score), 0) AS accuracy, CASE WHEN (SELECT count(*) FROM sc WHERE label <> 1) < 5 THEN 'insufficient' ELSE 'ok' END AS status FROM (SELECT unnest(range(10)) AS b) r LEFT JOIN sc ON least(floor(score * 10), 9) = r.b GROUP BY 1")
blank = lambda b: b.t("customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"))
add("h21_spurious_edge_check", lambda b: evaluate.spurious_edge_check(graph.shared_attribute_edges(b.incidence("l_partkey").withColumn("value", F.when(F.col("id") % 5 == 0, " ").otherwise(F.col("value"))), "shared_device", graph.WEIGHTS["shared_device"]), blank(b)), "SELECT CAST(count(*) AS BIGINT) AS spurious_edges FROM strong WHERE false")

# I: what-if.
add("i01_replay", lambda b: whatif.replay(b.features(), "burst_days", [2, 7, 14]).groupBy("value").agg(F.count_if(F.expr("flagged")).alias("flagged"), F.sum("suspicion_score").alias("suspicion")),
    ", g AS (SELECT CAST(v AS DOUBLE) AS value, f.*, CAST(signup_span_days <= v AS INT) + coalesce(CAST(order_value_cv < 0.15 AS INT), 0) + coalesce(CAST(claim_then_dormant_frac >= 0.4 AS INT), 0) + coalesce(CAST(bonus_claim_velocity_hours <= 12 AS INT), 0) AS s FROM g0 f, (SELECT unnest([2, 7, 14]) AS v)) SELECT value, count(*) FILTER (WHERE shared_instrument OR (shared_device AND organic_score < 3) OR (NOT shared_device AND organic_score < 2 AND s >= 3)) AS flagged, CAST(sum(s) AS BIGINT) AS suspicion FROM g GROUP BY 1")
paid = lambda b: b.t("orders").select(F.col("o_orderkey").alias("referral_id"), F.col("o_totalprice").alias("bonus"), F.floor(F.col("o_custkey") / 2).cast("long").alias("referrer"), F.col("o_custkey").alias("referred"), F.when(F.col("o_orderstatus") == "F", "paid").otherwise("pending").alias("status"))
add("i02_missed_cost", lambda b: whatif.missed_cost(b.truth(), paid(b)), ", mc AS (SELECT set_id, sum(o_totalprice) AS cost FROM (SELECT DISTINCT set_id, o_orderkey, o_totalprice FROM truth JOIN orders ON member = o_custkey OR member = o_custkey // 2 WHERE o_orderstatus = 'F') GROUP BY 1), ms AS (SELECT set_id, coalesce(any_value(cost), 0) AS cost FROM truth LEFT JOIN mc USING (set_id) GROUP BY 1) SELECT set_id, round(cost, 2) AS cost, (SELECT round(avg(cost), 4) FROM ms) AS mean_cost FROM ms")
SCEN = "fpc AS (SELECT s AS scenario, round(150 + p * k * (SELECT avg(o_totalprice) FROM orders), 4) AS fp_cost FROM (VALUES ('none', 0.0, 0), ('some', 0.05, 5), ('many', 0.15, 10)) t(s, p, k))"
add("i03_fp_cost_scenarios", lambda b: whatif.fp_cost_scenarios(b.orders()), f", {SCEN} SELECT * FROM fpc")
sweep = lambda b: b.t("orders").groupBy((F.col("o_orderkey") % 4).cast("double").alias("value")).agg(F.count_if(F.expr("o_orderstatus = 'F'")).alias("missed"), F.count_if(F.expr("o_orderstatus = 'P'")).alias("false_positives"))
SW = "swp AS (SELECT CAST(o_orderkey % 4 AS DOUBLE) AS value, count(*) FILTER (WHERE o_orderstatus = 'F') AS missed, count(*) FILTER (WHERE o_orderstatus = 'P') AS false_positives FROM orders GROUP BY 1)"
add("i04_cost_table", lambda b: whatif.cost_table(sweep(b), whatif.fp_cost_scenarios(b.orders()), 1000.0), f", {SCEN}, {SW}, c AS (SELECT scenario, value, round(missed * 1000.0 + false_positives * fp_cost, 2) AS cost FROM swp, fpc) SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY cost, value) = 1 AS cheapest FROM c")
add("i05_sweep_finding", lambda b: whatif.sweep_finding(sweep(b), ["missed", "false_positives"]), f", {SW} SELECT min(missed) = max(missed) AS missed_flat, min(false_positives) = max(false_positives) AS false_positives_flat FROM swp")
CHANGED = "CASE WHEN shared_instrument THEN true WHEN shared_device THEN organic_score < 3 WHEN organic_score >= 2 THEN false ELSE suspicion_score >= {} END"
add("i06_impact", lambda b: whatif.impact(b.features(), b.membership(), b.tagged(), "soft_flag_suspicion_threshold", 1.0), f""", f0 AS (SELECT cluster_key AS set_id, member FROM comp JOIN g0 USING (cluster_key) WHERE {CHANGED.format(3)}), f1 AS (SELECT cluster_key AS set_id, member FROM comp JOIN g0 USING (cluster_key) WHERE {CHANGED.format(1)}), {evaluated("x0", "f0")}, {evaluated("x1", "f1")}
    SELECT kind, count(*) AS total, count(x0_o.cluster_key) AS before, count(x1_o.cluster_key) AS after, count(x1_o.cluster_key) - count(x0_o.cluster_key) AS delta FROM x0_o JOIN x1_o USING (kind, set_id) GROUP BY 1""")
_check = lambda k, n, c, at: f"SELECT cluster_key, {k} AS k, '{n}' AS parameter, CAST({c} AS DOUBLE) AS value, CAST({c} AS DOUBLE) - CAST({at} AS DOUBLE) AS margin FROM judged WHERE NOT flagged"
GAP = f"gp AS (SELECT * FROM ({_check(0, 'spread_out_days', 'signup_span_days', 21)} UNION ALL {_check(1, 'diverse_order_cv', 'order_value_cv', 0.28)} UNION ALL {_check(2, 'engaged_sessions', 'post_signup_engagement', 1.5)}) WHERE margin >= 0), gb AS (SELECT cluster_key, count(*) AS passing, arg_min(parameter, (margin, k)) AS parameter, arg_min(value, (margin, k)) AS value, min(margin) AS margin FROM gp GROUP BY 1), gg AS (SELECT cluster_key, coalesce(passing, 0) AS passing, CASE WHEN organic_score < 3 THEN parameter END AS parameter, CASE WHEN organic_score < 3 THEN value END AS value, CASE WHEN organic_score < 3 THEN round(margin, 4) END AS margin FROM judged LEFT JOIN gb USING (cluster_key) WHERE NOT flagged)"
add("i07_parameter_gap", lambda b: whatif.parameter_gap(b.judged()), f", {GAP} SELECT * FROM gg")
PARAMS = "pt(parameter, now, least, most, step) AS (VALUES " + ", ".join(f"('{k}', {', '.join(f'CAST({x} AS DOUBLE)' for x in v)})" for k, v in rules.PARAMETERS.items()) + ")"
add("i08_propose_value", lambda b: whatif.propose_value(whatif.parameter_gap(b.judged())), f", {GAP}, {PARAMS}, w AS (SELECT cluster_key, parameter, now, greatest(least, least(most, round(round_even((value + step) / step, 0) * step, 6))) AS v FROM gg JOIN pt USING (parameter)) SELECT cluster_key, parameter, CASE WHEN abs(v - now) > 1e-6 THEN v END AS proposed FROM w")
MEASURES = ("hard_recall", "soft_recall", "recall", "false_positive_rate", "precision")
report = lambda b, above: stored(evaluate.eval_report(b.tagged(), b.flagged_sets(above), b.splits()))
add("i09_side_by_side", lambda b: whatif.side_by_side(report(b, 0.3), report(b, 0.6)), f""", f6 AS (SELECT cluster_key AS set_id, member FROM comp WHERE cluster_key IN (SELECT cluster_key FROM ld WHERE density > 0.6)), {EV}, {evaluated("ew", "f6")}, a AS (SELECT * FROM ev_e LEFT JOIN ev_t USING (split)), b AS (SELECT * FROM ew_e LEFT JOIN ew_t USING (split))
    SELECT split, {', '.join(f'a."{m}" AS {m}_old, b."{m}" AS {m}_new, round(b."{m}" - a."{m}", 6) AS {m}_delta' for m in MEASURES)} FROM a JOIN b USING (split)""")

# J: splits, models, metrics.
add("j01_time_split", lambda b: scoring.time_split(b.t("events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "split"), "SELECT event_id, CASE WHEN r <= floor(n * 0.70) THEN 'train' WHEN r <= floor(n * 0.85) THEN 'validation' ELSE 'holdout' END AS split FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events)")
add("j02_random_split3", lambda b: scoring.random_split3(b.scores(), "id").select("id", "split"), "SELECT id, CASE WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * 0.75) THEN 'dev' ELSE 'test' END AS split FROM (SELECT id, row_number() OVER (ORDER BY md5(id || '|7'), id) AS r, count(*) OVER () AS n FROM sc)")
add("j03_stratified_split3", lambda b: scoring.stratified_split3(b.scores(), "id", "label").select("id", "split"), "SELECT id, CASE WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * 0.75) THEN 'dev' ELSE 'test' END AS split FROM (SELECT id, row_number() OVER (PARTITION BY label ORDER BY md5(id || '|7'), id) AS r, count(*) OVER (PARTITION BY label) AS n FROM sc)")
add("j04_class_weight", lambda b: scoring.class_weight(b.scores(), "label"), "SELECT count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1) AS positive_weight FROM sc")


def _trained(b: Tables, fit) -> DataFrame:
    parts = stored(scoring.stratified_split3(b.vectors(), "id", "label"))
    part = lambda s: parts.filter(F.col("split") == s)
    return scoring.score(fit(part("train"), part("dev")), part("test")).select("id", "label", "score")


add("j05_fit_logistic", lambda b: _trained(b, scoring.fit_logistic))
add("j06_fit_boosted_trees", lambda b: _trained(b, scoring.fit_boosted_trees))


def _trained_on_columns(b: Tables) -> DataFrame:
    """Orders scored by columns with categories and missing values: is an order finished, from its priority, price and customer."""
    c = b.t("customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), "c_mktsegment", "c_nationkey")
    rows = b.t("orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_totalprice").alias("price"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"), F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") == "F").cast("int").alias("label")).join(c, "o_custkey", "left")
    parts = stored(scoring.stratified_split3(rows, "id", "label"))
    part = lambda s: parts.filter(F.col("split") == s)
    inputs = scoring.fit_inputs(part("train"), ["price", "balance", "year"], ["priority", "c_mktsegment", "c_nationkey"])
    return scoring.score(scoring.fit_boosted_trees(part("train"), part("dev"), inputs=inputs), part("test")).select("id", "label", "score")


add("j06_fit_on_columns", _trained_on_columns)
add("j07_score", lambda b: scoring.ranking_quality(_trained(b, scoring.fit_logistic)))
EFF = "vs AS (SELECT vec_id AS id, CAST(label = 0 AS INT) AS label, embedding, row_number() OVER (PARTITION BY label = 0 ORDER BY md5(vec_id || '|7'), vec_id) AS r, count(*) OVER (PARTITION BY label = 0) AS n FROM embeddings), lng AS (SELECT id, label, r <= floor(n * 0.6) AS train, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(unnest(range(len(embedding))) AS INT) AS idx FROM vs), st AS (SELECT idx, avg(x) FILTER (WHERE label = 0) AS mean0, stddev_pop(x) FILTER (WHERE label = 0) AS std0, avg(x) FILTER (WHERE label = 1) AS mean1, stddev_pop(x) FILTER (WHERE label = 1) AS std1, avg(x) AS mean, stddev_pop(x) AS std0_ FROM lng WHERE train GROUP BY 1), eff AS (SELECT idx, mean0, std0, mean1, std1, mean, CASE WHEN std0_ < 1e-9 THEN 1 ELSE std0_ END AS std, d, CASE WHEN d < 0 THEN -1.0 ELSE 1.0 END AS sign FROM (SELECT *, CASE WHEN sqrt((std0 * std0 + std1 * std1) / 2) > 1e-9 THEN (mean1 - mean0) / sqrt((std0 * std0 + std1 * std1) / 2) ELSE 0 END AS d FROM st) ORDER BY abs(d) DESC, idx LIMIT 10)"
chosen = lambda b: scoring.effect_sizes(scoring.stratified_split3(b.vectors(), "id", "label").filter("split = 'train'"))
add("j08_effect_sizes", chosen, f", {EFF} SELECT * FROM eff")
add("j09_z_score_sum", lambda b: scoring.z_score_sum(b.vectors(), stored(chosen(b))), f", {EFF} SELECT id, avg(sign * (x - mean) / std) AS z FROM lng JOIN eff USING (idx) GROUP BY 1")
add("j10_pr_points", lambda b: scoring.pr_points(b.scores()).select("score", "tp", "fp", "precision", "recall"), 'SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, tp / (tp + fp) AS "precision", tp / pos AS recall FROM pr')
add("j11_best_f1_threshold", lambda b: scoring.best_f1_threshold(b.scores()), "SELECT arg_max(score, (f, -score)) AS threshold, max(f) AS f1 FROM (SELECT score, round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / pos) / (tp / (tp + fp) + tp / pos) ELSE 0 END, 9) AS f FROM pr)")
add("j12_metrics_at_threshold", lambda b: scoring.metrics_at_threshold(b.scores(), 0.4), 'SELECT count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE score >= 0.4) AS alerts, count(*) FILTER (WHERE score >= 0.4 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.4 AND label <> 1) AS fp, positives / rows AS rate, tp / nullif(alerts, 0) AS "precision", tp / nullif(positives, 0) AS recall, 2 * tp / nullif(alerts + positives, 0) AS f1, (rows - positives - fp + tp) / rows AS accuracy FROM sc')
add("j13_ranking_quality", lambda b: scoring.ranking_quality(b.scores()), "SELECT sum(tp / (tp + fp) * p) / any_value(pos) AS average_precision, sum(n * (tp - p) + n * p / 2) / (any_value(pos) * any_value(neg)) AS roc_auc FROM pr")
add("j14_top_k_metrics", lambda b: scoring.top_k_metrics(b.scores(), [10, 50, 100]), 'SELECT k, count(*) FILTER (WHERE label = 1) / count(*) AS "precision", count(*) FILTER (WHERE label = 1) / (SELECT count(*) FROM sc WHERE label = 1) AS recall, min(score) AS lowest FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM sc), (SELECT CAST(unnest([10, 50, 100]) AS INT) AS k) WHERE r <= k GROUP BY k')
SEG = "r3 AS (SELECT *, CASE WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * 0.75) THEN 'dev' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY md5(id || '|7'), id) AS r, count(*) OVER () AS n FROM sc)), th AS (SELECT segment, arg_max(score, (f, -score)) AS threshold, max(f) AS f1 FROM (SELECT segment, score, round(2 * sum(p) OVER w / (sum(a) OVER w + sum(p) OVER (PARTITION BY segment)), 9) AS f FROM (SELECT segment, score, count(*) FILTER (WHERE label = 1) AS p, count(*) AS a FROM r3 WHERE split = 'dev' GROUP BY 1, 2) WINDOW w AS (PARTITION BY segment ORDER BY score DESC)) GROUP BY 1), ap AS (SELECT segment, any_value(threshold) AS threshold, any_value(f1) AS f1, count(*) FILTER (WHERE score >= threshold) AS alerts, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE label = 1) AS positives FROM r3 LEFT JOIN th USING (segment) WHERE split = 'test' GROUP BY 1)"
split = lambda b, s: scoring.random_split3(b.scores(), "id").filter(F.col("split") == s).drop("split")
add("j15_segmented_threshold", lambda b: scoring.segmented_threshold(split(b, "dev"), split(b, "test"), "segment"), f", {SEG} SELECT * FROM ap UNION ALL SELECT NULL, NULL, round(2 * sum(tp) / nullif(sum(alerts) + sum(positives), 0), 9), CAST(sum(alerts) AS BIGINT), CAST(sum(tp) AS BIGINT), CAST(sum(positives) AS BIGINT) FROM ap")
add("j16_threshold_for_recall", lambda b: scoring.threshold_for_recall(evaluate.threshold_sweep(b.density_rows(), [0.1, 0.3, 0.5, 0.7]), 0.5), f", {SWEEP} SELECT arg_min(threshold, (CAST(r < 0.5 AS INT), round(abs(r - 0.5), 9), threshold)) AS threshold, arg_min(r, (CAST(r < 0.5 AS INT), round(abs(r - 0.5), 9), threshold)) AS recall FROM (SELECT threshold, captured / nullif(ap, 0) AS r FROM sw)")
halves = lambda b: b.scores().withColumn("split", F.when(F.col("id") % 2 == 0, "dev").otherwise("test"))
QUANTILES = [0.01 + 0.98 * k / 59 for k in range(60)]
CHOOSE = """dv AS (SELECT t, count(*) FILTER (WHERE label = 1 AND score >= t) / nullif(count(*) FILTER (WHERE label = 1), 0) AS r FROM sc, gr WHERE id % 2 = 0 GROUP BY t), ch AS (SELECT arg_min(t, (CAST(r < 0.5 AS INT), round(abs(r - 0.5), 9), t)) AS threshold FROM dv) SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS alerts, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE label = 1) AS positives FROM sc, ch WHERE id % 2 = 1 GROUP BY 1"""
add("j17_dev_then_test", lambda b: scoring.dev_then_test(halves(b), [0.1, 0.3, 0.5, 0.7, 0.9], 0.5), f", gr AS (SELECT CAST(unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS DOUBLE) AS t), {CHOOSE}")
add("j17_quantile_grid", lambda b: scoring.dev_then_test(halves(b), scoring.quantile_grid(b.scores(), QUANTILES), 0.5), f", gr AS (SELECT DISTINCT round(unnest(quantile_cont(score, {QUANTILES})), 9) AS t FROM sc), {CHOOSE}")
add("j17_every_dev_score", lambda b: scoring.dev_then_test(halves(b), None, 0.5), f", gr AS (SELECT DISTINCT score AS t FROM sc WHERE id % 2 = 0), {CHOOSE}")
add("j18_ensemble_or", lambda b: scoring.ensemble_or(b.scores().filter("score > 0.8").select("id"), b.scores().filter("segment = 1").select("id"), b.scores()), ", e AS (SELECT 'a' AS who, label, score > 0.8 AS h FROM sc UNION ALL SELECT 'b', label, segment = 1 FROM sc UNION ALL SELECT 'either', label, score > 0.8 OR segment = 1 FROM sc) SELECT who, count(*) FILTER (WHERE h) AS alerts, count(*) FILTER (WHERE h AND label = 1) AS tp, count(*) FILTER (WHERE h AND label = 1) / nullif(count(*) FILTER (WHERE label = 1), 0) AS recall FROM e GROUP BY 1")
add("j19_isolated_positives", lambda b: scoring.isolated_positives(b.strong(), b.node_labels()), "SELECT id FROM nl WHERE label = 1 AND id NOT IN (SELECT src FROM adj WHERE dst IN (SELECT id FROM nl WHERE label = 1))")

# K: reports.
audit = lambda b: b.t("events").select(F.col("event_id").alias("audit_id"), F.col("user_id").alias("cluster_key"), F.col("event_type").alias("event"))
cards = lambda b: b.t("customer").select(F.col("c_custkey").alias("cluster_key"), F.col("c_mktsegment").alias("stage"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("confidence"), (F.col("c_acctbal") > 0).alias("flagged"), F.when(F.col("c_custkey") % 3 == 0, "MANUAL_REVIEW").when(F.col("c_custkey") % 3 == 1, "HOLD_BONUS").alias("action"))
add("k01_list_clusters", lambda b: reports.list_clusters(cards(b), True, "BUILDING", "1", ["HOLD_BONUS", "NO_ACTION"]), "SELECT c_custkey AS cluster_key, c_mktsegment AS stage, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS confidence, true AS flagged, 'HOLD_BONUS' AS action FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING' AND contains(CAST(c_custkey AS VARCHAR), '1') AND c_custkey % 3 = 1")
add("k02_audit_tail", lambda b: reports.audit_tail(audit(b), 25), "SELECT * FROM aud ORDER BY audit_id DESC LIMIT 25")
add("k03_event_counts", lambda b: reports.counts_by(audit(b), "event"), "SELECT event, count(*) AS n FROM aud GROUP BY 1")
add("k04_evidence_chain", lambda b: reports.evidence_chain(cards(b), audit(b)), "SELECT cluster_key, event, max(audit_id) AS audit_id FROM aud WHERE cluster_key = (SELECT min(c_custkey) FROM customer WHERE c_acctbal > 0) GROUP BY 1, 2")
set_sizes = lambda b: b.truth().groupBy("set_id").agg(F.count(F.lit(1)).alias("size"))
add("k05_closest_by_size", lambda b: reports.closest_by_size(set_sizes(b), 5), "SELECT set_id, count(*) AS size FROM truth GROUP BY 1 ORDER BY abs(count(*) - 5), set_id LIMIT 1")
add("k06_confounder_table", lambda b: reports.confounder_table(cards(b), stage=["BUILDING", "MACHINERY"], flagged=[False]).select("cluster_key"), "SELECT c_custkey AS cluster_key FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT c_acctbal > 0")
flagged_sizes = lambda b: features.sizes(b.membership()).join(b.flags(), "cluster_key")
add("k07_size_distribution", lambda b: reports.size_distribution(flagged_sizes(b)), "SELECT size, count(*) AS clusters, count(*) FILTER (WHERE cluster_key IN (SELECT set_id FROM fl)) AS flagged FROM sz GROUP BY 1")
add("k07_largest", lambda b: reports.largest(flagged_sizes(b)), "SELECT *, cluster_key IN (SELECT set_id FROM fl) AS flagged FROM sz ORDER BY size DESC, cluster_key LIMIT 15")
add("k08_summary_counts", lambda b: reports.summary_counts(b.t("customer"), b.edges(), b.strong(), b.flags()), "SELECT 'nodes' AS measure, count(*) AS n FROM customer UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'hard_edges', count(*) FROM strong UNION ALL SELECT 'candidates', count(*) FROM sz UNION ALL SELECT 'flagged', count(DISTINCT set_id) FROM fl")

# L: arrivals. Rows before 1997 are known, those of 1997 come as a first batch and later ones as a second.
def _arrivals(b: Tables) -> DataFrame:
    """The rows of the components that the second batch touches."""
    inc = stored(b.numbered("l_partkey"))
    year = F.year(day_of(F.col("value")))
    index = ComponentIndex(b.spark, shared_folder(b.spark), "bigint", value_type="bigint")
    index.build(inc.filter(year < 1997))
    index.absorb(inc.filter(year == 1997), 0)
    return index.absorb(inc.filter(year > 1997), 1)


LATE = "late98 AS (SELECT DISTINCT cluster_key FROM comp JOIN si ON member = id WHERE substr(split_part(value, '|', 2), 1, 4) > '1997')"
add("l01_score_arrivals", lambda b: membership_of(_arrivals(b)).select("cluster_key", "member"), f", {LATE} SELECT cluster_key, member FROM comp WHERE cluster_key IN (SELECT cluster_key FROM late98)")
add("l01_judged_arrivals", lambda b: judge_touched(_arrivals(b), "shared_device", b.member(b.device()), b.member(b.instrument()), b.signup(), b.claim(), b.sessions(), b.orders()).select("cluster_key", "size", "organic_score", "suspicion_score", "rule", "flagged"),
    f", {LATE} SELECT cluster_key, size, organic_score, suspicion_score, rule, flagged FROM judged WHERE cluster_key IN (SELECT cluster_key FROM late98)")
