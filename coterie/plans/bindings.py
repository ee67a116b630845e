"""The test tables seen as the entity tables of the operators, in Spark and in SQL."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coterie.functions.storage import stored
from coterie.operators import cluster, derive, evaluate, factored, features, graph, rules

LABEL = "case when event_type = 'error' and value > p90 then 'From-Botnet' when event_type = 'view' then 'From-Normal' else 'Background' end"

BY_DISCOUNT = {"l_partkey"}  # keys whose lines are also asked for below a discount

DAYS, FIRST_DAY = 4_000_000, -719_528  # more days than dates have, and one before the first of them


def numbered_value(key: str, day: str) -> Column:
    """A number for key and day, where only equality counts or key_of and day_of give them back."""
    return F.col(key) * DAYS + F.unix_date(F.to_date(day)) - FIRST_DAY


def key_of(value: Column) -> Column:
    return ((value - F.pmod(value, F.lit(DAYS))) / DAYS).cast("long")


def day_of(value: Column) -> Column:
    return F.date_from_unix_date((F.pmod(value, F.lit(DAYS)) + FIRST_DAY).cast("int"))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.kept, self.single = spark, sf_dir, {}, None

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """What a query mentions several times, written once."""
        if name not in self.kept:
            self.kept[name] = stored(build())
        return self.kept[name]

    def t(self, name: str) -> DataFrame:
        """A table; its times without zone are read in the session's zone, as the operators compare instants."""
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})

    def events(self) -> DataFrame:
        return self.t("events").withColumn("k", F.get_json_object("props", "$.k"))

    def sessions(self) -> DataFrame:
        action = F.when(F.col("event_type") == "signup", "signup").when(F.col("event_type") == "click", "referral_claim").when(F.col("event_type") == "purchase", "order_placed").otherwise("login")
        return self.t("events").select("event_id", "user_id", "ts", action.alias("action_type"))

    def accounts(self) -> DataFrame:
        return self.t("customer").select(F.col("c_custkey").alias("user_id"), F.to_timestamp(F.lit("2024-01-01")).alias("signup_date"))

    def signup(self) -> DataFrame:
        return derive.first_action(self.sessions(), "signup", "signup_ts")

    def claim(self) -> DataFrame:
        return derive.claim_ts(self.sessions())

    def first_k(self, kind: str) -> DataFrame:
        return self.events().filter(F.col("event_type") == kind).groupBy(F.col("user_id").alias("id")).agg(F.min_by("k", "event_id").alias("value"))

    def device(self) -> DataFrame:
        return self.first_k("signup")

    def instrument(self) -> DataFrame:
        return self.first_k("purchase")

    def member(self, df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("id", "member")

    def lines(self, key: str, most_discount: float | None = None) -> DataFrame:
        lines = self.t("lineitem")
        lines = lines.filter(F.col("l_discount") < most_discount) if most_discount else lines
        return lines.select("l_orderkey", key, "l_shipdate").join(self.t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))

    def incidence(self, key: str) -> DataFrame:
        return self.lines(key).select(F.col("o_custkey").alias("id"), F.concat_ws("|", F.col(key).cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("value")).distinct()

    def numbered(self, key: str, most_discount: float | None = None) -> DataFrame:
        """A row a line: who ordered, and the number of key and day."""
        return self.lines(key, most_discount).select(F.col("o_custkey").alias("id"), numbered_value(key, "l_shipdate").alias("value"))

    def single_orders(self) -> bool:
        """Whether no order's key is there twice, so that only lines of two orders can be two customers'."""
        if self.single is None:
            keys = self.t("orders").select("o_orderkey").dropna()
            self.single = keys.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").count() == 0
        return self.single

    def shared_lines(self, key: str) -> DataFrame:
        """numbered() of the lines whose value lines of two orders or more have, as all values that two customers hold; these few are then joined with their orders."""
        more = ["l_discount"] if key in BY_DISCOUNT else []
        lines = self.t("lineitem").dropna(subset=["l_orderkey", key, "l_shipdate"]).select("l_orderkey", numbered_value(key, "l_shipdate").alias("value"), *more)
        if self.single_orders():
            of = Window.partitionBy("value")
            lines = lines.withColumn("a", F.min("l_orderkey").over(of)).withColumn("b", F.max("l_orderkey").over(of)).filter("a != b").drop("a", "b")
        orders = self.t("orders").select("o_orderkey", F.col("o_custkey").alias("id"))
        return lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select("id", "value", *more)

    def held(self, key: str, most_discount: float | None = None) -> DataFrame:
        """(id, value, n): keys() and how many known customers hold the value; one shuffle by value."""

        def shared() -> DataFrame:
            lines = self.once(f"lines {key}", lambda: self.shared_lines(key)) if key in BY_DISCOUNT else self.shared_lines(key)
            lines = lines.filter(F.col("l_discount") < most_discount) if most_discount else lines
            rows, of = lines.select("id", "value").repartition("value").distinct(), Window.partitionBy("value")
            return rows.withColumn("n", F.count("id").over(of)).withColumn("rows", F.count(F.lit(1)).over(of)).filter("rows >= 2").drop("rows")

        return self.once(f"keys {key} {most_discount}", shared)

    def keys(self, key: str, most_discount: float | None = None) -> DataFrame:
        """incidence() with a number for key and day in place of its text, where only equality counts, of the values that two or more hold."""
        return self.held(key, most_discount).select("id", "value")

    def strong(self) -> DataFrame:
        return self.once("strong", lambda: graph.shared_attribute_edges(self.keys("l_partkey"), "shared_device", graph.WEIGHTS["shared_device"]))

    def weak(self) -> DataFrame:
        return graph.shared_attribute_edges(self.keys("l_suppkey"), "ip_subnet_overlap", graph.WEIGHTS["ip_subnet_overlap"])

    def edges(self) -> DataFrame:
        parts = {"shared_device": self.keys("l_partkey"), "ip_subnet_overlap": self.keys("l_suppkey")}
        return self.once("edges", lambda: graph.attribute_edges(parts))

    def membership(self) -> DataFrame:
        return self.once("membership", lambda: cluster.connected_components(graph.star_edges(self.keys("l_partkey"))))

    def sets(self, df: DataFrame) -> DataFrame:
        return df.select(F.col("cluster_key").alias("set_id"), "member")

    def truth(self) -> DataFrame:
        return self.once("truth", lambda: self.sets(cluster.connected_components(graph.star_edges(self.keys("l_partkey", 0.09)))))

    def tagged(self) -> DataFrame:
        """Truth sets as rings, hard if the set's number is even, and customers of one supplier and ship day as look-alikes."""
        rings = self.truth().select("set_id", F.when(F.col("set_id") % 2 == 0, "hard").otherwise("soft").alias("type"), "member")
        return self.once("tagged", lambda: evaluate.tagged_sets(rings, self.confounders().withColumn("type", F.lit("office"))))

    def confounders(self) -> DataFrame:
        """The customers of one supplier and ship day, two or more; numbers of the two become text only here."""
        day = F.date_format(day_of(F.col("value")), "yyyy-MM-dd")
        return self.keys("l_suppkey").dropna(subset=["value"]).select(F.concat_ws("|", key_of(F.col("value")).cast("string"), day).alias("set_id"), F.col("id").alias("member"))

    def splits(self) -> DataFrame:
        if "splits" not in self.kept:
            self.kept["splits"] = evaluate.split_sets(self.tagged())
        return self.kept["splits"]

    def groups(self) -> DataFrame:
        """What edges() links, as groups; held() has each holder once, so no row is shuffled again."""
        parts = {"shared_device": self.held("l_partkey"), "ip_subnet_overlap": self.held("l_suppkey")}
        return factored.numbered_groups({signal: rows.filter("n >= 2 and id is not null") for signal, rows in parts.items()}, graph.WEIGHTS)

    def orders(self) -> DataFrame:
        return self.t("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("order_value"), F.col("o_orderdate").alias("order_date"))

    def cod_orders(self) -> DataFrame:
        return self.t("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("order_value"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_cod"), (F.col("o_orderstatus") == "F").alias("is_refused"))

    def referrals(self) -> DataFrame:
        u = self.t("events").select("user_id").distinct()
        return u.select(F.floor(F.col("user_id") / 2).cast("long").alias("referrer_user_id"), F.col("user_id").alias("referred_user_id"))

    def flows(self) -> DataFrame:
        p90 = self.t("events").agg(F.percentile("value", 0.9).alias("p90"))
        e = self.events().crossJoin(F.broadcast(p90))
        return e.selectExpr("cast(user_id as string) as src", "k as dst", "event_type as port", "cast(event_id % 3 as string) as proto", "concat('w', weekofyear(ts)) as capture", "value as dur", "cast(event_id % 10 + 1 as double) as pkts", "value * 10 as bytes", "value as src_bytes", f"{LABEL} as label")

    def scores(self) -> DataFrame:
        d = self.t("documents").select("doc_id", "n_chars")
        return self.t("labels").join(d, "doc_id").select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"), F.col("toxic").alias("label"), (F.col("n_chars") % 3).alias("segment"))

    def vectors(self) -> DataFrame:
        return self.t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), (F.col("label") == 0).cast("int").alias("label"))

    def node_labels(self) -> DataFrame:
        """Customers of the machinery segment are positive, of the furniture segment unlabeled."""
        return self.t("customer").filter("c_mktsegment != 'FURNITURE'").select(F.col("c_custkey").alias("id"), (F.col("c_mktsegment") == "MACHINERY").cast("int").alias("label"))

    def features(self) -> DataFrame:
        m = self.membership()
        return self.once("features", lambda: features.cluster_features(self.edges(), m, self.member(self.device()), self.member(self.instrument()), self.signup(), self.claim(), self.sessions(), self.orders()))

    def judged(self) -> DataFrame:
        return rules.verdict(self.features())

    def flagged_sets(self, above: float = 0.3) -> DataFrame:
        """The clusters flagged by their density of positive labels, with their members; the rules flag none of these tables' clusters."""
        return self.sets(self.membership().join(self.flags(above).filter("flagged"), "cluster_key", "left_semi"))

    def flags(self, above: float = 0.3) -> DataFrame:
        return self.once(f"flags {above}", lambda: self.density_rows().select("cluster_key", F.coalesce(F.col("density") > above, F.lit(False)).alias("flagged")))

    def density_rows(self) -> DataFrame:
        return features.label_density(self.membership(), self.node_labels())


PRELUDE = """WITH RECURSIVE ev AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events),
sess AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'signup' WHEN 'click' THEN 'referral_claim' WHEN 'purchase' THEN 'order_placed' ELSE 'login' END AS action_type FROM events),
su AS (SELECT user_id, min(ts) AS signup_ts FROM sess WHERE action_type = 'signup' GROUP BY 1),
cl AS (SELECT user_id, min(ts) AS claim_ts FROM sess WHERE action_type = 'referral_claim' GROUP BY 1),
dev AS (SELECT user_id AS id, arg_min(k, event_id) AS value FROM ev WHERE event_type = 'signup' GROUP BY 1),
ins AS (SELECT user_id AS id, arg_min(k, event_id) AS value FROM ev WHERE event_type = 'purchase' GROUP BY 1),
si AS (SELECT DISTINCT o_custkey AS id, l_partkey || '|' || strftime(l_shipdate, '%Y-%m-%d') AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ti AS (SELECT DISTINCT o_custkey AS id, l_partkey || '|' || strftime(l_shipdate, '%Y-%m-%d') AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount < 0.09),
wi AS (SELECT DISTINCT o_custkey AS id, l_suppkey || '|' || strftime(l_shipdate, '%Y-%m-%d') AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
strong AS (SELECT a.id AS src, b.id AS dst, count(*) * 3.0 AS weight, 'shared_device' AS signal FROM si a JOIN si b ON a.value = b.value AND a.id < b.id GROUP BY 1, 2),
weak AS (SELECT a.id AS src, b.id AS dst, count(*) * 2.0 AS weight, 'ip_subnet_overlap' AS signal FROM wi a JOIN wi b ON a.value = b.value AND a.id < b.id GROUP BY 1, 2),
tstrong AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM ti a JOIN ti b ON a.value = b.value AND a.id < b.id),
edges AS (SELECT src, dst, sum(weight) AS weight, array_to_string(list_sort(list_distinct(list(signal))), ',') AS signals FROM (SELECT * FROM strong UNION ALL SELECT * FROM weak) GROUP BY 1, 2),
adj AS (SELECT src, dst FROM strong UNION ALL SELECT dst, src FROM strong),
reach AS (SELECT DISTINCT src AS n, src AS m FROM adj UNION SELECT reach.n, adj.dst FROM reach JOIN adj ON reach.m = adj.src),
comp AS (SELECT min(m) AS cluster_key, n AS member FROM reach GROUP BY n),
tadj AS (SELECT src, dst FROM tstrong UNION ALL SELECT dst, src FROM tstrong),
treach AS (SELECT DISTINCT src AS n, src AS m FROM tadj UNION SELECT treach.n, tadj.dst FROM treach JOIN tadj ON treach.m = tadj.src),
truth AS (SELECT min(m) AS set_id, n AS member FROM treach GROUP BY n),
nl AS (SELECT c_custkey AS id, CAST(c_mktsegment = 'MACHINERY' AS INT) AS label FROM customer WHERE c_mktsegment <> 'FURNITURE'),
ld AS (SELECT cluster_key, count(label) AS labeled, coalesce(sum(label), 0) AS positives, avg(label) AS density FROM comp LEFT JOIN nl ON member = id GROUP BY 1),
fl AS (SELECT cluster_key AS set_id, member FROM comp WHERE cluster_key IN (SELECT cluster_key FROM ld WHERE density > 0.3)),
ov AS (SELECT t.set_id AS a_id, f.set_id AS b_id, count(*) AS overlap, count(*) / any_value(tn.n) AS recall, count(*) / any_value(fn.n) AS "precision" FROM truth t JOIN fl f USING (member)
    JOIN (SELECT set_id, count(*) AS n FROM truth GROUP BY 1) tn ON tn.set_id = t.set_id JOIN (SELECT set_id, count(*) AS n FROM fl GROUP BY 1) fn ON fn.set_id = f.set_id GROUP BY 1, 2),
best AS (SELECT s.set_id, b.b_id AS cluster_key FROM (SELECT DISTINCT set_id FROM truth) s LEFT JOIN
    (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY least(recall, "precision") DESC, b_id) AS p FROM ov WHERE recall >= 0.5 AND "precision" >= 0.5) b ON s.set_id = b.a_id AND b.p = 1),
ind AS (SELECT a.cluster_key, e.* FROM edges e JOIN comp a ON e.src = a.member JOIN comp b ON e.dst = b.member WHERE a.cluster_key = b.cluster_key),
sz AS (SELECT cluster_key, count(*) AS size FROM comp GROUP BY 1),
f01 AS (SELECT s.cluster_key, size, coalesce(n, 0) AS n_edges, CASE WHEN size > 1 THEN round(coalesce(n, 0) / (size * (size - 1) / 2), 4) ELSE 0 END AS edge_density FROM sz s LEFT JOIN (SELECT cluster_key, count(*) AS n FROM ind GROUP BY 1) USING (cluster_key)),
f02 AS (SELECT cluster_key, array_to_string(list_sort(list_distinct(flatten(list(string_split(signals, ','))))), ',') AS signals_present FROM ind GROUP BY 1),
f03d AS (SELECT s.cluster_key, coalesce(top, 0) >= 2 AS shared_device, round(coalesce(top, 0) / size, 3) AS shared_device_frac FROM sz s LEFT JOIN (SELECT cluster_key, max(n) AS top FROM (SELECT cluster_key, value, count(*) AS n FROM comp JOIN dev ON member = id GROUP BY 1, 2) GROUP BY 1) USING (cluster_key)),
f03i AS (SELECT s.cluster_key, coalesce(top, 0) >= 2 AS shared_instrument, round(coalesce(top, 0) / size, 3) AS shared_instrument_frac FROM sz s LEFT JOIN (SELECT cluster_key, max(n) AS top FROM (SELECT cluster_key, value, count(*) AS n FROM comp JOIN ins ON member = id GROUP BY 1, 2) GROUP BY 1) USING (cluster_key)),
f04 AS (SELECT cluster_key, round(coalesce(CASE WHEN count(signup_ts) >= 2 THEN (epoch_us(max(signup_ts)) - epoch_us(min(signup_ts))) / 3.6e9 / 24 END, 0), 2) AS signup_span_days,
    round(coalesce(CASE WHEN count(signup_ts) >= 2 THEN (epoch_us(max(signup_ts)) - epoch_us(min(signup_ts))) / 3.6e9 / (count(signup_ts) - 1) END, 0), 2) AS avg_gap_hours FROM comp LEFT JOIN su ON member = user_id GROUP BY 1),
lastev AS (SELECT user_id, max(ts) AS last FROM sess GROUP BY 1),
f05 AS (SELECT cluster_key, round(count(*) FILTER (WHERE signup_ts IS NOT NULL AND claim_ts IS NOT NULL) / count(*), 3) AS claim_frac, round(avg((epoch_us(claim_ts) - epoch_us(signup_ts)) / 3.6e9), 2) AS bonus_claim_velocity_hours,
    round(avg(CASE WHEN signup_ts IS NOT NULL AND claim_ts IS NOT NULL THEN CAST(last <= claim_ts + INTERVAL 3 DAY AS INT) END), 3) AS claim_then_dormant_frac
    FROM comp LEFT JOIN su ON member = su.user_id LEFT JOIN cl ON member = cl.user_id LEFT JOIN lastev ON member = lastev.user_id GROUP BY 1),
f07 AS (SELECT cluster_key, count(o_totalprice) AS n_orders, CASE WHEN count(o_totalprice) >= 2 AND avg(o_totalprice) > 0 THEN round(stddev_samp(o_totalprice) / avg(o_totalprice), 4) END AS order_value_cv FROM comp LEFT JOIN orders ON member = o_custkey GROUP BY 1),
late AS (SELECT s.user_id, count(*) AS late FROM sess s JOIN su USING (user_id) WHERE ts > signup_ts + INTERVAL 7 DAY GROUP BY 1),
f08 AS (SELECT cluster_key, round(coalesce(sum(late), 0) / count(*), 3) AS post_signup_engagement FROM comp LEFT JOIN late ON member = user_id GROUP BY 1),
f09 AS (SELECT * FROM f01 LEFT JOIN f02 USING (cluster_key) LEFT JOIN f03d USING (cluster_key) LEFT JOIN f03i USING (cluster_key) LEFT JOIN f04 USING (cluster_key) LEFT JOIN f05 USING (cluster_key) LEFT JOIN f07 USING (cluster_key) LEFT JOIN f08 USING (cluster_key)),
g0 AS (SELECT *, CAST(signup_span_days >= 21 AS INT) + coalesce(CAST(order_value_cv >= 0.28 AS INT), 0) + CAST(post_signup_engagement >= 1.5 AS INT) AS organic_score,
    CAST(signup_span_days <= 7 AS INT) + coalesce(CAST(order_value_cv < 0.15 AS INT), 0) + coalesce(CAST(claim_then_dormant_frac >= 0.4 AS INT), 0) + coalesce(CAST(bonus_claim_velocity_hours <= 12 AS INT), 0) AS suspicion_score FROM f09),
g03 AS (SELECT *, CASE WHEN shared_instrument THEN 'instrument' WHEN shared_device AND organic_score >= 3 THEN 'household' WHEN shared_device THEN 'device' WHEN organic_score >= 2 THEN 'organic' WHEN suspicion_score >= 3 THEN 'pattern' ELSE 'weak' END AS rule FROM g0),
judged AS (SELECT *, rule IN ('instrument', 'device', 'pattern') AS flagged FROM g03),
flows AS (SELECT CAST(user_id AS VARCHAR) AS src, k AS dst, event_type AS port, CAST(event_id % 3 AS VARCHAR) AS proto, 'w' || weekofyear(ts) AS capture, value AS dur, CAST(event_id % 10 + 1 AS DOUBLE) AS pkts, value * 10 AS bytes, value AS src_bytes,
    case when event_type = 'error' and value > (SELECT quantile_cont(value, 0.9) FROM events) then 'From-Botnet' when event_type = 'view' then 'From-Normal' else 'Background' end AS label FROM ev),
hosts AS (SELECT capture || ':' || src AS host, * FROM flows),
cod AS (SELECT o_custkey AS user_id, o_totalprice, o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_cod, o_orderstatus = 'F' AS is_refused FROM orders),
f10 AS (SELECT * FROM f01 LEFT JOIN f02 USING (cluster_key) JOIN (SELECT c.cluster_key, count(o_totalprice) AS n_orders, count(*) FILTER (WHERE is_cod) AS n_cod_orders, coalesce(round(count(*) FILTER (WHERE is_cod) / nullif(count(o_totalprice), 0), 3), 0) AS cod_fraction,
    round(count(*) FILTER (WHERE is_cod AND is_refused) / nullif(count(*) FILTER (WHERE is_cod), 0), 3) AS refusal_rate, round(round(avg(o_totalprice), 6), 2) AS avg_order_value,
    CASE WHEN count(o_totalprice) >= 2 AND avg(o_totalprice) > 0 THEN round(stddev_samp(o_totalprice) / avg(o_totalprice), 4) END AS order_value_cv, any_value(shared_device) AS shared_address, any_value(shared_device_frac) AS shared_address_frac
    FROM comp c LEFT JOIN cod ON member = user_id JOIN f03d USING (cluster_key) GROUP BY 1) USING (cluster_key)),
sc AS (SELECT l.doc_id AS id, (n_chars % 1000) / 1000.0 AS score, toxic AS label, n_chars % 3 AS segment FROM labels l JOIN documents d USING (doc_id)),
pr AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM (SELECT score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label <> 1) AS n FROM sc GROUP BY 1) WINDOW w AS (ORDER BY score DESC)),
tg AS (SELECT 'ring' AS kind, CAST(set_id AS VARCHAR) AS set_id, CASE WHEN set_id % 2 = 0 THEN 'hard' ELSE 'soft' END AS type, member FROM truth
    UNION ALL SELECT 'confounder', value, 'office', id FROM wi WHERE value IN (SELECT value FROM wi GROUP BY 1 HAVING count(*) >= 2)),
tn AS (SELECT kind, set_id, any_value(type) AS type, count(*) AS size FROM tg GROUP BY 1, 2),
spl AS (SELECT kind, set_id, CASE WHEN row_number() OVER (PARTITION BY kind ORDER BY md5(set_id || '|7'), set_id) <= greatest(1, floor(count(*) OVER (PARTITION BY kind) * 0.3)) THEN 'holdout' ELSE 'dev' END AS split FROM tn),
aud AS (SELECT event_id AS audit_id, user_id AS cluster_key, event_type AS event FROM events)
"""


def evaluated(name: str, flagged: str) -> str:
    """CTEs ``name``_o, the outcome of every tagged set against the sets of ``flagged``, _t, what its clusters touch, and _e, the report by split."""
    return f"""{name}_p AS (SELECT kind, set_id, b_id, count(*) / any_value(size) AS recall, count(*) / any_value(fn.n) AS prec FROM tg JOIN (SELECT set_id AS b_id, member FROM {flagged}) f USING (member) JOIN tn USING (kind, set_id)
    JOIN (SELECT set_id AS b_id, count(*) AS n FROM {flagged} GROUP BY 1) fn USING (b_id) GROUP BY 1, 2, 3),
{name}_o AS (SELECT kind, set_id, type, size, arg_min(b_id, (-least(recall, prec), b_id)) FILTER (WHERE recall >= 0.5 AND prec >= 0.5) AS cluster_key FROM tn LEFT JOIN {name}_p USING (kind, set_id) GROUP BY 1, 2, 3, 4),
{name}_s AS (SELECT *, split AS part FROM {name}_o JOIN spl USING (kind, set_id) UNION ALL SELECT *, 'overall' FROM {name}_o JOIN spl USING (kind, set_id)),
{name}_g AS (SELECT part, b_id, max(CAST(kind = 'ring' AND recall >= 0.5 AND prec >= 0.5 AS INT)) AS good FROM (SELECT p.*, split AS part FROM {name}_p p JOIN spl USING (kind, set_id) UNION ALL SELECT p.*, 'overall' FROM {name}_p p) GROUP BY 1, 2),
{name}_t AS (SELECT part AS split, count(*) AS relevant, CAST(sum(good) AS BIGINT) AS true_clusters, CAST(sum(1 - good) AS BIGINT) AS false_clusters, avg(good) AS "precision" FROM {name}_g GROUP BY 1),
{name}_e AS (SELECT part AS split, count(*) FILTER (WHERE type = 'hard') AS n_hard, avg(CAST(cluster_key IS NOT NULL AS INT)) FILTER (WHERE type = 'hard') AS hard_recall, count(*) FILTER (WHERE type = 'soft') AS n_soft, avg(CAST(cluster_key IS NOT NULL AS INT)) FILTER (WHERE type = 'soft') AS soft_recall,
    count(*) FILTER (WHERE kind = 'ring') AS n_rings, avg(CAST(cluster_key IS NOT NULL AS INT)) FILTER (WHERE kind = 'ring') AS recall, count(*) FILTER (WHERE kind = 'confounder') AS n_confounders, avg(CAST(cluster_key IS NOT NULL AS INT)) FILTER (WHERE kind = 'confounder') AS false_positive_rate
    FROM {name}_s GROUP BY 1)"""
