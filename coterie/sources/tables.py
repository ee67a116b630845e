"""Reading, cleaning and validating activity tables (A)."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coterie.functions.storage import shared_folder

TABLES = {
    "accounts": ["user_id", "signup_date", "phone_number", "email", "device_fingerprint_id", "ip_address_at_signup", "referral_code_used", "referred_by_user_id", "kyc_status", "home_pincode"],
    "sessions": ["session_id", "user_id", "device_fingerprint_id", "ip_address", "timestamp", "action_type"],
    "referrals": ["referral_id", "referrer_user_id", "referred_user_id", "bonus_amount", "bonus_status", "claim_date"],
    "payment_instruments": ["user_id", "instrument_hash", "instrument_first_seen_date"],
    "orders": ["user_id", "order_id", "order_value", "order_date", "delivery_pincode"],
}
COD_TABLES = {
    "accounts": ["user_id", "signup_date", "phone_number", "delivery_address_hash", "home_pincode"],
    "orders": ["order_id", "user_id", "order_value", "order_date", "payment_method", "delivery_status"],
}


def read_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with header as strings, or a Parquet table cast to them."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select([F.col(c).cast("string") for c in columns])
    return spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("header", True).csv(path)


def read_entity_tables(spark: SparkSession, folder: str, tables: dict[str, list[str]] = TABLES) -> dict[str, DataFrame]:
    return {name: read_strings(spark, f"{folder}/{name}.csv", columns) for name, columns in tables.items()}


def read_cod_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    raw = read_entity_tables(spark, folder, COD_TABLES)
    return {"accounts": safe_timestamp(raw["accounts"], "signup_date"), "orders": safe_number(safe_timestamp(raw["orders"], "order_date"), "order_value")}


def has_text(c: Column | str) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) != ""


def drop_missing_id(df: DataFrame, column: str) -> DataFrame:
    return df.filter(has_text(F.col(column).cast("string")))


def safe_timestamp(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.expr(f"try_cast(`{column}` as timestamp)")).filter(F.col(column).isNotNull())


def safe_number(df: DataFrame, column: str, least: float = 0.0) -> DataFrame:
    return df.withColumn(column, F.expr(f"try_cast(`{column}` as double)")).filter((F.col(column) >= least) & ~F.isnan(column))


def _first_failed(checks: dict[str, Column]) -> Column:
    return reduce(lambda out, x: out.when(x[1], x[0]), list(checks.items())[1:], F.when(next(iter(checks.values())), next(iter(checks))))


def _report(failed: DataFrame, table: str, examples: int) -> DataFrame:
    """(table_name, reason, rows_dropped, examples) of failed(key, reason)."""
    top = failed.withColumn("place", F.row_number().over(Window.partitionBy("reason").orderBy("key"))).filter(F.col("place") <= examples)
    some = top.groupBy("reason").agg(F.sort_array(F.collect_list("key")).alias("examples"))
    return failed.groupBy("reason").agg(F.count(F.lit(1)).alias("rows_dropped")).join(some, "reason", "left").select(F.lit(table).alias("table_name"), "reason", "rows_dropped", F.coalesce(F.array_join("examples", ","), F.lit("")).alias("examples"))


def quality_report(df: DataFrame, table: str, key: str, checks: dict[str, Column], examples: int = 3) -> DataFrame:
    """Rows dropped for each first failed check, with the smallest keys as examples. checks: {reason: condition that fails}."""
    failed = df.select(F.col(key).cast("string").alias("key"), _first_failed(checks).alias("reason")).filter("reason is not null")
    return _report(failed, table, examples)


def clean(df: DataFrame, table: str, key: str, checks: dict[str, Column], examples: int = 3) -> tuple[DataFrame, DataFrame]:
    """(the rows that fail no check, quality_report of the others), from one pass over ``df``.

    The pass writes rows apart by their first failed check; kept rows are read from theirs, and the report reads the dropped ones only.
    """
    reason = "_reason"
    while reason in df.columns:
        reason += "_"
    path = shared_folder(df.sparkSession)
    split = df.withColumn(reason, F.coalesce(_first_failed(checks), F.lit("")))
    split.write.partitionBy(reason).parquet(path)
    back = df.sparkSession.read.schema(split.schema).parquet(path)
    none = F.col(reason).isNull() | (F.col(reason) == "")  # an empty partition value reads back as null
    failed = back.filter(~none).select(F.col(key).cast("string").alias("key"), F.col(reason).alias("reason"))
    return back.filter(none).drop(reason), _report(failed, table, examples)


ERRORS = "table_name string, row_key string, error string"


def validate_table(df: DataFrame, table: str, key: str, required: list[str], dates: list[str] = (), numbers: list[str] = (), enums: dict[str, list[str]] | None = None) -> DataFrame:
    """(table_name, row_key, error) for missing columns, bad dates, numbers and values."""
    missing = [c for c in required if c not in df.columns]
    spark = df.sparkSession
    out = spark.createDataFrame([(table, None, f"missing column {c}") for c in missing], ERRORS)
    bad = [F.when(has_text(c) & F.expr(f"try_cast(`{c}` as timestamp)").isNull(), F.lit(f"bad date in {c}")) for c in dates if c in df.columns]
    bad += [F.when(has_text(c) & F.expr(f"try_cast(`{c}` as double)").isNull(), F.lit(f"bad number in {c}")) for c in numbers if c in df.columns]
    bad += [F.when(has_text(c) & ~F.col(c).isin(v), F.lit(f"bad value in {c}")) for c, v in (enums or {}).items() if c in df.columns]
    if not bad:
        return out
    rows = df.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.explode(F.array_compact(F.array(*bad))).alias("error"))
    return out.unionByName(rows)


def validate_tables(tables: dict[str, DataFrame], specs: dict[str, dict], root: str, key: str) -> DataFrame:
    """(table_name, row_key, error) for all ``tables``; no row means valid, and nothing is corrected.

    specs: {table: arguments of validate_table, "key" and "required" at least}. Without the table ``root`` that is the
    only error. A table without a spec is unknown; one without a required column gets no further checks of its values.
    Values of the column ``key`` that ``root`` lacks are orphans in every table that holds them, once a value.
    """
    if root not in tables:
        spark = next(iter(tables.values())).sparkSession if tables else SparkSession.getActiveSession()
        return spark.createDataFrame([(root, None, "missing table")], ERRORS)
    spark = tables[root].sparkSession
    out = [spark.createDataFrame([(name, None, "unknown table") for name in tables if name not in specs], ERRORS)]
    for name, df in ((n, d) for n, d in tables.items() if n in specs):
        spec = specs[name]
        if set(spec["required"]) - set(df.columns):
            out.append(validate_table(df, name, spec["key"], spec["required"]))
        else:
            out.append(validate_table(df, name, **spec))
        if name != root and key in df.columns and key in tables[root].columns:
            out.append(orphan_keys(df, tables[root], key, key).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.lit(f"{key} not in {root}").alias("error")))
    return reduce(DataFrame.unionByName, out)


def orphan_keys(child: DataFrame, parent: DataFrame, column: str, parent_column: str) -> DataFrame:
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return child.filter(F.col(column).isNotNull()).select(column).distinct().join(keys, column, "left_anti")


def overlay(base: DataFrame, extra: DataFrame) -> DataFrame:
    return base.unionByName(extra, allowMissingColumns=True)


def expand_nested_accounts(df: DataFrame) -> dict[str, DataFrame]:
    """Records with parallel arrays (user_id, device, signup_ts, instruments, action_types, action_times, order_values, order_dates) as flat tables."""
    actions = df.select("user_id", F.posexplode(F.arrays_zip("action_types", "action_times")).alias("at", "a"))
    orders = df.select("user_id", F.posexplode(F.arrays_zip("order_values", "order_dates")).alias("at", "o"))
    return {
        "accounts": df.select("user_id", "device", "signup_ts"),
        "payment_instruments": df.select("user_id", F.explode("instruments").alias("instrument_hash")),
        "sessions": actions.select("user_id", "at", F.col("a.action_types").alias("action_type"), F.col("a.action_times").alias("ts")),
        "orders": orders.select("user_id", "at", F.col("o.order_values").alias("order_value"), F.col("o.order_dates").alias("order_date")),
        "referrals": df.filter("referred_by is not null").select(F.col("referred_by").alias("referrer_user_id"), F.col("user_id").alias("referred_user_id")),
    }


TRUTH = "map<string, struct<type:string, difficulty:string, members:array<string>, description:string>>"


def read_truth(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(set_id, type, difficulty, member) from nested truth JSON: one object a file, or one a line in large files."""
    return truth_rows(spark.read.option("wholetext", not lines).text(path).select("value"))


def truth_rows(texts: DataFrame) -> DataFrame:
    one = texts.select(F.explode(F.from_json("value", TRUTH)).alias("set_id", "s"))
    return one.select("set_id", "s.type", "s.difficulty", F.explode("s.members").alias("member"))


def read_labeled_nodes(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, label): class 1 is 1, other known classes 0; only ids that are nodes."""
    known = classes.filter(F.col("class") != "unknown").select("id", (F.col("class") == "1").cast("int").alias("label"))
    return known.join(nodes.select("id").distinct(), "id", "left_semi")


def restrict_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def flow_flags(flows: DataFrame) -> DataFrame:
    """Scopes hosts by capture and derives the three label flags from the label text."""
    text = F.lower("label")
    return flows.withColumn("host", F.concat_ws(":", "capture", "src")).withColumn("is_botnet", text.contains("botnet")).withColumn("is_normal", text.contains("normal")).withColumn("is_background", text.contains("background"))


def read_flows(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """{capture: path} of flow CSVs (SrcAddr, DstAddr, Dport, Proto, Dur, TotPkts, TotBytes, SrcBytes, Label)."""
    schema = "SrcAddr string, DstAddr string, Dport string, Proto string, Dur double, TotPkts double, TotBytes double, SrcBytes double, Label string"
    parts = [spark.read.schema(schema).option("header", True).csv(p).withColumn("capture", F.lit(c)) for c, p in paths.items()]
    return flow_flags(reduce(DataFrame.unionByName, parts).withColumnRenamed("SrcAddr", "src"))


def join_identity(transactions: DataFrame, identity: DataFrame, key: str) -> DataFrame:
    return transactions.join(identity, key, "left")


def assert_columns(df: DataFrame, expected: list[str], label: str | None = None) -> DataFrame:
    """df, or an error if columns miss or the label has one class only."""
    if missing := sorted(set(expected) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    if label and df.select(label).distinct().limit(2).count() < 2:
        raise ValueError(f"{label} has one class only")
    return df


def ip_subnet(ip: Column) -> Column:
    return F.when(F.size(F.split(ip, r"\.")) == 4, F.substring_index(ip, ".", 3))


def next_entity_index(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.coalesce(F.max(F.regexp_extract(column, r"(\d+)$", 1).try_cast("bigint")), F.lit(0)) + 1).alias("next_index"))
