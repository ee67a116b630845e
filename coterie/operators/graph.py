"""Entity graphs: edges from shared attribute values and referrals (D).

edges(src, dst, weight, signals) with src < dst; incidence(id, value).
"""

from collections.abc import Callable
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from coterie.functions.storage import stored

# Names of signals by priority, those of the hard graph, and the weights of each.
PRIORITY = ["shared_instrument", "shared_device", "ip_subnet_overlap", "referral_link", "shared_address", "phone_prefix"]
HARD = ["shared_instrument", "shared_device", "shared_address"]
PAIRS_PER_CELL = 500_000  # pairs that one task makes at a time, on average
ROWS_PER_BATCH = 100_000  # pairs that a task hands on at once
MOST_CODES = 2**62  # numbers of a pair with a value that sort as one
WEIGHTS = {"shared_instrument": 4.0, "shared_device": 3.0, "ip_subnet_overlap": 2.0, "shared_address": 4.0, "phone_prefix": 2.0}


def valid_value(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return text.isNotNull() & (text != "") & (F.lower(text) != "nan")


def valid_rows(incidence: DataFrame) -> DataFrame:
    """The rows of incidence(id, value) whose value is valid; numbers need no text for that."""
    rows = incidence.select("id", "value")
    return rows.dropna(subset=["value"]) if isinstance(rows.schema["value"].dataType, IntegralType) else rows.filter(valid_value(F.col("value")))


def _groups(incidence: DataFrame, cap: int | None, keys: list[str]) -> DataFrame:
    sizes = incidence.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return sizes.filter(F.col("n") <= cap) if cap else sizes


def holder_pairs(rows: DataFrame, key: list[str], holder: str) -> DataFrame:
    """(cell, *key, src, dst): every two holders src < dst of one key, once for each two of their rows; rows has just these columns.

    Holders fall into blocks by hash, and a cell is all pairs of two blocks, as many cells as keep ``PAIRS_PER_CELL`` in each.
    A row is sent to the cells of the blocks that its key's other holders are in, so that one task has all pairs of a cell, whatever
    keys they share: sums by cell, src and dst take no shuffle of pairs, and no task has all pairs of a key with many holders.
    """
    rows = rows.dropna(subset=key)
    n = F.col("n")
    pairs = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    cells = max(1, ceil(pairs / PAIRS_PER_CELL))
    blocks = ceil(sqrt(2 * cells)) if cells > 1 else 1
    if blocks == 1:
        placed = rows.withColumn("cell", F.lit(0)).withColumn("side", F.lit(0))
    else:
        own = rows.withColumn("i", F.pmod(F.xxhash64(holder), F.lit(blocks)).cast("int"))
        met = own.groupBy(*key, "i").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.collect_list(F.struct(F.col("i").alias("j"), "n")).alias("met"))
        sent = own.join(met.hint("merge"), key).select(*key, holder, "i", F.explode("met").alias("m")).filter("i != m.j or m.n > 1")
        placed = sent.select(*key, holder, (F.greatest("i", "m.j") * blocks + F.least("i", "m.j")).alias("cell"), F.when(F.col("i") == F.col("m.j"), 0).when(F.col("i") < F.col("m.j"), 1).otherwise(2).alias("side"))
    side = lambda other: F.collect_list(F.when(F.col("side") != other, F.col(holder)))
    lists = placed.repartition(cells, "cell").groupBy("cell", *key).agg(side(2).alias("left"), side(1).alias("right"), F.max("side").alias("side"))
    both = lists.select("cell", "side", *key, F.explode("left").alias("a"), "right").select("cell", "side", *key, "a", F.explode("right").alias("b"))
    return both.filter("if(side = 0, a < b, a != b)").select("cell", *key, F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def holder_lists(rows: DataFrame, key: list[str], holder: str, pairs_per_cell: int) -> DataFrame:
    """(cell, *key, side, holders): the cells of holder_pairs, with a key's holders of one block as a list; rows has each once, without nulls.

    Every two holders of a key meet in one cell: within a list of side 0, or one of side 1 and one of side 2.
    """
    n = F.col("n")
    pairs = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    cells = max(1, ceil(pairs / pairs_per_cell))
    blocks = ceil(sqrt(2 * cells)) if cells > 1 else 1
    block = F.pmod(F.xxhash64(holder), F.lit(blocks)).cast("int").alias("i")
    lists = rows.groupBy(*key, block).agg(F.collect_list(holder).alias("holders"))
    met = lists.groupBy(*key).agg(F.collect_list("i").alias("met"))
    sent = lists.join(met.hint("merge"), key).select(*key, "holders", "i", F.explode("met").alias("j")).filter("i != j or size(holders) > 1")
    side = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2)
    return sent.select((F.greatest("i", "j") * blocks + F.least("i", "j")).alias("cell"), *key, side.alias("side"), "holders").repartition(blocks * (blocks + 1) // 2, "cell")


def shared_attribute_edges(incidence: DataFrame, signal: str, weight: float, cap: int | None = None) -> DataFrame:
    """An edge for every pair that shares a value; groups above a cap make none, if one is given. Repeated rows add their weight again.

    A group of n makes n (n - 1) / 2 edges; where only reachability counts, star_edges links groups of any size with n - 1.
    """
    pairs = holder_pairs(stored(_small(incidence, cap)), ["value"], "id")
    return pairs.groupBy("cell", "src", "dst").agg((F.count(F.lit(1)) * F.lit(float(weight))).alias("weight")).drop("cell").withColumn("signals", F.array(F.lit(signal)))


def _small(incidence: DataFrame, cap: int | None) -> DataFrame:
    """The rows of valid values that two rows or more hold and, if a cap is given, no more than that."""
    valid = valid_rows(incidence)
    return valid.join(_groups(valid, cap, ["value"]).select("value"), "value", "left_semi")


def star_edges(incidence: DataFrame) -> DataFrame:
    """(src, dst) from the smallest holder of each value to its other holders: the components of all pairs, in linear size."""
    valid = valid_rows(incidence)
    lead = valid.groupBy("value").agg(F.min("id").alias("src"), F.max("id").alias("last")).filter("src != last")
    return valid.join(lead.select("value", "src"), "value").filter("src != id").select("src", F.col("id").alias("dst")).distinct()


def referral_edges(referrals: DataFrame, signup: DataFrame, claim: DataFrame) -> DataFrame:
    """Both ends known; 2.0 within 6 hours from signup to claim, 1.3 within 48, else or unknown 0.8."""
    known = signup.select(F.col("user_id").alias("referrer_user_id"))
    both = referrals.join(known, "referrer_user_id", "left_semi").join(signup.select(F.col("user_id").alias("referred_user_id"), "signup_ts"), "referred_user_id").join(claim.select(F.col("user_id").alias("referred_user_id"), "claim_ts"), "referred_user_id", "left")
    hours = (F.unix_micros("claim_ts") - F.unix_micros("signup_ts")) / 3.6e9
    weight = F.when(hours <= 6, 2.0).when(hours <= 48, 1.3).otherwise(0.8)
    ends = both.filter("referrer_user_id != referred_user_id").select(F.least("referrer_user_id", "referred_user_id").alias("src"), F.greatest("referrer_user_id", "referred_user_id").alias("dst"), weight.alias("weight"))
    return ends.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).withColumn("signals", F.array(F.lit("referral_link")))


def merge_edges(*edges: DataFrame) -> DataFrame:
    rows = reduce(DataFrame.unionByName, edges)
    return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("signals")))).alias("signals"))


def attribute_edges(parts: dict[str, DataFrame], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """merge_edges of the shared_attribute_edges of each signal's incidence(id, value), added up where their pairs are made."""
    rows = [_small(incidence, None).select(F.lit(i).alias("part"), "value", "id") for i, incidence in enumerate(parts.values())]
    pairs = holder_pairs(stored(reduce(DataFrame.unionByName, rows)), ["part", "value"], "id")
    n = [F.count_if(F.col("part") == i) for i in range(len(parts))]
    weight = reduce(lambda a, b: a + b, [c * F.lit(float(weights[signal])) for c, signal in zip(n, parts)])
    signals = F.sort_array(F.array_compact(F.array(*[F.when(c > 0, signal) for c, signal in zip(n, parts)])))
    return pairs.groupBy("cell", "src", "dst").agg(weight.alias("weight"), signals.alias("signals")).drop("cell")


def build_entity_graph(device: DataFrame, instrument: DataFrame, subnet: DataFrame, referral: DataFrame, cap: int | None = None) -> DataFrame:
    """merge_edges of the three attributes' edges and the referrals'; all are added up where their pairs are made."""
    parts = (("shared_device", device), ("shared_instrument", instrument), ("ip_subnet_overlap", subnet))
    shared = [_small(incidence, cap).select(F.col("value").cast("string").alias("value"), F.array(F.lit(signal)).alias("signals"), F.lit(WEIGHTS[signal]).alias("weight"), "id") for signal, incidence in parts]
    referred = referral.select(F.to_json(F.struct("src", "dst")).alias("value"), "signals", "weight", F.explode(F.array("src", "dst")).alias("id"))
    pairs = holder_pairs(stored(reduce(DataFrame.unionByName, [*shared, referred])), ["value", "signals", "weight"], "id")
    return pairs.groupBy("cell", "src", "dst").agg(F.sum("weight").alias("weight"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("signals")))).alias("signals")).drop("cell")


def hard_subgraph(edges: DataFrame, hard: list[str] = HARD) -> DataFrame:
    wanted = F.array(*map(F.lit, hard))
    return edges.filter(F.arrays_overlap("signals", wanted)).withColumn("signals", F.array_intersect("signals", wanted))


def prefix_edges(accounts: DataFrame, n: int = 9, cap: int | None = None) -> DataFrame:
    return shared_attribute_edges(accounts.filter(F.length("phone") >= n).select("id", F.substring("phone", 1, n).alias("value")), "phone_prefix", WEIGHTS["phone_prefix"], cap)


def address_edges(accounts: DataFrame, cap: int | None = None) -> DataFrame:
    return shared_attribute_edges(accounts.select("id", F.col("address").alias("value")), "shared_address", WEIGHTS["shared_address"], cap)


def _meeting() -> Callable[[pa.Table], pa.Table]:
    """(capture, src, met): for each source of a cell's lists the sources after it that share values, with these values in order. Sent as it is, so workers need not have the package."""

    def met_in(table: pa.Table) -> pa.Table:
        def ranked(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
            coded = column.combine_chunks().dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]

        captures, capture = ranked(table.column("capture"))
        values, value = ranked(table.column("value"))
        names, name = ranked(pc.list_flatten(table.column("holders")))
        ends = np.cumsum(pc.list_value_length(table.column("holders")).to_numpy())
        side = table.column("side").to_numpy()
        order = np.lexsort((side, value, capture))
        keys = (capture * len(values) + value)[order]
        pairs, shared = [], []
        for at in np.split(order, np.flatnonzero(np.diff(keys)) + 1):
            lists = [name[ends[r - 1] if r else 0 : ends[r]] for r in at]
            if side[at[0]] == 0:  # both ends in one block
                low, high = np.triu_indices(len(lists[0]), 1)
                a, b = lists[0][low], lists[0][high]
                found = np.minimum(a, b) * len(names) + np.maximum(a, b)
            elif len(lists) == 2:
                a, b = lists[0][:, None], lists[1][None, :]
                found = (np.minimum(a, b) * len(names) + np.maximum(a, b)).ravel()
            else:
                continue
            pairs.append(found + capture[at[0]] * len(names) ** 2)
            shared.append(np.full(len(found), value[at[0]]))
        pair, shared = (np.concatenate([np.empty(0, np.int64), *x]) for x in (pairs, shared))
        if len(captures) * len(names) ** 2 * len(values) < MOST_CODES:
            both = np.sort(pair * len(values) + shared)
            pair, shared = both // len(values), both % len(values)
        else:
            order = np.argsort(pair, kind="stable")
            pair, shared = pair[order], shared[order]
        starts = lambda x: np.flatnonzero(np.diff(x, prepend=-1))
        offsets = lambda x, n: pa.array(np.append(x, n), pa.int32())
        first = starts(pair)
        destinations = pa.ListArray.from_arrays(offsets(first, len(pair)), values.take(pa.array(shared)))
        source, dst = pair[first] // len(names), pair[first] % len(names)
        head = starts(source)
        met = pa.StructArray.from_arrays([names.take(pa.array(dst)), destinations], ["dst", "destinations"])
        of = source[head]
        out = pa.table({"capture": captures.take(pa.array(of // len(names))), "src": names.take(pa.array(of % len(names))), "met": pa.ListArray.from_arrays(offsets(head, len(first)), met)})
        step = max(1, len(head) * ROWS_PER_BATCH // max(1, len(first)))
        return pa.concat_tables([out.slice(i, step) for i in range(0, len(head), step)]) if len(head) else out

    return met_in


def co_destination_edges(flows: DataFrame, cap: int | None = None) -> DataFrame:
    """Per capture: sources that share dst:port; weight is the number of shared destinations."""
    once = flows.select("capture", "src", F.concat_ws(":", "dst", "port").alias("value")).distinct()
    small = once.join(_groups(once, cap, ["capture", "value"]).select("capture", "value"), ["capture", "value"], "left_semi")
    lists = holder_lists(stored(small.dropna(subset=["capture", "src"])), ["capture", "value"], "src", 4 * PAIRS_PER_CELL)
    kind = dict(lists.dtypes)
    source = kind["holders"].removeprefix("array<").removesuffix(">")
    met = lists.groupBy("cell").applyInArrow(_meeting(), f"capture {kind['capture']}, src {source}, met array<struct<dst:{source},destinations:array<string>>>")
    each = met.select("capture", "src", F.explode("met").alias("e"))
    return each.select("capture", "src", "e.dst", F.size("e.destinations").cast("long").alias("weight"), "e.destinations")


def combine_relations(edges: DataFrame, weights: dict[str, float], exclude: tuple[str, ...] = ()) -> DataFrame:
    """The weighted sum of relation edges (relation, src, dst, value); excluded ones are left out."""
    factor = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    kept = edges.filter(~F.col("relation").isin(*exclude)) if exclude else edges
    return kept.groupBy("src", "dst").agg(F.sum(F.col("value") * F.coalesce(F.try_element_at(factor, F.col("relation")), F.lit(1.0))).alias("weight"))


def bipartite_incidence(parts: dict[str, DataFrame]) -> DataFrame:
    """Distinct (row_id, col_id = kind:value) of incidences (id, value)."""
    rows = [df.filter(valid_value(F.col("value"))).select(F.col("id").alias("row_id"), F.concat(F.lit(f"{kind}:"), F.col("value").cast("string")).alias("col_id")) for kind, df in parts.items()]
    return reduce(DataFrame.unionByName, rows).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def drop_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges), "id", "left_semi")


def induced_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(cluster_key, src, dst, weight, signals) of edges inside a cluster."""
    a = membership.select("cluster_key", F.col("member").alias("src"))
    b = membership.select(F.col("cluster_key").alias("other"), F.col("member").alias("dst"))
    return edges.join(a, "src").join(b, "dst").filter("cluster_key = other").drop("other")


def linkage_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "field", "value").filter("value is not null")
    groups = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("field").agg(F.count(F.lit(1)).alias("n_values"), F.max("n").alias("largest"), F.max_by("value", F.struct("n", "value")).alias("largest_value"), F.count_if(F.col("n").between(2, 10)).alias("small_groups"))


def cap_report(incidence: DataFrame, caps: list[int]) -> DataFrame:
    """Groups and predicted clique edges kept and dropped for each cap."""
    sizes = incidence.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").groupBy("n").agg(F.count(F.lit(1)).alias("groups"))
    each = sizes.withColumn("cap", F.explode(F.array(*map(F.lit, caps)))).withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long") * F.col("groups"))
    kept = F.col("n") <= F.col("cap")
    part = lambda c, cond, name: F.sum(F.when(cond, F.col(c)).otherwise(0)).alias(name)
    return each.groupBy("cap").agg(part("groups", kept, "groups_kept"), part("groups", ~kept, "groups_dropped"), part("pairs", kept, "pairs_kept"), part("pairs", ~kept, "pairs_dropped"))


def edge_label(edges: DataFrame, priority: list[str] = PRIORITY, hard: list[str] = HARD) -> DataFrame:
    dominant = F.get(F.array_intersect(F.array(*map(F.lit, priority)), "signals"), 0)
    width = F.when(F.arrays_overlap("signals", F.array(*map(F.lit, hard))), "hard").otherwise("soft")
    return edges.select("src", "dst", dominant.alias("dominant"), width.alias("width"))
