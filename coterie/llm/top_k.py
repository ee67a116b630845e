"""Exact top-k search by inner product with cover trees over queries and data.

Equal vectors are one point: only the k + 1 rows of smallest vec_id that carry it
can be among anybody's k best, and equal queries are searched once. A cover tree
over a bounded sample of points (farthest-first centres; a level holds those that
stand farther apart than its radius, which halves from level to level) gives the
cells that all points and queries descend to. Cells are packed in the tree's
depth-first order into blocks of points and groups of queries; a cell too large
for one is dealt by hash. A group first searches the blocks that share a cell
with it. That leaves each of its cells a worst k-th score, and by

    <q, p> <= <cq, cp> + rq |cp| + rp |cq| + rq rp

(centres c, covering radii r) a pair of group and block is searched only if some
pair of their cells can still reach it. Inside a task both sides get cover trees
of their own, and the same bound drops pairs of their nodes. Scores are whole
numbers and bounds are rounded up, so the result is exact; k best of every pair
meet in a window that keeps k of each query before its shuffle.

Vectors that are null or hold a null or non-finite component take no part.
Vectors of different size are never compared. A row is no candidate of its own;
another row that repeats its vec_id is, and is a query of its own. A row without
vec_id is no query and, as a candidate, comes last among ties. Other columns are
ignored; an empty table gives no rows. Whole components beyond 2^31 / size are an
error. ``TOP`` points of the sample and ``CELLS`` cells are parameters that only
place the work.
"""

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from coterie.llm.centroids import matrix, whole_vectors
from coterie.llm.common import read, stored

K, EVERY, SCALE = 5, 50, 256
TOP, CELLS = 2048, 128
BLOCK, GROUP = 4096, 8192  # points of a block, queries of a group
LEAF = 64  # points of a node that is searched without further division, on average
FEW_PAIRS = 1_000_000
LAST = np.iinfo(np.int64).max


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products in whole numbers; through floats where those hold every partial sum exactly."""
    longest = lambda m: float((m.astype(float) ** 2).sum(1).max()) if m.size else 0.0
    if longest(a) * longest(b) < 2.0**100:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(float) ** 2).sum(1)) * (1 + 1e-12)


def farthest_first(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(centre, apart): rows in farthest-first order and how far each stood from those before; equal rows stand in for each other."""
    f = x.astype(float)
    centres, apart = [0], [np.inf]
    near = ((f - f[0]) ** 2).sum(1)
    while len(centres) < min(most, len(x)):
        c = int(near.argmax())
        if near[c] <= 0:
            break
        centres.append(c)
        apart.append(float(np.sqrt(near[c])))
        near = np.minimum(near, ((f - f[c]) ** 2).sum(1))
    return np.array(centres), np.array(apart)


def nearest_of(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and a distance not below the true one."""
    f, c = x.astype(float), centres.astype(float)
    found = (np.add.outer(np.zeros(len(f)), (c * c).sum(1)) - 2 * f @ c.T).argmin(1)
    return found, np.sqrt(((f - c[found]) ** 2).sum(1)) * (1 + 1e-12)


class CoverTree:
    """Nested levels of centres, coarsest first, over points ``x``.

    A level is (centres, radius that covers the node's points, each point's node); ``parents[i]`` gives the node of
    level i of every node of level i + 1. Radii are those of the points a node holds, so they bound whatever lies below.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF, most: int | None = None):
        order, apart = farthest_first(x, most or max(1, -(-len(x) // leaf)))
        sizes, reach = [1], apart[1] if len(order) > 1 else 0.0
        while sizes[-1] < len(order):
            reach /= 2
            n = int((apart > reach).sum())
            if n > sizes[-1]:
                sizes.append(n)
        self.levels, self.parents = [], []
        place, _ = nearest_of(x, x[order])
        for k in range(len(sizes) - 1, -1, -1):
            centres = x[order[: sizes[k]]]
            if k < len(sizes) - 1:
                up, _ = nearest_of(x[order[: sizes[k + 1]]], centres)
                self.parents.insert(0, up)
                place = up[place]
            away = np.sqrt(((x - centres[place]).astype(float) ** 2).sum(1)) * (1 + 1e-12)
            radius = np.zeros(sizes[k])
            np.maximum.at(radius, place, away)
            self.levels.insert(0, (centres, radius, place))


def reachable(a: tuple, b: tuple, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The largest whole inner product that points of each pair of nodes can have."""
    (ca, ra, *_), (cb, rb, *_), (i, j) = a, b, pairs
    score = products(ca, cb)[i, j]
    slack = ra[i] * _norms(cb)[j] + rb[j] * _norms(ca)[i] + ra[i] * rb[j]
    return score + np.floor(slack * (1 + 1e-9) + 1e-6).astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest scores, ties to the smaller id."""
    if scores.shape[1] > k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        row, column = np.nonzero(scores >= least[:, None])
    else:
        row, column = np.nonzero(np.ones_like(scores, bool))
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return row[place < k], column[place < k]


def search_block(q: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, point, score) of each query's k best points with a score of ``floor`` or more, and how many scores were computed."""
    tq, tp = CoverTree(q, leaf), CoverTree(p, leaf)
    deep = max(len(tq.levels), len(tp.levels))
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(deep):
        a, b = (t.levels[min(level, len(t.levels) - 1)] for t in (tq, tp))
        if level:
            i, j = _finer(tq, level, i, j)
            j, i = _finer(tp, level, j, i)
        worst = np.full(len(a[1]), LAST)
        np.minimum.at(worst, a[2], floor)
        most = reachable(a, b, (i, j))
        stays = most >= worst[i]
        i, j, most = i[stays], j[stays], most[stays]
    leaves, points = tq.levels[-1][2], tp.levels[-1][2]
    by_node = np.argsort(points, kind="stable")
    cuts = np.searchsorted(points[by_node], np.arange(len(tp.levels[-1][1]) + 1))
    of_node = lambda nodes: np.concatenate([by_node[cuts[n] : cuts[n + 1]] for n in nodes]) if len(nodes) else np.zeros(0, np.int64)
    out, computed = [], 0
    for node in np.unique(i):
        rows, mine = np.flatnonzero(leaves == node), i == node
        order = np.argsort(-most[mine], kind="stable")
        nodes, bound = j[mine][order], most[mine][order]
        size = np.cumsum(cuts[nodes + 1] - cuts[nodes])
        first = int(np.searchsorted(size, 4 * k)) + 1  # enough points to know k scores
        have = of_node(nodes[:first])
        scores = products(q[rows], p[have])
        worst = floor[rows]
        if len(have) >= k:
            worst = np.maximum(worst, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
        more = of_node(nodes[first:][bound[first:] >= worst.min()])
        if len(more):
            scores, have = np.hstack([scores, products(q[rows], p[more])]), np.concatenate([have, more])
        computed += scores.size
        r, c = best_of(scores, ids[have], k)
        good = scores[r, c] >= floor[rows[r]]
        out.append((rows[r[good]], have[c[good]], scores[r, c][good]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    return *(np.concatenate(x) for x in zip(*out, strict=True)), computed


def _finer(tree: CoverTree, level: int, mine: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with ``mine`` replaced by its children, if the tree has a level so fine."""
    if level >= len(tree.levels):
        return mine, other
    parent = tree.parents[level - 1]
    order = np.argsort(parent, kind="stable")
    cuts = np.searchsorted(parent[order], np.arange(len(tree.levels[level - 1][1]) + 1))
    n = cuts[mine + 1] - cuts[mine]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return order[np.repeat(cuts[mine], n) + inside], np.repeat(other, n)


def _placed(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = matrix(batch.column("v"))
        cell, away = nearest_of(x, centres) if len(x) else (np.zeros(0), np.zeros(0))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away, pa.float64())], [*batch.schema.names, "cell", "away"])


def _searched(queries: pa.Table, points: pa.Table, k: int) -> pa.Table:
    names = ["qid", "cell", "score", "least_id", "ids"]
    q, p = matrix(queries.column("v")), matrix(points.column("v"))
    ids = points.column("least_id").to_numpy()
    r, c, score = search_block(q, p, ids, k, queries.column("floor").to_numpy())[:3] if len(q) and len(p) else (np.zeros(0, np.int64),) * 3
    return pa.Table.from_arrays([queries.column("qid").take(r), queries.column("cell").take(r), pa.array(score, pa.int64()), points.column("least_id").take(c), points.column("ids").take(c)], names)


def _packed(spark: SparkSession, counts: dict[int, int], order: list[int], most: int, name: str) -> DataFrame:
    """(cell, first, parts): cells in ``order`` packed to about ``most`` rows; a larger one gets parts of its own."""
    rows, at, held = [], 0, 0
    for cell in order:
        n = counts.get(cell, 0)
        parts = -(-n // most)
        if held and (held + n > most or parts > 1):
            at, held = at + 1, 0
        rows.append((cell, at, max(parts, 1)))
        at, held = (at + parts, 0) if parts > 1 else (at, held + n)
    return spark.createDataFrame(rows, f"cell int, {name}_first int, {name}_parts int")


def _dealt(rows: DataFrame, order: list[int], most: int, name: str) -> DataFrame:
    counts = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    packed = _packed(rows.sparkSession, counts, order, most, name)
    part = F.pmod(F.xxhash64("v", F.lit(name)), F.col(f"{name}_parts")).cast("int")
    return rows.join(F.broadcast(packed), "cell").withColumn(name, F.col(f"{name}_first") + part).drop(f"{name}_first", f"{name}_parts")


def _joined(rows: DataFrame, pairs: DataFrame, few: bool, on: str) -> DataFrame:
    return rows.join(F.broadcast(pairs) if few else pairs.hint("merge"), on)


def _search(queries: DataFrame, points: DataFrame, pairs: DataFrame, k: int, kind: str) -> DataFrame:
    """(qid, cell, score, least_id, ids): k best of every pair (group, block)."""
    few = pairs.count() <= FEW_PAIRS
    left = _joined(queries.select("group", "qid", "cell", "v", "floor"), pairs, few, "group").groupBy("group", "block")
    right = _joined(points.select("block", "v", "least_id", "ids"), pairs, few, "block").groupBy("group", "block")
    return left.cogroup(right).applyInArrow(partial(_searched, k=k), f"qid long, cell int, score long, least_id long, ids {kind}")


def _ranked(df: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)


def _of_size(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(v, found): each distinct query vector with the k best rows, (score, vec_id, row), all vectors of one size."""
    spark, kind = points.sparkSession, points.schema["ids"].dataType.simpleString()
    sample = np.array([r.v for r in points.orderBy(F.xxhash64("v"), "v").select("v").limit(TOP).collect()], np.int64)
    top = CoverTree(sample.reshape(len(sample), -1), most=min(CELLS, -(-len(sample) // 8)))
    centres, finest = top.levels[-1][0], top.levels
    paths = np.zeros((len(finest), len(centres)), np.int64)
    up = np.arange(len(centres))
    for level in range(len(finest) - 1, -1, -1):
        paths[level] = up
        up = top.parents[level - 1][up] if level else up
    order = np.lexsort(paths[::-1]).tolist()
    place = lambda df: df.mapInArrow(partial(_placed, centres=centres), StructType([*df.schema.fields, StructField("cell", IntegerType()), StructField("away", DoubleType())]))
    points, queries = stored(place(points)), stored(place(queries))
    points, queries = stored(_dealt(points, order, BLOCK, "block")), stored(_dealt(queries, order, GROUP, "group"))
    open_ = F.lit(int(np.iinfo(np.int64).min))
    cover = lambda df, name: df.groupBy(name, "cell").agg(F.max("away").alias("radius"))
    groups, blocks = stored(cover(queries, "group")), stored(cover(points, "block"))
    home = stored(groups.select("group", "cell").join(blocks.select("block", "cell").hint("merge"), "cell").select("group", "block").distinct())
    found = stored(_search(queries.withColumn("floor", open_), points, home, k, kind))
    scored = _ranked(found, k, ["qid"], [F.desc("score"), "least_id"])
    floors = stored(scored.groupBy("qid").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(open_).alias("floor")))
    queries = stored(queries.join(floors.hint("merge"), "qid", "left").withColumn("floor", F.coalesce("floor", open_)))
    norms = _norms(centres)
    ip = products(centres, centres)
    near = spark.createDataFrame([(a, b, int(ip[a, b]), float(norms[a]), float(norms[b])) for a in range(len(centres)) for b in range(len(centres))], "qcell int, cell int, ip long, qnorm double, norm double")
    left = queries.groupBy("group", F.col("cell").alias("qcell")).agg(F.max("away").alias("qradius"), F.min("floor").alias("floor"))
    both = left.join(F.broadcast(near), "qcell").join(blocks.hint("merge"), "cell")
    slack = F.col("qradius") * F.col("norm") + F.col("radius") * F.col("qnorm") + F.col("qradius") * F.col("radius")
    rest = both.filter(F.col("ip") + slack * (1 + 1e-9) + 1 >= F.col("floor")).select("group", "block").distinct()
    rest = stored(rest.join(home.hint("merge"), ["group", "block"], "left_anti"))
    if not rest.isEmpty():
        found = found.unionByName(_search(queries, points, rest, k, kind))
    best = _ranked(found, k, ["qid"], [F.desc("score"), "least_id"]).select("qid", "score", F.explode("ids").alias("id"))
    best = _ranked(best.select("qid", "score", "id.vec_id", "id.row"), k, ["qid"], [F.desc("score"), F.asc_nulls_last("vec_id"), "row"])
    lists = best.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score", "vec_id", "row"))), lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id"), x["row"].alias("row"))).alias("found"))
    return queries.select("qid", "v").join(lists.hint("merge"), "qid").select("v", "found")


def top_k(rows: DataFrame, wanted: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of rows (vec_id long, v) that ``wanted`` picks, its k best among all others."""
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))  # written, so that a row keeps its number
    first = Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"), "row")
    few = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    ids = F.sort_array(F.collect_list(F.struct("place", "vec_id", "row")))
    points = stored(few.groupBy("v").agg(F.transform(ids, lambda x: F.struct(x["vec_id"].alias("vec_id"), x["row"].alias("row"))).alias("ids")).withColumn("least_id", F.coalesce(F.get("ids", F.lit(0))["vec_id"], F.lit(int(LAST)))))
    asked = stored(rows.filter(wanted).select("vec_id", "row", "v"))
    queries = stored(asked.select("v").distinct().withColumn("qid", F.monotonically_increasing_id()))
    sizes = [r.n for r in points.select(F.size("v").alias("n")).distinct().collect()]
    of = lambda df, n: df.filter(F.size("v") == n)
    parts = [_of_size(of(points, n), of(queries, n), k + 1) for n in sorted(sizes)]
    schema = "query_id long, rank int, vec_id long, score long"
    if not parts:
        return rows.sparkSession.createDataFrame([], schema)
    found = stored(reduce(DataFrame.unionByName, parts))
    others = F.slice(F.filter("found", lambda x: x["row"] != F.col("row")), 1, k)
    each = asked.join(found.hint("merge"), "v").select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_vectors(read(spark, sf_dir, "embeddings"), SCALE)
    return top_k(rows, F.col("vec_id") % EVERY == 0)


ORACLE = f"""
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, [floor(CAST(x AS DOUBLE) * {SCALE}) for x in embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.r, q.vec_id AS query_id, p.vec_id, CAST(list_inner_product(q.v, p.v) AS BIGINT) AS score FROM kept q JOIN kept p ON q.r <> p.r AND len(q.v) = len(p.v) WHERE q.vec_id % {EVERY} = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM placed WHERE rank <= {K}
"""
