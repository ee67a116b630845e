"""Centroid clustering with equal-average equal-variance search.

Vectors of whole numbers are assigned to their nearest centroid, and centroids
become the floor of their vectors' mean, for a given number of rounds. The
centroids are few (``k`` is a parameter) and travel to every task, sorted by the
sum of their components. A vector starts at its own sum and looks outward on
both sides: for m components of sum S and deviation V (the norm of what is left
without the mean), m d^2 >= (S_x - S_c)^2 ends a side, and
m d^2 >= (S_x - S_c)^2 + m (V_x - V_c)^2 rejects one centroid, in each case only
if the bound is above the best distance so far. What survives is compared in
whole numbers, ties to the smaller number. The rounds' sums are added up in the
tasks first, so a round shuffles one row per task and centroid.

Vectors that are null, of another size, or that hold a null or non-finite
component take no part. Repeated rows count as often as they stand there; a row
without vec_id takes part but seeds last. With fewer vectors than ``k`` there
are fewer centroids; an empty table gives no rows. Other columns are ignored.
Whole components of which ``SIZE`` might sum up beyond 2^31 (2^25 each) are an
error, as distances would not stay exact.
"""

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.llm.common import read, stored

SIZE, K, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
LARGEST = 1 << 31  # of a vector's largest component times its size


def whole_vectors(rows: DataFrame, scale: int, size: int | None = None) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x of ``embedding``; rows that take no part are left out."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    kept = rows.filter(finite if size is None else (F.size("embedding") == size) & finite)
    return kept.select("vec_id", whole.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long vectors as one array of whole numbers, a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)
    if out.size and max(int(out.max()), -int(out.min())) * out.shape[1] > LARGEST:
        raise ValueError(f"a whole component is beyond {LARGEST // out.shape[1]}")
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of each row's nearest centroid, and how many distances were computed."""
    rows, m = x.shape
    total = centroids.sum(1)
    order = np.lexsort((np.arange(len(centroids)), total))
    total, sorted_ = total[order], centroids[order]
    deviation = lambda a: np.sqrt((m * (a * a).sum(1) - a.sum(1) ** 2) / m)
    xs, xv, cv = x.sum(1), deviation(x), deviation(sorted_)
    best, found, compared = np.full(rows, np.iinfo(np.int64).max), np.full(rows, len(centroids)), 0
    right = np.searchsorted(total, xs)
    left = right - 1
    sides = [(left.copy(), -1, np.ones(rows, bool)), (right.copy(), 1, np.ones(rows, bool))]
    for _ in range(len(centroids)):
        moved = False
        for at, step, open_ in sides:
            open_ &= (at >= 0) & (at < len(total))
            here = np.flatnonzero(open_)
            apart = (xs[here] - total[at[here]]).astype(float) ** 2
            far = apart * (1 - 1e-9) > best[here].astype(float) * m
            open_[here[far]] = False
            here, apart = here[~far], apart[~far]
            if not len(here):
                continue
            moved = True
            c = at[here]
            gap = np.maximum(np.abs(xv[here] - cv[c]) - 1e-9 * (xv[here] + cv[c]), 0)  # less what rounding may add
            near = (apart + m * gap**2) * (1 - 1e-9) <= best[here].astype(float) * m
            r, c = here[near], c[near]
            d = ((x[r] - sorted_[c]) ** 2).sum(1)
            compared += len(r)
            better = (d < best[r]) | ((d == best[r]) & (order[c] < found[r]))
            best[r[better]], found[r[better]] = d[better], order[c[better]]
            at[here] += step
        if not moved:
            break
    return found, best, compared


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    count, total = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
    for batch in batches:
        x = matrix(batch.column("v"))
        if len(x):
            found, _, _ = nearest(x, centroids)
            order = np.argsort(found, kind="stable")
            cuts = np.searchsorted(found[order], np.arange(len(count) + 1))
            for c in np.flatnonzero(np.diff(cuts)):
                total[c] += x[order[cuts[c] : cuts[c + 1]]].sum(0)
            count += np.diff(cuts)
    each = np.column_stack([total, count])  # the count follows the components' sums
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count)), pa.int32()), pa.array(each.tolist(), pa.list_(pa.int64()))], ["cluster", "total"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = matrix(batch.column("v"))
        found, best, _ = nearest(x, centroids) if len(x) else (np.zeros(0), np.zeros(0), 0)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(found, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])


def seed_order(vec_id: Column, seed: int = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")), 256)


def centroid_clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every row of vectors (vec_id, v), and the final centroids.

    ``vectors`` is read once a round: it must give the same rows each time, as a stored table does.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    first = vectors.orderBy(F.asc_nulls_last(seed_order(F.col("vec_id"), seed)), "v").select("v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), -1) if first else np.zeros((0, 0), np.int64)
    if not first:
        return vectors.mapInArrow(partial(_assigned, centroids=centroids), f"vec_id {kind}, cluster int, distance long"), centroids
    for _ in range(rounds):
        per_task = vectors.select("v").mapInArrow(partial(_sums, centroids=centroids), "cluster int, total array<long>")
        sums = per_task.select("cluster", F.posexplode("total").alias("place", "x")).groupBy("cluster", "place").agg(F.sum("x").alias("x"))
        table = np.zeros((centroids.shape[0], centroids.shape[1] + 1), np.int64)
        for r in sums.collect():  # k rows a component
            table[r.cluster, r.place] = r.x
        n = table[:, -1:]
        centroids = np.where(n > 0, table[:, :-1] // np.maximum(n, 1), centroids)
    return vectors.mapInArrow(partial(_assigned, centroids=centroids), f"vec_id {kind}, cluster int, distance long"), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(whole_vectors(read(spark, sf_dir, "embeddings"), SCALE, SIZE))
    assigned, centroids = centroid_clusters(vectors)
    assigned = stored(assigned)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows
    shown = [(c, int(t), sum(per.values()), digest[c]) for c, t in per.items()]
    known = spark.createDataFrame(shown, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    away = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v, c)])"
    near = lambda t: f"(SELECT vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT x.rowid AS r, vec_id, v, cluster, {away} AS d FROM kept x, {t}) GROUP BY r, vec_id, v)"
    ctes = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rowid, vec_id, [CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT) for x in embedding] AS v FROM embeddings WHERE len(embedding) = {SIZE} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {SIZE})",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS INT) AS cluster, v AS c FROM kept QUALIFY cluster < {K})",
    ]
    for r in range(ROUNDS):
        ctes.append(f"a{r} AS MATERIALIZED {near(f'c{r}')}")
        ctes.append(f"m{r} AS (SELECT cluster, list(m ORDER BY i) AS m FROM (SELECT cluster, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster)")
        ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, CAST(coalesce(m, c) AS BIGINT[]) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))")
    ctes.append(f"last AS MATERIALIZED {near(f'c{ROUNDS}')}")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM last JOIN c{ROUNDS} USING (cluster)"


ORACLE = _oracle()
