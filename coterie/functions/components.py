"""Connected components by contraction: joins over written tables that shrink from round to round."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.functions.storage import stored

LINKS_PER_TASK = 500_000


def _gathered(table: DataFrame) -> DataFrame:
    """A written table, read by one task if that many links are left, so that a round on few links is one task without shuffles."""
    return table.coalesce(1) if table.count() <= LINKS_PER_TASK else table


def roots(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b) between different nodes; nodes of one component have one root.

    Each round orders the nodes by a hash of its own, maps every node to the
    first of its neighbours and itself, and contracts the links by that map,
    which leaves about half of the nodes of a chain and two of a star. A round
    writes one table, of links with their ends' images; the next one's links and
    the maps that are joined at the end are read from it. The links shrink to
    nothing, so the rounds end by themselves, and all tables together are of the
    size of the first few. Only the number of tasks depends on how many are left.
    """
    edges = _gathered(stored(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    maps: list[DataFrame] = []
    while True:
        rank = lambda c: F.xxhash64(F.lit(len(maps)), F.col(c))  # noqa: E731, B023
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(rank("b")).alias("h"), F.min_by("b", rank("b")).alias("near"))
        image = first.select(F.col("a").alias("node"), F.when(F.col("h") < rank("a"), F.col("near")).otherwise(F.col("a")).alias("to"))
        of = lambda c, to: image.select(F.col("node").alias(c), F.col("to").alias(to))  # noqa: E731, B023
        moved = _gathered(stored(edges.join(of("a", "ta"), "a").join(of("b", "tb"), "b")))
        maps.append(moved.select(F.col("a").alias("node"), F.col("ta").alias("to")).unionByName(moved.select(F.col("b").alias("node"), F.col("tb").alias("to"))).distinct())
        left = moved.filter("ta != tb")
        if left.isEmpty():
            break
        edges = left.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
    out = maps[-1].withColumnRenamed("to", "root")
    for image in reversed(maps[:-1]):
        out = image.join(out.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return out


def _uniting() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, label) of the links of one task: nodes take the smallest label beside them until none changes. Sent as it is, so workers need not have the package."""

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        kind = table.schema.field("a").type
        ends = np.array([*table.column("a").to_pylist(), *table.column("b").to_pylist()]) if not pa.types.is_integer(kind) else np.concatenate([table.column(c).to_numpy() for c in ("a", "b")])
        nodes, place = np.unique(ends, return_inverse=True)
        a, b = place[: table.num_rows], place[table.num_rows :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for end in (label[a], label[b], a, b):
                np.minimum.at(new, end, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        yield pa.RecordBatch.from_arrays([pa.array(nodes.tolist(), kind), pa.array(nodes[label].tolist(), kind)], ["node", "label"])

    return united


def components(links: DataFrame) -> DataFrame:
    """(node, label): of every node in links (a, b) the smallest node of its component.

    Up to ``LINKS_PER_TASK`` links, counted first, one task labels them at once; more are contracted in rounds.
    """
    kind = links.schema["a"].dataType.simpleString()
    ends = stored(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if ends.count() <= LINKS_PER_TASK:
        return ends.coalesce(1).mapInArrow(_uniting(), f"node {kind}, label {kind}")
    found = stored(roots(ends))
    label = found.groupBy("root").agg(F.min("node").alias("label"))
    return found.join(label, "root").select("node", "label")
