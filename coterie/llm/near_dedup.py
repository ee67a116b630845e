"""Near-duplicate detection by BagMinHash signatures, banding and exact verification.

A document is the multiset of its five-word shingles. BagMinHash (Ertl, 2018)
draws for every shingle of weight w a Poisson process of rate w: the weights are
discretised to whole levels of rate one, and the levels are grouped in a
hierarchy of doubling ranges, each one process. Each point falls on one of the
signature's components, which keeps the earliest. Two documents agree
in a component with the probability of their weighted Jaccard similarity.
Points are drawn in ascending order and a shingle stops once its next point lies
beyond the document's latest component, so most shingles draw one or two.

Documents of one multiset are one node from the start. Nodes are candidates for
each other where a band of their signatures agrees; buckets of one band key that
share nodes form a group. Every candidate pair of a group is verified on the
full multisets (64-bit hashes of the shingles) unless links found before already
join its ends, so the classes are exactly the components of all candidate pairs
of similarity 0.8 or more, and only links leave a task: less than one a node.

A group of up to ``BLOCK`` nodes is searched in one task. A larger one is dealt
into blocks, each searched together with the group's leads (the nodes whose
buckets hold most, where an original stands among its edited copies); of what
that leaves in different classes, only nodes that still share a bucket with
another class meet again, block against block, and blocks of one class never.
What no step reaches is a pair that disagrees in all bands: one of similarity
0.8 in 20 000, one of 0.85 in two million.

Null, empty and blank texts have no words and are classes of their own. Texts of
fewer than five words are one shingle. Words are maximal runs of non-blank
characters with A-Z in lower case. Rows that repeat a doc_id are members of the
class of their text; a row without doc_id never names a class that has one.
Extra columns are ignored by ``near_groups`` and returned by ``drop_near_copies``.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coterie.functions.components import roots
from coterie.llm.common import bytes_of, fold, hash_words, mix, pieces, read, stored, text_key, without, word_bounds

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
BLOCK, BLOCK_BYTES = 256, 4 << 20  # nodes of a block, and bytes of their shingles' hashes
LEADS = 8


def shingles(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of each row's distinct shingles, sorted by row and hash."""
    raw = fold(raw)
    begin, end, row = word_bounds(raw, starts)
    words = hash_words(raw, begin, end)
    if not len(words):
        return np.zeros(0, np.int64), words, np.zeros(0, np.int64)
    n = np.bincount(row, minlength=len(starts) - 1)
    first = np.r_[0, np.cumsum(n)[:-1]]
    place = np.arange(len(words)) - first[row]
    step = np.uint64(0x9FB21C651E98DF25)
    h = np.zeros(len(words), np.uint64)
    for k in range(SHINGLE):
        inside = place + k < n[row]
        at = np.minimum(np.arange(len(words)) + k, len(words) - 1)
        h = h * step + np.where(inside, words[at], np.uint64(0))
    starts_one = (place + SHINGLE <= n[row]) | ((place == 0) & (n[row] < SHINGLE))
    h, r = mix(h[starts_one]), row[starts_one]
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]
    at = np.flatnonzero(new)
    return r[at], h[at], np.diff(np.r_[at, len(h)])


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from 64 random bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int, size: int) -> np.ndarray:
    """BagMinHash: for each row ``size`` components, each a 64-bit name of its earliest point.

    The levels of a shingle's weight form ranges [0, 1), [1, 2), [2, 4), [4, 8), ...
    A range of length R is one process of rate R, seeded by shingle and range, so
    that all documents draw the same points; each point lies on a uniform level of
    its range, and a document takes it if that level is below its weight. A heavy
    shingle thus costs the logarithm of its weight.
    """
    best, name, worst = np.full(rows * size, np.inf), np.zeros(rows * size, np.uint64), np.full(rows, np.inf)
    ranges = [(0, 1.0, np.arange(len(h)))]
    while len(at := np.flatnonzero(weight > (low := 1 << (len(ranges) - 1)))):
        ranges.append((low, float(low), at))
    item = np.concatenate([at for *_, at in ranges])
    low = np.concatenate([np.full(len(at), x) for x, _, at in ranges])
    rate = np.concatenate([np.full(len(at), x) for _, x, at in ranges])
    state = np.concatenate([mix(h[at] + mix(np.array([k], np.uint64))) for k, (*_, at) in enumerate(ranges)])
    r, top, t = row[item], weight[item], np.zeros(len(item))
    while len(state):
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
        t = t - np.log(_unit(state)) / rate
        live = t < worst[r]
        state, r, t, low, rate, top = (x[live] for x in (state, r, t, low, rate, top))
        bits = mix(state ^ np.uint64(0x2545F4914F6CDD1D))
        slot = r * size + ((bits >> np.uint64(40)) % np.uint64(size)).astype(np.int64)
        level = low + ((bits & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate).astype(np.int64)
        taken = np.flatnonzero((level < top) & (t < best[slot]))
        # Written from the latest to the earliest, so that of points on one component the earliest stays.
        taken = taken[np.argsort(-t[taken], kind="stable")]
        best[slot[taken]] = t[taken]
        name[slot[taken]] = state[taken]
        worst = best.reshape(rows, size).max(axis=1)
    return name.reshape(rows, size)


SKETCH = "doc_id bigint, text_key bigint, size bigint, bag binary, bands array<bigint>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = BANDS * ROWS
    for batch in batches:
        for piece in pieces(batch):
            raw, starts = bytes_of(piece.column("text"))
            row, h, count = shingles(raw, starts)
            if len(row):
                used, local = np.unique(row, return_inverse=True)
                sig = signatures(local, h, count, len(used), size)
                total = np.bincount(local, weights=count).astype(np.int64)
                each = mix(h) * count.astype(np.uint64)
                edges = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                one = np.add.reduceat(each, edges)
                two = np.add.reduceat(mix(each ^ np.uint64(0x5851F42D4C957F2D)), edges)
                bags = np.stack([one, two], axis=1)
                key = np.zeros((len(used), BANDS), np.uint64)
                for k in range(ROWS):
                    key = mix(key + sig[:, k::ROWS][:, :BANDS])
                key = mix(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            else:
                used = np.zeros(0, np.int64)
                total, bags, key = used, np.zeros((0, 2), np.uint64), np.zeros((0, BANDS), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id").take(pa.array(used)),
                    piece.column("text_key").take(pa.array(used)),
                    pa.array(total, pa.int64()),
                    pa.array([b.tobytes() for b in bags], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, len(used) * BANDS + 1, BANDS, dtype=np.int32), pa.array(key.ravel(), pa.int64())),
                ],
                names=["doc_id", "text_key", "size", "bag", "bands"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, size, bag, bands) of every row that has words; bag names the multiset, bands are the band keys."""
    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(_sketch, SKETCH)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, tokens): a 64-bit hash for each occurrence of each shingle, so that overlaps of multisets are those of sets."""
    for batch in batches:
        for piece in pieces(batch):
            row, h, count = shingles(*bytes_of(piece.column("text")))
            again = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            h, row = np.repeat(h, count), np.repeat(row, count)
            h = np.where(again > 0, mix(h + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), h)
            cuts = np.searchsorted(row, np.arange(piece.num_rows + 1))
            tokens = [h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array(tokens, pa.binary())], names=["node", "tokens"])


LINKS = "a bigint, b bigint"


def _linked(table: pa.Table) -> pa.Table:
    """Links that join all classes of a unit which candidate pairs of SIMILARITY or more connect.

    Columns: node, label (its class so far), rank, side, bands, tokens. Pairs of one side are only compared on side 0.
    Nodes are taken in the order of their rank, each against all that follow, share a band with it and are of other
    classes at that time.
    """
    node, rank = table.column("node").to_numpy(), table.column("rank").to_numpy()
    order = np.lexsort((node, -rank))
    order = order[np.sort(np.unique(node[order], return_index=True)[1])]
    node, side = node[order], table.column("side").to_numpy()[order]
    lab = np.unique(table.column("label").to_numpy()[order], return_inverse=True)[1]
    bands = np.asarray(table.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)[order]
    raw, starts = bytes_of(table.column("tokens"))
    size, begin = np.diff(starts)[order] // 8, starts[:-1][order] // 8
    tokens = np.unique(np.frombuffer(raw.tobytes(), np.uint64), return_inverse=True)[1]
    seen = np.zeros(len(raw) // 8 + 1, bool)
    left, right = [], []
    for v in range(len(node) - 1):
        after = slice(v + 1, None)
        small, large = np.minimum(size[after], size[v]), np.maximum(size[after], size[v])
        near = v + 1 + np.flatnonzero((lab[after] != lab[v]) & (small >= SIMILARITY * large - 1e-9) & ((side[after] != side[v]) | (side[v] == 0)))
        near = near[(bands[near] == bands[v]).any(axis=1)] if len(near) else near
        if not len(near):
            continue
        seen[tokens[begin[v] : begin[v] + size[v]]] = True
        n = size[near]
        at = np.repeat(begin[near] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.add.reduceat(seen[tokens[at]].astype(np.int64), np.cumsum(n) - n)
        seen[tokens[begin[v] : begin[v] + size[v]]] = False
        like = near[both >= SIMILARITY * (size[v] + n - both) - 1e-9]
        if len(like):
            met, one = np.unique(lab[like], return_index=True)
            left.append(np.full(len(met), node[v]))
            right.append(node[like[one]])
            lab[np.isin(lab, met)] = lab[v]
    return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (left, right)], names=["a", "b"])


def _unit_links(units: DataFrame) -> DataFrame:
    """The links of each unit of (unit, node, label, rank, side, bands, tokens)."""
    columns = ["node", "label", "rank", "side", "bands", "tokens"]
    return units.select("unit", *columns).groupBy("unit").applyInArrow(lambda t: _linked(t), LINKS)


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """(node, group, rank) of the nodes that share a bucket with another; rank: the sizes of a node's buckets, summed."""
    members = nodes.select("node", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "node")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).filter("n > 1")
    multi = stored(members.join(sizes.hint("shuffle_hash"), "bucket").select("node", "lead", "n"))
    group = roots(multi.filter("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))).withColumnRenamed("root", "group")
    return group.join(multi.groupBy("node").agg(F.sum("n").alias("rank")), "node")


def with_tokens(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Adds tokens to nodes with (node, doc_id, text_key): the hashes of the text's shingles."""
    where = found.select("node", F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text"))
    here = docs.select("doc_id", text_key().alias("text_key"), "text")
    texts = here.join(where.hint("shuffle_hash"), here["doc_id"].eqNullSafe(where["_doc"]) & (here["text_key"] == where["_text"]))
    bags = texts.select("node", "text").mapInArrow(_bags, "node bigint, tokens binary").dropDuplicates(["node"])
    return found.drop("doc_id", "text_key").join(bags.hint("shuffle_hash"), "node")


def _dealt(nodes: DataFrame, blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int")


def _blocks(rows: str = "rows", size: str = "bytes") -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES)).cast("int")


def _count() -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.sum(F.col("size") * 8).alias("bytes")]


def first_links(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links inside the blocks of each group, each block with its group's leads; and (group, blocks) of groups of several."""
    groups = stored(found.groupBy("group").agg(*_count()).select("group", _blocks().alias("blocks")))
    several = groups.filter("blocks > 1")
    placed = found.join(groups, "group").withColumn("unit", F.xxhash64("group", _dealt(found, F.col("blocks"))))
    best = Window.partitionBy("group").orderBy(F.desc("rank"), "node")
    leads = found.join(several, "group").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= LEADS)
    leads = leads.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter(F.col("block") != _dealt(found, F.col("blocks")))
    units = placed.drop("blocks").unionByName(leads.withColumn("unit", F.xxhash64("group", "block")).drop("blocks", "place", "block"))
    return stored(_unit_links(units.withColumn("label", F.col("node")).withColumn("side", F.lit(0)))), several


def more_links(found: DataFrame, several: DataFrame, class_of: DataFrame) -> DataFrame:
    """Links between different classes (node, label) of the groups of several blocks: the rest of their candidate pairs, block against block.

    Only nodes in buckets that hold several classes take part. A class that fills a block has blocks of its own, which
    do not meet each other; the other classes of a group share pooled blocks, which also meet themselves.
    """
    large = stored(found.join(several.select("group"), "group", "left_semi").join(class_of, "node", "left").withColumn("label", F.coalesce("label", "node")))
    buckets = large.select("node", "label", F.posexplode("bands").alias("band", "key")).select("node", "label", F.xxhash64("band", "key").alias("bucket"))
    mixed = buckets.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("bucket")
    open_ = stored(buckets.join(mixed.hint("merge"), "bucket", "left_semi").select("node").distinct())
    rest = stored(large.join(open_.hint("shuffle_hash"), "node", "left_semi"))
    own = rest.groupBy("group", "label").agg(*_count()).withColumn("own", (F.col("rows") >= BLOCK) | (F.col("bytes") >= BLOCK_BYTES))
    pool = stored(own.withColumn("pool", F.when(F.col("own"), F.col("label"))))
    sets = stored(pool.groupBy("group", "pool").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).select("group", "pool", _blocks().alias("n")))
    named = rest.join(pool.select("group", "label", "pool"), ["group", "label"]).join(sets.withColumnRenamed("pool", "_pool").withColumnRenamed("group", "_group"), (F.col("group") == F.col("_group")) & F.col("pool").eqNullSafe(F.col("_pool"))).drop("_group", "_pool")
    block = F.when(F.col("pool").isNull(), F.pmod(F.xxhash64("label", "node", F.lit("pool")), F.col("n"))).otherwise(_dealt(rest, F.col("n"))).cast("int")
    named = stored(named.withColumn("block", F.xxhash64("group", "pool", block)).drop("n", "pool"))
    # Sets of a group that meet: two different ones, or the pool with itself; then their blocks.
    one, two = sets.select("group", F.col("pool").alias("p"), F.col("n").alias("np")), sets.select("group", F.col("pool").alias("q"), F.col("n").alias("nq"))
    meet = one.join(two.hint("merge"), "group").filter("p is null or (q is not null and p < q)")
    pairs = meet.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("np") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).filter("q is not null or i <= j")
    pairs = stored(pairs.select(F.xxhash64("group", "p", "i", "q", "j").alias("unit"), F.xxhash64("group", "p", "i").alias("x"), F.xxhash64("group", "q", "j").alias("y")))
    first = pairs.select("unit", F.col("x").alias("block"), F.when(F.col("x") == F.col("y"), 0).otherwise(1).alias("side"))
    second = pairs.filter("x != y").select("unit", F.col("y").alias("block"), F.lit(2).alias("side"))
    return stored(_unit_links(named.join(first.unionByName(second).hint("shuffle_hash"), "block")))


def near_labels(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label) of the nodes (node, doc_id, text_key, size, bands) that have links of SIMILARITY or more: one label a class."""
    found = stored(with_tokens(docs, stored(nodes.join(stored(candidate_groups(nodes)).hint("shuffle_hash"), "node"))))
    links, several = first_links(found)
    class_of = stored(roots(links)).withColumnRenamed("root", "label")
    if several.isEmpty():
        return class_of
    # A label is a node of its class, so links between classes join labels, and nodes without a class stand for themselves.
    ends = more_links(found, several, class_of)
    for end in ("a", "b"):
        label = class_of.select(F.col("node").alias(end), F.col("label").alias("_label"))
        ends = ends.join(label.hint("shuffle_hash"), end, "left").withColumn(end, F.coalesce("_label", end)).drop("_label")
    joined = stored(roots(ends))
    moved = class_of.join(joined.withColumnRenamed("node", "label").hint("shuffle_hash"), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return moved.unionByName(joined.withColumnRenamed("root", "label")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, class_id, size, kept."""
    sketched = stored(sketches(docs))
    # One node for each distinct multiset: its smallest row, numbered by a hash of the bag.
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "text_key", "doc_id", "size", "bands"))
    nodes = stored(sketched.groupBy("bag").agg(first.alias("f")).select(F.xxhash64("bag").alias("node"), "f.doc_id", "f.text_key", "f.size", "f.bands"))
    label_of = stored(near_labels(docs, nodes))
    named = nodes.join(label_of.hint("shuffle_hash"), "node", "left").select("node", "doc_id", "text_key", F.coalesce("label", "node").alias("label"))
    # The document that stays: the smallest doc_id, of rows that repeat it the smallest text.
    stays = named.groupBy("label").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "text_key", "doc_id")).alias("f"))
    node_class = stored(named.select("node", "label").join(stays.hint("merge"), "label").select("node", F.col("f.doc_id").alias("class_id"), F.col("f.text_key").alias("class_text")))
    rows = sketched.select("doc_id", "text_key", F.xxhash64("bag").alias("node"), "size").join(node_class.hint("merge"), "node")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_text"))
    rows = rows.select("doc_id", "text_key", "class_id", "size", kept.alias("kept"))
    wordless = docs.filter(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return rows.unionByName(wordless.select("doc_id", text_key().alias("text_key"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("kept")))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (its class's smallest doc_id), size (its shingles), kept."""
    return classes(docs).drop("text_key")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their class; rows of one doc_id and text stay or go together, rows without doc_id stay."""
    return without(docs, classes(docs).filter("not kept and doc_id is not null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))
