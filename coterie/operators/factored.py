"""The entity graph as shared values: what pairs would say, in rows that grow with the incidences (D02, D05, E02, E03, F01, F02).

A group is a value with its holders; groups(value, member, m, weight, signal) has a row per holder, m times the same one.
Holders a and b of a value are linked by weight * m_a * m_b, and links over several values add up, as merge_edges adds
the edges of shared_attribute_edges. A group of n holders is n rows in place of n (n - 1) / 2 edges. An edge of another
kind, such as a referral, is a group of two. ``pair_edges`` writes the edges out where somebody asks for them.
"""

from collections.abc import Callable
from functools import reduce
from heapq import nlargest
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.components import components
from coterie.functions.storage import stored
from coterie.operators.graph import valid_rows

CHOICES = 16  # communities of a group that its holders look at in a round
LEAST = 1e-4  # of modularity that a round must add
FADING = 0.05  # a level ends when two rounds add less than this share of what it added so far
ROWS_PER_PART = 1_000_000  # incidences whose members one task moves, on average


def shared_groups(incidence: DataFrame, signal: str, weight: float) -> DataFrame:
    """Groups of the values that two members or more of incidence(id, value) hold; repeated rows count in m."""
    rows = _shared(valid_rows(incidence).withColumnRenamed("id", "member"))
    counts = rows.groupBy("value", "member").agg(F.count(F.lit(1)).cast("double").alias("m"))
    return counts.select(F.concat(F.lit(f"{signal}:"), F.col("value").cast("string")).alias("value"), "member", "m", F.lit(float(weight)).alias("weight"), F.lit(signal).alias("signal"))


def numbered_groups(parts: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """shared_groups of each signal's incidence(id, value), if it has every holder of a value once, two or more of them, and whole numbers as values.

    Values stay numbers, different ones for each signal, and nothing is shuffled.
    """
    value = lambda i: (F.col("value").cast("long") * len(parts) + i).alias("value")
    return reduce(DataFrame.unionByName, [rows.select(value(i), F.col("id").alias("member"), F.lit(1.0).alias("m"), F.lit(float(weights[signal])).alias("weight"), F.lit(signal).alias("signal")) for i, (signal, rows) in enumerate(parts.items())])


def edge_groups(edges: DataFrame) -> DataFrame:
    """A group of two for every row of edges(src, dst, weight), which name a pair once; ``signal`` is their first, if they have signals."""
    signal = F.get("signals", F.lit(0)) if "signals" in edges.columns else F.lit("edge")
    ends = edges.select(F.concat_ws("|", F.lit("edge"), F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"), F.explode(F.array("src", "dst")).alias("member"), F.lit(1.0).alias("m"), F.col("weight").cast("double").alias("weight"), signal.alias("signal"))
    return ends


def entity_groups(device: DataFrame, instrument: DataFrame, subnet: DataFrame, referral: DataFrame) -> DataFrame:
    """build_entity_graph in groups."""
    from coterie.operators.graph import WEIGHTS

    parts = (("shared_device", device), ("shared_instrument", instrument), ("ip_subnet_overlap", subnet))
    return reduce(DataFrame.unionByName, [shared_groups(incidence, signal, WEIGHTS[signal]) for signal, incidence in parts] + [edge_groups(referral)])


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (value, member, ...) of the values with two members or more."""
    return _with_two(rows, "value")


def _with_two(rows: DataFrame, *key: str) -> DataFrame:
    """The rows whose key two members or more have, by one shuffle."""
    of = Window.partitionBy(*key)
    return rows.withColumn("_a", F.min("member").over(of)).withColumn("_b", F.max("member").over(of)).filter("_a != _b").drop("_a", "_b")


def pair_edges(groups: DataFrame) -> DataFrame:
    """(src, dst, weight, signals): every linked pair, as merge_edges gives them."""
    a, b = groups.alias("a"), groups.alias("b")
    pairs = a.join(b, (F.col("a.value") == F.col("b.value")) & (F.col("a.member") < F.col("b.member")))
    return pairs.groupBy(F.col("a.member").alias("src"), F.col("b.member").alias("dst")).agg(F.sum(F.col("a.weight") * F.col("a.m") * F.col("b.m")).alias("weight"), F.sort_array(F.collect_set("a.signal")).alias("signals"))


def weighted_degrees(groups: DataFrame) -> DataFrame:
    """(member, k): the weight of all links of each member, from the sizes of its groups."""
    sizes = groups.groupBy("value").agg(F.sum("m").alias("all_m"))
    return groups.join(sizes, "value").groupBy("member").agg(F.sum(F.col("weight") * F.col("m") * (F.col("all_m") - F.col("m"))).alias("k"))


def hard_groups(groups: DataFrame, hard: list[str]) -> DataFrame:
    """The groups whose members hard_subgraph links; star_edges of them have its components."""
    return groups.filter(F.col("signal").isin(hard))


def modularity(groups: DataFrame, membership: DataFrame, gamma: float = 1.3) -> DataFrame:
    """cluster.modularity of the pairs, from counts per value and cluster; members without cluster are their own."""
    named = membership.select("member", F.col("cluster_key").alias("c"))
    rows = groups.join(named, "member", "left").withColumn("alone", F.col("c").isNull())
    key = ["c", "member"] if rows.schema["c"].dataType == rows.schema["member"].dataType else [F.col(c).cast("string") for c in ("c", "member")]
    counts = rows.withColumn("c", F.coalesce(*key)).groupBy("value", "alone", "c").agg(F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("s2"), F.max("weight").alias("w"))
    per = counts.withColumn("all_m", F.sum("s").over(Window.partitionBy("value")))
    each = per.groupBy("alone", "c").agg(F.sum(F.col("w") * (F.col("s") * F.col("s") - F.col("s2")) / 2).alias("inside"), F.sum(F.col("w") * (F.col("s") * F.col("all_m") - F.col("s2"))).alias("degree"))
    total = each.agg(F.sum("inside").alias("inside"), F.sum("degree").alias("m2"), F.sum(F.col("degree") * F.col("degree")).alias("squares"))
    return total.select((F.col("inside") / (F.col("m2") / 2) - gamma * F.col("squares") / (F.col("m2") * F.col("m2"))).alias("q"))


def _moving(gamma: float, m2: float, choices: int, least: float) -> Callable[[pa.Table], pa.Table]:
    """(node, label, k, gain) of a part's nodes, moved one after another; sent as it is, so workers need not have the package.

    Rows without node say what labels of other parts hold of a value: nodes may move there, and nothing leaves them. Nodes are looked at
    again while a value of theirs has changed, until a sweep over all adds less than ``least`` of modularity.
    """

    def moved(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        named = table.filter(table.column("node").is_valid())
        if not named.num_rows:
            return pa.table({"node": named.column("node"), "label": named.column("label"), "k": named.column("k"), "gain": named.column("k")})
        nodes, first, node = np.unique(named.column("node").to_numpy(), return_index=True, return_inverse=True)
        labels, label = np.unique(column("label"), return_inverse=True)
        values, value = np.unique(column("value"), return_inverse=True)
        end = len(nodes) + label  # a label of another part stands for its nodes
        end[table.column("node").is_valid().to_numpy(zero_copy_only=False)] = node
        total = np.zeros(len(labels))
        total[label] = column("here")
        total, m, w = total.tolist(), column("m"), column("w")
        held = np.bincount(value)[value]
        near: list[list] = [[] for _ in range(len(nodes) + len(labels))]  # (other end, weight) of the values of two
        two = np.flatnonzero(held == 2)
        x, y = two[np.argsort(value[two], kind="stable")].reshape(-1, 2).T
        for i, j, weight in zip(end[x].tolist(), end[y].tolist(), (w[x] * m[x] * m[y]).tolist()):
            near[i].append((j, weight))
            near[j].append((i, weight))
        wide: list[list] = [[] for _ in nodes]  # (value, weight, m) of the others
        holds: dict[int, dict] = {}  # what each label holds of them
        more = np.flatnonzero(held > 2)
        for i, v, c, weight, mine in zip(end[more].tolist(), value[more].tolist(), label[more].tolist(), (w[more] * m[more]).tolist(), m[more].tolist()):
            h = holds.setdefault(v, {})
            h[c] = h.get(c, 0.0) + mine
            if i < len(nodes):
                wide[i].append((v, weight, mine))
        at = [*np.searchsorted(labels, named.column("label").to_numpy()[first]).tolist(), *range(len(labels))]
        k, free = (named.column(c).to_numpy(zero_copy_only=False)[first].tolist() for c in ("k", "free"))
        order = [x for x in np.random.default_rng(7).permutation(len(nodes)).tolist() if free[x]]
        gains, awake, changed, turn = [0.0] * len(nodes), [True] * len(near), dict.fromkeys(holds, 0), 0
        while True:
            added = 0.0
            top = {v: nlargest(choices, h, key=lambda c: (h[c], -total[c])) for v, h in holds.items() if len(h) > choices}  # noqa: B023
            for x in order:
                if not awake[x] and not any(changed[v] >= turn for v, _, _ in wide[x]):
                    continue
                awake[x] = False
                a, links, own = at[x], {}, 0.0
                for y, weight in near[x]:
                    c = at[y]
                    links[c] = links.get(c, 0.0) + weight
                for v, weight, mine in wide[x]:
                    h = holds[v]
                    own += weight * (h[a] - mine)
                    for c in top.get(v, h):
                        if c != a:
                            links[c] = links.get(c, 0.0) + weight * h.get(c, 0.0)
                pull = gamma * k[x] / m2
                stay = links.pop(a, 0.0) + own - pull * (total[a] - k[x])
                best, to = stay + 1e-9, a
                for c, link in links.items():
                    gain = link - pull * total[c]
                    if gain > best:
                        best, to = gain, c
                if to == a:
                    continue
                at[x], added, gains[x] = to, added + best - stay, gains[x] + best - stay
                total[a] -= k[x]
                total[to] += k[x]
                for y, _ in near[x]:
                    awake[y] = True
                for v, _, mine in wide[x]:
                    h, changed[v] = holds[v], turn + 1
                    h[to] = h.get(to, 0.0) + mine
                    h[a] -= mine
                    if h[a] <= 0:
                        del h[a]
            turn += 1
            if 2 * added / m2 < least:
                break
        schema = named.schema
        array = lambda x, c: pa.array(x.tolist(), schema.field(c).type)
        return pa.table({"node": array(nodes, "node"), "label": array(labels[at[: len(nodes)]], "label"), "k": pa.array(k, pa.float64()), "gain": pa.array(gains, pa.float64())})

    return moved


class _Level:
    """One level of the search: rows(value, node, m, w) and a labelling of the nodes, judged when asked with the best move of each node.

    ``table`` has (node, label, k, here, whole, to, gain): ``here`` is the degree of the node's community, ``whole`` what it and its
    links inside weigh, ``to`` the community it gains most in, null if in none. ``fixed`` and ``squares`` are what members link to
    themselves or lies in values of one node, and the squared degrees of nodes without rows.
    """

    def __init__(self, rows: DataFrame, state: DataFrame, m2: float, fixed: float, gamma: float, squares: float = 0.0, choices: int = CHOICES):
        self.rows, self.m2, self.fixed, self.squares, self.gamma, self.choices, self.turn = rows, m2, fixed, squares, gamma, choices, 0
        self.label(state)

    def label(self, state: DataFrame, up: bool | None = None) -> None:
        """Takes the labelling ``state``; ``up`` is for the moves it is judged with."""
        self.state, self.up, self.judged = state, up, None

    def judge(self) -> tuple[DataFrame, float, float]:
        """The table of the labelling, its modularity and what its moves would add one by one."""
        if not self.judged:
            table = self.moves(self.up, self.choices)
            x, y, hope = table.agg(F.sum("whole"), F.sum(F.col("k") * F.col("here")), F.sum("gain")).first()
            self.judged = table, ((x or 0.0) + self.fixed) / self.m2 - self.gamma * ((y or 0.0) + self.squares) / self.m2**2, 2 * (hope or 0.0) / self.m2
            self.state = table.select("node", "label", "k")
        return self.judged

    @property
    def table(self) -> DataFrame:
        return self.judge()[0]

    @property
    def q(self) -> float:
        return self.judge()[1]

    @property
    def hope(self) -> float:
        return self.judge()[2]

    @property
    def counts(self) -> DataFrame:
        """(value, label, s, w): what each community holds of each value."""
        return self.rows.join(self.state.select("node", "label"), "node").groupBy("value", "label").agg(F.sum("m").alias("s"), F.max("w").alias("w"))

    def moves(self, up: bool | None, choices: int) -> DataFrame:
        """The table of the labelling ``state``, written; ``up`` is None for moves between halves, else their direction.

        Communities are halved at random, anew each turn, and nodes of one half move to the other, which loses none meanwhile.
        Else all move towards larger labels, or all towards smaller ones. A group's holders look at
        its ``choices`` communities of most holders, the lighter first. Links that a community has through groups where it is
        not among those do not count in its favour, so a gain is never overrated.
        """
        half = F.pmod(F.xxhash64(F.lit(self.turn), F.col("label")), F.lit(2)) == 0
        open_ = half if up is None else F.lit(True)
        way = {None: lambda to: ~half, True: lambda to: to > F.col("label"), False: lambda to: to < F.col("label")}[up]
        state = self.state
        totals = state.groupBy("label").agg(F.sum("k").alias("here"))
        placed = self.rows.join(state.join(totals, "label"), "node").repartition("value")
        counted = placed.withColumn("s", F.sum("m").over(Window.partitionBy("value", "label"))).withColumn("open", open_)
        order = Window.partitionBy("value").orderBy(F.desc("open"), F.desc("s"), "here", "label")
        ranked = counted.withColumn("p", F.dense_rank().over(order))
        seen = F.when(F.col("open") & (F.col("p") <= choices), F.struct(F.col("label").alias("to"), "s", F.col("here").alias("there")))
        near = ranked.withColumn("near", F.collect_set(seen).over(Window.partitionBy("value")))
        own = F.array(F.struct(F.col("label").alias("to"), "s", F.col("here").alias("there")))
        each = near.select("node", "label", "k", "here", "m", "w", F.explode(F.concat(own, F.filter("near", lambda x: way(x["to"]) & (x["to"] != F.col("label"))))).alias("e"))
        mine, weight = F.col("e.to") == F.col("label"), F.col("w") * F.col("m")
        each = each.select("node", "label", "k", "here", F.col("e.to").alias("to"), F.col("e.there").alias("there"), (weight * (F.col("e.s") - F.when(mine, F.col("m")).otherwise(0.0))).alias("links"), F.when(mine, weight * F.col("e.s")).otherwise(0.0).alias("whole"))
        per = each.repartition("node").groupBy("node", "label", "k", "here", "to", "there").agg(F.sum("links").alias("links"), F.sum("whole").alias("whole"))
        mine, gain = F.col("to") == F.col("label"), F.col("links") - self.gamma * F.col("k") * F.col("there") / self.m2
        stay = F.col("links") - self.gamma * F.col("k") * (F.col("here") - F.col("k")) / self.m2
        best = per.groupBy("node", "label", "k", "here").agg(F.sum("whole").alias("whole"), F.max(F.when(mine, stay)).alias("stay"), F.min(F.when(~mine, F.struct((-gain).alias("less"), "to"))).alias("best"))
        gained = -F.col("best.less") - F.col("stay")
        return stored(best.select("node", "label", "k", "here", "whole", F.when(gained > 1e-9, F.col("best.to")).alias("to"), F.when(gained > 1e-9, gained).alias("gain")))

    def settle(self, parts: int) -> float:
        """Moves nodes one after another in each part, and returns what the parts add, each by itself.

        Communities are dealt to parts at random, anew each turn, with all their nodes. With one part a node moves wherever it gains most, and
        the sum is exact, or too small where a value has more than ``choices`` communities. Of several, half of the communities keep their nodes; those of the others move within their part,
        or to one of the half in another part, of which a value names its ``choices`` of most holders.
        A community with more than a part's share of rows keeps its nodes, which are not sent.
        """
        totals = self.state.groupBy("label").agg(F.sum("k").alias("here"))
        named = self.state.select("node", "label", "k").join(totals, "label")
        placed = self.rows.join(named, "node").select("value", "node", "label", "k", "here", "m", "w")
        chance = F.xxhash64(F.lit(self.turn), F.lit("part"), F.col("label"))
        if parts == 1:
            sent = placed.withColumn("part", F.lit(0)).withColumn("free", F.lit(True))
        else:
            large = self.rows.join(self.state, "node").groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ROWS_PER_PART).select("label", F.lit(True).alias("large"))
            dealt = placed.join(F.broadcast(stored(large)), "label", "left").withColumn("part", F.when(F.col("large"), -1).otherwise(F.pmod(chance, F.lit(parts)))).withColumn("keeps", F.col("large").isNotNull() | (F.pmod(F.shiftright(chance, 32), F.lit(2)) == 0))
            dealt = stored(dealt.drop("large"))
            held = dealt.groupBy("value", "label", "part", "here", "keeps").agg(F.sum("m").alias("m"), F.max("w").alias("w"))
            met = Window.partitionBy("value")
            first = F.row_number().over(met.orderBy(F.desc("keeps"), F.desc("m"), "here", "label"))
            asked = held.withColumn("parts", F.collect_set("part").over(met)).withColumn("p", first).filter((F.col("p") <= self.choices) & F.col("keeps"))
            others = asked.select("*", F.explode("parts").alias("to")).filter("`to` != part and `to` >= 0")
            none = F.lit(None).cast(dealt.schema["node"].dataType).alias("node")
            own = dealt.filter("part >= 0").withColumn("free", ~F.col("keeps")).drop("keeps")
            sent = own.unionByName(others.select("value", none, "label", F.lit(0.0).alias("k"), "here", "m", "w", F.col("to").alias("part"), F.lit(False).alias("free")))
        kind = dict(self.state.dtypes)
        moved = sent.groupBy("part").applyInArrow(_moving(self.gamma, self.m2, self.choices, LEAST / parts), f"node {kind['node']}, label {kind['label']}, k double, gain double")
        moved = stored(moved)
        self.turn += 1
        added = moved.agg(F.sum("gain")).first()[0] or 0.0
        state = moved.select("node", "label", "k")
        if parts > 1:
            state = self.state.join(state.withColumnRenamed("label", "to").drop("k"), "node", "left").select("node", F.coalesce("to", "label").alias("label"), "k")
        self.label(state)
        return 2 * added / self.m2

    def take(self) -> bool:
        """Makes the moves if modularity rises, else a quarter of them, else those of which no two touch one community,
        whose gains add up exactly. Parts of moves that would add too little one by one are not tried; all together may add more."""
        if not self.hope:
            return False
        before = self.state, self.judged
        table, q, hope = self.judged
        chance, moves = F.xxhash64(F.lit(self.turn), F.col("node")), table.filter(F.col("to").isNotNull()).select("node", "label", "to")
        for share in (1, 4, 0) if hope > LEAST else (1,):
            if share:
                state = table.select("node", F.coalesce(F.when(F.pmod(chance, F.lit(share)) == 0, F.col("to")), "label").alias("label"), "k")
            else:
                state = table.select("node", "label", "k").join(_apart(moves, chance).select("node", "to"), "node", "left").select("node", F.coalesce("to", "label").alias("label"), "k")
            self.turn += 1
            self.label(state)
            if self.q > q + LEAST:
                return True
        self.state, self.judged = before
        return False

    def search(self) -> bool:
        """Moves nodes until little is left to gain; whether any moved.

        Up to ``ROWS_PER_PART`` rows, counted first, one part has all of them. Else parts take turns until two rounds add little,
        or neither parts, two of halves nor one in either direction raise modularity."""
        n, widest = self.rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
        parts = ceil((n or 0) / ROWS_PER_PART) or 1
        if parts == 1:
            added = [self.settle(1)]
            while added[-1] > LEAST and widest > self.choices and self.hope > LEAST:
                added.append(self.settle(1))
            return max(added) > LEAST
        idle, reached = 0, [self.q]
        while True:
            before = self.state, self.judged
            done = not idle and self.settle(parts) > LEAST and self.q > reached[-1] + LEAST
            if not done:
                self.state, self.judged = before
                done = self.take()
            idle = 0 if done else idle + 1
            reached += [self.q] if done else []
            faded = len(reached) > 3 and self.q - reached[-3] < FADING * (self.q - reached[0])
            if faded or idle == 4:
                return len(reached) > 1
            if not done:
                self.turn += 1
                self.label(self.state, {1: None, 2: True, 3: False}[idle])

    def split(self) -> None:
        """Communities that fell apart become their pieces, which leaves the links inside and lowers the squares of the degrees."""
        rows = self.rows.join(self.state.select("node", "label"), "node")
        lead = rows.groupBy("value", "label").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a != b").select("value", "label", "a")
        links = rows.join(lead, ["value", "label"]).filter("a != node").select("a", F.col("node").alias("b")).distinct()
        pieces = components(links).withColumnRenamed("label", "piece")
        self.label(stored(self.state.join(pieces, "node", "left").select("node", F.coalesce("piece", "node").alias("label"), "k")))

    def coarser(self) -> "_Level":
        """The communities as nodes; values inside one community only add to what is fixed, communities without others to the squares.

        Values that the same two communities hold become one, with what they weigh together."""
        rows = stored(self.counts.select("value", F.col("label").alias("node"), F.col("s").alias("m"), "w"))
        per = stored(rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), F.max("w").alias("w"), F.min("m").alias("lo"), F.max("m").alias("hi")))
        inside = F.when(F.col("n") == 1, F.col("hi") * F.col("hi")).when(F.col("n") == 2, (F.col("hi") - F.col("lo")) * (F.col("hi") - F.col("lo")))
        fixed, widest = per.agg(F.sum(F.col("w") * inside), F.max("n")).first()
        pairs = per.filter("n = 2").groupBy("a", "b").agg(F.min("value").alias("value"), F.sum(F.col("w") * F.col("lo") * F.col("hi")).alias("w"))
        left = pairs.select("value", F.explode(F.array("a", "b")).alias("node"), F.lit(1.0).alias("m"), "w")
        if (widest or 0) > 2:
            left = left.unionByName(rows.join(per.filter("n > 2").select("value"), "value", "left_semi"))
        left = stored(left)
        state = stored(self.state.groupBy(F.col("label").alias("node")).agg(F.sum("k").alias("k")).select("node", F.col("node").alias("label"), "k").join(left.select("node", F.lit(True).alias("open")).distinct(), "node", "left"))
        alone = state.filter("open is null").agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
        return _Level(left, state.filter("open").drop("open"), self.m2, self.fixed + (fixed or 0.0), self.gamma, self.squares + alone, self.choices)


def _apart(moves: DataFrame, chance) -> DataFrame:
    """Moves of which no two leave or enter the same community: those that come first in both of theirs."""
    rank = F.struct(chance.alias("h"), F.col("node").alias("n"))
    ends = moves.select(rank.alias("rank"), F.explode(F.array("label", "to")).alias("c")).groupBy("c").agg(F.max("rank").alias("first"))
    ranked = moves.withColumn("rank", rank)
    at = lambda c, name: ends.select(F.col("c").alias(c), F.col("first").alias(name))
    return ranked.join(at("label", "f1"), "label").join(at("to", "f2"), "to").filter((F.col("rank") == F.col("f1")) & (F.col("rank") == F.col("f2"))).select("node", "label", "to")


def communities(groups: DataFrame, gamma: float = 1.3, min_size: int = 3, choices: int = CHOICES) -> DataFrame:
    """(cluster_key, member): Louvain communities of min_size or more, each one connected block, from groups of any size.

    Nodes move one after another in parts of ``ROWS_PER_PART`` rows; rounds of several parts are kept only if modularity rises by ``LEAST``. When
    little is left to gain, communities that fell apart are split, and communities become the nodes of the next level, until a level moves nothing. A round
    makes ``choices`` rows per incidence at most. With groups of up to ``choices`` communities, as edges are, every
    neighbouring community is compared.
    """
    base = stored(groups.groupBy("value", "member").agg(F.max("m").alias("m"), F.max("weight").alias("w")))
    degrees = stored(weighted_degrees(base.withColumnRenamed("w", "weight")))
    m2 = degrees.agg(F.sum("k")).first()[0] or 0.0
    names = degrees.select("member", F.col("member").alias("label"))
    if m2:
        own = base.agg(F.sum(F.col("w") * F.col("m") * F.col("m"))).first()[0]
        level = _Level(base.withColumnRenamed("member", "node"), degrees.select(F.col("member").alias("node"), F.col("member").alias("label"), "k"), m2, -own, gamma, choices=choices)
        while level.search():
            level.split()
            names = stored(names.withColumnRenamed("label", "node").join(level.state.select("node", "label"), "node", "left").select("member", F.coalesce("label", "node").alias("label")))
            level = level.coarser()
    keyed = names.groupBy("label").agg(F.min("member").alias("cluster_key"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size)
    return names.join(keyed, "label").select("cluster_key", "member")


def _inside(groups: DataFrame, membership: DataFrame) -> DataFrame:
    """(cluster_key, value, member, signal) of values that two members or more of a cluster hold."""
    rows = groups.select("value", "member", "signal").join(membership.select("cluster_key", "member"), "member")
    return _with_two(rows, "cluster_key", "value")


def density(groups: DataFrame, membership: DataFrame) -> DataFrame:
    """features.density without the pairs: (cluster_key, size, n_edges, edge_density).

    Pairs among the holders of a cluster's commonest value are counted, not listed. Members that hold the same values
    are one class; only pairs of classes with one outside that value are looked up, by a value they share.
    """
    inside = stored(_inside(groups, membership).select("cluster_key", "value", "member").distinct())
    held = inside.groupBy("cluster_key", "value").agg(F.count(F.lit(1)).alias("n"))
    top = held.groupBy("cluster_key").agg(F.max_by("value", F.struct("n", "value")).alias("top"), F.max("n").alias("n"))
    sets = inside.groupBy("cluster_key", "member").agg(F.sort_array(F.collect_list("value")).alias("held")).groupBy("cluster_key", "held").agg(F.count(F.lit(1)).alias("size"))
    classes = stored(sets.join(top.select("cluster_key", "top"), "cluster_key").select("cluster_key", F.sha2(F.array_join(F.col("held").cast("array<string>"), "\n"), 256).alias("c"), "held", "size", F.array_contains("held", F.col("top")).alias("in_top")))
    each = stored(classes.select("cluster_key", "c", "size", "in_top", F.explode("held").alias("value")))
    a = each.filter("not in_top").select("cluster_key", "value", F.col("c").alias("ca"), F.col("size").alias("na"))
    b = each.select("cluster_key", "value", F.col("c").alias("cb"), F.col("size").alias("nb"), "in_top")
    across = a.join(b.hint("merge"), ["cluster_key", "value"]).filter("in_top or ca < cb").select("cluster_key", "ca", "cb", "na", "nb").distinct()
    counts = [
        top.select("cluster_key", (F.col("n") * (F.col("n") - 1) / 2).alias("e")),
        classes.filter("not in_top").select("cluster_key", (F.col("size") * (F.col("size") - 1) / 2).alias("e")),
        across.select("cluster_key", (F.col("na") * F.col("nb")).cast("double").alias("e")),
    ]
    n = reduce(DataFrame.unionByName, counts).groupBy("cluster_key").agg(F.sum("e").cast("long").alias("n_edges"))
    size = membership.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("size"))
    out = size.join(n, "cluster_key", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return out.withColumn("edge_density", F.when(F.col("size") > 1, F.round(F.col("n_edges") / (F.col("size") * (F.col("size") - 1) / 2), 4)).otherwise(0.0))


def signals_present(groups: DataFrame, membership: DataFrame) -> DataFrame:
    """features.signals_present from the values that a cluster's members share."""
    return _inside(groups, membership).groupBy("cluster_key").agg(F.sort_array(F.collect_set("signal")).alias("signals_present"))
