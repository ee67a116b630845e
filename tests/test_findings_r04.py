import random

import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from coterie.operators import graph, scoring
from coterie.plans import registry


@pytest.mark.parametrize("kind", ["string", "long"])
def test_destinations_are_gathered_where_pairs_are_made_without_an_aggregate(spark, monkeypatch, kind):
    monkeypatch.setattr(graph, "PAIRS_PER_CELL", 8)
    monkeypatch.setattr(graph, "ROWS_PER_BATCH", 3)
    rng = random.Random(9)
    rows = [(rng.choice([1, 2, None]), rng.choice([*range(8, 24), None]), rng.choice("xyz"), str(rng.randrange(4))) for _ in range(90)]
    held = {}
    for c, s, d, p in rows:
        if c is not None and s is not None:
            held.setdefault((str(c), str(s) if kind == "string" else s), set()).add(f"{d}:{p}")
    want = {(c, a, b): sorted(v & w) for (c, a), v in held.items() for (k, b), w in held.items() if c == k and a < b and v & w}
    flows = spark.createDataFrame(rows, "capture long, src long, dst string, port string").withColumns({"capture": F.col("capture").cast("string"), "src": F.col("src").cast(kind)})
    edges = graph.co_destination_edges(flows)
    got = edges.collect()
    assert {(r.capture, r.src, r.dst): r.destinations for r in got} == want and len(got) == len(want)
    assert dict(edges.dtypes)["weight"] == "bigint" and all(r.weight == len(r.destinations) for r in got)
    above = edges._jdf.queryExecution().executedPlan().toString().split("FlatMapGroups", 1)[0]
    assert "Generate" in above and "Aggregate" not in above and "Exchange" not in above
    assert graph.co_destination_edges(flows.limit(0)).count() == 0


@pytest.mark.parametrize("most", [2**62, 0])
def test_pairs_of_a_cell_with_numbers_too_large_to_sort_as_one(monkeypatch, most):
    monkeypatch.setattr(graph, "MOST_CODES", most)
    lists = [("w1", "b", 1, ["s3", "s1"]), ("w1", "a", 0, ["s2", "s1"]), ("w1", "b", 2, ["s2"]), ("w2", "a", 1, ["s9"])]
    table = pa.table({c: pa.array([r[i] for r in lists]) for i, c in enumerate(["capture", "value", "side", "holders"])})
    met = [(r["capture"], r["src"], [(e["dst"], e["destinations"]) for e in r["met"]]) for r in graph._meeting()(table).to_pylist()]
    assert met == [("w1", "s1", [("s2", ["a", "b"])]), ("w1", "s2", [("s3", ["b"])])]


def test_the_query_on_columns_fits_the_whole_grid(spark, monkeypatch):
    seen = []

    def fitted(train, dev, inputs, grid, stages):
        seen.append(grid)
        model = Pipeline(stages=stages(None, (2, 1))).fit(inputs.transform(train).withColumn("weight", F.lit(1.0)))
        return scoring.Scorer(inputs, model, grid[0], 0.5)

    monkeypatch.setattr(scoring, "_fitted", fitted)
    assert registry.QUERIES["j06_fit_on_columns"](spark, "/root/testdata/sf0.001").filter("score is null").count() == 0
    assert seen == [tuple((depth, rounds) for depth in (3, 4, 6) for rounds in (100, 300))]


def test_points_fitted_side_by_side_are_those_fitted_one_by_one(spark, monkeypatch):
    rows = spark.createDataFrame([([float(i % 7), float(i % 5)], int(i % 7 < 3 or i % 11 == 0)) for i in range(300)], "features array<double>, label int")
    grid = ((1, 1), (2, 3), (2, 3, "again"), (2, 2))
    stages = lambda _, g: [GBTClassifier(featuresCol="vector", weightCol="weight", maxDepth=g[0], maxIter=g[1], seed=7)]
    best = scoring._fitted(rows, rows, None, grid, stages)
    monkeypatch.setattr(scoring, "AT_ONCE", 1)
    alone = scoring._fitted(rows, rows, None, grid, stages)
    shape = lambda scorer: [(t.depth, t.numNodes) for t in scorer.model.stages[0].trees]
    assert best.chosen == alone.chosen == (2, 3) and abs(best.auc - alone.auc) < 1e-9 and shape(best) == shape(alone)
    assert spark.sparkContext.getCheckpointDir()
