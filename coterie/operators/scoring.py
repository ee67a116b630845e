"""Splits, supervised scoring and ranking metrics (J)."""

from ast import literal_eval
from dataclasses import dataclass
from math import ceil
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coterie.functions.order import global_row_number, running_sums
from coterie.functions.storage import shared_folder, stored


def time_split(df: DataFrame, keys: list[str], train: float = 0.70, validation: float = 0.85) -> DataFrame:
    """Adds split by row position in the order of keys, the last of which is unique."""
    n = df.count()
    ranked = global_row_number(df, [F.col(k) for k in keys], "_n")
    split = F.when(F.col("_n") <= F.floor(F.lit(n * train)), "train").when(F.col("_n") <= F.floor(F.lit(n * validation)), "validation").otherwise("holdout")
    return ranked.withColumn("split", split).drop("_n")


def _md5_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def random_split3(df: DataFrame, key: str, train: float = 0.60, dev: float = 0.15, seed: int = 7) -> DataFrame:
    n = df.count()
    ranked = global_row_number(df.withColumn("_h", _md5_order(key, seed)), [F.col("_h"), F.col(key)], "_n")
    split = F.when(F.col("_n") <= F.floor(F.lit(n * train)), "train").when(F.col("_n") <= F.floor(F.lit(n * (train + dev))), "dev").otherwise("test")
    return ranked.withColumn("split", split).drop("_n", "_h")


def stratified_split3(df: DataFrame, key: str, label: str, train: float = 0.60, dev: float = 0.15, seed: int = 7) -> DataFrame:
    """random_split3 within each class: a global order by class and md5, less the classes before."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = global_row_number(df.withColumn("_h", _md5_order(key, seed)), [F.col(label), F.col("_h"), F.col(key)], "_n").join(F.broadcast(before), label)
    place = F.col("_n") - F.col("_before")
    split = F.when(place <= F.floor(F.col("_size") * train), "train").when(place <= F.floor(F.col("_size") * (train + dev)), "dev").otherwise("test")
    return ranked.withColumn("split", split).drop("_n", "_h", "_size", "_before")


def class_weight(train: DataFrame, label: str) -> DataFrame:
    return train.agg((F.count_if(F.col(label) == 0) / F.nullif(F.count_if(F.col(label) == 1), F.lit(0))).alias("positive_weight"))


# The grids that dev AUC chooses from; C is the inverse of the penalty on the sum of losses.
PENALTIES = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
TREES = tuple((depth, rounds) for depth in (3, 4, 6) for rounds in (100, 300))
STEP = 0.1
ROWS_PER_TASK = 50_000  # of a table that a fit reads again and again
AT_ONCE = 6  # grid points fitted side by side, as most of a fit's jobs are too short to fill a cluster


def fit_inputs(train: DataFrame, numeric: list[str], categorical: list[str], most: int = 200) -> PipelineModel:
    """What turns a table's columns into ``vector``, learned from ``train`` alone; it is saved and loaded like any PipelineModel.

    Numbers that are missing (null or NaN) become the training median and set an indicator of their own. The ``most``
    commonest values of a category get an index; null, empty, rarer and unseen values share one more, so a value that training
    did not see is a missing one and no row is lost. A number that training never saw has median 0.
    """
    medians = train.agg(*[F.percentile_approx(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), 0.5).alias(f"m{i}") for i, c in enumerate(numeric)]).first() if numeric else ()
    number = lambda c: f"nullif(cast(`{c}` as double), double('NaN'))"
    filled = [x for i, c in enumerate(numeric) for x in (f"coalesce({number(c)}, double('{medians[i] or 0.0!r}')) as n{i}_", f"cast({number(c)} is null as double) as m{i}_")]
    texts = [f"nullif(cast(`{c}` as string), '') as c{i}_" for i, c in enumerate(categorical)]
    stages = [SQLTransformer(statement=f"SELECT {', '.join(['*', *filled, *texts])} FROM __THIS__")]
    if categorical:
        counts = [train.groupBy(F.col(f"`{c}`").cast("string").alias("x")).count().filter("x != ''").orderBy(F.desc("count"), "x").limit(most).collect() for c in categorical]
        stages += [StringIndexerModel.from_labels([r.x for r in rows] or ["(none)"], inputCol=f"c{i}_", outputCol=f"x{i}_", handleInvalid="keep") for i, rows in enumerate(counts)]
        stages.append(OneHotEncoder(inputCols=[f"x{i}_" for i in range(len(categorical))], outputCols=[f"o{i}_" for i in range(len(categorical))], dropLast=False))
    inputs = [c for i in range(len(numeric)) for c in (f"n{i}_", f"m{i}_")] + [f"o{i}_" for i in range(len(categorical))]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="vector"))
    return Pipeline(stages=stages).fit(train)


def _vectors(df: DataFrame, inputs: PipelineModel | None) -> DataFrame:
    """``df`` with ``vector``: of its array ``features``, or of the columns that ``inputs`` takes."""
    return inputs.transform(df) if inputs else df.withColumn("vector", array_to_vector(F.col("features").cast("array<double>")))


@dataclass
class Scorer:
    """A fitted model with its inputs; ``chosen`` is what dev AUC picked from the grid, ``auc`` that AUC."""

    inputs: PipelineModel | None
    model: PipelineModel
    chosen: tuple
    auc: float

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.model.transform(_vectors(df, self.inputs))

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        if self.inputs:
            self.inputs.write().overwrite().save(f"{path}/inputs")
        spark.createDataFrame([(self.inputs is not None, repr(self.chosen), self.auc)], "inputs boolean, chosen string, auc double").write.mode("overwrite").json(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Scorer":
        about = spark.read.schema("inputs boolean, chosen string, auc double").json(f"{path}/about").first()
        inputs = PipelineModel.load(f"{path}/inputs") if about.inputs else None
        return Scorer(inputs, PipelineModel.load(f"{path}/model"), literal_eval(about.chosen), about.auc)


def _fitted(train: DataFrame, dev: DataFrame, inputs: PipelineModel | None, grid, stages) -> Scorer:
    """The model of the grid point whose dev AUC is largest, the first on ties; positives weigh as much as negatives in training."""
    weight = class_weight(train, "label").first()[0] or 1.0
    label = F.col("label").cast("double")
    ready = stored(_vectors(train, inputs).select("vector", label.alias("label"), F.when(label == 1, weight).otherwise(1.0).alias("weight")))
    ready = ready.repartition(ceil(ready.count() / ROWS_PER_TASK) or 1)  # a fit keeps its own copy of a task's rows, many times their file's size
    held = stored(_vectors(dev, inputs).select("vector", label.alias("label")))
    auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction")
    spark = train.sparkSession
    if not spark.sparkContext.getCheckpointDir():  # else boosting keeps the lineage of all its rounds
        spark.sparkContext.setCheckpointDir(shared_folder(spark))

    def fit(point) -> Scorer:
        model = Pipeline(stages=stages(ready, point)).fit(ready)
        return Scorer(inputs, model, point if isinstance(point, tuple) else (point,), auc.evaluate(model.transform(held)))

    with ThreadPool(max(1, min(AT_ONCE, len(grid)))) as pool:
        fitted = pool.map(inheritable_thread_target(spark)(fit), grid, chunksize=1)
    return max(fitted, key=lambda scorer: scorer.auc, default=None)


def fit_logistic(train: DataFrame, dev: DataFrame, grid: tuple[float, ...] = PENALTIES, inputs: PipelineModel | None = None) -> Scorer:
    """A scorer of (features array, label) tables, or of those ``inputs`` takes: standardised on train, the penalty by dev AUC."""
    n = train.count()

    def stages(_, c: float) -> list:
        scaler = StandardScaler(inputCol="vector", outputCol="scaled", withMean=True)
        return [scaler, LogisticRegression(featuresCol="scaled", weightCol="weight", regParam=1 / (c * max(n, 1)), maxIter=100)]

    return _fitted(train, dev, inputs, grid, stages)


def fit_boosted_trees(train: DataFrame, dev: DataFrame, grid: tuple[tuple[int, int], ...] = TREES, inputs: PipelineModel | None = None) -> Scorer:
    """A scorer like fit_logistic's: boosted trees, (depth, rounds) by dev AUC."""
    stages = lambda _, g: [GBTClassifier(featuresCol="vector", weightCol="weight", maxDepth=g[0], maxIter=g[1], stepSize=STEP, seed=7)]
    return _fitted(train, dev, inputs, grid, stages)


def score(model: Scorer, df: DataFrame) -> DataFrame:
    """``df`` with ``score``, the probability of label 1."""
    return model(df).select(*[F.col(f"`{c}`") for c in df.columns], F.get(vector_to_array("probability"), 1).alias("score"))


def effect_sizes(train: DataFrame, k: int = 10) -> DataFrame:
    """Cohen's d of each feature (features array, label), the k largest by absolute value, with sign, mean and std over all rows."""
    long = train.select("label", F.posexplode("features").alias("idx", "x")).withColumn("x", F.col("x").cast("double"))
    by_class = [f(F.when(F.col("label") == c, F.col("x"))).alias(f"{n}{c}") for c in (0, 1) for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    m = long.groupBy("idx").agg(*by_class, F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    pooled = F.sqrt((F.col("std0") * F.col("std0") + F.col("std1") * F.col("std1")) / 2)
    d = m.withColumn("d", F.when(pooled > 1e-9, (F.col("mean1") - F.col("mean0")) / pooled).otherwise(0.0))
    d = d.withColumn("sign", F.when(F.col("d") < 0, -1.0).otherwise(1.0)).withColumn("std", F.when(F.col("std") < 1e-9, 1.0).otherwise(F.col("std")))
    return d.orderBy(F.desc(F.abs("d")), "idx").limit(k)


def z_score_sum(df: DataFrame, selection: DataFrame) -> DataFrame:
    """(id, z): mean signed z of the features in selection (idx, sign, mean, std), at most some tens of rows."""
    long = df.select("id", F.posexplode("features").alias("idx", "x"))
    j = long.join(F.broadcast(selection.select("idx", "sign", "mean", "std")), "idx")
    return j.groupBy("id").agg(F.avg(F.col("sign") * (F.col("x") - F.col("mean")) / F.col("std")).alias("z"))


def pr_points(scores: DataFrame) -> DataFrame:
    """(score, tp, fp, precision, recall) at each distinct score as threshold."""
    per = stored(scores.groupBy("score").agg(F.count_if(F.expr("label = 1")).alias("p"), F.count_if(F.expr("label != 1")).alias("n")))
    total = per.agg(F.sum("p")).first()[0] or 0
    cum = running_sums(per, [F.desc("score")], {"tp": "p", "fp": "n"})
    return cum.select("score", "tp", "fp", "p", "n", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.lit(float(total) or None)).alias("recall"))


def best_f1_threshold(scores: DataFrame) -> DataFrame:
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return pr_points(scores).withColumn("f1", F.round(f1, 9)).agg(F.max_by("score", F.struct("f1", -F.col("score"))).alias("threshold"), F.max("f1").alias("f1"))


def metrics_at_threshold(scores: DataFrame, t: Column | float) -> DataFrame:
    hit = F.col("score") >= (t if isinstance(t, Column) else F.lit(t))
    c = scores.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.expr("label = 1")).alias("positives"), F.count_if(hit).alias("alerts"), F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") != 1)).alias("fp"))
    div = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return c.select("*", div("positives", "rows").alias("rate"), div("tp", "alerts").alias("precision"), div("tp", "positives").alias("recall"), (2 * F.col("tp") / F.nullif(F.col("alerts") + F.col("positives"), F.lit(0))).alias("f1"), ((F.col("rows") - F.col("positives") - F.col("fp") + F.col("tp")) / F.col("rows")).alias("accuracy"))


def ranking_quality(scores: DataFrame) -> DataFrame:
    """Step-wise average precision and rank AUC with ties counted half."""
    pts = pr_points(scores)
    t = pts.agg(F.sum(F.col("precision") * F.col("p")).alias("ap"), F.sum("p").alias("pos"), F.sum("n").alias("neg"), F.sum(F.col("n") * (F.col("tp") - F.col("p")) + F.col("n") * F.col("p") / 2).alias("wins"))
    return t.select((F.col("ap") / F.nullif(F.col("pos"), F.lit(0))).alias("average_precision"), (F.col("wins") / F.nullif(F.col("pos") * F.col("neg"), F.lit(0))).alias("roc_auc"))


def top_k_metrics(scores: DataFrame, ks: list[int]) -> DataFrame:
    """Precision, recall and lowest score of the best k rows (ties by id)."""
    total = scores.agg(F.count_if(F.expr("label = 1"))).first()[0]
    best = scores.orderBy(F.desc("score"), "id").limit(max(ks))
    ranked = best.withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # at most max(ks) rows
    each = ranked.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("n <= k")
    return each.groupBy("k").agg((F.count_if(F.expr("label = 1")) / F.count(F.lit(1))).alias("precision"), (F.count_if(F.expr("label = 1")) / F.lit(float(total) or None)).alias("recall"), F.min("score").alias("lowest"))


def segmented_threshold(validation: DataFrame, holdout: DataFrame, segment: str) -> DataFrame:
    """Each segment's best-F1 threshold on validation and its alerts, tp and positives on holdout; a row without segment pools them.

    Running counts are global ones less those of the segments before, so a segment of any size is spread over tasks.
    """
    per = stored(validation.groupBy(segment, "score").agg(F.count_if(F.expr("label = 1")).alias("p"), F.count(F.lit(1)).alias("a")))
    run = stored(running_sums(per, [F.col(segment), F.desc("score")], {"cp": "p", "ca": "a"}))
    base = run.groupBy(F.col(segment).alias("_segment")).agg(F.min(F.col("cp") - F.col("p")).alias("bp"), F.min(F.col("ca") - F.col("a")).alias("ba"), F.sum("p").alias("total"))
    f1 = F.round(2 * (F.col("cp") - F.col("bp")) / (F.col("ca") - F.col("ba") + F.col("total")), 9)
    best = run.join(base.hint("merge"), F.col(segment).eqNullSafe(F.col("_segment"))).withColumn("f1", f1).groupBy("_segment").agg(F.max_by("score", F.struct("f1", -F.col("score"))).alias("threshold"), F.max("f1").alias("f1"))
    hit = F.col("score") >= F.col("threshold")
    held = holdout.join(best.hint("merge"), F.col(segment).eqNullSafe(F.col("_segment")), "left")
    rows = held.groupBy(segment).agg(F.first("threshold").alias("threshold"), F.first("f1").alias("f1"), F.count_if(hit).alias("alerts"), F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(F.col("label") == 1).alias("positives"))
    rows = stored(rows)
    pooled = rows.agg(*[F.sum(c).alias(c) for c in ("alerts", "tp", "positives")])
    f1 = F.round(2 * F.col("tp") / F.nullif(F.col("alerts") + F.col("positives"), F.lit(0)), 9)
    none = F.lit(None).cast(rows.schema[segment].dataType).alias(segment)
    return rows.unionByName(pooled.select(none, F.lit(None).cast("double").alias("threshold"), f1.alias("f1"), "alerts", "tp", "positives"))


def threshold_for_recall(sweep: DataFrame, target: float) -> DataFrame:
    """The threshold whose recall is nearest at or above target, else nearest below."""
    key = F.struct((F.col("recall") < target).cast("int").alias("below"), F.round(F.abs(F.col("recall") - target), 9).alias("off"), "threshold")
    return sweep.agg(F.min_by("threshold", key).alias("threshold"), F.min_by("recall", key).alias("recall"))


def quantile_grid(scores: DataFrame, at: list[float]) -> DataFrame:
    """(threshold): the quantiles of ``score``, interpolated between neighbours in the order of all rows; null scores do not count.

    Rows are numbered in range partitions and only those at the wanted places are kept, so nothing is gathered.
    """
    some = stored(scores.filter("score is not null").select("score"))
    n = some.count()
    if not n:
        return some.select(F.col("score").alias("threshold"))
    ranked = global_row_number(some, [F.col("score")], "_n")
    exact = [q * (n - 1) for q in at]
    wanted = [(i, int(x) + k + 1, (1 - x % 1) if k == 0 else x % 1) for i, x in enumerate(exact) for k in (0, 1) if int(x) + k < n]
    places = scores.sparkSession.createDataFrame(wanted, "i int, _n int, part double")
    return ranked.join(F.broadcast(places), "_n").groupBy("i").agg(F.sum(F.col("score") * F.col("part")).alias("threshold")).select(F.round("threshold", 9).alias("threshold")).distinct()


def sweep_at(scores: DataFrame, grid: DataFrame) -> DataFrame:
    """(threshold, alerts, tp, recall) of scores(score, label) at each threshold of a grid, or at every distinct score without one.

    Counts come from one descending running sum over distinct scores and thresholds, not from rows times thresholds.
    """
    per = scores.groupBy("score").agg(F.count(F.lit(1)).alias("a"), F.count_if(F.expr("label = 1")).alias("p"))
    if grid is not None:
        zero = F.lit(0).cast("long")
        per = per.select("score", "a", "p", F.lit(0).alias("mark")).unionByName(grid.select(F.col("threshold").alias("score"), zero.alias("a"), zero.alias("p"), F.lit(1).alias("mark")))
        per = per.groupBy("score").agg(F.sum("a").alias("a"), F.sum("p").alias("p"), F.max("mark").alias("mark"))
    else:
        per = per.withColumn("mark", F.lit(1))
    per = stored(per)
    total = per.agg(F.sum("p")).first()[0]
    run = running_sums(per, [F.desc("score")], {"alerts": "a", "tp": "p"}).filter("mark = 1")
    return run.select(F.col("score").alias("threshold"), "alerts", "tp", (F.col("tp") / F.lit(float(total) if total else None)).alias("recall"))


def dev_then_test(rows: DataFrame, thresholds: list[float] | DataFrame | None, target: float) -> DataFrame:
    """rows(split, score, label): the threshold chosen once on dev for the target recall, and its metrics on test.

    thresholds: a list, a table like quantile_grid's, or None for every distinct dev score.
    """
    grid = rows.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double").distinct() if isinstance(thresholds, list) else thresholds
    chosen = stored(threshold_for_recall(sweep_at(rows.filter("split = 'dev'"), grid).filter("recall is not null"), target).select("threshold"))
    test = rows.filter("split = 'test'").crossJoin(F.broadcast(chosen))
    return test.groupBy("threshold").agg(F.count_if(F.expr("score >= threshold")).alias("alerts"), F.count_if(F.expr("score >= threshold and label = 1")).alias("tp"), F.count_if(F.expr("label = 1")).alias("positives"))


def ensemble_or(a: DataFrame, b: DataFrame, truth: DataFrame) -> DataFrame:
    """a(id), b(id), truth(id, label): caught, recall and precision of each and of both."""
    j = truth.join(a.select("id").distinct().withColumn("a", F.lit(True)), "id", "left").join(b.select("id").distinct().withColumn("b", F.lit(True)), "id", "left").fillna(False, ["a", "b"])
    long = j.select("label", F.explode(F.array(F.struct(F.lit("a").alias("who"), F.col("a").alias("hit")), F.struct(F.lit("b").alias("who"), F.col("b").alias("hit")), F.struct(F.lit("either").alias("who"), (F.col("a") | F.col("b")).alias("hit")))).alias("x")).select("label", "x.*")
    return long.groupBy("who").agg(F.count_if(F.expr("hit")).alias("alerts"), F.count_if(F.expr("hit and label = 1")).alias("tp"), (F.count_if(F.expr("hit and label = 1")) / F.nullif(F.count_if(F.expr("label = 1")), F.lit(0))).alias("recall"))


def isolated_positives(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Positives without a positive neighbour."""
    p = labels.filter("label = 1").select("id")
    ways = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = ways.join(p.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return p.join(near, "id", "left_anti")
