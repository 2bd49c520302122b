"""Training, search, importance and what-if scoring with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel, NaiveBayes, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.operators.nearest import nearest_rows
from tablemill.operators.ordered import RANGE_ROWS, positions
from tablemill.operators.scaling import _hash32, uniform_of
from tablemill.plans.prepare import SEPARATOR, q
from tablemill.session import stage


def assemble(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Adds ``features`` (vector) and ``label`` (double)."""
    renamed = df.select("*", *[q(c).cast("double").alias(f"__f{i}") for i, c in enumerate(features)])
    made = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(features))], outputCol="features").transform(renamed)
    return made.drop(*[f"__f{i}" for i in range(len(features))]).withColumn("label", q(label).cast("double"))


# ---- oversampling ------------------------------------------------------------------------

def oversample_minority(df: DataFrame, key: str, label: str, features: Sequence[str], seed: int, neighbours: int = 5) -> DataFrame:
    """New minority rows until both classes are equally large: key, neighbour, copy, weight, features.

    Each new row lies between a minority row and one of its ``neighbours`` nearest minority rows, by
    Euclidean distance over all features (ties to the smaller key).  Rows with an unknown feature take no
    part.  Rows in key order share the new ones evenly, the first of them one more; neighbour and weight
    are fixed by key, copy and seed.
    """
    complete = F.lit(True)
    for f in features:
        complete = complete & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    counts = df.filter(complete).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    minority = 1 if counts["p"] < counts["n"] else 0
    small, large = min(counts["p"], counts["n"]), max(counts["p"], counts["n"])
    if small < 2:
        raise ValueError("the smaller class needs two rows at least")
    rows = stage(positions(df.filter(complete & (F.col(label) == minority)).select(key, *features), [F.col(key)], on=key), "minority")
    every, rest = divmod(large - small, small)
    copies = F.lit(every) + F.when(F.col("pos") <= rest, 1).otherwise(0)
    near = nearest_rows(rows, key, features, neighbours).select(key, "rank", "neighbour")
    # a number fixed by key and copy picks among the neighbours that exist: each pair lists the copies that pick it
    named = lambda copy: F.concat_ws("/", F.col(key).cast("string"), copy.cast("string"))
    picks = lambda copy: _hash32(named(copy), seed) % min(small - 1, neighbours) + 1 == F.col("rank")
    asked = rows.withColumn("copies", copies).filter("copies > 0").join(near, key)
    made = asked.withColumn("copy", F.explode(F.filter(F.sequence(F.lit(1), F.col("copies")), picks)))
    made = made.withColumn("weight", uniform_of(named(F.col("copy")), seed + 1))
    other = rows.select(F.col(key).alias("neighbour"), *[F.col(f).alias(f"__{f}") for f in features])
    return made.join(other, "neighbour").select(key, "neighbour", "copy", "weight", *[
        (F.col(f).cast("double") + F.col("weight") * (F.col(f"__{f}").cast("double") - F.col(f).cast("double"))).alias(f) for f in features])


# ---- search ------------------------------------------------------------------------------

METRICS = ("roc_auc", "accuracy", "f1", "precision", "recall")


def _evaluator(metric: str):
    if metric == "roc_auc":
        return BinaryClassificationEvaluator(metricName="areaUnderROC")
    name = {"precision": "precisionByLabel", "recall": "recallByLabel"}.get(metric, metric)
    evaluator = MulticlassClassificationEvaluator(metricName=name)
    return evaluator.setMetricLabel(1.0) if metric in ("precision", "recall") else evaluator


def _cross_validate(df: DataFrame, estimator, grid, metric: str, folds: int, fold_column: str, parallelism: int):
    search = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=_evaluator(metric), numFolds=folds,
                            foldCol=fold_column, parallelism=parallelism)
    return search.fit(df)


def with_folds(df: DataFrame, key: str, folds: int, seed: int) -> DataFrame:
    """Fold number fixed by key and seed."""
    return df.withColumn("fold", (_hash32(F.col(key), seed) % folds).cast("int"))


def search_models(df: DataFrame, key: str, metric: str = "roc_auc", folds: int = 5, seed: int = 11, parallelism: int = 4) -> tuple[DataFrame, object]:
    """Cross-validated comparison of four model kinds on ``features``/``label``: (table, best model)."""
    logistic, tree, forest, bayes = (LogisticRegression(maxIter=20), DecisionTreeClassifier(seed=seed),
                                     RandomForestClassifier(seed=seed, numTrees=20), NaiveBayes(modelType="gaussian"))
    kinds = [
        ("LogisticRegression", logistic, ParamGridBuilder().addGrid(logistic.regParam, [0.0, 0.1]).build()),
        ("DecisionTree", tree, ParamGridBuilder().addGrid(tree.maxDepth, [3, 5]).build()),
        ("RandomForest", forest, ParamGridBuilder().addGrid(forest.maxDepth, [4]).build()),
        ("NaiveBayes", bayes, ParamGridBuilder().addGrid(bayes.smoothing, [1.0]).build())]
    data = with_folds(df, key, folds, seed).select("features", "label", "fold").cache()
    rows, best, best_score = [], None, None
    for name, estimator, grid in kinds:
        found = _cross_validate(data, estimator, grid, metric, folds, "fold", parallelism)
        for params, score in zip(grid, found.avgMetrics):
            rows.append((name, ", ".join(f"{p.name}={v}" for p, v in params.items()), metric, float(score)))
            if best_score is None or score > best_score:
                best, best_score = found.bestModel, score
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "model string, params string, metric string, score double"), best


def svm_grid(df: DataFrame, key: str, costs: Sequence[float] = (0.1, 1.0, 10.0, 100.0), folds: int = 5, seed: int = 11) -> DataFrame:
    """Linear support vector machine over a grid of costs (inverse regularisation), refitted at the best."""
    svm = LinearSVC(maxIter=20)
    data = with_folds(df, key, folds, seed).select("features", "label", "fold").cache()
    grid = ParamGridBuilder().addGrid(svm.regParam, [1 / c for c in costs]).build()
    found = _cross_validate(data, svm, grid, "accuracy", folds, "fold", 4)
    best = found.avgMetrics.index(max(found.avgMetrics))
    data.unpersist()
    return df.sparkSession.createDataFrame(
        [(float(c), float(s), i == best) for i, (c, s) in enumerate(zip(costs, found.avgMetrics))], "cost double, accuracy double, best boolean")


# ---- scoring and importance --------------------------------------------------------------

def score(model, df: DataFrame) -> DataFrame:
    """Adds ``prediction`` (int) and ``score``, the probability of the positive class."""
    scored = model.transform(df)
    return scored.withColumn("score", vector_to_array("probability")[1]).withColumn("prediction", F.col("prediction").cast("int"))


@dataclass(frozen=True)
class LinearRule:
    """Positive where the weighted sum of the features exceeds ``threshold``."""

    weights: tuple[float, ...]
    intercept: float = 0.0
    threshold: float = 0.0

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return rows @ np.asarray(self.weights) + self.intercept > self.threshold


def linear_rule(model) -> LinearRule | None:
    """The decision of a fitted two-class linear model; None for other kinds."""
    if isinstance(model, LinearSVCModel):
        return LinearRule(tuple(model.coefficients.toArray().tolist()), model.intercept, model.getThreshold())
    if isinstance(model, LogisticRegressionModel) and model.coefficientMatrix.numRows == 1 and 0 < model.getThreshold() < 1:
        share = model.getThreshold()
        return LinearRule(tuple(model.coefficients.toArray().tolist()), model.intercept, math.log(share / (1 - share)))
    return None


def _exchanges(rule: LinearRule, width: int):
    """Arrow batches of (label, x, other) to rows (j, hits, n): one column is exchanged at a time, -1 for none."""

    def counted(batches):
        hits, n = np.zeros(width + 1, dtype=np.int64), 0
        for batch in batches:
            x, other = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).copy() for c in ("x", "other"))
            label = batch.column("label").to_numpy(zero_copy_only=False) == 1
            n += len(label)
            hits[0] += (rule(x) == label).sum()
            for j in range(width):
                own = x[:, j].copy()
                x[:, j] = other[:, j]
                hits[j + 1] += (rule(x) == label).sum()
                x[:, j] = own
        yield pa.RecordBatch.from_pydict({"j": np.arange(-1, width, dtype=np.int32), "hits": hits, "n": np.full(width + 1, n, dtype=np.int64)})

    return counted


def next_in_turn(base: DataFrame, key: str, seed: int, repeats: int) -> DataFrame:
    """Every row of (key, label, x) with the ``x`` of its successor, as ``other``, in ``repeats`` orders fixed by hashes.

    The orders are rings: the last row meets the first.  Hashes spread evenly, so equal stretches of them are
    cells of about equal size; a cell's last row takes the first row of the next cell.  Rows move once a turn.
    """
    cells = max(1, -(-base.count() // RANGE_ROWS))
    turns = F.explode(F.array(*[F.struct(F.lit(r).alias("turn"), _hash32(F.col(key), seed + r).alias("h")) for r in range(repeats)]))
    dealt = base.withColumn("t", turns).select(
        key, "label", "x", "t.turn", "t.h", F.floor(F.col("t.h") * cells / 2**32).cast("int").alias("cell"))
    by_cell = Window.partitionBy("turn").orderBy("cell")
    whole = by_cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = dealt.groupBy("turn", "cell").agg(F.min_by("x", F.struct("h", key)).alias("head"))
    heads = heads.select("turn", "cell", F.coalesce(F.lead("head").over(by_cell), F.first("head").over(whole)).alias("head"))
    follows = F.lead("x").over(Window.partitionBy("turn", "cell").orderBy("h", key))
    return dealt.withColumn("follows", follows).join(heads, ["turn", "cell"]).select(
        "turn", key, "label", "x", F.coalesce("follows", "head").alias("other"))


def permutation_importance(model, df: DataFrame, key: str, features: Sequence[str], seed: int, repeats: int = 5) -> DataFrame:
    """Mean accuracy lost when one feature is taken from another row: feature, weight, falling.

    The other row is the next one in ``repeats`` orders fixed by hashes.  ``model`` is a LinearRule or a fitted
    model.  Linear decisions are made batch by batch, one column exchanged at a time, and a task gives counts
    only; other models score copies of the rows inside the task.  Equal keys are equal rows of the order;
    an empty table gives no features.
    """
    base = stage(df.select(key, "label", vector_to_array("features").alias("x")), "importance")
    matched = next_in_turn(base, key, seed, repeats).select("label", "x", "other")
    rule = model if isinstance(model, LinearRule) else linear_rule(model)
    if rule is not None:
        counted = matched.mapInArrow(_exchanges(rule, len(features)), "j int, hits long, n long")
    else:
        swapped = matched.withColumn("j", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1)))).withColumn(
            "features", array_to_vector(F.transform("x", lambda v, i: F.when(i == F.col("j"), F.get("other", i)).otherwise(v))))
        counted = model.transform(swapped.select("j", "label", "features")).select(
            "j", (F.col("prediction") == F.col("label")).cast("long").alias("hits"), F.lit(1).cast("long").alias("n"))
    right = stage(counted.groupBy("j").agg(F.try_divide(F.sum("hits"), F.sum("n")).alias("accuracy")), "importance-right")
    names = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("j") + 1)
    whole = right.filter("j = -1").select("accuracy").scalar()
    return right.filter("j >= 0 and accuracy is not null").select(names.alias("feature"), (whole - F.col("accuracy")).alias("weight")).orderBy(F.desc("weight"), "feature")


def parent_importance(importance: DataFrame, memory: dict[str, list[str]]) -> DataFrame:
    """Importance per column before dummy coding: the best child counts."""
    pairs = {c: p for p, children in memory.items() for c in children}
    if pairs:
        mapping = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
        parent = F.coalesce(F.try_element_at(mapping, F.col("feature")), F.col("feature"))
    else:
        parent = F.col("feature")
    return importance.groupBy(parent.alias("feature")).agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "feature")


def tree_importance(df: DataFrame, features: Sequence[str], seed: int = 11, top: int = 6) -> DataFrame:
    model = RandomForestClassifier(seed=seed, numTrees=20).fit(df)
    rows = [(f, float(w)) for f, w in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


# Wording of the sentences on weights.
FIRST_SENTENCE = "The strongest predictor is {feature}"
NEXT_SENTENCE = "The {place} strongest predictor is {feature} with a weight {ratio:.2f}% of {first}"
PLACES = ("second", "third")


def weight_sentences(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Strongest three positive and negative logistic weights with their share of the strongest.

    The published text prints the raw ratio as a percentage and mixes up the rows on the negative
    side; here each ratio is weight over first weight, in percent.
    """
    model = LogisticRegression(maxIter=50, standardization=True).fit(df)
    weights = sorted(((f, float(w)) for f, w in zip(features, model.coefficients.toArray())), key=lambda r: (-r[1], r[0]))
    rows = []
    for side, chosen in (("positive", weights[:3]), ("negative", weights[::-1][:3])):
        first = chosen[0]
        for place, (feature, weight) in enumerate(chosen):
            ratio = 100 * weight / first[1] if first[1] else 0.0
            text = (FIRST_SENTENCE.format(feature=feature) if place == 0 else
                    NEXT_SENTENCE.format(place=PLACES[place - 1], feature=feature, ratio=ratio, first=first[0]))
            rows.append((side, place + 1, feature, weight, ratio, text))
    return df.sparkSession.createDataFrame(rows, "side string, place int, feature string, weight double, ratio double, sentence string")


# ---- feature limits and what-if rows -----------------------------------------------------

def feature_limits(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Minimum and maximum per feature, one row each."""
    row = df.agg(*[F.struct(F.min(q(f)).cast("double").alias("min"), F.max(q(f)).cast("double").alias("max")).alias(f"s{i}") for i, f in enumerate(features)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"s{i}.min").alias("min"), F.col(f"s{i}.max").alias("max"))
                                          for i, f in enumerate(features)])).alias("r")).select("r.*")


def parent_limits(limits: DataFrame, memory: dict[str, list[str]]) -> DataFrame:
    """Limits per column before dummy coding; parents of dummy columns have none."""
    children = [c for cs in memory.values() for c in cs]
    plain = limits.filter(~F.col("feature").isin(children)) if children else limits
    if not memory:
        return plain
    parents = limits.sparkSession.createDataFrame([(p,) for p in memory], "feature string")
    return plain.unionByName(parents.select("feature", F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max")))


def apply_scenarios(base: DataFrame, scenarios: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Base row with the values each scenario replaces; ``scenarios`` is (scenario, column, value) as text."""
    wide = scenarios.groupBy("scenario").pivot("column", list(columns)).agg(F.max("value"))
    filled = {c: F.coalesce(F.col(c).try_cast(kind), base.select(c).scalar().cast(kind)) for c, kind in columns.items()}
    return wide.select("scenario", *[e.alias(c) for c, e in filled.items()])


def expand_dummies(df: DataFrame, memory: dict[str, list[str]]) -> DataFrame:
    """Replace parents by their 0/1 columns, as when the model was trained."""
    made = [F.when(q(p).cast("string").eqNullSafe(F.lit(c.removeprefix(p + SEPARATOR))), 1).otherwise(0).alias(c) for p, cs in memory.items() for c in cs]
    return df.select(*[q(c) for c in df.columns if c not in memory], *made)


def flag_outside(rows: DataFrame, limits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_outside``: the value lies beyond what the training rows held."""
    bounds = limits.groupBy().agg(*[x for c in columns for x in (
        F.max(F.when(F.col("feature") == c, F.col("min"))).alias(f"{c}|min"), F.max(F.when(F.col("feature") == c, F.col("max"))).alias(f"{c}|max"))])
    return rows.withColumns({f"{c}_outside": ~F.col(c).between(bounds.select(q(f"{c}|min")).scalar(), bounds.select(q(f"{c}|max")).scalar()) for c in columns})
