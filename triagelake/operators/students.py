"""Students of a teacher's decisions, on pyspark.ml, and resumable scoring by a caller's function."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.metrics import dot
from triagelake.operators.evaluation import auroc, recall_at_budget


def prepared(rows: DataFrame, folds: int = 5) -> DataFrame:
    """rows (id, x array<double>, y boolean) with features, label, class-balancing weight and a fold by hash."""
    n = rows.agg(F.count("*").alias("n"), F.count_if("y").alias("p")).first()
    positive, negative = max(1, n["p"]), max(1, n["n"] - n["p"])
    weight = F.when(F.col("y"), n["n"] / (2 * positive)).otherwise(n["n"] / (2 * negative))
    return rows.select("id", array_to_vector("x").alias("raw"), F.col("y").cast("double").alias("label"), weight.alias("weight"), F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int").alias("fold"))


def balanced(rows: DataFrame) -> DataFrame:
    """All rows of the rarer class, and as large a share of the other by a hash of the id, so as many or nearly so."""
    n = rows.agg(F.count_if("y").alias("yes"), F.count_if(~F.col("y")).alias("no")).first()
    share = min(n["yes"], n["no"]) / max(n["yes"], n["no"], 1)
    rarer = F.col("y") if n["yes"] <= n["no"] else ~F.col("y")
    return rows.where(rarer | (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)))


def feature_sets(rows: DataFrame, text: str, image: str) -> DataFrame:
    """rows with the arrays t, i and it, the vectors of text, image and both one after the other; ``it`` is null where one
    of them is."""
    t, i = F.col(text).cast("array<double>"), F.col(image).cast("array<double>")
    return rows.withColumns({"t": t, "i": i, "it": F.concat(t, i)})


def best_candidate(candidates: DataFrame, least: float) -> DataFrame:
    """The one of (kind, model, balance, auroc, recall) with the highest AUROC, then recall, then the first by name, and
    ``stop``: whether its recall is below ``least``, so that none is good enough."""
    return candidates.orderBy(F.desc_nulls_last("auroc"), F.desc_nulls_last("recall"), "kind", "model", "balance").limit(1).withColumn("stop", F.coalesce(F.col("recall") < least, F.lit(True)))


def trained_candidates(rows: DataFrame, dev: Column, kinds: tuple[str, ...], budget: float, strengths: tuple[float, ...] = (0.01,), hidden: int = 16, rounds: int = 30) -> DataFrame:
    """(kind, model, balance, auroc, recall at the budget) on the rows of ``dev`` for students trained on the others: each
    of the feature columns ``kinds``, logistic or perceptron, balanced by weight or by leaving out rows of the more
    frequent class. (A perceptron has no weights of rows, so by weight it sees them as they are.)"""
    parts = []
    for kind in kinds:
        own = rows.select("id", F.col(kind).alias("x"), "y", dev.alias("dev")).where("x IS NOT NULL").persist()
        train, check = own.where("NOT dev"), own.where("dev")
        width = own.select(F.max(F.size("x"))).first()[0]
        for balance, learn in (("weight", train), ("undersample", balanced(train))):
            for model in ("logistic", "perceptron"):
                fitted = logistic_student(learn, strengths, min(5, 2 * len(strengths))).bestModel if model == "logistic" else perceptron_student(learn, width, hidden, rounds)[0]
                scored = scores(fitted, check).persist()
                found = auroc(scored).select("auroc").first()[0], recall_at_budget(scored, budget).select("recall").first()[0]
                parts.append((kind, model, balance, *found))
                scored.unpersist()
        own.unpersist()
    return rows.sparkSession.createDataFrame(parts, "kind string, model string, balance string, auroc double, recall double")


def logistic_student(rows: DataFrame, strengths=(0.001, 0.01, 0.1), folds: int = 5):
    """Standardised logistic regression, balanced by weight; the strength is chosen by cross-validated AUROC.

    Every step of a fit sends a gradient a task, so there are no more tasks than cores, however many files there are.
    """
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    model = LogisticRegression(weightCol="weight", standardization=False, maxIter=100)
    pipeline = Pipeline(stages=[scaler, model])
    grid = ParamGridBuilder().addGrid(model.regParam, list(strengths)).build()
    search = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), foldCol="fold", numFolds=folds)
    return search.fit(prepared(rows, folds).coalesce(rows.sparkSession.sparkContext.defaultParallelism))


def perceptron_student(rows: DataFrame, width: int, hidden: int = 16, rounds: int = 60, step: int = 5, patience: int = 3):
    """One hidden layer that stops early: (fitted pipeline, validation losses).

    A tenth of the rows, by a hash of the id, is not learnt from. Training goes on from the last weights, ``step`` rounds at
    a time; after ``patience`` of these without a lower loss on that tenth it ends, and the best weights are kept.
    """
    of = prepared(rows, 10).persist()
    train, check = of.where("fold <> 0"), of.where("fold = 0")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    train, check = scaler.transform(train).persist(), scaler.transform(check).persist()
    weights, best, losses = None, None, []
    while len(losses) * step < rounds:
        learner = MultilayerPerceptronClassifier(layers=[width, hidden, 2], maxIter=step, seed=1, initialWeights=weights)
        model = learner.fit(train)
        weights = model.weights
        losses.append(log_loss(model.transform(check)))
        if best is None or losses[-1] < min(losses[:-1]):
            best = model
        if len(losses) - 1 - losses.index(min(losses)) >= patience:
            break
    for frame in (of, train, check):
        frame.unpersist()
    return PipelineModel([scaler, best]), losses


def log_loss(scored: DataFrame) -> float:
    """Mean negative logarithm of the probability given to the right class; 0 without rows."""
    p = vector_to_array("probability")
    right = F.when(F.col("label") == 1, p[1]).otherwise(p[0])
    return scored.agg(F.coalesce(F.avg(-F.log(F.greatest(right, F.lit(1e-15)))), F.lit(0.0))).first()[0]


def scores(model, rows: DataFrame) -> DataFrame:
    """(id, y, score) by a fitted student."""
    p = vector_to_array("probability")[1]
    return model.transform(prepared(rows)).select("id", (F.col("label") == 1).alias("y"), p.alias("score"))


def score(vector: Column, weights: list[float], bias: float) -> Column:
    """Logistic score by frozen weights; a vector of another length is an error, never a silent score."""
    checked = F.when(F.size(vector) == len(weights), vector).otherwise(F.raise_error("vector length differs from the frozen weights").cast("array<float>"))
    return 1 / (1 + F.exp(-(dot(checked, F.array(*map(F.lit, weights))) + bias)))


def score_with(rows: DataFrame, done: DataFrame | None, judge: Callable[[str], float], tries: int = 2) -> DataFrame:
    """(id, value, error, seconds) for the rows (id, text) that ``done`` hasn't scored; a failing row becomes an error row."""
    rest = rows.join(done.select("id"), "id", "left_anti") if done is not None else rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["id"], batch["text"]):
                began, value, error = time.perf_counter(), None, None
                for _ in range(tries):
                    try:
                        value, error = float(judge(text)), None
                        break
                    except Exception as problem:  # the item fails, the batch goes on
                        error = type(problem).__name__
                out.append((key, value, error, time.perf_counter() - began))
            yield pd.DataFrame(out, columns=["id", "value", "error", "seconds"])

    return rest.select("id", "text").mapInPandas(run, "id long, value double, error string, seconds double")
