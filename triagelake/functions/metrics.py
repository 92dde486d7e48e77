"""Evaluation formulas as column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def confusion(gold: Column, predicted: Column) -> list[Column]:
    """Aggregates tp, fp, fn, tn, n."""
    return [
        F.count_if(gold & predicted).alias("tp"), F.count_if(~gold & predicted).alias("fp"),
        F.count_if(gold & ~predicted).alias("fn"), F.count_if(~gold & ~predicted).alias("tn"), F.count("*").alias("n"),
    ]


def rates() -> dict[str, Column]:
    """precision, recall, f1, accuracy, specificity from tp, fp, fn, tn, n; null without a denominator, F1 then 0."""
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.when((tp > 0), 2 * p * r / (p + r)).otherwise(0.0)
    return {"precision": p, "recall": r, "f1": f1, "accuracy": ratio(tp + tn, n), "specificity": ratio(tn, tn + fp)}


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95% score interval of a share k / n; null where n is 0."""
    p = ratio(k, n)
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - spread) / (1 + z * z / n), (centre + spread) / (1 + z * z / n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """L2-normalised array<double>; a zero vector stays zero."""
    of = lambda length: F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))
    return F.transform(F.array(F.sqrt(dot(a, a))), of)[0]  # so that the length is found once, not for each component
