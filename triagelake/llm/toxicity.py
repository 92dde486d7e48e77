"""Toxicity: a sparse linear classifier, regularised by counterfactual swaps of identity terms."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, crc_mod, give_back, quoted, table, tidy
from .labelled import binary_sample

#: At most so many labelled documents of each class are used; labelled rows are learnt from where the remainder isn't 0.
SAMPLE, FOLDS = 1500, 5
#: Groups of identity terms that a neutral text may mention; a swap within a group must not change a score.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "european", "american"),
    ("gay", "lesbian", "straight", "transgender"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "blind", "deaf", "elderly"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("juden", "christen", "muslime"), ("juifs", "musulmans"), ("judíos", "musulmanes"),
)
SWAP = {t: group[(i + 1) % len(group)] for group in IDENTITIES for i, t in enumerate(group)}
LETTERS = re.compile(r"[^\W\d_]+").findall


def features(chunk: str) -> tuple[str, ...]:
    """A chunk's words, and their beginnings, which inflected and composed forms share."""
    found: list[str] = []
    for word in LETTERS(chunk.lower()):
        found += (word, f"{word[:4]}~", f"{word[:5]}~~") if len(word) > 4 else (word,)
    return tuple(found)


def of_text(text: str | None) -> set[str]:
    return {f for chunk in set((text or "").split()) for f in features(chunk)}


def counterfactual(found: set[str], k: int) -> tuple[set[str], set[str]]:
    """Features that a swap of the text's identity terms removes and adds; a text without any has two put in, to swap."""
    terms = [t for t in SWAP if t in found] or [sorted(SWAP)[k % len(SWAP)]]
    of = lambda words: {f for w in words for f in features(w)}
    return of(terms), of(SWAP[t] for t in terms)


def sparse(rows: list, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of every known feature."""
    at = [(i, index[f]) for i, row in enumerate(rows) for f in row if f in index]
    return tuple(np.array(at, np.int64).reshape(-1, 2).T)


def telling(rows: list[set[str]], y: np.ndarray, least: float = 2.0) -> set[str]:
    """Features whose share of the texts differs between the classes by ``least`` standard errors or more."""
    by = [Counter(f for row, label in zip(rows, y) if label == k for f in row) for k in (0, 1)]
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    found = set()
    for f in by[0].keys() | by[1].keys():
        share = (by[0][f] + by[1][f]) / sum(n)
        error = math.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))
        if by[0][f] + by[1][f] > 2 and abs(by[1][f] / n[1] - by[0][f] / n[0]) >= least * error:
            found.add(f)
    return found


def calibrated(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of scores that fit the labels best (Platt), by damped Newton steps with a small ridge on the scale."""
    a, b = 1.0, 0.0
    x = np.stack([score, np.ones_like(score)], axis=1)
    weight = weight / weight.sum() * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ [a, b], -30, 30)))
        gradient = x.T @ (weight * (p - y)) + [0.5 * (a - 1), 0.01 * b]
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag([0.5, 0.01])
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = max(a - step[0], 0.1), b - step[1]
    return a, b


def fit(sample: list[tuple[str, int]], counts: dict[int, int], l1: float = 1e-3, swap: float = 4.0, rounds: int = 100) -> tuple[float, dict[str, float]]:
    """Bias and non-zero weights of a logistic model over the set of a text's features.

    Accelerated proximal descent on the class-balanced log loss, an L1 penalty, and ``swap`` times the mean squared
    change of the score when identity terms are swapped. Scale and bias are then calibrated on every fourth text, which
    the descent doesn't see, at the classes' true shares. With no sample, or one of a single class, the share
    decides; without any label nothing is called toxic.
    """
    positive, negative = counts.get(1, 0), counts.get(0, 0)
    prior = math.log((positive + 0.5) / (negative + 1.5))
    labels = np.array([label for _, label in sample], float)
    rest = np.arange(len(labels)) % 4 == 3
    y = labels[~rest]
    if not len(y) or y.min() == y.max():
        return prior, {}
    texts = [of_text(text) for text, _ in sample]
    rows = [row for row, out in zip(texts, rest) if not out]
    pairs = [counterfactual(row, i) for i, row in enumerate(rows)]
    index = {f: i for i, f in enumerate(sorted(telling(rows, y) | {f for p in pairs for side in p for f in side}))}
    row, column = sparse(rows, index)
    out, gone = sparse([p[0] for p in pairs], index), sparse([p[1] for p in pairs], index)
    swap_row, swap_column = np.concatenate([out[0], gone[0]]), np.concatenate([out[1], gone[1]])
    sign = np.repeat([-1.0, 1.0], [len(out[0]), len(gone[0])])
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    n, m = len(y), len(index)
    # a step per feature: the curvature that its own column allows
    size = np.bincount(row, minlength=n)
    step = 1 / (0.25 * np.bincount(column, weight[row] * size[row], m) + 2 * swap / n * np.bincount(swap_column, minlength=m) * 8 + 1e-4)
    w, bias, ahead, ahead_bias, speed = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(rounds):
        score = ahead_bias + np.bincount(row, ahead[column], n)
        error = weight * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y)
        moved = np.bincount(swap_row, sign * ahead[swap_column], n)
        gradient = np.bincount(column, error[row], m) + 2 * swap / n * np.bincount(swap_column, sign * moved[swap_row], m)
        new = ahead - step * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias = ahead_bias - 2.0 * error.sum()
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        ahead, ahead_bias = new + (speed - 1) / faster * (new - w), new_bias + (speed - 1) / faster * (new_bias - bias)
        w, bias, speed = new, new_bias, faster
    weights = {f: float(w[i]) for f, i in index.items() if w[i]}
    raw = np.array([bias + sum(weights.get(f, 0.0) for f in row) for row in texts])
    if len(set(labels[rest])) < 2:
        rest[:] = True
    share = {1: positive / max(1, (labels[rest] == 1).sum()), 0: negative / max(1, (labels[rest] == 0).sum())}
    scale, shift = calibrated(raw[rest], labels[rest], np.array([share[int(k)] for k in labels[rest]]))
    return float(scale * bias + shift), {f: float(scale * x) for f, x in weights.items()}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, dict[str, float]]:
    model = fit(*binary_sample(docs, labels, "toxic", crc_mod("doc_id", FOLDS) != 0, sample))
    give_back()
    return model


def scores(texts, bias: float, weights: dict[str, float], memo: Memo) -> list[float]:
    out = []
    for text in texts:
        hits: set[str] = set()
        for known in filter(None, map(memo.__getitem__, set((text or "").split()))):
            hits.update(known)
        total = bias + math.fsum(weights[f] for f in hits)
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))))
        memo.trim()
    return out


def with_score(docs: DataFrame, model: tuple[float, dict[str, float]], column: str = "toxicity") -> DataFrame:
    """docs with all its columns and ``column``, the score of the whole text (0 to 1); a column of that name is replaced.

    The set of distinct words decides, so neither length nor repetition of a text changes what a word adds. Null, empty
    and wordless texts get the score of the bias. Repeated rows score alike; an empty table stays empty.
    """
    rows = scored_rows(docs, model)
    return rows.select(*(F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns if c != column), F.col("score").alias(column))


def scored_rows(docs: DataFrame, model: tuple[float, dict[str, float]]) -> DataFrame:
    """(row, score): every row of docs as a struct, so that no name of its columns matters, and its score."""
    model = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"))

    def run(batches):
        bias, weights = model.value
        memo = Memo(lambda chunk: tuple(f for f in features(chunk) if f in weights))
        for batch in batches:
            found = scores((t.as_py() for t in batch["row"].field("text")), bias, weights, memo)
            yield pa.record_batch([batch["row"], pa.array(found, pa.float64())], ["row", "score"])

    return rows.mapInArrow(tidy(run), rows.select("row").schema.add("score", "double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = with_score(docs, train(docs, labels), "score")
    held_out = F.coalesce(crc_mod("doc_id", FOLDS) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, whose score is below one half.

    Null and empty texts are judged by the bias alone. Rows with a null id and repeated rows are judged by their text.
    Whatever other columns docs has stay as they are. Without labels of both classes every row stays.
    """
    kept = scored_rows(docs, train(docs, labels)).where("score < 0.5")
    return kept.select(*(F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns))
