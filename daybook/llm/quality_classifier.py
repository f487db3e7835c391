"""Operator 1: quality scores by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, table

FEATURES = (
    "log_words", "word_length", "unique_words", "upper", "digits", "symbols", "bars", "exclaims", "stops", "commas",
    "capital_words", "short_words", "line_words", "repeated_lines", "repeated_pairs",
)
#: Weight of the pooled covariance and of its diagonal in each class's covariance.
POOLED = 0.6
DIAGONAL = 0.1

_SYMBOLS = re.compile(r"[#*$%&<>@^~_=+\\{}\[\]]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGITS = re.compile(r"[0-9]")


def statistics(text: str | None) -> tuple[float, ...]:
    """The transformed statistics of one whole text: logs of counts and log-odds of shares, all finite."""
    text = text or ""
    words, n = text.split(), len(text)
    m = len(words)
    share = lambda k, of: float(np.log((k + 0.5) / (max(of - k, 0) + 0.5)))
    lines = [x for x in text.split("\n") if x.strip()]
    chars = sum(map(len, words))
    pairs = set(zip(words, words[1:], strict=False))
    return (
        float(np.log1p(m)),
        chars / m if m else 0.0,
        share(len(set(words)), m),
        share(len(_UPPER.findall(text)), chars),
        share(len(_DIGITS.findall(text)), chars),
        share(len(_SYMBOLS.findall(text)), chars),
        share(text.count("|"), chars),
        share(text.count("!"), chars),
        share(text.count("."), chars),
        share(text.count(","), chars),
        share(sum(w[0].isupper() for w in words), m),
        share(sum(len(w) < 4 for w in words), m),
        float(np.log1p(m / max(1, len(lines)))),
        share(len(lines) - len(set(lines)), len(lines)),
        share(max(0, m - 1 - len(pairs)), max(0, m - 1)),
    )


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id and FEATURES of every row; null text counts as empty.  No other column is read."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([statistics(t) for t in batch["t"]], columns=list(FEATURES), dtype=float)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    schema = f"doc_id {kind}, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select("doc_id", F.col(text_col).alias("t")).mapInPandas(scan, schema)


@dataclass(frozen=True)
class Model:
    """Per class its mean, the inverse of its covariance's Cholesky factor, and its log weight."""

    means: tuple[np.ndarray, ...]
    whiten: tuple[np.ndarray, ...]
    weights: tuple[float, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: the difference of Mahalanobis log densities, tempered by the dimension."""
        logs = [w - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, w in zip(self.means, self.whiten, self.weights, strict=True)]
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / np.sqrt(x.shape[1]), -30, 30)))


def fit(stats: DataFrame, labels: DataFrame, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Model | None:
    """The model from stats joined with labels(doc_id, quality); None if a class has under two rows.

    One aggregation gives each class's count, sums and products; only those two rows reach the driver.  A document labelled
    again counts once, one labelled both ways not at all; labels of other values or without a document are left out."""
    ids = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality")
    ids = ids.groupBy("doc_id").agg(F.min("quality").alias("__class"), F.max("quality").alias("__other")).where("__class = __other")
    both = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]
    sums = (
        stats.join(ids, "doc_id")
        .groupBy("__class")
        .agg(
            F.count("*").alias("n"),
            F.array(*(F.sum(a) for a in FEATURES)).alias("s"),
            F.array(*(F.sum(F.col(a) * F.col(b)) for a, b in both)).alias("p"),
        )
        .collect()
    )
    found = {r["__class"]: r for r in sums if r["n"] > 1}
    if len(found) < 2:
        return None
    d, upper = len(FEATURES), np.triu_indices(len(FEATURES))
    means, spreads, counts = [], [], []
    for k in (0, 1):
        n, mean = found[k]["n"], np.array(found[k]["s"]) / found[k]["n"]
        full = np.zeros((d, d))
        full[upper] = found[k]["p"]
        full = full + np.triu(full, 1).T
        means.append(mean)
        spreads.append(full / n - np.outer(mean, mean))
        counts.append(n)
    pool = sum(n * c for n, c in zip(counts, spreads, strict=True)) / sum(counts)
    scale = np.sqrt(np.maximum(np.diag(pool), 1e-6))
    floor = 1e-3 * np.diag(scale**2)
    whiten, weights = [], []
    for n, own in zip(counts, spreads, strict=True):
        mixed = (1 - pooled) * own + pooled * pool
        mixed = (1 - diagonal) * mixed + diagonal * np.diag(np.diag(pool)) + floor
        factor = np.linalg.cholesky(mixed)
        whiten.append(np.linalg.inv(factor))
        weights.append(float(np.log(n / sum(counts)) - np.log(np.diag(factor)).sum()))
    return Model(tuple(means), tuple(whiten), tuple(weights))


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted; 0.5 for all if there is no model."""
    kind = stats.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = np.full(len(batch), 0.5) if model is None else model.scores(batch[list(FEATURES)].to_numpy())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    return stats.mapInPandas(scan, f"doc_id {kind}, score double, predicted int")


def held_out() -> F.Column:
    """A third of the rows, by their id alone; rows without an id are not held out (and have no label)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs, learned from labels(doc_id, quality) of rows not held out.

    Null and empty texts have statistics of their own and so a score; repeated rows repeat; an empty table gives no rows;
    without two rows of either class every score is 0.5.  Other columns, whatever their names, are never read."""
    stats = settle(measured(docs))
    model = fit(stats.where(~held_out()), labels.where(~held_out()))
    return score(stats, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def query(spark, sf_dir: str) -> DataFrame:
    return op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
