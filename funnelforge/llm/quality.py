"""Quality scores by regularised quadratic discriminant analysis.

Each text gives a vector of transformed statistics. Per label, their mean and
covariance come from one aggregation; covariances are shrunk towards the pooled one
and its diagonal. A score is the logistic of the difference of the two Mahalanobis
log-densities, with each class's Cholesky factor inverted once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelforge.llm.words import sliced, small_batches
from funnelforge.session import stored

#: The statistics of a text, in order.
NAMES = (
    "log_words", "log_lines", "word_length", "word_length_spread", "upper", "digits", "signs", "odd_signs", "marks",
    "distinct", "top_word", "repeated_next", "line_repeats", "short_words", "ended_lines", "bars", "title_words", "log_line_words",
)

_upper = bytes(range(0x41, 0x5B))
_digits = b"0123456789"
_letters = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_spaces = b" \t\n\r\x0b\x0c"
_marks = b".,;:?!'\"()-"
_ends = re.compile(rb"[.?!]\s*$", re.M)


def _part(x: float, of: float) -> float:
    """A share, spread out near 0 and 1."""
    p = (x + 0.5) / (of + 1.0)
    return math.log(p / (1.0 - p)) if 0 < p < 1 else 0.0


def statistics(text: bytes) -> list[float]:
    """The vector of NAMES; the empty text has one too."""
    words = text.split()
    n, size = len(words), len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    solid = size - (size - len(text.translate(None, _spaces)))
    letters = size - len(text.translate(None, _letters))
    digits = size - len(text.translate(None, _digits))
    marks = size - len(text.translate(None, _marks))
    return [
        math.log1p(n),
        math.log1p(len(lines)),
        math.log1p(lengths.mean()) if n else 0.0,
        math.log1p(lengths.std()) if n else 0.0,
        _part(size - len(text.translate(None, _upper)), letters),
        _part(digits, solid),
        _part(solid - letters - digits, solid),
        _part(max(0, solid - letters - digits - marks), solid),
        _part(text.count(b"!"), n),
        _part(len(counts), n),
        _part(max(counts.values()) if n else 0, n),
        _part(sum(map(bytes.__eq__, words, words[1:])), n),
        _part(len(lines) - len(set(lines)), len(lines)),
        _part(float((lengths <= 2).sum()), n),
        _part(len(_ends.findall(text)), len(lines)),
        _part(text.count(b"|"), n),
        _part(sum(map(bytes.istitle, words)), n),
        math.log1p(n / max(1, len(lines))),
    ]


class Discriminant:
    """Two shrunk Gaussians over standardised statistics."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float, ridge: float):
        d = sums.shape[1]
        means = sums / np.maximum(n, 1)[:, None]
        scatter = products - n[:, None, None] * np.einsum("ci,cj->cij", means, means)
        total = n.sum()
        self.known = bool((n > 0).all())
        self.even = float((n[1] + 1) / (total + 2)) if total else 0.5
        pooled = scatter.sum(0) / max(total - 2, 1)
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        pooled = pooled / np.outer(self.scale, self.scale)
        # Small classes lean on the pooled covariance; both lean on its diagonal.
        self.factors, self.means = [], means / self.scale
        for c in range(2):
            own = scatter[c] / max(n[c] - 1, 1) / np.outer(self.scale, self.scale)
            lean = min(1.0, shrink + d / (d + max(n[c], 0)))
            mixed = (1 - lean) * own + lean * pooled
            mixed = (1 - ridge) * mixed + ridge * np.diag(np.maximum(np.diag(mixed), 0.05)) + 1e-3 * np.eye(d)
            low = np.linalg.cholesky(mixed)
            self.factors.append((np.linalg.inv(low), 2 * np.log(np.diag(low)).sum()))
        self.prior = math.log((n[1] + 1) / (n[0] + 1))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), self.even)
        logs = []
        for (inverse, log_det), mean in zip(self.factors, self.means, strict=True):
            away = (x / self.scale - mean) @ inverse.T
            logs.append(-0.5 * ((away**2).sum(1) + log_det))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.prior, -30, 30)))


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, stats array<double>) per row; null texts are empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(rows, 1):
            found = [statistics(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, pa.list_(pa.float64()))], ["id", "stats"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(measure, f"id {kind}, stats array<double>")


def fit(rows: DataFrame, shrink: float = 0.1, ridge: float = 0.1) -> Discriminant:
    """A discriminant of ``rows`` (stats, label 0 or 1); each task sends one row a label."""
    d = len(NAMES)

    def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in frames:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                y = np.array(b.column(1).to_pylist())
                for c in range(2):
                    own = x[y == c]
                    n[c] += len(own)
                    sums[c] += own.sum(0)
                    products[c] += own.T @ own
        packed = np.concatenate([n, sums.ravel(), products.ravel()])
        yield pa.record_batch([pa.array(np.arange(len(packed)), pa.int32()), pa.array(packed, pa.float64())], ["k", "v"])

    total = rows.select("stats", "label").mapInArrow(add, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    packed = np.zeros(2 + 2 * d + 2 * d * d)
    packed[total["k"].to_numpy(int)] = total["v"]
    return Discriminant(packed[:2], packed[2 : 2 + 2 * d].reshape(2, d), packed[2 + 2 * d :].reshape(2, d, d), shrink, ridge)


def held_out(id_col: str, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id's text, modulo ``folds``, is ``fold``; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    Labels other than 0 and 1 and null ids teach nothing; an id with several labels
    teaches each. Without rows of both labels every score is the share of 1 among what
    there is, (n + 1) / (n + 2) smoothed. Null texts are scored as empty ones. Every
    labelled row that is not held out is learned from. Equal texts get equal scores, and
    0.5 is predicted 1; texts of any length count whole; an empty table gives no rows; other
    columns are not read.
    """
    with small_batches(docs.sparkSession):
        rows = stored(with_statistics(docs, id_col, text_col), "quality-statistics")
    value = F.col(label_col).cast("string").try_cast("double")
    known = labels.select(F.col(id_col).alias("id"), F.when(value.isin(0.0, 1.0), value).cast("int").alias("label")).where("label is not null")
    model = fit(rows.where(~held_out("id")).join(known, "id"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.record_batch([b.column(0), pa.array(held.value.scores(x), pa.float64())], ["id", "score"])

    found = rows.mapInArrow(score, f"id {kind}, score double")
    return found.select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
