"""Quality scores by regularised quadratic discriminant analysis.

Each class has a mean and a shrunken covariance of transformed document
statistics; a document's score is the logistic of the difference of its two
Mahalanobis log densities, computed with one Cholesky factor for each class.

Statistics come from one pass over whole texts inside Arrow batches. Moments
of all labelled training rows are added up by Spark: what reaches the driver
is a table of fixed size, whatever the number of documents or labels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

FEATURES = (
    "chars", "words", "word_length", "upper", "digits", "marks", "shouts", "stops",
    "lines", "foreign", "distinct", "top_word", "line_repeat", "pipes",
)


def _set(chars: bytes) -> np.ndarray:
    on = np.zeros(256)
    on[list(chars)] = 1
    return on


_CLASSES = np.stack(
    [
        _set(bytes(range(65, 91))),
        _set(bytes(range(97, 123))),
        _set(b"0123456789"),
        _set(b"#*$%&<>{}[]=~^_\\"),
        _set(b"!?"),
        _set(b".,;:"),
        _set(b"\n"),
        _set(bytes(range(128, 256))),
        _set(b"|"),
        _set(bytes(range(128, 192))),
    ],
    axis=1,
)


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of a whole text; an empty one has zeros."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    words = data.split()
    if not words:
        return np.zeros(len(FEATURES), np.float32)
    upper, lower, digits, marks, shouts, stops, breaks, high, pipes, inner = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES
    chars, n = len(data) - inner, len(words)
    counts = Counter(words)
    lines = data.split(b"\n")
    root = lambda part: np.sqrt(part / chars)
    return np.array(
        [
            np.log1p(chars),
            np.log1p(n),
            np.log((chars - n + 1) / n),
            np.sqrt(upper / max(1.0, upper + lower)),
            root(digits),
            root(marks),
            root(shouts),
            root(stops),
            np.log1p(breaks),
            root(high - inner),
            np.log(len(counts) / n) / np.log(n + 2),
            np.sqrt(max(counts.values()) / n),
            np.sqrt(1 - len(set(lines)) / len(lines)),
            root(pipes),
        ],
        np.float32,
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t.as_py()) for t in batch.column(1)]
        flat = pa.array(np.concatenate(rows) if rows else np.empty(0, np.float32))
        size = len(FEATURES)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "stats"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(quality, stats) to the sums of 1, x and x x' for each class."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1).astype(float)
        for label in np.unique(y):
            z = np.column_stack([np.ones(int((y == label).sum())), x[y == label]])
            total[int(label)] = total.get(int(label), 0) + z.T @ z
    for label, m in total.items():
        n = m.size
        cols = [pa.array([label] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(m.ravel())]
        yield pa.RecordBatch.from_arrays(cols, names=["quality", "place", "total"])


@dataclass
class Discriminant:
    """Two Gaussians; ``factors`` are the Cholesky factors of their covariances."""

    means: list
    factors: list
    offset: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        part = []
        for mean, low in zip(self.means, self.factors):
            z = np.linalg.solve(low, (x - mean).T)
            part.append(-0.5 * (z * z).sum(0) - np.log(np.diag(low)).sum())
        margin = (part[1] - part[0] + self.offset) / self.scale
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fitted(sums: dict[int, np.ndarray], shrinkage: float = 0.1, ridge: float = 1e-3, scale: float = 4.0) -> Discriminant | None:
    """The discriminant of the classes 0 and 1; None unless both have rows.

    A class covariance is drawn by ``shrinkage`` towards the diagonal of the
    pooled one, and every variance grows by ``ridge``, so that classes of few
    or equal rows have a factor too. ``scale`` divides the log odds: the
    statistics are dependent, and the raw odds are too sure.
    """
    if not all(label in sums and sums[label][0, 0] > 0 for label in (0, 1)):
        return None
    means, spreads, sizes = [], [], []
    for label in (0, 1):
        m, n = sums[label], sums[label][0, 0]
        means.append(m[0, 1:] / n)
        spreads.append(m[1:, 1:] / n - np.outer(means[-1], means[-1]))
        sizes.append(n)
    pooled = np.diag(np.diag(sum(s * n for s, n in zip(spreads, sizes)) / sum(sizes)))
    eye = ridge * np.eye(len(pooled))
    factors = [np.linalg.cholesky((1 - shrinkage) * s + shrinkage * pooled + eye) for s in spreads]
    return Discriminant(means, factors, float(np.log(sizes[1] / sizes[0])), scale)


def _scored(model: Discriminant | None, default: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
            score = model.score(x) if model else np.full(batch.num_rows, default)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, at: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Rows whose crc32(doc_id) mod ``folds`` is ``held_out`` are not learnt
    from. Empty and null texts have a score like others (their statistics are
    zeros). A null doc_id counts as empty text in the fold, and has no label.
    Labels that are null are left out; a doc_id that is labelled or listed
    several times counts as often. Without labels of both classes every score
    is the share of class 1 (0.5 without any). Very long texts are measured
    whole; other columns of docs and labels are left aside, so their names
    can't clash. An empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    stats = written(docs.mapInArrow(_measured, "doc_id long, stats array<float>"), "statistics")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds
    known = labels.filter("quality IN (0, 1)").select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int"))
    train = stats.filter(fold != held_out).join(known, F.col("doc_id") == F.col("labelled")).select("quality", "stats")
    sums = train.mapInArrow(_moments, "quality int, place int, total double")
    size = len(FEATURES) + 1
    found = {label: np.zeros(size * size) for label in (0, 1)}
    for r in sums.groupBy("quality", "place").agg(F.sum("total").alias("total")).collect():
        found[r["quality"]][r["place"]] = r["total"]
    found = {label: m.reshape(size, size) for label, m in found.items()}
    n0, n1 = found[0][0, 0], found[1][0, 0]
    out = stats.mapInArrow(_scored(fitted(found), n1 / (n0 + n1) if n0 + n1 else 0.5), "doc_id long, score double")
    return out.select(
        "doc_id", (fold == held_out).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted")
    )
