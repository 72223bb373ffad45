"""Language identification in two steps: a family of languages first, then one language of the family.

Families are groups of languages whose mean vectors are close. The family is
the largest margin of one linear support vector machine for each; within it,
every pair of languages has a machine of its own, and the language with the
most support from its pairs wins.

Documents are vectors of hashed byte trigrams, bigrams and letters of whole
texts, made in Arrow batches and never shuffled. The machines are fitted on a
bounded sample of each language's labelled rows, one machine in each Spark
task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Length of a vector (a power of two).
SIZE = 4096
#: Labelled rows of all languages together, and of one, that the machines are fitted on.
MOST_ROWS, LANGUAGE_ROWS = 40_000, 1_500
#: Bytes of a text that are counted at once.
_PIECE = 1 << 20

#: ASCII letters in lower case, bytes of other letters as they are, all else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def vector(text: str | None) -> np.ndarray:
    """Square roots of the counts of the text's hashed byte n-grams, of length 1; zeros for a text without any."""
    data = b" " + b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()) + b" "
    counts = np.zeros(SIZE, np.int64)
    for start in range(0, len(data), _PIECE):
        b = np.frombuffer(data[start : start + _PIECE + 2], np.uint8).astype(np.uint32)
        # a piece owns the n-grams that begin in it
        own = min(_PIECE, len(data) - start)
        for n in (1, 2, 3):
            m = min(own, len(b) - n + 1)
            if m > 0:
                code = sum(b[k : k + m] << np.uint32(8 * k) for k in range(n)) + np.uint32(n << 24)
                counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - 12), minlength=SIZE)
    out = np.sqrt(counts)
    return (out / max(1e-12, np.sqrt((out * out).sum()))).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Weights (the last one is the bias) of a linear support vector machine for y in -1, 1, by dual coordinate descent.

    Classes weigh alike, however many rows each has.
    """
    x = np.column_stack([x, np.ones(len(x), x.dtype)]).astype(np.float32)
    most = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    w, alpha, norm = np.zeros(x.shape[1], np.float32), np.zeros(len(x)), (x * x).sum(1)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            now = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / norm[i], 0.0), most[i])
            if now != alpha[i]:
                w += np.float32((now - alpha[i]) * y[i]) * x[i]
                moved = max(moved, abs(now - alpha[i]))
                alpha[i] = now
        if moved < 1e-3:
            break
    return w


def families_of(means: dict[str, np.ndarray]) -> list[list[str]]:
    """Languages in ceil(sqrt(n)) families: the two families of the closest mean vectors are joined again and again."""
    groups = [[lang] for lang in sorted(means)]
    centre = lambda g: sum(means[lang] for lang in g) / len(g)
    while len(groups) > max(1, int(np.ceil(np.sqrt(len(means))))):
        c = np.array([centre(g) for g in groups])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = c @ c.T
        near[np.tril_indices(len(near))] = -2
        i, j = divmod(int(near.argmax()), len(near))
        groups[i] = sorted(groups[i] + groups.pop(j))
    return sorted(groups)


@dataclass
class Hierarchy:
    """Families of languages, the machine of each family, and that of each pair (the first language is its 1)."""

    families: list[list[str]]
    family: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each row of x, and the share of support that family and language have, between 0 and 1."""
        sure = lambda margin: 1 / (1 + np.exp(-np.clip(3 * margin, -50, 50)))
        part = sure(x @ self.family[:, :-1].T + self.family[:, -1]) if len(self.families) > 1 else np.ones((len(x), 1))
        # the largest share is that of the largest margin
        at, part = part.argmax(1), part / part.sum(1, keepdims=True)
        langs, score = np.empty(len(x), object), part[np.arange(len(x)), at]
        for k, group in enumerate(self.families):
            rows = np.flatnonzero(at == k)
            support = np.ones((len(rows), len(group))) if len(group) == 1 else np.zeros((len(rows), len(group)))
            for i, a in enumerate(group):
                for j in range(i + 1, len(group)):
                    w = self.pairs[a, group[j]]
                    first = sure(x[rows] @ w[:-1] + w[-1]) / (len(group) - 1)
                    support[:, i] += first
                    support[:, j] += 1 / (len(group) - 1) - first
            best = support.argmax(1)
            langs[rows] = np.array(group, object)[best]
            score[rows] *= support[np.arange(len(rows)), best]
        return list(langs), score


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [vector(t.as_py()) for t in batch.column("text")]
        flat = pa.array(np.concatenate(rows) if rows else np.empty(0, np.float32))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * SIZE), flat)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), lists], names=["lang", "vector"])


def sample(docs: DataFrame, most: int, each: int) -> DataFrame:
    """(lang, vector) of at most ``each`` different texts of a language and ``most`` in all; which ones, their hashes say."""
    langs = docs.select("lang").distinct().count()
    each = min(each, max(1, most // max(1, langs)))
    keyed = docs.select("lang", "text", F.xxhash64("text").alias("key"))
    # each part of a language sends its smallest keys only
    part = keyed.select("lang", "key", F.pmod(F.hash("key"), F.lit(64)).alias("part")).distinct()
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("key"))
    part = part.withColumn("n", first("lang", "part")).filter(F.col("n") <= each)
    chosen = part.withColumn("n", first("lang")).filter(F.col("n") <= each).select("lang", "key")
    # at most MOST_ROWS rows of two columns are broadcast
    chosen = docs.sparkSession.createDataFrame(chosen.toPandas(), "lang string, key long")
    rows = keyed.join(F.broadcast(chosen), ["lang", "key"]).groupBy("lang", "key").agg(F.first("text").alias("text"))
    return rows.select("lang", "text").mapInArrow(_vectors, "lang string, vector array<float>")


def fitted(docs: DataFrame, most: int = MOST_ROWS, each: int = LANGUAGE_ROWS) -> Hierarchy | None:
    """The machines of (lang, text) rows; None without any. What reaches the driver is means and weights, as many as languages and their pairs within families."""
    rows = checkpointed(sample(docs, most, each))
    centred = rows.groupBy("lang").applyInPandas(
        lambda g: pd.DataFrame({"lang": [g["lang"].iloc[0]], "mean": [np.stack(g["vector"].to_numpy()).mean(0).astype(float)]}),
        "lang string, mean array<double>",
    )
    means = {r["lang"]: np.array(r["mean"]) for r in centred.collect()}
    if not means:
        return None
    families = families_of(means)
    # (problem, language, its class); a family's machine sees all languages, a pair's two
    problems = [(f"{k}", lang, 1 if lang in group else -1) for k, group in enumerate(families) for lang in means if len(families) > 1]
    pairs = [(k, a, b) for k, group in enumerate(families) for i, a in enumerate(group) for b in group[i + 1 :]]
    for n, (_, a, b) in enumerate(pairs):
        problems += [(f"p{n}", a, 1), (f"p{n}", b, -1)]
    weights: dict[str, np.ndarray] = {}
    if problems:
        roles = docs.sparkSession.createDataFrame(problems, "problem string, lang string, side int")

        def fit(g: pd.DataFrame) -> pd.DataFrame:
            g = g.iloc[np.lexsort(np.stack(g["vector"].to_numpy()).T[:8])]
            w = machine(np.stack(g["vector"].to_numpy()), g["side"].to_numpy())
            return pd.DataFrame({"problem": [g["problem"].iloc[0]], "w": [w.astype(float)]})

        made = rows.join(F.broadcast(roles), "lang").groupBy("problem").applyInPandas(fit, "problem string, w array<double>")
        weights = {r["problem"]: np.array(r["w"], np.float32) for r in made.collect()}
    family = np.stack([weights[f"{k}"] for k in range(len(families))]) if len(families) > 1 else np.zeros((1, SIZE + 1), np.float32)
    return Hierarchy(families, family, {(a, b): weights[f"p{n}"] for n, (_, a, b) in enumerate(pairs)})


def _identified(model: Hierarchy | None, unknown: str, rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for start in range(0, batch.num_rows, rows):
                part = [t.as_py() for t in batch.column(1).slice(start, rows)]
                x = np.stack([vector(t) for t in part])
                found, sure = model.predict(x) if model else ([unknown] * len(part), np.zeros(len(part)))
                for text, lang, score in zip(part, found, sure):
                    known = model is not None and has_letter(text)
                    langs.append(lang if known else unknown)
                    scores.append(float(min(1.0, max(0.0, score))) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identified(docs: DataFrame, folds: int = 3, held_out: int = 1, unknown: str = "und", most: int = MOST_ROWS, each: int = LANGUAGE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs.

    Rows whose crc32(doc_id) mod ``folds`` is ``held_out`` are not learnt
    from, nor are rows of null lang or without a letter; of the others at most
    ``each`` different texts of a language and ``most`` of all. Null, empty
    and letterless texts are ``unknown`` with score 0, and so are all where
    nothing is learnt. A null doc_id counts as empty text in the fold. With
    one language there is nothing to tell apart: it is every text's, with
    score 1. Ties go to the first language in order. Repeated rows are judged
    alike, very long texts whole; other columns are left aside, and an empty
    table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds
    known = docs.filter((fold != held_out) & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    model = fitted(known.select("lang", "text"), most, each)
    out = docs.select("doc_id", "text").mapInArrow(_identified(model, unknown), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold == held_out).alias("held_out"), "lang_pred", "score")
