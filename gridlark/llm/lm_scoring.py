"""Language-model scores of whole texts, learnt from the corpus itself.

Training texts are counted once: byte windows for the trie of prediction by
partial matching, and words for a unigram baseline. Counts are added up in
each task and again by Spark. The whole trie stays a Spark table. What a
window costs depends on the trie alone, so every distinct window of the
corpus is costed once: nodes of three context bytes or more are dealt by the
last three of them, where they meet the windows that ask them; those of fewer
context bytes are in every task (256 ** 3 at the most, in any corpus).

The most frequent windows and words, up to a bound each, are looked up in the
tasks; all others meet their costs and counts in a join, and none of them is
frequent enough to be a hot key. The bounds decide what is looked up where,
not what is known.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slots, written
from .ppm import ORDER, Model, Table, grams
from .shingles import WordHashes, word_list

MOST_NODES, MOST_WORDS = 1_500_000, 200_000
#: Nodes of fewer context bytes are in every task, the others are dealt by so many of them.
DEALT = 3
#: Kind of a count: a word (by hash), the texts, the windows of held out texts, or those learnt (ORDER).
WORDS, TEXTS, HELD = -1, -2, ORDER + 1


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    known, where = np.unique(keys, return_inverse=True)
    return known, np.bincount(where, counts, len(known)).astype(np.int64)


class _Counts:
    """Counts of 64-bit keys; given out whenever they outgrow ``most``."""

    def __init__(self, kind: int, most: int = 2_000_000):
        self.kind, self.most, self.parts, self.size = kind, most, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > self.most:
            self.parts = [_merged(self.parts)]
            self.size = len(self.parts[0][0])
            if self.size > self.most // 2:
                yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            keys, counts = _merged(self.parts)
            for k in range(0, len(keys), 100_000):
                part = keys[k : k + 100_000]
                cols = [pa.array(np.full(len(part), self.kind, np.int32)), pa.array(part.view(np.int64)), pa.array(counts[k : k + 100_000])]
                yield pa.RecordBatch.from_arrays(cols, names=["kind", "key", "n"])
        self.parts, self.size = [], 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(held_out, text) to counts of byte windows of full length, and of the words and texts that are learnt."""
    hashes, words, windows, held, texts = WordHashes(), _Counts(WORDS), _Counts(ORDER), _Counts(HELD), 0
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            rows = list(zip(*(c.to_pylist() for c in batch.slice(k, 500).columns)))
            part = [text for out, text in rows if not out]
            texts += len(part)
            for found, _ in grams(map(_bytes, part)):
                yield from windows.add(found)
            for found, _ in grams(_bytes(text) for out, text in rows if out):
                yield from held.add(found)
            for text in part:
                found = word_list(text)
                if found:
                    words.parts.append((np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)), np.ones(len(found), np.int64)))
            if words.parts:
                words.parts = [_merged(words.parts)]
                if len(words.parts[0][0]) > words.most // 2:
                    yield from words.out()
    yield from words.out()
    yield from windows.out()
    yield from held.out()
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([TEXTS], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], names=["kind", "key", "n"])


def _within(df: DataFrame, most: int) -> DataFrame:
    """The rows of the largest counts n, ``most`` at the most, by a histogram of counts.

    Bins are eighths of a power of two, so the histogram has a few hundred
    rows at any size; a bin that doesn't fit whole is left out.
    """
    bin_ = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    rows = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("k")).collect()
    total, least = 0, None
    for r in sorted(rows, key=lambda r: -r["bin"]):
        total += r["k"]
        if total > most:
            break
        least = r["bin"]
    return df.filter(bin_ >= least) if least is not None else df.limit(0)


def _arrays(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table of bounded size."""
    found = df.toArrow()
    return [c.to_numpy() for c in found.columns]


def _by_context(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """The columns of nodes that are sorted by context, in portions of whole contexts.

    A portion is ``most`` nodes and a batch, or one context, which has fewer
    than 256 ** 3 nodes whatever the corpus.
    """
    held, size = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size > most:
            columns = [np.concatenate(c) for c in zip(*held)]
            context = columns[1] >> 8 & (1 << 8 * DEALT) - 1
            last = int(np.argmax(context == context[-1]))
            if last:
                yield [c[:last] for c in columns]
            held = [[c[last:] for c in columns]]
            # a context larger than that goes on growing, and is looked at again after as many nodes
            size = 0 if not last else size - last
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _costed(low, most: int = 1 << 19):
    """Nodes (order, value, n, met), dealt and sorted by context, to the costs of their windows of full length."""

    def costs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        orders, values, counts, met = columns
        learnt, full = counts > 0, orders == ORDER
        model = Model(*(np.concatenate((a, b[learnt])) for a, b in zip(low.value, (orders, values, counts))))
        keys, met = values[full], met[full]
        for k in range(0, len(keys), 100_000):
            part = keys[k : k + 100_000]
            cols = [pa.array(part), pa.array(met[k : k + 100_000]), pa.array(model.costs(part.astype(np.uint64)))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "n", "cost"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _by_context(batches, most):
            yield from costs(columns)

    return run


_TABLES: dict[str, Table] = {}


def _table(key: str, keys: np.ndarray) -> Table:
    """The looked up windows of a job, put in a table once in each Python worker."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = Table(keys.astype(np.uint64))
    return _TABLES[key]


def _looked_up(texts: list[bytes], table: Table, cost: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The summed costs of each text's windows in the table; of the others, cuts by text, windows and times."""
    score, owners, others = np.zeros(len(texts)), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for windows, owner in grams(texts):
        at = table.find(windows)
        first, miss = owner[0], at < 0
        part = np.bincount(owner - first, cost[at])
        score[first : first + len(part)] += part
        owners.append(owner[miss])
        others.append(windows[miss])
    owners, others = np.concatenate(owners), np.concatenate(others)
    order = np.lexsort((others, owners))
    owners, others = owners[order], others[order]
    new = np.flatnonzero(np.r_[True, (owners[1:] != owners[:-1]) | (others[1:] != others[:-1])][: len(owners)])
    times = np.diff(np.r_[new, len(owners)])
    return score, [np.searchsorted(owners[new], np.arange(len(texts) + 1)), others[new].view(np.int64), times]


def _scored(key: str, shared, total: int, distinct: int, ends: int):
    """(doc_id, held_out, text) to the scores of a row, and its windows and words that aren't in the tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (windows, costs), (known, counts) = shared.value
        # the last place, 0, is that of windows that aren't in the table
        table, costs, hashes = _table(key, windows), np.append(costs, 0.0), WordHashes()
        row = TaskContext.get().partitionId() << 40
        cost = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))
        end = math.log10((ends + 0.5) / (total + 0.5 * (distinct + 1)))
        lists = lambda cuts, x, t: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x.astype(t)))
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = part.column(2).to_pylist()
                score, (edges, others, often) = _looked_up([_bytes(t) for t in texts], table, costs)
                rows, tails, times, cuts = [], [], [], [0]
                for text in texts:
                    found = word_list(text)
                    h, n = np.unique(np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)), return_counts=True)
                    at = np.searchsorted(known, h)
                    hit = (known[np.minimum(at, len(known) - 1)] == h) if len(known) else np.zeros(len(h), bool)
                    rows.append((row, len(found) + 1, int(n[hit].sum()) + (ends > 0), float((n[hit] * cost[at[hit]]).sum()) + end))
                    row += 1
                    tails.append(h[~hit].view(np.int64))
                    times.append(n[~hit])
                    cuts.append(cuts[-1] + len(tails[-1]))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cols[0], pa.int64()),
                        part.column(0),
                        part.column(1),
                        pa.array(cols[1], pa.int64()),
                        pa.array(cols[2], pa.int64()),
                        pa.array(cols[3], pa.float64()),
                        pa.array(score),
                        lists(cuts, np.concatenate(tails), np.int64),
                        lists(cuts, np.concatenate(times), np.int32),
                        lists(edges, others, np.int64),
                        lists(edges, often, np.int32),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail", "times", "windows", "often"],
                )

    return run


def _tail(rows: DataFrame, keys: str, times: str) -> DataFrame:
    """(row, key, times) of what a row didn't find in the tasks."""
    w = rows.select("row", F.explode(F.arrays_zip(keys, times)).alias("w"))
    return w.select("row", F.col("w")[keys].alias("key"), F.col("w")[times].alias("times"))


def scored(docs: DataFrame, folds: int = 5, held_out: int = 1, most_nodes: int = MOST_NODES, most_words: int = MOST_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Rows whose crc32(doc_id) mod ``folds`` is ``held_out`` are not learnt
    from; a null doc_id counts as empty text there. A null or empty text is
    its end alone: n_tokens 1, and a score like others. Repeated rows count
    as often as they come. With nothing to learn from, every byte costs the
    same and train_tokens is 0; an empty table gives an empty table. Very long
    texts are scored whole; other columns are left aside, so their names can't
    clash. Words are
    told apart by 64-bit hashes. ``most_nodes`` and ``most_words`` bound what
    is looked up in the tasks, and change no result.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds
    docs = docs.select(F.col("doc_id").cast("long"), (fold == held_out).alias("held_out"), F.col("text").cast("string"))
    counts = docs.select("held_out", "text").mapInArrow(_counted, "kind int, key long, n long")
    counts = written(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.filter(F.col("kind") == WORDS)
    sums = {r["kind"]: (r["n"], r["k"]) for r in counts.filter("kind < 0").groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}
    ends = sums.get(TEXTS, (0, 0))[0]
    total = sums.get(WORDS, (0, 0))[0] + ends
    distinct = sums.get(WORDS, (0, 0))[1] + (ends > 0)
    node = lambda k: F.struct(F.lit(k).alias("order"), F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("value"))
    learnt = F.col("kind") == ORDER
    orders = F.explode(F.when(learnt, F.array(*[node(k) for k in range(ORDER + 1)])).otherwise(F.array(node(ORDER))))
    nodes = counts.filter("kind >= 0").select(orders.alias("node"), F.when(learnt, F.col("n")).otherwise(0).alias("n"), F.col("n").alias("met"))
    # windows of held out texts that weren't learnt have n = 0: they are costed, but no nodes
    nodes = written(nodes.groupBy("node.order", "node.value").agg(F.sum("n").alias("n"), F.sum("met").alias("met")), "nodes")
    context = F.shiftright("value", 8).bitwiseAND(F.lit((1 << 8 * DEALT) - 1))
    # fewer than 256 ** DEALT nodes, and a few ten thousand in texts
    low = docs.sparkSession.sparkContext.broadcast(_arrays(nodes.filter(F.col("order") < DEALT).select("order", "value", "n")))
    # sorted, so that a task holds a portion of its contexts at a time
    dealt = nodes.filter(F.col("order") >= DEALT).repartition(slots(docs), context).sortWithinPartitions(context)
    costs = dealt.mapInArrow(_costed(low), "key long, n long, cost double")
    costs = written(costs, "costs")
    table = _arrays(_within(costs, most_nodes).select("key", "cost"))
    known, often = _arrays(_within(words, most_words).select("key", "n"))
    known = known.view(np.uint64)
    order = np.argsort(known)
    # both tables are bounded by most_nodes and most_words
    shared = docs.sparkSession.sparkContext.broadcast((table, (known[order], often[order].astype(float))))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<long>, times array<int>, windows array<long>, often array<int>"
    rows = written(docs.mapInArrow(_scored(uuid.uuid4().hex, shared, total, distinct, ends), schema), "rows")
    rest = _tail(rows, "windows", "often").join(costs.select("key", "cost"), "key")
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("rest"))
    tail = _tail(rows, "tail", "times")
    tail = tail.join(words.select("key", "n"), "key", "left")
    cost = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
    tail = tail.groupBy("row").agg(F.sum(F.col("times") * cost).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("met"))
    rows = rows.drop("tail", "times", "windows", "often").join(tail, "row", "left").join(rest, "row", "left")
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
