"""Approximate nearest neighbours by learned partitions.

A router fitted on a bounded sample places every vector in one part and names
the parts that a query probes; how many is chosen on the sample, so that held
out vectors reach the recall asked for against brute force. Parts are dealt
out in blocks of bounded size, queries as well, and each pair of blocks is one
matrix product. Scores are exact inner products in double precision.

Equal vectors are one candidate that knows its smallest ids, as many as any
answer can use, so a vector that many rows share is compared once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, slots, written
from .router import Router, fitted, probes_for

#: A part holds so many vectors, in a small table down to LEAST_PART of them; the sample has at least so many vectors, and a part PER_SAMPLE of it.
PER_PART, LEAST_PART, SMALL_PARTS, MOST_PARTS = 2500, 150, 16, 1024
SAMPLE, PER_SAMPLE = 5120, 40
BLOCK, QUERIES = 8192, 2048
#: Pairs whose exact scores are taken at once, and the rounding error of a matrix product against them, as a part of the vectors' lengths.
PAIRS, ROUNDING = 1 << 15, 1e-12


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<f8").reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _valid(dims: int):
    """(vec_id, embedding) to (vec_id, cls, vec) for vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, classes, vectors = [], [], []
            for i, e in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not e.is_valid or len(e) != dims or e.values.null_count:
                    continue
                x = e.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    vectors.append(x.tobytes())
                    classes.append(hashlib.blake2b(vectors[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(classes, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "cls", "vec"])

    return run


def _routed(router: Router, probes: int):
    """(cls, vec, ids) to (cls, vec, ids, parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = router.best(_unit(_matrix(batch.column(1))), probes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1, dtype=np.int32) * parts.shape[1]), pa.array(parts.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["cls", "vec", "ids", "parts"])

    return run


def _best(q: np.ndarray, c: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of c, score) of the ``count`` best of each q; of equal scores, the first rows of c.

    Every row of c that could be among them, whatever ties there, gets its
    exact score; as many at once as PAIRS.
    """
    sim = q @ c.T
    least = np.partition(sim, len(c) - count, axis=1)[:, len(c) - count] if count < len(c) else np.full(len(q), -np.inf)
    slack = ROUNDING * np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max()
    out = ([np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)])
    near = sim >= (least - 2 * slack)[:, None]
    ends = np.searchsorted(np.cumsum(near.sum(1)), np.arange(PAIRS, near.sum() + PAIRS, PAIRS), side="left") + 1
    for first, last in zip([0, *ends], ends):
        a, b = np.nonzero(near[first:last])
        if not len(a):
            continue
        a, score = a + first, np.empty(len(a))
        for k in range(0, len(a), PAIRS):
            score[k : k + PAIRS] = (q[a[k : k + PAIRS]] * c[b[k : k + PAIRS]]).sum(1)
        order = np.lexsort((b, -score, a))
        a, b, score = a[order], b[order], score[order]
        turn = np.arange(len(a)) - np.searchsorted(a, a)
        for x, y in zip(out, (a, b, score)):
            x.append(y[turn < count])
    return tuple(map(np.concatenate, out))


def _compared(count: int):
    """cogrouped blocks of queries and of candidates to the best ``count`` ids of each query."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        names, out = ["cls", "vec_id", "score"], ([], [], [])
        if queries.num_rows and candidates.num_rows:
            q, c = _matrix(queries.column("vec").combine_chunks()), _matrix(candidates.column("vec").combine_chunks())
            ids = candidates.column("ids").to_pylist()
            # classes in order of their smallest id, which settles ties between them
            turn = np.argsort(np.array([i[0] for i in ids]), kind="stable")
            c, ids = c[turn], [ids[k] for k in turn]
            asked = queries.column("cls").to_pylist()
            for s in range(0, len(q), 256):
                found: dict[int, list] = {}
                for a, b, score in zip(*map(np.ndarray.tolist, _best(q[s : s + 256], c, min(count, len(c))))):
                    found.setdefault(a, []).extend((-score, i) for i in ids[b])
                for a, rows in found.items():
                    for score, i in sorted(rows)[:count]:
                        out[0].append(asked[s + a])
                        out[1].append(i)
                        out[2].append(-score)
        return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=names)

    return run


def _fitted(classes: DataFrame, total: int, dims: int, k: int, recall: float, seed: int) -> tuple[Router, int]:
    """The router and its probes; from a sample of classes, picked by their digest, that grows with the parts up to a bound."""
    parts = min(MOST_PARTS, max(total // PER_PART, min(SMALL_PARTS, total // LEAST_PART)))
    if parts < 2:
        return fitted(np.zeros((1, dims)), 1), 1
    size = max(SAMPLE, PER_SAMPLE * parts)
    share = min(1.0, size / total)
    draw = F.pmod(F.xxhash64(F.lit(seed), "cls"), F.lit(1 << 30)) < int(share * (1 << 30))
    picked = classes.filter(draw).select("cls", "vec").limit(2 * size).toArrow().sort_by("cls")
    x = _matrix(picked.column("vec").combine_chunks())
    held, rest = x[::10], np.delete(x, np.s_[::10], axis=0)
    router = fitted(rest, parts)
    return router, probes_for(router, rest, held, k, recall)


def nearest(
    embeddings: DataFrame,
    k: int = 20,
    every: int = 20,
    recall: float = 0.96,
    seed: int = 5,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, nearest first.

    Queries are the rows whose vec_id is divisible by ``every``; candidates
    are all rows but the query's own. Ties go to the smaller vec_id, however
    many vectors tie. Vectors
    that are null, zero, of another length than most, or that hold null or
    non-finite components take no part, nor do rows without vec_id. A row
    that is repeated counts once. Other columns are left aside, so their names
    can't clash. An empty table gives an empty table, and so does one without
    any vector that takes part. ``recall`` is what held out vectors of the
    sample must reach; a table of fewer than 2 * LEAST_PART vectors is one part.
    """
    df = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    size = df.filter("embedding IS NOT NULL").groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims = size[0]["dims"] if size else 0
    rows = df.mapInArrow(_valid(dims), "vec_id long, cls binary, vec binary")
    rows = written(rows, "vectors")
    ids = rows.select("cls", "vec_id").distinct()
    turn = F.row_number().over(Window.partitionBy("cls").orderBy("vec_id"))
    # k + 1 ids serve any query: k others, and its own
    few = ids.withColumn("turn", turn).filter(F.col("turn") <= k + 1)
    few = few.groupBy("cls").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = written(rows.groupBy("cls").agg(F.first("vec").alias("vec")).join(few, "cls").select("cls", "vec", "ids"), "classes")
    asked = checkpointed(ids.filter(F.col("vec_id") % every == 0))
    router, probes = _fitted(classes, classes.count(), dims, k, recall, seed)
    kept = "cls binary, vec binary, ids array<long>, parts array<int>"
    placed = written(classes.mapInArrow(_routed(router, 1), kept).withColumn("part", F.col("parts")[0]).drop("parts"), "placed")
    queries = classes.join(asked.select("cls").distinct(), "cls", "left_semi").mapInArrow(_routed(router, probes), kept)
    queries = written(queries.select("cls", "vec", F.explode("parts").alias("part")), "queries")
    # blocks of a part: their numbers come from its counts, one row for each part
    blocks = placed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asks = queries.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("asks"))
    sizes = F.broadcast(blocks.join(asks, "part"))  # at most MOST_PARTS rows
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    left = queries.join(sizes, "part").select("part", mine("asks").alias("ask"), spread("blocks").alias("block"), "cls", "vec")
    right = placed.join(sizes, "part").select("part", spread("asks").alias("ask"), mine("blocks").alias("block"), "vec", "ids")
    key, n = ["part", "ask", "block"], slots(embeddings)
    found = (
        left.repartition(n, *key).groupBy(*key).cogroup(right.repartition(n, *key).groupBy(*key))
        .applyInArrow(_compared(k + 1), "cls binary, vec_id long, score double")
    )
    best = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "vec_id"))
    top = found.withColumn("turn", best).filter(F.col("turn") <= k + 1)
    lists = top.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("turn", "vec_id", "score"))).alias("near"))
    answer = asked.join(lists, "cls").select(
        F.col("vec_id").alias("query_id"),
        F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)).alias("rank", "near"),
    )
    return answer.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("near.vec_id").alias("vec_id"), F.col("near.score").alias("score"))
