"""Exact top-k search by inner product, in three phases with a uniform threshold.

Components are split into m parts; for a query, every part is a list of partial scores over all candidates, kept in
shards where the candidates are. (1) Shards give their local lists: the entries that are best by the first part, with
their other parts resolved. The k-th best whole score of all is a safe cutoff: no answer scores less. (2) The cutoff is broadcast. Whatever reaches it
has a part with at least an m-th of it, so shards collect the entries with such a part. (3) The remaining parts of
those entries are resolved exactly, and what reaches the cutoff is ranked. Queries go in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.llm.common import cut, scratch

_CHUNK = 512
#: Above all scores: components are below 2**135, vectors have at most 2**31.
_TOP = 1 << 320
_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "U1"), np.zeros(0, np.int64))


def quantised(vectors: DataFrame, factor: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): floor(factor * x) of all components x, of vectors without null or non-finite components and with an id.
    v holds whole numbers as doubles, which are exact at any size; none is cut to 64 bits."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(sound).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.rint(c * factor) - F.when(F.rint(c * factor) > c * factor, 1.0).otherwise(0.0)).alias("v")
    )


def _matrices(batch):
    """(ids, matrix) for each length of vector in a batch, in parts of bounded size."""
    column = batch.column("v")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values, ends, ids = column.flatten().to_numpy(), np.cumsum(sizes), batch.column("id").to_numpy()
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for at in range(0, len(rows), _CHUNK):
            part = rows[at : at + _CHUNK]
            yield int(size), ids[part], values[(ends[part] - size)[:, None] + np.arange(size)]


def _whole(values: np.ndarray) -> np.ndarray:
    """As Python integers."""
    return np.frompyfunc(int, 1, 1)(values)


def _exactly(queries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as they are where doubles hold all sums of products, else as Python integers."""
    with np.errstate(over="ignore"):
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    return (queries, vectors) if most < 2**52 else (_whole(queries), _whole(vectors))


def _bounds(size: int, parts: int) -> list[tuple[int, int]]:
    return [(size * k // parts, size * (k + 1) // parts) for k in range(parts)]


def _partial(q: np.ndarray, v: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    """Partial scores (query, vector) of a part of the components."""
    a, b = part
    return q[:, a:b] @ v[:, a:b].T if b > a else np.zeros((len(q), len(v)), q.dtype)


def _ordered(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores as 64-bit integers, the nearest ones of larger scores; and what orders those that are as large or larger,
    ascending from the highest, else the empty string."""
    if scores.dtype != object:
        return scores.astype(np.int64), np.full(len(scores), "", "U1")
    nearest = [min(max(int(s), -(2**63)), 2**63 - 1) for s in scores]
    return np.array(nearest, np.int64), np.array([_beyond(int(s)) if abs(int(s)) >= 2**63 - 1 else "" for s in scores], str)


def _beyond(score: int) -> str:
    return f"{_TOP - score:081x}"


def _exact(score: int, beyond: str) -> int:
    return _TOP - int(beyond, 16) if beyond else score


def _best(query: np.ndarray, score: np.ndarray, beyond: np.ndarray, ids: np.ndarray, k: int):
    """The k best entries of each query, ties to smaller ids."""
    order = np.lexsort((ids, beyond, ~score, query))
    query, score, beyond, ids = query[order], score[order], beyond[order], ids[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[rank < k], score[rank < k], beyond[rank < k], ids[rank < k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, parts: int = 2, block: int = 2048) -> DataFrame:
    """(query_id, rank, id, score): the k vectors with the highest inner product with each query, ties to smaller ids.

    vectors and queries: (id, v) of whole numbers, as quantised() gives them. A query is not its own candidate, nor is any
    row with its id; a vector of another length takes no part. Fewer than k candidates: all. Repeated candidates are
    listed each; repeated query rows once. Empty tables give an empty result. Scores are exact and ranked as such; one
    beyond 64 bits is given as the nearest 64-bit integer."""
    with scratch(vectors.sparkSession) as keep:
        return keep(_top_k(vectors, queries, k, parts, block))


def _top_k(vectors: DataFrame, queries: DataFrame, k: int, parts: int, block: int) -> DataFrame:
    spark = vectors.sparkSession
    vectors = cut(vectors)
    queries = cut(queries.distinct().withColumn("block", F.xxhash64("id", "v")))
    n_blocks = -(-queries.count() // block)
    results = []
    for b in range(n_blocks):
        rows = queries.where(F.pmod("block", F.lit(n_blocks)) == b).orderBy("id", "v").select("id", "v").collect()  # block rows, or a little more
        if not rows:
            continue
        ids = np.array([r["id"] for r in rows], np.int64)
        by_size: dict[int, np.ndarray] = {}
        for size in {len(r["v"]) for r in rows}:
            by_size[size] = np.array([i for i, r in enumerate(rows) if len(r["v"]) == size])
        asked = spark.sparkContext.broadcast((ids, {s: (at, np.array([rows[i]["v"] for i in at], np.float64).reshape(len(at), s)) for s, at in by_size.items()}))

        def local_lists(batches, asked=asked):
            ids, by_size = asked.value
            found = [_NONE]
            for batch in batches:
                for size, own, matrix in _matrices(batch):
                    if size not in by_size:
                        continue
                    at, q = by_size[size]
                    q, v = _exactly(q, matrix)
                    first = _bounds(size, parts)[0]
                    part = _partial(q, v, first)
                    if part.dtype == object or part.shape[1] <= k + 1:
                        best = np.tile(np.arange(part.shape[1]), (len(q), 1))
                    else:
                        best = np.argpartition(part, part.shape[1] - k - 1, axis=1)[:, -k - 1 :]  # one may be the query itself
                    rows, cols = np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()
                    other = own[cols] != ids[at[rows]]
                    rows, cols = rows[other], cols[other]
                    rest = (q[rows, first[1] :] * v[cols, first[1] :]).sum(axis=1)
                    found.append((at[rows], *_ordered(part[rows, cols] + rest), own[cols]))
                    if len(found) > 8:
                        found = [_best(*map(np.concatenate, zip(*found, strict=True)), k)]
            query, score, beyond, _ = _best(*map(np.concatenate, zip(*found, strict=True)), k)
            yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int64)), pa.array(score), pa.array(beyond, pa.string())], names=["q", "score", "beyond"])

        ranked = Window.partitionBy("q").orderBy(F.desc("score"), "beyond")
        cutoffs = (
            vectors.mapInArrow(local_lists, "q long, score long, beyond string")
            .withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k).where(F.col("n") == k)
            .select("q", "score", "beyond").collect()
        )  # one number for each query of the block
        limit = np.full(len(rows), -_TOP, object)
        for r in cutoffs:
            limit[r["q"]] = _exact(r["score"], r["beyond"])
        told = spark.sparkContext.broadcast(limit)

        def resolve(batches, asked=asked, told=told):
            (ids, by_size), limit = asked.value, told.value
            found, n = [_NONE], 0
            for batch in batches:
                for size, own, matrix in _matrices(batch):
                    if size not in by_size:
                        continue
                    at, q = by_size[size]
                    q, v = _exactly(q, matrix)
                    lists = [_partial(q, v, part) for part in _bounds(size, parts)]
                    least = limit[at].astype(lists[0].dtype)
                    enough = lists[0] * parts >= least[:, None]
                    for part in lists[1:]:
                        enough |= part * parts >= least[:, None]
                    rows, cols = np.nonzero(enough)
                    score = sum(part[rows, cols] for part in lists)
                    keep = (score >= least[rows]).astype(bool) & (own[cols] != ids[at[rows]])
                    found.append((at[rows[keep]], *_ordered(score[keep]), own[cols[keep]]))
                    n += int(keep.sum())
                    if n > 1_000_000:
                        found = [_best(*map(np.concatenate, zip(*found, strict=True)), k)]
                        n = 0
            query, score, beyond, own = _best(*map(np.concatenate, zip(*found, strict=True)), k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query.astype(np.int64)), pa.array(ids[query.astype(np.int64)]), pa.array(own), pa.array(score), pa.array(beyond, pa.string())],
                names=["q", "query_id", "id", "score", "beyond"],
            )

        answer = Window.partitionBy("q").orderBy(F.desc("score"), "beyond", "id")
        results.append(cut(
            vectors.mapInArrow(resolve, "q long, query_id long, id long, score long, beyond string")
            .withColumn("rank", F.row_number().over(answer)).where(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score")
        ))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out
