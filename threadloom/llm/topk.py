"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of partial scores, one for each group of dimensions; each
group is a list. Phase 1: every partition gathers, for each query and list, its
k best partial scores with their rows' exact scores. The k-th best exact score
over all of them is a safe cutoff: no row below it can be among the k best.
Phase 2: the cutoff goes to all tasks. A row whose total reaches it has a
partial score of at least cutoff / lists in some list, so only such entries are
kept, and of these only those whose bound (what the list gave plus the most the
other dimensions can give) reaches it. Phase 3: the entries left are scored
exactly, and the k best of each query are taken from those at or above the
cutoff.

Queries go through in blocks of a fixed number, so what is broadcast is bounded
(BLOCK vectors and as many cutoffs); each block is two passes over the rows.

Vectors are scaled to whole numbers, floor(scale * x) with x as double; all
sums stay below 2**53 and are exact in float64. Defined results: vectors that
are null, or hold null or non-finite components, take no part; a shorter vector
counts as having zeros at its end. Rows with the query's own id are not its
candidates; rows that repeat another id are candidates each for itself. Ties go
to smaller ids. A null id takes no part. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm._arrow import written

#: Queries in a block: the bound of what is broadcast at once.
BLOCK = 4096
#: Rows scored at once; bounds a task's matrices.
ROWS, QUERIES = 2048, 256


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): usable vectors as whole doubles."""
    x = F.col(vector_col)
    usable = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    offs = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(offs)
    if len(size) and (size == dim).all():
        return flat[offs[0] : offs[-1]].reshape(-1, dim)
    out = np.zeros((len(size), dim))
    for i, (a, n) in enumerate(zip(offs, np.minimum(size, dim))):
        out[i, :n] = flat[a : a + n]
    return out


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of scores, the columns of the k largest."""
    if scores.shape[1] <= k:
        rows, cols = np.indices(scores.shape)
        return rows.ravel(), cols.ravel()
    cols = np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]
    return np.repeat(np.arange(len(scores)), k), cols.ravel()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, lists: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best rows."""
    spark = vectors.sparkSession
    rows = scaled(vectors, id_col, vector_col, scale)
    asked = scaled(queries, id_col, vector_col, scale).dropDuplicates(["id"])
    ordered = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-asked.count() // (BLOCK // 2))))))
    blocks = max(1, -(-asked.count() // (BLOCK // 2)))
    out = None
    for block in range(blocks):
        found = _block(spark, rows, ordered.where(F.col("block") == block), k, lists)
        found = written(found) if blocks > 1 else found  # one block's vectors are held at a time
        out = found if out is None else out.unionByName(found)
    return out


def _block(spark, rows: DataFrame, asked: DataFrame, k: int, lists: int) -> DataFrame:
    got = asked.select("id", "v").orderBy("id").collect()
    if len(got) > BLOCK:  # as good as never: ids are dealt by hash
        half = asked.withColumn("half", F.pmod(F.hash("id"), F.lit(2)))
        return _block(spark, rows, half.where("half = 0"), k, lists).unionByName(_block(spark, rows, half.where("half = 1"), k, lists))
    dim = max([1, *(len(r.v) for r in got)])
    q = np.zeros((len(got), dim))
    for i, r in enumerate(got):
        q[i, : len(r.v)] = r.v
    q_ids = np.array([r.id for r in got], np.int64)
    edges = np.linspace(0, dim, min(lists, dim) + 1).astype(int)
    shared = spark.sparkContext.broadcast((q, q_ids))
    names = ["query_id", "vec_id", "score"]

    def partials(m: np.ndarray, some: np.ndarray) -> list[np.ndarray]:
        return [some[:, a:b] @ m[:, a:b].T for a, b in zip(edges, edges[1:])]

    def blocks(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                yield part.column(0).to_numpy(), _matrix(part.column(1), dim)

    def emit(qi, vi, s) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (qi, vi, s)], names=names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase 1. Keeps the k best of each query and list of the partition."""
        q, q_ids = shared.value
        kept: list[dict] = [{} for _ in edges[1:]]
        for ids, m in blocks(batches):
            for a in range(0, len(q), QUERIES):
                own = q_ids[a : a + QUERIES, None] == ids[None, :]
                parts = partials(m, q[a : a + QUERIES])
                total = sum(parts)
                for j, p in enumerate(parts):
                    p = np.where(own, -np.inf, p)
                    row, col = _best(p, k)
                    ok = np.isfinite(p[row, col])
                    row, col = row[ok], col[ok]
                    new = (row + a, ids[col], p[row, col], total[row, col])
                    old = kept[j].get(a)
                    x = [np.concatenate(z) for z in zip(old, new)] if old else list(new)
                    order = np.lexsort((-x[2], x[0]))
                    x = [z[order] for z in x]
                    first = np.searchsorted(x[0], x[0])
                    keep = np.arange(len(x[0])) - first < k
                    kept[j][a] = tuple(z[keep] for z in x)
        for lists_ in kept:
            for qi, vi, _, total in lists_.values():
                yield emit(q_ids[qi.astype(np.int64)], vi, total)

    schema = "query_id long, vec_id long, score long"
    # a lower bound of the k-th best: of scores of different rows only
    gathered = rows.mapInArrow(gather, schema).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cutoffs = gathered.withColumn("n", F.row_number().over(rank)).where(F.col("n") == k).select("query_id", "score").collect()
    cutoff = np.full(len(q_ids), -np.inf)
    for r in cutoffs:
        cutoff[np.searchsorted(q_ids, r.query_id)] = r.score
    shared_cutoff = spark.sparkContext.broadcast(cutoff)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phases 2 and 3: entries at or above the uniform threshold, bounded,
        then scored exactly."""
        (q, q_ids), cut = shared.value, shared_cutoff.value
        norms = [np.sqrt((q * q).sum(axis=1) - (q[:, a:b] ** 2).sum(axis=1)) for a, b in zip(edges, edges[1:])]
        for ids, m in blocks(batches):
            rest = [np.sqrt((m * m).sum(axis=1) - (m[:, a:b] ** 2).sum(axis=1)) for a, b in zip(edges, edges[1:])]
            for a in range(0, len(q), QUERIES):
                some, at = q[a : a + QUERIES], cut[a : a + QUERIES, None]
                left = np.zeros((len(some), len(ids)), bool)
                for j, p in enumerate(partials(m, some)):
                    # the rest can't give more than the product of its norms
                    left |= (p * (len(edges) - 1) >= at) & (p + norms[j][a : a + QUERIES, None] * rest[j][None, :] >= at - 1)
                left &= q_ids[a : a + QUERIES, None] != ids[None, :]
                row, col = np.nonzero(left)
                for x in range(0, len(row), 1 << 16):
                    r, c = row[x : x + (1 << 16)], col[x : x + (1 << 16)]
                    s = np.einsum("ij,ij->i", some[r], m[c])
                    ok = s >= at[r, 0]
                    if ok.any():
                        yield emit(q_ids[r[ok] + a], ids[c[ok]], s[ok])

    entries = rows.mapInArrow(collect, schema)
    ranked = entries.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
