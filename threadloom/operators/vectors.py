"""Nearest neighbours, projection and placement over vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.primitives import checkpointed

#: Query vectors in a block: the bound of what goes to all tasks at once.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, JVM-side."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))


def hashed_words(text: Column, dim: int = 64) -> Column:
    """A deterministic embedding: counts of md5(word) modulo ``dim``, unit length."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    spots = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))
    return normalised(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(spots, lambda s: s == i)).cast("double")))


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _matrix(column) -> np.ndarray:
    """Unit rows of an Arrow column of lists of equal length, off its buffer."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1))


def _asked(queries: DataFrame, id_col: str, *columns: str):
    """Blocks of queries, (ids, a matrix for each vector column): each block is
    bounded by about BLOCK rows, and they are taken one by one."""
    asked = queries.dropna(subset=[id_col, *columns])
    blocks = max(1, -(-asked.count() // (BLOCK * 3 // 4)))
    for n in range(blocks):
        part = asked.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == n) if blocks > 1 else asked
        got = part.select(id_col, *columns).toArrow().combine_chunks()
        if got.num_rows:
            yield got.column(0).to_numpy().astype(np.int64), *(_matrix(got.column(i + 1).combine_chunks()) for i in range(len(columns)))


def _whole(parts: list[DataFrame], spark, schema: str) -> DataFrame:
    """The union of the blocks' results; several are each written before the next
    block is taken, so that one broadcast is alive at a time."""
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def nearest(vectors: DataFrame, k: int, id_col: str, vector_col: str, queries: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """(id, other, sim, rank): for each query vector the ``k`` other rows of
    greatest cosine, rounded; ties by id. Null vectors take no part; one of length
    0 has similarity 0. Query vectors go to the tasks in blocks; a task keeps ``k``
    rows for each query while it reads, so what is shuffled is queries times tasks
    times ``k`` rows at most."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).dropna()
    schema, parts, before = "id long, other long, sim double", [], None
    for ids, q in _asked(vectors if queries is None else queries, id_col, vector_col):
        parts = [*parts[:-1], checkpointed(_top(before, k))] if before is not None else parts
        before = rows.mapInArrow(_kept(rows.sparkSession.sparkContext.broadcast((ids, q)), k, digits), schema)
        parts.append(before)
    rank = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    return _whole(parts, vectors.sparkSession, schema).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    return found.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k).drop("r")


def _kept(shared, k: int, digits: int):
    """An Arrow function over (id, v): a task's ``k`` best rows of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        order = np.argsort(ids)
        at, other, sim = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        least = np.full(len(ids), -np.inf)  # of a query's k rows, if it has k
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                own = part.column(0).to_numpy()
                s = np.round(q @ _matrix(part.column(1)).T, digits)
                spot = np.minimum(np.searchsorted(ids, own, sorter=order), len(ids) - 1)
                self_ = ids[order[spot]] == own
                s[order[spot[self_]], np.flatnonzero(self_)] = -np.inf
                bar = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, -k] if s.shape[1] > k else -np.inf)
                row, col = np.nonzero((s >= bar[:, None]) & (s > -np.inf))
                at, other, sim = np.concatenate([at, row]), np.concatenate([other, own[col]]), np.concatenate([sim, s[row, col]])
                best = np.lexsort((other, -sim, at))
                at, other, sim = at[best], other[best], sim[best]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                keep = place < k
                last = place == k - 1
                least[at[last]] = sim[last]
                at, other, sim = at[keep], other[keep], sim[keep]
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(other), pa.array(sim)], names=["id", "other", "sim"])

    return run


def rank_of(vectors: DataFrame, asked: DataFrame, id_col: str, vector_col: str, partner: str, partner_vector: str, digits: int = 9) -> DataFrame:
    """(id, partner, rank) of rows (id, vector, partner, its vector): 1 and the
    number of rows that are nearer than the partner, equal ones by id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).dropna()
    parts = []
    for ids, q, p in _asked(asked, id_col, vector_col, partner_vector):
        parts = [*parts[:-1], checkpointed(parts[-1])] if parts else parts
        mates = {r[0]: r[1] for r in asked.select(id_col, partner).where(F.col(id_col).isin(ids.tolist())).collect()} if len(ids) < 500 else dict(asked.select(id_col, partner).toArrow().to_pandas().itertuples(index=False))
        shared = rows.sparkSession.sparkContext.broadcast((ids, q, np.array([mates[i] for i in ids.tolist()], np.int64), np.round((q * p).sum(axis=1), digits)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, mate, own = shared.value
            nearer = np.zeros(len(ids), np.int64)
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    part = batch.slice(a, 1024)
                    other = part.column(0).to_numpy()[None, :]
                    s = np.round(q @ _matrix(part.column(1)).T, digits)
                    first = (s > own[:, None]) | ((s == own[:, None]) & (other < mate[:, None]))
                    nearer += (first & (other != ids[:, None])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(mate), pa.array(nearer)], names=["id", "partner", "n"])

        parts.append(rows.mapInArrow(run, "id long, partner long, n long").groupBy("id", "partner").agg((F.sum("n") + 1).alias("rank")))
    return _whole(parts, vectors.sparkSession, "id long, partner long, rank long")


def on_plane(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x, y) of all unit vectors on their two principal axes, the largest
    absolute coordinate 1, the sign of an axis that of its largest weight. Null
    vectors are left out."""
    rows = vectors.select(F.col(id_col), F.col(vector_col).alias("v")).dropna()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            m = _matrix(batch.column(1))
            if not len(m):
                continue
            m = np.concatenate([m, np.ones((len(m), 1))], axis=1)  # the last row and column sum the vectors
            total = m.T @ m + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "s"])

    got = rows.mapInArrow(summed, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).orderBy("cell").toArrow()
    if not got.num_rows:
        return rows.select(id_col, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    size = int(round(got.num_rows**0.5))
    moments = got.column("s").to_numpy().reshape(size, size)
    mean = moments[-1, :-1] / moments[-1, -1]
    _, axes = np.linalg.eigh(moments[:-1, :-1] / moments[-1, -1] - np.outer(mean, mean))
    plane = axes[:, ::-1][:, :2]
    plane = plane * np.sign(plane[np.abs(plane).argmax(axis=0), np.arange(plane.shape[1])])
    if plane.shape[1] < 2:
        plane = np.concatenate([plane, np.zeros((size - 1, 1))], axis=1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (_matrix(batch.column(1)) - mean) @ plane if batch.num_rows else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at[:, 0]), pa.array(at[:, 1])], names=[id_col, "x", "y"])

    flat = rows.mapInArrow(placed, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, x double, y double")
    most = flat.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("most"))
    scaled = lambda c: F.round(F.when(F.col("most") > 0, F.col(c) / F.col("most")).otherwise(0.0), 4).alias(c)
    return flat.crossJoin(F.broadcast(most)).select(id_col, scaled("x"), scaled("y"))  # one row


def near_pairs(neighbours: DataFrame, floor: float) -> DataFrame:
    """(a, b, sim): unordered pairs at or above a floor in which one is among the
    other's nearest."""
    pairs = neighbours.where(F.col("sim") >= floor)
    return pairs.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("sim").alias("sim"))


def principal_plane(m: np.ndarray) -> np.ndarray:
    """Two principal components, largest absolute coordinate 1; the sign of each
    is that which makes its largest coordinate positive."""
    centred = m - m.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    out = np.zeros((len(m), 2))
    for j in range(min(2, len(axes))):
        x = centred @ axes[j]
        out[:, j] = x * np.sign(x[np.abs(x).argmax()] or 1)
    most = np.abs(out).max()
    return out / most if most > 0 else out


def project(m: np.ndarray, placed: dict[int, tuple[float, float]], relayout: bool = False, near: int = 5, temperature: float = 0.05, jitter: float = 0.03, turn: float = 2.399963) -> np.ndarray:
    """A stable layout of unit vectors. Fewer than three placed points: a fresh
    plane. With ``relayout`` the fresh plane is turned, mirrored, scaled and shifted
    onto the placed points. Else placed points stay and each new one goes to the
    mean of its nearest placed ones, weighted by softmax, with a small offset."""
    if len(placed) < 3:
        return principal_plane(m)
    at = sorted(placed)
    old = np.array([placed[i] for i in at])
    if relayout:
        fresh = principal_plane(m)
        a, b = fresh[at] - fresh[at].mean(axis=0), old - old.mean(axis=0)
        u, s, vt = np.linalg.svd(a.T @ b)
        scale = s.sum() / max((a**2).sum(), 1e-12)
        out = (fresh - fresh[at].mean(axis=0)) @ u @ vt * scale + old.mean(axis=0)
        most = np.abs(out).max()
        return out / most if most > 1.25 else out
    out = np.zeros((len(m), 2))
    out[at] = old
    for n, i in enumerate(j for j in range(len(m)) if j not in placed):
        sim = m[at] @ m[i]
        best = np.argsort(-sim, kind="stable")[:near]
        w = np.exp((sim[best] - sim[best].max()) / temperature)
        out[i] = w @ old[best] / w.sum() + jitter * np.array([np.cos(n * turn), np.sin(n * turn)])
    return out
