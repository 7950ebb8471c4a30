"""Shared helpers: zero-copy text slices for Arrow functions, scratch tables
in the cluster's shared folder, and 64-bit hashes computed with numpy."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Texts are worked on in slices of about so many bytes, so that numpy
#: temporaries stay small whatever the size of an Arrow batch.
SLICE_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which every executor can
    reach. Where that is unset, a session on one machine gets a local one, and
    any other an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context_dir.isDefined():
            root = context_dir.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile  # one machine: tests and trials

            root = "file://" + tempfile.mkdtemp(prefix="threadloom-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/threadloom-{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts
    the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no frame still to be run reads. Frames
    made of them must be written themselves before: those don't go back to them if
    an executor is lost. Then the driver's JVM collects garbage, as only that makes
    Spark remove the shuffle files of finished jobs from the executors' disks."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(conf).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 int64 offsets of an Arrow string column, without
    copying; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def slices(offs: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (a, b) whose texts together have about ``limit`` bytes; a
    longer text stands alone."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


#: Bytes of an Arrow batch of texts, in the executor and again in its worker.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches held to BATCH_BYTES: by rows alone,
    a batch of long texts has no bound."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = re.fullmatch(r"(-?\d+)([a-z]*)", str(conf.get(key)).lower())
    scale = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    if now is None or not 0 < int(now[1]) * scale.get(now[2], 1 << 40) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Returns what Arrow's pool holds but doesn't use: workers live on between
    stages, and their pools would add up beside the executor's heap."""
    pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: tuple[np.ndarray, np.ndarray] | None = None
_byte_values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64, up to n."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for base in (_BASE, inverse):
            table = np.ones(size, np.uint64)
            filled, step = 1, base
            with np.errstate(over="ignore"):
                while filled < size:
                    take = min(filled, size - filled)
                    table[filled : filled + take] = table[:take] * np.uint64(step)
                    filled += take
                    step = step * step % (1 << 64)
            out.append(table)
        if size > 1 << 22:  # a text of many MB: don't keep its table
            return out[0], out[1]
        _powers = (out[0], out[1])
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span of ``data`` (ascending starts): a
    polynomial over random byte values, from one running sum, then mixed with
    the span's length. It doesn't depend on where a span lies, so long data
    go through in windows."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        base = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, base + 2 * SLICE_BYTES, side="right")))
        out[a:b] = _window_hashes(data[base : int(ends[a:b].max())], starts[a:b] - base, ends[a:b] - base)
        a = b
    return out


def _window_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _power_table(len(data) + 1)
    with np.errstate(over="ignore"):
        running = np.empty(len(data) + 1, np.uint64)
        running[0] = 0
        terms = _byte_values[data]
        terms *= power[: len(data)]
        np.cumsum(terms, out=running[1:])
        h = (running[ends] - running[starts]) * inverse[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return mix64(h)
