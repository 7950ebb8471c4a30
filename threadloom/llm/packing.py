"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens. In each round a queue gets a quantum, its
target share of a window, and sends whole stretches of a 64th of a window; what it
couldn't send stays as a deficit for the next round. A round sends about one
window, and the stream of rounds is cut every ``window`` tokens, so every window has
the target mixture to within two stretches for each queue, however many queues
there are, and only the last one is not full.

Because a queue always has tokens until it drains, what it has sent after r
rounds is r * quantum, rounded down to a stretch: its deficits over all windows and partitions are
closed form. So a task needs no other task's rows, only where its own rows
begin in their queues: one small table of tokens for each partition and source.
When queues drain (with given targets at very different times, with the
default, natural shares nearly together) a new phase begins, in which the
others share the window by their targets.

Tokens are made once and written to the shared folder as two or four bytes
each; the second pass reads them, never the texts.

Defined results: null or empty text is one token, ``end_id``. A null source is a
queue of its own. Rows with null or repeated ids are packed as they come, each
for itself. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm import _bpe
from threadloom.llm._arrow import SLICE_BYTES, bounded_batches, give_back, slices, text_buffers, written

#: Shares are multiples of 1 / UNITS.
UNITS = 1 << 18
#: Sources beyond so many, the smallest by tokens, share one more queue, whose
#: weight is the sum of theirs.
MAX_QUEUES = 1023
#: Numbers in an array of rounds and queues.
CELLS = 1 << 19
#: A row of the token table holds so many tokens at most.
CHUNK = 1 << 16
#: The table of where queues begin is broadcast up to so many rows (24 bytes each).
BROADCAST_ROWS = 200_000
REST = "\x00rest"


@dataclass
class Phase:
    """Rounds with the same queues. ``sent``: tokens of each queue before the
    phase; ``left``: what it has; ``rounds``: how many there are; ``stretch``: tokens
    that are sent at once."""

    base: int
    sent: np.ndarray
    left: np.ndarray
    units: np.ndarray
    rounds: int
    stretch: int

    def after(self, rounds: np.ndarray, window: int) -> np.ndarray:
        """Tokens that each queue has sent in the phase after so many rounds."""
        whole, part = np.divmod(self.units * window, UNITS)
        r = rounds[:, None]
        sent = r * whole + r * part // UNITS
        return np.minimum(sent - sent % self.stretch, self.left)


def share_units(weights: np.ndarray) -> np.ndarray:
    """Weights as whole UNITS that sum up to UNITS, at least one each."""
    exact = weights / weights.sum() * (UNITS - len(weights))
    units = np.floor(exact).astype(np.int64)
    for k in np.argsort(units - exact, kind="stable")[: UNITS - len(weights) - int(units.sum())]:
        units[k] += 1
    return units + 1


def schedule(tokens: list[int], weights: list[float], window: int) -> list[Phase]:
    """The phases for queues of so many tokens with these target weights."""
    left, sent, target = np.array(tokens, np.int64), np.zeros(len(tokens), np.int64), np.array(weights, float)
    phases, base, stretch = [], 0, max(1, window // 64)
    while left.any():
        active = left > 0
        units = np.zeros(len(left), np.int64)
        units[active] = share_units(target[active])
        rounds = min(-(-(-(-int(n) // stretch) * stretch * UNITS) // (int(u) * window)) for n, u in zip(left[active], units[active]))
        phase = Phase(base, sent.copy(), left.copy(), units, rounds, stretch)
        took = phase.after(np.array([rounds], np.int64), window)[0]
        phases.append(phase)
        sent, left, base = sent + took, left - took, base + int(took.sum())
    return phases


def place(queue: np.ndarray, begin: np.ndarray, length: np.ndarray, phases: list[Phase], window: int) -> tuple[np.ndarray, ...]:
    """Pieces of runs of tokens: run ``i`` has ``length[i]`` tokens of queue
    ``queue[i]`` from ``begin[i]``. Gives run, start in the run, length and
    position in the stream, for each piece of a run in one round."""
    out = []
    for phase in phases:
        at, left = phase.sent[queue], phase.left[queue]
        lo = np.maximum(begin, at) - at
        took = phase.after(np.array([phase.rounds], np.int64), window)[0][queue]
        hi = np.minimum(begin + length - at, np.minimum(left, took))
        run = np.flatnonzero(lo < hi)
        if not len(run):
            continue
        lo, hi, q = lo[run], hi[run], queue[run]
        quantum = phase.units[q] * window
        of = lambda o: -(-(o // phase.stretch + 1) * phase.stretch * UNITS // quantum) - 1  # noqa: B023, E731  the round that sends token o
        first, last = of(lo), of(hi - 1)
        many = last - first + 1
        rep = np.repeat(np.arange(len(run)), many)
        rounds = first[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
        some = max(1, CELLS // len(phase.left))  # rounds at once: bounds the arrays of rounds and queues
        for x in range(0, len(rep), some):
            rp = rep[x : x + some]
            seen, which = np.unique(rounds[x : x + some], return_inverse=True)
            before, then = phase.after(seen, window), phase.after(seen + 1, window)
            gain = then - before
            start = before.sum(axis=1)[:, None] + np.cumsum(gain, axis=1) - gain
            qr = q[rp]
            a = np.maximum(lo[rp], before[which, qr])
            b = np.minimum(hi[rp], then[which, qr])
            keep = a < b
            rp, which, qr, a, b = rp[keep], which[keep], qr[keep], a[keep], b[keep]
            out.append((run[rp], a + at[run[rp]] - begin[run[rp]], b - a, phase.base + start[which, qr] + a - before[which, qr]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


def cut(run: np.ndarray, start: np.ndarray, length: np.ndarray, position: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Cuts pieces where a window ends."""
    many = (position + length - 1) // window - position // window + 1
    rep = np.repeat(np.arange(len(run)), many)
    k = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
    edge = (position[rep] // window + k) * window
    a = np.maximum(position[rep], edge)
    b = np.minimum((position + length)[rep], edge + window)
    return run[rep], start[rep] + a - position[rep], b - a, a


def token_table(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(part, doc_id, source, q_off, start, n, doc_tokens, ids) for each chunk of
    at most CHUNK tokens; q_off: tokens of the source before it in the
    partition ``part``. Written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, so_far = _bpe.load(tokenizer_path), TaskContext.get().partitionId(), {}
        for batch in batches:
            raw, offs = text_buffers(batch.column(1))
            for a, b in slices(offs, 2 * SLICE_BYTES):
                counts, ids = encoder.encode(raw, offs[a : b + 1], want_ids=True)
                ends = np.cumsum(counts)
                all_ids = np.insert(ids, ends, end_id).astype("<u4")
                sources = batch.column(2).slice(a, b - a).to_pylist()
                docs = batch.column(0).slice(a, b - a).to_pylist()
                view, at, rows = memoryview(all_ids.tobytes()), 0, []
                for doc, source, n in zip(docs, sources, (counts + 1).tolist()):
                    off = so_far.get(source, 0)
                    so_far[source] = off + n
                    for x in range(0, n, CHUNK):
                        m = min(CHUNK, n - x)
                        rows.append((part, doc, source, off + x, x, m, n, view[4 * (at + x) : 4 * (at + x + m)]))
                    at += n
                columns = list(zip(*rows))
                kinds = [pa.int32(), batch.schema.field(0).type, pa.string(), *[pa.int64()] * 4, pa.binary()]
                if all_ids.max() < 1 << 16:  # two bytes each
                    short = memoryview(all_ids.astype("<u2").tobytes())
                    lengths = np.concatenate([[0], np.cumsum(np.array(columns[5]))])
                    columns[7] = [short[2 * i : 2 * j] for i, j in zip(lengths.tolist(), lengths[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "doc_id", "source", "q_off", "start", "n", "doc_tokens", "ids"])

            give_back()

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), F.col(text_col), F.col(source_col).cast("string").alias("source"))
    return written(bounded_batches(rows).mapInArrow(run, f"part int, doc_id {kind}, source string, q_off long, start long, n long, doc_tokens long, ids binary"))


def pack(
    df: DataFrame,
    tokenizer_path: str,
    window: int = 1024,
    end_id: int = 0,
    targets: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset). ``targets``: weights by source; by default, and for a source that
    it lacks, the source's number of tokens."""
    tokens = token_table(df, tokenizer_path, end_id, id_col, text_col, source_col)
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    per_part = written(tokens.withColumn("key", key).groupBy("part", "key").agg(F.sum("n").alias("n")))
    totals = per_part.groupBy("key").agg(F.sum("n").alias("n"))
    largest = [(r.key, r.n) for r in totals.orderBy(F.desc("n"), "key").limit(MAX_QUEUES).collect()]
    rest = per_part.agg(F.sum("n")).head()[0] or 0
    rest -= sum(n for _, n in largest)
    largest.sort()
    queues, sizes = [k for k, _ in largest], [n for _, n in largest]
    if rest:
        queues, sizes = [*queues, REST], [*sizes, rest]
    given = {"s" + k: v for k, v in (targets or {}).items()}
    weights = [given.get(k, float(n)) for k, n in zip(queues, sizes)]
    if rest and (small := sorted(set(given) - set(queues))):
        own = {r.key: r.n for r in totals.where(F.col("key").isin(small)).collect()}
        weights[-1] += sum(given[k] - n for k, n in own.items())
    phases = schedule(sizes, [max(w, 1e-9) for w in weights], window)

    spark = df.sparkSession
    names = spark.createDataFrame(list(zip(queues, range(len(queues)))) or [("", 0)], "key string, queue int")
    if rest:
        segments = per_part.join(F.broadcast(names), "key", "left").fillna(len(queues) - 1, ["queue"])
    else:
        segments = per_part.join(F.broadcast(names), "key")
    order = Window.partitionBy("queue").orderBy("part", "key")
    segments = segments.select("part", "key", "queue", (F.sum("n").over(order) - F.col("n")).alias("seg"))
    segments = written(segments)
    if segments.count() <= BROADCAST_ROWS:
        segments = F.broadcast(segments)
    rows = tokens.withColumn("key", key).join(segments, ["part", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.concatenate([[0], np.cumsum(batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64))])
            for a, b in slices(sizes, SLICE_BYTES):
                some = batch.slice(a, b - a)
                get = lambda k: some.column(k).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                first, n, whole, queue, begin = (get(k).astype(np.int64) for k in range(1, 6))
                raw, offs = text_buffers(some.column(6))
                ids = np.concatenate([raw[x:y].view("<u2" if (y - x) == 2 * m else "<u4").astype("<u4") for x, y, m in zip(offs, offs[1:], n)])
                base = np.cumsum(n) - n
                run_, start, length, position = cut(*place(queue, begin, n, phases, window), window)
                view = memoryview(ids.tobytes())
                lo = 4 * (base[run_] + start)
                crc = [zlib.crc32(view[x:y]) for x, y in zip(lo.tolist(), (lo + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(run_)), *map(pa.array, (first[run_] + start, length, np.array(crc, np.int64), whole[run_], position // window, position % window))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )
            give_back()

    kind = tokens.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", "start", "n", "doc_tokens", F.col("queue").cast("long"), F.col("seg") + F.col("q_off"), "ids")
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
