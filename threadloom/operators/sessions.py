"""Sessions over timed segments: gap blocks, mode cuts, episodes, pseudonyms.

Segments have a session key, ``st`` and ``en`` (longs), ``id`` and ``me``. All
windows are partitioned by the session key; a session is one speaker stream, the
unit that the rules are sequential over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gap_blocks(segments: DataFrame, key: str, gap: int) -> DataFrame:
    """Adds ``blk``: a block begins where the start lies more than ``gap`` after
    the latest end so far."""
    order = Window.partitionBy(key).orderBy("st", "en", "id")
    before = F.max("en").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return segments.withColumn("__new", (before.isNull() | (F.col("st") - before > gap)).cast("int")).withColumn("blk", F.sum("__new").over(order)).drop("__new")


def mode_cuts(blocks: DataFrame, key: str, least: int, pause: int) -> DataFrame:
    """Adds ``part``: a block is cut between runs of my and others' segments where
    the pause is at least ``pause`` and one of the runs is mine and at least
    ``least`` long."""
    order = Window.partitionBy(key, "blk").orderBy("st", "en", "id")
    was = F.lag("me").over(order)
    rows = blocks.withColumn("__ch", (was.isNull() | (was != F.col("me"))).cast("int")).withColumn("isl", F.sum("__ch").over(order)).drop("__ch")
    runs = rows.groupBy(key, "blk", "isl").agg(F.min("st").alias("s0"), F.max("en").alias("e1"), F.first("me").alias("m"))
    runs = runs.withColumn("lng", F.col("m") & (F.col("e1") - F.col("s0") >= least))
    by = Window.partitionBy(key, "blk").orderBy("isl")
    cut = (F.col("s0") - F.lag("e1").over(by) >= pause) & (F.col("lng") | F.lag("lng").over(by))
    runs = runs.withColumn("part", F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(by))
    return rows.join(runs.select(key, "blk", "isl", "part"), [key, "blk", "isl"]).drop("isl")


def assembled(parts: DataFrame, key: str, speaker: str) -> DataFrame:
    """One row for each episode."""
    out = parts.groupBy(key, "blk", "part").agg(
        F.min("st").alias("started_us"),
        F.max("en").alias("ended_us"),
        F.count("*").alias("n_segments"),
        F.count_distinct(speaker).alias("n_speakers"),
        F.sum(F.col("me").cast("long")).alias("self_segments"),
    )
    return out.withColumn("kind", episode_kind(F.col("self_segments"), F.col("n_segments")))


def episode_kind(mine: Column, n: Column) -> Column:
    return F.when(mine == 0, "others_only").when(mine == n, "monologue").otherwise("conversation")


def lag_sessions(rows: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """Adds ``session``: a new one where the gap to the row before is at least
    ``gap`` (closed, unlike gap_blocks)."""
    order = Window.partitionBy(key).orderBy(time, "id")
    step = F.col(time) - F.lag(time).over(order)
    return rows.withColumn("__new", (step.isNull() | (step >= gap)).cast("int")).withColumn("session", F.sum("__new").over(order)).drop("__new")


def pseudonyms(lines: DataFrame, key: str, label: str, order: str, me: str) -> DataFrame:
    """(key, label, pseudonym): my label is ``me``, others S1, S2 ... by first
    appearance."""
    first = lines.groupBy(key, label).agg(F.min(order).alias("first"))
    others = Window.partitionBy(key, F.col(label) == me).orderBy("first", label)
    return first.select(key, label, F.when(F.col(label) == me, "me").otherwise(F.concat(F.lit("S"), F.row_number().over(others).cast("string"))).alias("pseudonym"))


def admitted(requests: DataFrame, partition: list[str], order: list[str], cost: str, cap: float) -> DataFrame:
    """Adds ``spent_before`` and ``admitted``: a request is let through while what
    was spent before it is below the cap, so the one that reaches it passes."""
    before = F.sum(cost).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    spent = F.coalesce(before, F.lit(0))
    return requests.withColumn("spent_before", spent).withColumn("admitted", F.col("spent_before") < cap)


def recurrences(rows: DataFrame, keys: list[str], time: str, apart: int) -> DataFrame:
    """(keys, recurrences): times counted if first or at least ``apart`` after the
    last counted one: a fold over the sorted times of a group."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last"))

    def step(s: Column, t: Column) -> Column:
        counts = s["last"].isNull() | (t - s["last"] >= apart)
        return F.struct((s["n"] + counts.cast("long")).alias("n"), F.when(counts, t).otherwise(s["last"]).alias("last"))

    times = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(time)).alias("__t"))
    return times.select(*keys, F.aggregate("__t", zero, step, lambda s: s["n"]).alias("recurrences"))
