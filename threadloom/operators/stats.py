"""Evaluation statistics over frames of labels and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def auc(rows: DataFrame, group: list[str], score: str, positive: str) -> DataFrame:
    """(group, n_pos, n_neg, auc) of groups with rows of both kinds: ties count half. Rows are first counted by
    score, so what is ranked grows with the number of different scores."""
    by_score = rows.groupBy(*group, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = by_score.withColumn("won", F.col("p") * (below + F.col("n") / 2))
    out = wins.groupBy(*group).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum("won").alias("won"))
    return out.where("n_pos > 0 AND n_neg > 0").select(*group, "n_pos", "n_neg", F.round(F.col("won") / (F.col("n_pos") * F.col("n_neg")), 6).alias("auc"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agreement and Cohen's kappa (null where chance is 1)."""
    cells = rows.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("c"))
    total = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy("x").agg(F.sum("c").alias("cx"))
    right = cells.groupBy(F.col("y").alias("x")).agg(F.sum("c").alias("cy"))
    chance = left.join(right, "x").agg(F.coalesce(F.sum(F.col("cx") * F.col("cy")), F.lit(0)).alias("chance"))
    both = total.crossJoin(F.broadcast(chance))  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return both.select("n", F.round(po, 6).alias("agreement"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The interval of a share k / n."""
    p, zz = k / n, z * z
    mid, spread, size = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)), 1 + zz / n
    return F.when(n > 0, (mid - spread) / size), F.when(n > 0, (mid + spread) / size)


def label_scores(rows: DataFrame, mine: str, theirs: str) -> DataFrame:
    """Precision, recall and F1 of each label."""
    ends = rows.select(F.explode(F.array(F.struct(F.col(mine).alias("label"), F.lit(1).alias("m"), F.lit(0).alias("t"), (F.col(mine) == F.col(theirs)).cast("int").alias("hit")), F.struct(F.col(theirs).alias("label"), F.lit(0).alias("m"), F.lit(1).alias("t"), F.lit(0).alias("hit")))).alias("x"))
    g = ends.groupBy("x.label").agg(F.sum("x.m").alias("mine"), F.sum("x.t").alias("theirs"), F.sum("x.hit").alias("hit"))
    rate = lambda n: F.round(F.when(F.col(n) > 0, F.col("hit") / F.col(n)), 6)
    return g.select("label", "mine", "theirs", "hit", rate("theirs").alias("precision"), rate("mine").alias("recall"), F.round(F.when(F.col("mine") + F.col("theirs") > 0, 2 * F.col("hit") / (F.col("mine") + F.col("theirs"))), 6).alias("f1"))
