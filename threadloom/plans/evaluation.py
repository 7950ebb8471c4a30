"""Statistics and invariants over ``documents``, ``labels`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import sessions, stats
from threadloom.plans import query, table, timeline


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


_L = "l AS (SELECT labels.*, lang, n_chars FROM labels JOIN documents USING (doc_id))"


@query(f"""
WITH {_L} SELECT a.lang, count(DISTINCT a.doc_id) AS n_pos, count(DISTINCT b.doc_id) AS n_neg, round(avg(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0.0 END), 6)::DOUBLE AS auc
FROM l a JOIN l b ON a.lang = b.lang AND a.quality = 1 AND b.quality = 0 GROUP BY 1
""")
def auc(spark, sf_dir):
    """By ranks, not by pairs."""
    return stats.auc(_labelled(spark, sf_dir).withColumn("pos", F.col("quality") == 1), ["lang"], "n_chars", "pos")


@query("""
WITH t AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, (sum((quality = 1)::INT) * sum((toxic = 1)::INT) + sum((quality = 0)::INT) * sum((toxic = 0)::INT)) / (count(*) * count(*))::DOUBLE AS pe FROM labels)
SELECT n, round(po, 6)::DOUBLE AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6)::DOUBLE AS kappa FROM t
""")
def kappa(spark, sf_dir):
    """P2."""
    return stats.kappa(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(f"""
WITH {_L}, g AS (SELECT lang, sum(toxic)::DOUBLE AS k, count(*)::DOUBLE AS n FROM l GROUP BY 1)
SELECT lang, round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM g
""")
def wilson(spark, sf_dir):
    """P3, P8."""
    g = _labelled(spark, sf_dir).groupBy("lang").agg(F.sum("toxic").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("lang", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_P = "p AS (SELECT CASE WHEN quality = 1 THEN 'good' WHEN toxic = 1 THEN 'bad' ELSE 'other' END AS mine, CASE WHEN n_chars > 1500 THEN 'good' WHEN n_chars > 700 THEN 'other' ELSE 'bad' END AS theirs FROM l)"


@query(f"""
WITH {_L}, {_P}, m AS (SELECT mine AS label, count(*) AS mine, sum((mine = theirs)::INT)::BIGINT AS hit FROM p GROUP BY 1), t AS (SELECT theirs AS label, count(*) AS theirs FROM p GROUP BY 1)
SELECT label, coalesce(mine, 0) AS mine, coalesce(theirs, 0) AS theirs, coalesce(hit, 0) AS hit, round(hit / theirs::DOUBLE, 6) AS precision, round(hit / mine::DOUBLE, 6) AS recall, round(2 * hit / (mine + theirs)::DOUBLE, 6) AS f1 FROM m FULL JOIN t USING (label)
""")
def label_scores(spark, sf_dir):
    """P4, P7, P14."""
    n = F.col("n_chars")
    p = _labelled(spark, sf_dir).select(F.when(F.col("quality") == 1, "good").when(F.col("toxic") == 1, "bad").otherwise("other").alias("mine"), F.when(n > 1500, "good").when(n > 700, "other").otherwise("bad").alias("theirs"))
    return stats.label_scores(p, "mine", "theirs")


@query(f"""
WITH {_L}, c AS (SELECT unnest([200, 500, 1000, 2000, 4000]) AS cut)
SELECT cut, count(*) FILTER (WHERE n_chars >= cut) AS shown, count(*) FILTER (WHERE n_chars >= cut AND quality = 1) AS hit, round(count(*) FILTER (WHERE n_chars >= cut AND quality = 1) / nullif(count(*) FILTER (WHERE n_chars >= cut), 0)::DOUBLE, 6) AS precision, round(count(*) FILTER (WHERE n_chars >= cut AND quality = 1) / nullif(count(*) FILTER (WHERE quality = 1), 0)::DOUBLE, 6) AS recall
FROM l, c GROUP BY 1
""")
def metrics_by_cut(spark, sf_dir):
    """P5: all cuts in one pass, as columns turned to rows."""
    cuts = (200, 500, 1000, 2000, 4000)
    good, n = F.col("quality") == 1, F.col("n_chars")
    one = _labelled(spark, sf_dir).agg(F.count_if(good).alias("good"), *[F.count_if(n >= c).alias(f"s{c}") for c in cuts], *[F.count_if((n >= c) & good).alias(f"h{c}") for c in cuts])
    rows = one.select("good", F.inline(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"s{c}").alias("shown"), F.col(f"h{c}").alias("hit")) for c in cuts])))
    rate = lambda of: F.round(F.when(F.col(of) > 0, F.col("hit") / F.col(of)), 6)
    return rows.select("cut", "shown", "hit", rate("shown").alias("precision"), rate("good").alias("recall"))


@query(f"""
WITH {_L}, g AS (SELECT a, b FROM (SELECT unnest([300, 600, 900, 1200]) AS a), (SELECT unnest([1500, 2500, 3500]) AS b)),
m AS (SELECT a, b, avg(((n_chars BETWEEN a AND b) = (quality = 1))::INT) AS agreement, count(*) FILTER (WHERE n_chars BETWEEN a AND b AND quality = 1) / nullif(count(*) FILTER (WHERE n_chars BETWEEN a AND b), 0)::DOUBLE AS precision FROM l, g GROUP BY 1, 2)
SELECT a, b, round(agreement, 6)::DOUBLE AS agreement, row_number() OVER (ORDER BY coalesce(precision, 0) >= 0.5 DESC, agreement DESC, a, b) AS place FROM m
""")
def grid_search(spark, sf_dir):
    """A grid of two cuts; counts by length once, then the small grid."""
    spark_counts = _labelled(spark, sf_dir).groupBy("n_chars").agg(F.count_if(F.col("quality") == 1).alias("p"), F.count_if(F.col("quality") == 0).alias("n"))
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (300, 600, 900, 1200) for b in (1500, 2500, 3500)])
    inside = F.col("n_chars").between(F.col("a"), F.col("b"))
    m = spark_counts.select("*", F.inline(grid)).groupBy("a", "b").agg(F.sum(F.when(inside, F.col("p")).otherwise(F.col("n"))).alias("same"), F.sum(F.col("p") + F.col("n")).alias("all"), F.sum(F.when(inside, F.col("p")).otherwise(0)).alias("hit"), F.sum(F.when(inside, F.col("p") + F.col("n")).otherwise(0)).alias("shown"))
    from pyspark.sql.window import Window

    m = m.withColumn("agreement", F.col("same") / F.col("all")).withColumn("ok", F.coalesce(F.col("hit") / F.when(F.col("shown") > 0, F.col("shown")), F.lit(0.0)) >= 0.5)
    place = F.row_number().over(Window.orderBy(F.desc("ok"), F.desc("agreement"), "a", "b"))
    return m.select("a", "b", F.round("agreement", 6).alias("agreement"), place.cast("long").alias("place"))


@query("""
SELECT * FROM (VALUES ('empty', 0::BIGINT), ('overlapping', 0::BIGINT), ('lost', 0::BIGINT), ('out of order', 0::BIGINT), ('wrong kind', 0::BIGINT)) t(rule, violations)
""")
def invariants(spark, sf_dir):
    """Rules that episodes must keep, each with how often it is broken."""
    seg = timeline.segments(spark, sf_dir)
    blocks = sessions.gap_blocks(seg, "user_id", 21_600 * timeline.SECOND)
    parts = sessions.mode_cuts(blocks, "user_id", 3_600 * timeline.SECOND, 600 * timeline.SECOND)
    ep = sessions.assembled(parts, "user_id", "event_type")
    from pyspark.sql.window import Window

    late = F.col("started_us") < F.lag("started_us").over(Window.partitionBy("user_id").orderBy("blk", "part"))
    wrong = (F.col("kind") == "others_only") != (F.col("self_segments") == 0)
    counts = ep.withColumns({"late": late, "wrong": wrong}).agg(F.count_if(F.col("n_segments") < 1).alias("a"), F.count_if(F.col("late")).alias("d"), F.count_if(F.col("wrong")).alias("e"), F.sum("n_segments").alias("n"))
    rows = seg.agg(F.count("*").alias("all"))
    twice = parts.groupBy("id").count().where("count > 1").agg(F.count("*").alias("b"))
    one = counts.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(twice))  # one row each
    names = {"empty": F.col("a"), "overlapping": F.col("b"), "lost": F.col("all") - F.col("n"), "out of order": F.col("d"), "wrong kind": F.col("e")}
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("violations")) for k, v in names.items()])))
