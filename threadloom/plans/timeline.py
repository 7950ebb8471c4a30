"""Sessions, windows in time, corrections and deletions, over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators import sessions
from threadloom.plans import query, table
from threadloom.primitives import interval_join

SECOND = 1_000_000


def segments(spark, sf_dir) -> DataFrame:
    """Events as segments: a user's stream, lasting ``value`` seconds."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", us.alias("st"), (us + F.floor(F.col("value") * SECOND).cast("long")).alias("en"), F.col("event_type").isin("purchase", "view", "click").alias("me"), "event_type", "value"
    )


_SEG = "seg AS (SELECT event_id AS id, user_id, epoch_us(ts) AS st, epoch_us(ts) + floor(value * 1000000)::BIGINT AS en, event_type IN ('purchase', 'view', 'click') AS me, event_type, value FROM events)"


@query(f"""
WITH {_SEG}, a AS (
  SELECT *, max(en) OVER (PARTITION BY user_id ORDER BY st, en, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM seg
), b AS (
  SELECT *, sum((pe IS NULL OR st - pe > 21600000000)::INT) OVER (PARTITION BY user_id ORDER BY st, en, id) AS blk FROM a
), c AS (
  SELECT *, coalesce((lag(me) OVER (PARTITION BY user_id, blk ORDER BY st, en, id) <> me)::INT, 1) AS ch FROM b
), d AS (
  SELECT *, sum(ch) OVER (PARTITION BY user_id, blk ORDER BY st, en, id) AS isl FROM c
), r AS (
  SELECT user_id, blk, isl, min(st) AS s0, max(en) AS e1, bool_and(me) AND max(en) - min(st) >= 3600000000 AS lng FROM d GROUP BY ALL
), q AS (
  SELECT *, lag(e1) OVER w AS e0, lag(lng) OVER w AS l0 FROM r WINDOW w AS (PARTITION BY user_id, blk ORDER BY isl)
), p AS (
  SELECT user_id, blk, isl, sum(coalesce((s0 - e0 >= 600000000 AND (lng OR l0))::INT, 0)) OVER (PARTITION BY user_id, blk ORDER BY isl) AS part FROM q
)
SELECT user_id, blk::BIGINT AS block, part::BIGINT AS part, min(st) AS started_us, max(en) AS ended_us, count(*) AS n_segments,
  count(DISTINCT event_type) AS n_speakers, sum(me::INT)::BIGINT AS self_segments,
  CASE WHEN sum(me::INT) = 0 THEN 'others_only' WHEN sum(me::INT) = count(*) THEN 'monologue' ELSE 'conversation' END AS kind
FROM d JOIN p USING (user_id, blk, isl) GROUP BY user_id, blk, part
""")
def episodes(spark, sf_dir):
    """G1 to G3, E7."""
    blocks = sessions.gap_blocks(segments(spark, sf_dir), "user_id", 21_600 * SECOND)
    parts = sessions.mode_cuts(blocks, "user_id", 3_600 * SECOND, 600 * SECOND)
    return sessions.assembled(parts, "user_id", "event_type").withColumnRenamed("blk", "block")


@query(f"""
WITH {_SEG}, a AS (SELECT *, st - lag(st) OVER (PARTITION BY user_id ORDER BY st, id) AS step FROM seg),
b AS (SELECT *, sum((step IS NULL OR step >= 21600000000)::INT) OVER (PARTITION BY user_id ORDER BY st, id) AS session FROM a)
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(st) AS first_us, max(st) AS last_us FROM b GROUP BY 1, 2
""")
def typed_sessions(spark, sf_dir):
    """G5."""
    rows = sessions.lag_sessions(segments(spark, sf_dir), "user_id", "st", 21_600 * SECOND)
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("st").alias("first_us"), F.max("st").alias("last_us"))


@query(f"""
WITH {_SEG}
SELECT t.id AS tap_id, count(*) AS n_lines, min(l.id) AS first_line, max(l.id) AS last_line
FROM seg t JOIN seg l ON t.user_id = l.user_id AND l.st <= t.st + 7200000000 AND l.en >= t.st - 7200000000 AND l.event_type <> 'error'
WHERE t.event_type = 'error' GROUP BY t.id
""")
def tap_windows(spark, sf_dir):
    """Lines in a closed window around an instant."""
    seg, reach = segments(spark, sf_dir), 7_200 * SECOND
    taps = seg.where("event_type = 'error'").select("user_id", F.col("id").alias("tap_id"), (F.col("st") - reach).alias("l_start"), (F.col("st") + reach).alias("l_end"))
    lines = seg.where("event_type <> 'error'").select("user_id", "id", F.col("st").alias("r_start"), F.col("en").alias("r_end"))
    met = interval_join(taps, lines, 6 * 3_600 * SECOND, on=["user_id"], closed=True)
    return met.groupBy("tap_id").agg(F.count("*").alias("n_lines"), F.min("id").alias("first_line"), F.max("id").alias("last_line"))


@query(f"""
WITH {_SEG}, r AS (
  SELECT n.id AS note_id, l.id, l.st, row_number() OVER (PARTITION BY n.id ORDER BY l.st, l.id) AS k
  FROM seg n JOIN seg l ON n.user_id = l.user_id AND l.st > n.st AND l.st <= n.st + 86400000000 WHERE n.event_type = 'signup'
)
SELECT s.id AS note_id, coalesce(string_agg(r.id::VARCHAR, ',' ORDER BY r.st, r.id), '') AS followers
FROM seg s LEFT JOIN r ON r.note_id = s.id AND k <= 3 WHERE s.event_type = 'signup' GROUP BY s.id
""")
def note_followers(spark, sf_dir):
    """C11: the next three rows within a horizon, by one window."""
    seg = segments(spark, sf_dir)
    order = Window.partitionBy("user_id").orderBy("st", "id")
    next_ = F.array(*[F.struct(F.lead("st", k).over(order).alias("t"), F.lead("id", k).over(order).alias("i")) for k in (1, 2, 3)])
    kept = F.filter("next", lambda x: (x["t"] > F.col("st")) & (x["t"] <= F.col("st") + 86_400 * SECOND))
    return seg.withColumn("next", next_).where("event_type = 'signup'").select(F.col("id").alias("note_id"), F.array_join(F.transform(kept, lambda x: x["i"].cast("string")), ",").alias("followers"))


@query(f"WITH {_SEG} SELECT o.id AS old_id, n.id AS new_id FROM seg o JOIN seg n ON o.st < n.en AND n.st < o.en WHERE o.event_type = 'view' AND n.event_type = 'click'")
def time_overlap_links(spark, sf_dir):
    """Strict overlap, against all arrivals."""
    seg = segments(spark, sf_dir)
    old = seg.where("event_type = 'view'").select(F.col("id").alias("old_id"), F.col("st").alias("l_start"), F.col("en").alias("l_end"))
    new = seg.where("event_type = 'click'").select(F.col("id").alias("new_id"), F.col("st").alias("r_start"), F.col("en").alias("r_end"))
    return interval_join(old, new, 600 * SECOND).select("old_id", "new_id")


@query(f"""
WITH {_SEG}, spans AS (SELECT st AS a, st + floor(value * 60000000)::BIGINT AS b FROM seg WHERE event_type = 'signup' AND id % 20 = 0),
gone AS (SELECT DISTINCT s.id FROM seg s JOIN spans ON s.st < b AND a < s.en)
SELECT user_id, count(*) FILTER (WHERE g.id IS NULL) AS kept, count(*) FILTER (WHERE g.id IS NOT NULL) AS purged
FROM seg s LEFT JOIN gone g ON g.id = s.id GROUP BY user_id
""")
def tombstone_purge(spark, sf_dir):
    """Every segment that overlaps a forgotten span goes."""
    seg = segments(spark, sf_dir)
    spans = seg.where("event_type = 'signup' AND id % 20 = 0").select(F.col("st").alias("r_start"), (F.col("st") + F.floor(F.col("value") * 60 * SECOND).cast("long")).alias("r_end"))
    hit = interval_join(seg.select("id", F.col("st").alias("l_start"), F.col("en").alias("l_end")), spans, 3_600 * SECOND).select("id", F.lit(True).alias("hit")).distinct()
    return seg.join(hit, "id", "left").groupBy("user_id").agg(F.count_if(F.col("hit").isNull()).alias("kept"), F.count_if(F.col("hit").isNotNull()).alias("purged"))


@query("""
WITH o AS (SELECT event_id, user_id, event_type FROM events WHERE event_id % 7 <> 0),
n AS (SELECT event_id, user_id, CASE WHEN event_id % 13 = 0 THEN 'error' ELSE event_type END AS event_type FROM events WHERE event_id % 11 <> 0)
SELECT coalesce(n.user_id, o.user_id) AS user_id, count(*) FILTER (WHERE o.event_id IS NULL) AS arrived, count(*) FILTER (WHERE n.event_id IS NULL) AS gone,
  count(*) FILTER (WHERE o.event_type IS DISTINCT FROM n.event_type AND o.event_id IS NOT NULL AND n.event_id IS NOT NULL) AS relabelled,
  count(*) FILTER (WHERE o.event_type = n.event_type) AS same
FROM o FULL JOIN n USING (event_id) GROUP BY 1
""")
def revision_diff(spark, sf_dir):
    """What a new revision brings, drops and relabels."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    old = e.where("event_id % 7 <> 0").select("event_id", F.col("user_id").alias("ou"), F.col("event_type").alias("ot"))
    new = e.where("event_id % 11 <> 0").select("event_id", F.col("user_id").alias("nu"), F.when(F.col("event_id") % 13 == 0, "error").otherwise(F.col("event_type")).alias("nt"))
    both = old.join(new, "event_id", "full")
    had, has = F.col("ou").isNotNull(), F.col("nu").isNotNull()
    return both.groupBy(F.coalesce("nu", "ou").alias("user_id")).agg(
        F.count_if(~had).alias("arrived"), F.count_if(~has).alias("gone"), F.count_if(had & has & ~F.col("ot").eqNullSafe(F.col("nt"))).alias("relabelled"), F.count_if(F.col("ot") == F.col("nt")).alias("same")
    )


@query("""
WITH c AS (SELECT event_id, user_id, ts, (value * 100)::BIGINT AS cents FROM events),
s AS (SELECT *, coalesce(sum(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT user_id, count(*) FILTER (WHERE before < 20000) AS admitted, count(*) FILTER (WHERE before >= 20000) AS refused, coalesce(sum(cents) FILTER (WHERE before < 20000), 0)::BIGINT AS spent_cents FROM s GROUP BY 1
""")
def budget_gate(spark, sf_dir):
    """A request passes while what was spent before it is below the cap."""
    cents = table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    gated = sessions.admitted(cents, ["user_id"], ["event_id"], "cents", 20_000)
    return gated.groupBy("user_id").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused"), F.coalesce(F.sum(F.when(F.col("admitted"), F.col("cents"))), F.lit(0)).alias("spent_cents"))


@query("""
WITH w AS (SELECT date_trunc('week', ts)::TIMESTAMP AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT epoch_us(week) AS week_us, event_type, n, row_number() OVER (PARTITION BY week ORDER BY n DESC, event_type) AS place, round(n * 100.0 / sum(n) OVER (PARTITION BY week), 3)::DOUBLE AS pct FROM w
""")
def weekly_digest(spark, sf_dir):
    """Counts by week and kind, in order, with their share."""
    w = table(spark, sf_dir, "events").groupBy(F.date_trunc("week", "ts").cast("timestamp").alias("week"), "event_type").agg(F.count("*").alias("n"))
    by = Window.partitionBy("week")
    return w.select(F.unix_micros("week").alias("week_us"), "event_type", "n", F.row_number().over(by.orderBy(F.desc("n"), "event_type")).cast("long").alias("place"), F.round(F.col("n") * 100.0 / F.sum("n").over(by), 3).alias("pct"))


@query("""
SELECT epoch_us(date_trunc('month', o_orderdate)::TIMESTAMP) AS month_us, count(*) AS orders,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')) AS unread,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')) = 0 AS complete
FROM orders GROUP BY 1
""")
def completeness_gate(spark, sf_dir):
    """A period is ready when nothing in it is unread (semi-join flag)."""
    read = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("read")).distinct()
    unread = F.count_if(F.col("read").isNull())
    month = F.unix_micros(F.date_trunc("month", "o_orderdate").cast("timestamp")).alias("month_us")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(read, "o_orderkey", "left").groupBy(month).agg(F.count("*").alias("orders"), unread.alias("unread"), (unread == 0).alias("complete"))


@query(f"""
WITH {_SEG}
SELECT r.id AS run_id, count(c.id) AS requests, coalesce(sum((c.value * 100)::BIGINT), 0)::BIGINT AS cost_cents
FROM seg r LEFT JOIN seg c ON c.user_id = r.user_id AND c.st >= r.st AND c.st < r.st + 259200000000 AND c.id <> r.id WHERE r.event_type = 'signup' GROUP BY r.id
""")
def run_cost_intervals(spark, sf_dir):
    """Cost between a run's start and finish, by one range frame."""
    seg = segments(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    ahead = Window.partitionBy("user_id").orderBy("st").rangeBetween(0, 259_200 * SECOND - 1)
    seg = seg.withColumns({"n": F.count("*").over(ahead) - 1, "c": F.sum("cents").over(ahead) - F.col("cents")})
    return seg.where("event_type = 'signup'").select(F.col("id").alias("run_id"), F.col("n").alias("requests"), F.col("c").alias("cost_cents"))


@query("""
WITH RECURSIVE r AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE event_type IN ('view', 'click')),
f AS (SELECT user_id, k, t AS last, 1 AS n FROM r WHERE k = 1
  UNION ALL SELECT f.user_id, r.k, CASE WHEN r.t - f.last >= 43200000000 THEN r.t ELSE f.last END, f.n + (r.t - f.last >= 43200000000)::INT FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
SELECT user_id, max(n)::BIGINT AS recurrences FROM f GROUP BY 1
""")
def recurrences(spark, sf_dir):
    """Times at least half a day after the last counted one."""
    rows = segments(spark, sf_dir).where("event_type IN ('view', 'click')")
    return sessions.recurrences(rows, ["user_id"], "st", 43_200 * SECOND)


@query(f"""
WITH {_SEG}, m AS (SELECT user_id, st, id, value FROM seg),
v AS (SELECT user_id, min(st) AS first_us FROM m GROUP BY 1)
SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY st, id) AS step, dense_rank() OVER (ORDER BY first_us, user_id) AS trail FROM m JOIN v USING (user_id) WHERE value > 90
""")
def trails(spark, sf_dir):
    """Moments in order on trails numbered by first appearance. Only the
    small table of trails is ranked globally, not the moments."""
    seg = segments(spark, sf_dir)
    first = seg.groupBy("user_id").agg(F.min("st").alias("first_us"))
    shown = seg.where("value > 90")
    present = first.join(shown.select("user_id").distinct(), "user_id", "left_semi")
    numbered = present.select("user_id", F.dense_rank().over(Window.orderBy("first_us", "user_id")).cast("long").alias("trail"))
    return shown.join(numbered, "user_id").select("id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("st", "id")).cast("long").alias("step"), "trail")
