"""Folds of an append-only event log (highest event id wins) over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom import primitives
from threadloom.operators import graph
from threadloom.plans import query, table


def log(spark, sf_dir) -> DataFrame:
    """(event_id, user_id, kind, k): the log with its payload's number."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k"), "value", "ts")


_LOG = "log AS (SELECT event_id, user_id, event_type AS kind, (props->>'$.k')::BIGINT AS k, value, ts FROM events)"


@query(f"WITH {_LOG} SELECT user_id, kind, max(event_id) AS event_id, arg_max(k, event_id) AS k FROM log GROUP BY 1, 2")
def latest_per_key(spark, sf_dir):
    """N1, C17, D16."""
    return primitives.latest_by(log(spark, sf_dir).select("user_id", "kind", "event_id", "k"), ["user_id", "kind"], ["event_id"])


@query(f"""
WITH {_LOG}, title AS (SELECT user_id, arg_max(k, event_id) AS t FROM log WHERE kind = 'view' GROUP BY 1), note AS (SELECT user_id, arg_max(k, event_id) AS t FROM log WHERE kind = 'click' GROUP BY 1),
u AS (SELECT DISTINCT user_id FROM log)
SELECT user_id, coalesce(CASE WHEN title.t % 3 <> 0 THEN 'title ' || title.t END, 'original ' || user_id) AS title, CASE WHEN note.t % 2 = 1 THEN 'note ' || note.t END AS note
FROM u LEFT JOIN title USING (user_id) LEFT JOIN note USING (user_id)
""")
def effective_text(spark, sf_dir):
    """The latest correction of each field; an empty one reverts. Both
    fields fold in one aggregate."""
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("k")), F.when(F.col("kind") == kind, F.col("event_id")))
    folded = log(spark, sf_dir).groupBy("user_id").agg(last("view").alias("t"), last("click").alias("n"))
    title = F.when(F.col("t") % 3 != 0, F.concat(F.lit("title "), F.col("t").cast("string")))
    return folded.select("user_id", F.coalesce(title, F.concat(F.lit("original "), F.col("user_id").cast("string"))).alias("title"), F.when(F.col("n") % 2 == 1, F.concat(F.lit("note "), F.col("n").cast("string"))).alias("note"))


@query(f"""
WITH {_LOG}, m AS (SELECT user_id, arg_max(kind, event_id) AS mark FROM log WHERE kind IN ('signup', 'error') GROUP BY 1), s AS (SELECT user_id, arg_max(k, event_id) AS star FROM log WHERE kind = 'purchase' GROUP BY 1)
SELECT user_id, CASE WHEN mark = 'signup' THEN 'canonical' WHEN mark = 'error' THEN NULL WHEN user_id % 4 = 0 THEN 'canonical' WHEN star % 2 = 0 THEN 'pinned' END AS kept_as,
  CASE WHEN star IS NULL THEN 'observation' WHEN star % 3 = 0 THEN 'candidate' ELSE 'idea' END AS maturity
FROM (SELECT DISTINCT user_id FROM log) LEFT JOIN m USING (user_id) LEFT JOIN s USING (user_id)
""")
def kept_state(spark, sf_dir):
    """M7, M8: two latest-wins folds and what they mean together."""
    of = lambda v, *kinds: F.max_by(F.when(F.col("kind").isin(*kinds), F.col(v)), F.when(F.col("kind").isin(*kinds), F.col("event_id")))
    folded = log(spark, sf_dir).groupBy("user_id").agg(of("kind", "signup", "error").alias("mark"), of("k", "purchase").alias("star"))
    kept = F.when(F.col("mark") == "signup", "canonical").when(F.col("mark") == "error", None).when(F.col("user_id") % 4 == 0, "canonical").when(F.col("star") % 2 == 0, "pinned")
    return folded.select("user_id", kept.alias("kept_as"), F.when(F.col("star").isNull(), "observation").when(F.col("star") % 3 == 0, "candidate").otherwise("idea").alias("maturity"))


@query(f"""
WITH {_LOG}, l AS (SELECT event_id, least(user_id % 10, k % 10) AS a, greatest(user_id % 10, k % 10) AS b, CASE WHEN kind = 'click' THEN 'link' ELSE 'unlink' END AS kind FROM log WHERE kind IN ('click', 'view') AND user_id % 10 <> k % 10),
mine AS (SELECT a, b, arg_max(kind, event_id) AS kind, max(event_id) AS event_id FROM l GROUP BY 1, 2),
stored AS (SELECT DISTINCT least(user_id % 10, k % 10) AS a, greatest(user_id % 10, k % 10) AS b FROM log WHERE kind = 'purchase' AND user_id % 10 <> k % 10),
methods AS (SELECT 'm1' AS method, quantile_disc(event_id, 0.98) AS seen FROM log)
SELECT a, b, 'mine' AS method FROM mine WHERE kind = 'link'
UNION ALL SELECT a, b, 'm1' FROM stored JOIN methods ON true WHERE NOT EXISTS (SELECT 1 FROM mine m WHERE m.a = stored.a AND m.b = stored.b AND (m.kind = 'link' OR m.event_id > seen))
""")
def link_state(spark, sf_dir):
    """Shown edges as known at an event."""
    e = log(spark, sf_dir).select("event_id", "kind", (F.col("user_id") % 10).alias("a"), (F.col("k") % 10).alias("b"))
    events = e.where("kind IN ('click', 'view')").withColumn("kind", F.when(F.col("kind") == "click", "link").otherwise("unlink"))
    stored = e.where("kind = 'purchase' AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit("m1").alias("method")).distinct()
    methods = e.agg(F.expr("percentile_disc(0.98) WITHIN GROUP (ORDER BY event_id)").cast("long").alias("seen_event_id")).select(F.lit("m1").alias("method"), "seen_event_id")
    return graph.shown_edges(stored, events, methods)


@query(f"""
WITH {_LOG}, d AS (SELECT user_id, arg_max(k % 4, event_id) FILTER (WHERE k % 5 <> 0) AS r FROM log WHERE kind = 'error' GROUP BY 1),
names AS (SELECT * FROM (VALUES (0, 'duplicate'), (1, 'wrong'), (2, 'dull'), (3, 'private'), (4, 'unknown')) t(r, reason))
SELECT reason, count(d.user_id) AS n FROM names LEFT JOIN d ON coalesce(d.r, 4) = names.r GROUP BY 1
""")
def dismiss_reasons(spark, sf_dir):
    """Each dismissed card once by its latest given reason; zero-filled."""
    given = F.when(F.col("k") % 5 != 0, F.col("k") % 4)
    last = log(spark, sf_dir).where("kind = 'error'").groupBy("user_id").agg(F.coalesce(F.max_by(given, F.when(given.isNotNull(), F.col("event_id"))), F.lit(4)).alias("r"))
    names = spark.createDataFrame([(0, "duplicate"), (1, "wrong"), (2, "dull"), (3, "private"), (4, "unknown")], "r long, reason string")
    return names.join(last.groupBy("r").agg(F.count("*").alias("n")), "r", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
WITH todo AS (SELECT o_orderkey AS key, md5(o_orderkey::VARCHAR || '|' || o_orderstatus) AS h FROM orders),
reads AS (SELECT DISTINCT l_orderkey AS key, md5(l_orderkey::VARCHAR || '|' || l_linestatus) AS h, 'v' || (l_linenumber % 3) AS v FROM lineitem WHERE l_linenumber <= 2)
SELECT state, count(*) AS n, sum(key)::BIGINT AS mark FROM (
  SELECT t.key, CASE WHEN bool_or(r.v = 'v2') THEN 'done' WHEN count(r.v) > 0 THEN 'held' ELSE 'due' END AS state FROM todo t LEFT JOIN reads r ON r.key = t.key AND r.h = t.h GROUP BY t.key, t.h) GROUP BY 1
""")
def reread_gate(spark, sf_dir):
    """Due, held or done by key, input hash and version."""
    digest = lambda k, s: F.md5(F.concat_ws("|", F.col(k).cast("string"), s))
    todo = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), digest("o_orderkey", "o_orderstatus").alias("h"))
    reads = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("key"), digest("l_orderkey", "l_linestatus").alias("h"), F.concat(F.lit("v"), (F.col("l_linenumber") % 3).cast("string")).alias("v"))
    return primitives.three_way_gate(todo, reads, "key", "h", "v", "v2").groupBy("state").agg(F.count("*").alias("n"), F.sum("key").alias("mark"))


@query(f"""
WITH {_LOG}, price AS (SELECT * FROM (VALUES ('view', 1.0, 5.0), ('click', 3.0, 15.0), ('purchase', 15.0, 75.0)) t(kind, i, o)),
r AS (SELECT user_id, k, kind, max(event_id) AS event_id FROM log GROUP BY 1, 2, 3),
c AS (SELECT r.kind, (r.k * 1000 * coalesce(i, 15.0) + 200 * coalesce(o, 75.0)) / 1000000 AS usd, i IS NULL AS unknown FROM r LEFT JOIN price USING (kind))
SELECT kind, count(*) AS requests, round(sum(usd), 4)::DOUBLE AS cost, bool_or(unknown) AS priced_as_dearest FROM c GROUP BY 1
""")
def reread_estimate(spark, sf_dir):
    """The cost of the last request for each shown payload; an
    unknown model counts as the dearest."""
    price = spark.createDataFrame([("view", 1.0, 5.0), ("click", 3.0, 15.0), ("purchase", 15.0, 75.0)], "kind string, i double, o double")
    last = log(spark, sf_dir).groupBy("user_id", "k", "kind").agg(F.max("event_id").alias("event_id"))
    usd = (F.col("k") * 1000 * F.coalesce("i", F.lit(15.0)) + 200 * F.coalesce("o", F.lit(75.0))) / 1_000_000
    return last.join(F.broadcast(price), "kind", "left").groupBy("kind").agg(F.count("*").alias("requests"), F.round(F.sum(usd), 4).alias("cost"), F.bool_or(F.col("i").isNull()).alias("priced_as_dearest"))


@query(f"""
WITH {_LOG}, s AS (SELECT user_id, count(*) FILTER (WHERE kind IN ('view', 'click')) AS mine, count(*) FILTER (WHERE kind = 'error') AS others, count(DISTINCT k) FILTER (WHERE kind = 'purchase') AS links, bool_or(kind = 'signup' AND k % 2 = 0) AS canonical FROM log GROUP BY 1)
SELECT user_id, round(mine + 0.25 * least(others, 4) + 0.5 * links + 2.0 * canonical::INT, 3)::DOUBLE AS weight FROM s
""")
def weights(spark, sf_dir):
    """O1, O2."""
    return _weights(log(spark, sf_dir))


def _weights(rows: DataFrame, others: float = 0.25, most: int = 4, linked: float = 0.5, canonical: float = 2.0) -> DataFrame:
    signals = rows.groupBy("user_id").agg(
        F.count_if(F.col("kind").isin("view", "click")).alias("mine"),
        F.count_if(F.col("kind") == "error").alias("others"),
        F.count_distinct(F.when(F.col("kind") == "purchase", F.col("k"))).alias("links"),
        F.bool_or((F.col("kind") == "signup") & (F.col("k") % 2 == 0)).alias("canonical"),
    )
    weight = F.col("mine") + others * F.least("others", F.lit(most)) + linked * F.col("links") + canonical * F.col("canonical").cast("int")
    return signals.select("user_id", F.round(weight, 3).alias("weight"))


_WEIGHT = "w AS (SELECT user_id, count(*) FILTER (WHERE kind IN ('view', 'click')) + 0.25 * least(count(*) FILTER (WHERE kind = 'error'), 4) + 0.5 * count(DISTINCT k) FILTER (WHERE kind = 'purchase') + 2.0 * bool_or(kind = 'signup' AND k % 2 = 0)::INT AS weight, max(event_id) AS last FROM log GROUP BY 1)"


@query(f"""
WITH {_LOG}, {_WEIGHT}, open AS (SELECT DISTINCT user_id FROM log WHERE kind = 'signup' AND event_id % 9 = 0), gone AS (SELECT user_id, arg_max(k, event_id) AS floor FROM log WHERE kind = 'error' AND event_id % 4 = 0 GROUP BY 1)
SELECT user_id, round(weight, 3)::DOUBLE AS weight, row_number() OVER (ORDER BY weight DESC, last DESC, user_id) AS place FROM w LEFT JOIN gone USING (user_id)
WHERE user_id NOT IN (SELECT user_id FROM open) AND (gone.floor IS NULL OR weight >= gone.floor + 1.0) QUALIFY place <= 10
""")
def proposals(spark, sf_dir):
    """Eligible by weight, dismissed ones only if they grew."""
    rows = log(spark, sf_dir)
    last = rows.groupBy("user_id").agg(F.max("event_id").alias("last"))
    open_ = rows.where("kind = 'signup' AND event_id % 9 = 0").select("user_id").distinct()
    gone = rows.where("kind = 'error' AND event_id % 4 = 0").groupBy("user_id").agg(F.max_by("k", "event_id").alias("at"))
    eligible = _weights(rows).join(last, "user_id").join(open_, "user_id", "left_anti").join(gone, "user_id", "left").where("at IS NULL OR weight >= at + 1.0")
    top = eligible.orderBy(F.desc("weight"), F.desc("last"), "user_id").limit(10)
    return top.select("user_id", "weight", F.row_number().over(Window.orderBy(F.desc("weight"), F.desc("last"), "user_id")).cast("long").alias("place"))


@query(f"""
WITH {_LOG}, {_WEIGHT}, v AS (SELECT user_id, count(*) FILTER (WHERE kind IN ('view', 'click')) + 1.0 * least(count(*) FILTER (WHERE kind = 'error'), 8) + 0.5 * count(DISTINCT k) FILTER (WHERE kind = 'purchase') + 2.0 * bool_or(kind = 'signup' AND k % 2 = 0)::INT AS weight FROM log GROUP BY 1)
SELECT user_id, round(w.weight, 3)::DOUBLE AS before, round(v.weight, 3)::DOUBLE AS after FROM w JOIN v USING (user_id) ORDER BY abs(v.weight - w.weight) DESC, user_id LIMIT 12
""")
def tune(spark, sf_dir):
    """The largest moves under other settings."""
    rows = log(spark, sf_dir)
    both = _weights(rows).withColumnRenamed("weight", "before").join(_weights(rows, others=1.0, most=8).withColumnRenamed("weight", "after"), "user_id", "full")
    return both.orderBy(F.abs(F.col("after") - F.col("before")).desc(), "user_id").limit(12)


@query(f"""
WITH {_LOG}, v AS (SELECT event_id, user_id, kind, k, lag(kind) OVER w AS pk, lag(k) OVER w AS pn FROM (SELECT * FROM log WHERE kind IN ('view', 'click', 'purchase')) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT CASE WHEN kind IS NOT DISTINCT FROM pk AND k % 2 = pn % 2 THEN 'repeat' ELSE 'applied' END AS result, kind, count(*) AS n FROM v GROUP BY 1, 2
""")
def item_verdicts(spark, sf_dir):
    """An event that says what the latest said is a repeat."""
    rows = log(spark, sf_dir).where("kind IN ('view', 'click', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("event_id")
    same = F.lag("kind").over(w).eqNullSafe(F.col("kind")) & (F.lag("k").over(w) % 2 == F.col("k") % 2)
    return rows.select("kind", F.when(same, "repeat").otherwise("applied").alias("result")).groupBy("result", "kind").agg(F.count("*").alias("n"))


@query("""
SELECT 'no user' AS rule, count(*) AS n FROM events WHERE user_id IS NULL UNION ALL SELECT 'unknown kind', count(*) FROM events WHERE event_type NOT IN ('click', 'error', 'purchase', 'signup', 'view')
UNION ALL SELECT 'no payload', count(*) FROM events WHERE props->>'$.k' IS NULL UNION ALL SELECT 'negative', count(*) FROM events WHERE value < 0
""")
def event_constraints(spark, sf_dir):
    """All rules in one pass, one row each."""
    rules = {
        "no user": F.col("user_id").isNull(), "unknown kind": ~F.col("event_type").isin("click", "error", "purchase", "signup", "view"),
        "no payload": F.get_json_object("props", "$.k").isNull(), "negative": F.col("value") < 0,
    }
    counts = table(spark, sf_dir, "events").agg(*[F.count_if(c).alias(name) for name, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n")) for n in rules])).alias("x")).select("x.*")
