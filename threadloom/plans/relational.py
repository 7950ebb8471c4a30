"""Joins, aggregates, windows, samples and scores over the sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.plans import query, table
from threadloom.primitives import hash_sample, ordered_text


@query("""
SELECT c_custkey AS card, count(DISTINCT o_orderkey) AS observations, count(DISTINCT o_orderkey) FILTER (WHERE l_returnflag = 'N') AS mine, count(DISTINCT o_orderkey) FILTER (WHERE l_returnflag = 'R') AS relayed,
  count(DISTINCT l_partkey) AS conversations, epoch_us(min(o_orderdate)) AS first_us, epoch_us(max(o_orderdate)) AS last_us
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'N') > 0
""")
def cards(spark, sf_dir):
    """Several distinct counts in one pass, filtered after."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    us = lambda f: F.unix_micros(f("o_orderdate").cast("timestamp"))
    of = lambda flag: F.count_distinct(F.when(F.col("l_returnflag") == flag, F.col("o_orderkey")))
    out = joined.groupBy(F.col("c_custkey").alias("card")).agg(
        F.count_distinct("o_orderkey").alias("observations"), of("N").alias("mine"), of("R").alias("relayed"), F.count_distinct("l_partkey").alias("conversations"),
        us(F.min).alias("first_us"), us(F.max).alias("last_us"), F.count_if(F.col("l_returnflag") == "N").alias("__n"),
    )
    return out.where("__n > 0").drop("__n")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'A' DESC, l_returnflag = 'R' DESC, l_shipdate, l_partkey, l_linenumber) = 1
""")
def evidence_once(spark, sf_dir):
    """One row for each key by several criteria: an aggregate, no sort."""
    order = F.struct((F.col("l_returnflag") != "A").cast("int"), (F.col("l_returnflag") != "R").cast("int"), "l_shipdate", "l_partkey", "l_linenumber")
    li = table(spark, sf_dir, "lineitem")
    best = li.groupBy("l_orderkey").agg(F.min_by(F.struct("l_linenumber", "l_partkey", "l_returnflag"), order).alias("x"))
    return best.select("l_orderkey", "x.*")


@query("""
SELECT doc_id, CASE WHEN coalesce(toxic, 0) = 1 OR doc_id % 17 = 0 THEN NULL ELSE md5(text) END AS shown, n_chars, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT (coalesce(quality, 1) = 0 AND coalesce(toxic, 0) = 1)
""")
def sensitivity_redaction(spark, sf_dir):
    """Rows hidden, texts blanked, counts kept."""
    labels = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", "lang").join(labels, "doc_id", "left")
    toxic = F.coalesce("toxic", F.lit(0)) == 1
    hidden = (F.coalesce("quality", F.lit(1)) == 0) & toxic
    return d.where(~hidden).select("doc_id", F.when(~(toxic | (F.col("doc_id") % 17 == 0)), F.md5("text")).alias("shown"), "n_chars", "lang")


@query("""
WITH s AS (SELECT s_nationkey AS k, count(*) AS seen FROM supplier WHERE s_acctbal > 0 GROUP BY 1), c AS (SELECT c_nationkey AS k, max(c_name) AS name FROM customer WHERE c_custkey % 40 = 1 GROUP BY 1)
SELECT coalesce(s.k, c.k) AS nation, coalesce(seen, 0) AS seen, coalesce(name, 'none') AS name, CASE WHEN c.k IS NULL THEN 'proposed' WHEN s.k IS NULL THEN 'decided' ELSE 'both' END AS status FROM s FULL JOIN c ON s.k = c.k
""")
def mishearings_full_join(spark, sf_dir):
    """C3, M21, M30."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("seen"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 40 = 1").groupBy(F.col("c_nationkey").alias("nation")).agg(F.max("c_name").alias("name"))
    status = F.when(F.col("name").isNull(), "proposed").when(F.col("seen").isNull(), "decided").otherwise("both")
    return s.join(c, "nation", "full").select("nation", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("name", F.lit("none")).alias("name"), status.alias("status"))


@query("SELECT p_partkey, round(0.7 * p_size / 50.0 + 0.2 * least(1.0, ln(1 + p_partkey % 5) / ln(4)) + 0.1 * (p_brand LIKE '%3')::INT, 6)::DOUBLE AS score FROM part")
def idea_scores_v1(spark, sf_dir):
    """M28, B1."""
    score = 0.7 * F.col("p_size") / 50.0 + 0.2 * F.least(F.lit(1.0), F.ln(1 + F.col("p_partkey") % 5) / F.ln(F.lit(4.0))) + 0.1 * F.col("p_brand").like("%3").cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query("SELECT s_suppkey, round(0.65 * (2 * (s_suppkey % 4) + s_suppkey % 3 + s_suppkey % 5 + 2 * (s_suppkey % 2) - 6) / 24.0 + 0.25 * (s_acctbal > 5000)::INT + 0.1 * (s_nationkey = 3)::INT, 6)::DOUBLE AS score FROM supplier")
def idea_scores_v2(spark, sf_dir):
    """M28."""
    k = F.col("s_suppkey")
    score = 0.65 * (2 * (k % 4) + k % 3 + k % 5 + 2 * (k % 2) - 6) / 24.0 + 0.25 * (F.col("s_acctbal") > 5000).cast("int") + 0.1 * (F.col("s_nationkey") == 3).cast("int")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(score, 6).alias("score"))


@query("""
WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rk FROM part),
p AS (SELECT a.p_brand, a.p_partkey AS a, b.p_partkey AS b, a.rk, b.rk - a.rk AS gap FROM r a JOIN r b ON a.p_brand = b.p_brand AND b.rk BETWEEN a.rk + 1 AND a.rk + 5)
SELECT p_brand, a, b, gap, row_number() OVER (PARTITION BY p_brand ORDER BY gap, rk, a) AS place FROM p WHERE (a + b) % 3 <> 0 QUALIFY place <= 20
""")
def compare_pairs(spark, sf_dir):
    """A band join on ranks as one window of leads."""
    by = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    r = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("a"), F.row_number().over(by).alias("rk"), F.array(*[F.struct(F.lit(g).alias("gap"), F.lead("p_partkey", g).over(by).alias("b")) for g in range(1, 6)]).alias("next"))
    p = r.select("p_brand", "a", "rk", F.inline("next")).where("b IS NOT NULL AND (a + b) % 3 <> 0")
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("gap", "rk", "a"))
    return p.withColumn("place", place).where("place <= 20").select("p_brand", "a", "b", F.col("gap").cast("long"), F.col("place").cast("long"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0 ORDER BY md5('s1' || doc_id::VARCHAR), doc_id LIMIT 50")
def hash_samples(spark, sf_dir):
    """A sample that keeps its prefix as it grows."""
    return hash_sample(table(spark, sf_dir, "documents").where("doc_id % 3 <> 0"), "doc_id", 50, "s1").select("doc_id", "lang")


@query("""
WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n, c_nationkey FROM customer),
k AS (SELECT c_nationkey, n, unnest(range(5)) AS k FROM (SELECT DISTINCT c_nationkey, n FROM r))
SELECT DISTINCT r.c_nationkey, r.c_custkey FROM r JOIN k ON k.c_nationkey = r.c_nationkey AND r.i = round_even(k.k * (k.n - 1) / 4.0, 0)::BIGINT
""")
def spread_sample(spark, sf_dir):
    """evenly spread rows of an order, banker's rounding."""
    by = Window.partitionBy("c_nationkey")
    r = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.row_number().over(by.orderBy("c_acctbal", "c_custkey")) - 1).alias("i"), F.count("*").over(by).alias("n"))
    spots = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.bround(k * (F.col("n") - 1) / 4.0).cast("long"))
    return r.where(F.array_contains(spots, F.col("i").cast("long"))).select("c_nationkey", "c_custkey")


@query("""
WITH q AS (SELECT c_custkey, c_mktsegment, ntile(5) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS quintile, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rk, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS pos FROM customer),
k AS (SELECT unnest([10, 25, 50, 100]) AS k)
SELECT 'quintile' AS what, quintile AS place, count(*) AS n, sum(pos::INT)::BIGINT AS pos FROM q GROUP BY 2 UNION ALL SELECT 'top', k, count(*), sum(pos::INT)::BIGINT FROM q JOIN k ON rk <= k GROUP BY 2
""")
def coverage_quintiles_topk(spark, sf_dir):
    """P16, E4, E5."""
    by = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    has = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("pos")).distinct()
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal").join(has, "c_custkey", "left").fillna(0, ["pos"])
    q = c.select("pos", F.ntile(5).over(by).cast("long").alias("quintile"), F.row_number().over(by).alias("rk"))
    marks = F.array(F.struct(F.lit("quintile").alias("what"), F.col("quintile").alias("place")), *[F.when(F.col("rk") <= k, F.struct(F.lit("top").alias("what"), F.lit(k).cast("long").alias("place"))) for k in (10, 25, 50, 100)])
    return q.select("pos", F.explode(F.array_compact(marks)).alias("m")).groupBy("m.what", "m.place").agg(F.count("*").alias("n"), F.sum("pos").alias("pos"))


@query("""
WITH x AS (SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS month, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'identical' WHEN o_orderpriority LIKE '1%' THEN 'naming' WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'retranscribe' WHEN o_custkey % 2 = 0 THEN 'regrouped' ELSE 'first' END AS cause FROM orders)
SELECT epoch_us(month) AS month_us, cause, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY month), 2)::DOUBLE AS pct FROM x GROUP BY month, cause
""")
def spend_by_cause(spark, sf_dir):
    """The first cause that holds, with shares by period."""
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("back")).distinct()
    o = table(spark, sf_dir, "orders").join(back, "o_orderkey", "left")
    cause = F.when(F.col("o_orderstatus") == "F", "identical").when(F.col("o_orderpriority").like("1%"), "naming").when(F.col("back"), "retranscribe").when(F.col("o_custkey") % 2 == 0, "regrouped").otherwise("first")
    g = o.groupBy(F.unix_micros(F.date_trunc("month", "o_orderdate").cast("timestamp")).alias("month_us"), cause.alias("cause")).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("month_us")), 2))


@query("SELECT n_regionkey, count(*) AS n, md5(string_agg(n_nationkey::VARCHAR || '|' || n_name, chr(10) ORDER BY n_nationkey)) AS fingerprint, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def fingerprint(spark, sf_dir):
    """An order-independent fingerprint and ordered lists."""
    n = table(spark, sf_dir, "nation")
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit("|"), F.col("n_name"))
    return n.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.md5(ordered_text([F.col("n_nationkey")], line, "\n")).alias("fingerprint"), ordered_text([F.col("n_name")], F.col("n_name"), ", ").alias("names"))


@query("""
SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers, bool_or(c_acctbal < 0) AS owing, mode(c_mktsegment ORDER BY c_mktsegment) AS segment, round(sum(c_acctbal) FILTER (WHERE c_acctbal > 0) / nullif(count(c_custkey), 0), 2)::DOUBLE AS mean_owned
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
""")
def outer_join_rollup(spark, sf_dir):
    """C1, C2, D3, D8, D9, D11 to D13."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    j = r.join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    mode = F.expr("mode() WITHIN GROUP (ORDER BY c_mktsegment)")
    return j.groupBy("r_name").agg(
        F.count_distinct("n_nationkey").alias("nations"), F.count("c_custkey").alias("customers"), F.bool_or(F.col("c_acctbal") < 0).alias("owing"), mode.alias("segment"),
        F.round(F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))) / F.nullif(F.count("c_custkey"), F.lit(0)), 2).alias("mean_owned"),
    )


@query("""
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0
""")
def semi_anti_union(spark, sf_dir):
    """C5, C6, H2, H3."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    kept = c.join(o.where(F.col("o_orderpriority").like("1%")), "c_custkey", "left_semi").join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_anti")
    return kept.union(table(spark, sf_dir, "supplier").where("s_acctbal < 0").select("s_suppkey")).distinct()


@query("""
SELECT 'open' AS tag, o_orderkey AS key, o_orderdate AS seen FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 400000 UNION ALL SELECT 'late', l_orderkey, l_shipdate FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.09
ORDER BY seen DESC NULLS LAST, tag, key LIMIT 51 OFFSET 50
""")
def feed_page(spark, sf_dir):
    """One page of tagged sources in a total order."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' AND o_totalprice > 400000").select(F.lit("open").alias("tag"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("seen"))
    li = table(spark, sf_dir, "lineitem").where("l_quantity = 50 AND l_discount > 0.09").select(F.lit("late").alias("tag"), F.col("l_orderkey").alias("key"), F.col("l_shipdate").alias("seen"))
    return o.unionByName(li).orderBy(F.desc_nulls_last("seen"), "tag", "key").offset(50).limit(51)


@query("""
WITH b AS (SELECT l_orderkey, array_agg(l_partkey ORDER BY l_linenumber) AS parts FROM lineitem GROUP BY 1)
SELECT p_partkey, count(*) AS captures, min(l_orderkey) AS first_seen FROM part JOIN b ON list_contains(parts, p_partkey) WHERE p_size = 7 GROUP BY 1
""")
def array_membership(spark, sf_dir):
    """An array-membership join as a bridge and an equi-join."""
    from threadloom.primitives import explode_bridge

    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    p = table(spark, sf_dir, "part").where("p_size = 7").select("p_partkey")
    return explode_bridge(items, "parts", "p_partkey").join(p, "p_partkey").groupBy("p_partkey").agg(F.count("*").alias("captures"), F.min("l_orderkey").alias("first_seen"))


@query("""
SELECT o_custkey, o_orderkey, list_filter(list(l_linenumber ORDER BY l_linenumber), lambda x: x <> 2)::VARCHAR AS kept, list_contains(list(l_returnflag), 'R') AS back
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2
""")
def array_rebuild(spark, sf_dir):
    """An array rebuilt in order without some members."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    g = li.groupBy("o_custkey", F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("l"), F.bool_or(F.col("l_returnflag") == "R").alias("back"))
    kept = F.transform(F.filter("l", lambda x: x != 2), lambda x: x.cast("string"))
    return g.select("o_custkey", "o_orderkey", F.concat(F.lit("["), F.array_join(kept, ", "), F.lit("]")).alias("kept"), "back")


@query("""
WITH s AS (UNPIVOT (SELECT s_suppkey, s_acctbal AS balance, s_nationkey::DOUBLE AS nation, (s_suppkey % 7)::DOUBLE AS grade FROM supplier) ON balance, nation, grade INTO NAME signal VALUE v)
SELECT signal, floor(v / 1000) AS bucket, count(*) AS n, round(avg(v), 4)::DOUBLE AS mean, round(quantile_cont(v, 0.5), 4)::DOUBLE AS median FROM s GROUP BY 1, 2
""")
def signal_buckets(spark, sf_dir):
    """Signals in long form, in buckets."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"), (F.col("s_suppkey") % 7).cast("double").alias("grade"))
    long = s.unpivot(["s_suppkey"], ["balance", "nation", "grade"], "signal", "v")
    return long.groupBy("signal", F.floor(F.col("v") / 1000).cast("double").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.percentile("v", 0.5), 4).alias("median"))


@query("""
SELECT o_orderkey, CASE WHEN hour(o_orderdate) < 5 THEN 'night' WHEN hour(o_orderdate) < 12 THEN 'morning' WHEN hour(o_orderdate) < 17 THEN 'afternoon' WHEN hour(o_orderdate) < 22 THEN 'evening' ELSE 'night' END AS part,
  strftime(o_orderdate, '%A %Y-%m-%d') AS day, epoch_us(date_trunc('week', o_orderdate)::TIMESTAMP - INTERVAL 7 DAY) AS week_us, greatest(1, round_even(o_totalprice / 3600.0, 0))::BIGINT AS minutes
FROM orders
""")
def calendar(spark, sf_dir):
    """B15, B16, B18 (no clock time), B19, B20."""
    h = F.hour("o_orderdate")
    part = F.when(h < 5, "night").when(h < 12, "morning").when(h < 17, "afternoon").when(h < 22, "evening").otherwise("night")
    week = F.unix_micros((F.date_trunc("week", "o_orderdate") - F.expr("INTERVAL 7 DAYS")).cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", part.alias("part"), F.date_format("o_orderdate", "EEEE yyyy-MM-dd").alias("day"), week.alias("week_us"), F.greatest(F.lit(1), F.bround(F.col("o_totalprice") / 3600.0).cast("long")).alias("minutes"))
