"""Transcript lines, rules over them and labels, over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text
from threadloom.operators import sessions
from threadloom.plans import query, table
from threadloom.primitives import ordered_text


@query("""
WITH f AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2)
SELECT conv_id, role, CASE WHEN role = 'user' THEN 'me' ELSE 'S' || row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY first, role) END AS pseudonym FROM f
""")
def pseudonyms(spark, sf_dir):
    """G4."""
    return sessions.pseudonyms(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn", "user")


@query("""
SELECT conv_id, md5(string_agg('[' || (turn + 1) || '] ' || CASE WHEN role = 'user' THEN 'me' ELSE 'S1' END || ': ' || text, chr(10) ORDER BY turn)) AS payload_md5, count(*) AS lines,
  sha256(string_agg(sha256(text), chr(10) ORDER BY sha256(text))) AS input_hash
FROM conversations GROUP BY 1
""")
def payload_lines(spark, sf_dir):
    """Numbered lines in order, and an order-independent hash."""
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("] "), F.when(F.col("role") == "user", "me").otherwise("S1"), F.lit(": "), F.col("text"))
    hashes = F.array_join(F.sort_array(F.collect_list(F.sha2("text", 256))), "\n")
    return c.groupBy("conv_id").agg(F.md5(ordered_text([F.col("turn")], line, "\n")).alias("payload_md5"), F.count("*").alias("lines"), F.sha2(hashes, 256).alias("input_hash"))


@query("""
SELECT c.conv_id, c.turn, coalesce((SELECT max(p.turn) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND p.role <> c.role), -1) AS before, coalesce((SELECT min(p.turn) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn > c.turn AND p.role <> c.role), -1) AS after FROM conversations c
""")
def prev_next_other(spark, sf_dir):
    """Nearest lines of another speaker, by runs and two windows."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = (F.lag("role").over(w) != F.col("role")).cast("int")
    runs = c.withColumn("run", F.sum(F.coalesce(new, F.lit(0))).over(w))
    ends = runs.groupBy("conv_id", "run").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    by = Window.partitionBy("conv_id").orderBy("run")
    ends = ends.select("conv_id", "run", F.lag("hi").over(by).alias("before"), F.lead("lo").over(by).alias("after"))
    return runs.join(ends, ["conv_id", "run"]).select("conv_id", "turn", F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("after", F.lit(-1)).alias("after"))


@query("""
WITH cited AS (SELECT conv_id, min(turn) - 1 AS lo, max(turn) + 1 AS hi FROM conversations WHERE role = 'assistant' AND length(text) > 300 GROUP BY 1)
SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN cited s ON s.conv_id = c.conv_id AND c.turn BETWEEN lo AND hi
""")
def item_context(spark, sf_dir):
    """The lines around a cited span."""
    c = table(spark, sf_dir, "conversations")
    span = c.where("role = 'assistant' AND length(text) > 300").groupBy("conv_id").agg((F.min("turn") - 1).alias("lo"), (F.max("turn") + 1).alias("hi"))
    return c.join(span, "conv_id").where("turn BETWEEN lo AND hi").select("conv_id", "turn", "role")


@query("""
WITH w AS (SELECT *, len(regexp_split_to_array(trim(text), '\\s+')) AS n FROM conversations),
r AS (SELECT 'short' AS rule, conv_id, turn FROM w a WHERE role = 'user' AND n <= 12 AND EXISTS (SELECT 1 FROM w b WHERE b.conv_id = a.conv_id AND b.role = 'assistant' AND b.turn > a.turn AND b.turn <= a.turn + 2)
  UNION ALL SELECT 'the', conv_id, turn FROM w WHERE regexp_matches(text, '(?i)\\bthe\\b') AND n > 60),
o AS (SELECT *, row_number() OVER (PARTITION BY rule, conv_id ORDER BY sha256(conv_id || ':' || turn)) AS nth FROM r)
SELECT rule, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY sha256('s' || conv_id), conv_id) AS k FROM o WHERE nth = 1) WHERE k <= 40
""")
def hard_set_rules(spark, sf_dir):
    """Rules by regex and a range semi-join, then two hash orders."""
    w = table(spark, sf_dir, "conversations").withColumn("n", F.size(F.split(F.trim("text"), r"\s+")))
    answers = w.where("role = 'assistant'").select("conv_id", F.explode(F.array(F.col("turn") - 1, F.col("turn") - 2)).alias("turn")).distinct()
    short = w.where("role = 'user' AND n <= 12").join(answers, ["conv_id", "turn"], "left_semi").select(F.lit("short").alias("rule"), "conv_id", "turn")
    the = w.where(F.col("text").rlike(r"(?i)\bthe\b") & (F.col("n") > 60)).select(F.lit("the").alias("rule"), "conv_id", "turn")
    first = short.unionByName(the).groupBy("rule", "conv_id").agg(F.min_by("turn", F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256)).alias("turn"))
    k = F.row_number().over(Window.partitionBy("rule").orderBy(F.sha2(F.concat(F.lit("s"), F.col("conv_id").cast("string")), 256), "conv_id"))
    return first.withColumn("k", k).where("k <= 40").drop("k")


@query("""
SELECT conv_id, turn, CASE WHEN len(w) > 8 THEN array_to_string(w[1:8], ' ') || '…' ELSE array_to_string(w, ' ') END AS title, regexp_replace(replace(replace(replace(left(text, 40), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''|"', '', 'g') AS shown
FROM (SELECT *, regexp_split_to_array(trim(text), '\\s+') AS w FROM conversations)
""")
def titles(spark, sf_dir):
    """B13, B35."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.title(F.col("text")).alias("title"), F.regexp_replace(text.escaped(F.regexp_replace(F.substring("text", 1, 40), "'|\"", "")), "'|\"", "").alias("shown"))


@query("""
SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(html) AS n, (length(html) - length(replace(html, '<p', ''))) // 2 AS paragraphs, regexp_matches(html, '(?i)<script') AS scripted, url LIKE 'https:%' AS secure FROM pages
""")
def page_scan(spark, sf_dir):
    """A raw text scan with patterns."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.length("html").cast("long").alias("n"),
        F.floor((F.length("html") - F.length(F.replace("html", F.lit("<p")))) / 2).alias("paragraphs"), F.col("html").rlike("(?i)<script").alias("scripted"), F.col("url").like("https:%").alias("secure"),
    )
