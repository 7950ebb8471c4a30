"""Audit sheets, screens and guards over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import audits
from threadloom.plans import query, table
from threadloom.plans.graphs import _SIM
from threadloom.plans.readmodel import ledger, view


@query("""
WITH m AS (SELECT o_orderkey % 4 AS sheet, o_orderkey AS num, o_orderpriority AS part_of, o_custkey % 97 AS a, 97 + o_orderkey % 13 AS b, CASE o_orderstatus WHEN 'F' THEN 'same' WHEN 'O' THEN 'other' END AS label FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY sheet, num) AS nth, count(*) OVER (PARTITION BY a, b) AS c FROM m WHERE label IS NOT NULL)
SELECT part_of, label, count(*) AS marked, sum(c - 1)::BIGINT AS repeated FROM r WHERE nth = 1 GROUP BY 1, 2
""")
def pooled_sheets(spark, sf_dir):
    """P9."""
    label = F.when(F.col("o_orderstatus") == "F", "same").when(F.col("o_orderstatus") == "O", "other")
    k = F.col("o_orderkey")
    return audits.pooled(table(spark, sf_dir, "orders").select((k % 4).alias("sheet"), k.alias("num"), F.col("o_orderpriority").alias("part_of"), (F.col("o_custkey") % 97).alias("a"), (97 + k % 13).alias("b"), label.alias("label")))


@query("""
WITH w AS (SELECT l_orderkey AS pair, l_returnflag AS wording, max(l_quantity)::DOUBLE / 50 AS p FROM lineitem GROUP BY 1, 2),
m AS (SELECT pair, avg(p) AS mean FROM w GROUP BY 1), t AS (SELECT *, row_number() OVER (PARTITION BY wording ORDER BY p DESC, pair) AS place FROM w)
SELECT wording, place, pair, round(p, 6) AS p, round(mean, 6) AS mean FROM t JOIN m USING (pair) WHERE place <= 10
""")
def wording_tops(spark, sf_dir):
    """P15."""
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair"), F.col("l_returnflag").alias("wording")).agg((F.max("l_quantity").cast("double") / 50).alias("p"))
    return audits.wording_tops(w).select("wording", F.col("place").cast("long"), "pair", F.round("p", 6).alias("p"), F.round("mean", 6).alias("mean"))


@view("""
, s AS (SELECT item_id, i.said_by, count(DISTINCT speaker_label) AS n, bool_or(speaker_label = i.said_by) AS own FROM (SELECT item_id, who AS said_by, unnest(source_segment_ids) AS segment_id FROM (SELECT *, CASE WHEN item_id LIKE '%4' THEN 'click' ELSE 'view' END AS who FROM l_items) JOIN l_episodes USING (episode_id) WHERE current) i JOIN l_segments USING (segment_id) GROUP BY 1, 2)
SELECT count(*) AS items, count(*) FILTER (n > 1) AS multi_speaker, round(100.0 * count(*) FILTER (n > 1) / count(*), 1)::DOUBLE AS pct_multi, count(*) FILTER (NOT own) AS said_by_not_among_cited FROM s
""")
def speakers_cited(spark, sf_dir):
    """P19."""
    t = ledger(spark, sf_dir)
    items = t["items"].join(t["episodes"].where("current").select("episode_id"), "episode_id", "left_semi")
    return audits.speakers_cited(items.withColumn("said_by", F.when(F.col("item_id").like("%4"), "click").otherwise("view")), t["segments"])


@query("""
WITH stored AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'm0' ELSE 'm1' END AS model_version, sha256(CASE WHEN doc_id % 4 = 1 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 2)
SELECT doc_id AS id, sha256(text) AS input_hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.doc_id = d.doc_id AND s.h = sha256(d.text) AND model_version = 'm1')
""")
def missing_embeddings(spark, sf_dir):
    """I1."""
    d, k = table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id")
    text = F.when(k % 4 == 1, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    stored = d.where(k % 5 != 2).select(k.alias("id"), F.when(k % 6 == 0, "m0").otherwise("m1").alias("model_version"), F.sha2(text, 256).alias("input_hash"))
    return audits.stale(d.withColumnRenamed("doc_id", "id"), stored, "m1").drop("text")


@query(f"""
WITH {_SIM}, p AS (SELECT least(id // 3, other // 3) AS a, greatest(id // 3, other // 3) AS b, sim, least(id, other) AS la, greatest(id, other) AS lb FROM nn WHERE rank <= 49 AND id // 3 <> other // 3 AND (id // 3 + other // 3) % 3 <> 0)
SELECT a, b, round(sim, 6) AS score, la, lb FROM (SELECT DISTINCT ON (a, b) * FROM p ORDER BY a, b, sim DESC, la, lb)
""")
def closest_lines(spark, sf_dir):
    """I9."""
    lines = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 3).cast("long").alias("owner"), F.col("embedding").alias("v"))
    return audits.closest_lines(lines, (F.col("a") + F.col("b")) % 3 != 0).withColumn("score", F.round("score", 6))


@query("""
WITH merged AS (SELECT p_partkey AS idea_id, p_partkey - 1 AS into_id FROM part WHERE p_partkey % 5 = 1), cards AS (SELECT p_partkey AS idea_id FROM part WHERE p_partkey % 5 <> 1 AND p_partkey % 7 <> 0),
near AS (SELECT p_partkey AS a, 3 * p_partkey + 1 AS b, (p_partkey % 50) / 50.0::DOUBLE AS cosine FROM part),
apart AS (SELECT DISTINCT o_custkey % 50 AS a, o_custkey % 50 + o_orderkey % 20 AS b FROM orders WHERE o_orderkey % 11 = 0),
u AS (SELECT DISTINCT review_id, kind, coalesce(into_id, x.id) AS idea_id FROM (SELECT o_orderkey AS review_id, CASE o_orderkey % 3 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'judged_same' ELSE 'other' END AS kind, unnest([o_custkey, o_orderkey % 100, o_custkey % 50, o_custkey % 50]) AS id FROM orders WHERE o_orderkey % 4 <> 0) x LEFT JOIN merged m ON m.idea_id = x.id WHERE kind <> 'other' AND coalesce(into_id, x.id) IN (SELECT idea_id FROM cards)),
k AS (SELECT x.idea_id AS a, y.idea_id AS b, string_agg(DISTINCT x.kind, ',' ORDER BY x.kind) AS review FROM u x JOIN u y ON x.review_id = y.review_id AND x.idea_id < y.idea_id GROUP BY 1, 2)
SELECT a, b, cosine, coalesce(review, '') AS review, CASE WHEN (a + b) % 4 <> 0 THEN (a * 7 + b) % 10 / 10.0::DOUBLE END AS same FROM near FULL JOIN k USING (a, b) WHERE NOT EXISTS (SELECT 1 FROM apart p WHERE p.a = coalesce(near.a, k.a) AND p.b = coalesce(near.b, k.b))
""")
def merge_screen(spark, sf_dir):
    """The pairs to look at, in the screen's order."""
    part, o = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p")), table(spark, sf_dir, "orders")
    p, k, c = F.col("p"), F.col("o_orderkey"), F.col("o_custkey")
    merged = part.where(p % 5 == 1).select(p.alias("idea_id"), (p - 1).alias("into_id"))
    cards = part.where((p % 5 != 1) & (p % 7 != 0)).select(p.alias("idea_id"))
    near = part.select(p.alias("a"), (3 * p + 1).alias("b"), ((p % 50) / 50.0).alias("cosine"))
    apart = o.where(k % 11 == 0).select((c % 50).alias("a"), (c % 50 + k % 20).alias("b")).distinct()
    kind = F.when(k % 3 == 0, "duplicate").when(k % 3 == 1, "judged_same").otherwise("other")
    reviews = o.select(k.alias("review_id"), kind.alias("kind"), F.array(c, k % 100, c % 50, c % 50).cast("array<bigint>").alias("ids"), F.when(k % 4 == 0, k).alias("merge_id"))
    rows = audits.merge_universe(near, reviews, merged, cards, apart)
    a, b = F.col("a"), F.col("b")
    rows = rows.withColumn("same", F.when((a + b) % 4 != 0, (a * 7 + b) % 10 / 10.0)).orderBy(*audits.screen_order())
    return rows.withColumn("review", F.array_join("review", ","))


@query("""
WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'pin_theme' WHEN 1 THEN 'file_idea' ELSE 'note' END AS kind, CASE WHEN event_id % 3 <> 2 THEN 'h' || (event_id % 40) END AS theme_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '{}' ELSE '{"to":"x' || event_id || '"}' END AS payload FROM events),
j AS (SELECT e.*, kind <> 'note' AND n_nationkey IS NULL AS gone FROM e LEFT JOIN nation ON 'h' || n_nationkey = theme_id)
SELECT event_id, kind, CASE WHEN NOT gone THEN theme_id END AS theme_id, CASE WHEN gone THEN replace(left(coalesce(payload, '{}'), -1) || CASE WHEN coalesce(payload, '{}') = '{}' THEN '' ELSE ',' END || '"theme_gone":"' || theme_id || '"}', ' ', '') ELSE payload END AS payload FROM j
""")
def theme_guard(spark, sf_dir):
    """N6."""
    k = F.col("event_id")
    theme = F.when(k % 3 != 2, F.concat(F.lit("h"), (k % 40).cast("string")))
    text = F.when(k % 5 == 0, None).when(k % 5 == 1, "{}").otherwise(F.concat(F.lit('{"to":"x'), k.cast("string"), F.lit('"}')))
    e = table(spark, sf_dir, "events").select(k, F.when(k % 3 == 0, "pin_theme").when(k % 3 == 1, "file_idea").otherwise("note").alias("kind"), theme.alias("theme_id"), text.alias("payload"))
    themes = table(spark, sf_dir, "nation").select(F.concat(F.lit("h"), F.col("n_nationkey").cast("string")).alias("theme_id"))
    return audits.theme_named(e, themes).select("event_id", "kind", "theme_id", "payload")


@view("SELECT event_id, array_to_string(source_segment_ids, ',') AS segments FROM l_events LEFT JOIN l_items USING (item_id)")
def anchored_events(spark, sf_dir):
    """N7."""
    t = ledger(spark, sf_dir)
    return audits.anchored(t["events"], t["items"]).select("event_id", F.array_join("item_segment_ids", ",").alias("segments"))


@query("""
WITH p AS (SELECT o_custkey AS answer, o_orderkey AS ord, ' ' || CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END || ' ' AS name, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'd' || o_orderkey END AS description, [o_orderkey % 7, o_orderkey % 5, o_orderkey % 3, o_orderkey % 7, 1] AS ideas FROM orders),
m AS (SELECT *, trim(name) AS n, list_filter(ideas, lambda x: x BETWEEN 1 AND 4) AS v FROM p),
g AS (SELECT *, list_filter(v, lambda x, i: list_position(v, x) = i) AS d FROM m),
f AS (SELECT *, row_number() OVER (PARTITION BY answer, lower(n) ORDER BY ord) AS nth FROM g WHERE len(d) >= 3 AND n <> '' AND lower(n) NOT LIKE '3-%')
SELECT answer, ord, n AS name, nullif(trim(description), '') AS description, array_to_string(list_transform(d, lambda x: 'i' || x), ',') AS members FROM f WHERE nth = 1
""")
def proposed_themes(spark, sf_dir):
    """Names taken are those of one priority."""
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    name = F.concat(F.lit(" "), F.when(k % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority")), F.lit(" "))
    ideas = F.array(k % 7, k % 5, k % 3, k % 7, F.lit(1)).cast("array<bigint>")
    p = o.select(F.col("o_custkey").alias("answer"), k.alias("ord"), name.alias("name"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("d"), k.cast("string"))).alias("description"), ideas.alias("ideas"), F.array(*[F.lit(f"i{i}") for i in range(1, 5)]).alias("loose"))
    taken = o.where("o_orderpriority LIKE '3-%'").select(F.col("o_orderpriority").alias("name")).distinct()
    return audits.proposed_themes(p, taken).withColumn("members", F.array_join("members", ","))


@query("""
WITH m AS (SELECT label AS cell, vec_id AS id, CASE WHEN vec_id % 9 <> 4 THEN vec_id * 7919 % 1009 END AS first_said, CASE WHEN vec_id % 10 <> 0 THEN embedding[1]::DOUBLE END AS x, CASE WHEN vec_id % 10 <> 0 THEN embedding[2]::DOUBLE END AS y FROM embeddings),
c AS (SELECT avg(x) AS mx, -avg(y) AS my FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY first_said NULLS LAST, id) - 1 AS place, count(*) OVER (PARTITION BY cell) AS n FROM m),
s AS (SELECT p.*, mx, my, coalesce(x, mx + cos(place)) AS sx, coalesce(-y, my + sin(place)) AS sy FROM p, c WHERE n >= 3),
b AS (SELECT *, min(sx) OVER w AS x0, min(sy) OVER w AS y0, max(sx) OVER w - min(sx) OVER w AS dx, max(sy) OVER w - min(sy) OVER w AS dy FROM s WINDOW w AS (PARTITION BY cell)),
e AS (SELECT *, greatest(dx, dy, 1e-6) AS wide, degrees(atan2(sy - my, sx - mx)) AS turn FROM b)
SELECT cell, id, place, round(14 + 72 * (sx - x0 + (wide - dx) / 2) / wide, 1) AS px, round(14 + 72 * (sy - y0 + (wide - dy) / 2) / wide, 1) AS py, round(CASE WHEN turn < 0 THEN turn + 360 ELSE turn END)::INT AS hue FROM e
""")
def grid_cells(spark, sf_dir):
    """A label's vectors are a cell, their first two components the sky."""
    k, placed = F.col("vec_id"), F.col("vec_id") % 10 != 0
    at = lambda i: F.when(placed, F.element_at("embedding", i).cast("double"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cell"), k.alias("id"), F.when(k % 9 != 4, k * 7919 % 1009).alias("first_said"), at(1).alias("x"), at(2).alias("y"))
    return audits.grid_cells(rows, rows.select("id", "x", "y")).withColumn("place", F.col("place").cast("long"))


@query("""
WITH e AS (SELECT p_partkey AS idea_id, CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_name || ' ' END AS title, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS statement, CASE p_partkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN 'a note' WHEN 5 THEN 'another' END AS note FROM part)
SELECT idea_id, 'idea_correct' AS kind, '{' || concat_ws(',', '"title":"' || trim(title) || '"', '"statement":"' || statement || '"') || '}' AS payload FROM e WHERE title IS NOT NULL OR statement IS NOT NULL
UNION ALL SELECT idea_id, 'idea_note', '{"note":"' || trim(note) || '"}' FROM e WHERE note IS NOT NULL
""")
def corrections(spark, sf_dir):
    """N12."""
    k = F.col("p_partkey")
    note = F.when(k % 6 == 0, " ").when(k % 6 == 1, "a note").when(k % 6 == 5, "another")
    title = F.when(k % 2 == 0, F.concat(F.lit(" "), "p_name", F.lit(" ")))
    return audits.corrections(table(spark, sf_dir, "part").select(k.alias("idea_id"), title.alias("title"), F.when(k % 3 == 0, F.col("p_type")).alias("statement"), note.alias("note")))


@query(r"""
WITH c AS (SELECT conv_id * 100 + turn AS id, coalesce(text, '') AS text FROM conversations), f AS (SELECT regexp_extract(lower(text), '[\p{L}\p{N}_]+') AS w, count(*) AS seen FROM c GROUP BY 1),
p AS (SELECT upper(w) AS heard, w || '!' AS meant, CASE seen % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'confirmed' ELSE 'provisional' END AS status, seen FROM f WHERE regexp_full_match(w, '[a-z]+')),
t AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM c)
SELECT id, heard, meant, status, seen FROM t JOIN p ON heard = upper(w) AND lower(heard) = w WHERE status <> 'rejected'
""")
def mishearing_hints(spark, sf_dir):
    """The words that turns begin with are heard."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    f = c.groupBy(F.regexp_extract(audits.folded("text"), audits.WORD, 0).alias("w")).agg(F.count("*").alias("seen")).where(F.col("w").rlike("^[a-z]+$"))
    status = F.when(F.col("seen") % 3 == 0, "rejected").when(F.col("seen") % 3 == 1, "confirmed").otherwise("provisional")
    return audits.hints(c, f.select(F.upper("w").alias("heard"), F.concat("w", F.lit("!")).alias("meant"), status.alias("status"), "seen"))


@query("""
WITH d AS (SELECT o_custkey, min(o_orderdate)::DATE AS day FROM orders GROUP BY 1), n AS (SELECT day, count(*) AS n FROM d GROUP BY 1)
SELECT day, (sum(n) OVER (ORDER BY day))::BIGINT AS visible FROM n
""")
def replay(spark, sf_dir):
    """G21."""
    return audits.visible_by_day(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_said")))


@query("""
SELECT n, epoch_us(sent_at) AS at_us, text, mark = 'edit' AS edited FROM (SELECT o_orderkey AS n, o_orderdate::TIMESTAMP AS sent_at, CASE WHEN o_orderkey % 3 = 1 THEN 'edited ' || o_orderkey ELSE o_orderpriority || '  by ' || o_orderstatus END AS text, CASE o_orderkey % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'edit' ELSE 'drop' END AS mark FROM orders) WHERE mark <> 'drop'
""")
def curated(spark, sf_dir):
    """K9."""
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    export = o.select(k.alias("n"), at.alias("at"), F.concat("o_orderpriority", F.lit("  by "), "o_orderstatus").alias("text"))
    mark = F.when(k % 3 == 0, "keep").when(k % 3 == 1, "edit").otherwise("drop")
    sheet = o.select(k.alias("n"), F.date_format(at, "yyyy-MM-dd HH:mm").alias("sent"), F.concat("o_orderpriority", F.lit(" by\n"), "o_orderstatus").alias("quote"), mark.alias("mark"), F.concat(F.lit("edited "), k.cast("string")).alias("text"))
    return audits.curated(export, sheet).select("n", F.unix_micros("at").alias("at_us"), "text", "edited")
