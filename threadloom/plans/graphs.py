"""Vectors and graphs over ``embeddings``, closures over ``orders`` and ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom import primitives
from threadloom.operators import graph, vectors
from threadloom.plans import query, table

FLOOR = 0.30


def _nearest(spark, sf_dir, k: int) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), k, "vec_id", "embedding")


def knn_graph(spark, sf_dir, k: int = 3) -> DataFrame:
    return primitives.checkpointed(vectors.near_pairs(_nearest(spark, sf_dir, k), FLOOR))


_SIM = """sims AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM sims)"""
_EDGES = f"{_SIM}, edges AS (SELECT least(id, other) AS a, greatest(id, other) AS b, max(sim) AS sim FROM nn WHERE rank <= 3 AND sim >= 0.30 GROUP BY 1, 2)"


@query(f"WITH {_EDGES} SELECT a, b, round(sim, 4) AS confidence FROM edges")
def knn_edges(spark, sf_dir):
    """I3, H4, F4."""
    return vectors.near_pairs(_nearest(spark, sf_dir, 3), FLOOR).select("a", "b", F.round("sim", 4).alias("confidence"))


@query(f"WITH {_SIM} SELECT least(id, other) AS a, greatest(id, other) AS b, round(max(sim), 4) AS sim FROM nn WHERE rank <= 10 AND sim >= 0.35 GROUP BY 1, 2")
def nominated_pairs(spark, sf_dir):
    """I4."""
    return vectors.near_pairs(_nearest(spark, sf_dir, 10), 0.35).select("a", "b", F.round("sim", 4).alias("sim"))


@query(f"WITH {_SIM} SELECT id, other, rank, round(sim, 6) AS sim FROM nn WHERE id % 20 = 0 AND rank <= 8")
def seed_neighbours(spark, sf_dir):
    """Neighbours of given seeds; k clamped to 1..50."""
    rows, k = table(spark, sf_dir, "embeddings"), max(1, min(8, 50))
    return vectors.nearest(rows, k, "vec_id", "embedding", rows.where("vec_id % 20 = 0")).select("id", "other", F.col("rank").cast("long"), F.round("sim", 6).alias("sim"))


@query("SELECT label, n FROM (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS r FROM embeddings GROUP BY 1) WHERE r = 1")
def majority_label(spark, sf_dir):
    """The most common value, ties to the smaller."""
    counts = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "label").limit(1)


@query(f"""
WITH {_SIM}, near AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b FROM nn WHERE rank <= 5),
wide AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b FROM nn WHERE rank <= 10),
gap AS (SELECT quantile_cont(b - a, 0.75) AS g FROM wide)
SELECT 'near' AS kind, count(*) AS n, sum(a + b)::BIGINT AS mark FROM near UNION ALL SELECT 'wide', count(*), sum(a + b)::BIGINT FROM wide
UNION ALL SELECT 'apart', count(*), sum(a + b)::BIGINT FROM wide, gap WHERE b - a >= greatest(g, 1)
""")
def pair_sets(spark, sf_dir):
    """Near, wide and far-apart pairs by an exact quantile."""
    nn = primitives.checkpointed(_nearest(spark, sf_dir, 10))
    pairs = lambda k: nn.where(F.col("rank") <= k).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    wide = primitives.checkpointed(pairs(10))
    apart = wide.crossJoin(F.broadcast(wide.agg(F.percentile(F.col("b") - F.col("a"), 0.75).alias("g")))).where("b - a >= greatest(g, 1)")
    tag = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(F.col("a") + F.col("b")).alias("mark"))
    return tag("near", pairs(5)).unionByName(tag("wide", wide)).unionByName(tag("apart", apart))


@query(f"WITH {_SIM} SELECT id, other AS partner, rank FROM nn WHERE id % 20 = 0 AND other = id + 1")
def partner_rank(spark, sf_dir):
    """The rank of one partner: how many rows are nearer, counted where they
    stand; no list of neighbours is made."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select("vec_id", "embedding").join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("partner"), F.col("embedding").alias("partner_vector")), "vec_id")
    return vectors.rank_of(rows, asked, "vec_id", "embedding", "partner", "partner_vector").select("id", "partner", "rank")


@query(f"WITH {_EDGES} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY 1")
def degree(spark, sf_dir):
    """J10."""
    return graph.degrees(knn_graph(spark, sf_dir))


@query(f"""
WITH {_EDGES}, s AS (SELECT a AS x, b AS y FROM edges UNION ALL SELECT b, a FROM edges)
SELECT a, b, (SELECT count(*) FROM s p JOIN s q ON p.y = q.y WHERE p.x = a AND q.x = b) AS common FROM edges
""")
def triangles(spark, sf_dir):
    """Common neighbours of each edge's ends."""
    return graph.common_neighbours(knn_graph(spark, sf_dir))


@query()
def pagerank(spark, sf_dir):
    """Relevance to a seed; tested against numpy power steps."""
    edges = knn_graph(spark, sf_dir).select("a", "b", F.lit(1.0).alias("w"))
    return graph.personalised_pagerank(edges, 7)


@query()
def neighbourhoods(spark, sf_dir):
    """Tested against the sequential rule."""
    return graph.neighbourhoods(knn_graph(spark, sf_dir))


@query(f"""
WITH RECURSIVE {_EDGES}, s AS (SELECT a AS x, b AS y FROM edges UNION ALL SELECT b, a FROM edges),
r AS (SELECT x AS node, x AS c FROM s UNION SELECT r.node, s.y FROM r JOIN s ON r.c = s.x)
SELECT node, min(c) AS component FROM r GROUP BY 1
""")
def graph_components(spark, sf_dir):
    return graph.components(knn_graph(spark, sf_dir))


@query(f"""
WITH {_EDGES}, m AS (SELECT vec_id, label, vec_id % 7 AS conv FROM embeddings)
SELECT a, b, least(x.label, y.label) AS earlier, greatest(x.label, y.label) AS later FROM edges JOIN m x ON a = x.vec_id JOIN m y ON b = y.vec_id WHERE x.conv <> y.conv AND abs(x.label - y.label) >= 2
""")
def echoes(spark, sf_dir):
    """Edges whose ends share no conversation, with a gap between them."""
    m = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"), F.array(F.col("vec_id") % 7).alias("convs"))
    end = lambda c: m.select(F.col("id").alias(c), F.col("label").alias(f"l_{c}"), F.col("convs").alias(f"c_{c}"))
    e = knn_graph(spark, sf_dir).join(end("a"), "a").join(end("b"), "b").where(~F.arrays_overlap("c_a", "c_b") & (F.abs(F.col("l_a") - F.col("l_b")) >= 2))
    return e.select("a", "b", F.least("l_a", "l_b").alias("earlier"), F.greatest("l_a", "l_b").alias("later"))


@query(f"""
WITH {_EDGES}, o AS (SELECT vec_id AS node, 'o' || (vec_id % 40) AS obs FROM embeddings UNION ALL SELECT vec_id, 'o' || (vec_id % 9) FROM embeddings)
SELECT a, b, string_agg(DISTINCT obs, ',' ORDER BY obs) AS cited FROM edges JOIN o ON node = a OR node = b GROUP BY a, b
""")
def edge_citations(spark, sf_dir):
    """The sorted distinct observations of both ends."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"))
    name = lambda n: F.concat(F.lit("o"), (F.col("node") % n).cast("string"))
    o = ids.select("node", F.explode(F.array(name(40), name(9))).alias("obs"))
    ends = knn_graph(spark, sf_dir).select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    return ends.join(o, "node").groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("obs")), ",").alias("cited"))


def _chain(spark, sf_dir) -> DataFrame:
    """Each order of a customer supersedes the one before it."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return o.select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("dst")).dropna()


_CHAIN = "chain AS (SELECT * FROM (SELECT o_orderkey AS src, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL)"


@query(f"""
WITH RECURSIVE {_CHAIN}, r AS (SELECT o_orderkey AS node, o_orderkey AS reached FROM orders UNION SELECT r.node, c.dst FROM r JOIN chain c ON r.reached = c.src)
SELECT node, count(*) AS reached, min(reached) AS oldest FROM r GROUP BY 1
""")
def ancestor_closure(spark, sf_dir):
    """Set semantics, safe on cycles."""
    seed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"))
    return primitives.closure(_chain(spark, sf_dir), seed).groupBy("node").agg(F.count("*").alias("reached"), F.min("reached").alias("oldest"))


@query(f"""
WITH RECURSIVE {_CHAIN}, r AS (SELECT o_orderkey AS node, o_orderkey AS reached FROM orders UNION SELECT r.node, c.src FROM r JOIN chain c ON r.reached = c.dst)
SELECT node, count(*) AS reached, max(reached) AS newest FROM r GROUP BY 1
""")
def descendants(spark, sf_dir):
    """J2, J3."""
    seed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"))
    down = _chain(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return primitives.closure(down, seed).groupBy("node").agg(F.count("*").alias("reached"), F.max("reached").alias("newest"))


@query("""
WITH RECURSIVE f AS (SELECT p_partkey AS src, max(q) AS dst FROM (SELECT p_partkey, lag(p_partkey) OVER (PARTITION BY p_type, p_size ORDER BY p_partkey) AS q FROM part) GROUP BY 1 HAVING max(q) IS NOT NULL),
r AS (SELECT src AS node, dst AS t FROM f UNION ALL SELECT r.node, f.dst FROM r JOIN f ON r.t = f.src)
SELECT node, min(t) AS terminal FROM r GROUP BY 1
""")
def merge_terminals(spark, sf_dir):
    """Where each merge chain ends, by pointer doubling."""
    p = table(spark, sf_dir, "part")
    before = F.lag("p_partkey").over(Window.partitionBy("p_type", "p_size").orderBy("p_partkey"))
    return primitives.terminals(p.select(F.col("p_partkey").alias("src"), before.alias("dst")).dropna())


@query(f"""
WITH {_EDGES}, m AS (SELECT vec_id AS o, vec_id - 1 AS k FROM embeddings WHERE vec_id % 5 = 1),
e AS (SELECT coalesce(x.k, a) AS x, coalesce(y.k, b) AS y, CASE WHEN a % 2 = 0 THEN 'a>b' ELSE 'both' END AS d, x.k IS NOT NULL OR y.k IS NOT NULL AS moved, a, b FROM edges LEFT JOIN m x ON a = x.o LEFT JOIN m y ON b = y.o),
t AS (SELECT least(x, y) AS p, greatest(x, y) AS q, CASE WHEN x > y AND d = 'a>b' THEN 'b>a' ELSE d END AS d, moved, a, b FROM e WHERE x <> y)
SELECT p AS a, q AS b, d AS direction FROM (SELECT *, row_number() OVER (PARTITION BY p, q ORDER BY moved, a, b) AS r FROM t) WHERE r = 1
""")
def repointed_edges(spark, sf_dir):
    """Edges after merges."""
    merges = table(spark, sf_dir, "embeddings").where("vec_id % 5 = 1").select(F.col("vec_id").alias("other_id"), (F.col("vec_id") - 1).alias("keep_id"))
    edges = knn_graph(spark, sf_dir).select("a", "b", F.when(F.col("a") % 2 == 0, "a>b").otherwise("both").alias("direction"))
    return graph.repointed(edges, merges)


@query()
def projection(spark, sf_dir):
    """All vectors on their principal plane, scaled to a largest coordinate
    of 1. Each task sums its outer products; only a matrix of dimension squared
    comes to the driver."""
    return vectors.on_plane(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
