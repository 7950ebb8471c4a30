"""Building blocks that the operators share: latest-wins, bridges, interval
joins, fixpoints, upserts, gates. All are plain DataFrame plans."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder of ``spark.checkpoint.dir`` and read
    back, which cuts its lineage and survives lost executors. Where that is unset,
    a session on one machine gets a local folder, and any other an error."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile  # one machine: tests and trials

            root = "file://" + tempfile.mkdtemp(prefix="threadloom-")
            spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], columns: Sequence[str] | None = None) -> DataFrame:
    """For each key the row of greatest ``order``: a partial aggregate, no sort."""
    rest = [c for c in (columns or df.columns) if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*")


def explode_bridge(df: DataFrame, array: str, member: str, position: str | None = None) -> DataFrame:
    """One row for each member of an array column: turns membership joins into
    equi-joins."""
    if position:
        return df.select("*", F.posexplode(array).alias(position, member)).drop(array)
    return df.withColumn(member, F.explode(array)).drop(array)


def interval_join(left: DataFrame, right: DataFrame, bucket: int, on: Sequence[str] = (), closed: bool = False) -> DataFrame:
    """Pairs whose intervals overlap: (l_start, l_end) with (r_start, r_end), longs.
    Strict unless ``closed``: touching intervals don't overlap. Both sides are
    dealt to buckets of ``bucket`` units, so it is an equi-join; a pair is kept in
    the bucket where its overlap begins, once."""
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(a, b) / bucket)))
    le = left.withColumn("__b", buckets("l_start", "l_end"))
    ri = right.withColumn("__b", buckets("r_start", "r_end"))
    meet = (F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end")) if closed else (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end"))
    return le.join(ri, ["__b", *on]).where(meet & (F.floor(F.greatest("l_start", "r_start") / bucket) == F.col("__b"))).drop("__b")


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """All rows reachable from ``seed`` by ``step``, each once; cycles end, since
    rows already seen don't come again. One written frontier for each round; an
    error where there are more than ``limit`` rounds."""
    seen = checkpointed(seed.select(*keys).distinct())
    frontier, rounds = seen, 0
    while True:
        frontier = checkpointed(step(frontier).select(*keys).distinct().join(seen, list(keys), "left_anti"))
        if frontier.isEmpty():
            return seen
        rounds += 1
        if limit is not None and rounds > limit:
            raise RuntimeError(f"no fixpoint after {limit} rounds")
        seen = seen.unionByName(frontier)


def closure(edges: DataFrame, seed: DataFrame) -> DataFrame:
    """(node, reached): everything reachable along ``edges`` (src, dst), the node
    itself included, by set semantics. ``seed``: nodes. Round k adds what is 2^k
    hops from what is held, so rounds follow the logarithm of the depth; they end
    when one adds nothing. Hops of one length are as many as edges at most in
    chains, forests and cycles; graphs with many ways between nodes have more."""
    keys = ["node", "reached"]
    seen = checkpointed(seed.select("node", F.col("node").alias("reached")).distinct())
    hops = checkpointed(edges.select(F.col("src").alias("reached"), F.col("dst").alias("next")).distinct())
    while True:
        new = checkpointed(seen.join(hops, "reached").select("node", F.col("next").alias("reached")).distinct().join(seen, keys, "left_anti"))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
        on = hops.select(F.col("reached").alias("next"), F.col("next").alias("end"))
        hops = checkpointed(hops.join(on, "next").select("reached", F.col("end").alias("next")).distinct())


def terminals(forest: DataFrame) -> DataFrame:
    """(node, terminal) where each node of a forest (src, dst; one dst each) ends.
    Pointer doubling: rounds follow the logarithm of the depth."""
    up = checkpointed(forest.select(F.col("src").alias("node"), F.col("dst").alias("terminal")))
    while True:
        over = up.select(F.col("node").alias("terminal"), F.col("terminal").alias("next"))
        new = checkpointed(up.join(over, "terminal", "left").select("node", F.coalesce("next", "terminal").alias("terminal"), F.col("next").isNotNull().alias("moved")))
        up = new.drop("moved")
        if new.where("moved").isEmpty():
            return up


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with rows of ``new`` in place of those with the same key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*old.columns))


def changed_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` that ``old`` lacks or has otherwise (null-safe)."""
    rest = [c for c in new.columns if c not in keys]
    was = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in rest], F.lit(True).alias("__is"))
    differs = F.col("__is").isNull()
    for c in rest:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return new.join(was, list(keys), "left").where(differs).select(*new.columns)


def three_way_gate(todo: DataFrame, reads: DataFrame, key: str, input_hash: str, version: str, current: str) -> DataFrame:
    """``todo`` with ``state``: done (this input under the current version), held
    (under another), due (never)."""
    known = reads.groupBy(key, input_hash).agg(F.bool_or(F.col(version) == current).alias("__now"))
    return todo.join(known, [key, input_hash], "left").withColumn("state", F.when(F.col("__now"), "done").when(F.col("__now").isNotNull(), "held").otherwise("due")).drop("__now")


def symmetrised(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected edges as rows of both directions."""
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.unionByName(edges.select(F.col(b).alias(a), F.col(a).alias(b), *rest))


def hash_sample(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """The ``n`` rows of smallest md5 of seed and key: prefix-stable."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def ordered_text(order: Sequence[Column], value: Column, separator: str) -> Column:
    """Aggregate: values joined in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, value.alias("__v")))), lambda x: x["__v"]), separator)


def ranked(partition: Sequence[str], *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
