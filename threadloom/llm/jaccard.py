"""N-gram Jaccard self-join with grouped prefixes, to exact components.

1. One scan gives each text its number of distinct shingles, a 128-bit
   fingerprint of the set and a histogram, and counts shingles in a sketch.
   Texts with equal sets are one class from here on.
2. Shingles have one total order: by the level of their counter in the sketch
   (rare first), then by hash. A second scan takes each class's prefix. If two
   sets are similar enough, their prefixes meet. Classes with the same prefix and
   size are one group, and only groups are posted under the prefix's shingles.
3. Every group finds the group of near size that it shares most prefix shingles
   with; that pair of groups is filtered and verified on whole sets of their
   first members, and the other members of a group on its first one. That makes as
   many pairs as there are classes, however large a family of near copies is.
   Linked classes are one family from here on.
4. Groups under a shingle where several families still meet are expanded to
   members, which are compared by size, position and histogram where they stand;
   members of one family aren't paired. Twice, each member has only its likeliest
   partner verified, and families that are linked become one; then every pair
   that the bounds let through and that wasn't verified is.

Any two linked texts end in one family: a pair is verified, or already in one
family, or filtered by a bound that proves there is no link.

Verification compares whole sets of 64-bit shingle hashes. Texts of classes in
pairs are sent to their partner's task in sorted order, hot partners dealt over
several tasks. A shingle with many members is cut into tiles of TILE members, and
each pair of tiles is compared in a task of its own. Nothing that grows with the
documents is collected or broadcast: the driver sees HEAVY counters at most.

Defined results: null or empty text has no shingles and is linked with nothing.
Rows are nodes: repeated rows are linked, rows with the same id but other texts
only if their texts are. The component of a row whose id is null is the
smallest id of its links, or null. Ids may have any type with an order. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm._arrow import bounded_batches, give_back, mix64, release, slices, text_buffers, written
from threadloom.llm.components import components
from threadloom.llm.shingles import shingle_sets

#: Counters of the sketch in a task, which reports those that chance doesn't
#: explain; of all reported, the HEAVY heaviest have levels of their own. They only
#: order shingles: with others, the result is the same.
SKETCH = 1 << 22
HEAVY = 1 << 18
#: 64-bit words of a set's histogram: 16 cells of four bits in each.
WORDS = 16
BITS = [f"b{i}" for i in range(WORDS)]
#: Up to so many texts are looked up by broadcast locators (16 bytes each); for more
#: the texts are shuffled.
BROADCAST_ROWS = 200_000
#: A partner with more pairs than this is dealt over several tasks.
SALT_PAIRS = 256
#: Members of a tile: two tiles of about 100 bytes a member are compared at once.
TILE = 2048


def _at_least(n: np.ndarray, pct: int) -> np.ndarray:
    return (pct * n + 99) // 100


def _sets(batches: Iterator[pa.RecordBatch], text: int, k: int):
    for batch in batches:
        raw, offs = text_buffers(batch.column(text))
        for a, b in slices(offs):
            values, at = shingle_sets(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], k)
            yield batch.slice(a, b - a), values, at
        give_back()


def _sum_by(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=total[1:])
        return total[at[1:]] - total[at[:-1]]


def _class_ids(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of a set, as two sums over its members."""
    with np.errstate(over="ignore"):
        one = _sum_by(mix64(values + np.uint64(1)), at)
        two = _sum_by(mix64(values ^ np.uint64(0x5851F42D4C957F2D)), at)
    return mix64(one).view(np.int64), two.view(np.int64)


def _histograms(values: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """Shingles counted by a hash into 16 * WORDS cells, modulo 16."""
    cells = 16 * WORDS
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    count = np.bincount(row * cells + (values >> np.uint64(24)).astype(np.int64) % cells, minlength=(len(at) - 1) * cells).astype(np.uint8) & 15
    words = (count[0::2] | count[1::2] << 4).view(np.int64).reshape(-1, WORDS)
    return [pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS)]


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of the sets' symmetric difference: over all cells, the sum of
    the distances of counts around a circle of 16. Rows of words; all cells of a
    word at once."""
    top, low = np.uint64(0x8888888888888888), np.uint64(0x7777777777777777)
    d = ((x | top) - (y & low)) ^ ((x ^ ~y) & top)  # each cell's difference modulo 16
    over = d & top
    d ^= over | (over - (over >> np.uint64(3)))  # from 8 on, 15 less the difference
    total = np.bitwise_count(over).astype(np.int32)
    for bit in range(3):
        total += np.bitwise_count(d & np.uint64(0x1111111111111111 << bit)).astype(np.int32) << bit
    return total.sum(axis=1, dtype=np.int64)


def _distance_floor(na: np.ndarray, nb: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """A lower bound of the Jaccard distance from sizes and _differing."""
    apart = np.maximum(differing, np.abs(na - nb))
    return 2 * apart / (na + nb + apart)


class _Fresh:
    """Marks the first row of each non-empty class in a task; its memory is
    bounded, so a class may be marked again much later, which is only repeated."""

    def __init__(self) -> None:
        self.seen = np.zeros(0, np.int64)

    def __call__(self, c1: np.ndarray, n: np.ndarray) -> np.ndarray:
        first = np.zeros(len(c1), bool)
        first[np.unique(c1, return_index=True)[1]] = True
        take = np.flatnonzero(first & (n > 0) & ~np.isin(c1, self.seen))
        self.seen = np.concatenate([self.seen, c1[take]])[-200_000:]
        return take


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """Kind 0: id, locator, class, n and histogram of each row; kind 1: a counter
    of the sketch (in ``c1``) and its count (in ``n``) in one task."""
    names = ["kind", "id", "rk", "rk2", "c1", "c2", "n", *BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, fresh, id_type = np.zeros(SKETCH, np.int32), _Fresh(), None
        for some, values, at in _sets(batches, 3, k):
            c1, c2 = _class_ids(values, at)
            n = np.diff(at)
            keep = np.zeros(len(n), bool)
            keep[fresh(c1, n)] = True
            np.add.at(sketch, (values[np.repeat(keep, n)] & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            id_type = some.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), *some.columns[:3], *map(pa.array, (c1, c2, n)), *_histograms(values, at)], names=names)
        chance = sketch.sum() / SKETCH
        often = np.flatnonzero(sketch >= chance + 5 * math.sqrt(chance) + 2)
        for a in range(0, len(often), 1 << 16):
            i = often[a : a + (1 << 16)]
            none, zero = pa.nulls(len(i), id_type), pa.array(np.zeros(len(i), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(i), np.int32)), none, zero, zero, pa.array(i), zero, pa.array(sketch[i].astype(np.int64)), *[zero] * WORDS], names=names)

    kept = docs.schema["id"].dataType.simpleString()
    return written(docs.mapInArrow(run, f"kind int, id {kept}, rk long, rk2 long, c1 long, c2 long, n long, " + ", ".join(f"{b} long" for b in BITS)))


def _levels(profile: DataFrame) -> np.ndarray:
    """For each counter of the sketch 0, or the level of its count (four to a
    doubling) if it is among the HEAVY heaviest levels."""
    counts = profile.where("kind = 1").groupBy(F.col("c1").alias("i")).agg(F.sum("n").alias("n"))
    counts = written(counts.select("i", F.least(F.lit(255), F.floor(4 * F.log2("n"))).cast("int").alias("level")))
    spread = sorted(((r.level, r["count"]) for r in counts.groupBy("level").count().collect()), reverse=True)
    lowest, total = 256, 0
    for level, many in spread:
        total += many
        if total > HEAVY:
            break
        lowest = level
    out = np.zeros(SKETCH, np.uint8)
    heavy = counts.where(F.col("level") >= lowest).toArrow()
    out[heavy.column("i").to_numpy()] = heavy.column("level").to_numpy()
    return out


def _postings(docs: DataFrame, k: int, pct: int, levels: np.ndarray) -> DataFrame:
    """Kind 1: (token, gid, n, pos) of each group's prefix; kind 0: a class (in
    ``token`` and ``c2``) and its group."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, fresh = shared.value, _Fresh()
        for _, values, at in _sets(batches, 0, k):
            c1, c2 = _class_ids(values, at)
            n = np.diff(at)
            take = fresh(c1, n)
            if not len(take):
                continue
            text = np.repeat(np.arange(len(n)), n)
            order = np.argsort(level[(values & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")
            order = order[np.argsort(text[order].astype(np.uint16 if len(n) < 1 << 16 else np.int64), kind="stable")]
            length = n[take] - _at_least(n[take], pct) + 1
            doc = np.repeat(np.arange(len(take)), length)
            ends = np.cumsum(length)
            pos = np.arange(len(doc)) - np.repeat(ends - length, length)
            token = values[order[at[:-1][take][doc] + pos]]
            with np.errstate(over="ignore"):
                group = mix64(_sum_by(mix64(token + (pos.astype(np.uint64) << np.uint64(32))), np.concatenate([[0], ends])) + n[take].astype(np.uint64)).view(np.int64)
            for kind, columns in ((0, (c1[take], c2[take], group, n[take], n[take])), (1, (token.view(np.int64), np.zeros(len(doc), np.int64), group[doc], n[take][doc], pos))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns[:3]), *(pa.array(c.astype(np.int32)) for c in columns[3:])], names=["kind", "token", "c2", "gid", "n", "pos"])

    return written(docs.select("text").mapInArrow(run, "kind int, token long, c2 long, gid long, n int, pos int"))


def _fits(pct: int, na: str, nb: str, pa_: str, pb: str) -> F.Column:
    """Size and position filter of two postings."""
    need = F.ceil(F.lit(pct) * (F.col(na) + F.col(nb)) / F.lit(100 + pct))
    return F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb)) >= need


def _bounded(pairs: DataFrame, pct: int) -> DataFrame:
    """(a, b) of the pairs of structs x and y (cid, n, histogram) whose sizes and
    histograms allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([batch.column(c).field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2 + WORDS)] for c in (0, 1))
            bits = (np.stack(c[2:], axis=1).view(np.uint64) for c in (x, y))
            near = _distance_floor(x[1], y[1], _differing(*bits)) <= 1 - pct / 100 + 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(y[0][near]), pa.array(x[0][near])], names=["a", "b"])

    return pairs.select("x", "y").mapInArrow(run, "a long, b long")


def _first_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (cid, text) the first of each class in a task, so that rows repeated
    as they are don't travel; there are BROADCAST_ROWS classes at most."""
    seen: set[int] = set()
    for batch in batches:
        new = []
        for i, cid in enumerate(batch.column(0).to_pylist()):
            if cid not in seen:
                seen.add(cid)
                new.append(i)
        yield batch.take(pa.array(new, pa.int64()))


def verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, pct: int) -> DataFrame:
    """(a, b, ta, tb, linked) of distinct pairs (a, b, ta, tb) of classes, whose
    sets are compared whole. Written to the shared folder."""
    pairs = written(pairs)
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_PAIRS).cast("int").alias("salts"))
    dealt = pairs.join(hot, "a").select(F.col("b").alias("cid"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", "ta", "tb")
    none = [F.lit(None).cast("long").alias(c) for c in ("b", "ta", "tb")]
    left = hot.select(F.col("a").alias("cid"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *none)
    roles = held_roles = written(left.unionByName(dealt))
    wanted = written(classes.select("cid", "rk", "rk2").join(roles.select("cid").distinct(), "cid"))
    if roles.count() <= BROADCAST_ROWS:  # more than are wanted: texts move once, to their partners
        texts = docs.join(F.broadcast(wanted), ["rk", "rk2"]).select("cid", "text").mapInArrow(_first_in_task, "cid long, text string")
        roles = F.broadcast(roles)
    else:  # rows with the same id and text are alike: one goes on
        texts = docs.join(wanted, ["rk", "rk2"]).groupBy("rk", "rk2", "cid").agg(F.min("text").alias("text"))
    rows = texts.join(roles, "cid").select("a", "salt", "b", "ta", "tb", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, whose, last = np.zeros(0, np.uint64), None, None
        for some, values, at in _sets(batches, 5, k):
            out = []
            for i, (a, salt, b, ta, tb) in enumerate(zip(*(some.column(c).to_pylist() for c in range(5)))):
                own = values[at[i] : at[i + 1]]
                if (a, salt, b) == last:
                    continue  # the same row from another task
                last = a, salt, b
                if b is None:
                    held, whose = own, (a, salt)
                    continue
                if whose != (a, salt):
                    raise RuntimeError("a text that was there in an earlier pass is missing: the table changed")
                spot = np.minimum(np.searchsorted(held, own), len(held) - 1)
                both = int((held[spot] == own).sum())
                out.append((a, b, ta, tb, 100 * both >= pct * (len(held) + len(own) - both)))
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*out))[:4]), pa.array([x[4] for x in out])], names=["a", "b", "ta", "tb", "linked"])

    found = written(rows.mapInArrow(run, "a long, b long, ta long, tb long, linked boolean"))
    release(pairs, held_roles, wanted)
    return found


def _families(df: DataFrame, k: int, pct: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """A row (id, rk, rk2, c1, c2, n) for each row of ``df``, and the family of
    each non-empty class (c1, c2, top)."""
    base = bounded_batches(df).select(F.col(id_col).alias("id"), *locator(id_col, text_col), F.col(text_col).alias("text"))
    profile = _profile(base, k)
    rows = profile.where("kind = 0").drop("kind", *BITS)
    same = profile.where("kind = 0 AND n > 0").groupBy("c1", "c2")
    classes = same.agg(F.min(F.struct("rk", "rk2")).alias("at"), F.min("n").alias("n"), *[F.min(b).alias(b) for b in BITS])
    docs = base.where("text IS NOT NULL").select("rk", "rk2", "text")
    posted = _postings(docs, k, pct, _levels(profile))
    member = posted.where("kind = 0").select(F.col("token").alias("c1"), "c2", "gid").dropDuplicates(["c1", "c2"])
    classes = classes.join(member, ["c1", "c2"]).select("c1", "c2", "gid", "at.rk", "at.rk2", "n", *BITS)
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()))
    tokens = posted_tokens = _tokens(posted, pct)
    release(posted)
    state = classes.select("cid", "gid", F.col("cid").alias("top"), "n", *BITS)
    inner = state.groupBy("gid").count().where("count > 1").select(F.col("gid").alias("token"), "gid", F.lit(0).alias("pos"))
    found = verify(docs, classes, _first_pairs(tokens, state, pct), k, pct)
    state = _merged(state, found)
    tokens = tokens.select("token", "gid", "pos").unionByName(inner)  # members of a group meet, too
    unlinked = found.where("NOT linked").select("a", "b")
    for best_only in (True, True, False):
        pairs = written(_candidates(tokens, state, pct, best_only))
        if pairs.isEmpty():
            break  # no two families may be linked any more
        if best_only:  # where no pair is near enough now, none will be later: families only grow
            tokens, before = written(tokens.join(pairs.select("token").distinct(), "token", "left_semi")), posted_tokens
            release(before)
            posted_tokens = tokens
        found = verify(docs, classes, pairs.drop("token").distinct().join(unlinked, ["a", "b"], "left_anti"), k, pct)
        state, before = _merged(state, found), state
        release(before, pairs)
        unlinked = unlinked.unionByName(found.where("NOT linked").select("a", "b"))
    return rows, classes.select("cid", "c1", "c2").join(state.select("cid", "top"), "cid").drop("cid")


def locator(id_col: str, text_col: str) -> list[F.Column]:
    """128 bits of a row's id and text."""
    return [F.xxhash64(id_col, text_col).alias("rk"), F.xxhash64(F.lit(11), text_col, F.lit(1), id_col).alias("rk2")]


def _tokens(posted: DataFrame, pct: int) -> DataFrame:
    """(token, gid, pos, g1, g2) of shingles with several postings; g1 and g2 are
    groups there that allow a link: the smallest of like size, and the one before."""
    by_token = Window.partitionBy("token").orderBy("n", "gid")
    tokens = posted.where("kind = 1").select("token", "gid", "n", "pos")
    tokens = tokens.withColumns({"pg": F.lag("gid").over(by_token), "pn": F.lag("n").over(by_token), "pp": F.lag("pos").over(by_token), "ng": F.lead("gid").over(by_token)})
    # groups repeat if copies lie in several partitions: keep the first
    tokens = tokens.where("pg IS NULL OR pg <> gid OR pn <> n").where("NOT (pg IS NULL AND ng IS NULL)")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / pct))) if pct < 100 else F.col("n")
    star = Window.partitionBy("token", "band").orderBy("n", "gid")
    tokens = tokens.withColumn("band", band).withColumns({"fg": F.first("gid").over(star), "fn": F.first("n").over(star), "fp": F.first("pos").over(star)})
    g1 = F.when((F.col("fg") != F.col("gid")) & _fits(pct, "n", "fn", "pos", "fp"), F.col("fg"))
    g2 = F.when((F.col("pg") != F.col("gid")) & _fits(pct, "n", "pn", "pos", "pp"), F.col("pg"))
    return written(tokens.select("token", "gid", "pos", g1.alias("g1"), g2.alias("g2")))


def _first_pairs(tokens: DataFrame, state: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b, ta, tb) of classes: a group's first member with that of the
    group it shares most shingles with, and the other members with the first."""
    facts = F.struct("cid", F.col("n").cast("long").alias("n"), *BITS)
    groups = state.groupBy("gid").agg(F.min(facts).alias("x"), F.count("*").alias("members"))
    shared = tokens.select("gid", F.explode(F.array("g1", "g2")).alias("g")).where("g IS NOT NULL").groupBy("gid", "g").agg(F.count("*").alias("common"))
    best = shared.groupBy("gid").agg(F.max_by("g", F.struct("common", -F.col("g"))).alias("g"))
    lone = best.join(groups.select("gid", "x"), "gid").join(groups.select(F.col("gid").alias("g"), F.col("x").alias("y")), "g").select("x", "y")
    inner = state.select("gid", facts.alias("x")).join(groups.where("members > 1").select("gid", F.col("x").alias("y")), "gid").where("x.cid <> y.cid").select("x", "y")
    return _bounded(lone.unionByName(inner), pct).withColumns({"ta": F.col("a"), "tb": F.col("b")})


def _merged(state: DataFrame, found: DataFrame) -> DataFrame:
    """``state`` with linked families as one."""
    top = components(found.where("linked").select(F.col("ta").alias("a"), F.col("tb").alias("b"))).withColumnRenamed("node", "top")
    return written(state.join(top, "top", "left").select("cid", "gid", F.coalesce("root", "top").alias("top"), "n", *BITS))


def _candidates(tokens: DataFrame, state: DataFrame, pct: int, best_only: bool) -> DataFrame:
    """Pairs (token, a, b, ta, tb) of members of different families under one
    shingle, a < b, whose sizes, positions and histograms allow a link; or of each
    member only the one with its nearest partner there. A pair may come several times."""
    groups = state.groupBy("gid").agg(F.min("top").alias("lo"), F.max("top").alias("hi"), F.count("*").alias("m"))
    live = tokens.join(groups, "gid").groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("m").alias("m"))
    live = live.where("lo <> hi").select("token", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))
    rows = tokens.join(live, "token").join(state, "gid").withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumns({"p": F.least("tile", "other"), "q": F.greatest("tile", "other")})
    rows = rows.select("token", "p", "q", "tile", "cid", "top", "n", "pos", *BITS).repartition("token", "p", "q").sortWithinPartitions("token", "p", "q", "n", "cid")
    return rows.mapInArrow(_compared(pct, best_only), "token long, a long, b long, ta long, tb long")


def _compared(pct: int, best_only: bool):
    """An Arrow function over rows (token, p, q, tile, cid, top, n, pos, histogram)
    sorted by tile pair and size. Every row is compared with the next, the second
    next and so on, all rows at once, until the pair ends or sizes are too far."""
    limit = 1 - pct / 100 + 1e-9

    def pairs(columns: list[np.ndarray], bits: np.ndarray):
        token, p, q, tile, cid, top, n, pos = columns
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        end = np.append(np.flatnonzero(new), len(token))[np.cumsum(new)]
        best, mate = np.full(len(token), np.inf), np.full(len(token), -1)
        active, step = np.arange(len(token)), 0
        while True:
            step += 1
            active = active[active + step < end[active]]
            active = active[100 * n[active] >= pct * n[active + step]]
            if not len(active):
                break
            i = active[top[active] != top[active + step]]
            j = i + step
            ok = (tile[i] != tile[j]) | (p[i] == q[i])
            ok &= np.minimum(n[i] - pos[i], n[j] - pos[j]) >= -(-pct * (n[i] + n[j]) // (100 + pct))
            i, j = i[ok], j[ok]
            for part in (slice(0, 4), slice(0, WORDS)):  # a quarter is enough for most
                least = _distance_floor(n[i], n[j], _differing(bits[i, part], bits[j, part]))
                ok = least <= limit
                i, j, least = i[ok], j[ok], least[ok]
            if not best_only:
                yield i, j
                continue
            for x, y in ((i, j), (j, i)):
                better = least < best[x]
                best[x[better]], mate[x[better]] = least[better], y[better]
        if best_only:
            i = np.flatnonzero(mate >= 0)
            yield i, mate[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        seen = np.zeros(0, np.uint64)

        def fresh(x: np.ndarray, y: np.ndarray, cid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            nonlocal seen
            with np.errstate(over="ignore"):
                key = mix64(mix64(cid[x].view(np.uint64)) + cid[y].view(np.uint64))
            first = np.unique(key, return_index=True)[1]
            first = first[~np.isin(key[first], seen)]
            seen = np.concatenate([seen, key[first]])[-200_000:]
            return x[first], y[first]

        def done() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held)]
            token, cid, top, bits = columns[0], columns[4], columns[5], np.stack(columns[8:], axis=1).view(np.uint64)
            for i, j in pairs(columns[:8], bits):
                x, y = np.where(cid[i] < cid[j], i, j), np.where(cid[i] < cid[j], j, i)
                if not best_only:  # the token doesn't matter: a pair once, or again much later
                    x, y = fresh(x, y, cid)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (token[x], cid[x], cid[y], top[x], top[y])], names=["token", "a", "b", "ta", "tb"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy().astype(np.int64) for c in range(8 + WORDS)]
            last = np.flatnonzero(np.any([c != c[-1] for c in columns[:3]], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last tile pair may go on in the next batch
            if cut or (held and any(h[-1] != c[0] for h, c in zip(held[-1][:3], columns))):
                held.append([c[:cut] for c in columns])
                yield from done()
                held = []
            held.append([c[cut:] for c in columns])
        if held:
            yield from done()

    return run


def jaccard_components(df: DataFrame, k: int = 4, pct: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row: texts are linked when
    100 * intersection >= pct * union of their ``k``-word shingle sets."""
    rows, family = _families(df, k, pct, id_col, text_col)
    least = rows.where("n > 0").groupBy("c1", "c2").agg(F.min("id").alias("least"))
    named = family.join(least, ["c1", "c2"])
    named = named.join(named.groupBy("top").agg(F.min("least").alias("c")), "top").select("c1", "c2", "c")
    out = rows.join(named, ["c1", "c2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"))


def keep_one(df: DataFrame, k: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``df``: that of the smallest id (null ids come
    after all others), among equal ids that of the smallest hash of id and text.
    Texts without shingles all stay; of rows with the same id and text, one."""
    rows, family = _families(df, k, pct, id_col, text_col)
    first = rows.groupBy("c1", "c2", (F.col("n") > 0).alias("some"), F.when(F.col("n") == 0, F.struct("rk", "rk2")).alias("alone"))
    first = first.agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "rk", "rk2")).alias("x")).drop("alone")
    kept = first.where("some").join(family, ["c1", "c2"]).groupBy("top").agg(F.min("x").alias("x")).select("x.rk", "x.rk2")
    kept = written(kept.unionByName(first.where("NOT some").select("x.rk", "x.rk2")))
    at = dict(zip(("__rk", "__rk2"), locator(id_col, text_col)))
    kept = kept.select(F.col("rk").alias("__rk"), F.col("rk2").alias("__rk2"))
    return df.withColumns(at).join(kept, ["__rk", "__rk2"], "left_semi").dropDuplicates(["__rk", "__rk2"]).drop("__rk", "__rk2")
