"""Re-derivation and curation: purges, work discovery, reconciliation, ordered
folds of curation events, decisions from judges' answers."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators.graph import neighbourhoods
from threadloom.primitives import closure, explode_bridge


def touching(df: DataFrame, key: str, segments: str, dead: DataFrame) -> DataFrame:
    """Keys of rows whose array of segments holds a forgotten one."""
    return explode_bridge(df.select(key, segments), segments, "segment_id").join(dead.select("segment_id"), "segment_id", "left_semi").select(key).distinct()


def purged(t: Mapping[str, DataFrame], dead: DataFrame) -> dict[str, DataFrame]:
    """Frames without anything that a forgotten segment reaches: ideas (and all
    merged into them), captures, observations, verdicts and episodes go; arrays
    are trimmed in order; payloads of requests are blanked."""
    ideas = touching(t["ideas"], "idea_id", "segment_ids", dead)
    merged = t["merges"].select(F.col("keep_id").alias("src"), F.col("other_id").alias("dst"))
    gone = closure(merged, ideas.select(F.col("idea_id").alias("node"))).select(F.col("reached").alias("idea_id")).distinct()
    items = touching(t["items"], "item_id", "source_segment_ids", dead)
    out = {
        "ideas": t["ideas"].join(gone, "idea_id", "left_anti"),
        "items": t["items"].join(items, "item_id", "left_anti"),
        "observations": t["observations"].join(touching(t["observations"], "observation_id", "segment_ids", dead), "observation_id", "left_anti"),
        "verdicts": t["verdicts"].join(items, "item_id", "left_anti"),
        "evidence": t["evidence"].join(items, "item_id", "left_anti").join(gone, "idea_id", "left_anti"),
        "episodes": t["episodes"].join(touching(t["episodes"], "episode_id", "segment_ids", dead), "episode_id", "left_anti"),
    }
    sent = touching(t["egress_log"], "egress_id", "segment_ids", dead).withColumn("hit", F.lit(True))
    out["egress_log"] = t["egress_log"].join(sent, "egress_id", "left").withColumn("payload", F.when(F.col("hit").isNull(), F.col("payload"))).drop("hit")
    out["attention"] = trimmed(t["attention"].join(dead.select(F.col("segment_id").alias("cue_segment_id")), "cue_segment_id", "left_anti"), "attention_id", "segment_ids", dead)
    return out


def trimmed(df: DataFrame, key: str, array: str, dead: DataFrame) -> DataFrame:
    """``array`` without forgotten members, in order."""
    left = explode_bridge(df.select(key, array), array, "segment_id", "at").join(dead.select("segment_id"), "segment_id", "left_anti")
    kept = left.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "segment_id"))), lambda x: x["segment_id"]).alias("__kept"))
    return df.join(kept, key, "left").withColumn(array, F.coalesce("__kept", F.array().cast("array<string>"))).drop("__kept")


def sessions_needing_work(episodes: DataFrame, parts: DataFrame, current: DataFrame, stage_version: str) -> DataFrame:
    """Sessions with an episode of another version, an episode holding a segment
    that isn't current, or a current segment in no current episode."""
    live = episodes.where("current")
    stale = live.where(F.col("stage_version") != stage_version).select("session_id")
    lost = live.join(parts, "episode_id").join(current.select("segment_id"), "segment_id", "left_anti").select("session_id")
    held = live.select("episode_id").join(parts, "episode_id").select("segment_id")
    new = current.join(held, "segment_id", "left_anti").select("session_id")
    return stale.union(lost).union(new).distinct()


def reconciled(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """(episode_id, action): insert, retire, revive or keep."""
    both = existing.select("episode_id", F.col("current").alias("was")).join(desired.select("episode_id", F.lit(True).alias("wanted")), "episode_id", "full")
    action = F.when(F.col("was").isNull(), "insert").when(F.col("wanted").isNull() & F.col("was"), "retire").when(F.col("wanted") & ~F.col("was"), "revive").when(F.col("wanted"), "keep")
    return both.select("episode_id", action.alias("action")).where("action IS NOT NULL")


def combined(question: str, p: Column) -> Column:
    """One probability from a map of answers: the mean for tension and edge, the
    least for analogy, else the greatest."""
    values = F.map_values(p)
    if question in ("tension", "edge"):
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    return F.array_min(values) if question == "analogy" else F.array_max(values)


def answered(p: Column, cut: float | None = None, yes: float = 0.7, no: float = 0.3) -> Column:
    """yes, no or unsure."""
    if cut is not None:
        return F.when(p >= cut, "yes").otherwise("no")
    return F.when(p >= yes, "yes").when(p <= no, "no").otherwise("unsure")


def edge_label(connected: Column, same: Column, kinds: Mapping[str, Column], cut: float = 0.8, half: float = 0.5) -> Column:
    """none below the cut, same, the likeliest kind (ties to the later name), else
    related."""
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(k).alias("k")) for k, p in kinds.items()]))
    return F.when(connected < cut, "none").when(same >= half, "same").when(best["p"] >= half, best["k"]).otherwise("related")


def typed_observations(events: DataFrame, observations: DataFrame, ideas: DataFrame, merges: DataFrame) -> DataFrame:
    """One observation for each idea of mine (``ideas``: idea_id, origin), from the
    first event that added it, unless it has one or was merged away (``merges``:
    other_id)."""
    first = events.where("kind = 'idea_add'").groupBy("idea_id").agg(F.min("event_id").alias("event_id"), F.min_by("at", "event_id").alias("said_at"))
    own = first.join(ideas.where("origin = 'mine'").select("idea_id"), "idea_id", "left_semi")
    for gone in (observations.where("source = 'typed'").select("idea_id"), merges.select(F.col("other_id").alias("idea_id"))):
        own = own.join(gone, "idea_id", "left_anti")
    return own.select("idea_id", "said_at", F.lit("typed").alias("source"), F.lit("me").alias("said_by"))


def carried_by_observation(items: DataFrame, matches: DataFrame) -> DataFrame:
    """(item_id, idea_id): an unmatched capture joins the idea of the earliest
    matched capture of its observation."""
    known = items.join(matches.where("idea_id IS NOT NULL"), "item_id").groupBy("observation_id").agg(F.min_by("idea_id", F.struct("created_at", "item_id")).alias("idea_id"))
    return items.join(matches.select("item_id"), "item_id", "left_anti").join(known, "observation_id").select("item_id", "idea_id")


def quota_limited(pairs: DataFrame, n: int, most: int = 2) -> DataFrame:
    """The first ``n`` pairs (a, b, place) by place in which no end is used more
    than ``most`` times: each choice depends on those before it, so it is one
    group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict = {}
        out = []
        for r in pdf.sort_values("place").itertuples():
            if len(out) < n and used.get(r.a, 0) < most and used.get(r.b, 0) < most:
                used[r.a] = used.get(r.a, 0) + 1
                used[r.b] = used.get(r.b, 0) + 1
                out.append((r.a, r.b, r.place))
        return pd.DataFrame(out, columns=["a", "b", "place"])

    return pairs.select("a", "b", "place", F.lit(0).alias("one")).groupBy("one").applyInPandas(run, "a long, b long, place long")


def filed(answers: DataFrame, letters: DataFrame, blocks: DataFrame, most: int = 2) -> DataFrame:
    """(idea_id, theme_id, nth): letters of an answer to themes, each once in
    order, without blocked ones, at most ``most``."""
    rows = answers.select("idea_id", F.posexplode("letters").alias("at", "letter")).join(letters, "letter")
    first = rows.groupBy("idea_id", "theme_id").agg(F.min("at").alias("at")).join(blocks, ["idea_id", "theme_id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("idea_id").orderBy("at"))
    return first.select("idea_id", "theme_id", nth.alias("nth")).where(F.col("nth") <= most)


class ThemeLog:
    """Themes folded from an ordered log of curation events. Each event gives a
    result; names are compared without case."""

    def __init__(self) -> None:
        self.themes: dict[str, dict] = {}
        self.members: dict[str, set[str]] = {}
        self.blocks: set[tuple[str, str]] = set()
        self.rejected: set[str] = set()

    def add(self, theme: str, name: str, origin: str = "clustered", status: str = "active") -> None:
        self.themes[theme] = {"name": name, "origin": origin, "status": status, "pinned": False}
        self.members.setdefault(theme, set())

    def _taken(self, name: str, but: str | None = None) -> bool:
        return any(t["name"].lower() == name.lower() for k, t in self.themes.items() if k != but)

    def apply(self, kind: str, theme: str | None = None, idea: str | None = None, other: str | None = None, name: str | None = None, ideas: tuple[str, ...] = ()) -> str:
        t = self.themes.get(theme or "")
        if t is None and kind != "split":
            return "unknown theme"
        name = (name or "").strip()
        if kind in ("pin", "unpin"):
            if t["pinned"] == (kind == "pin"):
                return "repeat"
            t["pinned"] = kind == "pin"
        elif kind == "rename":
            if not name:
                return "no name"
            if self._taken(name, theme):
                return "name taken"
            t["name"] = name
        elif kind == "reject":
            if t["pinned"] or t["origin"] != "clustered":
                return "kept"
            self.rejected.add(t["name"].lower())
            del self.themes[theme], self.members[theme]
        elif kind == "merge":
            if other not in self.themes or other == theme:
                return "unknown theme"
            self.members[other] |= {i for i in self.members[theme] if (i, other) not in self.blocks}
            if t["status"] == "proposed":
                self.rejected.add(t["name"].lower())
            del self.themes[theme], self.members[theme]
        elif kind == "split":
            if not name:
                return "no name"
            if self._taken(name):
                return "name taken" if t is not None else "repeat"
            moved = self.members.get(theme or "", set()) & set(ideas)
            self.add(f"{theme}/{name.lower()}", name, "mine")
            self.members[f"{theme}/{name.lower()}"] |= moved
            if theme in self.members:
                self.members[theme] -= moved
            return f"moved {len(moved)}"
        elif kind == "file":
            if idea in self.members[theme]:
                return "repeat"
            self.blocks.discard((idea, theme))
            self.members[theme].add(idea)
        elif kind == "unfile":
            self.blocks.add((idea, theme))
            if idea not in self.members[theme]:
                return "repeat"
            self.members[theme].discard(idea)
        else:
            return "unknown kind"
        return "applied"


def theme_results(events: DataFrame, themes: DataFrame) -> DataFrame:
    """(event_id, result) of the whole log in order. Each event depends on names and
    members left by those before it, so themes and curation events (typed by hand)
    are one group; nothing goes through the driver."""

    def run(pdf: pd.DataFrame, themes: pd.DataFrame) -> pd.DataFrame:
        log = ThemeLog()
        for row in themes.sort_values("theme_id").itertuples():
            log.add(row.theme_id, row.name, row.origin, row.status)
        out = [(e.event_id, log.apply(e.kind, e.theme_id, e.idea_id, e.other, e.name, tuple(e.ideas) if e.ideas is not None else ())) for e in pdf.sort_values("event_id").itertuples()]
        return pd.DataFrame(out, columns=["event_id", "result"])

    return events.select("event_id", "kind", "theme_id", "idea_id", "other", "name", "ideas", F.lit(0).alias("one")).groupBy("one").cogroup(themes.select("theme_id", "name", "origin", "status", F.lit(0).alias("one")).groupBy("one")).applyInPandas(run, "event_id long, result string")


def threads(edges: DataFrame, moments: DataFrame, least: int = 3, conversations: int = 2) -> DataFrame:
    """(label, cards, conversations, began): neighbourhoods of at least ``least``
    cards said in at least ``conversations``."""
    groups = neighbourhoods(edges).withColumnRenamed("node", "card").join(moments, "card")
    g = groups.groupBy("label").agg(F.count_distinct("card").alias("cards"), F.count_distinct("conversation").alias("conversations"), F.min("at").alias("began"))
    return g.where((F.col("cards") >= least) & (F.col("conversations") >= conversations))


def tree(edges: DataFrame, most: int = 32, also: int = 2) -> DataFrame:
    """(card, lens, main): cards on the ``most`` largest neighbourhoods, and on
    others to which at least ``also`` of their edges lead."""
    groups = neighbourhoods(edges)
    sizes = groups.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most)
    lens = groups.join(F.broadcast(sizes.select("label")), "label")
    main = lens.select(F.col("node").alias("card"), F.col("label").alias("lens"), F.lit(True).alias("main"))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    leads = both.join(lens.select(F.col("node").alias("b"), F.col("label").alias("lens")), "b").groupBy(F.col("a").alias("card"), "lens").agg(F.count("*").alias("n")).where(F.col("n") >= also)
    extra = leads.join(main.select("card", "lens"), ["card", "lens"], "left_anti").join(main.select("card"), "card", "left_semi")
    return main.unionByName(extra.select("card", "lens", F.lit(False).alias("main")))
