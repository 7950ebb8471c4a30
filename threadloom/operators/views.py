"""The read model: views as functions of the ledger's frames.

``t`` is a mapping from table name to frame: segments, members, tombstones,
episodes, items, observations, ideas, evidence, events, connections,
connection_kinds, lineage, edge_methods, merges, verdicts, proposals, themes,
idea_themes, sensitivity. Ids are strings; arrays of segments are bridged once
and joined by equality. Events are folded by their highest id."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.graph import shown_edges
from threadloom.primitives import explode_bridge, latest_by, terminals

Tables = Mapping[str, DataFrame]


def last(value: str | Column, when: Column, order: str = "event_id") -> Column:
    """Aggregate: the value of the latest row for which ``when`` holds."""
    value = F.col(value) if isinstance(value, str) else value
    return F.max_by(value, F.when(when, F.col(order)))


def payload(name: str) -> Column:
    return F.get_json_object("payload", f"$.{name}")


def has_field(name: str) -> Column:
    return F.array_contains(F.json_object_keys("payload"), name)


def current_segments(t: Tables) -> DataFrame:
    """M1: members that aren't forgotten."""
    return t["members"].join(t["segments"], "segment_id").join(t["tombstones"].select("segment_id"), "segment_id", "left_anti")


def item_said_by(t: Tables) -> DataFrame:
    """M2: the current label of the line it was said on, else the recorded one."""
    labels = t["segments"].select(F.col("segment_id").alias("said_by_segment_id"), "speaker_label")
    return t["items"].join(labels, "said_by_segment_id", "left").select("item_id", F.coalesce("speaker_label", "said_by").alias("said_by"))


def item_speaker(t: Tables) -> DataFrame:
    """M3: me where a line of mine is known by voice, name or channel, me_diar
    where only otherwise, else not_me."""
    lines = explode_bridge(t["items"].select("item_id", "source_segment_ids"), "source_segment_ids", "segment_id")
    known = lines.join(t["segments"].where("speaker_kind = 'owner'").select("segment_id", "speaker_basis"), "segment_id")
    sure = F.bool_or(F.col("speaker_basis").isin("voice", "named", "channel"))
    mine = known.groupBy("item_id").agg(F.when(sure, "me").otherwise("me_diar").alias("speaker"))
    return t["items"].select("item_id").join(mine, "item_id", "left").select("item_id", F.coalesce("speaker", F.lit("not_me")).alias("speaker"), F.col("speaker").isNotNull().alias("cites_me"))


def observation_speaker(t: Tables) -> DataFrame:
    """M4: of the latest capture, current episodes first, then the smaller id."""
    current = t["episodes"].select("episode_id", "current")
    rows = t["items"].where("observation_id IS NOT NULL").join(current, "episode_id", "left").join(item_speaker(t), "item_id")
    order = F.struct((~F.coalesce("current", F.lit(False))).cast("int"), -F.unix_micros("created_at"), "item_id")
    return rows.groupBy("observation_id").agg(F.min_by("speaker", order).alias("speaker"))


def card_moments(t: Tables) -> DataFrame:
    """When each capture was said: its first line, else its observation."""
    lines = explode_bridge(t["items"].select("item_id", "source_segment_ids"), "source_segment_ids", "segment_id")
    first = lines.join(t["segments"].select("segment_id", "started_at", "conversation_id"), "segment_id").groupBy("item_id").agg(F.min("started_at").alias("said"), F.min("conversation_id").alias("conversation"))
    said = t["observations"].select("observation_id", "said_at")
    return t["items"].select("item_id", "observation_id").join(first, "item_id", "left").join(said, "observation_id", "left").select("item_id", F.coalesce("said", "said_at").alias("at"), "conversation")


def idea_observations(t: Tables) -> DataFrame:
    """M5: (idea, observation, source, speaker, said_at, conversation) of captured,
    archived and typed observations."""
    moments = card_moments(t)
    spoken = t["evidence"].join(t["items"].where("observation_id IS NOT NULL").select("item_id", "observation_id"), "item_id").join(moments, "item_id")
    spoken = spoken.groupBy("idea_id", "observation_id").agg(F.min("at").alias("said_at"), F.min("conversation").alias("conversation"))
    kinds = t["observations"].select("observation_id", "source")
    spoken = spoken.join(kinds, "observation_id").join(observation_speaker(t), "observation_id", "left").select("idea_id", "observation_id", "source", "speaker", "said_at", "conversation")
    own = t["observations"].where("source <> 'speech' AND idea_id IS NOT NULL")
    typed = own.select("idea_id", "observation_id", "source", F.col("said_by").alias("speaker"), "said_at", "conversation")
    return spoken.unionByName(typed.join(spoken.select("idea_id", "observation_id"), ["idea_id", "observation_id"], "left_anti"))


def merged_into(t: Tables) -> DataFrame:
    """(idea_id, into): where each merged idea is now."""
    ends = terminals(t["merges"].select(F.col("other_id").alias("src"), F.col("keep_id").alias("dst")))
    return ends.select(F.col("node").alias("idea_id"), F.col("terminal").alias("into"))


def idea_text(t: Tables) -> DataFrame:
    """M6: title and statement by the latest correction of each (an empty one
    reverts), my note, and when; merged ideas left out."""
    said = t["events"].where("kind IN ('correct', 'note')")
    fixed = said.groupBy("idea_id").agg(
        last(payload("title"), (F.col("kind") == "correct") & has_field("title")).alias("new_title"),
        last(payload("statement"), (F.col("kind") == "correct") & has_field("statement")).alias("new_statement"),
        last(payload("note"), F.col("kind") == "note").alias("note"),
        F.max(F.when(F.col("kind") == "correct", F.col("at"))).alias("corrected_at"),
    )
    ideas = t["ideas"].join(t["merges"].select(F.col("other_id").alias("idea_id")), "idea_id", "left_anti").join(fixed, "idea_id", "left")
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    return ideas.select("idea_id", F.coalesce(given("new_title"), F.col("title")).alias("title"), F.coalesce(given("new_statement"), F.col("statement")).alias("statement"), given("note").alias("my_note"), "corrected_at")


def idea_kept(t: Tables) -> DataFrame:
    """M7: kept by my latest keep or unkeep, else my own ideas canonical, else
    starred ones pinned."""
    fold = t["events"].groupBy("idea_id").agg(
        last(F.struct("kind", payload("as").alias("as")), F.col("kind").isin("keep", "unkeep")).alias("mark"), last("kind", F.col("kind").isin("star", "unstar")).alias("star")
    )
    kept = F.when(F.col("mark.kind") == "keep", F.coalesce("mark.as", F.lit("canonical"))).when(F.col("mark.kind") == "unkeep", None).when(F.col("origin") == "mine", "canonical").when(F.col("star") == "star", "pinned")
    return t["ideas"].select("idea_id", "origin").join(fold, "idea_id", "left").select("idea_id", kept.alias("kept_as"))


def idea_maturity(t: Tables) -> DataFrame:
    """M8: kept: idea; with an observation of mine: candidate; else observation."""
    mine = idea_observations(t).where("speaker IN ('me', 'me_diar')").select("idea_id", F.lit(True).alias("own")).distinct()
    rows = idea_kept(t).join(mine, "idea_id", "left")
    return rows.select("idea_id", F.when(F.col("kept_as").isNotNull(), "idea").when(F.col("own"), "candidate").otherwise("observation").alias("maturity"))


def capture_verdict(t: Tables) -> DataFrame:
    """The latest verdict over all captures of one observation."""
    key = F.coalesce("observation_id", "item_id").alias("key")
    rows = t["verdicts"].join(t["items"].select("item_id", key), "item_id")
    latest = latest_by(rows.select("key", "decided_at", "verdict_id", "verdict"), ["key"], ["decided_at", "verdict_id"])
    return t["items"].select("item_id", key).join(latest.select("key", "verdict"), "key", "left").select("item_id", "verdict")


def evidence(t: Tables) -> DataFrame:
    """One capture for each idea and observation: judged first, then the
    origin, then the earliest."""
    rows = t["evidence"].join(t["items"].select("item_id", F.coalesce("observation_id", "item_id").alias("key"), "quote", F.col("created_at").alias("captured_at")), "item_id").join(capture_verdict(t), "item_id")
    order = F.struct(F.col("verdict").isNull().cast("int"), (F.col("relation") != "origin").cast("int"), "captured_at", "item_id")
    best = rows.groupBy("idea_id", "key").agg(F.min_by(F.struct("item_id", "quote", "relation", "verdict", "captured_at"), order).alias("x"))
    return best.select("idea_id", "x.*")


def ideas(t: Tables) -> DataFrame:
    """Ideas that are mine or have evidence not discarded."""
    e = evidence(t).groupBy("idea_id").agg(F.count_if(~F.col("verdict").eqNullSafe(F.lit("discard"))).alias("n_evidence"), F.min("captured_at").alias("first_said"), F.bool_or(F.col("verdict") == "star").alias("starred"))
    themes = t["idea_themes"].groupBy("idea_id").agg(F.array_sort(F.collect_set("theme_id")).alias("themes"))
    rows = idea_text(t).join(t["ideas"].select("idea_id", "origin"), "idea_id").join(e, "idea_id", "left").join(themes, "idea_id", "left")
    return rows.withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0))).where("origin = 'mine' OR n_evidence > 0").withColumn("starred", F.coalesce("starred", F.lit(False)))


def my_link_events(t: Tables) -> DataFrame:
    """(a, b, kind, event_id) of links and unlinks, ends through merges."""
    up = merged_into(t)
    e = t["events"].where("kind IN ('link', 'unlink')")
    for c in ("idea_id", "other_idea_id"):
        e = e.join(up.select(F.col("idea_id").alias(c), F.col("into").alias(f"to_{c}")), c, "left").withColumn(c, F.coalesce(f"to_{c}", c))
    return e.select(F.col("idea_id").alias("a"), F.col("other_idea_id").alias("b"), "kind", "event_id").where("a <> b")


def shown_connections(t: Tables) -> DataFrame:
    """Edges as I left them."""
    return shown_edges(t["connections"].select("a", "b", "method"), my_link_events(t), t["edge_methods"].select("method", "seen_event_id"))


def card_links(t: Tables) -> DataFrame:
    """Shown edges with their kinds, and lineage, between visible cards."""
    seen = ideas(t).select("idea_id")
    kinds = t["connection_kinds"].groupBy("a", "b").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    undirected = shown_connections(t).join(kinds, ["a", "b"], "left").select("a", "b", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), F.lit(False).alias("directed"))
    directed = t["lineage"].select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.array("kind").alias("kinds"), F.lit(True).alias("directed"))
    out = undirected.unionByName(directed)
    return out.join(seen.withColumnRenamed("idea_id", "a"), "a", "left_semi").join(seen.withColumnRenamed("idea_id", "b"), "b", "left_semi")


def cards(t: Tables) -> DataFrame:
    """Each card's observations by speaker, conversations, times, links."""
    by = lambda *s: F.count_distinct(F.when(F.col("speaker").isin(*s), F.col("observation_id")))
    counts = idea_observations(t).groupBy("idea_id").agg(
        F.count_distinct("observation_id").alias("n_observations"), by("me").alias("n_me"), by("me_diar").alias("n_me_diar"), by("not_me").alias("n_not_me"),
        F.count_distinct("conversation").alias("n_conversations"), F.min("said_at").alias("first_said"), F.max("said_at").alias("last_said"),
    )
    links = card_links(t).select(F.explode(F.array("a", "b")).alias("idea_id")).groupBy("idea_id").agg(F.count("*").alias("n_links"))
    proposed = t["proposals"].where("outcome IS NULL").select("idea_id", F.lit(True).alias("proposed")).distinct()
    rows = idea_text(t).join(counts, "idea_id", "left").join(links, "idea_id", "left").join(proposed, "idea_id", "left").join(idea_maturity(t), "idea_id").join(idea_kept(t), "idea_id")
    return rows.fillna(0, ["n_observations", "n_me", "n_me_diar", "n_not_me", "n_conversations", "n_links"]).fillna(False, ["proposed"])


def proposals(t: Tables) -> DataFrame:
    """Open, not kept, and not dismissed since it was made."""
    dismissed = t["events"].where("kind = 'dismiss'").groupBy("idea_id").agg(F.max("at").alias("dismissed_at"))
    kept = idea_kept(t).where("kept_as IS NOT NULL").select("idea_id")
    rows = t["proposals"].where("outcome IS NULL").join(kept, "idea_id", "left_anti").join(dismissed, "idea_id", "left")
    return rows.where("dismissed_at IS NULL OR dismissed_at < made_at").drop("dismissed_at")


def themes(t: Tables) -> DataFrame:
    """M17."""
    n = t["idea_themes"].groupBy("theme_id").agg(F.count_distinct("idea_id").alias("n_ideas"))
    return t["themes"].join(n, "theme_id", "left").fillna(0, ["n_ideas"])


def sensitive(t: Tables) -> DataFrame:
    """By my latest mark, else by any category found."""
    marks = t["events"].where("kind IN ('sensitive', 'not_sensitive')").groupBy("idea_id").agg(F.max_by("kind", "event_id").alias("mark"))
    found = t["sensitivity"].select("idea_id", (F.size("categories") > 0).alias("found"))
    rows = t["ideas"].select("idea_id").join(marks, "idea_id", "left").join(found, "idea_id", "left")
    return rows.select("idea_id", F.when(F.col("mark").isNotNull(), F.col("mark") == "sensitive").otherwise(F.coalesce("found", F.lit(False))).alias("sensitive"))


def demo_cards(t: Tables) -> DataFrame:
    """Sensitive cards keep their counts and lose their words."""
    rows = cards(t).join(sensitive(t), "idea_id", "left")
    blank = lambda c: F.when(~F.coalesce("sensitive", F.lit(True)), F.col(c)).alias(c)
    words = {"title", "statement", "my_note"}
    return rows.select(*[blank(c) if c in words else F.col(c) for c in rows.columns if c != "sensitive"])


def demo_evidence(t: Tables) -> DataFrame:
    """No evidence of sensitive ideas."""
    return evidence(t).join(sensitive(t).where("sensitive").select("idea_id"), "idea_id", "left_anti")


def observation_arousal(t: Tables) -> DataFrame:
    """M22."""
    lines = explode_bridge(t["observations"].select("observation_id", "segment_ids"), "segment_ids", "segment_id")
    return lines.join(t["segments"].select("segment_id", "arousal"), "segment_id").groupBy("observation_id").agg(F.avg("arousal").alias("arousal"))
