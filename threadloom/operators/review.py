"""Lists for review, decisions from answers, and texts about cards. Like the views,
functions of the ledger's frames ``t``; answers come as columns of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import squeezed
from threadloom.operators import views
from threadloom.operators.views import Tables, payload
from threadloom.primitives import explode_bridge, latest_by, terminals

# Patterns and numbers of the rules below (fixed values).
NOTE_TO_SELF = r"(?i)\bnote to (my)?self\b"
NOT_A_STATEMENT = r"(?i)[\"“”]|^\s*\w+:\s|\bI said\b|\b(me|someone|S\d+|unknown):"
SOMEONE_SAYS = r"(?i)\bsomeone (says|said)\b"
MEMBERS = 3
SIDE_QUOTES = 2


def note_to_self(text: Column) -> Column:
    """Whether a line has the cue; a plain search comes first."""
    return text.ilike("%note to %self%") & text.rlike(NOTE_TO_SELF)


def statement(answer: Column, gist: Column, relayed: Column) -> Column:
    """An answer's statement, unless it is empty, reads as speech, or names
    "someone" where nothing was relayed; else the gist."""
    said = F.trim(F.coalesce(answer, F.lit("")))
    unfit = (said == "") | said.rlike(NOT_A_STATEMENT) | (said.rlike(SOMEONE_SAYS) & (F.coalesce(relayed, F.lit("")) == ""))
    return F.when(unfit, gist).otherwise(said)


def how(payload_column: Column) -> Column:
    """Bulk before audit before one; only a JSON true counts."""
    marks = F.from_json(payload_column, "bulk boolean, audit boolean")
    return F.when(marks["bulk"], "bulk").when(marks["audit"], "audit").otherwise("one")


def family(model: Column) -> Column:
    """Who makes a model: a prefix before a slash, but for bare names."""
    return F.when(model.startswith("claude"), "anthropic").otherwise(F.split_part(model, F.lit("/"), F.lit(1)))


def route(model: Column) -> Column:
    """A bare dated or undated name as a route with its version dotted."""
    return F.regexp_replace(model, r"^claude-([a-z]+)-(\d+)-(\d+)(?:-\d{8})?$", r"anthropic/claude-$1-$2.$3")


def version_label(model: Column, prompt: Column, policy: Column, current: str) -> Column:
    """Model and prompt version, and the policy if it isn't the current one."""
    return F.concat_ws(" ", model, prompt, F.when(policy != current, policy))


def fact_line(rows: DataFrame) -> DataFrame:
    """``rows`` with ``facts``: how far a card is, who said it, where and when,
    and its edges; empty parts are left out."""
    many = lambda n, word: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {word}"), F.when(F.col(n) == 1, "").otherwise("s")))
    said = F.concat_ws(", ", *[F.when(F.col(c) > 0, F.concat_ws(" ", F.col(c).cast("string"), F.lit(label))) for c, label in (("n_me", "me"), ("n_me_diar", "me (diarization)"), ("n_not_me", "not me"))])
    state = F.concat(F.coalesce(F.concat(F.lit("kept as "), F.col("kept_as")), F.col("maturity")), F.when(F.col("proposed"), " · proposed").otherwise(""))
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("—"))
    when = F.when(F.col("first_said").isNotNull(), F.concat_ws(" → ", day("first_said"), day("last_said"))).otherwise(day("last_said"))
    return rows.withColumn("facts", F.concat_ws(" · ", state, F.when(said != "", said).otherwise(F.col("origin")), many("n_conversations", "conversation"), when, many("n_links", "edge")))


def _current_captures(t: Tables) -> DataFrame:
    """Captures on current episodes and archived ones, with when they were said."""
    e = t["episodes"].select("episode_id", "current", F.col("started_at").alias("began"))
    o = t["observations"].select("observation_id", F.col("said_at").alias("archived_at"))
    rows = t["items"].join(e, "episode_id", "left").join(o, "observation_id", "left")
    rows = rows.withColumn("at", F.coalesce("began", F.when(F.col("episode_id").isNull(), F.col("archived_at"))))
    return rows.where("current OR episode_id IS NULL").withColumn("point", F.coalesce("observation_id", "item_id"))


def side_data(t: Tables) -> DataFrame:
    """(idea_id, nth, quote, said_on, me): up to two things said for each idea,
    mine first, then by day and quote."""
    speakers = views.observation_speaker(t).select("observation_id", (F.col("speaker") == "me").alias("me"))
    rows = _current_captures(t).where("current").join(t["evidence"].select("idea_id", "item_id"), "item_id").join(speakers, "observation_id")
    one = rows.groupBy("idea_id", "observation_id").agg(F.min_by(F.struct("quote", F.to_date("began").alias("said_on"), "me"), F.struct("created_at", "item_id")).alias("x")).select("idea_id", "x.*")
    own = t["observations"].where("idea_id IS NOT NULL").select("idea_id", "quote", F.to_date("said_at").alias("said_on"), (F.col("said_by") == "me").alias("me"))
    nth = F.row_number().over(Window.partitionBy("idea_id").orderBy(F.desc("me"), F.asc_nulls_last("said_on"), F.asc_nulls_last("quote")))
    return one.unionByName(own).withColumn("nth", nth).where(F.col("nth") <= SIDE_QUOTES)


def cluster_members(t: Tables) -> DataFrame:
    """(idea_id, nth, gist, quote): each idea's newest observations, one row
    for each: captures by their latest, an idea's own ones by what was typed."""
    rows = _current_captures(t).join(t["evidence"].select("idea_id", "item_id"), "item_id")
    one = rows.groupBy("idea_id", "point").agg(F.max_by(F.struct("gist", "quote", "at"), F.struct("at", "item_id")).alias("x")).select("idea_id", "x.*")
    own = t["observations"].where("idea_id IS NOT NULL AND source <> 'speech'").select("idea_id", F.col("quote").alias("gist"), "quote", F.col("said_at").alias("at"))
    nth = F.row_number().over(Window.partitionBy("idea_id").orderBy(F.desc_nulls_first("at"), "quote"))
    return one.unionByName(own).withColumn("nth", nth).where(F.col("nth") <= MEMBERS).select("idea_id", "nth", "gist", "quote")


def pending_items(t: Tables) -> DataFrame:
    """Current and archived captures that aren't matched, with their latest
    verdict and their place, oldest first."""
    latest = latest_by(t["verdicts"].select("item_id", "decided_at", "verdict_id", "verdict"), ["item_id"], ["decided_at", "verdict_id"]).select("item_id", "verdict")
    rows = _current_captures(t).join(t["evidence"].select("item_id"), "item_id", "left_anti").join(latest, "item_id", "left").join(views.item_said_by(t).withColumnRenamed("said_by", "by"), "item_id")
    return rows.select("item_id", "by", "verdict", "at")


def relayed_clusters(t: Tables) -> DataFrame:
    """Ideas that began with something relayed."""
    return t["evidence"].where("relation = 'origin'").join(t["items"].where("coalesce(attributed_to, '') <> ''").select("item_id"), "item_id", "left_semi").select("idea_id").distinct()


def segments_of(t: Tables) -> DataFrame:
    """(idea_id, segment_id): the lines an idea rests on, each once."""
    rows = t["evidence"].select("idea_id", "item_id").join(t["items"].select("item_id", "source_segment_ids"), "item_id")
    return explode_bridge(rows.select("idea_id", "source_segment_ids"), "source_segment_ids", "segment_id").distinct()


def forgotten_sent(tombstones: DataFrame, sent: DataFrame) -> DataFrame:
    """(segment_id, first_sent, requests) of forgotten lines that had gone
    out; ``sent``: request, at, segment_ids."""
    lines = explode_bridge(sent.select("at", "segment_ids"), "segment_ids", "segment_id")
    return lines.join(tombstones.select("segment_id").distinct(), "segment_id", "left_semi").groupBy("segment_id").agg(F.min("at").alias("first_sent"), F.count("*").alias("requests"))


def undecided(t: Tables) -> DataFrame:
    """One capture for each current observation on which neither a verdict nor
    feedback fell: its earliest."""
    key = F.coalesce("observation_id", "item_id").alias("point")
    points = t["items"].select("item_id", key)
    judged = points.join(t["verdicts"].select("item_id"), "item_id", "left_semi").select("point")
    noted = points.join(t["events"].where("item_id IS NOT NULL").select("item_id"), "item_id", "left_semi").select("point")
    rows = _current_captures(t).where("current").join(judged.unionByName(noted).distinct(), "point", "left_anti")
    return rows.groupBy("point").agg(F.min_by(F.struct("item_id", "quote"), F.struct("created_at", "item_id")).alias("x")).select("x.item_id", "x.quote")


def discards(t: Tables) -> DataFrame:
    """Captures whose own latest verdict is discard."""
    latest = latest_by(t["verdicts"].select("item_id", "decided_at", "verdict_id", "verdict"), ["item_id"], ["decided_at", "verdict_id"])
    return latest.where("verdict = 'discard'").join(t["items"].select("item_id", "quote"), "item_id").select("item_id", "quote", "decided_at")


def status(t: Tables) -> DataFrame:
    """One row of counts."""
    i = views.ideas(t).agg(F.count("*").alias("ideas"), F.count_if(F.col("origin") == "captured").alias("captured"), F.count_if(F.col("origin") == "mine").alias("added_by_me"), F.count_if(F.col("n_evidence") > 1).alias("with_more"))
    n = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))
    return i.crossJoin(n(views.shown_connections(t), "connections")).crossJoin(n(pending_items(t), "unmatched"))  # one row each


def card_evidence(t: Tables) -> DataFrame:
    """Current captures, archived captures and typed observations of ideas."""
    lines = explode_bridge(t["items"].select("item_id", "source_segment_ids"), "source_segment_ids", "segment_id")
    first = lines.join(t["segments"].select("segment_id", "conversation_id"), "segment_id").groupBy("item_id").agg(F.min("conversation_id").alias("conversation"))
    rows = t["evidence"].select("idea_id", "item_id").join(t["items"].drop("source_segment_ids"), "item_id").join(views.item_speaker(t).select("item_id", "speaker"), "item_id")
    current = t["episodes"].where("current").select("episode_id", F.col("started_at").alias("at"))
    columns = ["idea_id", "item_id", "observation_id", "speaker", "quote", "at", "conversation", "source", "arousal"]
    speech = rows.join(current, "episode_id").join(first, "item_id", "left").join(views.observation_arousal(t), "observation_id", "left").withColumn("source", F.lit("speech"))
    o = t["observations"].select("observation_id", F.col("said_at").alias("at"), "conversation", "source")
    archived = rows.where("episode_id IS NULL").join(o, "observation_id").withColumn("arousal", F.lit(None).cast("double"))
    typed = t["observations"].where("source <> 'speech' AND idea_id IS NOT NULL")
    typed = typed.select("idea_id", F.lit(None).cast("string").alias("item_id"), "observation_id", F.col("said_by").alias("speaker"), "quote", F.col("said_at").alias("at"), "conversation", "source", F.lit(None).cast("double").alias("arousal"))
    return speech.select(columns).unionByName(archived.select(columns)).unionByName(typed.select(columns))


def digests(t: Tables) -> DataFrame:
    """Each digest with its points as JSON, in order: only ideas that are
    still seen, and my latest response to the point (null: none)."""
    seen = views.ideas(t).select("idea_id")
    p = t["digest_points"]
    kept = p.select("digest_id", "ord", F.posexplode("idea_ids").alias("at", "idea_id")).join(seen, "idea_id", "left_semi")
    kept = kept.groupBy("digest_id", "ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "idea_id"))), lambda x: x["idea_id"]).alias("ids"))
    said = t["events"].where("kind IN ('digest_star', 'digest_dismiss')")
    said = said.groupBy(payload("digest_id").cast("long").alias("digest_id"), payload("point").cast("long").alias("ord")).agg(F.max_by(F.replace("kind", F.lit("digest_"), F.lit("")), "event_id").alias("mine"))
    rows = p.select("digest_id", "ord", "kind", "title").join(kept, ["digest_id", "ord"], "left").join(said, ["digest_id", "ord"], "left")
    point = F.struct(F.col("ord").alias("point"), "kind", "title", F.coalesce("ids", F.array().cast("array<string>")).alias("idea_ids"), "mine")
    points = rows.groupBy("digest_id").agg(F.to_json(F.array_sort(F.collect_list(point)), {"ignoreNullFields": "false"}).alias("points"))
    return t["digests"].join(points, "digest_id", "left").select("digest_id", "summary", F.coalesce("points", F.lit("[]")).alias("points"))


def apart(t: Tables, judged: DataFrame, page: int = 0, size: int = 50) -> DataFrame:
    """A page of pairs (a, b) judged not to connect, both ends still seen, in
    order of their ids, and whether there are more."""
    seen = views.ideas(t).select("idea_id")
    rows = judged.where("verdict = 'none'").select("a", "b")
    for c in ("a", "b"):
        rows = rows.join(seen.withColumnRenamed("idea_id", c), c, "left_semi")
    cut = rows.orderBy("a", "b").offset(page * size).limit(size + 1)
    return cut.withColumn("n", F.row_number().over(Window.orderBy("a", "b"))).withColumn("more", F.max("n").over(Window.partitionBy()) > size).where(F.col("n") <= size).drop("n")  # one page


def resolved_reviews(reviews: DataFrame, merges: DataFrame) -> DataFrame:
    """Reviews (review_id, idea_ids) whose ideas are one after all merges."""
    ends = terminals(merges.select(F.col("other_id").alias("src"), F.col("keep_id").alias("dst")))
    rows = explode_bridge(reviews.select("review_id", "idea_ids"), "idea_ids", "idea_id").join(ends.select(F.col("node").alias("idea_id"), "terminal"), "idea_id", "left")
    return rows.groupBy("review_id").agg(F.count_distinct(F.coalesce("terminal", "idea_id")).alias("n")).where("n = 1").select("review_id")


def looked_up(refs: DataFrame, ids: DataFrame, merged: DataFrame) -> DataFrame:
    """(ref, id, problem) for each reference (ref: a full id or the beginning
    of one): the one id, or why there is none. References are joined by their length
    and beginning, so no pair is compared."""
    lengths = refs.select(F.length("ref").alias("n")).distinct()
    starts = ids.select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("id")), lambda n: F.struct(n.alias("n"), F.substring(F.col("id"), F.lit(1), n).alias("ref"))))).alias("x")).select("id", "x.n", "x.ref")
    starts = starts.join(F.broadcast(lengths), "n", "left_semi")  # as many rows as an id has letters
    found = refs.distinct().join(starts.select("ref", "id"), "ref", "left").groupBy("ref").agg(F.count("id").alias("n"), F.min("id").alias("id"))
    rows = found.join(merged.select(F.col("idea_id").alias("id"), "into"), "id", "left")
    problem = F.when(F.col("n") == 0, "none").when(F.col("n") > 1, "ambiguous").when(F.col("into").isNotNull(), F.concat(F.lit("merged into "), F.col("into")))
    return rows.select("ref", F.when(problem.isNull(), F.col("id")).alias("id"), problem.alias("problem"))


def added_ideas(events: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new ideas, links they ask for, refused events) from idea_add events: the
    first well-formed one makes an idea; ids of ideas that aren't mine are refused;
    links to unknown ideas, to itself and repeated ones are left out."""
    adds = events.where("kind = 'idea_add' AND idea_id IS NOT NULL").withColumns({"title": payload("title"), "statement": payload("statement")}).where("title IS NOT NULL AND statement IS NOT NULL")
    rows = adds.join(known.select("idea_id", F.col("origin").alias("was")), "idea_id", "left")
    refused = rows.where("was <> 'mine'").select("event_id", "idea_id")
    made = latest_by(rows.where("was IS NULL").select("idea_id", "event_id", "title", "statement", "payload"), ["idea_id"], [-F.col("event_id")])
    new = made.select("idea_id", F.trim("title").alias("title"), F.trim("statement").alias("statement"), F.nullif(F.trim(F.coalesce(payload("note"), F.lit(""))), F.lit("")).alias("note"))
    to = F.from_json(F.coalesce(payload("link_to"), F.lit("[]")), "array<string>")
    asked = made.select("idea_id", F.explode(to).alias("other")).where("other <> idea_id").distinct()
    there = known.select(F.col("idea_id").alias("other")).unionByName(new.select(F.col("idea_id").alias("other"))).distinct()
    return new, asked.join(there, "other", "left_semi").select("idea_id", "other"), refused


def answered_items(payloads: DataFrame, answers: DataFrame) -> DataFrame:
    """K7: (payload, nth, quote, segment_ids): an answer's captures with their lines
    as segments. Payloads: payload, segment_ids; answers: payload, nth, quote, lines.
    Lines that don't exist are dropped, and captures left without one."""
    rows = answers.join(payloads, "payload")
    real = F.array_sort(F.array_distinct(F.filter("lines", lambda n: (n >= 1) & (n <= F.size("segment_ids")))))
    rows = rows.withColumn("real", real).where(F.size("real") > 0)
    return rows.select("payload", "nth", "quote", F.transform("real", lambda n: F.element_at("segment_ids", n.cast("int"))).alias("segment_ids"))


def started_in(quote: Column, texts: Column, cited: Column) -> Column:
    """K8: the place (from 0) of the message in which a quote starts, when the
    messages are joined by spaces; the cited one if it isn't there."""
    at = F.instr(F.array_join(texts, " "), squeezed(quote)) - 1
    ends = F.transform(texts, lambda x, i: F.aggregate(F.slice(texts, 1, i + 1), F.lit(0), lambda s, v: s + F.length(v) + 1))
    return F.when(at < 0, cited).otherwise(F.size(F.filter(ends, lambda e: e <= at)))


def digest_points(answers: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(digest_id, ord, kind, title, body, idea_ids): points of a known kind that
    cite an idea shown, renumbered; titles of 200 and bodies of 2,000 characters at
    most. Answers: digest_id, nth, kind, title, body, cited, shown."""
    real = F.transform(F.array_distinct(F.filter("cited", lambda n: (n >= 1) & (n <= F.size("shown")))), lambda n: F.element_at("shown", n.cast("int")))
    rows = answers.where(F.col("kind").isin(*kinds)).withColumn("idea_ids", real).where(F.size("idea_ids") > 0)
    ord_ = F.row_number().over(Window.partitionBy("digest_id").orderBy("nth"))
    return rows.select("digest_id", ord_.alias("ord"), "kind", F.left("title", F.lit(200)).alias("title"), F.left("body", F.lit(2000)).alias("body"), "idea_ids")


def tags(probabilities: dict[str, Column], cut: float = 0.5) -> Column:
    """Names, in their order, whose rounded probability reaches the cut."""
    return F.filter(F.array(*[F.when(F.round(p, 3) >= cut, F.lit(k)) for k, p in probabilities.items()]), lambda x: x.isNotNull())


def match_decisions(answers: DataFrame) -> DataFrame:
    """(item_id, decision, idea_id, review): the nearest candidate that makes the
    same point, by its place; several are also a review; none makes a new idea.
    Answers: item_id, candidates, same (places from 1 that make the same point)."""
    real = F.array_sort(F.array_distinct(F.filter("same", lambda n: (n >= 1) & (n <= F.size("candidates")))))
    ids = F.transform("real", lambda n: F.element_at("candidates", n.cast("int")))
    rows = answers.withColumn("real", real).withColumn("ids", ids)
    return rows.select("item_id", F.when(F.size("ids") > 0, "same_as").otherwise("new").alias("decision"), F.get("ids", F.lit(0)).alias("idea_id"), F.when(F.size("ids") > 1, F.col("ids")).alias("review"))


def refiled(idea_themes: DataFrame, checks: DataFrame, corrected: DataFrame) -> DataFrame:
    """Placements left after ideas corrected since they were filed lose those
    that were assigned or proposed."""
    stale = corrected.join(checks, "idea_id").where("corrected_at > checked_at").select("idea_id")
    drop = idea_themes.where("origin IN ('assigned', 'proposed')").join(stale, "idea_id", "left_semi").select("idea_id", "theme_id")
    return idea_themes.join(drop, ["idea_id", "theme_id"], "left_anti")


def unrelated(sims: DataFrame) -> DataFrame:
    """I8: pairs (a, b, sim), a < b, below the exact median of all pairs."""
    middle = sims.agg(F.percentile("sim", 0.5).alias("middle"))
    return sims.crossJoin(F.broadcast(middle)).where("sim < middle").select("a", "b", "sim")  # one row
