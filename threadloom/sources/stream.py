"""The utterance stream: a polled folder of ``index.json``, one JSON-lines file for
each conversation, and ``forgotten.json``. Reads are declarative; a file whose
hash isn't the index's is left for the next poll."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import canonical_json, uuid5
from threadloom.primitives import interval_join

FORMAT_VERSION = 1
#: Namespace of segment ids (fixed value).
SEGMENTS = "0b8f4f5e-6a43-4d1f-9a3c-2f7e9d1c5b60"
KINDS = ("owner", "person", "anonymous", "stranger", "unknown")
INDEX = "format_version int, conversations array<struct<conversation_id:string,start:string,end:string,open:boolean,transcribed:boolean,taps:array<string>,places:array<struct<name:string,start:string,end:string>>,utterances:int,revision:string,transcript_revision:string,file:string>>"
LINE = (
    "conversation_id string, utterance_id string, start string, end string, text string, speaker struct<kind:string,name:string,label:string>, text_confidence double, "
    "speaker_confidence struct<basis:string,owner_similarity:double>, affect struct<arousal:double>, delivery struct<words_per_second:double,pauses:int,pause_seconds:double,stutters:array<struct<kind:string,at:string,words_per_second_before:double>>>"
)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations of the index. Another format version is an error."""
    index = spark.read.schema(INDEX).json(f"{folder}/index.json", multiLine=True)
    right = F.assert_true(F.col("format_version").eqNullSafe(F.lit(FORMAT_VERSION)), "unknown format_version")
    places = F.assert_true(F.coalesce(F.forall("c.places", lambda p: p["name"].isNotNull() & (p["start"] <= p["end"])), F.lit(True)), "a place is wrong")
    return index.where(right.isNull()).select(F.explode("conversations").alias("c")).where(places.isNull()).select("c.*")


def to_read(index: DataFrame, stored: DataFrame) -> DataFrame:
    """Conversations never read, of another revision (null-safe), or of an older
    stage: ``stored`` has conversation_id, revision, stale."""
    had = stored.select("conversation_id", F.col("revision").alias("__r"), "stale", F.lit(True).alias("__had"))
    joined = index.join(had, "conversation_id", "left")
    return joined.where(F.col("__had").isNull() | ~F.col("revision").eqNullSafe(F.col("__r")) | F.col("stale")).select(*index.columns)


def read_utterances(spark: SparkSession, folder: str, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(utterances, raced): lines of files whose hash is the index's revision, and
    the conversations whose file has changed since. A broken line is an error."""
    files = spark.read.format("binaryFile").load(f"{folder}/conversations/*.jsonl")
    files = files.select(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("conversation_id"), F.substring(F.sha2("content", 256), 1, 16).alias("found"), F.col("content").cast("string").alias("body"))
    wanted = index.where("file IS NOT NULL").select("conversation_id", "revision", "transcript_revision").join(files, "conversation_id", "left")
    raced = wanted.where(~F.col("found").eqNullSafe(F.col("revision"))).select("conversation_id")
    lines = wanted.where("found = revision").select("conversation_id", "transcript_revision", F.explode(F.split(F.rtrim("body"), "\n")).alias("line")).where("line <> ''")
    parsed = lines.select("conversation_id", "transcript_revision", F.from_json("line", LINE, {"mode": "FAILFAST"}).alias("u"))
    kind = F.assert_true(F.col("u.speaker.kind").isin(*KINDS), "unknown speaker kind").isNull()
    return utterances(parsed.where(kind)), raced


def utterances(parsed: DataFrame) -> DataFrame:
    """Typed records with content-addressed segment ids."""
    u = F.col("u")
    identity = F.struct(F.col("conversation_id"), u["end"].alias("end"), u["start"].alias("start"), u["text"].alias("text"))
    name = F.concat(F.col("conversation_id"), F.lit("|"), F.sha2(canonical_json(identity), 256))
    who = u["speaker"]
    return parsed.select(
        uuid5(F.lit(SEGMENTS), name).alias("segment_id"), "conversation_id", "transcript_revision", u["utterance_id"].alias("utterance_id"),
        F.to_timestamp(u["start"]).alias("started_at"), F.to_timestamp(u["end"]).alias("ended_at"), u["text"].alias("text"), who["kind"].alias("speaker_kind"),
        F.when(who["kind"] == "owner", "me").otherwise(F.coalesce(who["name"], who["label"], who["kind"])).alias("speaker_label"),
        F.when(who["kind"] == "owner", True).when(who["kind"] == "unknown", None).otherwise(False).alias("is_self"),
        u["speaker_confidence"]["basis"].alias("speaker_basis"), u["speaker_confidence"]["owner_similarity"].cast("float").alias("speaker_conf"),
        u["text_confidence"].cast("float").alias("asr_confidence"), u["affect"]["arousal"].cast("float").alias("arousal"), u["delivery"].alias("delivery"),
    )


def read_forgotten(spark: SparkSession, folder: str) -> DataFrame:
    """Spans to forget; a missing file or bound is an error."""
    spans = spark.read.schema("forgotten_at string, start string, end string, conversation_id string, utterance_ids array<string>, reason string").json(f"{folder}/forgotten.json", multiLine=True)
    whole = F.assert_true(F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("forgotten_at").isNotNull(), "a span is not whole").isNull()
    return spans.where(whole).select(F.to_timestamp("start").alias("started_at"), F.to_timestamp("end").alias("ended_at"), F.to_timestamp("forgotten_at").alias("forgotten_at"), "reason")


def tombstones(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """(segment_id, forgotten_at, reason): every version of a segment that overlaps
    a span, in any conversation; touching isn't overlapping."""
    us = F.unix_micros
    seg = segments.select("segment_id", us("started_at").alias("l_start"), us("ended_at").alias("l_end"))
    cut = spans.select(us("started_at").alias("r_start"), us("ended_at").alias("r_end"), "forgotten_at", "reason")
    return interval_join(seg, cut, 3_600_000_000).groupBy("segment_id").agg(F.min("forgotten_at").alias("forgotten_at"), F.min_by("reason", "forgotten_at").alias("reason"))


def revision_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(segment_id, change) of one conversation's revisions: arrived, gone,
    relabelled (another speaker), refreshed (other annotations) or same."""
    side = lambda df, p: df.select("segment_id", F.struct("speaker_kind", "speaker_label", "is_self").alias(f"{p}_who"), F.struct("arousal", "asr_confidence", "speaker_conf").alias(f"{p}_notes"), F.lit(True).alias(f"{p}_is"))
    both = side(old, "o").join(side(new, "n"), "segment_id", "full")
    change = F.when(F.col("o_is").isNull(), "arrived").when(F.col("n_is").isNull(), "gone").when(~F.col("o_who").eqNullSafe(F.col("n_who")), "relabelled").when(~F.col("o_notes").eqNullSafe(F.col("n_notes")), "refreshed").otherwise("same")
    return both.select("segment_id", change.alias("change"))


def supersessions(gone: DataFrame, arrived: DataFrame) -> DataFrame:
    """(old_segment_id, new_segment_id, method): first by the same words and times,
    then by utterance under one transcript, else by overlap with any arrival."""
    o = gone.select(*[F.col(c).alias(f"o_{c}") for c in ("segment_id", "conversation_id", "started_at", "ended_at", "text", "utterance_id", "transcript_revision")])
    n = arrived.select(*[F.col(c).alias(f"n_{c}") for c in ("segment_id", "conversation_id", "started_at", "ended_at", "text", "utterance_id", "transcript_revision")])
    out = lambda df, how: df.select(F.col("o_segment_id").alias("old_segment_id"), F.col("n_segment_id").alias("new_segment_id"), F.lit(how).alias("method"))
    same = [F.col(f"o_{c}") == F.col(f"n_{c}") for c in ("conversation_id", "started_at", "ended_at", "text")]
    rekey = out(o.join(n, same), "rekey")
    left = o.join(rekey.select(F.col("old_segment_id").alias("o_segment_id")), "o_segment_id", "left_anti")
    keys = [F.col(f"o_{c}") == F.col(f"n_{c}") for c in ("conversation_id", "utterance_id", "transcript_revision")]
    by_id = out(left.join(n, keys), "utterance_id")
    rest = left.join(by_id.select(F.col("old_segment_id").alias("o_segment_id")), "o_segment_id", "left_anti")
    us = F.unix_micros
    met = interval_join(rest.select("o_segment_id", us("o_started_at").alias("l_start"), us("o_ended_at").alias("l_end")), n.select("n_segment_id", us("n_started_at").alias("r_start"), us("n_ended_at").alias("r_end")), 60_000_000)
    return rekey.unionByName(by_id).unionByName(out(met, "time_overlap"))


def read_chat_export(spark: SparkSession, path: str, zone: str) -> DataFrame:
    """(path, n, at, text): prompts of Markdown chat exports, times in a zone."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    turns = files.select("path", F.posexplode(F.split("body", r"(?m)^## (?=Prompt:|Response:)")).alias("n", "t")).where("n > 0 AND t LIKE 'Prompt:%'")
    at = F.to_timestamp(F.regexp_extract("t", r"(\d{1,2}/\d{1,2}/\d{4}, \d{1,2}:\d{2}:\d{2} [AP]M)", 1), "M/d/yyyy, h:mm:ss a")
    body = F.trim(F.regexp_replace(F.regexp_replace("t", r"(?s)^Prompt:\n[^\n]*\n", ""), r"(?s)\n---\n.*$", ""))
    return turns.select("path", "n", F.to_utc_timestamp(at, zone).alias("at"), body.alias("text"))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(path, num, shown, mark, note): sections of Markdown audit sheets."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    part = files.select("path", F.explode(F.split("body", r"(?m)^## (?=\d+\s*$)")).alias("t")).where(F.col("t").rlike(r"^\d+\s*\n"))
    line = lambda k: F.trim(F.regexp_extract("t", rf"(?m)^{k}:[ ]*(.*)$", 1))
    shown = F.trim(F.regexp_extract("t", r"(?s)^\d+\s*\n(.*?)(?=^mark:|^note:|\z)".replace("(?s)", "(?sm)"), 1))
    return part.select("path", F.regexp_extract("t", r"^(\d+)", 1).cast("int").alias("num"), shown.alias("shown"), line("mark").alias("mark"), line("note").alias("note"))
