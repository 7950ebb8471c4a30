"""Audit sheets, screens and guards: functions of frames, one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import squeezed
from threadloom.operators import vectors
from threadloom.primitives import checkpointed, explode_bridge, ranked

# Numbers and names of the rules below (fixed values).
THEME_KINDS = ("pin_theme", "unpin_theme", "rename_theme", "reject_theme", "merge_theme", "split_theme", "file_idea", "unfile_idea")
MIN_GROUP = 3
WORDING_TOP = 10
LINES_NEAR = 50
GRID_CARDS = 3
LIMITS = {"title": 120, "statement": 1000, "note": 1000}
WORD = r"[\p{L}\p{N}_]+"


def pooled(marks: DataFrame) -> DataFrame:
    """(part_of, label, marked, repeated) of marks (sheet, num, part_of, a, b, label).
    A pair counts once, by its first sheet's mark; marks without a label (null)
    don't count, nor stand in a later mark's way."""
    first = F.min(F.struct("sheet", "num", "part_of", "label")).alias("x")
    pairs = marks.where("label IS NOT NULL").groupBy("a", "b").agg(first, F.count("*").alias("m"))
    return pairs.groupBy("x.part_of", "x.label").agg(F.count("*").alias("marked"), F.sum(F.col("m") - 1).alias("repeated"))


def wording_tops(answers: DataFrame, most: int = WORDING_TOP) -> DataFrame:
    """(wording, place, pair, p, mean) of each wording's first pairs among
    answers (pair, wording, p), and the mean of all wordings of the pair, by which
    proposals are ranked. Ties go by pair."""
    means = answers.groupBy("pair").agg(F.avg("p").alias("mean"))
    best = answers.withColumn("place", ranked(["wording"], F.desc("p"), "pair")).where(F.col("place") <= most)
    return best.join(means, "pair").select("wording", "place", "pair", "p", "mean")


def speakers_cited(items: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: items with cited lines, those citing several speakers, their
    share in percent, and those whose speaker isn't among the cited ones."""
    lines = explode_bridge(items.select("item_id", "said_by", "source_segment_ids"), "source_segment_ids", "segment_id")
    each = lines.join(segments.select("segment_id", "speaker_label"), "segment_id").groupBy("item_id")
    # of each item only whether its labels differ: no list of them
    each = each.agg((F.min("speaker_label") != F.max("speaker_label")).alias("several"), F.bool_or(F.col("speaker_label") == F.col("said_by")).alias("cited"))
    several, n = F.count_if("several"), F.count("*")
    return each.agg(n.alias("items"), several.alias("multi_speaker"), F.round(F.when(n > 0, 100 * several / n), 1).alias("pct_multi"), F.count_if(~F.col("cited")).alias("said_by_not_among_cited"))


def stale(rows: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """(id, text, input_hash) of rows (id, text) whose text has no embedding of
    ``model`` among stored (id, model_version, input_hash)."""
    have = stored.where(F.col("model_version") == model).select("id", "input_hash")
    return rows.select("id", "text", F.sha2("text", 256).alias("input_hash")).join(have, ["id", "input_hash"], "left_anti")


def closest_lines(lines: DataFrame, allowed: Column, near: int = LINES_NEAR) -> DataFrame:
    """(a, b, score, la, lb) of allowed pairs of owners a < b of lines (id, owner,
    v): their closest pair of lines, ties to the smaller ones. A line's ``near``
    nearest are looked at, itself among them."""
    found = vectors.nearest(lines, near - 1, "id", "v").select("id", "other", "sim")
    whose = lines.select("id", "owner")
    found = found.join(whose, "id").join(whose.select(F.col("id").alias("other"), F.col("owner").alias("o")), "other")
    back = F.col("owner") > F.col("o")
    ends = {"a": F.least("owner", "o"), "b": F.greatest("owner", "o"), "la": F.when(back, F.col("other")).otherwise(F.col("id")), "lb": F.when(back, F.col("id")).otherwise(F.col("other"))}
    pairs = found.where("owner <> o").select("sim", *[c.alias(n) for n, c in ends.items()]).where(allowed)
    best = pairs.groupBy("a", "b").agg(F.min(F.struct((-F.col("sim")).alias("far"), "la", "lb")).alias("x"))
    return best.select("a", "b", (-F.col("x.far")).alias("score"), "x.la", "x.lb")


def merge_universe(near: DataFrame, reviews: DataFrame, merged: DataFrame, cards: DataFrame, apart: DataFrame) -> DataFrame:
    """(a, b, cosine, review) of pairs that may be one point: near ones (a, b,
    cosine) and those of open reviews (review_id, kind, ids, merge_id) of two
    kinds, an idea merged away (idea_id, into_id) standing for what it's part of,
    cards only; without apart ones (a, b). ``review`` has the kinds, sorted."""
    open_ = reviews.where("merge_id IS NULL AND kind IN ('duplicate', 'judged_same')")
    ids = explode_bridge(open_.select("review_id", "kind", "ids"), "ids", "idea_id").join(merged, "idea_id", "left")
    ids = ids.withColumn("idea_id", F.coalesce("into_id", "idea_id")).join(cards.select("idea_id"), "idea_id", "left_semi")
    rows = ids.groupBy("review_id", "kind").agg(F.array_sort(F.collect_set("idea_id")).alias("u"))  # of one row's own few ideas
    two = F.flatten(F.transform("u", lambda x, i: F.transform(F.slice("u", i + 2, F.size("u")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    kinds = rows.select("kind", F.inline(two)).groupBy("a", "b").agg(F.array_sort(F.collect_set("kind")).alias("review"))
    both = near.join(kinds, ["a", "b"], "full").join(apart, ["a", "b"], "left_anti")
    return both.select("a", "b", "cosine", F.coalesce("review", F.array().cast("array<string>")).alias("review"))


def screen_order(same: str = "same") -> list[Column]:
    """Answered first, likelier ones first, then reviewed, then nearer, then ids."""
    return [F.col(same).isNull(), F.coalesce(F.col(same), F.lit(0.0)).desc(), F.size("review") == 0, F.coalesce("cosine", F.lit(0.0)).desc(), F.col("a"), F.col("b")]


def theme_named(events: DataFrame, themes: DataFrame) -> DataFrame:
    """Events with a theme that is gone moved from ``theme_id`` into the payload (a
    JSON object or null). An event about themes that names none is an error."""
    about = F.col("kind").isin(*THEME_KINDS)
    named = events.withColumn("theme_id", F.when(about & F.col("theme_id").isNull(), F.raise_error(F.concat("kind", F.lit(" needs a theme_id")))).otherwise(F.col("theme_id")))
    known = themes.select("theme_id", F.lit(True).alias("__known")).dropDuplicates(["theme_id"])
    joined = named.join(known, "theme_id", "left")
    gone = about & F.col("__known").isNull()
    old = F.trim(F.coalesce("payload", F.lit("{}")))
    inner = F.trim(F.regexp_replace(old, r"^\{|\}$", ""))
    mark = F.regexp_replace(F.to_json(F.struct(F.col("theme_id").alias("theme_gone"))), r"^\{", "")
    moved = F.concat(F.lit("{"), inner, F.when(inner == "", "").otherwise(","), mark)
    return joined.withColumns({"payload": F.when(gone, moved).otherwise(F.col("payload")), "theme_id": F.when(~gone, F.col("theme_id"))}).drop("__known")


def anchored(events: DataFrame, items: DataFrame) -> DataFrame:
    """Events with the lines their item cites now; null without such an item."""
    return events.join(items.select("item_id", F.col("source_segment_ids").alias("item_segment_ids")), "item_id", "left")


def proposed_themes(proposals: DataFrame, taken: DataFrame) -> DataFrame:
    """(answer, ord, name, description, members) of the themes to make of proposals
    (answer, ord, name, description, ideas, loose): ``ideas`` are places from 1 in
    ``loose``; places outside and repeated ones don't count, MIN_GROUP are needed. A
    name that is empty, or in any case taken (name), or given earlier in the answer to a
    theme that is made, isn't made."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    places = F.array_distinct(F.filter("ideas", lambda n: (n >= 1) & (n <= F.size("loose"))))
    rows = proposals.withColumns({"name": bare(F.col("name")), "description": F.nullif(bare(F.col("description")), F.lit("")), "members": F.transform(places, lambda n: F.element_at("loose", n.cast("int")))})
    rows = rows.withColumn("lower", F.lower("name")).where((F.size("members") >= MIN_GROUP) & (F.col("name") != ""))
    rows = rows.join(taken.select(F.lower("name").alias("lower")).distinct(), "lower", "left_anti")
    first = rows.groupBy("answer", "lower").agg(F.min(F.struct("ord", "name", "description", "members")).alias("x"))
    return first.select("answer", "x.*")


def grid_cells(members: DataFrame, sky: DataFrame) -> DataFrame:
    """(cell, id, place, px, py, hue) of members (cell, id, first_said, x, y) of cells
    of GRID_CARDS cards or more: each where the sky puts it, scaled to 14..86 and centred
    on the shorter side; one without a place stands on a ring around the middle of the sky
    (id, x, y). y points down. Places are from 0, by first_said (null last), then id."""
    middle = sky.where("x IS NOT NULL").agg(F.coalesce(F.avg("x"), F.lit(0.0)).alias("mx"), F.coalesce(-F.avg("y"), F.lit(0.0)).alias("my"))
    large = members.groupBy("cell").agg(F.count("*").alias("m")).where(F.col("m") >= GRID_CARDS).select("cell")
    rows = members.join(large, "cell").withColumn("place", ranked(["cell"], F.col("first_said").asc_nulls_last(), "id") - 1)
    rows = rows.crossJoin(F.broadcast(middle))  # one row
    rows = rows.withColumns({"sx": F.coalesce("x", F.col("mx") + F.cos("place")), "sy": F.coalesce(-F.col("y"), F.col("my") + F.sin("place"))})
    box = rows.groupBy("cell").agg(F.min("sx").alias("x0"), F.min("sy").alias("y0"), (F.max("sx") - F.min("sx")).alias("w"), (F.max("sy") - F.min("sy")).alias("h"))
    rows = rows.join(box, "cell").withColumn("wide", F.greatest("w", "h", F.lit(1e-6)))
    put = lambda s, s0, side: F.round(14 + 72 * (F.col(s) - F.col(s0) + (F.col("wide") - F.col(side)) / 2) / F.col("wide"), 1)
    hue = F.round(F.pmod(F.degrees(F.atan2(F.col("sy") - F.col("my"), F.col("sx") - F.col("mx"))), F.lit(360.0))).cast("int")
    return rows.select("cell", "id", "place", put("sx", "x0", "w").alias("px"), put("sy", "y0", "h").alias("py"), hue.alias("hue"))


def corrections(edits: DataFrame) -> DataFrame:
    """(idea_id, kind, payload) events of edits (idea_id, title, statement, note), with
    the fields given (not null) alone; an empty one goes back to the original. An edit
    without a field, or with one that is too long, is an error."""
    rows = edits.select("idea_id", *[F.regexp_replace(c, r"^\s+|\s+$", "").alias(c) for c in LIMITS])
    wrong = F.when(F.coalesce(*LIMITS).isNull(), "nothing to change: give a title, statement or note")
    for c, most in LIMITS.items():
        wrong = wrong.when(F.length(c) > most, F.concat(F.lit(f"the {c} is "), F.length(c).cast("string"), F.lit(f" characters; at most {most}")))
    wrong = wrong.otherwise(None)
    card = F.when(F.coalesce("title", "statement").isNotNull(), F.struct(F.lit("idea_correct").alias("kind"), F.to_json(F.struct("title", "statement")).alias("payload")))
    note = F.when(F.col("note").isNotNull(), F.struct(F.lit("idea_note").alias("kind"), F.to_json(F.struct("note")).alias("payload")))
    events = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("array<struct<kind:string,payload:string>>")).otherwise(F.array_compact(F.array(card, note)))
    return rows.select("idea_id", F.inline(events))


def folded(text: Column | str) -> Column:
    """Text in lower case, letter by letter: the dotted capital I is one letter."""
    return F.lower(F.replace(F.col(text) if isinstance(text, str) else text, F.lit("İ"), F.lit("i")))


def hints(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, heard, meant, status, seen) of pairs (heard, meant, status, seen) that
    aren't rejected and whose heard words are in a text (id, text), as whole words in any
    case: each pair once for an id, whichever of its texts it is in. Where one word is
    heard, ids and words meet, without the texts. Other pairs meet a text's hash by their
    first word, then the whole is looked for in the text; pairs without a word character
    are looked for in all texts."""
    columns, first = ["heard", "meant", "status", "seen"], F.regexp_extract(folded("heard"), WORD, 0)
    asked = pairs.where("status <> 'rejected'").select(*columns, first.alias("word"), ((first != "") & (first == folded("heard"))).alias("single")).distinct()
    asked = checkpointed(asked.withColumn("pair", F.monotonically_increasing_id()))  # numbers stay; its size is known to the joins
    said = F.explode(F.array_distinct(F.regexp_extract_all(folded("text"), F.lit(WORD), F.lit(0)))).alias("word")
    met = texts.select("id", said).join(asked.where("single").select("word", "pair"), "word").select("id", "pair")
    longer = asked.where("NOT single").select("word", "pair", "heard")
    if not longer.isEmpty():
        edge = WORD.removesuffix("+")
        quoted = F.concat(F.lit(rf"(?iu)(?<!{edge})\Q"), F.replace("heard", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(rf"\E(?!{edge})"))
        keyed = texts.select("id", "text", F.xxhash64("text").alias("key"))
        near = keyed.select(F.col("id").alias("of"), "key", said).join(longer.where("word <> ''"), "word").select("of", "key", "pair", "heard").distinct()
        near = keyed.join(near, (keyed["key"] == near["key"]) & keyed["id"].eqNullSafe(near["of"])).where(F.regexp_like("text", quoted))
        bare = texts.select("id", "text").join(longer.where("word = ''"), F.regexp_like("text", quoted))
        met = met.unionByName(near.select("id", "pair")).unionByName(bare.select("id", "pair"))
    # by id too, since a frequent word is in most texts; the number is given, since these narrow
    # rows would be merged into a few tasks, and the rows that each writes are far wider
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts, "id", "pair").distinct().join(asked, "pair").select("id", *columns)


def visible_by_day(cards: DataFrame) -> DataFrame:
    """(day, visible): how many cards are visible at the end of each day on which one
    was first said; cards without first_said never are. Days are counted first."""
    days = cards.where("first_said IS NOT NULL").groupBy(F.to_date("first_said").alias("day")).agg(F.count("*").alias("n"))
    return days.select("day", F.sum("n").over(Window.orderBy("day")).alias("visible"))


def sheet_differences(export: DataFrame, sheet: DataFrame) -> DataFrame:
    """K9: (n, why) of numbers by which a sheet (n, sent, quote) isn't the export (n, at,
    text): one side lacks it, or the minute or the text, but for white space, differs."""
    both = export.select("n", "at", "text", F.lit(True).alias("e")).join(sheet.select("n", "sent", "quote", F.lit(True).alias("s")), "n", "full")
    why = F.when(F.col("e").isNull(), "not in the export").when(F.col("s").isNull(), "not on the sheet")
    why = why.when(~F.date_format("at", "yyyy-MM-dd HH:mm").eqNullSafe(F.col("sent")), "minute").when(~squeezed(F.col("text")).eqNullSafe(squeezed(F.col("quote"))), "text")
    return both.withColumn("why", why).where("why IS NOT NULL").select("n", "why")


def curated(export: DataFrame, sheet: DataFrame) -> DataFrame:
    """K9: (n, at, text, edited) of the messages that a sheet (n, sent, quote, mark, text)
    doesn't drop, with the text edited in; an error if it isn't the export's sheet."""
    wrong = sheet_differences(export, sheet).agg(F.min(F.struct("n", "why")).alias("x"))
    wrong = wrong.select(F.when(F.col("x").isNotNull(), F.raise_error(F.concat(F.lit("message "), F.col("x.n").cast("string"), F.lit(": "), F.col("x.why"))).cast("boolean")).otherwise(F.lit(True)).alias("same"))
    kept = export.join(sheet.select("n", "mark", F.col("text").alias("edit")), "n").where("mark <> 'drop'")
    edited = F.col("mark") == "edit"
    return kept.crossJoin(F.broadcast(wrong)).where("same").select("n", "at", F.when(edited, F.col("edit")).otherwise(F.col("text")).alias("text"), edited.alias("edited"))  # one row
