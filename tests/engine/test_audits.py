"""Audit operators on small frames, edge cases first."""

import re

import pytest
from pyspark.sql import functions as F

from threadloom.operators import audits


def test_pooled_first_readable_mark_counts(spark):
    m = spark.createDataFrame([(2, 1, "x", 1, 2, "same"), (1, 9, "y", 1, 2, None), (1, 10, "y", 1, 2, "other"), (3, 1, "x", 1, 3, "same")], "sheet int, num int, part_of string, a int, b int, label string")
    assert {tuple(r) for r in audits.pooled(m).collect()} == {("y", "other", 1, 1), ("x", "same", 1, 0)}


def test_wording_tops_ties_go_by_pair(spark):
    a = spark.createDataFrame([("b c", "w", 0.5), ("a c", "w", 0.5), ("a c", "v", 0.1)], "pair string, wording string, p double")
    got = {(r.wording, r.place): (r.pair, round(r["mean"], 6)) for r in audits.wording_tops(a, 1).collect()}
    assert got == {("w", 1): ("a c", 0.3), ("v", 1): ("a c", 0.3)}


def test_speakers_cited_without_rows(spark):
    items = spark.createDataFrame([], "item_id string, said_by string, source_segment_ids array<string>")
    lines = spark.createDataFrame([], "segment_id string, speaker_label string")
    assert tuple(audits.speakers_cited(items, lines).first()) == (0, 0, None, 0)


def test_theme_gone_moves_into_payload(spark):
    e = spark.createDataFrame([(1, "pin_theme", "t1", None), (2, "pin_theme", "t9", None), (3, "file_idea", 't"9', '{"a": 1}'), (4, "note", "t9", None), (5, "note", None, "{}")], "event_id int, kind string, theme_id string, payload string")
    themes = spark.createDataFrame([("t1",), ("t1",)], "theme_id string")
    got = {r.event_id: (r.theme_id, r.payload) for r in audits.theme_named(e, themes).collect()}
    assert got == {1: ("t1", None), 2: (None, '{"theme_gone":"t9"}'), 3: (None, '{"a": 1,"theme_gone":"t\\"9"}'), 4: ("t9", None), 5: (None, "{}")}
    with pytest.raises(Exception, match="needs a theme_id"):
        audits.theme_named(spark.createDataFrame([("pin_theme", None, None)], "kind string, theme_id string, payload string"), themes).collect()


def test_corrections(spark):
    form = "idea_id int, title string, statement string, note string"
    got = audits.corrections(spark.createDataFrame([(1, " x ", None, ""), (2, None, "s", None)], form))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "idea_correct", '{"title":"x"}'), (1, "idea_note", '{"note":""}'), (2, "idea_correct", '{"statement":"s"}')]
    for row, why in (((1, None, None, None), "nothing to change"), ((1, "x" * 121, None, None), "at most 120")):
        with pytest.raises(Exception, match=why):
            audits.corrections(spark.createDataFrame([row], form)).collect()


def test_hints_as_a_plain_search(spark):
    texts = ["Ask Ann-Lee now", "askew", "a.b c\\Ed", "", "über straße", "?! ok", "AB a b"]
    heard = ["ask", "ann-lee", "a.b", "\\E", "c\\Ed", "Über", "straße", "?!", "a b", "now"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    p = spark.createDataFrame([(h, "m", "confirmed", 1) for h in heard] + [("askew", "m", "rejected", 1)], "heard string, meant string, status string, seen int")
    want = {(i, h) for i, x in enumerate(texts) for h in heard if re.search(rf"(?<!\w){re.escape(h)}(?!\w)", x, re.I)}
    assert {(r.id, r.heard) for r in audits.hints(t, p).collect()} == want


@pytest.fixture
def no_broadcast(spark):
    """Joins as on tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def hints_of_an_id(spark):
    """Texts of one id, copies and an id that is null; letters that marks follow, and the dotted capital I."""
    texts = [(1, "Ask a b"), (1, "ask A.B a b"), (1, "ask A.B a b"), (2, "?! ask"), (2, "?!"), (None, "a b"), (None, "A B ask"), (3, "cafe\u0301 now"), (4, "\u0130stanbul"), (5, "")]
    heard = ["ASK", "a b", "a.b", "?!", "cafe", "istanbul", "\u0130stanbul"]
    t = spark.createDataFrame(texts, "id int, text string")
    p = spark.createDataFrame([(h, "m", "confirmed", 1) for h in heard], "heard string, meant string, status string, seen int")
    want = {(i, h) for i, x in texts for h in heard if re.search(rf"(?<!\w){re.escape(h)}(?!\w)", x, re.I)}
    got = [(r.id, r.heard) for r in audits.hints(t, p).collect()]
    assert set(got) == want and len(got) == len(want)


def test_hints_once_for_an_id(spark):
    hints_of_an_id(spark)


def test_hints_once_for_an_id_without_broadcasts(spark, no_broadcast):
    hints_of_an_id(spark)


def test_hints_of_single_words_move_no_texts(spark, no_broadcast):
    from threadloom import catalog

    got = catalog.queries()["mishearing_hints"](spark, "/root/testdata/sf0.001")
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan)
    assert moved and not any("text#" in x for x in moved)


def test_mishearing_hints_as_sql_where_ids_repeat(spark, tmp_path):
    """Turn 100 of a conversation and turn 0 of the next have the same id."""
    import duckdb

    from threadloom import catalog

    said = ["Ask ask now", "now ask", "\u0130stanbul calls", "istanbul cafe\u0301", "cafe ask", None, "?!", "fill in", "fill", "fill", "now"]
    rows = [(i % 2 + 1, 0 if i % 2 else 100, "user", x) for i, x in enumerate(said)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.execute(catalog.oracle_sql()["mishearing_hints"]).fetchall()
    got = catalog.queries()["mishearing_hints"](spark, str(tmp_path)).select("id", "heard", "meant", "status", "seen")
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_proposed_themes_only_made_ones_take_a_name(spark):
    form = "answer int, ord int, name string, description string, ideas array<int>, loose array<string>"
    loose = ["a", "b", "c", "d"]
    p = [(1, 1, "Work", "d", [1, 2, 2, 9], loose), (1, 2, " work ", " ", [4, 1, 2, 1], loose), (1, 3, "WORK", "d", [1, 2, 3], loose), (1, 4, "Old", "d", [1, 2, 3], loose), (1, 5, " ", "d", [1, 2, 3], loose)]
    got = audits.proposed_themes(spark.createDataFrame(p, form), spark.createDataFrame([("OLD",)], "name string")).collect()
    assert [tuple(r) for r in got] == [(1, 2, "work", None, ["d", "a", "b"])]


def test_merge_universe(spark):
    near = spark.createDataFrame([("a", "b", 0.9), ("x", "y", 0.5)], "a string, b string, cosine double")
    reviews = spark.createDataFrame([(1, "duplicate", ["b", "m", "b"], None), (2, "judged_same", ["c", "a"], None), (3, "duplicate", ["a", "z"], None), (4, "duplicate", ["b", "c"], 7), (5, "other", ["b", "c"], None)], "review_id int, kind string, ids array<string>, merge_id int")
    merged = spark.createDataFrame([("m", "a")], "idea_id string, into_id string")
    cards = spark.createDataFrame([("a",), ("b",), ("c",)], "idea_id string")
    apart = spark.createDataFrame([("x", "y")], "a string, b string")
    got = audits.merge_universe(near, reviews, merged, cards, apart)
    assert {tuple(map(str, r)) for r in got.collect()} == {("a", "b", "0.9", "['duplicate']"), ("a", "c", "None", "['judged_same']")}
    asked = got.withColumn("same", F.when(F.col("b") == "c", 0.1)).orderBy(*audits.screen_order())
    assert [r.b for r in asked.collect()] == ["c", "b"]


def test_curated_refuses_another_sheet(spark):
    export = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2026-01-02 03:04:05', 'a  b'), (2, TIMESTAMP '2026-01-02 03:05:05', 'c') AS t(n, at, text)")
    form = "n int, sent string, quote string, mark string, text string"
    good = [(1, "2026-01-02 03:04", "a b", "edit", "A"), (2, "2026-01-02 03:05", " c", "drop", None)]
    assert [(r.n, r.text, r.edited) for r in audits.curated(export, spark.createDataFrame(good, form)).collect()] == [(1, "A", True)]
    bad = [(1, "2026-01-02 03:05", "a b", "keep", None), (3, "x", "c", "keep", None)]
    found = audits.sheet_differences(export, spark.createDataFrame(bad, form)).collect()
    assert {tuple(r) for r in found} == {(1, "minute"), (2, "not on the sheet"), (3, "not in the export")}
    with pytest.raises(Exception, match="message 1: minute"):
        audits.curated(export, spark.createDataFrame(bad, form)).collect()


def test_replay_and_cells_without_rows(spark):
    assert audits.visible_by_day(spark.createDataFrame([(None,)], "first_said timestamp")).collect() == []
    two = spark.createDataFrame([("c", 1, 1, None, None), ("c", 2, None, None, None)], "cell string, id int, first_said int, x double, y double")
    assert audits.grid_cells(two, two.select("id", "x", "y")).collect() == []
    three = two.unionByName(spark.createDataFrame([("c", 3, 0, 5.0, 5.0)], two.schema))
    got = {r.id: (r.place, r.px, r.py) for r in audits.grid_cells(three, three.select("id", "x", "y")).collect()}
    assert [got[i][0] for i in (3, 1, 2)] == [0, 1, 2] and all(14 <= v <= 86 for p in got.values() for v in p[1:])
