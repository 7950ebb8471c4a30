import pytest
from pyspark.sql import functions as F

from threadloom.operators import lifecycle as L


def test_purge_reaches_everything(spark):
    f = spark.createDataFrame
    t = {
        "ideas": f([("d1", ["s1"]), ("d2", []), ("d3", ["s9"])], "idea_id string, segment_ids array<string>"),
        "merges": f([("d2", "d1")], "other_id string, keep_id string"),
        "items": f([("i1", ["s1", "s2"]), ("i2", ["s2"])], "item_id string, source_segment_ids array<string>"),
        "observations": f([("o1", ["s1"]), ("o2", [])], "observation_id string, segment_ids array<string>"),
        "verdicts": f([("i1", "keep"), ("i2", "star")], "item_id string, verdict string"),
        "evidence": f([("d1", "i2"), ("d3", "i1"), ("d3", "i2")], "idea_id string, item_id string"),
        "episodes": f([("e1", ["s0", "s1"]), ("e2", ["s2"])], "episode_id string, segment_ids array<string>"),
        "egress_log": f([("g1", ["s1"], "words"), ("g2", ["s2"], "kept")], "egress_id string, segment_ids array<string>, payload string"),
        "attention": f([("a1", "s1", ["s1"]), ("a2", "s2", ["s3", "s1", "s2"]), ("a3", "s2", ["s1"])], "attention_id string, cue_segment_id string, segment_ids array<string>"),
    }
    out = L.purged(t, f([("s1",)], "segment_id string"))
    ids = lambda n, k: {r[k] for r in out[n].collect()}
    assert ids("ideas", "idea_id") == {"d3"} and ids("items", "item_id") == {"i2"} and ids("observations", "observation_id") == {"o2"}
    assert ids("verdicts", "item_id") == {"i2"} and ids("episodes", "episode_id") == {"e2"}
    assert {(r.idea_id, r.item_id) for r in out["evidence"].collect()} == {("d3", "i2")}
    assert {r.egress_id: r.payload for r in out["egress_log"].collect()} == {"g1": None, "g2": "kept"}
    assert {r.attention_id: r.segment_ids for r in out["attention"].collect()} == {"a2": ["s3", "s2"], "a3": []}


def test_work_and_reconciliation(spark):
    f = spark.createDataFrame
    episodes = f([("e1", "A", True, "v1"), ("e2", "B", True, "v0"), ("e3", "C", True, "v1"), ("e4", "D", False, "v0")], "episode_id string, session_id string, current boolean, stage_version string")
    parts = f([("e1", "s1"), ("e2", "s2"), ("e3", "gone")], "episode_id string, segment_id string")
    current = f([("s1", "A"), ("s2", "B"), ("s5", "E")], "segment_id string, session_id string")
    assert {r.session_id for r in L.sessions_needing_work(episodes, parts, current, "v1").collect()} == {"B", "C", "E"}
    desired = f([("e1",), ("e4",), ("e9",)], "episode_id string")
    assert {r.episode_id: r.action for r in L.reconciled(episodes, desired).collect()} == {"e1": "keep", "e2": "retire", "e3": "retire", "e4": "revive", "e9": "insert"}


def test_decisions(spark):
    df = spark.createDataFrame([({"a": 0.4, "b": 0.8},)], "p map<string,double>")
    r = df.select(*[L.combined(q, F.col("p")).alias(q) for q in ("tension", "analogy", "other")]).head()
    assert (round(r.tension, 6), r.analogy, r.other) == (0.6, 0.4, 0.8)
    one = lambda *x: spark.range(1).select(L.edge_label(F.lit(x[0]), F.lit(x[1]), {"a": F.lit(x[2]), "b": F.lit(x[3])}).alias("l"), L.answered(F.lit(x[0])).alias("y")).head()
    assert [one(*x).l for x in ((0.7, 1.0, 1.0, 1.0), (0.9, 0.5, 0.0, 0.0), (0.9, 0.1, 0.6, 0.6), (0.9, 0.1, 0.2, 0.3))] == ["none", "same", "b", "related"]
    assert [one(x, 0.0, 0.0, 0.0).y for x in (0.7, 0.3, 0.5)] == ["yes", "no", "unsure"]


def test_carry_file_and_quota(spark):
    f = spark.createDataFrame
    items = f([("i1", "o1", 1), ("i2", "o1", 2), ("i3", "o1", 3), ("i4", "o2", 4)], "item_id string, observation_id string, created_at long")
    assert {tuple(r) for r in L.carried_by_observation(items, f([("i2", "d2"), ("i3", "d3")], "item_id string, idea_id string")).collect()} == {("i1", "d2")}
    got = L.filed(f([("d1", ["B", "A", "B", "C", "Z"])], "idea_id string, letters array<string>"), f([("A", "t1"), ("B", "t2"), ("C", "t3")], "letter string, theme_id string"), f([("d1", "t1")], "idea_id string, theme_id string"))
    assert {(r.theme_id, r.nth) for r in got.collect()} == {("t2", 1), ("t3", 2)}
    pairs = f([(1, 2, 1), (1, 3, 2), (1, 4, 3), (5, 6, 4), (2, 3, 5)], "a long, b long, place long")
    assert [(r.a, r.b) for r in L.quota_limited(pairs, 4).orderBy("place").collect()] == [(1, 2), (1, 3), (5, 6), (2, 3)]
    events = f([(5, 10, "idea_add", "d1"), (6, 11, "idea_add", "d1"), (7, 12, "idea_add", "d2")], "event_id long, at long, kind string, idea_id string")
    assert [tuple(r)[:2] for r in L.typed_observations(events, f([("d2", "typed")], "idea_id string, source string"), f([("d1", "mine"), ("d2", "mine")], "idea_id string, origin string"), f([("d9",)], "other_id string")).collect()] == [("d1", 10)]


def test_theme_log(spark):
    themes = spark.createDataFrame([("t1", "One", "clustered", "active"), ("t2", "Two", "clustered", "proposed"), ("t3", "Three", "clustered", "active")], "theme_id string, name string, origin string, status string")
    steps = [
        ("pin", "t1", None, None, None, None, "applied"), ("pin", "t1", None, None, None, None, "repeat"), ("reject", "t1", None, None, None, None, "kept"), ("rename", "t1", None, None, " two ", None, "name taken"),
        ("rename", "t1", None, None, "", None, "no name"), ("file", "t2", "d1", None, None, None, "applied"), ("file", "t2", "d2", None, None, None, "applied"), ("unfile", "t1", "d2", None, None, None, "repeat"),
        ("split", "t2", None, None, "Four", ["d1"], "moved 1"), ("merge", "t2", None, "t1", None, None, "applied"), ("file", "t2", "d1", None, None, None, "unknown theme"), ("file", "t1", "d2", None, None, None, "applied"), ("reject", "t3", None, None, None, None, "applied"),
    ]
    events = spark.createDataFrame([(i, *s[:6]) for i, s in enumerate(steps)], "event_id long, kind string, theme_id string, idea_id string, other string, name string, ideas array<string>")
    got = [r.result for r in L.theme_results(events, themes).orderBy("event_id").collect()]
    assert got == [s[6] for s in steps]


def test_threads_and_tree(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (11, 12), (12, 13), (11, 13), (3, 11), (3, 12)], "a long, b long")
    moments = spark.createDataFrame([(i, f"c{i % 2}" if i < 10 else "c9", i) for i in (1, 2, 3, 11, 12, 13)], "card long, conversation string, at long")
    got = L.threads(edges, moments).collect()
    assert all(r.cards >= 3 and r.conversations >= 2 for r in got)
    tree = {(r.card, r.lens, r.main) for r in L.tree(edges).collect()}
    assert sum(m for _, _, m in tree) == 6 and all(isinstance(c, int) for c, _, _ in tree)


@pytest.mark.parametrize("width", [1, 5])
def test_order_of_rows_does_not_matter(spark, width):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "a long, b long").repartition(width)
    assert {r.card for r in L.tree(edges).collect()} == {1, 2, 3, 4}
