from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from threadloom.operators import views

T0 = datetime(2026, 9, 1, 9)
at = lambda m: T0 + timedelta(minutes=m)


@pytest.fixture(scope="module")
def t(spark):
    f = spark.createDataFrame
    return {
        "segments": f([("s1", "c1", at(0), "me", "owner", "voice", 0.5), ("s2", "c1", at(1), "Al", "person", None, None), ("s3", "c2", at(9), "me", "owner", "diar", 0.7)], "segment_id string, conversation_id string, started_at timestamp, speaker_label string, speaker_kind string, speaker_basis string, arousal double"),
        "members": f([("s1",), ("s2",), ("s3",)], "segment_id string"),
        "tombstones": f([("s2",)], "segment_id string"),
        "episodes": f([("e1", True), ("e2", False)], "episode_id string, current boolean"),
        "items": f([("i1", "e1", "old", "s1", ["s1"], "o1", "q1", at(10)), ("i2", "e2", "x", None, ["s2"], "o1", "q2", at(20)), ("i3", "e1", "x", None, ["s3"], "o2", "q3", at(30)), ("i4", "e1", "x", None, ["s2"], None, "q4", at(40))], "item_id string, episode_id string, said_by string, said_by_segment_id string, source_segment_ids array<string>, observation_id string, quote string, created_at timestamp"),
        "observations": f([("o1", "speech", None, None, None, None, ["s1", "s3"]), ("o2", "speech", None, None, None, None, ["s3"]), ("o3", "typed", "d2", "me", at(50), "c9", [])], "observation_id string, source string, idea_id string, said_by string, said_at timestamp, conversation string, segment_ids array<string>"),
        "ideas": f([("d1", "t1", "st1", "captured"), ("d2", "t2", "st2", "mine"), ("d3", "t3", "st3", "captured"), ("d4", "t4", "st4", "captured")], "idea_id string, title string, statement string, origin string"),
        "evidence": f([("d1", "i1", "origin"), ("d1", "i2", "same_as"), ("d1", "i3", "same_as"), ("d4", "i4", "origin")], "idea_id string, item_id string, relation string"),
        "events": f([(1, at(1), "correct", "d1", None, '{"title":"new"}'), (2, at(2), "correct", "d1", None, '{"title":"","statement":"s"}'), (3, at(3), "link", "d1", "d2", "{}"), (4, at(4), "unlink", "d2", "d4", "{}"), (5, at(5), "keep", "d4", None, '{"as":"pinned"}'), (6, at(6), "unkeep", "d4", None, "{}"), (7, at(7), "star", "d1", None, "{}"), (8, at(8), "sensitive", "d4", None, "{}"), (9, at(9), "not_sensitive", "d1", None, "{}"), (10, at(90), "dismiss", "d1", None, "{}"), (11, at(11), "link", "d3", "d4", "{}")], "event_id long, at timestamp, kind string, idea_id string, other_idea_id string, payload string"),
        "connections": f([("d1", "d4", "m"), ("d2", "d4", "m")], "a string, b string, method string"),
        "connection_kinds": f([("d1", "d4", "supports")], "a string, b string, kind string"),
        "lineage": f([("d1", "d2", "evolves")], "from_id string, to_id string, kind string"),
        "edge_methods": f([("m", 2)], "method string, seen_event_id long"),
        "merges": f([("d3", "d1")], "other_id string, keep_id string"),
        "verdicts": f([(1, "i1", "keep", at(1)), (2, "i2", "discard", at(2)), (3, "i4", "star", at(3))], "verdict_id long, item_id string, verdict string, decided_at timestamp"),
        "proposals": f([("d1", at(60), None), ("d4", at(60), None), ("d2", at(60), "kept")], "idea_id string, made_at timestamp, outcome string"),
        "themes": f([("h1", "n"), ("h2", "m")], "theme_id string, name string"),
        "idea_themes": f([("d1", "h1"), ("d4", "h1")], "idea_id string, theme_id string"),
        "sensitivity": f([("d1", ["health"]), ("d2", []), ("d4", [])], "idea_id string, categories array<string>"),
    }


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_speech(t):
    assert {r.segment_id for r in views.current_segments(t).collect()} == {"s1", "s3"}
    assert by(views.item_said_by(t), "item_id", "said_by") == {"i1": "me", "i2": "x", "i3": "x", "i4": "x"}
    assert by(views.item_speaker(t), "item_id", "speaker") == {"i1": "me", "i2": "not_me", "i3": "me_diar", "i4": "not_me"}
    assert by(views.observation_speaker(t), "observation_id", "speaker") == {"o1": "me", "o2": "me_diar"}
    assert by(views.card_moments(t), "item_id", "at") == {"i1": at(0), "i2": at(1), "i3": at(9), "i4": at(1)}
    assert by(views.observation_arousal(t), "observation_id", "arousal") == {"o1": 0.6, "o2": 0.7}


def test_ideas(t):
    text = {r.idea_id: (r.title, r.statement) for r in views.idea_text(t).collect()}
    assert text == {"d1": ("t1", "s"), "d2": ("t2", "st2"), "d4": ("t4", "st4")}
    assert by(views.idea_kept(t), "idea_id", "kept_as") == {"d1": "pinned", "d2": "canonical", "d3": None, "d4": None}
    assert by(views.idea_maturity(t), "idea_id", "maturity") == {"d1": "idea", "d2": "idea", "d3": "observation", "d4": "observation"}
    assert by(views.capture_verdict(t), "item_id", "verdict") == {"i1": "discard", "i2": "discard", "i3": None, "i4": "star"}
    assert {(r.idea_id, r.item_id) for r in views.evidence(t).collect()} == {("d1", "i1"), ("d1", "i3"), ("d4", "i4")}
    assert by(views.ideas(t), "idea_id", "n_evidence") == {"d1": 1, "d2": 0, "d4": 1}
    assert by(views.themes(t), "theme_id", "n_ideas") == {"h1": 2, "h2": 0}


def test_edges_and_cards(t):
    assert {(r.a, r.b, r.method) for r in views.shown_connections(t).collect()} == {("d1", "d2", "mine"), ("d1", "d4", "mine")}
    assert {(r.a, r.b, tuple(r.kinds)) for r in views.card_links(t).collect()} == {("d1", "d2", ()), ("d1", "d4", ("supports",)), ("d1", "d2", ("evolves",))}
    cards = {r.idea_id: r for r in views.cards(t).collect()}
    one = cards["d1"]
    assert (one.n_observations, one.n_me, one.n_me_diar, one.n_conversations, one.n_links, one.proposed) == (2, 1, 1, 2, 3, True)
    assert (cards["d2"].n_observations, cards["d4"].n_observations, cards["d4"].maturity) == (1, 0, "observation")
    assert {r.idea_id for r in views.proposals(t).collect()} == {"d4"}
    assert by(views.sensitive(t), "idea_id", "sensitive") == {"d1": False, "d2": False, "d3": False, "d4": True}
    demo = {r.idea_id: r for r in views.demo_cards(t).collect()}
    assert demo["d4"].title is None and demo["d1"].title == "t1" and demo["d4"].n_links == 1
    assert views.demo_evidence(t).where(F.col("idea_id") == "d4").isEmpty()
