import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom import primitives
from threadloom.functions import text
from threadloom.operators import graph, matching, sessions, stats, vectors
from threadloom.sources import stream


def test_gap_is_strict_and_mode_cuts(spark):
    rows = [(1, "s", 0, 10, True), (2, "s", 70, 75, True), (3, "s", 136, 140, False)]
    df = spark.createDataFrame(rows, "id long, k string, st long, en long, me boolean")
    assert [r.blk for r in sessions.gap_blocks(df, "k", 60).orderBy("id").collect()] == [1, 1, 2]
    for pause, parts in ((6, 2), (2, 1)):
        one = [(1, "s", 0, 40, True), (2, "s", 40 + pause, 50 + pause, False)]
        blocks = sessions.gap_blocks(spark.createDataFrame(one, "id long, k string, st long, en long, me boolean"), "k", 60)
        assert sessions.mode_cuts(blocks, "k", 30, 5).select("part").distinct().count() == parts


def test_recurrences(spark):
    minutes = [("c1", 0), ("c1", 10), ("c1", 40), ("c2", 0)]
    df = spark.createDataFrame(minutes, "c string, t long")
    for apart, want in ((30, 3), (5, 4), (60, 2)):
        assert sessions.recurrences(df, ["c"], "t", apart).agg(F.sum("recurrences")).head()[0] == want


def test_quote_score_and_place():
    assert text.score("the quick brown fox jumps", "well, the quick brown fox jumps over") == 1.0
    assert text.score("uh, I like it so well, yeah", "I like it so well yeah hmm") == 1.0  # like, so, well and yeah are words
    assert text.score("eh no way", "no way") == 0.5  # two words count as four
    assert text.score("", "a b") == 0 and text.score("one two three four", "five six seven eight") == 0
    assert text.score("déjà vu encore là", "deja vu encore la") < 1
    window = [("a", "we should keep it simple"), ("b", "and then ship the thing")]
    assert text.place("keep it simple … ship the thing", window, ["a"]) == ("keep it simple … ship the thing", ["a", "b"], 1.0)
    assert text.place("", window, ["a", "z"]) == ("", ["a", "z"], 1.0)
    assert text.place(" [3] me: ship the thing", window, []) == ("ship the thing", ["b"], 1.0)
    assert text.place("simple and", window, []) == ("simple and", ["a", "b"], 1.0)  # a run across lines is on both
    assert text.place("the other", window, ["a"]) == ("the other", ["a"], 0.5)  # one shared word puts it nowhere
    assert text.place("um we / thing", window, []) == ("um we / thing", ["b"], 0.667)  # fillers count; one word that is all of a part


def test_greedy_is_the_sequential_rule(spark):
    rnd = random.Random(1)
    pairs = {(rnd.randint(0, 40), rnd.randint(0, 40)): rnd.choice([0.3, 0.4, 0.5, 0.9]) for _ in range(120)}
    rows = [(a, b, s) for (a, b), s in pairs.items()]
    got = matching.greedy_match(spark.createDataFrame(rows, "l long, r long, score double"), 0.4).collect()
    assert sorted(map(tuple, got)) == sorted(matching.greedy(r for r in rows if r[2] >= 0.4))


def test_neighbourhoods_two_triangles_and_a_bridge(spark):
    edges = [(1, 2), (2, 3), (1, 3), (11, 12), (12, 13), (11, 13), (3, 11), (5, 5), (20, 21)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in graph.neighbourhoods(df.where("a <> b")).collect()}
    assert len({got[i] for i in (1, 2, 3)}) == 1 and len({got[i] for i in (11, 12, 13)}) == 1 and got[1] != got[11]
    assert got == swept([e for e in edges if e[0] != e[1]])


def swept(edges, rounds=30):
    """The rule itself: sweeps in id order, a neighbour pulling with 1 and the
    number of common neighbours, moves only to what pulls more."""
    near = {}
    for x, y in edges:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    label = {x: x for x in near}
    for _ in range(rounds):
        was = dict(label)
        for x in sorted(near):
            pulls = {}
            for y in near[x]:
                pulls[label[y]] = pulls.get(label[y], 0) + 1 + len(near[x] & near[y])
            if max(pulls.values()) > pulls.get(label[x], 0):
                label[x] = min(n for n in pulls if pulls[n] == max(pulls.values()))
        if was == label:
            break
    return label


def test_neighbourhoods_of_a_random_graph(spark):
    rnd = random.Random(4)
    edges = sorted({(min(e), max(e)) for e in ((rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(150)) if e[0] != e[1]})
    got = {r.node: r.label for r in graph.neighbourhoods(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == swept(edges)


def test_pagerank_against_power_steps(spark):
    rnd = np.random.default_rng(1)
    edges = sorted({(int(a), int(b)) for a, b in rnd.integers(0, 20, (50, 2)) if a < b})
    m = np.zeros((20, 20))
    for a, b in edges:
        m[a, b] = m[b, a] = 1
    p = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
    seed = edges[0][0]
    start = np.eye(20)[seed]
    r = start.copy()
    for _ in range(60):
        r = 0.15 * start + 0.85 * r @ p
    others = np.delete(r, seed).max()
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a long, b long, w double")
    got = {x.node: x["rank"] for x in graph.personalised_pagerank(df, seed).collect()}
    assert got[seed] == 1.0
    for n, v in got.items():
        if n != seed:
            assert abs(v - r[n] / others) < 1e-3


def test_components_closure_terminals(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)], "src long, dst long")
    got = primitives.closure(edges, spark.createDataFrame([(0,), (100,)], "node long")).groupBy("node").count().collect()
    assert {r.node: r["count"] for r in got} == {0: 41, 100: 3}
    ends = primitives.terminals(edges.where("src < 100"))
    assert {r.terminal for r in ends.collect()} == {40}
    assert {r.component for r in graph.components(edges.toDF("a", "b")).collect()} == {0, 100}


def test_closure_goes_to_the_end(spark):
    n = 2500
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(9000 + i, 9000 + (i + 1) % 7) for i in range(7)], "src long, dst long")
    got = primitives.closure(edges, spark.createDataFrame([(0,), (0,), (700,), (9000,), (9999,)], "node long")).groupBy("node").agg(F.count("*").alias("n"), F.max("reached").alias("last")).collect()
    assert {r.node: (r.n, r["last"]) for r in got} == {0: (n + 1, n), 700: (n - 699, n), 9000: (7, 9006), 9999: (1, 9999)}


def test_closure_against_search(spark):
    rnd = random.Random(5)
    pairs = {(rnd.randrange(60), rnd.randrange(60)) for _ in range(75)}
    want = set()
    for s in range(0, 60, 3):
        reached, todo = {s}, [s]
        while todo:
            at = todo.pop()
            more = {b for a, b in pairs if a == at} - reached
            reached |= more
            todo += more
        want |= {(s, r) for r in reached}
    got = primitives.closure(spark.createDataFrame(sorted(pairs), "src long, dst long"), spark.createDataFrame([(s,) for s in range(0, 60, 3)], "node long")).collect()
    assert len(got) == len(want) and {(r.node, r.reached) for r in got} == want


def test_fixpoint_raises_at_its_guard(spark):
    step = lambda f: f.where("x < 9").select((F.col("x") + 1).alias("x"))
    seed = spark.createDataFrame([(0,)], "x long")
    assert primitives.fixpoint(seed, step, ["x"], limit=9).count() == 10
    with pytest.raises(RuntimeError):
        primitives.fixpoint(seed, step, ["x"], limit=8)


def test_interval_join_against_all_pairs(spark):
    rnd = random.Random(3)
    left = [(i, s, s + rnd.randint(0, 90)) for i, s in enumerate(rnd.sample(range(1000), 80))]
    right = [(i, s, s + rnd.randint(0, 300)) for i, s in enumerate(rnd.sample(range(1000), 60))]
    a, b = spark.createDataFrame(left, "x long, l_start long, l_end long"), spark.createDataFrame(right, "y long, r_start long, r_end long")
    for closed in (False, True):
        want = sorted((x, y) for x, s, e in left for y, t, f in right if (s <= f and t <= e if closed else s < f and t < e))
        assert sorted((r.x, r.y) for r in primitives.interval_join(a, b, 50, closed=closed).collect()) == want


def test_nearest_by_angle(spark):
    rows = [(i, [float(np.cos(np.radians(d))), float(np.sin(np.radians(d))), 0.0]) for i, d in enumerate((0, 10, 25, 90))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    pairs = lambda k: sorted((r.a, r.b) for r in vectors.near_pairs(vectors.nearest(df, k, "id", "v"), 0.65).collect())
    assert pairs(10) == [(0, 1), (0, 2), (1, 2)] and pairs(1) == [(0, 1), (1, 2)]


def test_projection_is_stable():
    m = np.random.default_rng(1).normal(size=(40, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    first = vectors.project(m, {})
    placed = {i: tuple(first[i]) for i in range(30)}
    again = vectors.project(m, placed)
    assert np.allclose(again[:30], first[:30]) and np.abs(again).max() <= 1.25
    mirrored = {i: (-x, y) for i, (x, y) in placed.items()}
    assert np.allclose(vectors.project(m, mirrored, relayout=True)[:30, 0], -first[:30, 0], atol=1e-6)


def test_capture_checks():
    lines = matching.lines_of("[1] me: we should keep it simple\n[2] S1: yes\n[3] me: and ship\nnot a line")
    check = lambda quote, cited, **x: matching.check_capture(lines, quote, cited, x.get("reading", "r"), x.get("gist", "g"), x.get("mishearings", []))
    assert check("keep it  simple", [1]) == [] and check("and ship", [1, 3]) == []
    assert check("Keep it, simple", [1]) == ["quote_inexact"]
    assert check("yes", [1]) == ["quote_not_mine"] and check("simple yes", [1]) == ["quote_not_mine"]
    assert check("keep it simple", [3]) == ["quote_lines_not_cited"]
    assert check("other words", [2, 9], gist="", mishearings=[("x", "y")]) == ["quote_not_in_transcript", "cites_none_of_mine", "mishearing_not_in_quote", "mishearing_not_in_reading", "empty_field"]
    assert check("", [1], mishearings=[]) == ["empty_field"]
    both = matching.lines_of("about this\nTranscript:\n[7] me: keep\n[8] me: it simple\n[10] me: and more")
    assert [n for n, _, _ in both] == [7, 8, 10] and matching.lines_of("[1] S1: a: b") == [(1, "S1", "a: b")]
    assert matching.check_capture(both, "keep it", [7, 8], "r", "g") == [] and matching.check_capture(both, "keep it", [7], "r", "g") == ["quote_lines_not_cited"]
    assert matching.check_capture(both, "simple and", [8, 10], "r", "g") == ["quote_not_mine"]  # not one stretch


def test_kappa_and_empty(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(0, 0)] * 3 + [(1, 0)] * 2, "a int, b int")
    r = stats.kappa(df, "a", "b").head()
    assert (r.n, r.agreement, r.kappa) == (8, 0.75, 0.52941) or abs(r.kappa - 0.529412) < 1e-6
    assert stats.kappa(df.where("a = 1 AND b = 1"), "a", "b").head().kappa is None


def test_upsert_changed_gate(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    new = spark.createDataFrame([(2, None), (3, "c"), (1, "b")], "k long, v string")
    assert sorted(map(tuple, primitives.upsert(old, new, ["k"]).collect())) == [(1, "b"), (2, None), (3, "c")]
    assert sorted(map(tuple, primitives.changed_rows(old, new, ["k"]).collect())) == [(1, "b"), (3, "c")]


@pytest.fixture
def folder(tmp_path):
    import hashlib

    (tmp_path / "conversations").mkdir()
    line = lambda i, s, e, t, kind: json.dumps({"conversation_id": "c1", "utterance_id": f"c1:{i:04}", "start": s, "end": e, "text": t, "speaker": {"kind": kind, "label": "L"}, "extra": 1})
    body = "\n".join([line(0, "2026-09-01T09:00:00.000Z", "2026-09-01T09:00:05.000Z", "hé \"x\"", "owner"), line(1, "2026-09-01T09:00:05.000Z", "2026-09-01T09:00:09.000Z", "ok", "unknown")]) + "\n"
    (tmp_path / "conversations/c1.jsonl").write_text(body)
    (tmp_path / "conversations/c2.jsonl").write_text(body)
    revision = hashlib.sha256(body.encode()).hexdigest()[:16]
    entry = lambda c, r: {"conversation_id": c, "revision": r, "transcript_revision": "t", "file": f"{c}.jsonl", "places": [{"name": "p", "start": "a", "end": "b"}]}
    (tmp_path / "index.json").write_text(json.dumps({"format_version": 1, "conversations": [entry("c1", revision), entry("c2", "stale"), {"conversation_id": "c3"}]}))
    (tmp_path / "forgotten.json").write_text(json.dumps([{"forgotten_at": "2026-09-02T00:00:00Z", "start": "2026-09-01T09:00:05.000Z", "end": "2026-09-01T09:00:06.000Z", "reason": "r"}]))
    return str(tmp_path)


def test_stream(spark, folder):
    import hashlib
    import uuid

    index = stream.read_index(spark, folder)
    rows, raced = stream.read_utterances(spark, folder, index)
    got = {r.utterance_id: r for r in rows.collect()}
    assert [r.conversation_id for r in raced.collect()] == ["c2"] and len(got) == 2
    one = got["c1:0000"]
    identity = json.dumps({"conversation_id": "c1", "start": "2026-09-01T09:00:00.000Z", "end": "2026-09-01T09:00:05.000Z", "text": "hé \"x\""}, sort_keys=True, ensure_ascii=False)
    assert one.segment_id == str(uuid.uuid5(uuid.UUID(stream.SEGMENTS), "c1|" + hashlib.sha256(identity.encode()).hexdigest()))
    assert one.is_self is True and one.speaker_label == "me" and got["c1:0001"].is_self is None
    dead = stream.tombstones(rows, stream.read_forgotten(spark, folder)).collect()
    assert [r.segment_id for r in dead] == [got["c1:0001"].segment_id]  # touching isn't overlapping
    stored = spark.createDataFrame([("c1", one.transcript_revision, False), ("c3", None, False)], "conversation_id string, revision string, stale boolean")
    assert {r.conversation_id for r in stream.to_read(index, stored).collect()} == {"c1", "c2"}
    changed = rows.withColumn("speaker_label", F.lit("z")).where("is_self")
    assert {r.change for r in stream.revision_changes(rows, changed).collect()} == {"relabelled", "gone"}
    assert {r.method for r in stream.supersessions(rows, rows).collect()} == {"rekey"}


def test_streaming_sessions(spark, tmp_path):
    from threadloom.streaming.sessions import event_stream, session_counts

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(f"{tmp_path}/in")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    q = session_counts(event_stream(spark, f"{tmp_path}/in", schema)).writeStream.format("memory").queryName("sess").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sess").agg(F.sum("n")).head()[0] == 1000
