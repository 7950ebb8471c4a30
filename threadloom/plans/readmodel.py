"""The read model and its lists over a ledger made of the driver's tables: lines and
feedback are ``events``, ideas are ``part``. The ledger's frames are SQL that both
engines read alike; views are written apart."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import review, views
from threadloom.plans import query, table

#: The ledger. ARRAY stands for an engine's function that makes a list.
LEDGER = {
    "segments": "SELECT 's' || event_id AS segment_id, 'c' || user_id AS conversation_id, ts AS started_at, event_type AS speaker_label, CASE WHEN event_id % 3 = 0 THEN 'owner' ELSE 'person' END AS speaker_kind, CASE event_id % 5 WHEN 0 THEN 'voice' WHEN 1 THEN 'named' WHEN 2 THEN 'diar' END AS speaker_basis, CAST(event_id % 8 AS DOUBLE) / 8 AS arousal FROM events",
    "members": "SELECT 's' || event_id AS segment_id FROM events WHERE event_id % 11 <> 0",
    "tombstones": "SELECT 's' || event_id AS segment_id FROM events WHERE event_id % 13 = 1",
    "episodes": "SELECT 'e' || user_id AS episode_id, user_id % 4 <> 0 AS current, min(ts) AS started_at FROM events GROUP BY user_id",
    "items": "SELECT 'i' || event_id AS item_id, CASE WHEN event_id % 30 >= 6 THEN 'e' || user_id END AS episode_id, 'x' AS said_by, CASE WHEN event_id % 4 = 0 THEN 's' || event_id END AS said_by_segment_id, ARRAY('s' || event_id, 's' || (event_id + 1)) AS source_segment_ids, CASE WHEN event_id % 14 <> 4 THEN 'o' || (event_id - event_id % 6) END AS observation_id, 'quote ' || event_id AS quote, 'gist ' || event_id AS gist, CASE WHEN event_id % 10 = 6 THEN 'Al' ELSE '' END AS attributed_to, ts AS created_at FROM events WHERE event_id % 2 = 0",
    "observations": "SELECT 'o' || event_id AS observation_id, CASE event_id % 30 WHEN 0 THEN 'archive' WHEN 24 THEN 'typed' ELSE 'speech' END AS source, CASE event_id % 30 WHEN 24 THEN 'd' || (event_id % 500) END AS idea_id, CASE event_id % 30 WHEN 24 THEN 'me' END AS said_by, CASE WHEN event_id % 30 IN (0, 24) THEN ts END AS said_at, CASE WHEN event_id % 30 IN (0, 24) THEN 'c' || user_id END AS conversation, 'typed ' || event_id AS quote, ARRAY('s' || event_id, 's' || (event_id + 2)) AS segment_ids FROM events WHERE event_id % 6 = 0",
    "ideas": "SELECT 'd' || p_partkey AS idea_id, p_name AS title, p_type AS statement, CASE WHEN p_partkey % 5 = 0 THEN 'mine' ELSE 'captured' END AS origin FROM part",
    "evidence": "SELECT DISTINCT 'd' || (event_id % 500) AS idea_id, 'i' || event_id AS item_id, CASE WHEN event_id % 8 = 0 THEN 'origin' ELSE 'same_as' END AS relation FROM events WHERE event_id % 2 = 0 AND event_id % 9 <> 5",
    "events": """SELECT event_id, ts AS at, kind, 'd' || (event_id % 251) AS idea_id, 'd' || (event_id * 7 % 251) AS other_idea_id, CASE WHEN event_id % 15 = 2 THEN 'i' || (event_id * 2 % 5000) END AS item_id, CASE WHEN kind = 'correct' AND event_id % 3 = 0 THEN '{"title":"t' || event_id || '"}' WHEN kind = 'correct' THEN '{"title":"","statement":"s' || event_id || '"}' WHEN kind = 'note' THEN '{"note":"n' || event_id || '"}' WHEN kind = 'keep' AND event_id % 2 = 0 THEN '{"as":"pinned"}' WHEN kind LIKE 'digest%' THEN '{"digest_id":' || (event_id % 5) || ',"point":' || (event_id % 17 + 1) || '}' WHEN event_id % 3 = 0 THEN '{"bulk":true,"audit":true}' WHEN event_id % 3 = 1 THEN '{"audit":true}' ELSE '{"bulk":"true"}' END AS payload
        FROM (SELECT event_id, ts, CASE event_id % 15 WHEN 0 THEN 'correct' WHEN 1 THEN 'note' WHEN 2 THEN 'item' WHEN 3 THEN 'link' WHEN 4 THEN 'unlink' WHEN 5 THEN 'keep' WHEN 6 THEN 'unkeep' WHEN 7 THEN 'star' WHEN 8 THEN 'unstar' WHEN 9 THEN 'sensitive' WHEN 10 THEN 'not_sensitive' WHEN 11 THEN 'dismiss' WHEN 12 THEN 'digest_star' WHEN 13 THEN 'digest_dismiss' ELSE 'read' END AS kind FROM events) e""",
    "connections": "SELECT least('d' || p_partkey, 'd' || (p_partkey * 3 + 1)) AS a, greatest('d' || p_partkey, 'd' || (p_partkey * 3 + 1)) AS b, 'm' || (p_partkey % 2) AS method FROM part WHERE p_partkey < 300",
    "connection_kinds": "SELECT least('d' || p_partkey, 'd' || (p_partkey * 3 + 1)) AS a, greatest('d' || p_partkey, 'd' || (p_partkey * 3 + 1)) AS b, CASE WHEN p_partkey % 2 = 0 THEN 'supports' ELSE 'analogy' END AS kind FROM part WHERE p_partkey < 300 AND p_partkey % 3 = 0",
    "lineage": "SELECT 'd' || p_partkey AS from_id, 'd' || (p_partkey + 2) AS to_id, 'evolves' AS kind FROM part WHERE p_partkey % 7 = 0 AND p_partkey < 400",
    "edge_methods": "SELECT 'm' || r_regionkey AS method, r_regionkey * 4000 + 2000 AS seen_event_id FROM region WHERE r_regionkey < 2",
    "merges": "SELECT 'd' || p_partkey AS other_id, 'd' || (p_partkey - 1) AS keep_id FROM part WHERE p_partkey % 9 IN (3, 4) AND p_partkey < 500",
    "verdicts": "SELECT event_id AS verdict_id, 'i' || (event_id - event_id % 4) AS item_id, CASE event_id % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'discard' ELSE 'star' END AS verdict, ts AS decided_at FROM events WHERE event_id % 7 < 2",
    "proposals": "SELECT 'd' || (event_id % 500) AS idea_id, ts AS made_at, CASE WHEN event_id % 4 = 0 THEN 'kept' END AS outcome FROM events WHERE event_id % 19 = 0",
    "themes": "SELECT 'h' || n_nationkey AS theme_id, n_name AS name FROM nation",
    "idea_themes": "SELECT 'd' || p_partkey AS idea_id, 'h' || (p_partkey % 23) AS theme_id FROM part WHERE p_partkey % 3 = 0 AND p_partkey < 600",
    "sensitivity": "SELECT 'd' || p_partkey AS idea_id, ARRAY('health', p_brand) AS categories FROM part WHERE p_partkey % 10 = 0",
    "digests": "SELECT r_regionkey AS digest_id, r_name AS summary FROM region",
    "digest_points": "SELECT p_partkey % 4 AS digest_id, CAST(floor(p_partkey / 4) + 1 AS BIGINT) AS ord, CASE WHEN p_partkey % 2 = 0 THEN 'turn' ELSE 'thread' END AS kind, p_type AS title, ARRAY('d' || p_partkey, 'd' || (p_partkey + 3), 'd' || (p_partkey + 100000)) AS idea_ids FROM part WHERE p_partkey < 80",
}
_SOURCES = ("events", "part", "nation", "region")


def ledger(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The ledger's frames, lazily: only those that a view uses are read."""
    sources = {f"src_{s}": table(spark, sf_dir, s) for s in _SOURCES}
    sources["src_events"] = sources["src_events"].withColumn("ts", F.col("ts").cast("timestamp"))
    out = {}
    for name, sql in LEDGER.items():
        text = sql.replace("ARRAY(", "array(").replace("{", "{{").replace("}", "}}")
        for s in _SOURCES:
            text = text.replace(f"FROM {s}", f"FROM {{src_{s}}}")
        out[name] = spark.sql(text, **{k: v for k, v in sources.items() if f"{{{k}}}" in text})
    return out


def _quoted(sql: str) -> str:
    """``at`` is a word of DuckDB's grammar."""
    return re.sub(r"(?<![\w\"'])at(?![\w\"'(])", '"at"', sql)


def _cte(name: str, sql: str) -> str:
    return f"l_{name} AS ({sql.replace('ARRAY(', 'list_value(')})"


_VIEWS = """
item_said_by AS (SELECT item_id, coalesce(speaker_label, said_by) AS said_by FROM l_items LEFT JOIN l_segments ON segment_id = said_by_segment_id),
item_lines AS (SELECT item_id, unnest(source_segment_ids) AS segment_id FROM l_items),
owned AS (SELECT item_id, bool_or(coalesce(speaker_basis IN ('voice', 'named', 'channel'), false)) AS sure FROM item_lines JOIN l_segments USING (segment_id) WHERE speaker_kind = 'owner' GROUP BY 1),
item_speaker AS (SELECT item_id, CASE WHEN sure THEN 'me' WHEN sure IS NOT NULL THEN 'me_diar' ELSE 'not_me' END AS speaker, sure IS NOT NULL AS cites_me FROM l_items LEFT JOIN owned USING (item_id)),
observation_speaker AS (SELECT DISTINCT ON (observation_id) observation_id, speaker FROM l_items JOIN item_speaker USING (item_id) LEFT JOIN l_episodes USING (episode_id) WHERE observation_id IS NOT NULL ORDER BY observation_id, coalesce(current, false) DESC, created_at DESC, item_id),
moments AS (SELECT i.item_id, coalesce(min(s.started_at), any_value(o.said_at)) AS at, min(s.conversation_id) AS conversation FROM l_items i LEFT JOIN item_lines USING (item_id) LEFT JOIN l_segments s USING (segment_id) LEFT JOIN l_observations o USING (observation_id) GROUP BY 1),
spoken AS (SELECT e.idea_id, i.observation_id, min(m.at) AS said_at, min(m.conversation) AS conversation FROM l_evidence e JOIN l_items i USING (item_id) JOIN moments m USING (item_id) WHERE i.observation_id IS NOT NULL GROUP BY 1, 2),
idea_observations AS (
  SELECT p.idea_id, observation_id, o.source, w.speaker, p.said_at, p.conversation FROM spoken p JOIN l_observations o USING (observation_id) LEFT JOIN observation_speaker w USING (observation_id)
  UNION ALL SELECT idea_id, observation_id, source, said_by, said_at, conversation FROM l_observations o WHERE source <> 'speech' AND idea_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM spoken p WHERE p.idea_id = o.idea_id AND p.observation_id = o.observation_id)),
up AS (SELECT a.other_id AS idea_id, coalesce(c.keep_id, b.keep_id, a.keep_id) AS into_id FROM l_merges a LEFT JOIN l_merges b ON b.other_id = a.keep_id LEFT JOIN l_merges c ON c.other_id = b.keep_id),
fixed AS (SELECT idea_id, max_by(payload->>'title', event_id) FILTER (kind = 'correct' AND (payload->'title') IS NOT NULL) AS t, max_by(payload->>'statement', event_id) FILTER (kind = 'correct' AND (payload->'statement') IS NOT NULL) AS s, max_by(payload->>'note', event_id) FILTER (kind = 'note') AS note, max(at) FILTER (kind = 'correct') AS corrected_at FROM l_events GROUP BY 1),
idea_text AS (SELECT i.idea_id, coalesce(nullif(t, ''), title) AS title, coalesce(nullif(s, ''), statement) AS statement, nullif(note, '') AS my_note, corrected_at FROM l_ideas i LEFT JOIN fixed USING (idea_id) WHERE i.idea_id NOT IN (SELECT other_id FROM l_merges)),
marks AS (SELECT DISTINCT ON (idea_id) idea_id, kind, payload->>'as' AS as_ FROM l_events WHERE kind IN ('keep', 'unkeep') ORDER BY idea_id, event_id DESC),
stars AS (SELECT DISTINCT ON (idea_id) idea_id, kind FROM l_events WHERE kind IN ('star', 'unstar') ORDER BY idea_id, event_id DESC),
idea_kept AS (SELECT i.idea_id, CASE WHEN m.kind = 'keep' THEN coalesce(as_, 'canonical') WHEN m.kind = 'unkeep' THEN NULL WHEN origin = 'mine' THEN 'canonical' WHEN s.kind = 'star' THEN 'pinned' END AS kept_as FROM l_ideas i LEFT JOIN marks m USING (idea_id) LEFT JOIN stars s USING (idea_id)),
idea_maturity AS (SELECT idea_id, CASE WHEN kept_as IS NOT NULL THEN 'idea' WHEN EXISTS (SELECT 1 FROM idea_observations o WHERE o.idea_id = k.idea_id AND speaker IN ('me', 'me_diar')) THEN 'candidate' ELSE 'observation' END AS maturity FROM idea_kept k),
points AS (SELECT item_id, coalesce(observation_id, item_id) AS point FROM l_items),
point_verdict AS (SELECT DISTINCT ON (point) point, verdict FROM l_verdicts JOIN points USING (item_id) ORDER BY point, decided_at DESC, verdict_id DESC),
capture_verdict AS (SELECT item_id, verdict FROM points LEFT JOIN point_verdict USING (point)),
evidence AS (SELECT DISTINCT ON (idea_id, point) idea_id, item_id, quote, relation, verdict, created_at AS captured_at FROM l_evidence JOIN l_items USING (item_id) JOIN points USING (item_id) JOIN capture_verdict USING (item_id) ORDER BY idea_id, point, verdict IS NULL, relation <> 'origin', created_at, item_id),
evidence_of AS (SELECT idea_id, count(*) FILTER (verdict IS DISTINCT FROM 'discard') AS n, min(captured_at) AS first_said, coalesce(bool_or(verdict = 'star'), false) AS starred FROM evidence GROUP BY 1),
ideas AS (SELECT x.idea_id, x.title, x.statement, x.my_note, i.origin, coalesce(n, 0) AS n_evidence, first_said, coalesce(starred, false) AS starred FROM idea_text x JOIN l_ideas i USING (idea_id) LEFT JOIN evidence_of USING (idea_id) WHERE origin = 'mine' OR n > 0),
my_links AS (SELECT * FROM (SELECT coalesce(u.into_id, e.idea_id) AS x, coalesce(v.into_id, other_idea_id) AS y, kind, event_id FROM l_events e LEFT JOIN up u ON u.idea_id = e.idea_id LEFT JOIN up v ON v.idea_id = other_idea_id WHERE kind IN ('link', 'unlink')) WHERE x <> y),
latest_links AS (SELECT least(x, y) AS a, greatest(x, y) AS b, max_by(kind, event_id) AS kind, max(event_id) AS event_id FROM my_links GROUP BY 1, 2),
shown AS (SELECT a, b, 'mine' AS method FROM latest_links WHERE kind = 'link'
  UNION ALL SELECT c.a, c.b, c.method FROM l_connections c LEFT JOIN latest_links l ON l.a = c.a AND l.b = c.b LEFT JOIN l_edge_methods m ON m.method = c.method WHERE l.kind IS NULL OR (l.kind = 'unlink' AND NOT coalesce(l.event_id > m.seen_event_id, false))),
card_links AS (SELECT * FROM (SELECT a, b, coalesce((SELECT string_agg(DISTINCT kind, ',' ORDER BY kind) FROM l_connection_kinds k WHERE k.a = s.a AND k.b = s.b), '') AS kinds, false AS directed FROM shown s UNION ALL SELECT from_id, to_id, kind, true FROM l_lineage) WHERE a IN (SELECT idea_id FROM ideas) AND b IN (SELECT idea_id FROM ideas)),
link_counts AS (SELECT idea_id, count(*) AS n_links FROM (SELECT a AS idea_id FROM card_links UNION ALL SELECT b FROM card_links) GROUP BY 1),
said_counts AS (SELECT idea_id, count(DISTINCT observation_id) AS n_observations, count(DISTINCT observation_id) FILTER (speaker = 'me') AS n_me, count(DISTINCT observation_id) FILTER (speaker = 'me_diar') AS n_me_diar, count(DISTINCT observation_id) FILTER (speaker = 'not_me') AS n_not_me, count(DISTINCT conversation) AS n_conversations, min(said_at) AS first_said, max(said_at) AS last_said FROM idea_observations GROUP BY 1),
cards AS (SELECT x.idea_id, title, statement, my_note, coalesce(n_observations, 0) AS n_observations, coalesce(n_me, 0) AS n_me, coalesce(n_me_diar, 0) AS n_me_diar, coalesce(n_not_me, 0) AS n_not_me, coalesce(n_conversations, 0) AS n_conversations, first_said, last_said, coalesce(n_links, 0) AS n_links, x.idea_id IN (SELECT idea_id FROM l_proposals WHERE outcome IS NULL) AS proposed, maturity, kept_as
  FROM idea_text x LEFT JOIN said_counts USING (idea_id) LEFT JOIN link_counts USING (idea_id) JOIN idea_maturity USING (idea_id) JOIN idea_kept USING (idea_id)),
sensitive AS (SELECT i.idea_id, CASE WHEN m.kind IS NOT NULL THEN m.kind = 'sensitive' ELSE i.idea_id IN (SELECT idea_id FROM l_sensitivity) END AS sensitive FROM l_ideas i LEFT JOIN (SELECT idea_id, max_by(kind, event_id) AS kind FROM l_events WHERE kind IN ('sensitive', 'not_sensitive') GROUP BY 1) m USING (idea_id)),
arousal AS (SELECT observation_id, avg(arousal) AS arousal FROM (SELECT observation_id, unnest(segment_ids) AS segment_id FROM l_observations) JOIN l_segments USING (segment_id) GROUP BY 1),
current_items AS (SELECT i.*, e.current, e.started_at AS began, coalesce(e.started_at, CASE WHEN i.episode_id IS NULL THEN o.said_at END) AS at, coalesce(i.observation_id, i.item_id) AS point FROM l_items i LEFT JOIN l_episodes e USING (episode_id) LEFT JOIN l_observations o ON o.observation_id = i.observation_id WHERE e.current OR i.episode_id IS NULL)
"""
WITH = "WITH " + ",\n".join(_cte(k, v) for k, v in LEDGER.items()) + "," + _VIEWS
_us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us")


def view(select: str):
    """Registers a plan over the ledger with SQL over its views."""
    return query(_quoted(WITH + select))


@view("SELECT segment_id, conversation_id, speaker_label FROM l_members JOIN l_segments USING (segment_id) WHERE segment_id NOT IN (SELECT segment_id FROM l_tombstones)")
def current_segments(spark, sf_dir):
    """M1."""
    return views.current_segments(ledger(spark, sf_dir)).select("segment_id", "conversation_id", "speaker_label")


@view("SELECT * FROM item_said_by")
def item_said_by(spark, sf_dir):
    """M2."""
    return views.item_said_by(ledger(spark, sf_dir))


@view("SELECT * FROM item_speaker")
def item_speaker(spark, sf_dir):
    """M3."""
    return views.item_speaker(ledger(spark, sf_dir))


@view("SELECT * FROM observation_speaker")
def observation_speaker(spark, sf_dir):
    """M4."""
    return views.observation_speaker(ledger(spark, sf_dir))


@view("SELECT idea_id, observation_id, source, speaker, epoch_us(said_at) AS said_at_us, conversation FROM idea_observations")
def idea_observations(spark, sf_dir):
    """M5."""
    return views.idea_observations(ledger(spark, sf_dir)).select("idea_id", "observation_id", "source", "speaker", _us("said_at"), "conversation")


@view("SELECT idea_id, title, statement, my_note, epoch_us(corrected_at) AS corrected_at_us FROM idea_text")
def idea_text(spark, sf_dir):
    """M6."""
    return views.idea_text(ledger(spark, sf_dir)).select("idea_id", "title", "statement", "my_note", _us("corrected_at"))


@view("SELECT idea_id, kept_as, maturity FROM idea_kept JOIN idea_maturity USING (idea_id)")
def idea_states(spark, sf_dir):
    """M7, M8."""
    t = ledger(spark, sf_dir)
    return views.idea_kept(t).join(views.idea_maturity(t), "idea_id")


@view("SELECT * FROM capture_verdict")
def capture_verdicts(spark, sf_dir):
    """M9, C15."""
    return views.capture_verdict(ledger(spark, sf_dir))


@view("SELECT idea_id, item_id, quote, relation, verdict, epoch_us(captured_at) AS captured_at_us FROM evidence")
def idea_evidence(spark, sf_dir):
    """M10."""
    return views.evidence(ledger(spark, sf_dir)).select("idea_id", "item_id", "quote", "relation", "verdict", _us("captured_at"))


@view("SELECT idea_id, title, statement, my_note, origin, n_evidence, epoch_us(first_said) AS first_said_us, starred, coalesce((SELECT string_agg(DISTINCT theme_id, ',' ORDER BY theme_id) FROM l_idea_themes h WHERE h.idea_id = ideas.idea_id), '') AS themes FROM ideas")
def visible_ideas(spark, sf_dir):
    """M11."""
    rows = views.ideas(ledger(spark, sf_dir))
    return rows.select("idea_id", "title", "statement", "my_note", "origin", "n_evidence", _us("first_said"), "starred", F.coalesce(F.array_join("themes", ","), F.lit("")).alias("themes"))


@view("SELECT * FROM shown")
def connections(spark, sf_dir):
    """M12, M23, J5, J6."""
    return views.shown_connections(ledger(spark, sf_dir))


@view("""
SELECT e.idea_id, e.item_id, i.observation_id, w.speaker, i.quote, epoch_us(p.started_at) AS at_us, m.conversation, 'speech' AS source, round(a.arousal, 6) AS arousal FROM l_evidence e JOIN l_items i USING (item_id) JOIN l_episodes p ON p.episode_id = i.episode_id AND p.current JOIN item_speaker w USING (item_id) JOIN moments m USING (item_id) LEFT JOIN arousal a ON a.observation_id = i.observation_id
UNION ALL SELECT e.idea_id, e.item_id, i.observation_id, w.speaker, i.quote, epoch_us(o.said_at), o.conversation, o.source, NULL FROM l_evidence e JOIN l_items i USING (item_id) JOIN l_observations o ON o.observation_id = i.observation_id JOIN item_speaker w USING (item_id) WHERE i.episode_id IS NULL
UNION ALL SELECT idea_id, NULL, observation_id, said_by, quote, epoch_us(said_at), conversation, source, NULL FROM l_observations WHERE source <> 'speech' AND idea_id IS NOT NULL
""")
def card_evidence(spark, sf_dir):
    """M13."""
    return review.card_evidence(ledger(spark, sf_dir)).select("idea_id", "item_id", "observation_id", "speaker", "quote", _us("at"), "conversation", "source", F.round("arousal", 6).alias("arousal"))


_CARD = ("idea_id", "title", "statement", "my_note", "n_observations", "n_me", "n_me_diar", "n_not_me", "n_conversations", "n_links", "proposed", "maturity", "kept_as")


@view(f"SELECT {', '.join(_CARD)}, epoch_us(first_said) AS first_said_us, epoch_us(last_said) AS last_said_us FROM cards")
def card_rows(spark, sf_dir):
    """M14."""
    return views.cards(ledger(spark, sf_dir)).select(*_CARD, _us("first_said"), _us("last_said"))


@view("SELECT * FROM card_links")
def card_edges(spark, sf_dir):
    """Links and lineage."""
    return views.card_links(ledger(spark, sf_dir)).withColumn("kinds", F.array_join("kinds", ","))


@view("SELECT idea_id, epoch_us(made_at) AS made_at_us FROM l_proposals p WHERE outcome IS NULL AND idea_id NOT IN (SELECT idea_id FROM idea_kept WHERE kept_as IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM l_events e WHERE e.idea_id = p.idea_id AND e.kind = 'dismiss' AND e.at >= p.made_at)")
def open_proposals(spark, sf_dir):
    """M16."""
    return views.proposals(ledger(spark, sf_dir)).select("idea_id", _us("made_at"))


@view("SELECT theme_id, name, (SELECT count(DISTINCT idea_id) FROM l_idea_themes h WHERE h.theme_id = t.theme_id) AS n_ideas FROM l_themes t")
def theme_rows(spark, sf_dir):
    """M17."""
    return views.themes(ledger(spark, sf_dir))


@view("""
, digest_said AS (SELECT (payload->>'digest_id')::BIGINT AS digest_id, (payload->>'point')::BIGINT AS ord, max_by(replace(kind, 'digest_', ''), event_id) AS mine FROM l_events WHERE kind IN ('digest_star', 'digest_dismiss') GROUP BY 1, 2),
point_json AS (SELECT digest_id, ord, '{"point":' || ord || ',"kind":"' || kind || '","title":"' || title || '","idea_ids":[' || coalesce((SELECT string_agg('"' || u.i || '"', ',' ORDER BY u.at) FROM (SELECT unnest(idea_ids) AS i, generate_subscripts(idea_ids, 1) AS at) u WHERE u.i IN (SELECT idea_id FROM ideas)), '') || '],"mine":' || coalesce('"' || mine || '"', 'null') || '}' AS j FROM l_digest_points p LEFT JOIN digest_said USING (digest_id, ord))
SELECT digest_id, summary, coalesce((SELECT '[' || string_agg(j, ',' ORDER BY ord) || ']' FROM point_json p WHERE p.digest_id = d.digest_id), '[]') AS points FROM l_digests d
""")
def digest_rows(spark, sf_dir):
    """Nested points as JSON."""
    return review.digests(ledger(spark, sf_dir))


@view("SELECT * FROM sensitive")
def sensitivity_marks(spark, sf_dir):
    """M19."""
    return views.sensitive(ledger(spark, sf_dir))


@view(f"SELECT {', '.join(c if c not in ('title', 'statement', 'my_note') else f'CASE WHEN NOT sensitive THEN {c} END AS {c}' for c in _CARD)} FROM cards JOIN sensitive USING (idea_id)")
def demo_cards(spark, sf_dir):
    """Cards."""
    return views.demo_cards(ledger(spark, sf_dir)).select(*_CARD)


@view("SELECT idea_id, item_id, quote FROM evidence WHERE idea_id NOT IN (SELECT idea_id FROM sensitive WHERE sensitive)")
def demo_evidence(spark, sf_dir):
    """Evidence."""
    return views.demo_evidence(ledger(spark, sf_dir)).select("idea_id", "item_id", "quote")


@view("SELECT observation_id, round(arousal, 6) AS arousal FROM arousal")
def observation_arousal(spark, sf_dir):
    """M22."""
    return views.observation_arousal(ledger(spark, sf_dir)).select("observation_id", F.round("arousal", 6).alias("arousal"))


@view("SELECT idea_id, into_id AS \"into\" FROM up")
def merged_into(spark, sf_dir):
    """M23, J4."""
    return views.merged_into(ledger(spark, sf_dir))


@view("""
, one AS (SELECT DISTINCT ON (e.idea_id, i.observation_id) e.idea_id, i.quote, began::DATE AS said_on, w.speaker = 'me' AS me FROM current_items i JOIN l_evidence e USING (item_id) JOIN observation_speaker w ON w.observation_id = i.observation_id WHERE current ORDER BY e.idea_id, i.observation_id, created_at, item_id),
said AS (SELECT * FROM one UNION ALL SELECT idea_id, quote, said_at::DATE, said_by = 'me' FROM l_observations WHERE idea_id IS NOT NULL)
SELECT idea_id, nth::INTEGER AS nth, quote, said_on::VARCHAR AS said_on, me FROM (SELECT *, row_number() OVER (PARTITION BY idea_id ORDER BY me DESC NULLS LAST, said_on NULLS LAST, quote NULLS LAST) AS nth FROM said) WHERE nth <= 2
""")
def side_quotes(spark, sf_dir):
    """Two things said for each idea, mine first."""
    return review.side_data(ledger(spark, sf_dir)).select("idea_id", "nth", "quote", F.col("said_on").cast("string").alias("said_on"), "me")


@view("""
, one AS (SELECT DISTINCT ON (e.idea_id, point) e.idea_id, gist, quote, at FROM current_items JOIN l_evidence e USING (item_id) ORDER BY e.idea_id, point, at DESC NULLS LAST, item_id DESC),
said AS (SELECT * FROM one UNION ALL SELECT idea_id, quote, quote, said_at FROM l_observations WHERE idea_id IS NOT NULL AND source <> 'speech')
SELECT idea_id, nth::INTEGER AS nth, gist, quote FROM (SELECT *, row_number() OVER (PARTITION BY idea_id ORDER BY at DESC NULLS FIRST, quote) AS nth FROM said) WHERE nth <= 3
""")
def cluster_members(spark, sf_dir):
    """The newest three observations of each idea."""
    return review.cluster_members(ledger(spark, sf_dir))


@view("""
, last AS (SELECT DISTINCT ON (item_id) item_id, verdict FROM l_verdicts ORDER BY item_id, decided_at DESC, verdict_id DESC)
SELECT item_id, s.said_by AS "by", verdict, epoch_us(at) AS at_us FROM current_items JOIN item_said_by s USING (item_id) LEFT JOIN last USING (item_id) WHERE item_id NOT IN (SELECT item_id FROM l_evidence)
""")
def pending_items(spark, sf_dir):
    """Captures that wait for a match."""
    return review.pending_items(ledger(spark, sf_dir)).select("item_id", "by", "verdict", _us("at"))


@view("SELECT DISTINCT idea_id FROM l_evidence JOIN l_items USING (item_id) WHERE relation = 'origin' AND attributed_to <> ''")
def relayed_clusters(spark, sf_dir):
    """O16."""
    return review.relayed_clusters(ledger(spark, sf_dir))


@view("SELECT DISTINCT idea_id, segment_id FROM l_evidence JOIN item_lines USING (item_id)")
def segments_of_ideas(spark, sf_dir):
    """O18."""
    return review.segments_of(ledger(spark, sf_dir))


@view("SELECT segment_id, epoch_us(min(created_at)) AS first_sent_us, count(*) AS requests FROM l_items JOIN item_lines USING (item_id) WHERE segment_id IN (SELECT segment_id FROM l_tombstones) GROUP BY 1")
def forgotten_but_sent(spark, sf_dir):
    """O19."""
    t = ledger(spark, sf_dir)
    sent = t["items"].select(F.col("created_at").alias("at"), F.col("source_segment_ids").alias("segment_ids"))
    return review.forgotten_sent(t["tombstones"], sent).select("segment_id", _us("first_sent"), "requests")


@view("""
, touched AS (SELECT point FROM points WHERE item_id IN (SELECT item_id FROM l_verdicts) OR item_id IN (SELECT item_id FROM l_events WHERE item_id IS NOT NULL))
SELECT DISTINCT ON (point) item_id, quote FROM current_items WHERE current AND point NOT IN (SELECT point FROM touched) ORDER BY point, created_at, item_id
""")
def undecided_items(spark, sf_dir):
    """Captures I haven't decided on."""
    return review.undecided(ledger(spark, sf_dir))


@view("SELECT item_id, quote, epoch_us(decided_at) AS decided_at_us FROM (SELECT DISTINCT ON (item_id) item_id, verdict, decided_at FROM l_verdicts ORDER BY item_id, decided_at DESC, verdict_id DESC) JOIN l_items USING (item_id) WHERE verdict = 'discard'")
def discarded_items(spark, sf_dir):
    """Captures I discarded."""
    return review.discards(ledger(spark, sf_dir)).select("item_id", "quote", _us("decided_at"))


@view("SELECT count(*) AS ideas, count(*) FILTER (origin = 'captured') AS captured, count(*) FILTER (origin = 'mine') AS added_by_me, count(*) FILTER (n_evidence > 1) AS with_more, (SELECT count(*) FROM shown) AS connections, (SELECT count(*) FROM current_items WHERE item_id NOT IN (SELECT item_id FROM l_evidence)) AS unmatched FROM ideas")
def status_counts(spark, sf_dir):
    """O21, R14."""
    return review.status(ledger(spark, sf_dir))


_PAIRS = "SELECT a, b, CASE WHEN a < 'd2' THEN 'none' ELSE 'related' END AS verdict FROM l_connections"


@view(f", judged AS ({_PAIRS}) SELECT a, b, (SELECT count(*) > 50 FROM judged j WHERE verdict = 'none' AND j.a IN (SELECT idea_id FROM ideas) AND j.b IN (SELECT idea_id FROM ideas)) AS more FROM judged WHERE verdict = 'none' AND a IN (SELECT idea_id FROM ideas) AND b IN (SELECT idea_id FROM ideas) ORDER BY a, b LIMIT 50")
def apart_pairs(spark, sf_dir):
    """The first page of pairs judged not to connect."""
    t = ledger(spark, sf_dir)
    return review.apart(t, t["connections"].select("a", "b", F.when(F.col("a") < "d2", "none").otherwise("related").alias("verdict")))


@view("SELECT 'r' || p_partkey AS review_id FROM part WHERE p_partkey < 500 AND (SELECT count(DISTINCT coalesce(into_id, x)) FROM (SELECT unnest(list_value('d' || p_partkey, 'd' || (p_partkey + 1))) AS x) LEFT JOIN up ON idea_id = x) = 1")
def settled_reviews(spark, sf_dir):
    """Reviews whose ideas have become one."""
    p = table(spark, sf_dir, "part").where("p_partkey < 500")
    name = lambda n: F.concat(F.lit("d"), (F.col("p_partkey") + n).cast("string"))
    reviews = p.select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("review_id"), F.array(name(0), name(1)).alias("idea_ids"))
    return review.resolved_reviews(reviews, ledger(spark, sf_dir)["merges"])


@view("""
, refs AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'd' || (event_id * 3) ELSE substr('d' || (event_id * 5 % 3000), 1, 4) END AS ref FROM events),
hit AS (SELECT ref, count(i.idea_id) AS n, min(i.idea_id) AS id FROM refs LEFT JOIN l_ideas i ON starts_with(i.idea_id, ref) GROUP BY 1)
SELECT ref, CASE WHEN n = 1 AND into_id IS NULL THEN id END AS id, CASE WHEN n = 0 THEN 'none' WHEN n > 1 THEN 'ambiguous' WHEN into_id IS NOT NULL THEN 'merged into ' || into_id END AS problem FROM hit LEFT JOIN up ON idea_id = id
""")
def idea_lookup(spark, sf_dir):
    """Ids by a unique beginning, else why not."""
    t = ledger(spark, sf_dir)
    e = table(spark, sf_dir, "events").select("event_id")
    name = lambda n: F.concat(F.lit("d"), n.cast("string"))
    refs = e.select(F.when(F.col("event_id") % 2 == 0, name(F.col("event_id") * 3)).otherwise(F.substring(name(F.col("event_id") * 5 % 3000), 1, 4)).alias("ref"))
    return review.looked_up(refs, t["ideas"].select(F.col("idea_id").alias("id")), views.merged_into(t))


@view("SELECT event_id, CASE WHEN (payload->'bulk')::VARCHAR = 'true' THEN 'bulk' WHEN (payload->'audit')::VARCHAR = 'true' THEN 'audit' ELSE 'one' END AS how FROM l_events")
def keep_modes(spark, sf_dir):
    """How a keep was made, by its payload."""
    return ledger(spark, sf_dir)["events"].select("event_id", review.how(F.col("payload")).alias("how"))


@query(r"""
SELECT conv_id, turn, regexp_matches(text, '\bnote to (my)?self\b', 'i') AS cue, CASE WHEN trim(text) = '' OR regexp_matches(text, '["“”]|^\s*\w+:\s|\bI said\b|\b(me|someone|S\d+|unknown):', 'i') OR (regexp_matches(text, '\bsomeone (says|said)\b', 'i') AND conv_id % 2 = 0) THEN 'gist ' || conv_id ELSE trim(text) END AS statement
FROM (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN text WHEN 1 THEN 'Note to myself: ' || substr(text, 1, 9) WHEN 2 THEN 'keynote to selfless' WHEN 3 THEN 'someone says ' || turn WHEN 4 THEN ' S1: said' ELSE ' ' END AS text FROM conversations)
""")
def line_rules(spark, sf_dir):
    """The note cue, and statements that fall back to a gist."""
    turn = F.col("turn") % 6
    text = F.when(turn == 0, F.col("text")).when(turn == 1, F.concat(F.lit("Note to myself: "), F.substring("text", 1, 9))).when(turn == 2, "keynote to selfless").when(turn == 3, F.concat(F.lit("someone says "), F.col("turn").cast("string"))).when(turn == 4, " S1: said").otherwise(" ")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    gist = F.concat(F.lit("gist "), F.col("conv_id").cast("string"))
    return rows.select("conv_id", "turn", review.note_to_self(F.col("text")).alias("cue"), review.statement(F.col("text"), gist, F.when(F.col("conv_id") % 2 == 1, "Al")).alias("statement"))


@view("""
SELECT idea_id, array_to_string(list_filter([
  CASE WHEN kept_as IS NULL THEN maturity ELSE 'kept as ' || kept_as END || CASE WHEN proposed THEN ' · proposed' ELSE '' END,
  coalesce(nullif(array_to_string(list_filter([CASE WHEN n_me > 0 THEN n_me || ' me' END, CASE WHEN n_me_diar > 0 THEN n_me_diar || ' me (diarization)' END, CASE WHEN n_not_me > 0 THEN n_not_me || ' not me' END], lambda x: x IS NOT NULL), ', '), ''), origin),
  CASE WHEN n_conversations > 0 THEN n_conversations || ' conversation' || CASE WHEN n_conversations = 1 THEN '' ELSE 's' END END,
  CASE WHEN first_said IS NOT NULL THEN strftime(first_said, '%Y-%m-%d') || ' → ' || strftime(last_said, '%Y-%m-%d') ELSE '—' END,
  CASE WHEN n_links > 0 THEN n_links || ' edge' || CASE WHEN n_links = 1 THEN '' ELSE 's' END END], lambda x: x IS NOT NULL), ' · ') AS facts
FROM cards JOIN l_ideas USING (idea_id)
""")
def fact_lines(spark, sf_dir):
    """B36."""
    t = ledger(spark, sf_dir)
    return review.fact_line(views.cards(t).join(t["ideas"].select("idea_id", "origin"), "idea_id")).select("idea_id", "facts")


@query("""
SELECT id, CASE WHEN starts_with(m, 'claude') THEN 'anthropic' ELSE split_part(m, '/', 1) END AS family, CASE WHEN m = 'claude-x-4-2-20260101' OR m = 'claude-x-4-2' THEN 'anthropic/claude-x-4.2' ELSE m END AS route, m || ' p' || id % 3 || CASE WHEN id % 2 = 0 THEN '' ELSE ' C' END AS label
FROM (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'claude-x-4-2-20260101' WHEN 1 THEN 'claude-x-4-2' WHEN 2 THEN p_type || '/m-1-2' ELSE 'claude-x-4-2-2026' END AS m FROM part)
""")
def model_names(spark, sf_dir):
    """B39, B40."""
    k = F.col("p_partkey")
    m = F.when(k % 4 == 0, "claude-x-4-2-20260101").when(k % 4 == 1, "claude-x-4-2").when(k % 4 == 2, F.concat("p_type", F.lit("/m-1-2"))).otherwise("claude-x-4-2-2026")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), m.alias("m"))
    prompt = F.concat(F.lit("p"), (F.col("id") % 3).cast("string"))
    return rows.select("id", review.family(F.col("m")).alias("family"), review.route(F.col("m")).alias("route"), review.version_label(F.col("m"), prompt, F.when(F.col("id") % 2 == 0, "B").otherwise("C"), "B").alias("label"))


@query("""
WITH a AS (SELECT o_custkey AS payload, o_orderkey AS nth, list(l_linenumber ORDER BY l_linenumber DESC) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT payload, nth, list_aggregate(list_transform(list_sort(list_distinct(list_filter(lines, lambda n: n <= payload % 5))), lambda n: 's' || n), 'string_agg', ',') AS segments FROM a WHERE len(list_filter(lines, lambda n: n <= payload % 5)) > 0
""")
def answered_items(spark, sf_dir):
    """K7: an answer's captures with real lines only."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    rows = table(spark, sf_dir, "orders").join(li, "o_orderkey").groupBy(F.col("o_custkey").alias("payload"), F.col("o_orderkey").alias("nth")).agg(F.collect_list("l_linenumber").alias("lines"))
    n = (F.col("payload") % 5).cast("int")
    segments = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("s"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    payloads = rows.select("payload").distinct().select("payload", segments.alias("segment_ids"))
    return review.answered_items(payloads, rows.withColumn("quote", F.lit(""))).select("payload", "nth", F.array_join("segment_ids", ",").alias("segments"))


@query("""
WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations GROUP BY 1),
q AS (SELECT conv_id, texts, CASE conv_id % 3 WHEN 0 THEN 'not there' WHEN 1 THEN texts[len(texts)] ELSE substr(texts[1], 1, 12) END AS quote FROM c),
p AS (SELECT *, instr(array_to_string(texts, ' '), trim(regexp_replace(quote, '\\s+', ' ', 'g'))) - 1 AS spot FROM q)
SELECT conv_id, CASE WHEN spot < 0 THEN 7 ELSE len(list_filter(list_transform(generate_series(1, len(texts)), lambda k: list_sum(list_transform(texts[1:k], lambda t: length(t) + 1))), lambda e: e <= spot)) END::INTEGER AS message FROM p
""".replace("\\\\s", "\\s"))
def quote_messages(spark, sf_dir):
    """K8: the message in which a quote starts."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    quote = F.when(F.col("conv_id") % 3 == 0, "not there").when(F.col("conv_id") % 3 == 1, F.element_at("texts", -1)).otherwise(F.substring(F.element_at("texts", 1), 1, 12))
    return c.withColumn("quote", quote).select("conv_id", review.started_in(F.col("quote"), F.col("texts"), F.lit(7)).cast("int").alias("message"))


_ANSWER = "SELECT o_orderkey AS id, o_custkey AS owner, list_value(o_orderkey % 4, o_orderkey % 3, o_orderkey % 7) AS cited, CASE o_orderkey % 3 WHEN 0 THEN 'turn' WHEN 1 THEN 'thread' ELSE 'other' END AS kind, o_orderpriority AS title FROM orders"
_CITED = "list_distinct(list_filter(cited, lambda n: n >= 1 AND n <= 3))"


def _answers(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("owner"), F.array(k % 4, k % 3, k % 7).alias("cited"), F.when(k % 3 == 0, "turn").when(k % 3 == 1, "thread").otherwise("other").alias("kind"), F.col("o_orderpriority").alias("title"))


@query(f"WITH a AS ({_ANSWER}) SELECT owner AS digest_id, row_number() OVER (PARTITION BY owner ORDER BY id) AS ord, kind, title, list_sum(list_transform(list_filter([1, 2, 3], lambda n: list_contains(cited, n)), lambda n: 10 * n))::BIGINT AS ideas FROM a WHERE kind <> 'other' AND len({_CITED}) > 0")
def digest_answers(spark, sf_dir):
    """Points that rest on ideas shown, renumbered."""
    rows = _answers(spark, sf_dir).select(F.col("owner").alias("digest_id"), F.col("id").alias("nth"), "kind", "title", F.lit("body").alias("body"), "cited", F.array(F.lit(10), F.lit(20), F.lit(30)).alias("shown"))
    return review.digest_points(rows, ("turn", "thread")).select("digest_id", F.col("ord").cast("long").alias("ord"), "kind", "title", F.aggregate("idea_ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("ideas"))


@query(f"WITH a AS ({_ANSWER}), s AS (SELECT id, list_sort({_CITED}) AS same FROM a) SELECT id AS item_id, CASE WHEN len(same) > 0 THEN 'same_as' ELSE 'new' END AS decision, CASE WHEN len(same) > 0 THEN 'c' || same[1] END AS idea_id, CASE WHEN len(same) > 1 THEN array_to_string(list_transform(same, lambda n: 'c' || n), ',') END AS review FROM s")
def match_decisions(spark, sf_dir):
    """What the matcher's answers decide."""
    rows = _answers(spark, sf_dir).select(F.col("id").alias("item_id"), F.array(F.lit("c1"), F.lit("c2"), F.lit("c3")).alias("candidates"), F.col("cited").alias("same"))
    return review.match_decisions(rows).withColumn("review", F.array_join("review", ","))


@query("SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN round((p_partkey % 11) / 10.0, 3) >= 0.5 THEN 'health' END, CASE WHEN round((p_partkey % 7) / 6.0, 3) >= 0.5 THEN 'family' END, CASE WHEN round((p_partkey % 3) / 3.0, 3) >= 0.5 THEN 'money' END], lambda x: x IS NOT NULL), ',') AS tags FROM part")
def sensitivity_tags(spark, sf_dir):
    """Tags in their fixed order by their probabilities."""
    k = F.col("p_partkey")
    got = review.tags({"health": (k % 11) / 10.0, "family": (k % 7) / 6.0, "money": (k % 3) / 3.0})
    return table(spark, sf_dir, "part").select(k.alias("id"), F.array_join(got, ",").alias("tags"))


_ADDS = """adds AS (SELECT event_id, 'n' || (event_id % 700) AS idea_id, '{"title":" t' || event_id || ' ","statement":"s","note":"' || CASE WHEN event_id % 2 = 0 THEN 'why' ELSE ' ' END || '","link_to":["n' || (event_id % 13) || '","n' || (event_id % 700) || '","zz"]}' AS payload FROM events WHERE event_id % 5 = 0),
known AS (SELECT 'n' || p_partkey AS idea_id, CASE WHEN p_partkey % 2 = 0 THEN 'mine' ELSE 'captured' END AS origin FROM part WHERE p_partkey < 60)"""


@query(f"""
WITH {_ADDS}, first AS (SELECT DISTINCT ON (idea_id) event_id, idea_id, payload FROM adds WHERE idea_id NOT IN (SELECT idea_id FROM known) ORDER BY idea_id, event_id)
SELECT 'new' AS what, idea_id, trim(payload->>'title') || coalesce('/' || nullif(trim(payload->>'note'), ''), '') AS detail FROM first
UNION ALL SELECT DISTINCT 'link', idea_id, o FROM (SELECT idea_id, unnest(from_json(payload->'link_to', '["VARCHAR"]')) AS o FROM first) WHERE o <> idea_id AND (o IN (SELECT idea_id FROM known) OR o IN (SELECT idea_id FROM first))
UNION ALL SELECT 'refused', idea_id, event_id::VARCHAR FROM adds JOIN known USING (idea_id) WHERE origin <> 'mine'
""")
def added_ideas(spark, sf_dir):
    """Ideas, links and refusals from events that add ideas."""
    k, p = F.col("event_id"), F.col("p_partkey")
    n = lambda c: F.concat(F.lit("n"), c.cast("string"))
    text = F.concat(F.lit('{"title":" t'), k.cast("string"), F.lit(' ","statement":"s","note":"'), F.when(k % 2 == 0, "why").otherwise(" "), F.lit('","link_to":["'), n(k % 13), F.lit('","'), n(k % 700), F.lit('","zz"]}'))
    events = table(spark, sf_dir, "events").where(k % 5 == 0).select(k, F.lit("idea_add").alias("kind"), n(k % 700).alias("idea_id"), text.alias("payload"))
    known = table(spark, sf_dir, "part").where(p < 60).select(n(p).alias("idea_id"), F.when(p % 2 == 0, "mine").otherwise("captured").alias("origin"))
    new, links, refused = review.added_ideas(events, known)
    tag = lambda what, df, detail: df.select(F.lit(what).alias("what"), "idea_id", detail.alias("detail"))
    return tag("new", new, F.concat_ws("/", "title", "note")).unionByName(tag("link", links, F.col("other"))).unionByName(tag("refused", refused, F.col("event_id").cast("string")))


@query("""
WITH t AS (SELECT o_custkey AS idea_id, o_orderkey AS theme_id, CASE o_orderkey % 3 WHEN 0 THEN 'assigned' WHEN 1 THEN 'proposed' ELSE 'archive' END AS origin FROM orders)
SELECT idea_id, theme_id, origin FROM t JOIN customer ON c_custkey = idea_id WHERE NOT (origin IN ('assigned', 'proposed') AND c_nationkey > 12)
""")
def refiled_themes(spark, sf_dir):
    """Placements after corrections."""
    k = F.col("o_orderkey")
    placed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("idea_id"), k.alias("theme_id"), F.when(k % 3 == 0, "assigned").when(k % 3 == 1, "proposed").otherwise("archive").alias("origin"))
    c = table(spark, sf_dir, "customer")
    ids = c.select(F.col("c_custkey").alias("idea_id"), "c_nationkey")
    return review.refiled(placed, ids.select("idea_id", F.lit(12).alias("checked_at")), ids.select("idea_id", F.col("c_nationkey").alias("corrected_at")))
