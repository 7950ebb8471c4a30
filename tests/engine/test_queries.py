"""Every registered query against its SQL at the smallest scale."""

import pytest

from threadloom import catalog

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(round(r[i], 6) if isinstance(r[i], float) else str(r[i]) for i in order)) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, oracle, name):
    got = catalog.queries()[name](spark, SF)
    want = oracle.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"quote_pairs", "quote_place", "capture_checks"}))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def conversations(spark):
    out = {}
    for r in sorted(catalog.table(spark, SF, "conversations").collect(), key=lambda r: (r.conv_id, r.turn)):
        out.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    return out


def test_quote_pairs_by_hand(spark):
    """Against a second computation of the matching blocks' sum."""
    from difflib import SequenceMatcher

    def plain(t):
        cleaned = "".join(c if c.isalnum() else "" if c in "'’" else " " for c in t.lower())
        return [w for w in cleaned.split() if w not in ("uh", "um", "er", "ah", "eh", "hmm", "mm")]

    want = {}
    for conv, lines in conversations(spark).items():
        for (_, _, before), (turn, _, now) in zip(lines, lines[1:]):
            x, y = plain(before), plain(now)
            shared = len(x) + len(y) and SequenceMatcher(None, x, y, autojunk=False).ratio() * (len(x) + len(y)) / 2
            want[conv * 100 + turn] = round(shared / max(min(len(x), len(y)), 4), 6) if x and y else 0.0
    assert {r.id: r.score for r in catalog.queries()["quote_pairs"](spark, SF).collect()} == pytest.approx(want, abs=2e-6)


def test_quote_place_finds_every_line(spark):
    """A quote of a whole line without one word is found, but for the leaked label."""
    got = {(r.conv_id, r.turn): r for r in catalog.queries()["quote_place"](spark, SF).collect()}
    lines = conversations(spark)
    assert set(got) == {(c, t) for c, ls in lines.items() for t, _, _ in ls}
    for (_, turn), r in got.items():
        assert str(turn) in r.lines.split(",")  # cited, so there in any case
    assert sum(r.share >= 0.99 for r in got.values()) > 0.9 * len(got)


def test_capture_checks_by_kind(spark):
    """Each capture is made wrong in known ways: what must and can't be found."""
    got = {r.conv_id: r.codes.split(",") if r.codes else [] for r in catalog.queries()["capture_checks"](spark, SF).collect()}
    lines = conversations(spark)
    assert set(got) == set(lines)
    for conv, codes in got.items():
        ls = lines[conv]
        assert ("empty_field" in codes) == (conv % 7 == 0 or conv % 9 == 0 or conv % 6 == 5 or not [ls[0][2], ls[0][2], ls[-1][2], ls[0][2] + ls[1][2] if len(ls) > 1 else ls[0][2], "x", ""][conv % 6].strip())
        if conv % 6 == 4:
            assert "quote_not_in_transcript" in codes
        cited = 1 if conv % 5 else 2
        assert ("cites_none_of_mine" in codes) == (len(ls) < cited or ls[cited - 1][1] != "user")
        if conv % 6 == 0 and ls[0][1] == "user" and ls[0][2].strip() and conv % 5:
            assert not {"quote_not_in_transcript", "quote_not_mine", "quote_inexact", "quote_lines_not_cited"} & set(codes)


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0
