import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from threadloom.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def keep(kind, s):
    digits = re.sub(r"\D", "", s)
    return {
        "email": True,
        "ip": all(int(x) <= 255 for x in s.split(".")) if kind == "ip" else None,
        "card": 13 <= len(digits) <= 19 and pii.luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def brute(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if keep(k, m[0])]


def test_base_against_plain_patterns():
    rnd = random.Random(1)
    parts = ["a", "b.c", "@", ".", "-", "_", "1", "22", "255", "256", "1.2.3.4", "+1", " ", "(", ")", "4417744280351547", "é", "+", "%", "000000001"]
    for _ in range(20000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 24)))
        assert pii.find(text) == brute(text), text


def test_time_follows_length():
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 150_000, "1.2.3." * 50_000, "+1" * 150_000, "one " * 75_000, "a at b dot " * 27_000, "1 " * 150_000):
        began = time.time()
        pii.find_all(text)
        assert time.time() - began < 5, text[:12]


def test_deobfuscation_maps_back():
    cases = {
        "write to john.doe [at] mail (dot) example [dot] com now": ("email", "john.doe [at] mail (dot) example [dot] com"),
        "write to jane at mail dot example dot com now": ("email", "jane at mail dot example dot com"),
        "mail jоhn@exаmple.соm é": ("email", "jоhn@exаmple.соm"),
        "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ": ("email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        "call plus one five five five zero one nine nine two two now": ("phone", "plus one five five five zero one nine nine two two"),
        "ip one nine two dot one six eight dot zero dot one ok": ("ip", "one nine two dot one six eight dot zero dot one"),
        "card 4111​1111​1111​1111 end": ("card", "4111​1111​1111​1111"),
        "tel +１ (５５５) 555-0199 x": ("phone", "+１ (５５５) 555-0199"),
    }
    for text, (kind, part) in cases.items():
        a = text.index(part)
        assert (kind, a, a + len(part)) in pii.find_all(text)[1], (text, pii.find_all(text), pii.deobfuscated(text) and pii.deobfuscated(text).text)
    for text in ("she was at home", "look at example.com", "one two three", "at least one dot", "Él se, на дворе трава"):
        assert pii.find_all(text)[1] == []


def test_one_disguise_is_enough():
    """Dots alone, and words among digits, with no other disguise in the text."""
    cases = {
        "write john.smith@example [dot] com now": ("email", "john.smith@example [dot] com"),
        "write john@example[.]com now": ("email", "john@example[.]com"),
        "host 192[.]168[.]1[.]20 up": ("ip", "192[.]168[.]1[.]20"),
        "host 192 dot 168 dot 1 dot 20 up": ("ip", "192 dot 168 dot 1 dot 20"),
        "host 192 dot 168 dot one dot 20 up": ("ip", "192 dot 168 dot one dot 20"),
        "host 192.168.one.20 up": ("ip", "192.168.one.20"),
        "write john at mail.example dot com now": ("email", "john at mail.example dot com"),
        "write john at example [dot] com now": ("email", "john at example [dot] com"),
        "call +49 one 5 one 7 two 3 four now": ("phone", "+49 one 5 one 7 two 3 four"),
        "card 4111 1111 1111 11 one one end": ("card", "4111 1111 1111 11 one one"),
        "in 2024, four one one one 1 1 1 1 1 1 1 1 1 1 1 1 end": ("card", "four one one one 1 1 1 1 1 1 1 1 1 1 1 1"),
        "ip １.2.3.4 and one two three": ("ip", "１.2.3.4"),
    }
    for text, (kind, part) in cases.items():
        a = text.index(part)
        assert (kind, a, a + len(part)) in pii.find_all(text)[1], text
    for text in ("a point made, one point in time", "see [.] and (dot) at 5 point 3", "look at example.com, at 10 dot 5"):
        assert pii.find_all(text)[1] == [], text


def test_wider_spans_are_added_beside_base_spans():
    for text, base, wide, masked in (
        ("to jоhn@example.com now", "hn@example.com", "jоhn@example.com", "to <EMAIL> now"),
        ("a (at) b and jane@mail.example (dot) com now", "jane@mail.example", "jane@mail.example (dot) com", "a (at) b and <EMAIL> now"),
        ("to john [dot] smith@example.com now", "smith@example.com", "john [dot] smith@example.com", "to <EMAIL> now"),
    ):
        spans = [("email", text.index(x), text.index(x) + len(x)) for x in (base, wide)]
        got = pii.find_all(text)
        assert got == (spans[:1], sorted(spans)), text
        assert pii.redacted(text, got[1]) == masked
    text = "a@b.co one two three, 10.0.0.1 [dot]"
    assert pii.find_all(text)[1] == pii.find(text)


def test_frames(spark):
    texts = [None, "", "a@b.co and a [at] b [dot] co, 10.0.0.1", "same", "same"]
    df = spark.createDataFrame([(i if i != 3 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    rows = pii.digest(pii.find_pii(df)).collect()
    assert len(rows) == 5 and {r.doc_id for r in rows} == {0, 1, 2, 4, None}
    two = next(r for r in rows if r.doc_id == 2)
    assert (two.n_email, two.n_ip, two.spans) == (1, 1, "email:0:6,email:11:28,ip:30:38")
    assert two.base_sha256 == hashlib.sha256(b"email:0:6,ip:30:38").hexdigest()
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[0] is None and out[1] == "" and out[2] == "<EMAIL> and <EMAIL>, <IP>"
    assert pii.redact(df.limit(0)).count() == 0 and pii.find_pii(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").select("doc_id", F.col("text")).collect()}
    rows = queries.op5_pii_deobfuscation(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute(docs[r.doc_id])
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in PATTERNS]
        assert set(joined) <= set(r.spans.split(",")) or not joined
