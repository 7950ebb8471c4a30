import zlib

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import queries, toxicity

GOOD = "river mountain table letter window garden paper music morning bridge silver orange tidy clever modern".split()
BAD = "idiot moron worthless".split()


def _symbols(word):
    return toxicity._SYMBOL[np.frombuffer(word.encode(), np.uint8)].tobytes()


def brute(a, b):
    """The kernel of two words by all their subsequences."""

    def vector(w):
        s = bytes([toxicity._BEGIN]) + _symbols(w) + bytes([toxicity._END])
        out = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.WINDOW)):
                    u = (s[i], s[j], s[k])
                    out[u] = out.get(u, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    x, y = vector(a), vector(b)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def test_kernel_against_all_subsequences():
    words = ["idiot", "idxiot", "iddiot", "idiocy", "moron", "aaaa", "banana", "x"]
    kernel = toxicity.Kernel([_symbols(w) for w in ("idiot", "banana", "moron")])
    flat = b"".join(map(_symbols, words))
    got = kernel.values(np.frombuffer(flat, np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]))
    for i, w in enumerate(words):
        for j, landmark in enumerate(("idiot", "banana", "moron")):
            assert abs(got[i, j] - brute(w, landmark)) < 1e-5 or got[i, j] == 0 and brute(w, landmark) < 0.5


def test_learns_tolerates_insertions_and_defined_results(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        toxic = int(i % 4 == 0)
        words = list(rng.choice(GOOD, 12)) + (list(rng.choice(BAD, 2)) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    cases = {
        1: ("You idiot, worthless moron", 1), 2: ("you id-iot, w.o.r.t.h.l.e.s.s m o r o n", 1), 3: ("an iddiot and a mooron, a worthlesss one", 1), 4: ("1d10t m0r0n worthles5", 1),
        5: ("river garden music", 0), 6: (None, 0), 7: ("", 0), 8: ("!!", 0), 9: ("river " * 200_000, 0), 10: ("x" * 300_000, 0), 11: ("river " * 100_000 + "idiot moron worthless " + "paper " * 1000, 1),
    }
    test = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()] + [(5, "river garden music"), (None, "paper")], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = toxicity.score(test, model).collect()
    assert len(got) == len(cases) + 2 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert {k: by[k].predicted for k in cases} == {k: y for k, (_, y) in cases.items()}
    assert toxicity.score(test.limit(0), model).count() == 0
    none = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("toxic = 0"))
    assert {r.score for r in toxicity.score(test, none).collect()} == {0.0}


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    want = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect()}
    got = queries.op3_toxicity(spark, sf).collect()
    assert len(got) == queries.table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.predicted, want[r.doc_id]) for r in got if r.held_out and r.doc_id in want]
    assert np.mean([p == y for p, y in held]) > 0.96
    assert np.mean([y for p, y in held if p]) > 0.95
