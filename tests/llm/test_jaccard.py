import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom.llm import components, jaccard, queries


def shingles(text, k):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, pct):
    """Components over all pairs of rows, by union-find."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        seen = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    seen[j] = seen.get(j, 0) + 1
        for j, n in seen.items():
            if 100 * n >= pct * (len(s) + len(sets[j]) - n):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((str(d), len(sets[i]), str(least.get(top(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows)))


def got(df, k, pct):
    return sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.jaccard_components(df, k, pct).collect())


@pytest.mark.parametrize("k,pct", [(4, 85), (5, 80), (1, 60)])
def test_against_all_pairs(spark, k, pct):
    rnd = random.Random(k)
    vocab = [f"w{i}" for i in range(400)]
    common = [rnd.choice(vocab) for _ in range(60)]
    rows, d = [], 0
    for _ in range(30):
        base = [rnd.choice(vocab[: rnd.choice([5, 400])]) for _ in range(rnd.randint(1, 120))]
        if rnd.random() < 0.4:
            base = base[:5] + common + base[5:12]
        for _ in range(rnd.choice([1, 1, 2, 9])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            if rnd.random() < 0.3:
                copy = copy[: max(1, len(copy) - rnd.randint(0, 8))]
            rows.append((d, (" " if rnd.random() < 0.9 else "\t\n").join(copy)))
            d += 1
    rows += [(d, None), (d + 1, ""), (d + 2, " \n"), (5, "another text under a known id here"), rows[7], (None, rows[3][1]), (None, "alone without an id at all"), (d + 3, "A b É"), (d + 4, "a B É"), (d + 5, "long " * 30000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("x")).repartition(6)
    assert got(df, k, pct) == brute(rows, k, pct)


def test_large_families_of_near_copies(spark, monkeypatch):
    rnd = random.Random(9)
    monkeypatch.setattr(jaccard, "TILE", 32)
    rows = []
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(70)]
        for _ in range(60):
            copy = list(base)
            for _ in range(rnd.randint(1, 4)):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(500)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, " ".join(f"f0w{j}" for j in range(30)) + f" y{i} z{i} q{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, 4, 85) == brute(rows, 4, 85)


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(df).count() == 0


def test_query_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").collect()]
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in queries.op6_ngram_jaccard(spark, sf_dir).collect())
    assert found == brute(rows, 4, 85)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randint(100, 400), rnd.randint(100, 400)) for _ in range(180)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    want = {x: top(x) for e in edges if e[0] != e[1] for x in e}
    assert {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
