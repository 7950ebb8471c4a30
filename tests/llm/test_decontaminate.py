import re

from pyspark.sql import functions as F

from threadloom.llm import decontaminate as D
from threadloom.llm import queries

ITEMS = [
    (1, "Alice has 5 apples and gives 2 apples to Bob before Alice walks 3 km home."),
    (2, "Was ist die Größe von Éclair auf dem Tisch?"),
    (3, "two words"),
    (4, ""),
    (5, None),
    (6, "Alice has 5 apples and gives 2 apples to Bob before Alice walks 3 km home."),
]


def run(spark, docs, items=ITEMS, **kw):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    items = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (round(r.share, 2), r.changed) for r in D.decontaminate(docs, items, **kw).collect()}


def test_templates_and_slots(spark):
    docs = [
        (10, "x y z Alice has 5 apples and gives 2 apples to Bob before Alice walks 3 km home. and on"),
        (11, "so Carol has 17 apples and gives 4.5 apples to Dave before Carol walks 900 miles home, then"),
        (12, "so Carol has 17 apples and gives 4 apples to Dave before Erin walks 9 km home."),
        (13, "ALICE HAS 5 APPLES AND GIVES 2 APPLES TO BOB BEFORE ALICE WALKS 3 KM HOME!!"),
        (14, "Alice has 5 apples and gives 2 apples"),
        (15, "WAS IST DIE GRÖSSE VON ÉCLAIR AUF DEM TISCH %%%"),
        (16, None), (17, ""), (None, "these two words here"), (18, "Was ist die größe von Éclair auf dem Tisch " * 3),
        (19, "word " * 300_000 + ITEMS[1][1] + " word" * 1000),
    ]
    got = run(spark, docs)
    assert got[10, 1] == got[10, 6] == (1.0, False)
    assert got[11, 1] == (1.0, True)
    assert (12, 1) not in got  # one name has become two
    assert got[13, 1][1] is False and (14, 1) not in got
    assert got[18, 2] == got[19, 2] == (1.0, False)
    assert got[None, 3] == (1.0, False)
    assert {d for d, _ in got} == {10, 11, 13, 18, 19, None} | ({15} if (15, 2) in got else set())


def test_equal_values_and_longer_names(spark):
    docs = [
        (20, "so Alice has 7 apples and gives 3 apples to Bob before Alice walks 3 km home, then"),
        (21, "so Mary Ann has 7 apples and gives 3 apples to Bob before Mary Ann walks 3 km home, then"),
        (22, "so Mary Ann has 7 apples and gives 3 apples to Bob before Mary Jo walks 3 km home, then"),
        (23, "Then Alice has 5 apples and gives 2 apples to Bob before Alice walks 3 km home."),
        (24, "Otto Meier told Mary Ann"),
    ]
    names = [(7, "Alice Smith"), (8, "Mary Ann Meier has 4 cats and Mary Ann Meier has 5 dogs")]
    more = [(25, "Ina has 3 cats and Ina has 3 dogs")]
    got = run(spark, docs + more, ITEMS[:1] + names)
    assert got[20, 1] == got[21, 1] == (1.0, True) and got[23, 1] == (1.0, False)
    assert (22, 1) not in got and got[25, 8] == (1.0, True)


def test_blocks_and_nothing(spark, monkeypatch):
    docs = [(1, ITEMS[0][1]), (2, ITEMS[1][1])]
    monkeypatch.setattr(D, "BLOCK_WORDS", 8)
    assert set(run(spark, docs)) == {(1, 1), (1, 6), (2, 2)}
    assert run(spark, docs, items=[]) == {} and run(spark, []) == {}


def test_query_finds_the_planted_passages(spark, sf_dir):
    fold = lambda t: " ".join(re.findall(r"\w+", t.casefold()))
    docs = [(r.doc_id, fold(r.text)) for r in queries.table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, fold(r.text)) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    whole = {(d, i) for d, t in docs for i, b in items if f" {b} " in f" {t} "}
    got = queries.op10_decontamination(spark, sf_dir).collect()
    assert whole <= {(r.doc_id, r.item_id) for r in got}
    five = lambda t: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)}
    docs, items = dict(docs), dict(items)
    for r in got:
        b = five(items[r.item_id])
        assert r.changed or len(b & five(docs[r.doc_id])) >= 0.6 * len(b)
