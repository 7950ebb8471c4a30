import os
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import pii, queries, toxicity

sys.path.insert(0, os.path.dirname(__file__))
from test_jaccard import brute as components  # noqa: E402
from test_pii import brute as base_pii  # noqa: E402
from test_tokens_packing import _check_packing  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf, out = "/root/testdata/sf0.001", []
    docs = queries.table(spark, sf, "documents")
    at = tmp_path_factory.mktemp("stages")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{at}/{i}")
        out.append((docs.collect(), spark.read.parquet(f"{at}/{i}").collect()))
        docs = spark.read.parquet(f"{at}/{i}")
    return out


def test_each_stage_on_its_input(spark, stages):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "pii", "packing"]
    docs = queries.table(spark, sf, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, queries.table(spark, sf, "labels"))).collect()
    before, after = stages[0]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in scored if not r.predicted)
    assert set(after) <= set(before)

    before, after = stages[1]
    groups = {}
    for d, _, c in components([(r.doc_id, r.text) for r in before], 5, 80):
        groups.setdefault(c, set()).add(int(d))
    assert sorted(r.doc_id for r in after) == sorted(min(g) for g in groups.values())

    before, after = stages[2]
    fold = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.casefold()).split())
    items = [fold(r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not any(f" {b} " in f" {fold(r.text)} " for b in items)}

    before, after = stages[3]
    old = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        assert not base_pii(r.text) and r.n_chars == len(r.text)
        assert r.text == pii.redacted(old[r.doc_id], pii.find_all(old[r.doc_id])[1])

    before, after = stages[4]
    _check_packing(after, [(r.doc_id, r.text) for r in before], Tokenizer.from_file(queries.tokenizer_path()), 1024)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, "b"), (None, "some words are here and more of them", "en", "s", 1, "c"), (4, "some words are here and more of them", None, "s", 1, "d"), (4, "a text of its own for the same id", "en", "s", 5, "e"), (4, "a text of its own for the same id", "en", "s", 5, "e")]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        kept = docs.collect()
        assert len(kept) == (4 if some else 0)
        pieces = corpus_pipeline.pack_sequences(spark, docs, "").collect()
        assert {p.doc_id for p in pieces} == {r.doc_id for r in kept}


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.agg(F.sum("length")).head()[0] == sum(r.length for r in stages[-1][1])
