import zlib

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import langid, queries
from threadloom.llm.svm import linear_svm

WORDS = {
    "en": "the and of with this that have from which would their there about where",
    "de": "der die und nicht eine schön über auch werden können gegen zwischen",
    "es": "el los que para como más pero también años había señor mañana",
    "fr": "le les des pour être avec très où déjà même aussi français",
}


def _rows():
    rng = np.random.default_rng(1)
    return [(i, " ".join(rng.choice(WORDS[lang].split(), 12)), lang, "s") for i, lang in enumerate(sorted(WORDS) * 60)]


def test_svm():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 20))
    y = np.sign(x[:, 0] * 2 - x[:, 3] + 0.3)
    w, b = linear_svm(x, y)
    assert np.mean(np.sign(x @ w + b) == y) > 0.97
    assert linear_svm(x, np.ones(300))[1] > 0


def test_languages_and_defined_results(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.train(df, per_language=40)
    assert model.families == ["germanic", "romance"]
    more = [(1000, None), (1001, ""), (1002, "123 !?"), (1003, "x"), (1004, "Ж"), (1005, "der " * 200_000), (None, "los señor"), (7, rows[7][1]), (7, rows[7][1])]
    test = spark.createDataFrame([r[:2] for r in rows] + more, "doc_id long, text string").withColumn("score", F.lit("x"))
    got = langid.predict(test, model).collect()
    assert len(got) == len(rows) + len(more)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].lang_pred == lang for i, _, lang, _ in rows]) > 0.99
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred in WORDS and by[1004].lang_pred in WORDS and by[1005].lang_pred == "de" and by[None].lang_pred == "es"
    assert all(0 <= r.score <= 1 for r in got)
    # a text's scores don't depend on its neighbours
    alone = langid.predict(test.where("doc_id = 5"), model).head()
    assert abs(alone.score - by[5].score) < 1e-6
    assert langid.train(df.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(df.limit(3), None).collect()} == {"und"}
    assert {r.lang_pred for r in langid.predict(df, langid.train(df.where("lang = 'de'"))).collect()} == {"de"}


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.doc_id: r.lang for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op4_language_id(spark, sf).collect()
    assert len(got) == len(want)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == want[r.doc_id] for r in got if r.held_out]) > 0.95
