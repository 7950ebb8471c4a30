"""Language identification by hierarchical discrimination.

A language's family is predicted first, by one linear support vector machine for
each family; within the family, one-versus-one linear machines between its
languages vote. Features are hashed byte n-grams (one to three bytes of the
case-folded text), counted over the whole text and divided by their number, so
all machines are one table lookup for each position, summed with numpy.

Training takes a bounded sample: for each language the ``per_language`` rows of
smallest hash, with features of BUCKETS floats each. Its bound, languages times
``per_language`` times BUCKETS, is what the driver holds.

Defined results: ``und`` with score 0 where a text is null, empty or has no
letter. If nothing can be learned (no labelled row), every text is ``und``; with
one language, all texts with letters are that. One row out for each row in, null
and repeated ids included; null labels teach nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm._arrow import bounded_batches, slices, text_buffers
from threadloom.llm._fold import folded
from threadloom.llm.svm import linear_svm

BUCKETS = 4096
#: Families of languages (fixed values); a language not listed is its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy yi lb".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
    "indo_aryan": "hi bn ur mr gu pa ne".split(),
    "semitic": "ar he mt am".split(),
    "celtic": "ga cy br gd".split(),
    "baltic": "lt lv".split(),
}
_FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


def _buckets(data: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams that begin at each byte: three rows. Across a
    text's end the last ones read into the next; they are few and the same
    offsets are left out by ``_scores``."""
    low = folded(data).astype(np.uint32)
    low[data < 65] = 32  # marks, digits and white space alike
    n = len(low)
    two, three = low.copy(), low.copy()
    two[: n - 1] |= low[1:] << 8
    three[: n - 2] |= low[1 : n - 1] << 8 | low[2:] << 16
    out = np.empty((3, n), np.int32)
    for row, (code, seed) in enumerate(((low, 1), (two, 2), (three, 3))):
        out[row] = (code * np.uint32(2654435761) + np.uint32(seed * 0x9E3779B1 % (1 << 32))) >> np.uint32(20)
    return out


def _features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Shares of the buckets among each text's n-grams."""
    out = np.zeros((len(offs) - 1, BUCKETS), np.float32)
    for i, (a, b) in enumerate(zip(offs, offs[1:])):
        if b > a:
            rows = _buckets(data[a:b])
            all_ = np.concatenate([rows[k, : max(0, b - a - k)] for k in range(3)])
            out[i] = np.bincount(all_, minlength=BUCKETS) / len(all_)
    return out


class Model:
    def __init__(self, labels: list[str], features: np.ndarray):
        self.langs = sorted(set(labels))
        families = [family(x) for x in labels]
        self.families = sorted(set(families))
        y = np.array(labels)
        f = np.array(families)
        tables, bias = [], []
        self.within: dict[str, list[tuple[str, str, int]]] = {}

        def fit(rows: np.ndarray, positive: np.ndarray) -> int:
            w, b = linear_svm(features[rows], np.where(positive, 1.0, -1.0))
            tables.append(w)
            bias.append(b)
            return len(tables) - 1

        everything = np.arange(len(y))
        self.of_family = [fit(everything, f == name) for name in self.families] if len(self.families) > 1 else []
        for name in self.families:
            own = sorted({a for a, b in zip(labels, families) if b == name})
            pairs = []
            for a, b in combinations(own, 2):
                rows = np.flatnonzero((y == a) | (y == b))
                pairs.append((a, b, fit(rows, y[rows] == a)))
            self.within[name] = pairs
        self.only = {name: [x for x in self.langs if family(x) == name] for name in self.families}
        self.table = np.array(tables, np.float32).T.copy() if tables else np.zeros((BUCKETS, 0), np.float32)
        self.bias = np.array(bias)

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Every machine's value for each text: a row for each text."""
        out = np.zeros((len(offs) - 1, self.table.shape[1]))
        n = np.diff(offs)
        total = np.maximum(3 * n - np.minimum(n, 1) - np.minimum(n, 2), 1)
        if len(data) and self.table.shape[1]:
            rows = _buckets(data)
            starts = offs[:-1][n > 0]
            for t in range(self.table.shape[1]):
                w = np.ascontiguousarray(self.table[:, t])
                value = np.zeros(len(data))
                for k in range(3):
                    part = w[rows[k]]
                    for j in range(1, k + 1):  # n-grams that would leave their text
                        part[np.maximum(offs[1:] - j, 0)[n >= j]] = 0
                    value += part
                out[n > 0, t] = np.add.reduceat(value, starts)
        return out / total[:, None] + self.bias

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        s = self.scores(data, offs)
        count = len(offs) - 1
        chosen = s[:, self.of_family].argmax(axis=1) if self.of_family else np.zeros(count, int)
        sure = np.ones(count)
        if self.of_family:
            top = np.sort(s[:, self.of_family], axis=1)
            sure = 1 / (1 + np.exp(np.clip(-(top[:, -1] - top[:, -2]), -50, 50)))
        langs = []
        for i in range(count):
            name = self.families[chosen[i]]
            votes = dict.fromkeys(self.only[name], 0)
            margin = dict.fromkeys(self.only[name], 0.0)
            for a, b, t in self.within[name]:
                v = s[i, t]
                votes[a if v >= 0 else b] += 1
                margin[a] += v
                margin[b] -= v
            best = max(self.only[name], key=lambda x: (votes[x], margin[x]))
            langs.append(best)
            if self.within[name]:
                least = min((v if a == best else -v) for a, b, t in self.within[name] if best in (a, b) for v in [s[i, t]])
                sure[i] *= 1 / (1 + np.exp(np.clip(-2 * least, -50, 50)))
        return langs, sure


def _lettered(texts: list[str], raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    plain = np.concatenate([[0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122))])
    has = plain[offs[1:]] > plain[offs[:-1]]
    for i in np.flatnonzero(~has & (np.diff(offs) > 0)):
        has[i] = any(c.isalpha() for c in raw[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return has


def train(labelled: DataFrame, per_language: int = 400, sample_rows: int = 8_000, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from a bounded sample of ``labelled``: of each language the
    ``per_language`` different texts of smallest hash, or fewer where there are so
    many languages that these were more than ``sample_rows`` (one each at least).
    None if there are no rows. Copies of a text count once."""
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # the share of hashes to look at comes from a partial aggregate, so that no
    # language, however large, is ranked whole in one task
    many = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("d")).withColumn("langs", F.count("*").over(Window.partitionBy()))
    each = F.greatest(F.lit(1), F.least(F.lit(per_language), F.floor(F.lit(sample_rows) / F.col("langs"))))
    share = F.least(F.lit(1.0), 2 * (each + 32) / F.col("d"))
    # a row for each language: there are fewer than the model has pairs of them
    cut = many.select("lang", each.alias("each"), (share * 2.0**63).alias("below"))
    some = rows.join(F.broadcast(cut), "lang").where(F.abs(F.col("h").cast("double")) <= F.col("below"))
    one = some.groupBy("lang", "h", "each").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_buffers(batch.column(1))
            got = _features(raw[offs[0] :] if len(offs) else raw, offs - offs[0]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in got], pa.binary())], names=["lang", "x"])

    order = Window.partitionBy("lang").orderBy("h")
    sample = one.withColumn("n", F.row_number().over(order)).where(F.col("n") <= F.col("each")).select("lang", "text")
    got = sample.mapInArrow(run, "lang string, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.lang, bytes(r.x)))
    return Model([r.lang for r in got], np.array([np.frombuffer(r.x, np.float16) for r in got], np.float32))


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw, offs = text_buffers(batch.column(1))
            for a, b in slices(offs):
                data, local = raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                has = _lettered([], data, local)
                langs, sure = model.predict(data, local) if model else ([""] * (b - a), np.zeros(b - a))
                has &= model is not None
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x if h else "und" for x, h in zip(langs, has)], pa.string()), pa.array(np.where(has, sure, 0.0))], names=["id", "lang_pred", "score"])

    return bounded_batches(df.select(id_col, text_col)).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
