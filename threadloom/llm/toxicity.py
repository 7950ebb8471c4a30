"""Toxicity: a subsequence string kernel, Nyström landmarks, a linear SVM.

The kernel compares words by their subsequences of three characters, word ends
included, within WINDOW characters; each character skipped costs a factor DECAY.
So a word with letters put in or left out stays near the word it disguises.
Hyphens and the like inside words are dropped, single letters in a row are one
word, and digits count as the letters they look like.

Landmarks are words of the labelled sample: those most telling by their log-odds
that aren't near each other. A text's features are, for each landmark, the
largest kernel value over its words and the damped sum of those values, both
whitened by the landmarks' own kernel matrix (Nyström). A linear support vector
machine with a logistic on held-apart decisions gives the score.

Training takes at most ``sample_rows`` labelled rows, those of smallest hash: the
documented bound of all that comes to the driver (a few hundred words with
counts, and FEATURES floats for each row). Scoring is one map over the table;
each worker keeps the kernel values of words that it has seen, up to a bound.

Defined results: null and empty texts have the score of a text without words
near a landmark. One row out for each row in, null and repeated ids included;
null labels teach nothing. Without labelled rows of both kinds every score is
the share of toxic rows (0 if there are none). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm._arrow import bounded_batches, give_back, slices, span_hashes, text_buffers
from threadloom.llm._fold import folded
from threadloom.llm.svm import linear_svm

WINDOW, DECAY = 5, 0.6
LANDMARKS = 64
#: Words whose largest kernel value is lower have none.
NEAR = 0.4
#: Words that a worker keeps kernel values of, and words it knows to have none.
KEPT = 400_000
_LONGEST = 48
_STEPS = [(j, k) for k in range(2, WINDOW) for j in range(1, k)]


def _symbols() -> np.ndarray:
    """Six-bit symbols of bytes; 0 is no part of a word, 1 is dropped in words."""
    out = np.zeros(256, np.uint8)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        out[ord(c)] = out[ord(c) - 32] = 4 + i
    for digit, letter in zip("0123456789", "oizeasgtbg"):
        out[ord(digit)] = out[ord(letter)]
    out[128:] = 30 + np.arange(128) % 34
    out[[ord(c) for c in "-_*~^"]] = 1
    return out


_SYMBOL = _symbols()
_BEGIN, _END = 2, 3


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words one after another, the words' starts (and the end),
    and each word's text."""
    symbol = _SYMBOL[folded(data)]
    part = symbol > 1
    gap = symbol == 0
    at = np.flatnonzero(part)
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64)
    chars = symbol[at]
    breaks = np.cumsum(gap)
    new = np.ones(len(at), bool)
    new[1:] = breaks[at[1:]] != breaks[at[:-1]]
    first = np.searchsorted(at, offs[:-1])
    new[first[first < len(at)]] = True
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(at)))
    text = np.searchsorted(offs, at[starts], side="right") - 1
    # at least four single letters in a row are one word
    single = (size == 1) & (chars[starts] < 30)
    joined = single.copy()
    joined[1:] &= single[:-1] & (text[1:] == text[:-1])
    joined[0] = False
    run = np.flatnonzero(np.diff(np.concatenate([[0], joined.astype(np.int8), [0]])))
    for a, b in zip(run[::2], run[1::2]):
        if b - a < 3:
            joined[a:b] = False
    starts, text = starts[~joined], text[~joined]
    # cut the longest: pieces of a very long word are words of their own
    size = np.diff(np.append(starts, len(at)))
    if (size > _LONGEST).any():
        many = -(-size // _LONGEST)
        rep = np.repeat(np.arange(len(size)), many)
        starts = starts[rep] + _LONGEST * (np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many))
        text = text[rep]
    return chars, np.append(starts, len(at)), text


def _subsequences(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, weight) of each subsequence, by word."""
    size = ends - starts + 2
    word = np.repeat(np.arange(len(size)), size)
    begin = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.uint8)
    flat[begin], flat[begin + size - 1] = _BEGIN, _END
    inner = np.ones(len(flat), bool)
    inner[begin] = inner[begin + size - 1] = False
    flat[inner] = chars[np.repeat(starts - np.cumsum(ends - starts) + (ends - starts), ends - starts) + np.arange(int((ends - starts).sum()))]
    last = np.repeat(begin + size, size)
    flat = np.concatenate([flat, np.zeros(WINDOW, np.uint8)]).astype(np.int32)
    n = len(word)
    pos = np.arange(n)
    code = np.empty((n, len(_STEPS)), np.int32)
    fits = np.empty((n, len(_STEPS)), bool)
    for c, (j, k) in enumerate(_STEPS):
        code[:, c] = flat[:n] << 12 | flat[j : n + j] << 6 | flat[k : n + k]
        fits[:, c] = pos + k < last
    weight = np.broadcast_to(np.array([DECAY ** (k - 2) for _, k in _STEPS]), code.shape)
    return np.repeat(word, len(_STEPS))[fits.ravel()], code[fits], weight[fits]


def _squares(word: np.ndarray, code: np.ndarray, weight: np.ndarray, count: int) -> np.ndarray:
    """Each word's kernel value with itself."""
    key = word.astype(np.int64) << 18 | code
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(weight, new) if len(new) else np.zeros(0)
    return np.bincount(key[new] >> 18, weights=total**2, minlength=count)


class Kernel:
    """Kernel values of words with fixed landmarks (arrays of symbols)."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        chars = np.frombuffer(b"".join(landmarks), np.uint8)
        ends = np.cumsum([len(x) for x in landmarks], dtype=np.int64)
        word, code, weight = _subsequences(chars, ends - np.array([len(x) for x in landmarks]), ends)
        norm = np.sqrt(_squares(word, code, weight, len(landmarks)))
        codes, which = np.unique(code, return_inverse=True)
        self._row = np.full(1 << 18, -1, np.int32)
        self._row[codes] = np.arange(len(codes))
        self._of = np.zeros((len(codes), len(landmarks)), np.float32)
        np.add.at(self._of, (which, word), weight / norm[word])
        self._clear()
        self.gram = self.values(chars, np.concatenate([[0], ends]))

    def _clear(self) -> None:
        self._keys, self._place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self._kept = [np.zeros((1, len(self.landmarks)), np.float32)]  # row 0: no value
        self._rows = 1

    def values(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Normalised kernel values: a row for each word."""
        out = np.zeros((len(starts) - 1, len(self.landmarks)), np.float32)
        for a in range(0, len(out), 4096):
            b = min(a + 4096, len(out))
            word, code, weight = _subsequences(chars, starts[a:b], starts[a + 1 : b + 1])
            row = self._row[code]
            hit = np.flatnonzero(row >= 0)
            # most words share too little with any landmark to matter
            own = np.bincount(word[hit], weights=weight[hit], minlength=b - a)
            all_ = np.bincount(word, weights=weight, minlength=b - a)
            some = own >= 0.25 * all_
            hit = hit[some[word[hit]]]
            if not len(hit):
                continue
            first = np.flatnonzero(np.concatenate([[True], word[hit][1:] != word[hit][:-1]]))
            sums = np.add.reduceat(self._of[row[hit]] * weight[hit, None].astype(np.float32), first)
            which = word[hit][first]
            inside = some[word]
            norm = np.sqrt(_squares(word[inside], code[inside], weight[inside], b - a))
            out[a + which] = sums / norm[which, None]
        return out

    def look_up(self, chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, values): for each word a row of ``values``; place 0: none."""
        hashes = span_hashes(chars, starts[:-1], starts[1:])
        keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._keys) > KEPT or self._rows > KEPT // 8:
            self._clear()
        i = np.searchsorted(self._keys, keys)
        known = self._keys[np.minimum(i, len(self._keys) - 1)] == keys if len(self._keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        if len(new):
            a, b = starts[:-1][where[new]], starts[1:][where[new]]
            flat_starts = np.concatenate([[0], np.cumsum(b - a)])
            flat = chars[np.repeat(a - flat_starts[:-1], b - a) + np.arange(flat_starts[-1])]
            got = self.values(flat, flat_starts)
            near = got.max(axis=1) >= NEAR
            place = np.zeros(len(new), np.int32)
            place[near] = self._rows + np.arange(int(near.sum()))
            self._kept.append(got[near])
            self._rows += int(near.sum())
            self._keys = np.insert(self._keys, i[new], keys[new])
            self._place = np.insert(self._place, i[new], place)
            i = np.searchsorted(self._keys, keys)
        if len(self._kept) > 1:
            self._kept = [np.concatenate(self._kept)]
        return self._place[i][inverse], self._kept[0]


def _whitener(gram: np.ndarray) -> np.ndarray:
    value, vector = np.linalg.eigh((gram + gram.T) / 2 + 1e-3 * np.eye(len(gram)))
    return vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T


def features(kernel: Kernel, white: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each text: largest values and damped sums by landmark, whitened."""
    count, size = len(offs) - 1, len(kernel.landmarks)
    most, total = np.zeros((count, size), np.float32), np.zeros((count, size), np.float32)
    chars, starts, text = words(data, offs)
    if len(text):
        place, kept = kernel.look_up(chars, starts)
        at = np.flatnonzero(place)
        if len(at):
            value, of = kept[place[at]], text[at]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            most[of[first]] = np.maximum.reduceat(value, first)
            total[of[first]] = np.log1p(np.add.reduceat(value**4, first))
    return np.concatenate([most @ white, total @ white], axis=1)


class Model:
    def __init__(self, landmarks: list[bytes], w: np.ndarray, b: float, slope: float, shift: float):
        self.landmarks, self.w, self.b, self.slope, self.shift = landmarks, w, b, slope, shift

    def score(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -50, 50)))


def _logistic(decision: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic on decisions, by Newton steps."""
    slope, shift = 1.0, 0.0
    p1, p0 = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (p1 + 1) / (p1 + 2), 1 / (p0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * decision + shift, -50, 50)))
        g = np.array([((p - goal) * decision).sum() + 1e-3 * slope, (p - goal).sum()])
        v = p * (1 - p) + 1e-6
        h = np.array([[(v * decision**2).sum() + 1e-3, (v * decision).sum()], [(v * decision).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - np.clip(step[0], -1, 1), shift - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(slope), 0.0), float(shift)


def _choose(counts: list[tuple[bytes, int, int]], positive: int, negative: int) -> list[bytes]:
    """Landmarks among (word, toxic rows, other rows): by log-odds, most telling
    first, none near another."""
    odds = lambda p, n: np.log((p + 0.5) / (positive + 1)) - np.log((n + 0.5) / (negative + 1))
    order = sorted(counts, key=lambda c: (-odds(c[1], c[2]) * np.sqrt(c[1]), c[0]))[: 12 * LANDMARKS]
    chosen: list[bytes] = []
    if not order:
        return chosen
    gram = Kernel([w for w, _, _ in order]).gram
    taken: list[int] = []
    for i in range(len(order)):
        if len(taken) == LANDMARKS:
            break
        if not taken or gram[i, taken].max() < 0.75:
            taken.append(i)
    return [order[i][0] for i in taken]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | float:
    """A model from at most ``sample_rows`` labelled rows, or the share of toxic
    rows if it can't be learned."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    ids = known.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    sample = docs.select(id_col, text_col).dropna().join(F.broadcast(ids), id_col).select("y", F.col(text_col).alias("text"))

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_buffers(batch.column(1))
            for a, b in slices(offs):
                chars, starts, text = words(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                whole = chars.tobytes()
                seen = sorted({(t, whole[x:y]) for t, x, y in zip(text.tolist(), starts[:-1].tolist(), starts[1:].tolist()) if y - x >= 3})
                y = batch.column(0).slice(a, b - a).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([w for _, w in seen], pa.binary()), pa.array([y[t] for t, _ in seen], pa.int32())], names=["word", "y"])

    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    positive, negative = n.get(1, 0), n.get(0, 0)
    if not positive or not negative:
        return float(positive > 0)
    counts = sample.mapInArrow(telling, "word binary, y int").groupBy("word").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    ratio = F.log((F.col("p") + 0.5) / (positive + 1)) - F.log((F.col("n") + 0.5) / (negative + 1))
    found = counts.where("p >= 3").orderBy((ratio * F.sqrt("p")).desc(), "word").limit(40 * LANDMARKS).collect()
    landmarks = _choose([(bytes(r.word), r.p, r.n) for r in found], positive, negative)
    if not landmarks:
        return positive / (positive + negative)
    shared = docs.sparkSession.sparkContext.broadcast(landmarks)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(shared.value)
        white = _whitener(kernel.gram)
        for batch in batches:
            raw, offs = text_buffers(batch.column(1))
            for a, b in slices(offs):
                x = features(kernel, white, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    got = sorted((bytes(r.x), r.y) for r in sample.mapInArrow(measured, "y int, x binary").collect())
    x, y = np.array([np.frombuffer(v, np.float32) for v, _ in got]), np.array([2.0 * t - 1 for _, t in got])
    decision = np.zeros(len(y))
    fold = np.random.default_rng(1).integers(0, 3, len(y))
    for k in range(3):
        w, b = linear_svm(x[fold != k], y[fold != k], c=1.0, rounds=20)
        decision[fold == k] = x[fold == k] @ w + b
    slope, shift = _logistic(decision, (y > 0).astype(float))
    w, b = linear_svm(x, y, c=1.0, rounds=20)
    return Model(landmarks, w, b, slope, shift)


def score(df: DataFrame, model: Model | float, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, score, predicted) for each row, or ``keep`` columns and these."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [id_col] if keep is None else keep
    held: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if isinstance(model, Model) and "kernel" not in held:
            held["kernel"] = Kernel(model.landmarks)
            held["white"] = _whitener(held["kernel"].gram)
        for batch in batches:
            got = _scores(model, held, batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=[*batch.schema.names[1:], "score", "predicted"])

    kept = ", ".join(f"`__k{i}` {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    rows = df.select(F.col(text_col).alias("__text"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)])
    out = bounded_batches(rows).mapInArrow(run, f"{kept}, score double, predicted int")
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "score", "predicted")


def keep_clean(df: DataFrame, model: Model | float, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose score is below ``threshold``, all columns as they are."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    held: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if isinstance(model, Model) and "kernel" not in held:
            held["kernel"] = Kernel(model.landmarks)
            held["white"] = _whitener(held["kernel"].gram)
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, held, batch.column(batch.schema.get_field_index(text_col))) < threshold))
            give_back()

    return bounded_batches(df).mapInArrow(run, df.schema)


def _scores(model: Model | float, held: dict, column) -> np.ndarray:
    raw, offs = text_buffers(column)
    out = np.full(len(offs) - 1, model if not isinstance(model, Model) else 0.0)
    if isinstance(model, Model):
        for a, b in slices(offs):
            x = features(held["kernel"], held["white"], raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            out[a:b] = model.score(x @ model.w + model.b)
    return out
