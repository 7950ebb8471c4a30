"""Benchmark decontamination by template canonicalisation.

Words are case-folded runs of letters and digits (marks between digits belong
to a number). A template replaces what a re-parameterised question changes by
typed placeholders: numbers, units after a number, and names. Windows of five
words are hashed twice: with names as they are, and, where a window has a
capitalised word, with those as name placeholders. Documents' windows are
looked up in the benchmark's hash table; a document never moves, only its few
matches leave the task.

For a document and an item with matches, slots are then checked: the values in
an item's slots must each map to one of the document's (a name that stands twice
in the item is one name in the document, and so on; two values of the item may
have become the same). Windows whose slots contradict
another slot of the same alignment, or the mapping of a longer alignment, don't
count. The item is found in the document if at least ``share`` of its windows
are matched consistently. An item not found so is looked for once more with each
run of names as one name in both texts, if it has a whole window then.

The benchmark goes to the tasks in blocks of at most BLOCK_WORDS words, one pass
over the documents for each, so what is broadcast has a fixed bound.

Defined results: null, empty or wordless texts match nothing, and neither do
items without words. An item of fewer than five words is one window of its own
length. Repeated rows are found each for itself; null ids stay null. Repeated
items with different ids are found each. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm._arrow import bounded_batches, give_back, mix64, slices, span_hashes, text_buffers, written
from threadloom.llm._fold import folded

#: Words of units (fixed values).
UNITS = """
percent degrees celsius fahrenheit kelvin
mm cm m km mi inch inches foot feet yard yards mile miles meter meters metre metres
kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres
mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes
ml l liter liters litre litres gallon gallons cup cups
s sec min h hr second seconds minute minutes hour hours day days week weeks month months year years
dollar dollars cent cents euro euros usd eur
""".split()
BLOCK_WORDS = 2_000_000
_WORD, _NUMBER, _UNIT, _NAME = 0, 1, 2, 3
_FIXED = mix64(np.array([0, 11, 22, 33], np.uint64) + np.uint64(0x1234567))
_TABLE_BITS = 22


def _hash_words(items: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(items).encode(), np.uint8)
    ends = np.cumsum([len(x.encode()) for x in items])
    return span_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64))


_unit_hashes = np.sort(_hash_words(UNITS))
_digit = np.zeros(256, bool)
_digit[48:58] = True
_alnum = _digit.copy()
_alnum[65:91] = _alnum[97:123] = True
_alnum[128:] = True
_mark = np.zeros(256, bool)
_mark[[ord(c) for c in ".,:/"]] = True
_joins = np.zeros(256, bool)
_joins[[ord(c) for c in " -'"]] = True


class Words:
    """Words of a slice of texts: spans, hashes, kinds, and the first word of
    each text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        n = len(data)
        low = folded(data)
        inside = _alnum[data]
        if n > 2:
            digit = _digit[data]
            inside[1:-1] |= _mark[data[1:-1]] & digit[:-2] & digit[2:]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        end = np.zeros(n + 1, bool)
        end[1:] = inside
        end[:-1] &= ~inside
        edges = offs[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        start[edges], end[edges] = inside[edges], inside[edges - 1]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end)
        self.first = np.searchsorted(self.start, offs)
        self.hash = span_hashes(low, self.start, self.end)
        s = self.start
        self.kind = np.where(_digit[data[s]], _NUMBER, _WORD).astype(np.int8)
        after = np.zeros(len(s), bool)
        after[1:] = self.kind[:-1] == _NUMBER
        after[np.minimum(self.first[:-1], len(s) - 1)[self.first[:-1] < len(s)]] = False
        near = np.flatnonzero(after & (self.kind == _WORD))
        if len(near):
            spot = np.searchsorted(_unit_hashes, self.hash[near])
            self.kind[near[_unit_hashes[np.minimum(spot, len(_unit_hashes) - 1)] == self.hash[near]]] = _UNIT
        # a capital, then something that isn't one
        two = data[s] >= 0xC2
        at = lambda k: np.minimum(s + k, max(n - 1, 0))
        capital = (low[s] != data[s]) | (two & (low[at(1)] != data[at(1)]))
        second = np.where(two, at(2), at(1))
        shouted = (low[second] != data[second]) | ((data[second] >= 0xC2) & (low[np.minimum(second + 1, max(n - 1, 0))] != data[np.minimum(second + 1, max(n - 1, 0))]))
        long = self.end - s > np.where(two, 2, 1)
        self.kind[(self.kind == _WORD) & capital & long & ~shouted] = _NAME
        self._data, self._low = data, low

    def merged(self) -> Words:
        """The same words with each run of names as one name."""
        out, n = copy(self), len(self.start)
        inner = np.zeros(n, bool)
        inner[1:] = (self.kind[1:] == _NAME) & (self.kind[:-1] == _NAME) & (self.start[1:] == self.end[:-1] + 1)
        inner[1:] &= _joins[self._data[np.minimum(self.end[:-1], max(len(self._data) - 1, 0))]]
        inner[self.first[:-1][self.first[:-1] < n]] = False
        out.start, out.end, out.kind = self.start[~inner], self.end[np.append(~inner, True)[1:]], self.kind[~inner]
        out.first = np.concatenate([[0], np.cumsum(~inner)])[self.first]
        out.hash = span_hashes(self._low, out.start, out.end)
        return out

    def text(self, i: int) -> str:
        return self._data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace").casefold()

    def windows(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes of the windows of k words, and their first words: plain, then
        those with names as placeholders."""
        count = np.diff(self.first)
        many = np.maximum(count - k + 1, 0)
        at = np.repeat(self.first[:-1], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        plain = np.where((self.kind == _NUMBER) | (self.kind == _UNIT), _FIXED[self.kind], self.hash)
        yield self._combined(plain, at, k), at
        name = self.kind == _NAME
        if name.any():
            so_far = np.concatenate([[0], np.cumsum(name)])
            at = at[so_far[at + k] > so_far[at]]
            yield self._combined(np.where(name, _FIXED[_NAME], plain), at, k), at

    @staticmethod
    def _combined(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(at), k * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out += h[at + j] * np.uint64((2 * j + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))
        return mix64(out)


class Index:
    """Window hashes of some benchmark items; ``merged``: with runs of names as
    one, of those that have k words then."""

    def __init__(self, items: list[tuple[object, str]], k: int, merged: bool = False):
        raw, offs = text_buffers(pa.array([t for _, t in items], pa.string()))
        self.words, self.ids, self.k, self.merged = Words(raw, offs), [i for i, _ in items], k, merged
        if merged:
            self.words = self.words.merged()
        count = np.diff(self.words.first)
        self.lengths = sorted({min(k, int(c)) for c in count if c >= (k if merged else 1)})
        self.total = np.maximum(count - k + 1, np.minimum(count, 1))
        of = np.repeat(np.arange(len(items)), count)
        tables = []
        for size in self.lengths:
            for h, at in self.words.windows(size):
                keep = np.minimum(count[of[at]], k) == size  # short items have one window
                tables.append((h[keep], at[keep], of[at[keep]]))
        self.hash, self.at, self.item = (np.concatenate(x) for x in zip(*tables)) if tables else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.at, self.item = self.hash[order], self.at[order], self.item[order]
        self.filter = np.zeros(1 << _TABLE_BITS, bool)
        self.filter[(self.hash >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def matches(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(first word in the slice, first word in the index, length)."""
        for size in self.lengths:
            for h, at in words.windows(size):
                maybe = np.flatnonzero(self.filter[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
                lo = np.searchsorted(self.hash, h[maybe], side="left")
                hi = np.searchsorted(self.hash, h[maybe], side="right")
                for w, a, b in zip(at[maybe].tolist(), lo.tolist(), hi.tolist()):
                    for x in range(a, b):
                        yield w, int(self.at[x]), size

    def found(self, words: Words, pairs: list[tuple[int, int, int]], item: int) -> tuple[float, bool]:
        """The share of the item's windows matched with consistent slots, and
        whether some slot's value differs. Slots one to one come first, since then
        an alignment of chance takes no slots; the larger share counts."""
        return max((self._share(words, pairs, item, strict) for strict in (True, False)), key=lambda x: x[0])

    def _share(self, words: Words, pairs: list[tuple[int, int, int]], item: int, strict: bool) -> tuple[float, bool]:
        lines: dict[int, list] = defaultdict(list)  # matches on one alignment
        for w, x, size in pairs:
            own = [(int(self.words.kind[x + j]), self.words.text(x + j), words.text(w + j)) for j in range(size) if self.words.kind[x + j] != _WORD]
            lines[w - x].append((x, size, [(kind, a, b) for kind, a, b in own if kind != _UNIT or a != b]))
        to: dict = {}
        back: dict = {}
        kept, changed = set(), False
        for _, matched in sorted(lines.items(), key=lambda line: (-len(line[1]), line[0])):
            mapped = {slot for _, _, own in matched for slot in own}
            one_to, one_back = Counter((kind, a) for kind, a, _ in mapped), Counter((kind, b) for kind, _, b in mapped)
            for x, size, own in matched:
                single = not strict or all(one_back[kind, b] == 1 and back.get((kind, b), a) == a for kind, a, b in own)
                if single and all(one_to[kind, a] == 1 and to.get((kind, a), b) == b for kind, a, b in own):
                    kept.add((x, size))
                    changed |= any(a != b for _, a, b in own)
                    for kind, a, b in own:
                        to[kind, a], back[kind, b] = b, a
        return len(kept) / int(self.total[item]), changed


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, share, changed) for each document and item found in it;
    ``changed``: with other slot values."""
    out = None
    for items in _blocks(benchmark, item_col, item_text_col):
        if out is not None:
            out = written(out)  # one block's items are held at a time
        part = _pass(docs, items, k, share, id_col, text_col)
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, k: int = 5, share: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they are."""
    for n, items in enumerate(_blocks(benchmark, item_col, item_text_col)):
        docs = _without(written(docs) if n else docs, items, k, share, text_col)
    return docs


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[list]:
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("t IS NOT NULL")
    words = items.agg(F.sum(F.size(F.split("t", r"\s+")))).head()[0] or 0
    blocks = max(1, -(-words // (BLOCK_WORDS // 2)))
    for n in range(blocks):
        yield [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == n).collect()]


def _indexes(items: list, k: int) -> list[Index]:
    return [Index(items, k), Index(items, k, merged=True)]


def _found(indexes: list[Index], column, share: float) -> list[tuple[int, object, float, bool]]:
    """(row, item id, share, changed) of a batch's texts."""
    raw, offs = text_buffers(column)
    rows = []
    for a, b in slices(offs):
        plain = Words(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        done = set()
        for index in indexes:
            words = plain.merged() if index.merged else plain
            by = defaultdict(list)
            for w, x, size in index.matches(words):
                text = int(np.searchsorted(words.first, w, side="right")) - 1
                by[text, int(np.searchsorted(index.words.first, x, side="right")) - 1].append((w, x, size))
            for (text, item), pairs in by.items():
                if (text, item) not in done and len({x for _, x, _ in pairs}) >= share * int(index.total[item]):
                    got, changed = index.found(words, pairs, item)
                    if got >= share:
                        done.add((text, item))
                        rows.append((a + text, index.ids[item], got, changed))
    return rows


def _without(docs: DataFrame, items: list, k: int, share: float, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((items, k))
    held: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "index" not in held:
            held["index"] = _indexes(*shared.value)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[r[0] for r in _found(held["index"], batch.column(batch.schema.get_field_index(text_col)), share)]] = False
            yield batch.filter(pa.array(clean))
            give_back()

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def _pass(docs: DataFrame, items: list, k: int, share: float, id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((items, k))
    held: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "index" not in held:
            held["index"] = _indexes(*shared.value)
        for batch in batches:
            rows = _found(held["index"], batch.column(1), share)
            at, item, got, changed = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(got, pa.float64()), pa.array(changed, pa.bool_())], names=["doc_id", "item_id", "share", "changed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, item_id long, share double, changed boolean")
