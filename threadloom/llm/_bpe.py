"""Byte-level BPE over Arrow buffers.

``load(path)`` reads a tokenizer file. For a plain byte-level BPE .json (the
common word-splitting pattern, no normaliser, merges in id order) texts are cut
into pretokens with numpy on the UTF-8 bytes, and only the distinct pretokens
go through a BPE core; their ids are kept in a bounded table. Any other .json
goes through ``tokenizers``, a .model through ``sentencepiece``. All give the
ids that the library gives without added begin or end tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from threadloom.llm._arrow import SLICE_BYTES, slices, span_hashes

#: The word pattern of this kind of tokenizer (fixed value; the numpy splitter
#: below is its equivalent).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode's White_Space (fixed values).
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Distinct pretokens that a worker keeps; when full the table starts anew.
TABLE_LIMIT = 400_000
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def _class_table() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = _LETTER
        elif kind == "N":
            table[c] = _NUMBER
    table[WHITE] = _SPACE
    return table


def pretokens(data: np.ndarray, offs: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Ascending start positions of the pretokens of the texts
    ``data[offs[i]:offs[i + 1]]``; they tile the bytes without gaps."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    cls = classes[data]  # right for ASCII; other bytes follow
    lead = (data & 0xC0) != 0x80
    wide = np.flatnonzero((data >= 0xC0))
    if len(wide):
        b0 = data[wide].astype(np.int64)
        at = lambda k: data[np.minimum(wide + k, n - 1)].astype(np.int64) & 0x3F
        code = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | at(1), np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | at(1) << 6 | at(2), (b0 & 0x07) << 18 | at(1) << 12 | at(2) << 6 | at(3)))
        own = classes[np.minimum(code, 0x10FFFF)]
        cls[wide] = own
        for k in (1, 2, 3):
            more = b0 >= (0, 0xC0, 0xE0, 0xF0)[k]
            cls[np.minimum(wide[more] + k, n - 1)] = own[more]
    first = np.zeros(n + 1, bool)
    first[offs[:-1][offs[:-1] < n]] = True
    first[n] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(cls[1:], cls[:-1], out=change[1:])
    change |= first[:n]
    s = np.flatnonzero(change)  # starts of runs of one class
    e = np.append(s[1:], n)
    c = cls[s]
    white = c == _SPACE
    last = first[e]  # the run ends its text
    mark = np.zeros(n + 1, bool)
    # a run that isn't white takes one plain space before it
    word = ~white
    spaced = word & ~first[s] & (data[np.maximum(s - 1, 0)] == 0x20)
    starts = np.where(spaced, s - 1, s)
    mark[starts[word]] = True
    # white runs: the last character stands apart unless the text ends there
    mark[s[white & last]] = True
    ws, we = s[white & ~last], e[white & ~last]
    tail = we - 1
    for _ in range(3):
        tail = np.where(lead[tail], tail, tail - 1)
    mark[ws[tail > ws]] = True
    mark[tail[data[tail] != 0x20]] = True
    # contractions: an apostrophe alone that starts a pretoken, then the letters
    quote = np.flatnonzero((e - s == 1) & (data[s] == 0x27) & ~spaced & ~last)
    if len(quote):
        p = s[quote] + 1
        q = np.minimum(p + 1, n - 1)
        x, y = data[p], np.where((q < e[np.minimum(quote + 1, len(e) - 1)]), data[q], 0)
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        mark[p[one | two]] = False
        mark[p[one] + 1] = True
        mark[p[two] + 2] = True
    return np.flatnonzero(mark[:n])


class _Fast:
    """See the module's text."""

    def __init__(self, spec: dict):
        import tiktoken

        decode = {c: b for b, c in _byte_alphabet().items()}
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(decode[c] for c in word): i for word, i in vocab.items() if word not in special}
        self.special = [x.encode() for x in special]
        self._core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._classes = _class_table()
        self._clear()

    def _clear(self) -> None:
        self._keys, self._at, self._len = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self._flat, self._used = np.zeros(1 << 16, np.uint32), 0

    def _look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pretoken's ids lie in the flat table, and how many."""
        hashes = span_hashes(data, starts, ends)
        keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._keys) > TABLE_LIMIT:
            self._clear()
        i = np.searchsorted(self._keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self._keys):
            known = self._keys[np.minimum(i, len(self._keys) - 1)] == keys
        new = np.flatnonzero(~known)
        if len(new):
            raw, encode = data.tobytes(), self._core.encode_ordinary
            got = [encode(raw[a:b].decode("utf-8", "replace")) for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())]
            sizes = np.fromiter(map(len, got), np.int32, len(got))
            total = int(sizes.sum())
            if self._used + total > len(self._flat):
                self._flat = np.concatenate([self._flat[: self._used], np.zeros(max(total, len(self._flat)), np.uint32)])
            self._flat[self._used : self._used + total] = np.fromiter((x for ids in got for x in ids), np.uint32, total)
            at = self._used + np.cumsum(sizes) - sizes
            self._used += total
            self._at = np.insert(self._at, i[new], at)
            self._len = np.insert(self._len, i[new], sizes)
            self._keys = np.insert(self._keys, i[new], keys[new])
            i = np.searchsorted(self._keys, keys)
        return self._at[i][inverse], self._len[i][inverse]

    def _plain(self, data: np.ndarray, offs: np.ndarray, want_ids: bool):
        starts = pretokens(data, offs, self._classes)
        ends = np.append(starts[1:], len(data))
        at, size = self._look_up(data, starts, ends)
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        # texts begin at a pretoken; an empty one has none
        per_text = total[np.searchsorted(starts, offs)]
        if not want_ids:
            return np.diff(per_text), None
        move = at - total[:-1]
        ids = self._flat[np.repeat(move, size) + np.arange(total[-1])]
        return np.diff(per_text), ids

    def encode(self, raw: np.ndarray, offs: np.ndarray, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Ids per text, and all ids one after another if wanted."""
        counts, parts = np.zeros(len(offs) - 1, np.int64), []
        for a, b in slices(offs):
            data, local = raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            whole = data.tobytes()
            if any(x in whole for x in self.special):
                for k in range(a, b):  # special strings count as the library counts them
                    ids = self._core.encode(raw[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace"), allowed_special="all")
                    counts[k] = len(ids)
                    parts.append(np.array(ids, np.uint32))
                continue
            if b - a == 1 and len(data) > SLICE_BYTES:
                local = safe_cuts(whole, SLICE_BYTES)
                for x, y in slices(local):
                    n, ids = self._plain(data[local[x] : local[y]], local[x : y + 1] - local[x], want_ids)
                    counts[a] += n.sum()
                    parts.append(ids)
                continue
            n, ids = self._plain(data, local, want_ids)
            counts[a:b] = n
            parts.append(ids)
        if not want_ids:
            return counts, None
        return counts, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


_SAFE = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")


def safe_cuts(text: bytes, limit: int) -> np.ndarray:
    """Offsets that cut a long text into parts of about ``limit`` bytes. A cut
    lies between a letter and one plain space before a letter: there every
    pretoken ends, so the parts' ids are the whole text's. Without such a
    place a part stays longer."""
    cuts, at = [0], limit
    while at < len(text):
        found = _SAFE.search(text, at)
        if not found:
            break
        cuts.append(found.start())
        at = found.start() + limit
    return np.array([*cuts, len(text)], np.int64)


class _Library:
    """Through the library itself, texts in batches balanced by bytes."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self._encode = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, raw: np.ndarray, offs: np.ndarray, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        counts, parts = np.zeros(len(offs) - 1, np.int64), [np.zeros(0, np.uint32)]
        for a, b in slices(offs, SLICE_BYTES // 4):
            got = self._encode([raw[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace") for k in range(a, b)])
            counts[a:b] = [len(x) for x in got]
            if want_ids:
                parts += [np.array(x, np.uint32) for x in got]
        return counts, np.concatenate(parts) if want_ids else None


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _is_plain(spec: dict) -> bool:
    """Whether the fast way gives this file's ids: no normaliser or cutting,
    the usual byte-level splitter, merge ranks in the order of ids."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if spec.get("normalizer") or spec.get("truncation") or spec.get("padding"):
        return False
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return False
    vocab, special = model["vocab"], {t["content"] for t in spec.get("added_tokens", [])}
    merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    ids = [vocab.get(m.replace(" ", "", 1)) for m in merged]
    return None not in ids and all(x < y for x, y in zip(ids, ids[1:])) and all(c in vocab for c in _byte_alphabet().values()) and len(ids) + 256 + len(special & set(vocab)) == len(vocab)


_loaded: dict[str, object] = {}


def load(path: str):
    """The encoder of a tokenizer file, kept for the worker's life."""
    if path not in _loaded:
        spec = None
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
        _loaded[path] = _Fast(spec) if spec and _is_plain(spec) else _Library(path)
    return _loaded[path]
