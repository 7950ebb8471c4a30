"""Word shingles of UTF-8 texts as sorted sets of 64-bit hashes, with numpy on
Arrow buffers: no string is made for a word."""

from __future__ import annotations

import numpy as np

from threadloom.llm._arrow import mix64, span_hashes

#: Bytes between words: space and 0x09 to 0x0D.
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: Lower case for A-Z only.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words and, per text, how many precede it."""
    n = len(data)
    inside = ~_GAP[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = np.zeros(n + 1, bool)
    ends[1:] = inside
    ends[:-1] &= ~inside
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    starts[edges] = inside[edges]
    ends[edges] = inside[edges - 1]
    ends[n] = n > 0 and inside[n - 1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends), np.searchsorted(s, offs)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``k``-word shingles of each text (lower-cased A-Z), sorted
    within a text, and offsets. A text of fewer words has all its words as one
    shingle; one without words has none."""
    s, e, first = words(data, offs)
    h = span_hashes(_LOWER[data], s, e)
    count = np.diff(first)
    many = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), many)
    at = first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    size = np.minimum(count, k)[text]
    with np.errstate(over="ignore"):
        out = size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        for j in range(k):
            word = h[np.minimum(at + j, len(h) - 1)] if len(h) else h
            out += np.where(j < size, mix64(word + np.uint64((j + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))), np.uint64(0))
    out = mix64(out)
    order = np.argsort(out)
    order = order[np.argsort(text[order].astype(np.uint16 if len(count) < 1 << 16 else np.int64), kind="stable")]
    out, text = out[order], text[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[new], np.searchsorted(text[new], np.arange(len(count) + 1))
