"""Case folding on UTF-8 bytes with numpy, for characters of one or two bytes
whose folded form is as long (Latin, Greek, Cyrillic and the like)."""

from __future__ import annotations

import numpy as np

_one = np.arange(256, dtype=np.uint8)
_one[65:91] += 32
_two: np.ndarray | None = None


def _pairs() -> np.ndarray:
    global _two
    if _two is None:
        _two = np.arange(1 << 16, dtype=np.uint16)
        for code in range(0x80, 0x800):
            a, b = chr(code).encode(), chr(code).casefold().encode()
            if a != b and len(b) == 2:
                _two[a[0] << 8 | a[1]] = b[0] << 8 | b[1]
    return _two


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with case folded; as long as ``data``."""
    out = _one[data]
    at = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] < 0xE0)) if len(data) else np.zeros(0, np.int64)
    if len(at):
        pair = _pairs()[data[at].astype(np.uint16) << 8 | data[at + 1]]
        out[at] = pair >> 8
        out[at + 1] = pair & 0xFF
    return out
