"""Words of whole texts as 64-bit hashes, and hashes of windows of them."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
REMEMBER = 300_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBER:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_known = _Hashes()


def word_hashes(text: str) -> np.ndarray:
    known, found = _known, _WORD.findall(text)
    return np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash per window of ``k`` words: a polynomial in the words' hashes, mixed. Built by doubling."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    done, length, out = hashes, 1, None
    power, covered = _STEP, 0  # ``power`` is the step to the power of ``length``
    rest = k
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                part = done[covered:covered + n]
                out = part if out is None else out * power + part
                covered += length
            rest >>= 1
            if rest:
                done = done[:-length] * power + done[length:] if len(done) > length else done
                power = power * power
                length *= 2
        out = (out ^ (out >> np.uint64(32))) * _MIX
        return out ^ (out >> np.uint64(29))


def shingles(text: str, k: int = 5) -> np.ndarray:
    """Distinct hashes of windows of ``k`` words, sorted; a text of fewer words is one window, one of none has none."""
    found = word_hashes(text)
    return np.unique(windows(found, min(k, len(found)))) if len(found) else found
