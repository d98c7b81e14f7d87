"""Token ids of whole texts from remembered chunks.

A byte-level vocabulary splits text with one pattern before merging. Wherever a run of spaces meets a word the pattern
has a boundary of its own, so a text may be cut there and equal chunks share their ids. A worker remembers
chunks up to ``LIMIT`` and starts over beyond it, which bounds its memory and never changes a result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

LIMIT = 800_000
GROUP = 1 << 20

_CHUNK = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]")

#: White space beyond ASCII. A chunk with any of it may join its neighbours, so its text is encoded whole.
WIDE_SPACE = "\x85\xa0  -     　"
_WIDE = re.compile(f"[{WIDE_SPACE}]")


class Chunked:
    """``encode`` maps a list of strings to the ids of each as little-endian unsigned 32-bit integers."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], special: str | None = None):
        self.encode, self.special = encode, special
        self.known: dict[str, bytes] = {}
        self.whole: set[str] = set()

    def _learn(self, new: list[str]) -> None:
        self.known.update(zip(new, self.encode(new), strict=True))
        self.whole.update(p for p in new if _WIDE.search(p) or self.special and self.special in p)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.known) > LIMIT:
            self.known.clear()
            self.whole.clear()
        get = self.known.get
        parts = [_CHUNK.findall(t) for t in texts]
        found = [list(map(get, p)) for p in parts]
        new = list({p for ps, fs in zip(parts, found, strict=True) if None in fs for p, f in zip(ps, fs, strict=True) if f is None})
        if new:
            self._learn(new)
        for text, ps, fs in zip(texts, parts, found, strict=True):
            if self.whole and not self.whole.isdisjoint(ps):
                yield self.encode([text])[0]
            else:
                yield b"".join(map(get, ps) if None in fs else fs)

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text; texts are worked on in groups of about ``GROUP`` characters."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)
