"""Byte-level BPE encoding and decoding with a segment tree.

Each match of the splitting pattern is encoded on its own. A tree over its byte positions holds in every node the least
rank of an adjacent pair and the leftmost position that has it. A merge takes the root, joins the token there with its
live neighbour and renews three leaves (the merged place, the place that died, the place before), each in
logarithmically many steps. Many short matches are worked on side by side as rows of one array; a long match has a tree of its own.

Cases: a null or empty text has no ids and decodes to nothing; an empty table gives no rows; repeated rows repeat their result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from blockwalk.llm.chunks import WIDE_SPACE, Chunked
from blockwalk.llm.common import texts

NONE = 1 << 62
_AT = 40  # bits for the position in a node; the rank is above
ROWS = 8192
SIDE_BY_SIDE = 64


def read_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}


class SegmentTreeBpe:
    """Ranks are token ids: a pair may merge where its joined bytes have a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        space = rf"\t-\r {WIDE_SPACE}"
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {(ranks[b[:k]] << 20) | ranks[b[k:]]: i for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks}
        self.pairs = pairs
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order]
        # open addressing: the key's slot, or the next free one
        bits = max(len(pairs) * 2, 2).bit_length()
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, dtype=np.int64)
        self.ids = np.full(1 << bits, -1, dtype=np.int64)
        self._fill()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _fill(self) -> None:
        mask, todo, at = len(self.slots) - 1, np.arange(len(self.keys)), self._slot(self.keys)
        self.reach = 0
        while len(todo):
            self.reach += 1
            free = self.slots[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = np.zeros(len(at), dtype=bool)
            won[first] = True
            won &= free
            self.slots[at[won]], self.ids[at[won]] = self.keys[todo[won]], self.merged[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & mask

    def _nodes(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Node values of the pairs of tokens at positions ``at``; a token of -1 has no pair."""
        keys = (left << 20) | right
        spot, out, mask = self._slot(keys), np.full(len(keys), -1, dtype=np.int64), len(self.slots) - 1
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.reach):
            if not len(open_):
                break
            there = self.slots[spot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.ids[spot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
            spot[open_] = (spot[open_] + 1) & mask
        return np.where(out >= 0, (out << _AT) | at, NONE)

    def _many(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Words of at most ``width`` bytes (a power of two), a row each."""
        n = len(words)
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        size = np.array([len(w) for w in words])
        inside = np.arange(width) < size[:, None]
        token = np.full((n, width + 1), -1, dtype=np.int64)
        token[:, :width] = np.where(inside, self.single[flat], -1)
        place = np.arange(width)
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        right = np.where(place + 1 < size[:, None], token[:, 1:], -1)
        tree[:, width:] = self._nodes(token[:, :width].ravel(), right.ravel(), np.tile(place, n)).reshape(n, width)
        level = width // 2
        while level:
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            at, rank = root & ((1 << _AT) - 1), root >> _AT
            gone = after[live, at]
            then = after[live, gone]
            prior = before[live, at]
            token[live, at], token[live, gone] = rank, -1
            after[live, at] = then
            linked = then < width
            before[live[linked], then[linked]] = at[linked]
            had = prior >= 0
            rows = np.concatenate([live, live, live[had]])
            spots = np.concatenate([at, gone, prior[had]])
            values = np.concatenate([
                self._nodes(rank, np.where(linked, token[live, np.minimum(then, width)], -1), at), np.full(len(live), NONE),
                self._nodes(token[live[had], prior[had]], rank[had], prior[had])])
            tree[rows, width + spots] = values
            node = (width + spots) >> 1
            while node[0]:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node >>= 1
            live = live[tree[live, 1] < NONE]
        return [t[t >= 0] for t in token[:, :width]]

    def _one(self, word: bytes) -> np.ndarray:
        """A long word with plain lists."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        token = self.single[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, before, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs
        tree = [NONE] * (2 * width)

        def node(a: int, b: int) -> int:
            rank = pairs.get((token[a] << 20) | token[b]) if a >= 0 and b < n else None
            return NONE if rank is None else (rank << _AT) | a

        tree[width:width + n] = [node(i, i + 1) for i in range(n)]
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while (root := tree[1]) < NONE:
            at = root & ((1 << _AT) - 1)
            gone = after[at]
            then, prior = after[gone], before[at]
            token[at], token[gone], after[at] = root >> _AT, -1, then
            if then < n:
                before[then] = at
            for spot, value in ((at, node(at, then)), (gone, NONE), (prior, node(prior, at))):
                if spot >= 0:
                    i = width + spot
                    tree[i] = value
                    while i := i >> 1:
                        value = min(tree[2 * i], tree[2 * i + 1])
                        if tree[i] == value:
                            break
                        tree[i] = value
        return np.array([t for t in token if t >= 0], dtype=np.int64)

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words as little-endian unsigned 32-bit integers."""
        done, by_width = {}, {}
        for w in words:
            if (whole := self.ranks.get(w)) is not None:
                done[w] = whole.to_bytes(4, "little")
            elif len(w) > SIDE_BY_SIDE:
                done[w] = self._one(w).astype("<u4").tobytes()
            else:
                by_width.setdefault(max(1 << (len(w) - 1).bit_length(), 2), []).append(w)
        for width, group in by_width.items():
            for i in range(0, len(group), ROWS):
                some = group[i:i + ROWS]
                done.update((w, ids.astype("<u4").tobytes()) for w, ids in zip(some, self._many(some, width), strict=True))
        return done

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        split = [[m.encode() for m in self.split.findall(p)] for p in parts]
        known = self.encode_words(list({w for words in split for w in words}))
        return [b"".join([known[w] for w in words]) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join([self.bytes_of[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@lru_cache(maxsize=2)
def _kept(lines: bytes, pattern: str) -> tuple[SegmentTreeBpe, Chunked]:
    """Kept by a worker from task to task, with the chunks it remembers."""
    bpe = SegmentTreeBpe(read_ranks(lines), pattern)
    return bpe, Chunked(bpe.encode_parts)


def round_trips(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of ``docs``."""
    rows = texts(docs)
    with open(ranks_path, "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, encode = _kept(lines.value, pattern)
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch["doc_id"], encode(batch["text"]), strict=True):
                out.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})

    return rows.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
