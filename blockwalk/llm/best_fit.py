"""Best-two-fit packing of token pieces into sequences.

A text's ids (and the end id) are cut into pieces of at most ``SIZE`` tokens; only longer documents are cut, the
remainder goes first. Packing depends on lengths alone, so the bins are planned on the histogram of
lengths: at most ``SIZE`` counts, whatever the number of documents. A bin is filled greedily with the longest
lengths that fit; then its smallest piece is replaced by two unpacked ones where they fill its gap more tightly. A bin's
pattern is repeated as long as its lengths last, so the plan has some thousand entries and may be broadcast.

Pieces then take their places by rank within their length: ranks come from counts per stored partition, so no
length is ever gathered in one task.

Cases: a null or empty text is one piece that holds the end id; an empty table gives no rows; rows that repeat an id are packed as
documents of their own; ties in length are placed by stored order.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockwalk.llm.common import cut, texts

SIZE = 2048
END = 0

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_of() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: printable ones stand for themselves, the rest
    follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(model: dict, splitter: dict | None) -> dict[bytes, int] | None:
    """Bytes to ids, where ids are in the order of the merges, so that the least rank is the earliest merge."""
    plain = splitter == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not plain or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        return None
    vocabulary, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocabulary[a + b] for a, b in merges]
    if made != sorted(made) or len(set(made)) != len(made):
        return None
    byte_of, made = _byte_of(), set(made)
    return {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if i in made or len(t) == 1}


@lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> Callable[[str], bytes]:
    """A text's ids as little-endian unsigned 32-bit integers, as the ``tokenizers`` library gives them.

    A byte-level vocabulary whose ids follow its merges has the same ids in ``tiktoken``, which is many times as fast;
    any other is left to ``tokenizers``. Kept by a worker from task to task.
    """
    import json

    stated = json.loads(vocabulary)
    ranks = None if stated.get("normalizer") or stated.get("post_processor") else _ranks(stated["model"], stated.get("pre_tokenizer"))
    added = {t["content"]: t["id"] for t in stated["added_tokens"]}
    odd = any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in stated["added_tokens"])
    if ranks is None or odd:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)
        return lambda text: array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    import public_tokenizers
    import tiktoken

    bpe = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    parts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def encode(text: str) -> bytes:
        if parts is None or not parts.search(text):
            return array("I", bpe.encode_ordinary(text)).tobytes()
        return b"".join(array("I", [added[p]] if p in added else bpe.encode_ordinary(p)).tobytes() for p in parts.split(text))

    return encode


def pieces(docs: DataFrame, vocabulary_path: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids in pieces of at most ``size``."""
    rows = texts(docs)
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    end = struct.pack("<I", END)

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(vocabulary.value)
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch["doc_id"], map(encode, batch["text"]), strict=True):
                ids += end
                n = len(ids) // 4
                first = (n - 1) % size + 1
                edges = [0, *range(first, n + 1, size)]
                out += [(doc_id, i, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return rows.mapInPandas(cut_up, _PIECES)


class _Left:
    """Counts by length; the lengths still to be had are the set bits of one integer."""

    def __init__(self, counts: dict[int, int]):
        self.counts = dict(counts)
        self.bits = sum(1 << n for n, c in counts.items() if c)

    def most(self, room: int) -> int:
        """The greatest length that fits, 0 if none does."""
        return max((self.bits & ((1 << room + 1) - 1)).bit_length() - 1, 0) if room > 0 else 0

    def add(self, length: int, n: int) -> None:
        self.counts[length] += n
        self.bits = self.bits | 1 << length if self.counts[length] else self.bits & ~(1 << length)


def _best_pair(left: _Left, room: int, beyond: int) -> tuple[int, int] | None:
    """Two lengths whose sum is as near to ``room`` as can be, and over ``beyond``."""
    best, found = beyond, None
    a = left.most(room - 1)
    while a and 2 * a > best:
        left.add(a, -1)
        b = left.most(min(room - a, a))
        left.add(a, 1)
        if b and a + b > best:
            best, found = a + b, (a, b)
            if best == room:
                break
        a = left.most(a - 1)
    return found


def plan(counts: dict[int, int], size: int = SIZE) -> dict[str, np.ndarray]:
    """For runs of ranks within a length: the first sequence, pieces of that length per sequence, and the first offset.

    ``counts`` has the number of pieces by length, each from 1 to ``size``.
    """
    left = _Left(counts)
    used = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while left.bits:
        taken, room = [], size
        while n := left.most(room):
            taken.append(n)
            left.add(n, -1)
            room -= n
        if room and len(taken) > 1:
            small = taken.pop()
            if pair := _best_pair(left, room + small, small):
                left.add(small, 1)
                for n in pair:
                    left.add(n, -1)
                taken += pair
            else:
                taken.append(small)
        each = {n: taken.count(n) for n in taken}
        more = min(left.counts[n] // k for n, k in each.items())
        offset = 0
        for n, k in sorted(each.items(), reverse=True):
            rows.append((n, used[n], sequence, k, offset))
            used[n] += k * (more + 1)
            offset += n * k
            if more:
                left.add(n, -k * more)
        sequence += more + 1
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T.copy(), strict=True))


def ranked(found: DataFrame) -> DataFrame:
    """``rank`` from 0 within each length, by counts per partition of the stored ``found``."""
    placed = found.withColumn("part", F.spark_partition_id())
    sums = placed.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select(F.col("part"), F.col("length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("part", "length").orderBy(F.col("doc_id").asc_nulls_last(), "piece")
    return placed.join(firsts, ["part", "length"]).withColumn("rank", F.col("first") + F.row_number().over(own) - 1) \
        .drop("part", "first")


def packed(docs: DataFrame, vocabulary_path: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    found = cut(pieces(docs, vocabulary_path, size))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    bins = docs.sparkSession.sparkContext.broadcast(plan(counts, size))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = bins.value
        starts = (b["length"] << 44) | b["rank"]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(starts, (length << 44) | rank, side="right") - 1
            turn, slot = np.divmod(rank - b["rank"][at], b["each"][at])
            yield batch.assign(sequence_id=b["sequence"][at] + turn, offset=b["offset"][at] + slot * length) \
                [["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    return ranked(found).mapInPandas(place, f"{_PIECES}, sequence_id long, offset long")
