"""Passages that repeat across documents, by a sparse suffix array.

Suffixes are kept only where content selects them: in every stretch of ``LEAST`` words, the start of the ``HEAD``-word gram of
least hash (the leftmost of equals). Two texts that share a passage of ``LEAST`` words keep a suffix at the same place in it.

1. Kept suffixes meet by their first ``HEAD`` words; those that only one document has are done with. What repeats goes into a Bloom
   filter of ``FILTER_BITS`` bits, which may be broadcast; a false hit costs work, never a result.
2. A second reading extends each suffix that passed left and right: fingerprints of all ``LEAST``-word windows that select it. Equal
   extensions collapse, with the least and greatest document that has them.
3. The windows of distinct extensions are compared with their equals in sorted order; a window repeats if its documents differ. The
   union of a document's repeated windows is its maximal matches, however long.

All comparisons are aggregates with partial sums, so a passage that a third of all documents holds is no hot task.

Cases: texts of under ``LEAST`` words have no spans; a passage that repeats inside one document only is no span; rows that repeat an id
are one document; null ids are not compared and give a row without spans each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwalk.llm.common import cut, texts
from blockwalk.llm.words import _WORD, windows, word_hashes

LEAST = 51
HEAD = 12
SELECT = LEAST - HEAD + 1
FILTER_BITS = 1 << 27
SLICES = 64
ROWS = 10_000
_PLACE = 24  # bits of a position beside the order of a gram


def kept_suffixes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint of the first words, first window, number of windows) of every kept suffix."""
    grams = windows(hashes, HEAD)
    n = len(hashes) - LEAST + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << _PLACE) - 1)
    order = (grams & ~low) | (place & low)
    width = 1
    while 2 * width <= SELECT:
        order = np.minimum(order[:-width], order[width:])
        width *= 2
    order = np.minimum(order[:n], order[SELECT - width:SELECT - width + n])
    first = np.arange(n, dtype=np.uint64)
    at = (first + ((order - first) & low)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return grams[at[start]].view(np.int64), start, np.diff(np.r_[start, n])


def _bits(suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A slice and two places inside it."""
    room = np.uint64(FILTER_BITS // SLICES - 1)
    x = suffix.view(np.uint64)
    return (x % np.uint64(SLICES)).astype(np.int64), ((x >> np.uint64(8)) & room).astype(np.int64), ((x >> np.uint64(36)) & room).astype(np.int64)


def repeated_filter(suffixes: DataFrame) -> np.ndarray:
    """Bits of the suffixes (suffix, doc_id) that more than one document has; slices are filled in tasks of their own."""
    repeated = suffixes.groupBy("suffix").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi") \
        .select("suffix", F.pmod("suffix", F.lit(SLICES)).alias("part"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            part, one, two = _bits(batch["suffix"].to_numpy())
            for p in np.unique(part).tolist():
                bits = found.setdefault(p, np.zeros(FILTER_BITS // SLICES // 8, dtype=np.uint8))
                for at in (one[part == p], two[part == p]):
                    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for p, bits in found.items():
            yield pd.DataFrame({"part": [p], "bits": [bits.tobytes()]})

    whole = np.zeros((SLICES, FILTER_BITS // SLICES // 8), dtype=np.uint8)
    for row in repeated.repartition(SLICES, "part").mapInPandas(fill, "part int, bits binary").collect():  # FILTER_BITS in all
        whole[row["part"]] |= np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return whole


def _passes(bits: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    part, one, two = _bits(suffix)
    return ((bits[part, one >> 3] >> (one & 7)) & (bits[part, two >> 3] >> (two & 7)) & 1).astype(bool)


def extensions(docs: DataFrame) -> DataFrame:
    """(doc_id, ext, first, wins): kept suffixes that may repeat, with the fingerprints of the windows around them."""
    rows = texts(docs).where("doc_id IS NOT NULL")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(kept_suffixes(word_hashes(t))[0]) for t in batch["text"]]
            yield pd.DataFrame({"suffix": np.concatenate(found) if found else np.zeros(0, dtype=np.int64),
                                "doc_id": np.repeat(batch["doc_id"].to_numpy(), [len(f) for f in found])})

    shared = docs.sparkSession.sparkContext.broadcast(repeated_filter(rows.mapInPandas(keep, "suffix long, doc_id long")))

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, columns = shared.value, ["doc_id", "ext", "first", "wins"]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                hashes = word_hashes(text)
                suffix, first, n = kept_suffixes(hashes)
                stay = np.flatnonzero(_passes(bits, suffix))
                if not len(stay):
                    continue
                wins = windows(hashes, LEAST).view(np.int64)
                for a, b in zip(first[stay].tolist(), n[stay].tolist(), strict=True):
                    own = wins[a:a + b]
                    out.append((doc_id, xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63), a, own))
                if len(out) >= ROWS:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(extend, "doc_id long, ext long, first int, wins array<long>")


def _spans(first: np.ndarray, mask: np.ndarray) -> list[list[int]]:
    """Word spans (start, end exclusive) that the marked windows cover."""
    row, off = np.nonzero((mask[:, None] >> np.arange(SELECT)) & 1)
    starts = np.unique(first[row] + off)
    if not len(starts):
        return []
    new = np.r_[True, np.diff(starts) > LEAST]
    ends = np.r_[starts[np.flatnonzero(new)[1:] - 1], starts[-1]] + LEAST
    return np.stack([starts[new], ends], 1).tolist()


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_repeated, spans, cut_spans, partners), one row per document.

    ``spans`` are the word spans whose every window of ``LEAST`` words also stands in another document, ``cut_spans`` those that a document
    of a smaller id has as well (what a dedup cuts out), ``partners`` some ids it shares them with: for each extension
    the least or greatest.
    """
    found = cut(extensions(docs))
    distinct = cut(found.groupBy("ext", "wins").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")))
    each = distinct.select("ext", "lo", "hi", F.posexplode("wins").alias("off", "win"))
    windows_ = each.groupBy("win").agg(F.min("lo").alias("w_lo"), F.max("hi").alias("w_hi")).where("w_lo <> w_hi")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("off"))
    masks = each.join(windows_, "win").groupBy("ext").agg(
        F.sum(bit).alias("mask"), F.sum(F.when(F.col("w_lo") < F.col("lo"), bit).otherwise(0)).alias("mask_least"),
        F.min("lo").alias("lo"), F.min("w_lo").alias("w_lo"), F.max("w_hi").alias("w_hi"))
    rows = found.select("doc_id", "ext", "first").join(masks, "ext").select(
        "doc_id", "first", "mask", F.when(F.col("doc_id") > F.col("lo"), F.col("mask")).otherwise(F.col("mask_least")).alias("mask_cut"),
        F.when(F.col("w_lo") != F.col("doc_id"), F.col("w_lo")).otherwise(F.col("w_hi")).alias("partner"))
    per_doc = rows.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array(F.col("first").cast("long"), "mask", "mask_cut"))).alias("m"), F.collect_set("partner").alias("partners"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, m, partners in zip(batch["doc_id"], batch["m"], batch["partners"], strict=True):
                table = np.array(m, dtype=np.int64).reshape(-1, 3)
                spans, cuts = _spans(table[:, 0], table[:, 1]), _spans(table[:, 0], table[:, 2])
                out.append((doc_id, sum(b - a for a, b in spans), spans, cuts, sorted(partners)))
            yield pd.DataFrame(out, columns=["doc_id", "n_repeated", "spans", "cut_spans", "partners"])

    kind = "array<array<int>>"
    merged = per_doc.mapInPandas(merge, f"doc_id long, n_repeated long, spans {kind}, cut_spans {kind}, partners array<long>")
    ids = docs.select("doc_id")
    every = ids.where("doc_id IS NOT NULL").distinct().unionByName(ids.where("doc_id IS NULL"))
    none = F.array().cast(kind)
    return every.join(merged, "doc_id", "left").select(
        "doc_id", F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"), F.coalesce("spans", none).alias("spans"),
        F.coalesce("cut_spans", none).alias("cut_spans"), F.coalesce("partners", F.array().cast("array<long>")).alias("partners"))


def without(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans and the white space behind them."""
    places = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:places[a]])
        at = places[b]
    return "".join(out) + text[at:]
