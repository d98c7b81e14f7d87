"""N-gram Jaccard join with Bayesian pruning of candidates.

1. Every text becomes its set of 5-word shingles; equal sets collapse to one representative.
2. Representatives get ``BANDS`` x ``ROWS`` MinHash values of one byte. Two that agree in a whole band share a bucket. At a
   similarity of 0.8 a pair shares none with a probability of 3e-6.
3. Inside a bucket MinHash values are compared ``STEP`` at a time. With m of n values equal and a flat prior, the posterior chance
   of reaching the threshold is a binomial tail; a pair is dropped as soon as it is below ``TOLERANCE``. At a
   similarity of 0.8 all steps together drop a pair with a probability of 1.1e-6, less than the bands do.
4. What survives links representatives into candidate components. Inside each the shingle sets of all pairs are compared in
   full, so links and their numbers are exact there.

Buckets and components of any size are split into blocks, and pairs of blocks are tasks of bounded size. A task returns
one row per member (its links, its local component), never pairs, so a group's pairs are counted without being written out.

Cases: a text of one to four words is one shingle; a text without words has no links and is its own class; rows that
repeat an id are one document (with different texts: the one of the least hash); null ids are not compared, each gives
(null, null, 0) in ``classes``, while ``kept_rows`` compares rows and not ids; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwalk.llm.common import cut, free_name, partitions, texts
from blockwalk.llm.links import components
from blockwalk.llm.words import shingles

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
VALUES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-7
BLOCK = 256
BLOCK_SHINGLES = 1_000_000
COLUMNS = 4096

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(found: np.ndarray) -> bytes:
    """One byte per value: of the least product, a byte whose bits the order doesn't fix."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(least, (_FACTORS[:, None] * found[None, at:at + 512]).min(1), out=least)
    return ((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.uint8).tobytes()


def reach(m: int, n: int, threshold: float = THRESHOLD) -> float:
    """The posterior chance of a similarity of at least ``threshold`` after m of n equal values, from a flat prior."""
    return sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After each step: the fewest equal values with which a pair stays."""
    return [next(m for m in range(n + 1) if reach(m, n, threshold) >= tolerance) for n in range(STEP, VALUES + 1, STEP)]


def _set_id(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _body_id(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, body_id, set_id, n, sig), one row per row of ``docs``; ``body_id`` is the SHA-256 of the text."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = shingles(text, WORDS)
                out.append((_set_id(found), len(found), minhash(found)))
            new = pd.DataFrame(out, columns=["set_id", "n", "sig"])
            yield batch[["id", "unknown", "body_id"]].assign(**{c: new[c].to_numpy() for c in new})

    # a column of longs with nulls would reach Python as floats
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("unknown"),
                              _body_id(F.col("text")).alias("body_id"), "text")
    return rows.mapInPandas(sign, "id long, unknown boolean, body_id binary, set_id binary, n long, sig binary") \
        .select(F.when(~F.col("unknown"), F.col("id")).alias("doc_id"), "body_id", "set_id", "n", "sig")


def _bands(reps: DataFrame) -> DataFrame:
    """(bucket, id): a band's bytes and its number in one integer."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch["sig"]), dtype=np.uint8).reshape(-1, BANDS, ROWS).astype(np.int64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.int64), sig.shape[:2]).copy()
            for i in range(ROWS):
                key = (key << 8) | sig[:, :, i]
            yield pd.DataFrame({"bucket": key.ravel(), "id": np.repeat(batch["id"].to_numpy(), BANDS)})

    return reps.select("id", "sig").mapInPandas(split, "bucket long, id long")


def _blocks(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """A row per pair of blocks that its own block takes part in; (key, i, j) names the task, ``own`` the row's block."""
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col(blocks)).cast("int")
    return rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))) \
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", blocks)


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index in each index's component, from pairs of indexes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _survivors(batches: Iterator[pd.DataFrame], fewest: list[int]) -> Iterator[pd.DataFrame]:
    """(a, b): stars that join what the pruning leaves connected in each task's group. Groups come one after another."""
    rest = None
    for batch in _with_end(batches):
        rows = rest if batch is None else batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if rows is None or not len(rows):
            continue
        group = rows[["bucket", "i", "j"]].to_numpy()
        new = np.r_[True, (group[1:] != group[:-1]).any(1)]
        start = np.flatnonzero(new)
        if batch is not None:
            if len(start) == 1:
                rest = rows
                continue
            rest, rows = rows.iloc[start[-1]:].reset_index(drop=True), rows.iloc[:start[-1]]
            new = new[:start[-1]]
            start = start[:-1]
        ids = rows["id"].to_numpy()
        sig = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint8).reshape(-1, VALUES)
        end = np.r_[start[1:], len(rows)][np.cumsum(new) - 1]
        lefts, rights = [], []
        for gap in range(1, int((end - np.arange(len(rows))).max(initial=0))):
            a = np.flatnonzero(np.arange(len(rows)) + gap < end)
            equal = np.zeros(len(a), dtype=np.int64)
            for step, least in enumerate(fewest):
                part = slice(step * STEP, (step + 1) * STEP)
                equal += (sig[a, part] == sig[a + gap, part]).sum(1)
                stay = equal >= least
                a, equal = a[stay], equal[stay]
                if not len(a):
                    break
            lefts.append(a)
            rights.append(a + gap)
        if lefts:
            root = _local_roots(len(rows), np.concatenate(lefts), np.concatenate(rights))
            linked = root != np.arange(len(rows))
            yield pd.DataFrame({"a": ids[linked], "b": ids[root[linked]]})


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def candidates(reps: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(a, b): edges whose components hold every pair that shares a bucket and survives the pruning."""
    fewest = least_matches(threshold, tolerance)
    bands = _bands(reps)
    shared = bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1") \
        .select("bucket", F.ceil(F.col("members") / BLOCK).alias("blocks"))
    rows = _blocks(bands.join(shared, "bucket"), "bucket", "blocks").join(reps.select("id", "sig"), "id")
    dealt = rows.repartition(partitions(reps.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id") \
        .select("bucket", "i", "j", "id", "sig")
    return dealt.mapInPandas(lambda batches: _survivors(batches, fewest), "a long, b long").distinct()


def exact_links(sets: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of shingle sets reach the threshold, by whole intersections."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), size)
    _, column, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = holders[column] > 1
    owner, column = owner[common], column[common]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), dtype=np.float64)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        held = np.zeros((n, min(COLUMNS, width - at)), dtype=np.float32)
        held[owner[lo:hi], column[lo:hi] - at] = 1
        both += held @ held.T
    union = size[:, None] + size[None, :] - both
    return (both >= threshold * union - 1e-9) & (both > 0) & ~np.eye(n, dtype=bool)


def _verified(docs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(id, root, blocks, links, label) per task: links to others by their copies, and the least id of the local component.

    ``nodes`` has (id, doc_id, body_id, set_id, copies, root, blocks); a node's text is that of the row with its doc_id and body_id.
    """
    kept = nodes.select("id", F.col("doc_id").alias("of_doc"), F.col("body_id").alias("of_body"), "set_id", "copies", "root", "blocks")
    rows = texts(docs).withColumn("body_id", _body_id(F.col("text"))) \
        .join(kept, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("body_id") == F.col("of_body"))) \
        .select("id", "set_id", "copies", "root", "blocks", "text")
    tasks = _blocks(rows.withColumn("of", F.col("blocks")), "root", "blocks")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        sets, keep = [], []
        for k, (text, set_id) in enumerate(zip(group["text"], group["set_id"], strict=True)):
            found = shingles(text, WORDS)
            if _set_id(found) == bytes(set_id):
                sets.append(found)
                keep.append(k)
        group = group.iloc[keep]
        once = ~group["id"].duplicated().to_numpy()
        group, sets = group[once], [s for s, o in zip(sets, once, strict=True) if o]
        ids, copies, own = group["id"].to_numpy(), group["copies"].to_numpy(), group["own"].to_numpy()
        link = exact_links(sets, threshold)
        if len(group) and group["i"].iloc[0] != group["j"].iloc[0]:
            link &= own[:, None] != own[None, :]  # pairs inside a block have a task of their own
        a, b = np.nonzero(link)
        label = ids[_local_roots(len(ids), a, b)]
        return pd.DataFrame({"id": ids, "root": group["root"], "blocks": group["of"], "links": (link * copies[None, :]).sum(1), "label": label})

    return tasks.groupBy("root", "i", "j").applyInPandas(compare, "id long, root long, blocks long, links long, label long")


def _linked(docs: DataFrame, reps: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(id, links, least) of the nodes ``reps`` (id, doc_id, body_id, set_id, copies, n, sig) that may have links: documents linked, the component's least node."""
    roots = components(candidates(reps, threshold, tolerance))
    sized = reps.drop("sig").join(roots, "id")
    per_root = sized.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("total"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("total") / BLOCK_SHINGLES))
    nodes = sized.join(per_root, "root").withColumn("blocks", blocks)
    checked = cut(_verified(docs, nodes, threshold))
    split = components(checked.where("blocks > 1").select(F.col("id").alias("a"), F.col("label").alias("b")))
    return checked.groupBy("id").agg(F.sum("links").alias("links"), F.min("label").alias("label")).join(split, "id", "left") \
        .select("id", "links", F.coalesce("root", "label").alias("least"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_links, copy_of), one row per document.

    ``class_id`` is the least id among all documents reached over links, ``n_links`` the number of other documents at or
    over the threshold, copies included, and ``copy_of`` the least id with the same shingle set.
    """
    known = signatures(docs.where("doc_id IS NOT NULL"))
    signed = cut(known.groupBy("doc_id").agg(F.min(F.struct("set_id", "n", "sig", "body_id")).alias("v")).select("doc_id", "v.*"))
    sets = cut(signed.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")))
    reps = signed.join(sets, (F.col("doc_id") == F.col("id")) & (signed["set_id"] == sets["set_id"])) \
        .select("id", "doc_id", "body_id", signed["set_id"], "copies", "n", "sig")
    found = _linked(docs, reps, threshold, tolerance)
    per_set = sets.join(found, "id", "left").select(
        "set_id", F.col("id").alias("copy_of"), F.coalesce("least", "id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    every = signed.select("doc_id", "set_id", "n").join(per_set, "set_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("copy_of", "doc_id").alias("copy_of"))
    unknown = docs.where("doc_id IS NULL").select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("copy_of"))
    return every.unionByName(unknown)


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its own columns: of each class the row of the least id, and rows without words.

    Here rows are compared by (doc_id, text), so every text of an id and every row without an id takes part; null ids sort last.
    """
    signed = cut(signatures(docs).where("n > 0").distinct())
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "set_id", "body_id")
    sets = cut(signed.groupBy("set_id").agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("sig").alias("sig"))
               .withColumn("id", F.monotonically_increasing_id()))  # fixed by the checkpoint
    found = _linked(docs, sets.select("id", "first.doc_id", "first.body_id", "set_id", "copies", "n", "sig"), THRESHOLD, TOLERANCE)
    stays = sets.join(found, "id", "left").groupBy(F.coalesce("least", "id")).agg(F.min("first").alias("first")).select("first.*")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
    gone = signed.alias("l").join(stays.alias("r"), same & (F.col("l.body_id") == F.col("r.body_id")), "left_anti").select("doc_id", "body_id")
    key = free_name(docs, "body_id")
    rows = docs.withColumn(key, _body_id(F.coalesce(F.col("text"), F.lit(""))))
    return rows.alias("l").join(gone.alias("r"), same & (F.col(f"l.{key}") == F.col("r.body_id")), "left_anti").drop(key)
