"""Near duplicates among embeddings by sorted projection passes.

Equal vectors of a label stand for each other first. A pass gives every vector 64 concatenated hashes, the signs of random projections, and
orders the vectors of a label by them. Each vector is compared with its neighbours of at least ``WINDOW`` places on either side, in blocks;
neighbours that two partitions part meet once more at the partitions' edges. Every pass has its own projections, and the pairs that reach
the threshold are joined over all passes. The number of passes follows from the size of the largest label: two vectors at the threshold agree in as many
leading hashes as it takes to cut a label down to half a window in at least one pass, but for a chance of ``MISS``.

Links are then counted whole inside each joined group, also those that no window saw. A group of up to ``BLOCK`` vectors is one block. In a
larger one, vectors within half the threshold angle of the group's mean are all linked to each other and are only counted; the others meet
all of the group in pairs of blocks. So a dense group costs work in proportion to its size, however large it is.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing; so do vectors of
different lengths. Repeated rows are rows of their own and link. A null id links as any other; it is never a component's id unless there is
no other. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwalk.llm.common import cut, partitions
from blockwalk.llm.jaccard_pruning import _local_roots
from blockwalk.llm.links import components
from blockwalk.ship import ship

THRESHOLD = 0.93
WINDOW = 128
MISS = 1e-5
BITS = 64
AT_ONCE = 4
BLOCK = 512
SEED = 20_231
#: Cosines so near the threshold are computed again, exactly rounded, so that both sides of a pair agree; angles keep the same distance.
CLOSE = 1e-9


def _passes(largest: int, threshold: float, window: int) -> int:
    if largest <= window:
        return 1
    same = 1 - math.acos(threshold) / math.pi
    agree = same ** (math.log2(largest / window) + 1)
    return math.ceil(math.log(MISS) / math.log1p(-agree))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    a, b = (np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) for x in (a.astype(np.float64), b.astype(np.float64)))
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def _reach(left: np.ndarray, right: np.ndarray, u: np.ndarray, v: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows of the unit vectors ``u`` and ``v`` reach the threshold; ``left`` and ``right`` are the vectors as given."""
    cosine = u @ v.T
    found = cosine >= threshold
    for i, j in np.argwhere(np.abs(cosine - threshold) < CLOSE):
        found[i, j] = _exact(left[i], right[j]) >= threshold
    return found


def _projections(of_pass: int, length: int) -> np.ndarray:
    return np.random.default_rng([SEED, of_pass, length]).normal(size=(BITS, length))


def keys(unit: np.ndarray, of_pass: int) -> np.ndarray:
    """The concatenated hashes as one number that sorts like them."""
    bits = np.packbits(unit @ _projections(of_pass, unit.shape[1]).T > 0, axis=1)
    return (bits.view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _given(column: pd.Series, kind: type) -> np.ndarray:
    return np.stack([np.frombuffer(v, dtype=kind) for v in column])


def _window_links(set_of: np.ndarray, v: list[bytes], kind: type, window: int, threshold: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Positions of linked pairs: each row against the rest of its block and the next one, inside a run of one set."""
    lefts, rights = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    ends = np.flatnonzero(np.r_[set_of[1:] != set_of[:-1], True]) + 1 if len(set_of) else []
    at = 0
    for end in ends:
        given = _given(v[at:end], kind)
        unit = _unit(given)
        for low in range(0, end - at, window):
            near = slice(low, low + 2 * window)
            i, j = np.nonzero(_reach(given[low:low + window], given[near], unit[low:low + window], unit[near], threshold))
            later = j > i
            lefts.append(at + low + i[later])
            rights.append(at + low + j[later])
        at = end
    return lefts, rights


def _stars(ids: np.ndarray, lefts: list[np.ndarray], rights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    root = _local_roots(len(ids), np.concatenate(lefts), np.concatenate(rights))
    linked = root != np.arange(len(ids))
    return ids[linked], ids[root[linked]]


_FOUND = "kind byte, a long, b long, part int, side byte, spot long, set_of string, v binary"


def _frame(kind: int, n: int, **columns) -> pd.DataFrame:
    empty = {"kind": np.int8(kind), "a": None, "b": None, "part": None, "side": None, "spot": None, "set_of": None, "v": None}
    return pd.DataFrame(empty | columns, index=range(n)).astype({c: "Int64" for c in ("a", "b", "part", "side", "spot")})


def _pass_links(reps: DataFrame, passes: range, kind: type, window: int, threshold: float) -> DataFrame:
    """(a, b) stars of linked vectors, by the passes named."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length = batch["v"].map(len)
            for n, part in batch.groupby(length, sort=False):
                given = np.stack(part["v"].to_numpy()).astype(kind)
                unit = _unit(given)
                for of_pass in passes:
                    yield pd.DataFrame({"set_of": f"{of_pass}:{n}:" + part["label"], "key": keys(unit, of_pass), "id": part["id"], "v": [x.tobytes() for x in given]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen, rows = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not len(batch):
                continue
            if seen < window:
                head = batch.iloc[:window - seen]
                yield _frame(1, len(head), a=head["id"].to_numpy(), part=part, side=0, spot=np.arange(seen, seen + len(head)), set_of=head["set_of"].to_numpy(), v=head["v"].to_numpy())
            seen += len(batch)
            rows = batch if rows is None else pd.concat([rows, batch], ignore_index=True)
            a, b = _stars(rows["id"].to_numpy(), *_window_links(rows["set_of"].to_numpy(), list(rows["v"]), kind, window, threshold))
            yield _frame(0, len(a), a=a, b=b)
            rows = rows.iloc[-window:].reset_index(drop=True)
        if rows is not None:
            yield _frame(2, 1, part=part, spot=seen)
            if seen >= window:
                yield _frame(1, len(rows), a=rows["id"].to_numpy(), part=part, side=1, spot=np.arange(seen - len(rows), seen), set_of=rows["set_of"].to_numpy(), v=rows["v"].to_numpy())

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "spot"], kind="stable")
        a, b = _stars(group["a"].to_numpy(), *_window_links(group["set_of"].to_numpy(), list(group["v"]), kind, window, threshold))
        return pd.DataFrame({"a": a, "b": b})

    spark = reps.sparkSession
    order = ["set_of", "key", "id"]
    laid = reps.select("id", "label", "v").mapInPandas(project, "set_of string, key long, id long, v binary")
    laid = laid.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    found = cut(laid.mapInPandas(compare, _FOUND))
    # where partitions end: a row per partition says how many rows it has; short partitions lie between longer ones as they are
    edges, place = [], 0
    for r in found.where("kind = 2").select("part", "spot").orderBy("part").collect():
        edges.append((r["part"], 0, place))
        if r["spot"] >= window:
            place += 1
            edges.append((r["part"], 1, place))
    spots = spark.createDataFrame(edges, "part int, side byte, place int")
    across = found.where("kind = 1").join(spots, ["part", "side"]).groupBy("place").applyInPandas(meet, "a long, b long")
    return found.where("kind = 0").select("a", "b").unionByName(across)


def _whole_links(nodes: DataFrame, kind: type, threshold: float, block: int) -> DataFrame:
    """(id, links): for each of ``nodes`` (id, root, copies, v) the rows of other nodes of its group that it is linked to."""
    spark = nodes.sparkSession
    half = math.acos(threshold) / 2 - CLOSE
    sized = nodes.groupBy("root").agg(F.count("*").alias("members"))
    large = nodes.join(sized.where(F.col("members") > block).select("root"), "root")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for root, part in batch.groupby("root"):
                yield pd.DataFrame({"root": [root], "mean": [_unit(np.stack(part["v"].to_numpy())).sum(0)]})

    def total(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"root": group["root"].iloc[:1], "mean": [np.stack(group["mean"].to_numpy()).sum(0)]})

    schema = "root long, mean array<double>"
    means = large.select("root", "v").mapInPandas(add, schema).groupBy("root").applyInPandas(total, schema)

    def side(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            core = np.zeros(len(batch), dtype=bool)
            has = batch["mean"].notna().to_numpy()
            for _, at in pd.Series(np.flatnonzero(has)).groupby(batch["v"][has].map(len).to_numpy()):
                mean = np.stack(batch["mean"].iloc[at].to_numpy())
                if np.abs(mean).max(1).min() > 0:
                    cosine = (_unit(np.stack(batch["v"].iloc[at].to_numpy())) * _unit(mean)).sum(1)
                    core[at] = np.arccos(np.clip(cosine, -1, 1)) <= half
            yield pd.DataFrame({"id": batch["id"], "root": batch["root"], "copies": batch["copies"], "core": core, "v": [np.asarray(x, dtype=kind).tobytes() for x in batch["v"]]})

    placed = cut(nodes.join(means, "root", "left").mapInPandas(side, "id long, root long, copies long, core boolean, v binary"))
    counts = placed.groupBy("root").agg(
        F.ceil(F.sum(F.when(~F.col("core"), 1).otherwise(0)) / block).cast("int").alias("outer_blocks"),
        F.ceil(F.sum(F.when(F.col("core"), 1).otherwise(0)) / block).cast("int").alias("core_blocks"),
        F.coalesce(F.sum(F.when(F.col("core"), F.col("copies"))), F.lit(0)).alias("core_rows"))
    rows = placed.join(counts, "root")
    deal = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), F.greatest(F.col(n), F.lit(1))).cast("int")
    others = F.col("outer_blocks") + F.when(F.col("core"), 0).otherwise(F.col("core_blocks"))
    dealt = rows.withColumn("own", F.when(F.col("core"), F.col("outer_blocks") + deal("core_blocks")).otherwise(deal("outer_blocks"))) \
        .where(others > 0).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1))) \
        .select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "copies", "v")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in _with_last(batches):
            rows = rest if batch is None else batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if rows is None or not len(rows):
                continue
            group = rows[["root", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(1)])
            if batch is not None:
                rest, rows = rows.iloc[starts[-1]:].reset_index(drop=True), rows.iloc[:starts[-1]]
            bounds = [*starts, len(rows)] if batch is None else starts
            ids, copies, links = rows["id"].to_numpy(), rows["copies"].to_numpy(), np.zeros(len(rows), dtype=np.int64)
            own, i_of, j_of = (rows[c].to_numpy() for c in ("own", "i", "j"))
            for at, end in zip(bounds[:-1], bounds[1:], strict=True):
                given = _given(rows["v"].iloc[at:end], kind)
                unit, n = _unit(given), copies[at:end]
                if i_of[at] == j_of[at]:
                    hit = _reach(given, given, unit, unit, threshold)
                    np.fill_diagonal(hit, False)
                    links[at:end] = hit @ n
                else:
                    left = own[at:end] == i_of[at]
                    hit = _reach(given[left], given[~left], unit[left], unit[~left], threshold)
                    found = np.empty(end - at, dtype=np.int64)
                    found[left], found[~left] = hit @ n[~left], hit.T @ n[left]
                    links[at:end] = found
            if len(rows):
                yield pd.DataFrame({"id": ids, "links": links})

    compared = dealt.repartition(partitions(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j", "id").mapInPandas(count, "id long, links long")
    inside = rows.where("core").select("id", (F.col("core_rows") - F.col("copies")).alias("links"))
    return compared.unionByName(inside).groupBy("id").agg(F.sum("links").alias("links"))


def _with_last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("v"))
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    sound = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))
    usable = F.coalesce(F.col("label").isNotNull() & F.forall("v", sound) & F.exists("v", lambda c: c != 0), F.lit(False))
    rows = rows.select("vec_id", F.when(usable, F.col("label")).alias("label"), F.when(usable, F.col("v")).alias("v"))
    sets = rows.where("label IS NOT NULL").groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    reps = cut(sets.withColumn("id", F.monotonically_increasing_id()))  # fixed by the checkpoint
    largest = reps.groupBy("label", F.size("v")).count().agg(F.max("count")).first()[0] or 0
    total = _passes(largest, threshold, window)
    edges = None
    for at in range(0, total, AT_ONCE):
        found = cut(_pass_links(reps, range(at, min(total, at + AT_ONCE)), kind, window, threshold).distinct())
        edges = found if edges is None else edges.unionByName(found)
    roots = components(edges)
    nodes = reps.join(roots, "id")
    links = _whole_links(nodes.select("id", "root", "copies", "v"), kind, threshold, block)
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_rep = reps.join(nodes.select("id", "root"), "id", "left").join(least, "root", "left").join(links, "id", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    joined = rows.join(of_rep, ["label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
