"""Collocations per language from depth-truncated suffix subtrees, built group by group.

A suffix is a word and the words that follow it in its piece, cut at the longest phrase length. A first scan counts, inside each task,
the distinct suffixes below prefixes of one and two words; prefixes that would fill more than a share of the memory budget are extended
by a word, and prefixes are then dealt to groups of about one budget each. A second scan sends every suffix, with its number in the
task, to the group of its prefix, all suffixes of a prefix in one row. A group takes its prefixes in order, builds the subtree of each from its
leaves and reads the totals of all nodes from theirs. Nodes above an extended prefix are totalled over their groups.

No language, word or passage gathers in one task: equal suffixes are counted before they travel, and a heavy prefix is spread by its
extensions. What goes back to the tasks is the list of extended prefixes, at most ``SHARE`` per group and depth.

Cases: a null text is empty, a null language is ``und``; an empty table or one without candidates gives no rows; repeated rows count
again; other columns are left out; ids play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwalk.llm.common import cut, partitions
from blockwalk.ship import ship

LONGEST = 3
LEAST = 10
TOP = 2000
#: Leaves of one group, and the share of it (1 / SHARE) beyond which a prefix is extended.
BUDGET = 1_000_000
SHARE = 4
#: Prefixes sent at once, words that a task counts at once, distinct words it numbers, and bytes of a text that it reads at once.
PREFIXES = 2_000
AT_ONCE = 3_000_000
NUMBERED = 1_000_000
SLICE = 1 << 20
_BITS = 21
_MASK = (1 << _BITS) - 1

_TOKEN = re.compile(rb"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+")
_GAP = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"


class _Numbers(dict):
    """Words by number from 1; what ends a piece is 0."""

    def __init__(self):
        super().__init__({bytes([c]): 0 for c in _ENDS})
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        number = self[word] = len(self.words) - 1
        return number


def _slices(text: bytes) -> Iterator[bytes]:
    """Parts of at least ``SLICE`` bytes, cut where no word is."""
    at = 0
    while len(text) - at > SLICE:
        gap = _GAP.search(text, at + SLICE)
        if gap is None:
            break
        yield text[at:gap.start()]
        at = gap.start()
    yield text[at:] if at else text


class _Suffixes:
    """Counts suffixes of streams of words, a stream per language, and gives them away before they outgrow the task."""

    def __init__(self):
        self.numbers = _Numbers()
        self.streams: dict[str, list[np.ndarray]] = {}
        self.held = 0

    def add(self, lang: str, text: bytes) -> Iterator[tuple]:
        stream = self.streams.setdefault(lang, [])
        for part in _slices(text.lower()):
            found = _TOKEN.findall(part)
            if found:
                stream.append(np.fromiter(map(self.numbers.__getitem__, found), dtype=np.int64, count=len(found)))
                self.held += len(found)
            if self.held > AT_ONCE or len(self.numbers) > NUMBERED:
                yield from self.flush(open_lang=lang)
                stream = self.streams.setdefault(lang, [])
        stream.append(np.zeros(1, dtype=np.int64))

    def flush(self, open_lang: str | None = None) -> Iterator[tuple]:
        """(lang, words, codes, counts). The last words of an open stream stay: their suffixes are not whole yet."""
        kept: list[bytes] = []
        for lang, stream in self.streams.items():
            line = np.concatenate(stream) if stream else np.zeros(0, dtype=np.int64)
            stay = line[max(0, len(line) - LONGEST + 1):] if lang == open_lang else line[:0]
            line = np.concatenate([line, np.zeros(LONGEST - 1, dtype=np.int64)]) if lang != open_lang else line
            kept = [self.numbers.words[i] for i in stay] if lang == open_lang else kept
            code = line[:max(0, len(line) - LONGEST + 1)]
            alive, whole = code > 0, code
            for k in range(1, LONGEST):
                word = line[k:k + len(code)]
                alive = alive & (word > 0)
                whole = (whole << _BITS) | np.where(alive, word, 0)
            whole = whole[code > 0]
            if len(whole):
                yield (lang, self.numbers.words, *np.unique(whole, return_counts=True))
        self.streams, self.held = {}, 0
        if len(self.numbers) > NUMBERED:
            self.numbers = _Numbers()
        if kept:
            self.streams[open_lang] = [np.array([self.numbers[w] if w else 0 for w in kept], dtype=np.int64)]


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    of = _Suffixes()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            yield from of.add(lang, text)
    yield from of.flush()


def _rows(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def heavy_prefixes(docs: DataFrame, budget: int = BUDGET) -> tuple[int, list[tuple]]:
    """The number of groups, and the prefixes (lang, first word, second word or empty) that are extended.

    The limit is a share of the budget and of an even group. Each count of a task names what exceeds half the limit's share of it, so a prefix
    that no task names is below the limit.
    """
    least_groups = partitions(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, codes, _ in _leaves(batches):
            share = max(1, min(budget, len(codes) / least_groups) / (2 * SHARE))
            out = [("", "", len(codes))]
            for depth in range(1, LONGEST):
                prefix = codes >> (_BITS * (LONGEST - depth))
                starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
                sizes = np.diff(np.r_[starts, len(codes)])
                for at in np.flatnonzero(sizes >= share):
                    key = int(prefix[starts[at]])
                    parts = [words[(key >> (_BITS * (depth - 1 - i))) & _MASK].decode() for i in range(depth)]
                    if parts[-1]:
                        out.append((parts[0], parts[1] if depth > 1 else "", int(sizes[at])))
            first, second, size = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out)), pa.array(first), pa.array(second), pa.array(size)], ["lang", "first", "second", "leaves"])

    named = _rows(docs).mapInArrow(count, "lang string, first string, second string, leaves long") \
        .groupBy(F.when(F.col("first") != "", F.col("lang")).alias("lang"), "first", "second").agg(F.sum("leaves").alias("leaves"))
    named = cut(named)
    total = named.where("first = ''").agg(F.sum("leaves")).first()[0] or 0
    groups = max(least_groups, -(-total // budget))
    limit = max(1, total / groups / SHARE)
    found = named.where((F.col("first") != "") & (F.col("leaves") >= limit)).collect()
    return groups, [(r["lang"], r["first"], r["second"]) for r in found]


_DEALT = "lang string, w1 string, w2 string, w3 string, tails string, counts array<int>"


def _dealt(docs: DataFrame, heavy: list[tuple]) -> DataFrame:
    """A row per count of a task and prefix: its words (null from where it ends), the rest of each suffix below it, and their numbers."""
    known = docs.sparkSession.sparkContext.broadcast(
        {level: {(lang, *[w.encode() for w in rest[:level]]) for lang, *rest in heavy if bool(rest[1]) == (level > 1)} for level in (1, 2)})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, twos = known.value[1], known.value[2]
        for lang, words, codes, counts in _leaves(batches):
            level = 1 + np.isin(codes >> (2 * _BITS), [i for i in np.unique(codes >> (2 * _BITS)) if (lang, words[i]) in ones]).astype(np.int8)
            if twos:
                pairs = np.unique(codes[level == 2] >> _BITS)
                level += np.isin(codes >> _BITS, [p for p in pairs if (lang, words[p >> _BITS], words[p & _MASK]) in twos]).astype(np.int8)
            text = pa.array(words, type=pa.binary()).cast(pa.string())
            head = codes >> (_BITS * (LONGEST - level))
            starts = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (level[1:] != level[:-1])])
            for first in range(0, len(starts), PREFIXES):
                at = starts[first:first + PREFIXES]
                end = starts[first + PREFIXES] if first + PREFIXES < len(starts) else len(codes)
                part, depth = codes[at[0]:end], level[at[0]:end]
                place = [(part >> (_BITS * k)) & _MASK for k in (2, 1, 0)]
                below = [pc.if_else(pa.array(depth <= k), text.take(pa.array(place[k])), "") for k in (1, 2)]
                tails = pc.binary_join_element_wise(*below, " ")
                offsets = pa.array(np.r_[at, end] - at[0], type=pa.int32())
                columns = [pc.if_else(pa.array(level[at] > k), text.take(pa.array(place[k][at - at[0]])), pa.scalar(None, pa.string())) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at)), text.take(pa.array(place[0][at - at[0]])), *columns, pc.binary_join(pa.ListArray.from_arrays(offsets, tails), "\n"),
                     pa.ListArray.from_arrays(offsets, pa.array(counts[at[0]:end].astype(np.int32)))], ["lang", "w1", "w2", "w3", "tails", "counts"])

    return _rows(docs).mapInArrow(send, _DEALT)


class _Subtree:
    """The leaves below one prefix, by the words that follow it."""

    def __init__(self, lang: str, prefix: tuple[str, ...]):
        self.lang, self.prefix, self.parts, self.total = lang, prefix, [], 0

    def add(self, tails: str, counts: np.ndarray, total: int) -> None:
        self.parts.append((tails, counts))
        self.total += total

    def nodes(self, least: int) -> Iterator[tuple]:
        """(words, total) of the prefix's own node and of all nodes below it that are found often enough."""
        if self.total < least or not self.prefix[-1]:  # a suffix that ends where its prefix is extended has no node of its own
            return
        leaves: dict[str, int] = {}
        for tails, counts in self.parts:
            for tail, n in zip(tails.split("\n"), counts.tolist(), strict=True):
                leaves[tail] = leaves.get(tail, 0) + n
        above: dict[str, int] = {}
        depth = len(self.prefix)
        yield self.prefix, self.total
        for tail, n in leaves.items():
            first, _, second = tail.strip(" ").partition(" ")
            if first:
                above[first] = above.get(first, 0) + n
                if second and n >= least:
                    yield (*self.prefix, first, second), n
        if depth < LONGEST:
            for first, n in above.items():
                if n >= least:
                    yield (*self.prefix, first), n


def _totals(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Totals of nodes from prefixes in order, one prefix in memory at a time; nodes above extended prefixes as far as this group goes."""
    shared: dict[tuple, int] = {}
    out: list[tuple] = []
    tree: _Subtree | None = None

    def close() -> None:
        if tree is None:
            return
        for depth in range(1, len(tree.prefix)):
            key = (tree.lang, *tree.prefix[:depth], *[""] * (LONGEST - depth))
            shared[key] = shared.get(key, 0) + tree.total
        out.extend((tree.lang, *words, *[""] * (LONGEST - len(words)), n) for words, n in tree.nodes(least))

    def given(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64() if k == LONGEST + 1 else pa.string()) for k, c in enumerate(columns)], ["lang", "w1", "w2", "w3", "a"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i) if i < 2 else pc.fill_null(batch.column(i), "\n") for i in range(4)]  # no word has a line's end
        counts = batch.column(5)
        offsets = counts.offsets.to_numpy() - counts.offsets[0].as_py()
        flat = counts.flatten().to_numpy()
        sums = np.add.reduceat(flat.astype(np.int64), offsets[:-1])
        langs = keys[0].dictionary_encode()
        for lang, n in zip(langs.dictionary.to_pylist(), np.bincount(langs.indices.to_numpy(), weights=sums), strict=True):
            shared[(lang, *[""] * LONGEST)] = shared.get((lang, *[""] * LONGEST), 0) + int(n)
        new = np.zeros(batch.num_rows, dtype=bool)
        for column in keys:
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        new[0] = True
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], batch.num_rows]
        # whole prefixes that are found too seldom for any node end here; the first and last may go on in other batches
        seen = np.add.reduceat(sums, starts) >= least
        seen |= pc.not_equal(keys[2], "\n").to_numpy(zero_copy_only=False)[starts]
        seen[[0, -1]] = True
        for at, end in zip(starts[seen].tolist(), ends[seen].tolist(), strict=True):
            lang, *words = (c[at].as_py() for c in keys)
            prefix = tuple(w for w in words if w != "\n")
            if tree is None or tree.prefix != prefix or tree.lang != lang:
                close()
                tree = _Subtree(lang, prefix)
            for i in range(at, end):
                tree.add(batch.column(4)[i].as_py(), flat[offsets[i]:offsets[i + 1]], int(sums[i]))
        if out:
            yield given(out)
            out.clear()
    close()
    out += [(*key, n) for key, n in shared.items()]
    if out:
        yield given(out)


def nodes(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> DataFrame:
    """(lang, w1, w2, w3, a): phrases of one to three words found ``least`` times or more; with no word, all words of the language."""
    groups, heavy = heavy_prefixes(docs, budget)
    # a prefix lies in one group; the groups of a task come one prefix after another
    prefixes = _dealt(docs, heavy).repartition(groups, "lang", "w1", "w2", "w3").sortWithinPartitions("w1", "lang", "w2", "w3")
    found = prefixes.mapInArrow(lambda batches: _totals(batches, least), "lang string, w1 string, w2 string, w3 string, a long")
    return found.groupBy("lang", "w1", "w2", "w3").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | (F.col("w1") == ""))


def _score(a: Column, left: Column, right: Column) -> Column:
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    square = (wide[0] * wide[0]).cast("decimal(32,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * square, wide[1] * wide[2])


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    tree = cut(nodes(docs, least, budget))
    words = tree.where("w1 <> '' AND w2 = ''").select("lang", F.col("w1").alias("w"), F.col("a").alias("f"))
    pairs = tree.where("w2 <> '' AND w3 = ''").select("lang", "w1", "w2", "a")
    threes = tree.where("w3 <> ''")

    inside = threes.select("lang", F.explode(F.array(F.struct(F.col("w1").alias("w1"), F.col("w2").alias("w2")), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a") \
        .groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longest"))
    alone = pairs.join(inside, ["lang", "w1", "w2"], "left").where("longest IS NULL OR 100 * CAST(longest AS DECIMAL(38,0)) < 50 * CAST(a AS DECIMAL(38,0))")

    def with_word(df: DataFrame, word: str, name: str) -> DataFrame:
        return df.join(words.select("lang", F.col("w").alias(word), F.col("f").alias(name)), ["lang", word])

    def with_pair(df: DataFrame, first: str, second: str, name: str) -> DataFrame:
        return df.join(pairs.select("lang", F.col("w1").alias(first), F.col("w2").alias(second), F.col("a").alias(name)), ["lang", first, second])

    def cut_at(k: int, left: str, right: str) -> Column:
        return F.struct(_score(F.col("a"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    two = with_word(with_word(alone, "w1", "f1"), "w2", "f2") \
        .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", cut_at(1, "f1", "f2").alias("c"))
    three = with_word(with_word(with_pair(with_pair(threes, "w1", "w2", "f12"), "w2", "w3", "f23"), "w1", "f1"), "w3", "f3") \
        .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(cut_at(1, "f1", "f23"), cut_at(2, "f12", "f3")).alias("c"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.unionByName(three).select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    n = tree.where("w1 = ''").select("lang", F.col("a").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
