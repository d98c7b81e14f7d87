"""Toxicity from the nearest labelled examples.

Texts are TF-IDF vectors over every word of the examples (a bounded, hash-chosen sample of labelled rows; document
frequencies are those of the whole table). Words that tell labelled toxic texts from others (chi-squared over the sample) count in
full, and so do their beginnings; all other words count ``QUIET`` times as much. One pseudo-term stands in every text, so that a
text without any known word has a vector too.

The nearest examples by cosine are found exactly in an inverted index, for many texts at once. Postings of seldom terms are summed outright. Those of
the terms that most examples hold are kept in blocks of examples, as matrices: a block's greatest possible cosine is its greatest sum over
seldom terms and the query's weights times the block's greatest weights; blocks are opened in that order, each for all texts that
need it, until none can reach the k-th best. What reaches it is summed again term by term, so that a result does not depend on the
texts beside it. Ties at the k-th place all vote. Votes are weighted by closeness and by how many labelled
rows an example stands for; a logistic curve fitted to leave-one-out votes of the sample makes them probabilities. The
examples that voted most are returned as evidence.

The index has at most ``PER_CLASS`` examples of each label, so it may be broadcast. Labels outside the training folds are never read.

Cases: null and empty texts have the pseudo-term alone; without labelled rows every score is 0; one label only gives that label's
rate; repeated rows repeat their result; conflicting labels of one id count as toxic; long texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, fields, replace
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwalk.llm.common import cut, in_fold, texts

FOLDS, HELD_OUT = 5, 0
PER_CLASS = 2000
LEAST_DOCS, LEAST_Z = 5, 5.0
QUIET = 0.05
PREFIXES = range(3, 8)
BACKGROUND = 2.0
NEAREST = 25
BLOCK = 64
EVIDENCE = 5
FIRST_BLOCKS = 8
ORDER_TERMS = 12
COMMON = 768  # terms kept as columns of matrices; the others have lists
ROUNDING = 1e-9
REMEMBER_SCORES = 20_000
CHARACTERS, TEXTS = 4_000_000, 20_000  # texts split together
POSTINGS, QUERIES = 2_000_000, 128  # texts compared together

#: (term, count) pairs, as tuples or as rows of an array.
Found = tuple[tuple[int, int], ...] | np.ndarray

_WORD = re.compile(r"[^\W\d_]+")
#: UTF-8 bytes with every ASCII byte but the letters blanked.
_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def letters_of(text: str) -> bytes:
    """The words of the lower-cased text, as ``_WORD`` finds them, between blanks; a pattern is needed only where other scripts bring more than letters."""
    text = text.lower()
    plain = text.encode("utf-8", "surrogatepass").translate(_LETTERS)
    if plain.isascii() or plain.decode("utf-8", "surrogatepass").replace(" ", "").isalpha():
        return plain
    return " ".join(_WORD.findall(text)).encode("utf-8", "surrogatepass")


def words_of(text: str) -> list[str]:
    return letters_of(text).decode("utf-8", "surrogatepass").split()


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings (marked)."""
    return [word, *[word[:k] + "*" for k in PREFIXES if k <= len(word)]]


def _groups(sizes: Sequence[int], budget: int, most: int) -> Iterator[slice]:
    """Runs of at most ``most`` items that sum to no more than the budget, or have one item."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > budget or i - start == most):
            yield slice(start, i)
            start, total = i, 0
        total += size
    if len(sizes):
        yield slice(start, len(sizes))


class Terms:
    """Counts of the indexed terms. Texts are taken together, and each of their distinct words is looked up once."""

    def __init__(self, chosen: list[str]):
        self.at = {t: i for i, t in enumerate(chosen)}
        encoded = [t.encode("utf-8", "surrogatepass") for t in chosen]
        self.chosen = pa.array([t + b" " for t in encoded], pa.large_binary())
        self.starts = pa.array({t[:PREFIXES.start] for t in encoded if t.endswith(b"*")}, pa.large_binary())

    def __call__(self, text: str) -> tuple[tuple[int, int], ...]:
        return tuple(map(tuple, self.table(text).tolist()))

    def table(self, text: str) -> np.ndarray:
        """Rows (term, count) in the order of terms."""
        return np.stack(self.counted([text])[1:], 1)

    def held(self, text: str) -> np.ndarray:
        """The terms of a text without their counts."""
        return self.counted([text])[1]

    def tables(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """The table of every text."""
        for part in _groups(list(map(len, texts)), CHARACTERS, TEXTS):
            row, term, times = self.counted(texts[part])
            yield from np.split(np.stack([term, times], 1), np.searchsorted(row, np.arange(1, part.stop - part.start)))

    def counted(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) as columns, in the order of texts and terms."""
        own = list(map(letters_of, texts))
        signs = np.frombuffer(b" ".join([b"", *own, b""]), np.uint8)
        blank = signs == 32
        end = (blank[1:] > blank[:-1]).nonzero()[0] + 1  # a blank stays behind each word, the others go
        blank[end] = False
        kept = signs[~blank]
        at = np.concatenate([[0], (kept == 32).nonzero()[0] + 1])
        words = pa.Array.from_buffers(pa.large_binary(), len(end), [None, pa.py_buffer(at), pa.py_buffer(kept)]).dictionary_encode()
        places = end.searchsorted(np.array([0, *map(len, own)]).cumsum() + np.arange(1, len(own) + 2))
        code = words.indices.to_numpy()
        first, n, ids = self.found(words.dictionary)
        first, n = first[code], n[code]
        key = (np.arange(len(own)) * len(self.at)).repeat(places[1:] - places[:-1]).repeat(n) + ids[_ranges(first, n)]
        key.sort()
        new = np.concatenate([[True], key[1:] != key[:-1], [True]]).nonzero()[0] if len(key) else np.zeros(1, int)
        row, term = np.divmod(key[new[:-1]], max(len(self.at), 1))
        return row, term, new[1:] - new[:-1]

    def found(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The i-th word (a blank behind each) has ``n[i]`` terms, in ``ids`` from ``first[i]`` on."""
        own = pc.index_in(words, self.chosen).fill_null(-1).to_numpy()
        near = pc.is_in(pc.binary_slice(words, 0, PREFIXES.start), self.starts).to_numpy(zero_copy_only=False).nonzero()[0]
        near_words = [w[:-1].decode("utf-8", "surrogatepass") for w in words.take(pa.array(near)).to_pylist()]
        more = [(i, self.at[t]) for i, w in zip(near.tolist(), near_words, strict=True) for t in terms_of(w)[1:] if t in self.at]
        more = np.array(more, dtype=np.int64).reshape(-1, 2)
        plain = (own >= 0).nonzero()[0]
        word, ids = np.concatenate([plain, more[:, 0]]), np.concatenate([own[plain], more[:, 1]])
        n = np.bincount(word, minlength=len(words))
        return n.cumsum() - n, n, ids[word.argsort(kind="stable")]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one range behind the other."""
    end = length.cumsum()
    return (start - end + length).repeat(length) + np.arange(end[-1] if len(end) else 0)


@dataclass
class Index:
    """Postings of the examples. ``votes`` are the rows each example stands for, ``share`` what a term counts.

    The terms of example i are ``term[first[i]:first[i + 1]]``, with their counts; ``vectors[i]`` holds them and the pseudo-term, with weights of
    unit length. A common term has a ``column`` of ``dense``, whose greatest entries in each block are ``top``; the postings of
    another lie from ``starts`` on, ``sizes`` of them, by example.
    """

    ids: np.ndarray
    toxic: np.ndarray
    votes: np.ndarray
    idf: np.ndarray
    share: np.ndarray
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray
    curve: tuple[float, float] = (0.0, 1.0)
    vectors: list[tuple[np.ndarray, np.ndarray]] = field(init=False)
    column: np.ndarray = field(init=False)
    dense: np.ndarray = field(init=False)
    top: np.ndarray = field(init=False)
    example: np.ndarray = field(init=False)
    weight: np.ndarray = field(init=False)
    starts: np.ndarray = field(init=False)
    sizes: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n, pseudo = len(self.ids), len(self.idf)
        example = np.r_[np.repeat(np.arange(n), np.diff(self.first)), np.arange(n)]
        term = np.r_[self.term, np.full(n, pseudo)].astype(np.int64)
        weight = np.r_[self._weights(self.term, self.times), np.full(n, BACKGROUND)]
        weight /= np.sqrt(np.bincount(example, weight * weight, minlength=n))[example]
        order = np.argsort(example, kind="stable")
        ends = (self.first[1:] + np.arange(1, n + 1))[:-1]
        self.vectors = list(zip(np.split(term[order], ends), np.split(weight[order], ends), strict=True)) if n else []
        postings = np.bincount(term, minlength=pseudo + 1)
        common = np.argsort(-postings, kind="stable")[:COMMON]
        common = common[postings[common] * BLOCK > n]  # more than one in a block
        self.column = np.full(pseudo + 1, -1)
        self.column[common] = np.arange(len(common))
        at = self.column[term]
        self.dense = np.zeros((n, len(common)))
        self.dense[example[at >= 0], at[at >= 0]] = weight[at >= 0]
        self.top = np.maximum.reduceat(self.dense, np.arange(0, n, BLOCK)).T if n else self.dense.T
        seldom = np.flatnonzero(at < 0)
        seldom = seldom[np.lexsort((example[seldom], term[seldom]))]
        self.example, self.weight = example[seldom], weight[seldom]
        self.sizes = np.where(self.column < 0, postings, 0)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __getstate__(self) -> dict:
        """Postings are made again where an index arrives; they are several times as large."""
        return {f.name: getattr(self, f.name) for f in fields(self) if f.init}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    @property
    def examples(self) -> list[tuple[tuple[int, int], ...]]:
        return [tuple(map(tuple, self.found(i).tolist())) for i in range(len(self.ids))]

    def found(self, i: int) -> np.ndarray:
        part = slice(self.first[i], self.first[i + 1])
        return np.stack([self.term[part], self.times[part]], 1)

    def _weights(self, at: np.ndarray, times: np.ndarray) -> np.ndarray:
        return (1 + np.log(times)) * self.idf[at] * self.share[at]

    def vector(self, found: Found) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of unit length; the pseudo-term is the last."""
        pairs = np.asarray(found, dtype=np.int64).reshape(-1, 2)
        at, weight = np.r_[pairs[:, 0], len(self.idf)], np.r_[self._weights(pairs[:, 0], pairs[:, 1]), BACKGROUND]
        return at, weight / np.linalg.norm(weight)

    def nearest(self, found: Found, without: int = -1, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples and all that tie with the last, with their cosines."""
        return next(self.nearest_of([np.asarray(found, dtype=np.int64).reshape(-1, 2)], [without], k))

    def nearest_of(self, found: Sequence[np.ndarray], without: Sequence[int] | None = None, k: int = NEAREST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The nearest of every table; example ``without[i]`` is left out of the i-th answer."""
        without = np.full(len(found), -1) if without is None else np.asarray(without)
        sizes = [int(self.sizes[pairs[:, 0]].sum()) for pairs in found]
        query = np.zeros(len(self.idf) + 1)
        for part in _groups(sizes, POSTINGS, QUERIES):
            vectors = [self.vector(pairs) for pairs in found[part]]
            reached = self._reached(vectors, without[part], k)
            for (at, weight), near in zip(vectors, reached, strict=True):
                query[at] = weight
                own = [self.vectors[i] for i in near.tolist()]
                cosine = query[np.concatenate([t for t, _ in own])] * np.concatenate([w for _, w in own]) if own else np.zeros(0)
                score = np.bincount(np.repeat(np.arange(len(own)), [len(t) for t, _ in own]), cosine, minlength=len(own))
                query[at] = 0
                if len(self.ids) > k:
                    last = score >= np.partition(score, -k)[-k] - ROUNDING
                    near, score = near[last], score[last]
                order = np.lexsort((self.ids[near], -score))
                yield near[order], score[order]

    def _reached(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: np.ndarray, k: int) -> list[np.ndarray]:
        """For each vector the examples that may be among its nearest, up to rounding."""
        m, n = len(vectors), len(self.ids)
        row = np.repeat(np.arange(m), [len(at) for at, _ in vectors])
        at, weight = np.concatenate([a for a, _ in vectors]), np.concatenate([w for _, w in vectors])
        column = self.column[at]
        query = np.zeros((m, len(self.top)))
        query[row[column >= 0], column[column >= 0]] = weight[column >= 0]
        seldom = self.sizes[at] > 0
        size = self.sizes[at[seldom]]
        posting = _ranges(self.starts[at[seldom]], size)
        cosine = np.bincount(np.repeat(row[seldom] * n, size) + self.example[posting], np.repeat(weight[seldom], size) * self.weight[posting],
                             minlength=m * n).reshape(m, n)
        bound = np.maximum.reduceat(cosine, np.arange(0, n, BLOCK), axis=1) + query @ self.top
        order = np.argsort(-bound, axis=1, kind="stable")
        score = np.full((m, bound.shape[1], BLOCK), -1.0)
        best = np.full((m, k), -1.0)
        left_out = np.flatnonzero(without >= 0)
        done, step = 0, FIRST_BLOCKS
        while True:
            next_ = order[:, done:done + step]
            wanted = np.zeros(bound.shape, bool)
            np.put_along_axis(wanted, next_, np.take_along_axis(bound, next_, 1) >= best.min(axis=1, keepdims=True) - 2 * ROUNDING, 1)
            rows = np.flatnonzero(wanted.any(axis=1))
            if not len(rows):
                break
            for block in np.flatnonzero(wanted.any(axis=0)).tolist():
                own, part = np.flatnonzero(wanted[:, block]), slice(block * BLOCK, min((block + 1) * BLOCK, n))
                score[own, block, :part.stop - part.start] = cosine[own, part] + query[own] @ self.dense[part].T
            score.reshape(m, -1)[left_out, without[left_out]] = -1.0
            seen = np.concatenate([best[rows], score[rows[:, None], next_[rows]].reshape(len(rows), -1)], axis=1)
            best[rows] = np.partition(seen, -k, axis=1)[:, -k:]
            done, step = done + step, 2 * step
        score, least = score.reshape(m, -1), best.min(axis=1)
        near, example = np.nonzero((score >= 0) & (score >= least[:, None] - 2 * ROUNDING))
        return np.split(example, np.searchsorted(near, np.arange(1, m)))

    def votes_of(self, found: Sequence[np.ndarray], without: Sequence[int] | None = None) -> Iterator[tuple[float, list[int]]]:
        """The weighted share of toxic examples among the nearest, and the ids that weigh most for the outcome, for every table."""
        for where, cosine in self.nearest_of(found, without):
            if not len(where):
                yield 0.0, []
                continue
            weight = self.votes[where] / (1.02 - np.minimum(cosine, 1.0))
            toxic = self.toxic[where]
            share = float((weight * toxic).sum() / weight.sum())
            side = toxic == (share >= 0.5)
            yield share, self.ids[where[side][:EVIDENCE]].tolist()

    def scores(self, found: Sequence[np.ndarray]) -> Iterator[tuple[float, list[int]]]:
        if not len(self.ids):
            return repeat((0.0, []), len(found))
        return ((_probability(share, self.curve), evidence) for share, evidence in self.votes_of(found))


def calibrated(spark: SparkSession, index: Index) -> Index:
    """The index with a curve fitted to the leave-one-out votes of its examples, weighted like the votes."""
    if not len(index.ids) or index.toxic.all() or not index.toxic.any():
        return index
    shared = spark.sparkContext.broadcast(index)

    def leave_one_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            i = batch["id"].tolist()
            yield pd.DataFrame({"i": i, "vote": [share for share, _ in shared.value.votes_of(list(map(shared.value.found, i)), i)]})

    votes = spark.range(len(index.ids)).mapInPandas(leave_one_out, "i long, vote double").toPandas().sort_values("i")["vote"].to_numpy()
    shared.destroy()
    curve = _fit_curve(_logit(votes), index.toxic.astype(float), index.votes / index.votes.sum())
    return replace(index, curve=curve)


def _logit(share: np.ndarray) -> np.ndarray:
    p = np.clip(share, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _probability(share: float, curve: tuple[float, float]) -> float:
    a, b = curve
    return float(1 / (1 + np.exp(-(a + b * _logit(np.array(share))))))


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton steps for a + b x, held near (0, 1)."""
    a, b = 0.0, 1.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a + b * x)))
        r, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        grad = np.array([r.sum() + 1e-3 * a, (r * x).sum() + 1e-3 * (b - 1)])
        hess = np.array([[h.sum() + 1e-3, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
    return float(a), float(max(b, 0.1))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text) of the examples, and the number of training rows of each label."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), FOLDS, HELD_OUT)) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    least = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in sorted(totals)]
    picked = reduce(DataFrame.unionByName, least, known.limit(0))
    return texts(docs).join(F.broadcast(picked), "doc_id"), totals


def _associations(examples: DataFrame) -> DataFrame:
    """(term, n, n_toxic): examples that hold a term, summed in each task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        toxic: Counter[str] = Counter()
        for batch in batches:
            for text, y in zip(batch["text"], batch["toxic"], strict=True):
                own = {t for w in set(words_of(text)) for t in terms_of(w)}
                n.update(own)
                if y:
                    toxic.update(own)
        if n:
            yield pd.DataFrame({"term": list(n), "n": list(n.values()), "n_toxic": [toxic[t] for t in n]})

    return examples.mapInPandas(count, "term string, n long, n_toxic long") \
        .groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def _idf(docs: DataFrame, chosen: list[str]) -> np.ndarray:
    """Inverse document frequencies over all rows of ``docs``, summed in each task first."""
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms(shared.value)
        n = np.zeros(len(shared.value) + 1, dtype=np.int64)
        for batch in batches:
            texts_ = batch["text"].tolist()
            for part in _groups(list(map(len, texts_)), CHARACTERS, TEXTS):
                n += np.bincount(terms.counted(texts_[part])[1], minlength=len(n))
            n[-1] += len(batch)
        held = np.flatnonzero(n)
        yield pd.DataFrame({"at": held, "n": n[held]})

    held = np.zeros(len(chosen) + 1)
    for row in texts(docs).select("text").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        held[row["at"]] = row["n"]
    shared.destroy()
    return np.log(1 + held[-1] / np.maximum(held[:-1], 1))


def build(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[str], Index]:
    """The indexed terms and the calibrated index."""
    examples, totals = sample(docs, labels, per_class)
    examples = cut(examples)
    sizes = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n, n_toxic = sum(sizes.values()), sizes.get(1, 0)
    rate = n_toxic / n if n else 0.0
    chosen: list[str] = []
    idf = share = np.zeros(0)
    if 0 < rate < 1:
        spread = F.sqrt(F.col("n") * rate * (1 - rate) * (1 - F.col("n") / n) + 1e-9)
        z = F.abs(F.col("n_toxic") - F.col("n") * rate) / spread
        terms = _associations(examples).select("term", ((F.col("n") >= LEAST_DOCS) & (z >= LEAST_Z)).alias("tells")) \
            .where(F.col("tells") | ~F.col("term").endswith("*")).orderBy("term").toPandas()  # the words of the examples
        chosen = terms["term"].tolist()
        share = np.where(terms["tells"], 1.0, QUIET)
        idf = _idf(docs, chosen)
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms(shared.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"],
                                "found": [t.ravel() for t in terms.tables(batch["text"].tolist())]})

    rows = examples.mapInPandas(vectors, "doc_id long, toxic int, found array<int>").collect()
    shared.destroy()
    pairs = [np.array(r["found"], dtype=np.int64).reshape(-1, 2) for r in rows]
    telling = [[t for t in p[:, 0].tolist() if share[t] == 1.0] for p in pairs]
    common = np.argsort(-np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *[p[:, 0] for p in pairs]])), kind="stable")[:ORDER_TERMS]
    order = sorted(range(len(rows)), key=lambda i: (telling[i], (~np.isin(common, pairs[i][:, 0])).tolist(), len(pairs[i]),
                                                    rows[i]["doc_id"], pairs[i].tolist()))  # like beside like, so that few blocks are opened
    toxic = np.array([rows[i]["toxic"] for i in order], dtype=np.int64)
    votes = np.array([totals[y] / sizes[y] for y in toxic.tolist()])
    flat = np.concatenate([np.zeros((0, 2), dtype=np.int64), *[pairs[i] for i in order]])
    first = np.cumsum([0, *[len(pairs[i]) for i in order]])
    index = Index(np.array([rows[i]["doc_id"] for i in order], dtype=np.int64), toxic, votes, idf, share, first,
                  flat[:, 0].astype(np.int32), flat[:, 1].astype(np.int32))
    return chosen, calibrated(docs.sparkSession, index)


def scored(docs: DataFrame, chosen: list[str], index: Index) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), one row per row of ``docs``; only the text is read for a score."""
    shared = docs.sparkSession.sparkContext.broadcast((chosen, index))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chosen_, index_ = shared.value
        terms, known = Terms(chosen_), {}
        for batch in batches:
            out, texts_ = [], batch["text"].tolist()
            for part in _groups(list(map(len, texts_)), CHARACTERS, TEXTS):
                found = list(terms.tables(texts_[part]))
                keys = [xxhash.xxh3_128_digest(t.tobytes()) for t in found]
                new = {key: t for key, t in zip(keys, found, strict=True) if key not in known}
                known.update(zip(new, index_.scores(list(new.values())), strict=True))
                out += [known[key] for key in keys]
                if len(known) > REMEMBER_SCORES:
                    known.clear()
            score = np.array([s for s, _ in out])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": score,
                                "predicted": (score >= 0.5).astype("int32"), "evidence": [e for _, e in out]})

    rows = texts(docs).select("doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")
