"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary classifier per bit, linear over hashed character n-grams of one to three
letters, predicts that bit. Decoding sums each classifier's logistic loss against every codeword, weighted by how
reliable the bit was in training, and takes the nearest codeword. A text whose two nearest codewords are
close is flagged as ambiguous.

Training uses at most ``PER_LANGUAGE`` texts of each language, chosen by hash of the id; their n-gram counts are made by
Spark tasks, and only these counts reach the driver. The model is ``BUCKETS`` by bits, whatever the corpus.
Labels are read from rows outside the held-out fold only.

Cases: a null text, or one without a letter, is ``und`` with score 0; without any training row every text is ``und``; with one language
it is predicted throughout; empty tables give no rows; repeated rows repeat their result; long texts are read in blocks, whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockwalk.llm.common import in_fold, texts

FOLDS, HELD_OUT = 4, 2
PER_LANGUAGE = 500
BUCKETS = 1 << 13
BLOCK = 1 << 18
STEPS = 150
DECAY = 1e-4
AMBIGUOUS = 0.6


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def counts(text: str) -> np.ndarray | None:
    """n-gram counts by bucket; None without a letter. Anything but letters separates words."""
    total, seen = np.zeros(BUCKETS, dtype=np.float32), False
    lower = text.lower()
    for at in range(0, max(len(lower), 1), BLOCK):
        part = lower[max(at - 2, 0):at + BLOCK]  # n-grams across the cut are kept
        codes = np.frombuffer((" " + part + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
        letter = _letters()[codes]
        seen = seen or bool(letter.any())
        codes = np.where(letter, codes, 32).astype(np.uint64)
        codes = codes[np.r_[True, letter[1:] | letter[:-1]]]
        two = codes[:-1] * np.uint64(0x100000001B3) + codes[1:]
        three = two[:-1] * np.uint64(0x100000001B3) + codes[2:]
        grams = np.concatenate([codes, two, three]) * np.uint64(0x9E3779B97F4A7C15)
        total += np.bincount((grams >> np.uint64(64 - 13)).astype(np.int64), minlength=BUCKETS)
    return total if seen else None


def features(found: np.ndarray) -> np.ndarray:
    x = np.sqrt(found)
    return x / np.linalg.norm(x)


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1. Up to seven classes: every split into two sides; beyond: seeded splits, the farthest apart of some draws."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        sides = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1)]
        return np.array([s for s in sides if -1 in s], dtype=float).T
    bits = 10 * int(np.ceil(np.log2(n)))
    draws = (np.random.default_rng(seed).choice((-1.0, 1.0), (n, bits)) for seed in range(50))
    split = [d for d in draws if (np.abs(d.sum(0)) < n).all()]
    return max(split, key=lambda d: min((a != b).sum() for a, b in itertools.combinations(d, 2)))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Per language: the weighted mean of the bits' losses."""
        margins = x @ self.weights + self.bias
        return (np.logaddexp(0, -margins[None, :] * self.codes) * self.trust).sum(1) / max(self.trust.sum(), 1e-9)

    def predict(self, found: np.ndarray | None) -> tuple[str, float, bool]:
        if found is None or not self.languages:
            return "und", 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = self.losses(features(found))
        odds = np.exp(-self.codes.shape[1] * (loss - loss.min()))
        share = odds / odds.sum()
        best = int(np.argmax(share))
        return self.languages[best], float(share[best]), bool(share[best] < AMBIGUOUS)


def fit(found: np.ndarray, langs: list[str]) -> Model:
    """Logistic regression for all bits at once, by accelerated gradient steps; every language weighs the same."""
    languages = sorted(set(langs))
    codes = codewords(len(languages))
    if not codes.shape[1]:
        return Model(languages, codes, np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(0))
    x = np.sqrt(found.astype(np.float32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([languages.index(v) for v in langs])
    target = codes[y].astype(np.float32)
    share = (1 / np.bincount(y))[y].astype(np.float32)[:, None] / len(languages)
    w = ahead = np.zeros((BUCKETS, codes.shape[1]), dtype=np.float32)
    b = np.zeros(codes.shape[1], dtype=np.float32)
    for step in range(STEPS):
        pull = share * target / (1 + np.exp(target * (x @ ahead + b)))
        new = ahead + 4 * (x.T @ pull - DECAY * ahead)
        b = b + 2 * pull.sum(0)
        ahead = new + step / (step + 3) * (new - w)
        w = new
    right = (share * (np.sign(x @ w + b) == target)).sum(0)
    return Model(languages, codes, w, b, np.clip(2 * right - 1, 0.01, 1))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, doc_id, text) of the training texts: the least hashes of each language outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                       & ~in_fold(F.col("doc_id"), FOLDS, HELD_OUT)).select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language) \
        .select("doc_id", "lang").distinct()
    return texts(docs, "lang").join(F.broadcast(picked), ["doc_id", "lang"]).select("lang", "doc_id", "text")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(lang, i, c) for lang, i, t in zip(batch["lang"], batch["doc_id"], batch["text"], strict=True) if (c := counts(t)) is not None]
            yield pd.DataFrame([(lang, i, (at := np.flatnonzero(c)).astype("<i4").tobytes(), c[at].astype("<f4").tobytes()) for lang, i, c in rows],
                               columns=["lang", "doc_id", "at", "n"])

    rows = sample(docs, per_language).mapInPandas(count, "lang string, doc_id long, at binary, n binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"], bytes(r["at"])))
    found = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, r in enumerate(rows):
        found[i, np.frombuffer(bytes(r["at"]), dtype="<i4")] = np.frombuffer(bytes(r["n"]), dtype="<f4")
    return fit(found, [r["lang"] for r in rows])


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), one row per row of ``docs``; only the text is read for a prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            out = [m.predict(counts(t)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"],
                                "lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "ambiguous": [x[2] for x in out]})

    rows = texts(docs).select("doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
