import collections
import random
import re

import pytest

from blockwalk.llm import collocations
from llm.conftest import documents

PIECE, WORD = re.compile("[.,;:!?\x0a-\x0d]"), re.compile("[^\x20\x09]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=2000):
    n, found = collections.Counter(), collections.defaultdict(collections.Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split((text or "").translate(LOWER)):
            words = WORD.findall(piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    found[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, f in found.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in held.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * held[q]}
        ranked = []
        for p in held.keys() - gone:
            score, _, left, right = min((1_000_000 * held[p] ** 2 // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -held[p], " ".join(p).encode(), left, right))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def texts(seed, n=400):
    pick = random.Random(seed)
    words = ["the", "The", "of", "New", "York", "city", "é", "\x01a", "a", "a\x01", "z" * 40, "É"] + [f"w{i}" for i in range(30)]
    for _ in range(n):
        parts = [pick.choice(words) if pick.random() < 0.7 else "the new york city" for _ in range(pick.randrange(60))]
        yield "".join(p + pick.choice([" ", " ", "  ", "\t", ", ", "\n", ".", "!? "]) for p in parts), pick.choice(["en", "de", None, "", "x y"])


@pytest.mark.parametrize(("budget", "at_once", "numbered", "part"), [(1_000_000, 3_000_000, 1_000_000, 1 << 20), (60, 50, 20, 64)])
def test_counts_and_ranks(spark, monkeypatch, budget, at_once, numbered, part):
    """Whatever is extended, dealt, sliced or given away early, counts are those of the plain count."""
    for name, value in (("AT_ONCE", at_once), ("NUMBERED", numbered), ("SLICE", part)):
        monkeypatch.setattr(collocations, name, value)
    rows = [*texts(1), ("the new york city " * 700, "en"), ("x" * 500, "de")]
    docs = documents(spark, [(i, t, lang, "s", 1) for i, (t, lang) in enumerate(rows)]).repartition(3)
    # the tasks get the values of this process only through the functions under test, so they are checked here too
    flushed = collections.Counter()
    of = collocations._Suffixes()
    for text, lang in rows:
        for key, words, codes, counts in of.add("und" if lang is None else lang, text.encode()):
            flushed.update({(key, *[words[(int(c) >> s) & collocations._MASK] for s in (42, 21, 0)]): int(k) for c, k in zip(codes, counts, strict=True)})
    for key, words, codes, counts in of.flush():
        flushed.update({(key, *[words[(int(c) >> s) & collocations._MASK] for s in (42, 21, 0)]): int(k) for c, k in zip(codes, counts, strict=True)})
    want = collections.Counter()
    for text, lang in rows:
        for piece in PIECE.split(text.translate(LOWER)):
            w = [x.encode() for x in WORD.findall(piece)] + [b"", b""]
            want.update(("und" if lang is None else lang, *w[i:i + 3]) for i in range(len(w) - 2))
    assert flushed == want
    if budget < 1000:
        assert collocations.heavy_prefixes(docs, budget)[1]
    got = sorted(tuple(r) for r in collocations.collocations(docs, budget=budget).collect())
    assert got == brute(rows) and got
    few = sorted(tuple(r) for r in collocations.collocations(docs, top=3, budget=budget).collect())
    assert few == brute(rows, top=3)


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a = 3_000_000_007
    row = spark.range(1).select(collocations._score(F.lit(a), F.lit(a + 1), F.lit(a + 5)).alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // ((a + 1) * (a + 5))


def test_ties_go_to_the_first_cut(spark):
    rows = [(i, "p q r", "en", "s", 1) for i in range(12)] + [(50 + i, "p, q, r", "en", "s", 1) for i in range(3)]
    got = collocations.collocations(documents(spark, rows)).collect()
    assert [tuple(r) for r in got] == brute([(t, lang) for _, t, lang, _, _ in rows])


def test_odd_and_empty_tables(odd, nothing):
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    assert sorted(tuple(r) for r in collocations.collocations(odd).collect()) == brute(rows)
    got = collocations.collocations(nothing)
    assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
