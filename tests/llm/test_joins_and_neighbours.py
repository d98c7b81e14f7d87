import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwalk.llm import jaccard_pruning as J
from blockwalk.llm import links, sparse_suffix, toxic_neighbours
from blockwalk.llm.words import shingles, windows, word_hashes
from llm.conftest import by_id, documents


def roots_of(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {i: find(i) for i in ids}


def brute_classes(texts):
    sets = {i: set(shingles(t).tolist()) for i, t in texts.items()}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = roots_of(texts, pairs)
    return {i: (root[i], sum(i in p for p in pairs)) for i in texts}


@pytest.fixture(scope="module")
def near(words):
    rnd = random.Random(8)
    texts = {}
    for g in range(12):
        base = rnd.choices(words, k=rnd.randint(40, 300))
        for _ in range(rnd.randint(1, 9)):
            own = list(base)
            for _ in range(rnd.randint(0, len(own) // 40)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            texts[len(texts)] = " ".join(own)
    base = rnd.choices(words, k=120)
    for i in range(150):  # a group over several blocks
        own = list(base)
        own[rnd.randrange(120)] = f"edit{i}"
        texts[1000 + i] = " ".join(own)
    texts[2000] = texts[1000]
    return texts


def test_classes_against_all_pairs(spark, near, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 40)
    got = by_id(J.classes(documents(spark, list(near.items()))), "class_id", "n_links")
    assert got == brute_classes(near)


def test_pruning_rule():
    fewest = J.least_matches(0.8, 1e-5)
    assert len(fewest) == J.VALUES // J.STEP and all(a <= b for a, b in itertools.pairwise(fewest))
    for step, m in enumerate(fewest):
        n = (step + 1) * J.STEP
        assert J.reach(m, n) >= 1e-5 and (m == 0 or J.reach(m - 1, n) < 1e-5)


def test_pruning_loses_less_than_the_bands():
    s = J.THRESHOLD
    step = [math.comb(J.STEP, k) * s**k * (1 - s) ** (J.STEP - k) for k in range(J.STEP + 1)]
    chance, lost = np.array([1.0]), 0.0
    for least in J.least_matches(s, J.TOLERANCE):
        chance = np.convolve(chance, step)
        lost += chance[:least].sum()
        chance[:least] = 0
    assert lost < (1 - s**J.ROWS) ** J.BANDS


def test_minhash_estimates(words):
    a = set(range(4000))
    for share in (0.3, 0.8):
        k = int(4000 * 2 * share / (1 + share))
        x = np.random.default_rng(1).integers(0, 2**63, 8000, dtype=np.uint64)
        one, two = np.frombuffer(J.minhash(x[:4000]), np.uint8), np.frombuffer(J.minhash(x[4000 - k:8000 - k]), np.uint8)
        assert abs((one == two).mean() - share) < 0.12
    assert a


def test_jaccard_odd_rows(odd, nothing):
    rows = J.classes(odd).collect()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows if r["doc_id"] is not None}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 1), 7: (6, 1), 8: (8, 0), 9: (9, 0), 10: (10, 0)}
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert J.kept_rows(odd).columns == odd.columns
    assert J.classes(nothing).count() == 0 and J.kept_rows(nothing).count() == 0


def test_near_stage_drops_rows_not_ids(spark, words):
    rnd = random.Random(3)
    text = [" ".join(rnd.choices(words, k=60)) for _ in range(5)]
    big = 2**53 + 1
    rows = [(5, text[0]), (7, text[0] + " tail"), (7, text[1]), (None, text[0] + " end"), (None, text[2]), (None, text[2] + " end"), (None, text[3]),
            (None, ""), (big, text[4]), (big + 1, text[4] + " tail"), (None, None), (8, text[1] + " tail")]
    got = J.kept_rows(documents(spark, rows).withColumn("body_id", F.lit("clash"))).collect()
    kept = {(r["doc_id"], r["text"]) for r in got}
    twins = {(None, text[2]), (None, text[2] + " end")}
    assert len(kept & twins) == 1
    assert kept - twins == {(5, text[0]), (7, text[1]), (None, text[3]), (None, ""), (None, None), (big, text[4])} and len(got) == 7


def test_near_stage_against_all_pairs(spark, near, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 40)
    kept = {r["doc_id"] for r in J.kept_rows(documents(spark, list(near.items()))).collect()}
    assert kept == {i for i, (root, _) in brute_classes(near).items() if root == i}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rnd = random.Random(4)
    ids = list(range(400))
    pairs = {"chain": list(itertools.pairwise(rnd.sample(ids, 300))), "star": [(7, i) for i in range(8, 300)], "none": [],
             "random": [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)]}[shape]
    got = {r["id"]: r["root"] for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots_of(ids, pairs)
    assert got == {i: want[i] for i in {x for a, b in pairs if a != b for x in (a, b)}}


def test_windows():
    h = word_hashes("a b c a b c d")
    for k in (1, 2, 3, 4, 7):
        w = windows(h, k)
        assert len(w) == 8 - k
    assert windows(h, 3)[0] == windows(h, 3)[3] != windows(h, 3)[1] and len(windows(h, 8)) == 0
    assert len(shingles("a b")) == 1 and len(shingles("")) == 0


def brute_spans(texts):
    wins = {i: [tuple(t.split()[a:a + 51]) for a in range(len(t.split()) - 50)] for i, t in texts.items()}
    holders = {}
    for i, ws in wins.items():
        for w in ws:
            holders.setdefault(w, set()).add(i)

    def spans(starts):
        out = []
        for s in starts:
            if out and s <= out[-1][1]:
                out[-1][1] = s + 51
            else:
                out.append([s, s + 51])
        return out

    return {i: (spans([a for a, w in enumerate(ws) if len(holders[w]) > 1]), spans([a for a, w in enumerate(ws) if min(holders[w]) < i]))
            for i, ws in wins.items()}


def test_passages_against_brute_force(spark, words):
    rnd = random.Random(9)
    passage = [rnd.choices(words, k=n) for n in (50, 51, 52, 80, 300)]
    texts = {}
    for i in range(120):
        own = rnd.choices(words, k=rnd.randint(0, 120))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passage)
            cut = rnd.choice([p, p, p[rnd.randrange(5):], p[:len(p) - rnd.randrange(5)]])
            at = rnd.randint(0, len(own))
            own[at:at] = cut
        texts[i] = " ".join(own)
    texts[200] = " ".join(["same"] * 300)
    texts[201] = " ".join(["same"] * 200)
    got = {r["doc_id"]: ([list(s) for s in r["spans"]], [list(s) for s in r["cut_spans"]]) for r in
           sparse_suffix.repeats(documents(spark, list(texts.items()))).collect()}
    want = brute_spans(texts)
    assert got == {i: tuple(v) for i, v in want.items()}
    assert any(v[0] for v in want.values())


def test_without():
    assert sparse_suffix.without("a b  c d\ne", [[1, 3]]) == "a d\ne"
    assert sparse_suffix.without("a b", [[0, 2]]) == "" and sparse_suffix.without("", []) == ""


def test_suffix_odd_rows(odd, nothing):
    rows = sparse_suffix.repeats(odd).collect()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == len(got) + 2 and sorted(got) == list(range(1, 11))
    assert [list(s) for s in got[6]["spans"]] == [[0, 120_000]] and [list(s) for s in got[7]["cut_spans"]] == [[0, 120_000]]
    assert got[6]["cut_spans"] == [] and got[6]["partners"] == [7] and got[1]["n_repeated"] == 0
    assert sparse_suffix.repeats(nothing).count() == 0


@pytest.fixture(scope="module")
def labelled(spark, words):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        own = rnd.choices(words[:900], k=rnd.randint(30, 90))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rnd.randint(2, 5)):
                own.insert(rnd.randrange(len(own)), rnd.choice(["vile", "grossling", "grossly", "scorn"]))
        elif i % 11 == 0:
            own.append("scorn")
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_held_out(labelled):
    docs, labels = labelled
    got = toxic_neighbours.scored(docs, *toxic_neighbours.build(docs, labels)).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 900 and np.mean([(r["doc_id"] % 6 == 0) == bool(r["predicted"]) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and len(r["evidence"]) <= 5 for r in got)


def test_held_out_labels_are_never_read(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxic_neighbours.build(docs, labels), toxic_neighbours.build(docs, flipped)
    assert one[0] == two[0] and one[1].curve == two[1].curve and (one[1].ids == two[1].ids).all()


def test_document_frequencies_are_of_the_whole_table(labelled):
    docs, labels = labelled
    more = docs.unionByName(docs.selectExpr("doc_id + 100000 AS doc_id", "'vile words' AS text", "lang", "source", "n_chars"))
    chosen, index = toxic_neighbours.build(more, labels)
    held = sum("vile" in r["text"].split() for r in more.collect())
    assert np.isclose(index.idf[chosen.index("vile")], np.log(1 + 1800 / held)) and held > 900


def test_every_word_of_the_examples_is_indexed(labelled):
    docs, labels = labelled
    chosen, index = toxic_neighbours.build(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    held = {w for i in index.ids.tolist() for w in toxic_neighbours._WORD.findall(text[i])}
    assert held == {t for t in chosen if not t.endswith("*")}
    assert index.share[chosen.index("vile")] == 1.0 and index.share[chosen.index("w")] == toxic_neighbours.QUIET
    assert all(np.isclose(index.nearest(e)[1][0], 1.0) for e in index.examples[:50])


def test_nearest_is_exact(labelled):
    docs, labels = labelled
    chosen, index = toxic_neighbours.build(docs, labels)
    dense = np.zeros((len(index.ids), len(index.idf) + 1))
    for i, e in enumerate(index.examples):
        at, w = index.vector(e)
        dense[i, at] = w
    terms = toxic_neighbours.Terms(chosen)
    for text in ["", "vile", "scorn scorn grossling w1", "vile grossly w3 w4", " ".join(["vile"] * 50)]:
        at, w = index.vector(terms(text))
        cosine = dense[:, at] @ w
        where, got = index.nearest(terms(text))
        last = np.sort(cosine)[-toxic_neighbours.NEAREST]
        assert set(where.tolist()) == set(np.flatnonzero(cosine >= last - 1e-9).tolist()) and np.allclose(got, cosine[where])


def test_toxic_odd_rows(spark, odd, nothing, labelled):
    docs, labels = labelled
    built = toxic_neighbours.build(docs, labels)
    assert toxic_neighbours.scored(odd, *built).count() == odd.count() and toxic_neighbours.scored(nothing, *built).count() == 0
    none = labels.limit(0)
    assert {r["score"] for r in toxic_neighbours.scored(odd, *toxic_neighbours.build(docs, none)).collect()} == {0.0}
    one = labels.where("toxic = 0")
    assert {r["predicted"] for r in toxic_neighbours.scored(odd, *toxic_neighbours.build(docs, one)).collect()} == {0}
    twice = labels.unionByName(labels.withColumn("toxic", F.lit(None).cast("int")))
    assert toxic_neighbours.build(docs, twice)[0] == built[0]
    assert toxic_neighbours.build(odd, labels) is not None


def test_words_are_split_without_a_pattern_where_letters_alone_are_left():
    """Same words and counts as by the pattern, each known word looked up once (before: a step of the interpreter per word)."""
    import sys
    from collections import Counter

    odd = ["", "a_b1c²d Straße", "É́ ß x", "日本 １２ a b", "ǅ İ", "٣a b c", "ﬁn \x00q\x1cr", "kill killer, KILLING hat"]
    split = lambda t: toxic_neighbours._WORD.findall(t.lower())
    assert [toxic_neighbours.words_of(t) for t in odd] == [split(t) for t in odd]
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500))
    terms = toxic_neighbours.Terms(["kill", "kil*", "kill*", "hat", "a", *long.split()])
    for text in (*odd, long):
        want: Counter = Counter()
        for word, n in Counter(split(text)).items():
            want.update({terms.at[t]: n for t in toxic_neighbours.terms_of(word) if t in terms.at})
        for _ in range(2):
            assert terms(text) == tuple(sorted(want.items())) and sorted(terms.held(text).tolist()) == sorted(want)
    lines = [0]

    def count(frame, event, arg):
        lines[0] += event == "line"
        return count

    sys.settrace(count)
    try:
        terms.table(long)
    finally:
        sys.settrace(None)
    assert lines[0] < 200


def test_texts_are_compared_together(labelled, monkeypatch):
    """Many texts at once give what each gives alone, to the last bit, and what all cosines give; unknown words take no steps (before: some ten each)."""
    import sys

    docs, labels = labelled
    chosen, index = toxic_neighbours.build(docs, labels)
    texts = [r["text"] for r in docs.collect()][:200] + ["", "vile", "123 _", "Äß vile scornful", "vile"]
    terms = toxic_neighbours.Terms(chosen)
    tables = list(terms.tables(texts))
    dense = np.zeros((len(index.ids), len(index.idf) + 1))
    for i, e in enumerate(index.examples):
        at, w = index.vector(e)
        dense[i, at] = w
    for common, k in ((0, 25), (5, 1), (768, 25), (768, 2000)):
        monkeypatch.setattr(toxic_neighbours, "COMMON", common)
        own = toxic_neighbours.replace(index)
        without = [i % 3 - 1 for i in range(len(texts))]
        together = list(own.nearest_of(tables, without, k))
        for text, table, (where, got), i in zip(texts, tables, together, without, strict=True):
            assert np.array_equal(table, terms.table(text))
            alone = own.nearest(table, i, k)
            assert np.array_equal(alone[0], where) and np.array_equal(alone[1], got)
            at, w = own.vector(table)
            cosine = dense[:, at] @ w
            if i >= 0:
                cosine[i] = -1
            last = np.sort(cosine)[-k] if len(cosine) > k else 0
            assert set(where.tolist()) == set(np.flatnonzero((cosine >= 0) & (cosine >= last - 1e-9)).tolist()) and np.allclose(got, cosine[where])
    expected = list(index.scores(tables))
    for name in ("CHARACTERS", "TEXTS", "POSTINGS", "QUERIES"):
        monkeypatch.setattr(toxic_neighbours, name, 3)
        assert list(index.scores(list(terms.tables(texts)))) == expected
        monkeypatch.undo()
    lines = [0]

    def count(frame, event, arg):
        lines[0] += event == "line"
        return count

    new = " ".join(f"new{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500))
    sys.settrace(count)
    try:
        found = terms.table(new)
    finally:
        sys.settrace(None)
    assert not len(found) and lines[0] < 200
