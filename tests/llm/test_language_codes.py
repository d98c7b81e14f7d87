import random
import zlib

import numpy as np
import pytest

from blockwalk.llm import language_codes as L
from blockwalk.llm.queries import op1_language_codes
from llm.conftest import documents

STEMS = {"aa": ["ka", "ro", "ti"], "bb": ["zu", "we", "gho"], "cc": ["lia", "mne", "dor"]}


def prose(rnd, lang, n=60):
    return " ".join("".join(rnd.choice(STEMS[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    rows = [(i, prose(rnd, lang), lang, "s", 0) for i in range(400) for lang in [sorted(STEMS)[i % 3]]]
    return documents(spark, rows)


def test_held_out_accuracy_and_folds(corpus):
    model = L.train(corpus)
    got = {r["doc_id"]: r for r in L.identified(corpus, model).collect()}
    assert model.languages == ["aa", "bb", "cc"] and model.codes.shape == (3, 3)
    held = [i for i in got if got[i]["held_out"]]
    assert set(held) == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([got[i]["lang_pred"] == sorted(STEMS)[i % 3] for i in held]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_labels_are_never_read(spark, corpus):
    from pyspark.sql import functions as F
    wrong = corpus.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "zz").otherwise(F.col("lang")))
    assert np.allclose(L.train(wrong).weights, L.train(corpus).weights)


def test_codewords_differ_in_many_bits():
    for n in (2, 3, 4, 7, 12, 30):
        codes = L.codewords(n)
        gaps = [(codes[i] != codes[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= max(1, codes.shape[1] // 4) and (np.abs(codes.sum(0)) < n).all()


def test_wrong_bit_is_corrected():
    codes = L.codewords(4)
    model = L.Model(list("abcd"), codes, np.zeros((L.BUCKETS, 7)), codes[2] * 3.0, np.ones(7))
    assert model.predict(L.counts("text"))[0] == "c"
    bias = codes[2] * 3.0
    bias[4] = -bias[4]
    assert L.Model(list("abcd"), codes, model.weights, bias, np.ones(7)).predict(L.counts("text"))[0] == "c"


def test_blocks_change_nothing(monkeypatch):
    text = "Wörter, die über 12 Grenzen gehen. " * 300
    whole = L.counts(text)
    monkeypatch.setattr(L, "BLOCK", 101)
    parts = L.counts(text)
    # a block's own edges add separators, never letters
    assert abs(parts.sum() - whole.sum()) < 0.1 * whole.sum() and np.corrcoef(parts, whole)[0, 1] > 0.99


def test_odd_rows(odd, nothing):
    model = L.train(odd)
    got = L.identified(odd, model).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] in (3, 4, 5, 9):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert L.identified(nothing, L.train(nothing)).count() == 0
    assert {r["lang_pred"] for r in L.identified(odd, L.train(nothing)).collect()} == {"und"}


def test_query(spark, sf):
    got = op1_language_codes(spark, sf)
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(want)
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in rows if r["held_out"]]) > 0.95
