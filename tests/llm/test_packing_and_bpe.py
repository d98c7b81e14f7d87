import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from blockwalk.llm import best_fit, chunks, segment_bpe
from blockwalk.llm.queries import op2_best_fit, op3_segment_bpe

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "é", "日", "🙂", "1", "²", "-", "_", " ", "\xa0", "\x1f", "\x85", "<|endoftext|>", "́"]


def noise(seed, n):
    rnd = random.Random(seed)
    return ["", " ", *["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(1, 80))) for _ in range(n)]]


def test_ids_as_the_library_gives_them():
    vocabulary = open(JSON, encoding="utf-8").read()
    library, own = Tokenizer.from_str(vocabulary), best_fit._encoder(vocabulary)
    for text in noise(1, 1500):
        ids = library.encode(text, add_special_tokens=False).ids
        assert own(text) == struct.pack(f"<{len(ids)}I", *ids), text


def _bpe():
    return segment_bpe.SegmentTreeBpe(segment_bpe.read_ranks(open(RANKS, "rb").read()), public_tokenizers.PATTERN)


def test_segment_tree_against_the_library(monkeypatch):
    bpe = _bpe()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = [*noise(2, 1500), "ab" * 3000, "x" * 5001, "日" * 700]
    monkeypatch.setattr(chunks, "LIMIT", 100)  # forgetting must not change a result
    monkeypatch.setattr(chunks, "GROUP", 500)
    for text, ids in zip(texts, segment_bpe.Chunked(bpe.encode_parts)(texts), strict=True):
        want = library.encode_ordinary(text)
        assert ids == struct.pack(f"<{len(want)}I", *want), text
        assert bpe.decode(ids) == text.encode()


def test_one_long_word_and_many_short_ones_agree():
    bpe = _bpe()
    words = [bytes(random.Random(i).choices(b"abcdeing t", k=5 + i % 55)) for i in range(300)]
    many = bpe.encode_words(words)
    assert all(bpe.ranks.get(w) is not None or bpe._one(w).astype("<u4").tobytes() == many[w] for w in words)


def _check(rows, size=best_fit.SIZE):
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return len(filled)


def test_plan_is_valid_and_near_the_bound():
    rnd = random.Random(5)
    for high, n in ((2048, 3000), (700, 3000), (2048, 7), (40, 500)):
        counts = Counter(min(high, int(rnd.expovariate(1 / (high / 4))) + 1) for _ in range(n))
        plan = best_fit.plan(counts)
        least = -(-sum(k * v for k, v in counts.items()) // 2048)
        assert plan["sequence"].max() + 1 <= max(least * 1.02 + 1, counts[2048])


def test_best_pair_fills_tighter():
    left = best_fit._Left({700: 1, 340: 1, 310: 1, 5: 2})
    assert best_fit._best_pair(left, 655, 320) == (340, 310)
    assert best_fit._best_pair(best_fit._Left({300: 1}), 600, 0) is None  # one piece is not a pair
    assert best_fit._best_pair(best_fit._Left({300: 2}), 600, 0) == (300, 300)


def test_packing_brute_force(spark, sf):
    rows = op2_best_fit(spark, sf).collect()
    library = Tokenizer.from_file(JSON)
    pieces = defaultdict(dict)
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = r
    total = 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        own = [pieces[d["doc_id"]][i] for i in range(len(pieces[d["doc_id"]]))]
        assert [p["start"] for p in own] == [sum(q["length"] for q in own[:i]) for i in range(len(own))]
        assert sum(p["length"] for p in own) == len(ids) and len(own) == -(-len(ids) // 2048)
        for p in own:
            part = ids[p["start"]:p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    assert _check(rows) <= -(-total // 2048) * 1.02 + 1


def test_round_trip_query(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=segment_bpe.read_ranks(open(RANKS, "rb").read()))
    for r in op3_segment_bpe(spark, sf).collect():
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(odd, nothing):
    rows = best_fit.packed(odd, JSON).collect()
    _check(rows)
    ends = [r for r in rows if r["doc_id"] in (3, 4)]
    assert [(r["start"], r["length"], r["ids_crc32"]) for r in ends] == [(0, 1, zlib.crc32(b"\0\0\0\0"))] * 2
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert sum(r["piece"] == 0 for r in rows) == odd.count()
    assert best_fit.packed(nothing, JSON).count() == 0
    trips = segment_bpe.round_trips(odd, RANKS, public_tokenizers.PATTERN)
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in trips.collect()}[3] == (0, empty, empty)
    assert trips.count() == odd.count()
    assert segment_bpe.round_trips(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
