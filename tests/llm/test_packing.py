import itertools
import random
import zlib

import numpy as np
import pytest

from strandlake.llm import packing
from strandlake.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


ODD = ["Ǆfoo<|endoftext|>bar", "b́ar ́e\x0bX y's o'clock don't 'tis it's***", "İI ΑΣ <|startoftext|>\x85z 12345", "ß ÿ× ÷é É ª µ \xa0 x　y", "<|", "a<|b", "  \n\t ", "...", "'s 't", "naïve,\r\nword"]


def test_ids_are_the_tokenizers(tokenizer, corpus):
    words = packing.WordIds(tokenizer_path())
    for t in ODD + [t for _, t, *_ in corpus]:
        want = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert packing.encode_text(t, words) == np.array(want, "<u4").tobytes()


def check(rows, want, capacity):
    seen, bins = {}, {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(seen) == set(want)
    for i, pieces in seen.items():
        pieces.sort(key=lambda r: r.piece)
        ids = want[i]
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // capacity)))
        for r in pieces:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert len(part) == r.length and r.start == r.piece * capacity and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert sum(r.length for r in pieces) == len(ids)
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(places)) and sum(places[-1]) <= capacity
    return len(bins)


def test_round_trip(docs, corpus, tokenizer):
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in corpus}
    for capacity in (64, 2048):
        rows = packing.pack(docs, tokenizer_path(), capacity=capacity, with_ids=True).collect()
        n = check(rows, want, capacity)
        assert n <= 1.01 * sum(map(len, want.values())) / capacity + 1
        for r in rows:
            assert r.ids == want[r.doc_id][r.start : r.start + r.length]


def test_plan_against_exhaustive_search():
    rng = random.Random(1)
    for _ in range(40):
        counts = np.zeros(33, np.int64)
        for _ in range(7):
            counts[rng.randrange(1, 33)] += 1
        sizes = [s for s in range(33) for _ in range(counts[s])]
        longest = max(sizes)
        best = max(sum(c) for k in range(1, 8) for c in itertools.combinations(sizes, k) if sum(c) <= 32 and longest in c)
        got = packing.fullest(counts, 32)
        assert sum(got) == best and all(got.count(s) <= counts[s] for s in got)
        plan = packing.plan({s: int(counts[s]) for s in set(sizes)}, 32)
        assert sorted(s for p, t in plan for _ in range(t) for s in p) == sorted(sizes)


def test_empty_nulls_repeats(spark, empty):
    assert packing.pack(empty, tokenizer_path()).count() == 0
    rows = [(None, "a b"), (1, None), (1, None), (2, "")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path()).collect()
    assert sorted((str(r.doc_id), r.length) for r in out) == [("1", 1), ("1", 1), ("2", 1), ("None", 3)]
    assert len({r.sequence_id for r in out}) == 1 and len({r.offset for r in out}) == 4


def test_many_blocks_of_one_length(spark, monkeypatch):
    """Ranks within one length run on over blocks and groups of blocks."""
    monkeypatch.setattr(packing, "RANK_BLOCK", 3)
    monkeypatch.setattr(packing, "SUPER", 4)
    df = spark.createDataFrame([(i, "a b c" if i % 3 else "d e") for i in range(400)], "doc_id long, text string")
    out = packing.pack(df, tokenizer_path(), capacity=16).collect()
    words = packing.WordIds(tokenizer_path())
    want = {i: [*np.frombuffer(packing.encode_text("a b c" if i % 3 else "d e", words), "<u4").tolist(), 0] for i in range(400)}
    assert check(out, want, 16) <= 1.03 * sum(map(len, want.values())) / 16 + 1


def test_other_tokenizers_encode_whole_texts(spark, corpus, tokenizer):
    import public_tokenizers
    from tokenizers import Tokenizer

    assert packing.wordwise(tokenizer)
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    other = Tokenizer.from_file(path)
    assert not packing.wordwise(other)
    words = packing.WordIds(path)
    for t in [*ODD, "Cased Words, CASED words"]:
        assert packing.encode_text(t, words) == np.array(other.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_clashing_columns_and_repeated_rows(spark, tokenizer):
    from pyspark.sql import functions as F

    rows = [(1, "some words here"), (1, "some words here"), (None, "more words"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_row", "_id", "piece", "length", "_blocks", "sequence_id"):
        df = df.withColumn(c, F.lit("x"))
    out = packing.pack(df, tokenizer_path()).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "1", "2", "None"] and len({r.offset for r in out}) == 4 and {r.sequence_id for r in out} == {out[0].sequence_id}
