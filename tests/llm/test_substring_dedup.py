import random

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import substring_dedup as sd

from .conftest import SCHEMA, prose


def slow_gear(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(sd.GEAR[b])) & 0xFFFF
        out.append(h)
    return out


def test_gear_and_chunks():
    rng = random.Random(3)
    text = (prose(rng, 400) + "é日" * 50).encode()
    data = np.frombuffer(text, np.uint8)
    assert sd.gear(data)[15:].tolist() == slow_gear(text)[15:]
    ends = sd.chunk_ends(data)
    assert ends[-1] == len(text) and (np.diff(ends, prepend=0) <= sd.MOST).all()
    parts = [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]
    assert b"".join(parts) == text
    for p in parts:
        p.decode()
    moved = [p for p in sd.chunk_ends(np.frombuffer(b"inserted " + text, np.uint8)) - 9]
    assert len(set(moved) & set(ends)) > 0.9 * len(ends)


def brute(rows, min_words):
    seen, cuts = {}, {}
    for i, t in rows:
        raw = (t or "").encode()
        ends = sd.chunk_ends(np.frombuffer(raw, np.uint8)) if raw else []
        cuts[i] = [(a, raw[a:b]) for a, b in zip([0, *ends[:-1]], ends)] if len(ends) else []
        for k, (_, c) in enumerate(cuts[i]):
            seen.setdefault(c, []).append((i, k))
    out = set()
    for i, parts in cuts.items():
        raw = b"".join(c for _, c in parts)
        run = []
        for k, (a, c) in enumerate([*parts, (0, None)]):
            if c is not None and len(seen[c]) > 1:
                run.append((k, a, c))
                continue
            if run:
                start, size = run[0][1], sum(len(x) for _, _, x in run)
                words = sum(1 for p in range(start, start + size) if not raw[p : p + 1].isspace() and (p == 0 or raw[p - 1 : p].isspace()))
                if words >= min_words:
                    first = min(min(seen[x])[0] for _, _, x in run)
                    out.add((i, start, size, words, len(run), first, all(min(seen[x]) != (i, n) for n, _, x in run)))
            run = []
    return out


def test_against_brute_force(docs, corpus):
    rows = [(i, t) for i, t, *_ in corpus]
    got = {tuple(r) for r in sd.repeated_passages(docs).collect()}
    assert got == brute(rows, sd.MIN_WORDS)


def test_planted_passage_and_removal(spark):
    rng = random.Random(5)
    fresh = lambda n: " ".join(f"{rng.randrange(16**9):x}" for _ in range(n))
    passage = fresh(60)
    texts = [fresh(80) + "\n" + passage + "\n" + fresh(40) for _ in range(4)] + [fresh(200) for _ in range(4)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA)
    found = sd.repeated_passages(df)
    rows = found.collect()
    assert {r.doc_id for r in rows} == {0, 1, 2, 3}
    assert {r.doc_id for r in rows if not r.removed} == {0}
    out = {r.doc_id: r.text for r in sd.remove_passages(df, found).collect()}
    assert out[0] == texts[0] and out[5] == texts[5]
    for r in rows:
        if r.removed:
            raw = texts[r.doc_id].encode()
            assert raw[r.start : r.start + r.length].decode() in passage + "\n" and out[r.doc_id].encode() == raw[: r.start] + raw[r.start + r.length :]


def test_empty_and_nulls(spark, empty):
    assert sd.repeated_passages(empty).count() == 0
    df = spark.createDataFrame([(None, "word " * 100, "", "", 0), (1, None, "", "", 0), (2, "", "", "", 0)], SCHEMA)
    assert sd.repeated_passages(df).count() == 0


def test_copies_beside_first_occurrences_go(spark):
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"{rng.randrange(16**9):x}" for _ in range(n))
    p, x, q, y = fresh(60) + "\n", fresh(60) + "\n", fresh(40) + "\n", fresh(9) + "\n"
    texts = [p, p + x, p + x, q, q + y + p, q + y + p]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA)
    spans = sd.passage_spans(df)
    parts = [[t.encode()[a:b] for e in [sd.chunk_ends(np.frombuffer(t.encode(), np.uint8)).tolist()] for a, b in zip([0, *e[:-1]], e)] for t in texts]
    seen, want = set(), []
    for chunks in parts:
        count = lambda c: sum(other.count(c) for other in parts)
        want.append(b"".join(c for c in chunks if c not in seen or count(c) == 1))
        seen |= set(chunks)
    out = {r.doc_id: r.text.encode() for r in sd.remove_passages(df, spans).collect()}
    assert [out[i] for i in range(6)] == want and len(want[1]) < len(x) + 200 and want[2] == want[5] == b""
    assert len(want[4]) < len(y) + 200
    rows = spans.collect()
    assert min(r.n_words for r in rows) < sd.MIN_WORDS <= min(r.passage_words for r in rows)
    whole = {(r.doc_id, r.start, r.n_words) for r in sd.repeated_passages(df).collect()}
    assert whole == {(r.doc_id, r.passage_start, r.passage_words) for r in rows}


def test_cuts_without_boundary_follow_content():
    rng = random.Random(2)
    quiet = bytearray(b"abcdefghijklmnop")  # bytes with no gear boundary from the 16th on
    while len(quiet) < 3000:
        c = rng.randrange(33, 127)
        if sd.gear(np.frombuffer(bytes(quiet[-15:]) + bytes([c]), np.uint8))[-1] >> (16 - sd.CUT_BITS):
            quiet.append(c)
    data = lambda k: np.frombuffer(b"z" * k + bytes(quiet), np.uint8)
    ends = [set((sd.chunk_ends(data(k)) - k).tolist()) for k in (0, 7, 40, 100, 333)]
    assert all(len(ends[0] & e) > 0.9 * len(ends[0]) for e in ends)


def test_chunks_are_whole_words():
    rng = random.Random(4)
    data = np.frombuffer(prose(rng, 3000).encode(), np.uint8)
    ends = sd.chunk_ends(data)
    assert all(data[e - 1] == 32 and data[e] != 32 for e in ends[:-1])
    flat = np.frombuffer(("word " * 2000).encode(), np.uint8)
    assert (np.diff(sd.chunk_ends(flat), prepend=0) <= sd.MOST).all() and all(flat[e - 1] == 32 for e in sd.chunk_ends(flat)[:-1])


def test_boundaries_of_a_passage_do_not_depend_on_what_is_beside_it():
    rng = random.Random(6)
    for _ in range(300):
        passage = prose(rng, 51).encode()
        words = [i + 1 for i, b in enumerate(passage) if b == 32]
        cuts = []
        for _ in range(2):
            text = prose(rng, rng.randrange(1, 60)).encode() + b" " + passage + b" " + prose(rng, rng.randrange(1, 60)).encode()
            ends = sd.chunk_ends(np.frombuffer(text, np.uint8)) - text.index(passage)
            cuts.append({int(e) for e in ends if words[4] <= e <= words[-1 - sd.SIDE]})
        both = cuts[0] & cuts[1]  # a chunk of over MOST bytes that lies partly outside the passage may be cut further inside it
        assert {e for c in cuts for e in c if min(both) <= e <= max(both)} == both and min(both) <= words[20] and max(both) >= words[29]


def test_texts_that_share_an_id(spark):
    rng = random.Random(12)
    fresh = lambda n: " ".join(f"{rng.randrange(16**9):x}" for _ in range(n))
    p, a, b = fresh(60), fresh(70), fresh(70)
    rows = [(1, a + " " + p), (1, b + " " + p + " " + a), (1, a + " " + p), (2, p), (3, fresh(50))]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA)
    spans = sd.passage_spans(df)
    out = sorted((r.doc_id, r.text) for r in sd.remove_passages(df, spans).collect())
    by_crc = {r.text_crc32 for r in spans.collect() if r.doc_id == 1}
    assert len(by_crc) == 2  # the row repeated in full counts once
    assert [t for i, t in out if i == 3] == [rows[4][1]] and len(out) == 5
    kept = " ".join(t for _, t in sorted({(i, t) for i, t in out}))
    assert all(kept.count(w) == 1 for w in p.split()[10:50])
    assert sd.passage_spans(df.where("doc_id = 1").dropDuplicates(["text"]).limit(1)).count() == 0


def test_removal_keeps_clashing_columns(spark):
    rng = random.Random(13)
    p = prose(rng, 90)
    df = spark.createDataFrame([(1, p, 5, 6), (2, p, 7, 8), (None, p, 9, 10)], "doc_id long, text string, _cuts int, row int").withColumn("cuts", F.lit(1))
    out = {r.doc_id: r for r in sd.remove_passages(df, sd.passage_spans(df)).collect()}
    assert out[1].text == p and out[2].text == "" and out[None].text == p and (out[2]._cuts, out[2].row, out[2].cuts) == (7, 8, 1)


def test_hot_chunks_are_joined_in_parts(spark, monkeypatch):
    from strandlake.llm import common

    monkeypatch.setattr(common, "HOT", 10)
    monkeypatch.setattr(common, "PARTS", 4)
    rng = random.Random(14)
    p = prose(rng, 60)
    texts = [prose(rng, 20) + "\n" + p for _ in range(60)] + [prose(rng, 200) for _ in range(10)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA)
    assert {tuple(r) for r in sd.repeated_passages(df).collect()} == brute(list(enumerate(texts)), sd.MIN_WORDS)
