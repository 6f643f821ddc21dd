import itertools
import random
import re

import numpy as np

from strandlake.llm import near_dedup as nd
from strandlake.llm.common import LOWER, UPPER

from .conftest import SCHEMA, edited, prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_against_brute_force(docs, corpus):
    out = nd.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
    assert {tuple(r) for r in out.collect()} == brute(corpus)


def test_chain_of_edits_and_outliers(spark):
    """A family whose members link through others only, and members just below the threshold."""
    rng = random.Random(8)
    base = prose(rng, 80)
    rows = [(i, edited(rng, base, rng.randrange(0, 9)), "en", "s", 0) for i in range(120)]
    out = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id", "kept")
    assert {tuple(r) for r in out.collect()} == brute(rows)


def test_sets_match_tuples(corpus):
    texts = [t for _, t, *_ in corpus]
    for s, t in zip(nd.shingle_sets(texts), texts):
        assert len(s) == len(shingles(t)) and (np.diff(s.astype(object)) > 0).all()


def test_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    a, b = [], []
    for _ in range(600):
        u = rng.integers(0, 2**64, 200, dtype=np.uint64)
        a.append(np.sort(u[:175]))
        b.append(np.sort(u[25:]))
    n = np.full(600, 175)
    est = nd.jaccard_estimate(nd.sketches(a), nd.sketches(b), n, n)
    assert abs(est.mean() - 0.75) < 0.01
    assert nd.plausible(nd.sketches(a), nd.sketches(b), n, n).all()
    assert (nd.band_keys(nd.sketches(a)) == nd.band_keys(nd.sketches(b))).any(axis=1).all()


def test_empty_null_and_repeated(spark, empty):
    assert nd.near_duplicates(empty).count() == 0
    rows = [(None, "one two three four five six", "", "", 0), (1, "one two three four five six", "", "", 0), (2, "one two three four five six", "", "", 0), (2, "one two three four five six", "", "", 0), (3, None, "", "", 0)]
    out = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in out)
    assert got == [("1", 2, 1, True), ("2", 2, 1, False), ("2", 2, 1, False), ("3", 0, 3, True), ("None", 2, None, True)]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, k) for k in range(101, 160)]
    out = {r._id: r._comp for r in nd.components(spark.createDataFrame(pairs, "_a long, _b long")).collect()}
    want = {i: i // 10 * 10 for i in range(40)} | {k: 100 for k in range(100, 160)}
    assert out == want
