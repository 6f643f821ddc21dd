import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from strandlake.llm import mixing


def schedule(spark, sizes, **kw):
    rows = [(i * 1000 + k, " ".join(["w"] * n), f"s{i}") for i, docs in enumerate(sizes) for k, n in enumerate(docs)]
    return rows, mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), **kw).collect()


def test_budget_order_and_repeats(spark):
    sizes = [[7] * 60, [5] * 6, [3] * 2]
    rows, out = schedule(spark, sizes, whole=True, max_repeat=4.0, target_entropy=0.99, block_tokens=50)
    n = {i: len(t.split()) for i, t, _ in rows}
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    epochs = {}
    for s, got in by.items():
        got.sort(key=lambda r: (r.start, r.epoch))
        at = 0
        for r in got:  # readings stand one behind the other
            assert r.start == at and r.n_tokens == n[r.doc_id]
            at += r.n_tokens
        total = sum(n[i] for i, _, x in rows if x == s)
        epochs[s] = at / total
        whole = [r for r in got if r.epoch == 0]
        assert sorted(r.doc_id for r in whole) == sorted(i for i, _, x in rows if x == s)
        for r in got:  # blocks of an epoch are permuted as wholes
            assert r.start // total == r.epoch
    assert min(epochs.values()) >= 1 and max(epochs.values()) <= 4.0 + 0.2


def test_exponent(spark):
    t = spark.createDataFrame([(1000,), (10,), (10,)], "_tokens long")
    k = mixing.solve_exponent(t, 0.9, 1e9)

    def entropy(k):
        u = [x ** (k / mixing.GRID) for x in (1000, 10, 10)]
        return -sum(x / sum(u) * math.log(x / sum(u)) for x in u) / math.log(3)

    assert entropy(k) >= 0.9 > entropy(k + 1)
    tight = mixing.solve_exponent(t, 0.9, 1.5)
    repeat = lambda k: max((x ** (k / mixing.GRID)) / x for x in (1000, 10)) * 1020 / sum(x ** (k / mixing.GRID) for x in (1000, 10, 10))
    assert repeat(tight) <= 1.5 < repeat(tight - 1)
    assert mixing.solve_exponent(t.limit(0), 0.9, 4.0) in range(mixing.GRID + 1)


def test_nulls_and_empty(docs, empty):
    assert mixing.mix(empty).count() == 0
    out = mixing.mix(docs, whole=True)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.source for r in out.select("source").collect()} == {"hot", "s1", None}


def test_token_count(spark):
    texts = [None, "", " \t", "a", " a\x0bb\nc ", "é 日本 x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mixing.token_count(F.col("t"))).collect()] == [0, 0, 0, 1, 3, 3]


def test_order_is_a_hash_of_the_id(spark):
    rows, out = schedule(spark, [[1] * 20], block_tokens=1000)
    want = sorted((i for i, _, _ in rows), key=lambda i: hashlib.md5(f"{i}:0".encode()).hexdigest())
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == want


def test_documents_follow_the_schedule(spark, docs, corpus):
    for df, kw in ((docs, {}), (docs, {"whole": True}), (docs.unionByName(docs.where("doc_id < 7")), {"whole": True, "block_tokens": 300})):
        args = {"target_entropy": 0.99, "block_tokens": 200} | kw
        want = Counter(r.doc_id for r in mixing.mix(df, **args).collect())
        got = mixing.mixed_documents(df, **args)
        assert got.columns == df.columns and Counter(r.doc_id for r in got.select("doc_id").collect()) == want


def test_offsets_do_not_depend_on_the_groups_of_blocks(spark, monkeypatch):
    sizes = [[3 + k % 5 for k in range(200)], [4] * 30]
    rows, out = schedule(spark, sizes, whole=True, target_entropy=0.99, block_tokens=10)
    want = {(r.doc_id, r.epoch): r.start for r in out}
    assert len({r.block for r in out if r.source == "s0"}) > 50
    for digits in (0, 1, 32):
        monkeypatch.setattr(mixing, "DIGITS", digits)
        assert {(r.doc_id, r.epoch): r.start for r in schedule(spark, sizes, whole=True, target_entropy=0.99, block_tokens=10)[1]} == want


def test_every_exponent_is_the_plain_bisection(spark):
    tokens = (5000, 800, 70, 9, 1)
    t = spark.createDataFrame([(x,) for x in tokens], "_tokens long")
    u = [[x ** (k / mixing.GRID) for x in tokens] for k in range(mixing.GRID + 1)]
    entropy = [-sum(x / sum(v) * math.log(x / sum(v)) for x in v) / math.log(len(tokens)) for v in u]
    repeat = [max(x / n for x, n in zip(v, tokens)) * sum(tokens) / sum(v) for v in u]
    for target, most in ((0.2, 1e9), (0.5, 1e9), (0.999, 1e9), (0.9, 40.0), (0.9, 1.0), (0.0, 3.0)):
        by_entropy = max((k for k in range(mixing.GRID + 1) if entropy[k] >= target), default=0)
        by_repeat = min(k for k in range(mixing.GRID + 1) if repeat[k] <= most + 1e-9)
        assert mixing.solve_exponent(t, target, most) == max(by_entropy, by_repeat)


def test_clashing_columns(docs):
    for name in ("_blocks", "_s", "_ends", "_b0", "_times", "_copy", "_es", "_eb", "row", "col"):
        odd = docs.withColumn(name, F.lit(7))
        assert mixing.mixed_documents(odd, whole=True).select(name, "doc_id").columns == [name, "doc_id"]
    odd = docs.withColumn("_blocks", F.lit(7)).withColumn("row", F.col("doc_id"))
    assert Counter(tuple(r) for r in mixing.mixed_documents(odd, whole=True).select("doc_id", "row", "_blocks").collect()) == Counter((r.doc_id, r.doc_id, 7) for r in mixing.mix(odd, whole=True).collect())


def test_plan_is_native(docs):
    for df in (mixing.mix(docs, whole=True), mixing.mixed_documents(docs, whole=True)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
