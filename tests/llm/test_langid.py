import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import langid

SYLLABLES = {"en": "th er on an re he in ed nd ha at".split(), "de": "sch ei ch en der ung ein ö ü ß pf".split(), "fr": "é eau ou è aux tion que ç oi eux".split()}


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(4, 60))), lang))
    return out


def test_gradients_against_differences():
    tagger = langid.ByteTagger.fresh(["a", "b", "c"], hidden=3, seed=1)
    for d in (tagger.ahead, tagger.back):
        d.table, d.gates, d.cand = (p.astype(np.float64) for p in d.params)
    tagger.weights, tagger.bias = tagger.weights.astype(np.float64), tagger.bias.astype(np.float64)
    data, real = langid._padded([b"abcab", b"bc", b"ccc"], 8)
    label = np.array([0, 1, 2])
    _, grads = tagger.gradients(data, real, label)
    rng = np.random.default_rng(0)
    for p, g in zip(tagger.params, grads):
        live = np.argwhere(np.abs(g) > 1e-6)
        for at in map(tuple, live[rng.choice(len(live), min(4, len(live)), replace=False)]):
            keep, step = p[at], 1e-3
            p[at] = keep + step
            up = tagger.gradients(data, real, label)[0]
            p[at] = keep - step
            down = tagger.gradients(data, real, label)[0]
            p[at] = keep
            assert abs((up - down) / (2 * step) - g[at]) < 2e-2 * max(1.0, abs(g[at]) * 10)


def test_held_out_accuracy(spark):
    rows = texts(900, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(df, langid.train(df), carry=("lang",)).collect()
    assert {r.doc_id: r.held_out for r in out} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_labels_are_not_read_when_predicting(spark):
    rows = texts(300, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    a = langid.identify(df, model).orderBy("doc_id").collect()
    b = langid.identify(df.withColumn("lang", F.lit(None).cast("string")), model).orderBy("doc_id").collect()
    assert a == b


def test_undetermined_null_and_empty(spark, docs, empty):
    model = langid.train(docs)
    rows = [(1, None), (2, ""), (3, "123 !!"), (None, "words here"), (4, "x" * 5000)]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[None].held_out is False and out[4].lang_pred in ("en", "fr")
    assert langid.train(empty) is None and langid.identify(empty, None).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_windows_cover_whole_texts():
    tagger = langid.ByteTagger.fresh(["a", "b"], hidden=4)
    text = "abc" * 200
    whole = tagger.documents([text], width=2)[0]
    parts = [text.encode()[i : i + langid.WINDOW] for i in range(0, 600, langid.WINDOW)]
    want = sum(tagger.positions(np.frombuffer(p, np.uint8)[:, None])[:, 0].sum(axis=0) for p in parts) / 600
    assert np.allclose(whole, want, atol=1e-5)
