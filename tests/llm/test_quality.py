import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import quality


def sites(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(1200):
        good = rng.random() < (0.95 if i % 3 else 0.2)
        host = "good" if i % 3 else "bad"
        words = ["lorem", "ipsum", "dolor", "sit", "amet"]
        text = " ".join(rng.choice(words) + ("" if good else "***") for _ in range(30))
        rows.append((i, text, host, f"p{i % 2}"))
        if i % 4 == 0:
            labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), spark.createDataFrame(labels, "doc_id long, quality int"), rows


def test_scores_and_shrinkage(spark):
    docs, labels, rows = sites(spark)
    out = {r.doc_id: r for r in quality.quality(docs, labels, F.col("host"), F.col("path")).collect()}
    assert len(out) == 1200
    right = np.mean([out[i].kept == ("***" not in t) for i, t, *_ in rows])
    assert right > 0.97
    assert np.mean([r.path_rate for r in out.values() if r.host == "good"]) > 0.8 > 0.4 > np.mean([r.path_rate for r in out.values() if r.host == "bad"])


def test_sparse_sites_move_to_the_prior(spark):
    docs, labels, _ = sites(spark)
    lone = spark.createDataFrame([(9999, "lorem*** ipsum***", "lone", "x")], "doc_id long, text string, host string, path string")
    out = quality.quality(docs.unionByName(lone), labels, F.col("host"), F.col("path")).where("doc_id = 9999").first()
    rate = quality.quality(docs, labels, F.col("host"), F.col("path")).agg(F.avg("doc_score")).first()[0]
    assert abs(out.host_rate - rate) < 0.05


def test_nulls_unlabelled_and_empty(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.quality(docs, none, F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    assert len(out) == docs.count() and all(abs(r.quality_score - 0.5) < 1e-6 or r.quality_score >= 0 for r in out)
    assert quality.quality(empty, none, F.col("source"), F.col("lang")).count() == 0


def weight(groups, around):
    """Prior weight of [(rate, n)] around [prior], by moments."""
    spread = sum(n * (r - a) ** 2 for (r, n), a in zip(groups, around))
    chance = sum(a * (1 - a) for a in around)
    room = sum(a * (1 - a) * (n - 1) for (_, n), a in zip(groups, around) if n > 1)
    ratio = (spread - chance) / room if room else 0
    return min(max(1 / ratio - 1, 1.0), quality.MAX_PRIOR) if ratio > 0 else quality.MAX_PRIOR


def test_against_brute_force(spark):
    """Rates, prior weights and scores recomputed from each document's own evidence, null sites, repeats and clashing columns included."""
    docs, labels, rows = sites(spark)
    odd = [(2000, None, None, None), (2001, "", "bad", None), (2002, "lorem " * 40_000, None, "p0"), (None, "lorem ipsum", "good", "p1"), (5, rows[5][1], rows[5][2], rows[5][3]), (2003, "amet***", "lone", "x")]
    df = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, host string, path string"))
    df = df.withColumn("h", F.col("host")).withColumn("p", F.col("path")).drop("host", "path").withColumn("_p", F.lit(1)).withColumn("_e", F.lit("x")).withColumn("host_rate", F.lit(2))
    out = quality.quality(df, labels, F.col("h"), F.col("p")).collect()
    assert len(out) == 1206
    of_host, of_path = {}, {}
    for r in out:
        of_host.setdefault(r.host, []).append(r.doc_score)
        of_path.setdefault((r.host, r.path), []).append(r.doc_score)
    rate = sum(r.doc_score for r in out) / len(out)
    hosts = [(np.mean(v), len(v)) for v in of_host.values()]
    hw = weight(hosts, [rate] * len(hosts))
    prior = {h: (sum(v) + hw * rate) / (len(v) + hw) for h, v in of_host.items()}
    pw = weight([(np.mean(v), len(v)) for v in of_path.values()], [prior[h] for h, _ in of_path])
    for r in out:
        h, p, own = of_host[r.host], of_path[r.host, r.path], r.doc_score
        host = (sum(h) - own + hw * rate) / (len(h) - 1 + hw)
        path = (sum(p) - own + pw * host) / (len(p) - 1 + pw)
        logit = lambda x: np.log(x / (1 - x))
        odds = logit(own) + logit(min(max(path, 1e-3), 1 - 1e-3)) - logit(rate)
        assert abs(r.host_rate - host) < 1e-9 and abs(r.path_rate - path) < 1e-9
        assert abs(r.quality_score - 1 / (1 + np.exp(-odds))) < 1e-9 and r.kept == (r.quality_score >= quality.THRESHOLD)
    assert {r.path for r in out if r.doc_id == 2000} == {None}


def test_sample_is_bounded_and_of_all_labels(spark):
    docs, labels, _ = sites(spark)
    from strandlake.llm.common import hashed_sample

    rows = labels.withColumnRenamed("doc_id", "_id")
    got = hashed_sample(rows, 40, 300).collect()
    want = rows.orderBy(F.pmod(F.xxhash64("_id"), F.lit(1 << 30))).limit(40).collect()
    assert got == want and hashed_sample(rows, 1000, 300).count() == 300
    assert quality.quality(docs, labels, F.col("host"), F.col("path"), sample=80).count() == 1200
