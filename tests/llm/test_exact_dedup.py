import hashlib

from pyspark.sql import functions as F

from strandlake.llm.common import LOWER, UPPER
from strandlake.llm.exact_dedup import drop_exact_duplicates, exact_dedup


def brute(rows):
    norm = [(i, (t or "").translate(str.maketrans(UPPER, LOWER))) for i, t, *_ in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    return {(i, max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm}


def test_against_brute_force(docs, corpus):
    assert {tuple(r) for r in exact_dedup(docs).collect()} == brute(corpus)


def test_empty_and_clashing_columns(docs, empty):
    assert exact_dedup(empty).count() == 0
    clash = docs.withColumn("_len", F.lit(1)).withColumn("keep_id", F.lit("x"))
    assert exact_dedup(clash).count() == docs.count()
    assert drop_exact_duplicates(clash).columns == clash.columns


def test_null_and_repeated_ids(spark):
    rows = [(None, "t"), (5, "T"), (5, "t"), (None, "alone")]
    out = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in out)) == [("5", "5", 3, True), ("5", "5", 3, True), ("None", "5", 3, False), ("None", "None", 1, True)]


def test_hot_group_is_whole(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup(rows).where("group_size > 1")
    assert out.count() == 1000 and out.where("kept").select("doc_id").collect()[0][0] == 2997
    assert drop_exact_duplicates(rows).count() == 2001


def test_plan_is_native(docs):
    plan = exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_stage_with_null_and_repeated_ids(spark):
    rows = [(None, "t"), (5, "T"), (5, "t"), (None, "alone"), (None, "twice"), (None, "twice"), (7, "x"), (8, "X"), (7, "y"), (None, None), (3, "")]
    out = drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == [("3", ""), ("5", "T"), ("7", "y"), ("8", "X"), ("None", "alone"), ("None", "twice")]


def test_stage_hashes_marked_groups_only(spark, monkeypatch):
    from strandlake.llm import exact_dedup as ed

    rows = [(i, ("a" * 70 + f"{i // 2:04d}") if i < 40 else "x" * (i + 100), i) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumn("sha", F.lit("s")).withColumn("_bits", F.lit(1))
    for maps in (1, 4096):  # false marks change nothing
        monkeypatch.setattr(ed, "BITMAPS", maps)
        out = drop_exact_duplicates(df)
        assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == list(range(1, 40, 2)) + list(range(40, 80))


def test_null_ids_are_dealt_out(spark):
    same = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    out = exact_dedup(same)
    assert out.groupBy("keep_id", "group_size", "kept").count().collect()[0][:] == (None, 500, True, 500)
    assert drop_exact_duplicates(same).count() == 1
