import pytest

import corpus_pipeline
from strandlake.llm import langid
from strandlake.llm.queries import oracle_sql, queries, tokenizer_path

from .conftest import SCHEMA
from .test_exact_dedup import brute as exact
from .test_near_dedup import brute as near


@pytest.fixture(scope="module")
def sf_dir(docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{d}/documents.parquet")
    return str(d)


def test_stages_against_brute_force(spark, docs, corpus, sf_dir):
    at = docs
    rows = {r[0]: r for r in corpus}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "exact dedup", "near dedup", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        at = spark.createDataFrame(stage(spark, at, sf_dir).collect(), at.schema if name != "packing" else None)
        kept[name] = at
        if name != "packing":
            assert at.columns == docs.columns
    ids = lambda n: {r.doc_id for r in kept[n].collect()}
    first = ids("language ID")
    assert {i for i, t, *_ in corpus if not langid.has_letter(t)}.isdisjoint(first)
    left = [rows[i] for i in sorted(first)]
    assert ids("exact dedup") == {i for i, k, *_ in exact(left) if i == k}
    left = [rows[i] for i in sorted(ids("exact dedup"))]
    assert ids("near dedup") == {i for i, _, c, _ in near(left) if i == c}
    assert ids("mixing") == ids("near dedup") == ids("packing")
    for name in names[:4]:
        for r in kept[name].collect():
            assert tuple(r) == rows[r.doc_id]


def test_run_and_registration(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert set(oracle_sql()) <= set(queries()) and "pipeline" in queries() and tokenizer_path()


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
