"""Registered queries run, and equal their SQL where a SQL engine is at hand."""

from __future__ import annotations

import numbers

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from strandlake import queries as core

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in [*TABLES, "embeddings", "documents"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    number = lambda v: isinstance(v, numbers.Real) and not isinstance(v, (bool, np.bool_))
    text = lambda v: "-" if v is None or v is pd.NA or v != v else (f"{float(v):.4f}".replace("-0.0000", "0.0000") if number(v) else str(v))
    return sorted(tuple(map(text, r)) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_equals_sql(spark, sql, name):
    assert rows(core.QUERIES[name](spark, D).toPandas()) == rows(sql.execute(core.ORACLE[name]).df())


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80
