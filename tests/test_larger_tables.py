"""Queries equal their SQL on rows that larger tables bring: points on a line, equal points, numbers wider than a field."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandlake import queries as core
from strandlake.operators import alignments as A
from strandlake.operators import neighbours as N
from strandlake.operators import networks as W

PART = "/root/testdata/sf0.1/part.parquet"


@pytest.fixture
def same(spark, tmp_path):
    """``same(name, part=SQL)`` writes the tables and compares a query with its SQL; nulls, NaN and infinities differ from one another."""
    duckdb = pytest.importorskip("duckdb")

    def shown(rows):
        text = lambda v: ("nan" if math.isnan(v) else str(v) if math.isinf(v) else f"{v:.4f}") if isinstance(v, float) else str(v)
        return sorted(tuple(map(text, r)) for r in rows)

    def check(name, **tables):
        con = duckdb.connect()
        for t, q in tables.items():
            con.execute(f"COPY ({q}) TO '{tmp_path}/{t}.parquet'")
            con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        want = con.execute(entry.oracle_sql()[name])
        columns, want = [c[0] for c in want.description], want.fetchall()
        got = entry.queries()[name](spark, str(tmp_path)).select(*columns).collect()
        assert want and shown(got) == shown(want)
        return want

    return check


def test_backbone_torsions_of_points_on_a_line(same):
    rows = same("backbone_torsions", part=f"SELECT * FROM '{PART}' WHERE p_partkey BETWEEN 3200 AND 6415")
    assert any(r[2:] == (0.0, None, None) for r in rows)


def test_stacked_rings_whose_points_lie_on_a_line(same):
    same("pi_stacking", part=f"SELECT p_partkey + 20000 AS p_partkey, p_size, p_retailprice FROM '{PART}' WHERE p_partkey BETWEEN 900 AND 1850")


def test_dihedrals_of_points_on_a_line(same):
    rows = same("dihedrals", part="SELECT k AS p_partkey, 'Brand#1' AS p_brand, (CASE WHEN k < 6 THEN 3 ELSE k * k % 11 END)::INT AS p_size, 900.0 + k // 6 AS p_retailprice FROM range(24) r(k)")
    assert (0, 0.0) in rows


def test_pqr_of_numbers_wider_than_their_columns(same):
    """Residues from 10,000 and coordinates from 10,000 on."""
    rows = same("pqr_round_trip", part=f"SELECT p_partkey + 1180000 AS p_partkey, p_size, p_retailprice FROM '{PART}' WHERE p_partkey < 40")
    assert any(r[4] > 9999 for r in rows) and any(r[5] > 9999 for r in rows)


EQUAL = "SELECT k AS p_partkey, 'Brand#1' AS p_brand, (k % 40 * 7 % 9)::INT AS p_size, 900.0 + k % 40 // 5 AS p_retailprice FROM (SELECT * FROM range(12) UNION ALL SELECT * FROM range(80, 86)) r(k)"  # keys 40 apart are at one place


def test_hessian_of_points_at_one_place(same):
    assert any(math.isnan(r[5]) for r in same("hessian_matrix", part=EQUAL))


def test_springs_of_points_at_one_place(same):
    rows = same("weighted_kirchhoff", part=EQUAL)
    assert any(r[3] == -math.inf for r in rows) and any(r[3] == math.inf for r in rows)


def _no_broadcast_of_exploded_rows(spark, df):
    """The plan as it is made before anything runs, where estimates of size would allow a broadcast."""
    return "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()


def test_joint_counts_are_not_broadcast(spark):
    joint, _ = A._pairs(A.cells(core.alignment(spark, "/root/testdata/sf0.001")), True)
    assert _no_broadcast_of_exploded_rows(spark, joint)


def test_grid_cells_are_not_broadcast(spark):
    assert _no_broadcast_of_exploded_rows(spark, N.neighbours(core.points(spark, "/root/testdata/sf0.001"), 3.0, key="p_partkey"))


def test_fragments_of_atoms_just_one_apart(same):
    """Far from 0 sums of rounded hundredths miss distances of 1 by their last bits."""
    assert same("inferred_fragments", part=f"SELECT * REPLACE (p_partkey + 80000 AS p_partkey) FROM '{PART}' WHERE p_partkey < 1600")


def test_fragments_of_atoms_at_one_place(same):
    rows = same("inferred_fragments", part="SELECT * FROM (VALUES (0, 5, 900.0), (133, 5, 900.0), (266, 5, 905.0)) v(p_partkey, p_size, p_retailprice)")
    assert sorted(rows) == [(0, 0), (133, 0)]


def test_sums_of_springs_are_rounded_once(spark):
    """A running sum of the same springs ends in other bits for every order of rows."""
    springs = [1 / (225 - k * 0.01) for k in range(20_000)]
    for order in (springs, springs[::-1]):
        rows = spark.createDataFrame([(0, k + 1, v) for k, v in enumerate(order)], "i long, j long, value double")
        assert W.laplacian(rows).where("i = j").first().value == math.fsum(springs)
    assert W.laplacian(spark.createDataFrame([(0, 1, math.inf), (0, 2, 1.0)], "i long, j long, value double")).where("i = j").first().value == math.inf


def test_springs_by_square_have_no_rounded_root(spark):
    """1 / 40.96 is 0.0244140625: a five at the tenth place, which a squared root may lose."""
    for square in (40.96, 3.0, 7.0, 11.0, 204.8):
        both = spark.range(1).select(F.lit(square).alias("s")).select(W.gamma_by_square(F.col("s")).alias("g")).first()
        assert both.g == 1 / square
    points = spark.createDataFrame([(k, 0.0, float(y), 0.0) for k, y in enumerate((0, 6.4, 7.3))], "k long, x double, y double, z double")
    got = {(r.i, r.j): r.value for r in W.kirchhoff(points, "k", 15.0, gamma=W.gamma_by_square, squared=True).collect()}
    assert got[0, 1] == -1 / (6.4 * 6.4) and got[0, 2] == -1 / (7.3 * 7.3)


@pytest.mark.parametrize("cell", [None, (7.0, 9.0, 6.5), (3.0, 5.0, 20.0)])
def test_neighbours_come_once(spark, cell):
    rng = np.random.default_rng(2)
    x = rng.uniform(-12, 12, size=(150, 3)).round(1)
    x[:3] = [[-1e-17, 0, 0], [0.1, 0, 0], [0, 0, 0]]
    rows = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "k long, x double, y double, z double")
    want = {}
    for i in range(150):
        d = x[i] - x[i + 1 :]
        d = d if cell is None else d - np.array(cell) * np.rint(d / np.array(cell))
        want |= {(i, i + 1 + k): float(np.sqrt(s)) for k, s in enumerate((d * d).sum(axis=1)) if s <= 4}
    got = [((r.i, r.j), r.distance) for r in N.neighbours(rows, 2.0, key="k", cell=cell).collect()]
    assert len(got) == len(want) and dict(got) == pytest.approx(want)


def test_periodic_neighbours_stand_in_14_cells_and_need_no_decimals(spark):
    """Decimal rounding of each candidate, and each pair twice, took longer than all else."""
    found = N.neighbours(core.points(spark, "/root/testdata/sf0.001"), 3.0, key="p_partkey", cell=(50.0, 100.0, 40.0))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "rint" in plan.lower() and "round(" not in plan and plan.count("explode(") == 1
