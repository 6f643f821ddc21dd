"""Alignment rows, sparse coupling, spectra and small tables against numpy and plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import alignments as A
from strandlake.operators import interactions as I
from strandlake.operators import matrices as M
from strandlake.operators import records as R

RNG = np.random.default_rng(21)


def matrix(spark, m, lead=()):
    rows = [(*lead, i, j, float(x)) for (i, j), x in np.ndenumerate(m)]
    return spark.createDataFrame(rows, ("g string, " if lead else "") + "i int, j int, value double")


def test_graphical_lasso_meets_its_conditions():
    x = RNG.normal(size=(60, 8))
    x[:, 1] += x[:, 0]
    x[:, 5] -= 0.8 * x[:, 4]
    s = np.cov(x.T)
    rho = np.full((8, 8), 0.12)
    rho[2, 3] = rho[3, 2] = 1e9
    p = A.graphical_lasso(s, rho, 1e-8)
    w = np.linalg.inv(p)
    off = ~np.eye(8, dtype=bool)
    free = off & (np.abs(p) > 1e-9)
    assert np.allclose(np.diag(w), np.diag(s) + 0.12, atol=1e-5)
    assert np.allclose((w - s)[free], (rho * np.sign(p))[free], atol=1e-4)
    assert (np.abs(w - s)[off & ~free] <= rho[off & ~free] + 1e-4).all() and p[2, 3] == 0 and free.any() and (off & ~free).sum() > 2


def test_sparse_coupling_finds_the_coupled_columns(spark):
    pairs = ["AC", "DE", "FG", "HI"]
    rows = []
    for k in range(120):
        seq = list(RNG.choice(list("ACDEFGHIKL"), 6))
        seq[1], seq[4] = pairs[RNG.integers(4)]
        rows.append((k, f"s{k}", "".join(seq)))
    msa = spark.createDataFrame(rows, "seq_idx long, label string, seq string")
    out = {(r.i, r.j): r.value for r in A.sparse_coupling(msa).collect()}
    assert len(out) == 36 and all(abs(out[i, j] - out[j, i]) < 1e-9 for i, j in out) and all(out[i, i] == 0 for i in range(6))
    assert max((v, k) for k, v in out.items())[1] in {(1, 4), (4, 1)}
    assert A.sparse_coupling(msa.where("seq_idx < 0")).count() == 0


def test_rows_of_and_stacked(spark):
    msa = spark.createDataFrame([(0, "AB_H/1-3", "AC-"), (1, "AB/2-4", "DEF"), (2, "AB/5-7", "GHI"), (3, "ZQ", "KLM")], "seq_idx long, label string, seq string")
    at = lambda name: [r.seq_idx for r in A.rows_of(msa, name).orderBy("seq_idx").collect()]
    assert at("AB") == [1, 2] and at("B_") == [0] and at("Q") == [3] and at("none") == []
    with pytest.raises(ValueError):
        A.stacked(msa, msa.withColumn("seq", F.concat("seq", F.lit("A"))))
    assert A.stacked(msa.where("seq_idx < 0"), msa).count() == 4
    assert [r.seq for r in A.picked(msa, ["AB"], slice(5, 9)).collect()] == ["", ""]


def test_merges_root_and_subgroups(spark):
    x = RNG.normal(size=(7, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    got = [(r.a, r.b, r.height, r["size"]) for r in M.merges(matrix(spark, d)).orderBy("merge").collect()]
    assert got == [(a, b, pytest.approx(h), n) for a, b, h, n in M.linkage(d)]
    s = x @ x.T
    root = np.zeros((7, 7))
    for r in M.square_root(matrix(spark, s, ("p",)), ("g",)).collect():
        root[r.i, r.j] = r.value
    assert np.allclose(root @ root, s) and np.allclose(root, root.T)
    leaves = spark.createDataFrame([(n, p) for p, n in enumerate([3, 1, 0, 2])], "node int, place int")
    steps = spark.createDataFrame([(3, 1, 0.5), (0, 1, 2.0), (0, 2, 1.0)], "i int, j int, value double")
    assert {r.node: r.subgroup for r in M.subgroups(leaves, steps, 1.0).collect()} == {3: 1, 1: 1, 0: 2, 2: 2}
    full = M.onto_full(spark.createDataFrame([(1, 4.0)], "i int, value double"), spark.createDataFrame([(0,), (1,)], "i int"))
    assert sorted(tuple(r) for r in full.collect()) == [(0, 0.0), (1, 4.0)]


def test_spectral_clusters(spark):
    group = np.array([0, 1, 2, 0, 1, 2, 0, 0, 1, 2, 2])
    s = np.where(group[:, None] == group[None], 1.0, 0.02) + RNG.uniform(0, 0.01, (11, 11))
    s = (s + s.T) / 2
    found = {r.node: r.cluster for r in M.spectral_clusters(matrix(spark, s), 3).collect()}
    assert len(set(zip(group, (found[k] for k in range(11))))) == 3


@pytest.mark.parametrize("block", [3, 16])
def test_boundary_strengths(spark, block):
    s = RNG.uniform(0.1, 1, (9, 9))
    s = (s + s.T) / 2
    np.fill_diagonal(s, 0)
    want = []
    for k in range(9):
        m = s.copy()
        for j in range(9):
            if abs(j - k) > 1:
                m[k, j] = m[j, k] = 0
        deg = m.sum(axis=1)
        w = np.sort(np.linalg.eigvalsh(np.eye(9) - m / np.sqrt(np.outer(deg, deg))))
        want.append((1 / w[1:6]).sum())
    got = {r.node: r.strength for r in M.boundary_strengths(matrix(spark, s, ("p",)), ("g",), 6, None, False, block).collect()}
    assert np.allclose([got[k] for k in range(9)], want)
    rest = {r.node: r.strength for r in M.boundary_strengths(matrix(spark, s), (), 6, 1.0, True, block).collect()}
    far = np.abs(np.array(want) - np.median(want))
    kept = far <= np.median(far)
    assert all((rest[k] is None) != kept[k] for k in range(9)) and min(rest[k] for k in range(9) if kept[k]) == 0


def test_interaction_tables(spark):
    energies = spark.createDataFrame([("HIS", "ASP", "-1.5"), ("ASP", "HIS", "2.0")], "first string, second string, solvated string")
    pairs = spark.createDataFrame([("HSD", "ASPP"), ("ASP", "HIE"), ("GLY", "ALA"), (None, "ALA")], "resname1 string, resname2 string")
    out = {(r.resname1, r.resname2): r.energy for r in I.pair_energies(pairs, energies, "solvated").collect()}
    assert out == {("HSD", "ASPP"): -1.5, ("ASP", "HIE"): 2.0, ("GLY", "ALA"): None, (None, "ALA"): None}
    with pytest.raises(ValueError):
        I.pair_energies(pairs, energies, "other")
    ends = spark.createDataFrame([(0.0, 0.0, 2.0, 4.0, 1.0, 2.0)], "x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    assert tuple(I.dummy_atoms(ends).first()) == ("DUM", "DUM", 2.0, 0.5, 2.0)


def test_with_ends(spark):
    rows = spark.createDataFrame([("a", x, float(x)) for x in (1, 2, 3, 7, 8)] + [("b", 4, 1.0)], "k string, x int, y double")
    got = sorted(((r.k, r.x, r.y) for r in R.with_ends(rows, "x", ["y"], ["k"]).collect()), key=str)
    assert got == sorted([*(("a", x, float(x)) for x in (1, 2, 3, 7, 8)), ("a", 4, None), ("b", 4, 1.0)], key=str)
