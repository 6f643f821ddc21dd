"""Operators against numpy on small tables."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.operators import alignments as A
from strandlake.operators import ensembles as E
from strandlake.operators import geometry as G
from strandlake.operators import hierarchy as H
from strandlake.operators import interactions as I
from strandlake.operators import matrices as M
from strandlake.operators import neighbours as N
from strandlake.operators import networks as W
from strandlake.operators import records as R
from strandlake.plans import iteration as P

RNG = np.random.default_rng(12)


def points(spark, x, **more):
    pdf = pd.DataFrame({"atom_index": range(len(x)), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2], **more})
    return spark.createDataFrame(pdf)


# ---- neighbours ----------------------------------------------------------------


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), radius=st.floats(0.3, 4.0), periodic=st.booleans())
def test_grid_join_is_the_nested_loop(spark, seed, radius, periodic):
    x = np.random.default_rng(seed).uniform(-6, 6, (60, 3))
    cell = (7.0, 9.0, 11.0) if periodic else None
    got = {(r.i, r.j): r.distance for r in N.neighbours(points(spark, x), radius, cell=cell).collect()}
    want = {}
    for i, j in itertools.combinations(range(60), 2):
        d = x[i] - x[j]
        if cell:
            d = d - np.array(cell) * np.round(d / np.array(cell))
        if (d**2).sum() <= radius**2:
            want[i, j] = math.sqrt((d**2).sum())
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_neighbour_options(spark):
    x = RNG.uniform(0, 5, (40, 3))
    df = points(spark, x, resnum=np.arange(40))
    assert N.neighbours(df, 2.0, least_gap=5).where("j - i < 5").isEmpty()
    other = points(spark, x[:5])
    assert N.neighbours(df, 1.0, other=other).where("i = j").count() == 5
    assert N.points_near(df, other, 1e-3).count() == 5 and N.points_near(df, other, 1e-3).columns == df.columns
    with pytest.raises(ValueError):
        N.neighbours(df, 0)
    assert N.distance_pairs(df, "atom_index").count() == 780


# ---- geometry -------------------------------------------------------------------


def test_geometry(spark):
    p = RNG.standard_normal((4, 3))
    df = spark.createDataFrame([tuple(map(float, p.ravel()))], ", ".join(f"p{k}{c} double" for k in range(4) for c in "xyz"))
    v = [G.point(f"p{k}") for k in range(4)]
    got = df.select(G.distance(v[0], v[1]), G.angle(*v[:3]), G.dihedral(*v), G.angle(*v[:3], radian=True)).first()
    a, b, c, d = p
    ang = math.acos((a - b) @ (c - b) / np.linalg.norm(a - b) / np.linalg.norm(c - b))
    n1, n2 = np.cross(b - a, c - b), np.cross(c - b, d - c)
    tor = math.copysign(math.acos(n1 @ n2 / np.linalg.norm(n1) / np.linalg.norm(n2)), n1 @ (d - c))
    assert np.allclose(got, [np.linalg.norm(a - b), math.degrees(ang), math.degrees(tor), ang])
    x = RNG.standard_normal((30, 3))
    pts = points(spark, x, w=RNG.uniform(1, 2, 30))
    w = np.array(pts.select("w").toPandas()["w"])
    mid = (x * w[:, None]).sum(axis=0) / w.sum()
    assert np.allclose(G.centres(pts, weights="w").first(), mid)
    assert abs(G.gyradius(pts, weights="w").first()[0] - math.sqrt((w * ((x - mid) ** 2).sum(axis=1)).sum() / w.sum())) < 1e-9
    assert G.central_atoms(pts, "atom_index").first()[0] == ((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin()
    ax = G.principal_axes(pts.withColumn("k", F.lit(1)), ("k",)).orderBy("axis").toPandas()
    assert np.allclose(ax["eigval"], np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True) * 30))[::-1])
    moved = G.move(pts, to=(1.0, 2.0, 3.0))
    assert np.allclose(G.centres(moved).first(), (1, 2, 3)) and np.allclose(G.centres(G.move(pts, by=(1.0, 0.0, 0.0))).first(), x.mean(axis=0) + (1, 0, 0))
    inside = G.wrapped(pts, (0.5, 0.5, 0.5)).agg(*[F.max(F.abs(c)) for c in "xyz"]).first()
    assert max(inside) <= 0.25
    assert G.surrounding_box(pts, pts.where("atom_index < 2"), 0.1).where("atom_index < 2").count() == 2
    aniso = spark.createDataFrame([(1, [2.0, 3.0, 1.0, 0.1, 0.2, 0.3])], "atom_index int, anisou array<double>")
    m = np.array([[2, 0.1, 0.2], [0.1, 3, 0.3], [0.2, 0.3, 1]])
    assert np.allclose([r.eigval for r in G.displacement_axes(aniso, "atom_index").orderBy("axis").collect()], np.linalg.eigvalsh(m)[::-1])


def test_torsions_and_blocks(spark):
    rows = [("A", r, n, *map(float, RNG.standard_normal(3) + r)) for r in range(5) for n in ("N", "CA", "C")]
    df = spark.createDataFrame(rows, "chain string, resindex int, name string, x double, y double, z double")
    out = {r.resindex: r for r in G.backbone_torsions(df, ("chain",), furthest=100).collect()}
    at = {(r, n): np.array(p) for _, r, n, *p in rows}

    def tor(a, b, c, d):
        n1, n2 = np.cross(b - a, c - b), np.cross(c - b, d - c)
        return math.degrees(math.copysign(math.acos(n1 @ n2 / np.linalg.norm(n1) / np.linalg.norm(n2)), n1 @ (d - c)))

    assert out[0].phi is None and out[4].psi is None and out[4].omega is None
    assert abs(out[2].phi - tor(at[1, "C"], at[2, "N"], at[2, "CA"], at[2, "C"])) < 1e-6
    assert abs(out[2].psi - tor(at[2, "N"], at[2, "CA"], at[2, "C"], at[3, "N"])) < 1e-6
    assert abs(out[2].omega - tor(at[2, "CA"], at[2, "C"], at[3, "N"], at[3, "CA"])) < 1e-6
    assert G.backbone_torsions(df, ("chain",), furthest=0.01).where("phi is not null").isEmpty()
    res = df.select("chain", "resindex").distinct().withColumn("ss", F.when(F.col("resindex") < 3, "H").otherwise("E"))
    assert [r.block for r in G.rigid_blocks(res, ("chain",), per_block=2).orderBy("resindex").collect()] == [0, 0, 1, 1, 2]
    assert [r.block for r in G.rigid_blocks(res, ("chain",), secondary="ss").orderBy("resindex").collect()] == [0, 0, 0, 1, 1]


# ---- ensembles ------------------------------------------------------------------


def rotated(x, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((3, 3)))
    return x @ (q * np.sign(np.linalg.det(q))).T + seed


def conf_rows(spark, confs):
    rows = [(c, a, *map(float, p)) for c, x in enumerate(confs) for a, p in enumerate(x)]
    return spark.createDataFrame(rows, "conf int, atom int, x double, y double, z double")


def test_superposition(spark):
    base = RNG.standard_normal((12, 3))
    confs = [base] + [rotated(base, s) + 1e-3 * RNG.standard_normal((12, 3)) for s in range(1, 5)]
    df = conf_rows(spark, confs)
    ref = df.where("conf = 0").select("atom", "x", "y", "z")
    moved = E.superposed(df, ref, "conf", "atom")
    assert E.rmsd_to_reference(moved, ref, "conf", "atom").agg(F.max("rmsd")).first()[0] < 0.01
    for r in E.transformations(df, ref, "conf", "atom").collect():
        rot, shift = E.kabsch(confs[r.conf], base)
        assert np.allclose(np.reshape(r.rotation, (3, 3)), rot) and np.allclose(r.shift, shift) and abs(np.linalg.det(rot) - 1) < 1e-9
    done = E.iteratively_superposed(df, "conf", "atom")
    assert E.fluctuations(done, "atom").agg(F.max("rmsf")).first()[0] < 0.01
    msf = {r.atom: r.msf for r in E.fluctuations(df, "atom").collect()}
    assert np.allclose([msf[a] for a in range(12)], np.var(np.array(confs), axis=0).sum(axis=1))
    weighted = {r.atom: (r.msf, r.n) for r in E.fluctuations(df.withColumn("w", (F.col("conf") < 3).cast("double")), "atom", "w").collect()}
    assert np.allclose([weighted[a][0] for a in range(12)], np.var(np.array(confs[:3]), axis=0).sum(axis=1)) and weighted[0][1] == 3


def test_pairs_refinement_covariance(spark):
    x = RNG.standard_normal((40, 6))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "conf long, v array<double>")
    got = E.pairwise_rmsd(df, "conf", "v").toPandas()
    assert len(got) == 780 and np.allclose(got["rmsd"], np.sqrt(((x[got["i"]] - x[got["j"]]) ** 2).sum(axis=1) / 2))
    small = E._block_rows(df, "conf", "v", lambda a, b: (a * b).sum(axis=1), "dot", block=7).toPandas()
    assert len(small) == 780 and np.allclose(small["dot"], (x[small["i"]] * x[small["j"]]).sum(axis=1))
    edges = [(0, 1), (0, 2), (0, 3), (4, 5), (6, 7), (7, 8)]
    conflicts = spark.createDataFrame(edges, "i int, j int")
    left = {r[0] for r in E.refined(conflicts, spark.range(10).select(F.col("id").cast("int").alias("m")), "m", protected=(5,)).collect()}
    assert not any(a in left and b in left for a, b in edges) and {1, 2, 3, 5, 6, 8, 9} == left
    cov = W.vector_covariance(df, "v").toPandas()
    assert np.allclose(cov.sort_values(["i", "j"])["value"].to_numpy().reshape(6, 6), np.cov(x.T, bias=True))
    pcs = W.principal_components(df, "v", n_modes=3).toPandas()
    assert np.allclose(pcs.groupby("mode")["eigval"].first(), np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:3])
    occ = E.trimmed(spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.0), (0, 1, 1.0), (1, 1, 1.0)], "conf int, atom int, w double"), "atom", "w", 0.9)
    assert {r.atom for r in occ.collect()} == {1}


# ---- alignments -----------------------------------------------------------------

SEQS = ["ACD-EFBX", "ACDAEFZX", "AGDAE-JK", "acdaefdk", "WWWW----", "A-DAEFBK"]


@pytest.fixture(scope="module")
def msa(spark):
    return spark.createDataFrame([(i, f"S_{'ABCDEF'[i]}/{10 * i + 1}-{10 * i + 9}", s) for i, s in enumerate(SEQS)], "seq_idx int, label string, seq string")


def shares(column):
    from strandlake.functions.vocabulary import AMBIGUOUS

    out = {}
    for c in column:
        c = c.upper() if c.isalpha() else "-"
        for o in AMBIGUOUS.get(c, c):
            out[o] = out.get(o, 0) + 1 / len(AMBIGUOUS.get(c, c))
    return out


def test_entropy_and_occupancy(msa):
    got = {r.col: r.entropy for r in A.column_entropy(A.cells(msa)).collect()}
    gaps = {r.col: r.entropy for r in A.column_entropy(A.cells(msa), omit_gaps=False).collect()}
    for k in range(8):
        s = shares([q[k] for q in SEQS])
        h = lambda c: -sum(v / sum(c.values()) * math.log(v / sum(c.values())) for v in c.values())
        assert abs(got[k] - h({a: v for a, v in s.items() if a != "-"})) < 1e-9 and abs(gaps[k] - h(s)) < 1e-9
    occ = {r.col: r.occupancy for r in A.occupancy(A.cells(msa)).collect()}
    assert occ == {k: sum(q[k].isalpha() for q in SEQS) / 6 for k in range(8)}
    rows = {r.seq_idx: r.occupancy for r in A.occupancy(A.cells(msa), "seq_idx", count=True).collect()}
    assert rows == {i: sum(c.isalpha() for c in q) for i, q in enumerate(SEQS)}


def joint(i, j):
    from strandlake.functions.vocabulary import AMBIGUOUS

    out = {}
    for q in SEQS:
        a, b = (c.upper() if c.isalpha() else "-" for c in (q[i], q[j]))
        for x, y in itertools.product(AMBIGUOUS.get(a, a), AMBIGUOUS.get(b, b)):
            out[x, y] = out.get((x, y), 0) + 1 / len(AMBIGUOUS.get(a, a)) / len(AMBIGUOUS.get(b, b))
    return out


def test_pair_statistics(msa):
    mi = {(r.i, r.j): r.mi for r in A.mutual_information(A.cells(msa)).collect()}
    nm = {(r.i, r.j): r.mi for r in A.mutual_information(A.cells(msa), norm=True).collect()}
    om = {(r.i, r.j): r.omes for r in A.omes(A.cells(msa)).collect()}
    for i, j in itertools.combinations(range(8), 2):
        p, a, b = joint(i, j), shares([q[i] for q in SEQS]), shares([q[j] for q in SEQS])
        want = sum(v / 6 * math.log(v * 6 / a[x] / b[y]) for (x, y), v in p.items())
        h = -sum(v / 6 * math.log(v / 6) for v in p.values())
        full = 6 * sum((p.get((x, y), 0) / 6 - a[x] * b[y] / 36) ** 2 / (a[x] * b[y] / 36) for x in a for y in b)
        assert abs(mi[i, j] - want) < 1e-9 and abs(nm[i, j] - want / h) < 1e-9 and abs(om[i, j] - full) < 1e-9


def test_coupling_and_direct_information(spark, msa):
    from strandlake.functions.vocabulary import BACKGROUND as Q

    w = np.zeros((6, 8))
    for k in range(8):
        col = [q[k].upper() for q in SEQS]
        f = {c: col.count(c) / 6 for c in set(col) if c.isalpha()}
        phi = {c: 0.0 if c not in Q or f[c] >= 1 else abs(math.log(f[c] * (1 - Q[c]) / ((1 - f[c]) * Q[c]))) for c in f}
        size = math.sqrt(sum((f[c] * phi[c]) ** 2 for c in f))
        w[:, k] = [f[c] * phi[c] ** 2 / size if c in f and size else 0.0 for c in col]
    got = {(r.i, r.j): r.sca for r in A.coupling(A.cells(msa)).collect()}
    want = np.abs(np.cov(w.T, bias=True))
    assert all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(8) for j in range(i, 8))
    weights = A.effective_sequences(A.mismatches(msa), msa, seqid=0.6)
    di = A.direct_information(msa, weights).toPandas()
    assert len(di) == 28 and np.isfinite(di["di"]).all() and (di["di"] > -1e-9).all()


def test_identity_unique_weights(msa):
    def ident(a, b):
        some = [(x, y) for x, y in zip(a, b) if x.isalpha() or y.isalpha()]
        return sum(x == y for x, y in some) / len(some) if some else 0.0

    got = {(r.i, r.j): r.identity for r in A.identities(msa).collect()}
    assert all(abs(got[i, j] - ident(SEQS[i], SEQS[j])) < 1e-9 for i, j in itertools.combinations(range(6), 2))
    for least in (0.3, 0.5, 0.7):
        kept = []
        for i, s in enumerate(SEQS):
            if all(ident(SEQS[k], s) < least for k in kept):
                kept.append(i)
        assert sorted(r.seq_idx for r in A.unique_rows(msa, A.identities(msa), least=least).collect()) == kept
    up = lambda s: "".join(c if c.isupper() else "-" for c in s)
    want = [1 / sum(sum(x != y for x, y in zip(up(a), up(b))) / 8 < 0.5 for b in SEQS) for a in SEQS]
    weights = {r.seq_idx: r.weight for r in A.effective_sequences(A.mismatches(msa), msa, seqid=0.5).collect()}
    assert np.allclose([weights[i] for i in range(6)], want)


def test_refine_merge_labels(spark, msa):
    cut = A.refined(msa, reference="S_F/51-59").select("seq_idx", "seq").collect()
    keep = [k for k, c in enumerate(SEQS[5]) if c.isalpha()]
    assert {r.seq_idx: r.seq for r in cut} == {i: "".join(s[k] for k in keep) for i, s in enumerate(SEQS)}
    assert sorted(r.seq_idx for r in A.refined(msa, row_occupancy=0.8).collect()) == [0, 1, 2, 3, 5]
    some = A.refined(msa, column_occupancy=0.9).first().seq
    assert len(some) == sum(sum(q[k].isalpha() for q in SEQS) / 6 >= 0.9 for k in range(8))
    other = spark.createDataFrame([("S_A/1-9", "QQ"), ("S_B/11-19", "RR"), ("S_B/11-19", "SS")], "label string, seq string")
    assert [tuple(r) for r in A.merged(msa, other).collect()] == [("S_A/1-9", SEQS[0] + "QQ")]
    assert A.merged(msa, other.limit(1), A.species()).first().label == "A"
    nums = [(r.col, r.resnum) for r in A.residue_numbers(msa.where("seq_idx = 2")).orderBy("col").collect()]
    assert nums == [(0, 21), (1, 22), (2, 23), (3, 24), (4, 25), (6, 26), (7, 27)]
    parts = msa.select(*A.label_parts()).first()
    assert tuple(parts) == ("S_A", 1, 9)
    ranks = A.ranked(A.mutual_information(A.cells(msa)), "mi", zscore=True).orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 29)) and all(a.mi >= b.mi for a, b in zip(ranks, ranks[1:]))


# ---- interactions ---------------------------------------------------------------


def test_detection(spark):
    rows = [
        (0, "NZ", "LYS", 1, "A", 0.0, 0.0, 0.0), (1, "OD1", "ASP", 9, "B", 3.0, 0.5, 0.0), (2, "OD2", "ASP", 9, "B", 3.0, -0.5, 0.0),
        (3, "SG", "CYS", 20, "A", 10.0, 0.0, 0.0), (4, "SG", "CYS", 40, "A", 12.0, 0.0, 0.0), (5, "CB", "CYS", 20, "A", 9.5, 1.5, 0.0), (6, "CB", "CYS", 40, "A", 12.5, 0.0, 1.5),
        (7, "N", "ALA", 50, "A", 20.0, 0.0, 0.0), (8, "H", "ALA", 50, "A", 21.0, 0.0, 0.0), (90, "O", "GLY", 80, "A", 22.9, 0.2, 0.0),
        (100, "CB", "VAL", 90, "A", 30.0, 0.0, 0.0), (101, "CG1", "VAL", 90, "A", 31.0, 0.0, 0.0), (140, "CD1", "ILE", 120, "A", 34.0, 0.0, 0.0), (141, "CB", "ILE", 120, "A", 33.5, 0.0, 2.0),
        (200, "ZN", "ZN", 300, "A", 40.0, 0.0, 0.0), (201, "ND1", "GLN", 301, "A", 42.0, 0.0, 0.0), (202, "NZ", "LYS", 5, "A", 1.0, 3.0, 0.0),
    ]
    for ring, (z, resnum, first) in enumerate(((0.0, 400, 300), (4.0, 410, 320))):
        rows += [(first + k, n, "PHE", resnum, "C", 60 + 1.4 * math.cos(k * math.pi / 3), 1.4 * math.sin(k * math.pi / 3), z) for k, n in enumerate(("CG", "CD1", "CE1", "CZ", "CE2", "CD2"))]
    rows.append((350, "NZ", "LYS", 420, "C", 60.0, 0.0, 8.5))
    atoms = spark.createDataFrame(rows, "atom_index int, name string, resname string, resnum int, chain string, x double, y double, z double")
    of = lambda f, **kw: [(r.res1, r.res2, r.distance, r.metric) for r in f(atoms, **kw).collect()]
    assert [x[:2] for x in of(I.salt_bridges)] == [("LYS1", "ASP9"), ("LYS5", "ASP9")]
    assert [x[:3] for x in of(I.repulsive_ionic)] == [("LYS1", "LYS5", 3.1623)]
    assert [x[:3] for x in of(I.disulfides)] == [("CYS20", "CYS40", 2.0)]
    hb = of(I.hydrogen_bonds)
    assert [x[:2] for x in hb] == [("ALA50", "GLY80")] and hb[0][3] < 40
    assert [x[:3] for x in of(I.hydrophobic)] == [("VAL90", "ILE120", 3.0)]
    assert [x[:3] for x in of(I.metal_contacts)] == [("ZN300", "GLN301", 2.0)]
    stack = of(I.pi_stacking)
    assert [x[:3] for x in stack] == [("PHE400", "PHE410", 4.0)] and abs(stack[0][3] % 180) < 1e-3
    assert [x[:3] for x in of(I.pi_cation)] == [("PHE410", "LYS420", 4.5)]
    both = atoms.crossJoin(spark.createDataFrame([(0,), (1,)], "frame int"))
    assert I.all_interactions(both, ("frame",)).groupBy("frame").count().select("count").distinct().count() == 1
    assert I.between_chains(I.salt_bridges(atoms)).count() == 2
    plan = I.hydrogen_bonds(atoms)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bridges_and_records(spark):
    bonds = spark.createDataFrame([(1, 10), (10, 2), (10, 11), (11, 3), (11, 12), (12, 4), (20, 21)], "i int, j int")
    waters = spark.createDataFrame([(w,) for w in (10, 11, 12, 21)], "atom int")
    got = {tuple(r.path): r.n_waters for r in I.water_bridges(bonds, waters, depth=3).collect()}
    assert got == {(1, 10, 2): 1, (1, 10, 11, 3): 2, (2, 10, 11, 3): 2, (3, 11, 12, 4): 2, (1, 10, 11, 12, 4): 3, (2, 10, 11, 12, 4): 3}
    clusters = {(r.cluster, r.atom) for r in I.bridge_clusters(bonds, waters).collect()}
    assert clusters == {(10, a) for a in (1, 2, 3, 4, 10, 11, 12)}
    rows = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("a", "c", 3)], "p string, q string, n int")
    assert sorted(r.n for r in I.without_repeats(rows, ("p", "q"), "n").collect()) == [1, 3]
    assert {r.partner for r in I.partners(rows, "p", "q", "a").collect()} == {"b", "c"}
    chosen = spark.createDataFrame([("a",), ("b",)], "k string")
    assert I.with_ends_in(rows, "p", "q", chosen, "k", both=True).count() == 2 and I.with_ends_in(rows, "p", "q", chosen, "k").count() == 3


# ---- networks -------------------------------------------------------------------


def test_networks_against_dense(spark):
    x = RNG.uniform(0, 12, (25, 3))
    atoms = points(spark, x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = (d <= 8) & (d > 0)
    k = np.diag(near.sum(axis=1)) - near.astype(float)
    got = np.zeros((25, 25))
    kirchhoff = P.stored(W.kirchhoff(atoms, "atom_index", 8.0), "k")
    for r in kirchhoff.collect():
        got[r.i, r.j] = r.value
    assert np.allclose(got, k)
    values, vectors = np.linalg.eigh(k)
    modes = P.stored(W.modes(kirchhoff, n_modes=None), "modes")
    assert np.allclose(sorted(modes.toPandas().groupby("mode")["eigval"].first()), values[1:])
    inv = np.linalg.pinv(k)
    flucts = {r.node: r.sqfluct for r in W.square_fluctuations(modes).collect()}
    assert np.allclose([flucts[i] for i in range(25)], np.diag(inv))
    cc = {(r.i, r.j): r.value for r in W.cross_correlations(modes).collect()}
    assert all(abs(cc[i, j] - inv[i, j] / math.sqrt(inv[i, i] * inv[j, j])) < 1e-8 for i in range(25) for j in range(25))
    h = np.zeros((75, 75))
    for i, j in zip(*np.nonzero(near)):
        r = x[j] - x[i]
        block = -np.outer(r, r) / (r @ r)
        h[3 * i : 3 * i + 3, 3 * j : 3 * j + 3] = block
        h[3 * i : 3 * i + 3, 3 * i : 3 * i + 3] -= block
    hess = P.stored(W.hessian(atoms, "atom_index", 8.0), "h")
    gh = np.zeros((75, 75))
    for r in hess.collect():
        gh[3 * r.i + r.p, 3 * r.j + r.q] = r.value
    assert np.allclose(gh, h)
    am = P.stored(W.modes(hess, n_modes=10, axes=3), "am")
    assert np.allclose(sorted(am.toPandas().groupby("mode")["eigval"].first()), [v for v in np.linalg.eigvalsh(h) if v > 1e-6][:10])
    same = W.overlaps(am, am).toPandas()
    assert np.allclose(same[same.mode_a == same.mode_b]["overlap"], 1) and abs(W.subspace_overlap(W.overlaps(am, am)).first()[0] - 1) < 1e-6
    assert abs(W.spectral_overlap(am, am).first()[0] - 1) < 1e-4 and abs(W.weighted_inner_product(am, am).first()[0] - 1) < 1e-6
    shares_ = W.variance_shares(am).agg(F.sum("share")).first()[0]
    assert abs(shares_ - 1) < 1e-9 and W.modes_covering(am, 0.01).select("mode").distinct().count() == 1
    keep = spark.createDataFrame([(i,) for i in range(10)], "node long")
    red = np.zeros((10, 10))
    for r in W.reduced(kirchhoff, keep).collect():
        red[r.i, r.j] = r.value
    assert np.allclose(red, k[:10, :10] - k[:10, 10:] @ np.linalg.solve(k[10:, 10:], k[10:, :10]))
    with pytest.raises(ValueError):
        W.kirchhoff(atoms, "atom_index", 2.0)
    col = {r.mode: r.collectivity for r in W.collectivity(am).collect()}
    assert all(0 < v <= 3 for v in col.values())


def test_walks_samples_hinges(spark):
    a = np.array([[0, 1, 0, 2], [1, 0, 3, 0], [0, 3, 0, 1], [2, 0, 1, 0]], float)
    df = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(4) for j in range(4) if a[i, j]], "i int, j int, value double")
    t = a / a.sum(axis=1)[:, None]
    for r in W.hit_times(df).collect():
        if r.j == 3 and r.i != 3:
            others = [k for k in range(4) if k != 3]
            want = np.linalg.solve(np.eye(3) - t[np.ix_(others, others)], np.ones(3))
            assert abs(r.hit - want[others.index(r.i)]) < 1e-8
    modes = spark.createDataFrame([(0, 2.0, n, 0, float(v)) for n, v in enumerate(np.array((0.5, 0.4, -0.2, -0.6, 0.3)) / math.sqrt(0.9))], "mode int, variance double, node int, axis int, v double")
    assert [r.node for r in W.hinges(modes).orderBy("node").collect()] == [2, 4]
    assert sorted((r.node, r.band) for r in W.hinge_bands(modes).collect()) == [(2, 0), (4, 1)]
    coords = spark.createDataFrame([(n, 0, float(n)) for n in range(5)], "node int, axis int, value double")
    step = W.traversed(modes, coords, 0, steps=2, rmsd=1.0).where("step = 2").join(coords.withColumnRenamed("value", "was"), ["node", "axis"])
    assert abs(step.agg(F.sqrt(F.avg((F.col("value") - F.col("was")) ** 2))).first()[0] - 1) < 1e-9
    drawn = W.sampled(modes, coords, 200, rmsd=0.7, seed=3).join(coords.withColumnRenamed("value", "was"), ["node", "axis"])
    rms = drawn.groupBy("conf").agg(F.sqrt(F.avg((F.col("value") - F.col("was")) ** 2)).alias("r")).agg(F.avg("r")).first()[0]
    assert abs(rms - 0.7) < 1e-6
    sig = W.signature(spark.createDataFrame([(1, 1.0, 1.0), (1, 3.0, 1.0), (1, 9.0, 0.0)], "n int, v double, w double"), ("n",), "v", "w").first()
    assert (sig.mean, sig.stddev, sig.min, sig["max"]) == (2.0, 1.0, 1.0, 3.0)


# ---- matrices and clusters -----------------------------------------------------


def triples(spark, m):
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m)) if m[i, j]], "i int, j int, value double")


def dense(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.i, r.j] = r.value
    return out


def test_contact_maps(spark):
    m = RNG.integers(1, 9, (6, 6)).astype(float)
    m = m + m.T
    df = triples(spark, m)
    r = m.sum(axis=1)
    for root in (False, True):
        by = np.sqrt(np.outer(r, r)) if root else np.outer(r, r)
        assert np.allclose(dense(M.coverage_normalised(df, root), 6), m / by * m.sum() / (m / by).sum())
    s = dense(M.sequentially_normalised(df), 6)
    assert np.allclose(s, s.T) and np.ptp(s.sum(axis=1)) / s.sum(axis=1).mean() < 1e-2 and abs(s.sum() - m.sum()) < 1e-6
    assert M.is_symmetric(df) and not M.is_symmetric(df.where("i <= j"))
    f = spark.createDataFrame([(i, 2.0) for i in range(6)], "at int, f double")
    assert np.allclose(dense(M.vector_normalised(df, f), 6), m / 4) and np.allclose(dense(M.vector_normalised(df, f, True), 6), m / 2)
    loci = spark.createDataFrame([(0,), (10,), (20,), (35,)], "p int")
    assert M.bin_width(loci, "p").first()[0] == 10
    runs = [(r.s, r["first"], r["last"]) for r in M.domains(spark.createDataFrame(list(enumerate("AABBA")), "k int, s string"), "k", "s").orderBy("first").collect()]
    assert runs == [("A", 0, 1), ("B", 2, 3), ("A", 4, 4)]


def test_clusters(spark):
    x = np.concatenate([RNG.normal(c, 0.1, (8, 2)) for c in (0, 5, 10)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    pairs = triples(spark, np.triu(d))
    label = np.repeat([1, 2, 3], 8)
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "k int, cluster int")
    mid = {r.cluster: r.medoid for r in M.medoids(pairs, labels, "k", "cluster").collect()}
    want = {c: int(np.flatnonzero(label == c)[d[np.ix_(label == c, label == c)].sum(axis=1).argmin()]) for c in (1, 2, 3)}
    assert mid == want
    st_ = {r.cluster: r for r in M.cluster_statistics(pairs, labels, "k", "cluster").collect()}
    own = d[label == 2][:, want[2]]
    assert np.allclose([st_[2]["mean"], st_[2].stddev, st_[2].median, st_[2].p95], [own.mean(), own.std(), np.median(own), np.percentile(own, 95)])
    same = lambda rows, c: len({(label[r[0]], r[1]) for r in rows}) == c
    assert same([(r.node, r.cluster) for r in M.hierarchical_clusters(pairs).collect()], 3)
    assert same([(r.k, r.cluster) for r in M.dbscan(pairs, labels, "k", eps=1.0, least=3).collect()], 3)
    assert same([(r.node, r.cluster) for r in M.k_medoids(pairs, 3).collect()], 3)
    assert same([(r.k, r.cluster) for r in M.neighbour_count_clusters(pairs, labels, "k", 2.0).collect()], 3)
    vec = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "k int, v array<double>")
    assert same([(r.k, r.cluster) for r in M.k_means(vec, "v", 3).collect()], 3)
    text = M.tree(pairs).first()[0]
    assert text.endswith(";") and text.count("(") == 23 and M.newick(list("abcd"), d[:4, :4], "nj").count(",") == 3


# ---- records, hierarchy, iteration ---------------------------------------------


def test_ontology_and_text(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("f", "c")], "child string, parent string")
    up = {(r.node, r.ancestor): r.steps for r in P.closure(edges).collect()}
    assert up["e", "a"] == 3 and up["d", "d"] == 0 and ("a", "b") not in up
    pairs = spark.createDataFrame([("e", "f"), ("d", "d"), ("b", "c")], "a string, b string")
    got = {(r.a, r.b): r.length for r in R.branch_lengths(edges, pairs).collect()}
    assert got == {("e", "f"): 3, ("d", "d"): 0, ("b", "c"): 2}
    assert {r.t for r in R.deepest_terms(spark.createDataFrame([("a",), ("e",), ("f",)], "t string"), edges, "t").collect()} == {"e", "f"}
    n = spark.createDataFrame([(v,) for v in (1, 2, 3, 7, 9, 10)], "n int")
    assert R.ranges_text(n, "n").first()[0] == "1 to 3 7 9 to 10"
    for width, values in ((5, (0, 99999, 100000, 100001, 43770015, 43770016, 87440031)), (4, (9999, 10000, 1223055, 1223056))):
        df = spark.createDataFrame([(v,) for v in values], "n long").withColumn("t", R.to_hybrid36(F.col("n"), width))
        assert [r.b for r in df.select(R.from_hybrid36(F.col("t"), width).alias("b")).collect()] == list(values)
    assert spark.range(1).select(R.to_hybrid36(F.lit(100000).cast("long")), R.to_hybrid36(F.lit(43770016).cast("long"))).first()[:] == ("A0000", "a0000")
    gaps = spark.createDataFrame([(0, None), (1, 1.0), (2, None), (3, 3.0), (4, None)], "t int, v double")
    assert [r.v for r in R.interpolated(gaps, "t", "v").orderBy("t").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0]
    one = spark.createDataFrame([([1, 0, 1], "a-b c", 1.0, 0.0)], "bits array<int>, s string, a double, b double")
    assert tuple(one.select(R.from_bits(F.col("bits")), R.alphanumeric(F.col("s")), R.divided(F.col("a"), F.col("b"), -1.0)).first()) == (5, "a_b_c", -1.0)
    codes = spark.createDataFrame([("1.10", "1abcA00"), ("1.1", "2xyzB01")], "c string, d string")
    assert R.under(codes, "c", "1.1").count() == 1 and R.classified(codes, "c", "d", "1abc").count() == 1


def test_hierarchy(spark):
    rows = [(0, "S", "B", 1, ""), (1, "S", "B", 2, ""), (2, "S", "A", 1, ""), (3, "S", "B", 1, ""), (4, "T", "B", 1, "")]
    df = spark.createDataFrame(rows, "atom_index int, segment string, chain string, resnum int, icode string").withColumn("resname", F.when(F.col("resnum") == 1, "ALA").otherwise("XXX"))
    out = H.indexed(df).orderBy("atom_index").collect()
    assert [r.segindex for r in out] == [0, 0, 0, 0, 1] and [r.chindex for r in out] == [0, 0, 1, 0, 2] and [r.resindex for r in out] == [0, 1, 2, 0, 3]
    assert {r.chindex: r.sequence for r in H.sequences(H.indexed(df), ("chindex",)).collect()} == {0: "AX", 1: "A", 2: "A"}
    pairs = H.matched_chains(df.where("segment = 'S'"), df.where("segment = 'S'"), 0, 0)
    assert {(r.chain_a, r.chain_b): r.coverage for r in pairs.collect()}["A", "B"] == 50.0
    move = spark.createDataFrame([("1", "A", 0, [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0])], "biomol string, chain string, copy int, rotation array<double>, shift array<double>")
    r = H.assemblies(df.where("chain = 'A'").withColumns({"x": F.lit(2.0), "y": F.lit(3.0), "z": F.lit(4.0)}), move).first()
    assert (r.x, r.y, r.z) == (-2.0, 2.0, 4.0)


def test_components_beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(P, "LINKS", 5)
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(500, k) for k in range(501, 560)] + [(700 - k, 701 - k) for k in range(30)]
    got = {r.node: r.component for r in P.components(spark.createDataFrame(edges, "i long, j long")).collect()}
    want = {i: i // 20 * 20 for i in range(60)} | {k: 500 for k in range(500, 560)} | {k: 671 for k in range(671, 702)}
    assert got == want
    assert P.components(spark.createDataFrame([], "i long, j long")).count() == 0


def test_closure_of_a_long_chain(spark):
    up = P.closure(spark.createDataFrame([(k, k + 1) for k in range(130)], "child long, parent long")).collect()
    assert {(r.node, r.ancestor, r.steps) for r in up} == {(a, b, b - a) for a in range(131) for b in range(a, 131)}


def test_unstable_state_is_an_error(spark):
    with pytest.raises(RuntimeError):
        P.until_stable(spark.range(1), lambda s: s.select((s["id"] + 1).alias("id")), "unstable", most=3)


# ---- modes by the published rules ----------------------------------------------


def slow_hinges(v):
    """The side of each sign change nearer zero, moved on while values fall."""
    out = set()
    for j in range(len(v) - 1):
        if np.sign(v[j]) != np.sign(v[j + 1]):
            while j + 1 < len(v) and abs(v[j + 1]) < abs(v[j]):
                j += 1
            out.add(j)
    return out


def slow_bands(v, threshold, space):
    band, n, regions = math.sqrt(1 / len(v)) / threshold, len(v), []
    for i in range(n - 1):
        if np.sign(v[i]) != np.sign(v[i + 1]):
            lo, hi = i, i + 1
            while abs(v[lo]) < band and lo > 0 and abs(v[lo - 1]) < band:
                lo -= 1
            while abs(v[hi]) < band and hi < n - 1 and abs(v[hi + 1]) < band:
                hi += 1
            regions.append((lo, hi))
    s, merged = 0 if space is None else 1 + space, []
    for lo, hi in sorted(regions):
        if merged and lo <= merged[-1][1] + s:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    out = set()
    for lo, hi in merged:
        near = sorted(range(lo, hi + 1), key=lambda k: (abs(v[k]), k))
        out |= set(near[:2]) if hi - lo + 1 >= s + 4 else set() if v[lo] * v[hi] > 0 else {near[0]}
    return out


def test_hinges_of_hand_worked_and_random_vectors(spark):
    rng = np.random.default_rng(8)
    vectors = [[0.5, 0.4, 0.01, -0.02, 0.03, -0.3, -0.6], [0.3, -0.1, 0.1, -0.3, 0.9], [1.0, 2.0, 3.0], [0.2, -0.5, -0.4, -0.1, 0.0, 0.4]]
    vectors += [list(np.cumsum(rng.standard_normal(40)) * rng.choice([0.02, 0.1, 1.0])) for _ in range(12)]
    df = spark.createDataFrame([(m, n, float(x)) for m, v in enumerate(vectors) for n, x in enumerate(v)], "mode int, node int, v double")
    got = lambda rows: {m: {r.node for r in rows if r.mode == m} for m in range(len(vectors))}
    assert got(W.hinges(df).collect()) == {m: slow_hinges(v) for m, v in enumerate(vectors)}
    assert slow_hinges(vectors[1]) == {1, 2, 3}
    for threshold, space in ((15.0, None), (1.0, None), (1.0, 0), (2.0, 3)):
        assert got(W.hinge_bands(df, threshold=threshold, space=space).collect()) == {m: slow_bands(v, threshold, space) for m, v in enumerate(vectors)}


def test_collectivity_and_dimension_by_formula(spark):
    v, mass = np.array([1.0, 0.5, -2.0, 0.25]), np.array([2.0, 1.0, 4.0, 1.0])
    df = spark.createDataFrame([(0, n, float(x)) for n, x in enumerate(v)], "mode int, node int, v double")
    masses = spark.createDataFrame([(n, float(x)) for n, x in enumerate(mass)], "node int, mass double")
    for m, given in ((np.ones(4), None), (mass, masses)):
        u = v**2 / m
        u = u / math.sqrt(u.sum())
        assert abs(W.collectivity(df, masses=given).first().collectivity - math.exp(-(u * np.log(u)).sum()) / 4) < 1e-9
    eigval = np.sort(np.random.default_rng(1).random(16) + 0.1)
    modes = spark.createDataFrame([(k, float(x)) for k, x in enumerate(eigval)], "mode int, eigval double")
    want = np.polyfit(np.log(np.sqrt(eigval[:4])), np.log(np.arange(2, 6)), 1)[0]
    assert abs(W.spectral_dimension(modes).first().dimension - want) < 1e-9


def test_entropy_transfer_by_determinants(spark):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((6, 6)))
    lam = rng.random(5) + 0.3
    df = spark.createDataFrame([(k, float(lam[k]), 1 / float(lam[k]), n, 0, float(q[n, k])) for k in range(5) for n in range(6)], "mode int, eigval double, variance double, node int, axis int, v double")
    entropy = lambda m: 0.5 * math.log(np.linalg.det(m))

    def transfer(i, j, tau):
        now, later = (q[:, :5] / lam) @ q[:, :5].T, (q[:, :5] / lam * np.exp(-lam * tau)) @ q[:, :5].T
        future = np.array([[now[j, j], later[j, j]], [later[j, j], now[j, j]]])
        both = np.array([[now[j, j], later[j, j], later[i, j]], [later[j, j], now[j, j], now[i, j]], [later[i, j], now[i, j], now[i, i]]])
        past = np.array([[now[j, j], now[i, j]], [now[i, j], now[i, i]]])
        return entropy(future) - entropy(both) - 0.5 * math.log(now[j, j]) + entropy(past)

    one = {(r.i, r.j): r.value for r in W.entropy_transfer(df, 0.7).collect()}
    assert len(one) == 30 and all(abs(v - transfer(i, j, 0.7)) < 1e-9 for (i, j), v in one.items())
    net = {(r.i, r.j): r.value for r in W.net_entropy_transfer(W.entropy_transfer(df, 0.7)).collect()}
    assert all(abs(v - (one[i, j] - one[j, i])) < 1e-12 for (i, j), v in net.items())
    whole = {(r.i, r.j): r.value for r in W.overall_entropy_transfer(df).collect()}
    want = np.trapezoid([transfer(0, 1, t) for t in W.TIMES], W.TIMES)
    assert abs(whole[0, 1] - want) < 1e-9


def test_depths_are_longest_paths(spark):
    edges = spark.createDataFrame([("b", "r"), ("c", "b"), ("d", "c"), ("d", "r")], "child string, parent string")
    assert {r.node: r.depth for r in R.depths(edges).collect()} == {"r": 0, "b": 1, "c": 2, "d": 3}
    assert R.branch_lengths(edges, spark.createDataFrame([("d", "b")], "a string, b string")).first().length == 2
    chain = P.closure(spark.createDataFrame([(k, k + 1) for k in range(300)], "child long, parent long"))
    assert chain.count() == 301 * 302 // 2 and chain.where("node = 0 AND ancestor = 300").first().steps == 300
    with pytest.raises(ValueError):
        P.longest_paths(edges.unionByName(spark.createDataFrame([("r", "d")], "child string, parent string")))
    loop = {(r.node, r.ancestor): r.steps for r in P.closure(spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "child long, parent long")).collect()}
    assert loop == {(a, b): (b - a) % 3 for a in range(3) for b in range(3)}


def test_bonds_by_distance_and_coincident_points(spark):
    rows = [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 2.0, 0.0, 0.0), (3, 2.0, 0.0, 0.0), (4, None, 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, "k int, x double, y double, z double")
    assert {(r.i, r.j) for r in N.inferred_bonds(atoms, "k").collect()} == {(0, 1), (1, 2), (1, 3)}
    assert {(r.i, r.j) for r in N.inferred_bonds(atoms, "k", furthest=2.0, nearest=1.0).collect()} == {(0, 2), (0, 3)}
    p = lambda *v: tuple(F.lit(float(x)) for x in v)
    one = spark.range(1).select(G.angle(p(0, 0, 0), p(0, 0, 0), p(1, 0, 0)).alias("a"), G.dihedral(p(0, 0, 0), p(1, 0, 0), p(2, 0, 0), p(3, 1, 0)).alias("t")).first()
    assert one.a is None and one.t is None


def test_unsettled_loops_raise(spark):
    m = spark.createDataFrame([(0, 1, 5.0), (1, 0, 1.0), (0, 0, 2.0), (1, 1, 9.0)], "i int, j int, value double")
    with pytest.raises(RuntimeError):
        M.sequentially_normalised(m, tolerance=-1.0, most=2)
    points = spark.createDataFrame([], "k int")
    assert M.neighbour_count_clusters(m.limit(0), points, "k", 1.0).count() == 0


def test_mmcif_files_of_one_name_stay_apart(spark, tmp_path):
    from strandlake.sources import structures as X

    row = "ATOM {} C CA . ALA {} 1 . {} 0.0 0.0 1.0 0.0"
    items = "group_PDB id type_symbol auth_atom_id label_alt_id auth_comp_id auth_asym_id auth_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z occupancy B_iso_or_equiv".split()
    for folder, chain in (("a", "A"), ("b", "B")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.cif").write_text("data_x\nloop_\n" + "".join(f"_atom_site.{i}\n" for i in items) + "\n".join(row.format(k, chain, float(k)) for k in range(3)))
    out = X.read_mmcif(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted((r.chain, r.atom_index, r.x) for r in out.collect()) == [(c, k, float(k)) for c in "AB" for k in range(3)]
