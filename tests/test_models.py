"""Further models, surfaces, mappings and the command line against numpy and plain Python."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake import cli
from strandlake.operators import mapping as Y
from strandlake.operators import models as L
from strandlake.operators import networks as W
from strandlake.operators import surfaces as U
from strandlake.plans.iteration import stored

RNG = np.random.default_rng(5)
X = RNG.uniform(0, 10, (18, 3))


@pytest.fixture(scope="module")
def atoms(spark):
    pdf = pd.DataFrame({"atom_index": range(18), "x": X[:, 0], "y": X[:, 1], "z": X[:, 2], "chain": ["A"] * 9 + ["B"] * 9, "resnum": list(range(9)) * 2, "secondary": ["H", "E", "C"] * 6, "radius": [4.0] * 9 + [None] * 9})
    return spark.createDataFrame(pdf).withColumn("radius", F.when(~F.isnan("radius"), F.col("radius")))


def test_springs(atoms):
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(axis=2))
    got = {(r.i, r.j): r.value for r in L.springs(atoms, "atom_index", 8.0, L.by_structure(), ("chain", "resnum", "secondary")).collect()}
    for i, j in itertools.permutations(range(18), 2):
        if d[i, j] > 8:
            assert (i, j) not in got
        elif i // 9 == j // 9 and abs(i - j) == 1:
            assert got[i, j] == 10.0
    radii = {(r.i, r.j) for r in L.springs(atoms, "atom_index", 20.0, L.by_radii(3.0), ("radius",)).collect()}
    reach = [4.0] * 9 + [3.0] * 9
    assert radii == {(i, j) for i, j in itertools.permutations(range(18), 2) if d[i, j] <= reach[i] + reach[j]}
    plain = L.springs(atoms, "atom_index", 8.0, lambda d, a, b: F.lit(1.0))
    same = {(r.i, r.p, r.j, r.q): r.value for r in L.hessian_from(plain).collect()}
    want = {(r.i, r.p, r.j, r.q): r.value for r in W.hessian(atoms, "atom_index", 8.0).collect()}
    assert set(same) == set(want) and all(abs(same[k] - want[k]) < 1e-9 for k in want)
    assert L.springs(atoms, "atom_index", 12.0, L.by_sequence_and_space(), ("chain", "resnum")).where("value <= 0").isEmpty()


def test_rigid_blocks_and_membrane(spark, atoms):
    h = stored(W.hessian(atoms, "atom_index", 12.0), "h")
    coords = atoms.select(F.col("atom_index").alias("node"), "x", "y", "z")
    alone = coords.select("node", F.col("node").alias("block"))
    full = W.modes(h, n_modes=5, axes=3).toPandas().groupby("mode")["eigval"].first()
    single = L.rigid_block_modes(h, coords, alone, 5).toPandas().groupby("mode")["eigval"].first()
    assert np.allclose(full, single)
    two = L.rigid_block_modes(h, coords, coords.select("node", (F.col("node") >= 9).cast("int").alias("block")), 20).toPandas()
    assert two["mode"].nunique() == 6
    m = L.membrane_nodes(atoms, "atom_index", 0.0, 10.0, margin=6.0, clear=3.0).toPandas()
    assert len(m) and m["atom_index"].min() == 18 and (np.sqrt(((m[list("xyz")].to_numpy()[:, None] - X[None]) ** 2).sum(axis=2)).min() > 3.0)


def test_classes_and_matching(spark):
    a = RNG.normal((0, 0, 0), (1, 0.1, 1), (80, 3))
    b = RNG.normal((0, 2, 0), (1, 0.1, 1), (80, 3))
    rows = [(0, list(map(float, v))) for v in a] + [(1, list(map(float, v))) for v in b]
    df = spark.createDataFrame(rows, "label int, v array<double>")
    first = L.discriminant(df, "v", "label", 1).orderBy("node").toPandas()["v"].abs().tolist()
    assert first[1] > 0.95
    w = L.logistic(df, "v", "label").toPandas()
    assert w.loc[w["v"].abs().idxmax(), "node"] == 1
    cost = RNG.uniform(0, 1, (5, 6))
    best = min(sum(cost[i, p[i]] for i in range(5)) for p in itertools.permutations(range(6), 5))
    assert abs(sum(cost[i, j] for i, j in L.assignment(cost)) - best) < 1e-9
    assert abs(sum(cost.T[i, j] for i, j in L.assignment(cost.T)) - best) < 1e-9
    o = spark.createDataFrame([(0, 0, 0.1), (0, 1, -0.9), (1, 0, 0.8), (1, 1, 0.7)], "mode_a int, mode_b int, overlap double")
    assert {(r.mode_a, r.mode_b) for r in L.matched(o).collect()} == {(0, 1), (1, 0)}


def test_mode_families_and_scans(spark, atoms):
    m = stored(W.modes(W.hessian(atoms, "atom_index", 12.0), n_modes=4, axes=3), "m")
    both = stored(m.withColumn("member", F.lit("p")).unionByName(m.withColumn("member", F.lit("q"))), "both")
    pairs = stored(L.ensemble_spectral_overlaps(both, "member"), "pairs")
    assert {(r.a, r.b): round(r.overlap, 4) for r in pairs.collect()} == {("p", "p"): 1.0, ("p", "q"): 1.0, ("q", "q"): 1.0}
    fam = spark.createDataFrame([("p", "f"), ("q", "f")], "member string, family string")
    assert L.subfamily_overlaps(pairs, fam, "member", "family", 2).first().overlap > 0.999
    an = {r.node: r.anisou for r in L.anisotropic_factors(m).collect()}
    fl = {r.node: r.sqfluct for r in W.square_fluctuations(m).collect()}
    assert all(abs(sum(an[k][:3]) - fl[k]) < 1e-9 for k in fl)
    assert L.pair_deformations(m, atoms.withColumnRenamed("atom_index", "node"), 0, 5).count() == 4
    assert L.rank_scores(W.collectivity(m)).count() == 4
    heavy = spark.createDataFrame([(r, *map(float, X[r] + RNG.normal(0, 1, 3))) for r in range(5) for _ in range(4)], "residue int, x double, y double, z double")
    scan = L.essential_residues(atoms.withColumnRenamed("atom_index", "node"), heavy, cutoff=7.0, n_modes=5).toPandas()
    assert len(scan) == 5 and abs(scan["zscore"].mean()) < 1e-9
    start = atoms.withColumnRenamed("atom_index", "node").select("node", "x", "y", "z")
    end = start.withColumn("x", F.col("x") + (F.col("x") - float(X[:, 0].mean())) * 0.1)  # no rigid shift, which modes leave out
    path = L.adaptive_path(start, end, steps=3, n_modes=48).join(end.select("node", F.col("x").alias("tx")), "node")
    left = [r.r for r in path.groupBy("step").agg(F.sqrt(F.avg((F.col("x") - F.col("tx")) ** 2)).alias("r")).orderBy("step").collect()]
    assert left == sorted(left, reverse=True) and left[-1] < 0.9 * left[0]


def test_surfaces(spark):
    one = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 2.0)], "atom_index int, x double, y double, z double, radius double")
    assert abs(U.accessible_surface(one).first().area - 4 * math.pi * 3.4**2) < 1e-9
    two = one.unionByName(spark.createDataFrame([(1, 3.0, 0.0, 0.0, 2.0)], one.schema))
    cap = 2 * math.pi * 3.4 * (3.4 - 1.5)
    assert abs(U.accessible_surface(two, samples=1500).first().area - (4 * math.pi * 3.4**2 - cap)) < 1.0
    assert abs(U.volume(one, 2.0, 0.2).first().volume - 4 / 3 * math.pi * 8) < 0.5
    shell = [(i, x, y, z) for i, (x, y, z) in enumerate(itertools.product(range(-4, 5), repeat=3)) if max(abs(x), abs(y), abs(z)) == 4]
    box = spark.createDataFrame([(i, float(x), float(y), float(z), "A", "ALA", i) for i, x, y, z in shell], "atom_index int, x double, y double, z double, chain string, resname string, resnum int")
    found = stored(U.cavities(box, 1.0, 1.5, 4.5), "cavity")
    facts = U.object_parameters(found, 1.0).collect()
    assert len(facts) == 1 and abs(facts[0].x) < 0.6 and 60 < facts[0].volume < 350
    assert U.lining_residues(found, box, 1.0, 3.0).count() > 20
    assert U.overlap_cells(found, found, 1.0).first().volume == facts[0].volume
    p = spark.createDataFrame([("c", 0, 0.0, 0.0, 0.0, 2.0), ("c", 1, 3.0, 0.0, 0.0, 1.0)], "path string, step int, x double, y double, z double, radius double")
    r = U.path_parameters(p).first()
    assert (r.length, r.bottleneck) == (3.0, 1.0) and abs(r.volume - math.pi * 7) < 1e-9


def brute_align(a, b):
    """Best global score by trying every alignment."""
    def go(i, j, last):
        if i == len(a) and j == len(b):
            return 0.0
        out = []
        if i < len(a) and j < len(b):
            out.append((1.0 if a[i] == b[j] else -1.0) + go(i + 1, j + 1, 0))
        if i < len(a):
            out.append((-0.1 if last == 1 else -1.0) + go(i + 1, j, 1))
        if j < len(b):
            out.append((-0.1 if last == 2 else -1.0) + go(i, j + 1, 2))
        return max(out)

    return go(0, 0, 0)


def test_alignment_and_mapping(spark):
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = ("".join(rng.choice(list("ACD"), rng.integers(1, 6))) for _ in range(2))
        x, y, score = Y.align(a, b)
        assert x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y) and abs(score - brute_align(a, b)) < 1e-9
    assert Y.align("XXACDEYY", "ACDE", local=True)[:2] == ("ACDE", "ACDE")
    pairs = spark.createDataFrame([(1, "ACDEF", "ADEF"), (2, "AC", None)], "k int, seq_a string, seq_b string")
    out = Y.aligned_pairs(pairs)
    assert [(r.aligned_a, r.aligned_b, r.identity) for r in out.collect()] == [("ACDEF", "A-DEF", 100.0)]
    assert sorted((r.index_a, r.index_b) for r in Y.index_map(out, ("k",)).collect()) == [(0, 0), (2, 1), (3, 2), (4, 3)]
    star = Y.star_alignment(spark.createDataFrame([("p", "ACDEF"), ("q", "ADEF"), ("r", "ACDE")], "label string, seq string"))
    assert {r.label: r.seq for r in star.collect()} == {"p": "ACDEF", "q": "A-DEF", "r": "ACDE-"}
    at = spark.createDataFrame([(0, "CA", 7), (2, "CA", 9)], "residue int, name string, atom_index int")
    to = spark.createDataFrame([(0, "CA", 0), (1, "CA", 1), (2, "CA", 2)], "residue int, name string, atom_index int")
    got = {r.position: r.atom_index for r in Y.mapped_atoms(at, to, Y.index_map(out, ("k",)).select("index_a", "index_b")).collect()}
    assert got == {0: 7, 1: 9, 2: None}
    maps = spark.createDataFrame([("T1", "A", 90.0), ("T1", "B", 95.0), ("T2", "B", 99.0)], "target string, chain string, coverage double")
    assert {(r.target, r.chain) for r in Y.combined_maps(maps).collect()} == {("T1", "A"), ("T2", "B")}


def test_command_line(spark, tmp_path):
    from .test_sources import PDB

    (tmp_path / "a.pdb").write_text(PDB)
    (tmp_path / "m.fasta").write_text(">a\nACD-\n>b\nACDE\n>c\nGGDE\n")
    for k, args in enumerate((["select", f"{tmp_path}/a.pdb", "--select", "ion"], ["contacts", f"{tmp_path}/a.pdb", "--target", "name N", "--radius", "2"], ["conserv", f"{tmp_path}/m.fasta"], ["coevol", f"{tmp_path}/m.fasta"], ["refine", f"{tmp_path}/m.fasta", "--rowocc", "0.9"], ["filter", f"{tmp_path}/m.fasta", "--pattern", "a"])):
        cli.main(["--out", f"{tmp_path}/o{k}", *args], spark)
    read = lambda k: spark.read.option("header", "true").csv(f"{tmp_path}/o{k}")
    assert [read(k).count() for k in range(6)] == [1, 2, 4, 6, 2, 1]


def test_frames_splines_and_ranked_pairs(spark, atoms):
    from strandlake.operators import alignments as A

    m = stored(W.modes(W.hessian(atoms, "atom_index", 12.0), n_modes=2, axes=3), "m")
    turn = [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    was = {(r["mode"], r.node, r.axis): r.v for r in m.collect()}
    for r in L.realigned(m, turn).collect():
        assert abs(r.v - sum(turn[r.axis][k] * was[r["mode"], r.node, k] for k in range(3))) < 1e-12
    nodes = atoms.select(F.col("atom_index").alias("node"), "x", "y", "z")
    same = L.interpolated_modes(m, nodes, nodes.withColumnRenamed("node", "atom")).collect()
    assert len(same) == len(was) and all(abs(r.v - was[r["mode"], r.node, r.axis]) < 1e-6 for r in same)
    ranks = spark.createDataFrame([(0, 1, 1), (0, 5, 2), (2, 9, 3), (3, 9, 4)], "i int, j int, rank int")
    dist = spark.createDataFrame([(0, 1, 2.0), (0, 5, 4.0), (2, 9, 20.0), (3, 9, 6.0)], "i int, j int, distance double")
    assert [r["rank"] for r in A.filtered_pairs(ranks, dist, 2, least_gap=3, furthest=10).collect()] == [2, 4]
