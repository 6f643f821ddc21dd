"""Channels, pores and voids of blocks of atoms with bored ways."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import channels as C
from strandlake.plans.iteration import stored

GRID = np.array([(x, y, z) for x in range(0, 19, 2) for y in range(0, 19, 2) for z in range(0, 19, 2)], float)


def bored(blind: bool) -> np.ndarray:
    """A block with a way along z, closed below if ``blind``."""
    off = np.linalg.norm(GRID[:, :2] - 9, axis=1)
    return GRID[(off > 3.5) | (blind & (GRID[:, 2] < 6))]


BLOCKS = {"blind": bored(True), "through": bored(False), "solid": GRID}


@pytest.fixture(scope="module")
def atoms(spark):
    rows = [(n, "A", "ALA", k, *map(float, p), 1.5) for n, b in BLOCKS.items() for k, p in enumerate(b)]
    return spark.createDataFrame(rows, "structure string, chain string, resname string, resnum int, x double, y double, z double, radius double")


@pytest.fixture(scope="module")
def found(atoms):
    return stored(C.channels(atoms, ("structure",), min_depth=3.0), "channels")


def test_clearances_are_brute_force():
    xyz, r = BLOCKS["blind"][::7], np.linspace(1.2, 1.8, len(BLOCKS["blind"][::7]))
    low, box = C.clearances(xyz, r, 1.0, 3.0)
    at = np.argwhere(np.ones_like(box)) + low
    want = np.minimum(3.0, (np.linalg.norm(at[:, None] - xyz[None], axis=2) - r).min(axis=1))
    assert np.allclose(box.ravel(), want)


def test_blind_way_leads_up(found):
    rows = found.where("structure = 'blind'").collect()
    assert rows and {r.structure for r in found.select("structure").distinct().collect()} == {"blind", "through"}
    for k in {r.channel for r in rows}:
        way = sorted((r for r in rows if r.channel == k), key=lambda r: r.step)
        xyz = np.array([(r.x, r.y, r.z) for r in way])
        assert (np.linalg.norm(np.diff(xyz, axis=0), axis=1) < 1.75).all() and xyz[-1, 2] > xyz[0, 2] + 3
        clear = (np.linalg.norm(xyz[:, None] - BLOCKS["blind"][None], axis=2) - 1.5).min(axis=1)
        assert np.allclose(np.minimum(clear, 3.0), [r.radius for r in way])
        d = np.linalg.norm(np.diff(xyz, axis=0), axis=1)
        mid = np.minimum(clear, 3.0)
        assert abs(sum(d / ((mid[1:] + mid[:-1]) / 2) ** 2) - way[0].cost) < 1e-9


def test_parameters_pores_and_filters(found, atoms):
    path = ("structure", "channel")
    p = {(r.structure, r.channel): r for r in C.way_parameters(found, path).collect()}
    rows = found.collect()
    for key, r in p.items():
        xyz = np.array([(s.x, s.y, s.z) for s in sorted((s for s in rows if (s.structure, s.channel) == key), key=lambda s: s.step)])
        assert abs(r.length - np.linalg.norm(np.diff(xyz, axis=0), axis=1).sum()) < 1e-9 and abs(r.end_to_end - np.linalg.norm(xyz[0] - xyz[-1])) < 1e-9
        assert r.bottleneck <= 2.0 + 1e-9 and r.volume > 0
    pore = stored(C.pores(found, ("structure",)), "pores")
    through = pore.where("structure = 'through'")
    span = through.groupBy("channel_a", "channel_b").agg((F.max("z") - F.min("z")).alias("s"), F.count("step").alias("n"), F.countDistinct("x", "y", "z").alias("u")).collect()
    assert max(r.s for r in span) > 9 and all(r.n == r.u for r in span)
    gaps = C.way_parameters(pore, ("structure", "channel_a", "channel_b")).where("length < end_to_end - 1e-9")
    assert gaps.count() == 0
    long = C.ways_between(found, path, length=(6.0, None), bottleneck=(None, 9.0)).select(*path).distinct().collect()
    assert {tuple(r) for r in long} == {k for k, r in p.items() if r.length >= 6}
    near = C.ways_near(found, atoms.where("x = 4 and y = 8 and z = 12"), path, ("structure",), 6.0)
    assert 0 < near.count() <= found.count()
    lining = C.way_residues(found, atoms, path, ("structure",), 1.5).collect()
    for r in lining[:50]:
        p0 = BLOCKS[r.structure][r.resnum]
        assert min(np.linalg.norm(p0 - (s.x, s.y, s.z)) - s.radius for s in rows if (s.structure, s.channel) == (r.structure, r.channel)) <= 1.5 + 1e-9


def test_dense_points(found):
    one = found.where("structure = 'blind' and channel = 0")
    n = one.count()
    dense = C.way_atoms(one, ("structure", "channel"), 4).orderBy("atom").collect()
    assert len(dense) == 4 * (n - 1) + 1
    first = one.orderBy("step").limit(2).collect()
    assert abs(dense[2].x - (first[0].x + first[1].x) / 2) < 1e-9 and abs(dense[2].radius - (first[0].radius + first[1].radius) / 2) < 1e-9


def test_voids_and_start_point(atoms):
    v = stored(C.voids(atoms, ("structure",), surf_radius=3.0, inner_radius=1.0, min_depth=3.0), "voids")
    p = {r.structure: r for r in C.void_parameters(v, 1.0, ("structure",)).collect()}
    assert set(p) == {"blind", "through"} and p["through"].n_cells > p["blind"].n_cells > 20 and p["blind"].depth > 5
    start = C.channels(atoms.where("structure = 'blind'"), ("structure",), min_depth=3.0, start_point=(9, 9, 12)).where("step = 0").select("x", "y", "z").distinct().collect()
    assert len(start) == 1 and np.linalg.norm(np.array(start[0]) - (9, 9, 12)) <= 3.0


def test_scan_and_occupancy(atoms):
    blind = atoms.where("structure = 'blind'")
    s = stored(C.scanned_channels(blind, (0.9, 5.0), (1.0,), (3.0, 50.0), ("structure",)), "scan")
    assert {(r.inner_radius, r.min_depth) for r in s.select("inner_radius", "min_depth").distinct().collect()} == {(0.9, 3.0)}
    share = C.scanned_occupancy(s.withColumn("run", F.struct("inner_radius", "sparsity", "min_depth")), 4, 1.0, ("structure",))
    assert {r.share for r in share.select("share").distinct().collect()} == {0.25}


def test_empty_and_null_atoms(atoms, spark):
    assert C.channels(atoms.where("x < -5"), ("structure",)).count() == 0
    hole = atoms.where("structure = 'solid'").limit(3).withColumn("x", F.lit(None).cast("double"))
    assert C.voids(hole, ("structure",)).count() == 0
    few = spark.createDataFrame([("one", 0.0, 0.0, 0.0, 1.5)], "structure string, x double, y double, z double, radius double")
    assert C.channels(few, ("structure",)).count() == 0
