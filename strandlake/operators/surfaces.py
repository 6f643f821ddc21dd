"""Surfaces, volumes and cavities on grid cells and sampled spheres: explodes, cell equi-joins and anti-joins."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.neighbours import AXES, pairs_within
from strandlake.plans.iteration import components, stored
from strandlake.session import workers_find_package


def accessible_surface(atoms: DataFrame, key: str = "atom_index", radius: str = "radius", probe: float = 1.4, samples: int = 96, keys: Sequence[str] = ()) -> DataFrame:
    """(``key``, ``area``): each atom's surface that a probe reaches, by the share of sampled points no other atom covers.

    Equal balls, which do not cover one another's points, stand once. A task
    holds the balls of a cell of side four times the largest radius and those
    around it, so points and pairs are never rows.
    """
    r = F.col(radius) + probe
    balls = atoms.select(*keys, F.col(key).alias("i"), *AXES, r.alias("r"))
    widest = balls.agg(F.max("r")).first()[0] or 1.0
    if widest <= 0:
        raise ValueError("radius has to be positive")
    workers_find_package(atoms.sparkSession)
    own = lambda a: F.floor(F.col(a) / (4 * widest)).cast("long")
    span = lambda a: F.explode(F.sequence(*[F.floor((F.col(a) + s * 2 * widest) / (4 * widest)).cast("long") for s in (-1, 1)]))
    different = balls.dropna(subset=[*AXES, "r"]).groupBy(*keys, *AXES, "r").agg(F.count(F.lit(1)).alias("copies")).drop("copies")
    near = different
    for c in AXES:
        near = near.withColumn("_c" + c, span(c))
    near = near.withColumn("_own", (F.col("_cx") == own("x")) & (F.col("_cy") == own("y")) & (F.col("_cz") == own("z")))
    k = np.arange(samples)
    z = 1 - (2 * k + 1) / float(samples)
    turn = math.pi * (3 - math.sqrt(5)) * k
    sphere = np.stack([np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z], axis=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        at, size = np.stack([t[c].to_numpy() for c in AXES], axis=1), t["r"].to_numpy()
        mine = np.flatnonzero(t["_own"].to_numpy())
        for start in range(0, len(mine), 2048):
            some = mine[start : start + 2048]
            dots = (at[some][:, None] + size[some][:, None, None] * sphere).reshape(-1, 3)
            n = _covered(dots, np.repeat(some, samples), at, size).reshape(len(some), samples).sum(axis=1)
            rows = t.take(pa.array(some)).select([*keys, *AXES, "r"]).append_column("n", pa.array(n, pa.int64()))
            yield from rows.combine_chunks().to_batches()

    kinds = "".join(f"`{c}` {atoms.schema[c].dataType.simpleString()}, " for c in (*keys, *AXES)) + f"r {balls.schema['r'].dataType.simpleString()}, n long"
    gone = near.groupBy(*keys, "_cx", "_cy", "_cz").applyInArrow(count, kinds)
    share = (samples - F.coalesce("n", F.lit(0))) / samples
    return balls.join(gone, [*keys, *AXES, "r"], "left").select(*keys, F.col("i").alias(key), (4 * math.pi * F.col("r") ** 2 * share).alias("area"))


PAIRS = 1 << 20  # of dots and balls compared at once


def _covered(dots: np.ndarray, own: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which dots lie inside a ball that is not their own (``own``: its row).

    A ball in the same small cell as a dot, of a diagonal below every radius,
    covers it; the dots left are compared with the balls of the 27 cells of
    the widest radius around them, the middle one first.
    """
    low = np.minimum(at.min(axis=0), dots.min(axis=0))

    def codes(points: np.ndarray, side: float, shift: Sequence[int] = (0, 0, 0)) -> np.ndarray:
        c = np.floor((points - low) / side).astype(np.int64) + 2 + np.array(shift)
        return (c[:, 0] << 42) + (c[:, 1] << 21) + c[:, 2]

    done = np.zeros(len(dots), bool)
    inner = (size.min() * (1 - 1e-6) - 1e-9) / math.sqrt(3)
    if inner > 0 and np.ptp(dots, axis=0).max() / inner < 1 << 20:
        done = np.isin(codes(dots, inner), np.unique(codes(at, inner)))
    side = size.max()
    order = np.argsort(codes(at, side), kind="stable")
    held = codes(at, side)[order]
    for shift in sorted(itertools.product((-1, 0, 1), repeat=3), key=lambda s: sum(map(abs, s))):
        left = np.flatnonzero(~done)
        code = codes(dots[left], side, shift)
        first, last = np.searchsorted(held, code, "left"), np.searchsorted(held, code, "right")
        left, first, number = left[last > first], first[last > first], (last - first)[last > first]
        ends = np.cumsum(number)
        i = 0
        while i < len(left):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            d = np.repeat(left[i:j], number[i:j])
            b = order[np.repeat(first[i:j] - (ends[i:j] - number[i:j]), number[i:j]) + np.arange(ends[i] - number[i], ends[j - 1])]
            gap = np.sqrt(((dots[d] - at[b]) ** 2).sum(axis=1))
            done[d[(gap < size[b] - 1e-9) & (own[d] != b)]] = True
            i = j
    return done


def filled_cells(atoms: DataFrame, radius: Column | float, side: float, keys: Sequence[str] = ()) -> DataFrame:
    """Grid cells (``cx``, ``cy``, ``cz``) whose centre lies within the radius of an atom."""
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    span = lambda a: F.explode(F.sequence(F.floor((F.col(a) - F.col("_r")) / side).cast("int"), F.floor((F.col(a) + F.col("_r")) / side).cast("int")))
    cells = atoms.select(*keys, *AXES, r.alias("_r")).withColumn("cx", span("x")).withColumn("cy", span("y")).withColumn("cz", span("z"))
    d2 = sum(((F.col("c" + a) + 0.5) * side - F.col(a)) ** 2 for a in AXES)
    return cells.where(d2 <= F.col("_r") ** 2).select(*keys, "cx", "cy", "cz").distinct()


def volume(atoms: DataFrame, radius: Column | float, side: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Volume of the union of balls, in cells."""
    return filled_cells(atoms, radius, side, keys).groupBy(*keys).agg((F.count(F.lit(1)) * side**3).alias("volume"))


def overlap_cells(a: DataFrame, b: DataFrame, side: float) -> DataFrame:
    """Shared volume of two sets of cells, by their ``object`` columns: (``object_a``, ``object_b``, ``volume``)."""
    on = ["cx", "cy", "cz"]
    both = a.withColumnRenamed("object", "object_a").join(b.withColumnRenamed("object", "object_b"), on)
    return both.groupBy("object_a", "object_b").agg((F.count(F.lit(1)) * side**3).alias("volume"))


def cavities(atoms: DataFrame, side: float = 1.0, inner: float = 2.0, outer: float = 4.5, least_cells: int = 8) -> DataFrame:
    """Pockets: cells a small probe enters and a large one does not, in connected groups: (``object``, cx, cy, cz).

    Cells within ``inner`` of an atom are filled; a cell within ``outer`` of
    atoms on both sides along two axes or more is enclosed; face-sharing
    enclosed free cells are one object, of ``least_cells`` at least. Objects
    are numbered by their smallest cell.
    """
    wall = stored(filled_cells(atoms, inner, side), "wall")
    free = filled_cells(atoms, outer, side).join(wall, ["cx", "cy", "cz"], "left_anti")
    reach = max(1, int(2 * outer / side))
    inside = None
    for axis in ("cx", "cy", "cz"):
        others = [c for c in ("cx", "cy", "cz") if c != axis]
        near = free.join(wall.withColumnRenamed(axis, "w"), others).where(F.abs(F.col("w") - F.col(axis)) <= reach)
        both = near.groupBy("cx", "cy", "cz").agg((F.min("w") < F.first(axis)).alias("lo"), (F.max("w") > F.first(axis)).alias("hi")).where("lo and hi").select("cx", "cy", "cz")
        inside = both if inside is None else inside.unionByName(both)
    held = stored(inside.groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("cx", "cy", "cz"), "enclosed")
    code = lambda x, y, z: (x + 100_000) * F.lit(10**12) + (y + 100_000) * F.lit(10**6) + (z + 100_000)
    own = held.withColumn("id", code(F.col("cx").cast("long"), F.col("cy").cast("long"), F.col("cz").cast("long")))
    links = None
    for d in ((1, 0, 0), (0, 1, 0), (0, 0, 1)):
        moved = own.select(*[(F.col(c) + s).alias(c) for c, s in zip(("cx", "cy", "cz"), d)], F.col("id").alias("j"))
        part = own.join(moved, ["cx", "cy", "cz"]).select(F.col("id").alias("i"), "j")
        links = part if links is None else links.unionByName(part)
    comp = components(links)
    named = own.join(comp.withColumnRenamed("node", "id"), "id").select(F.col("component").alias("object"), "cx", "cy", "cz")
    big = named.groupBy("object").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_cells).select("object")
    return named.join(big, "object", "left_semi")


def object_parameters(cells: DataFrame, side: float) -> DataFrame:
    """Volume, cell count and centre of each object."""
    centre = [((F.avg("c" + a) + 0.5) * side).alias(a) for a in AXES]
    return cells.groupBy("object").agg(F.count(F.lit(1)).alias("n_cells"), (F.count(F.lit(1)) * side**3).alias("volume"), *centre)


def lining_residues(cells: DataFrame, atoms: DataFrame, side: float, reach: float = 4.0) -> DataFrame:
    """(``object``, chain, resname, resnum) of residues with an atom within reach of a cell's centre."""
    a = cells.select("object", *[((F.col("c" + x) + 0.5) * side).alias("a_" + x) for x in AXES])
    b = atoms.select("chain", "resname", "resnum", *[F.col(x).alias("b_" + x) for x in AXES])
    return pairs_within(a, b, reach).select("object", "chain", "resname", "resnum").distinct()


def path_parameters(spheres: DataFrame, path: str = "path", order: str = "step", radius: str = "radius") -> DataFrame:
    """Length, bottleneck and volume of chains of spheres (channels, pores), volume as that of the cones between them."""
    from pyspark.sql.window import Window

    by = Window.partitionBy(path).orderBy(order)
    d = F.sqrt(sum((F.col(a) - F.lag(a).over(by)) ** 2 for a in AXES))
    seg = spheres.withColumns({"_d": F.coalesce(d, F.lit(0.0)), "_r": F.coalesce(F.lag(radius).over(by), F.col(radius))})
    cone = math.pi / 3 * F.col("_d") * (F.col("_r") ** 2 + F.col("_r") * F.col(radius) + F.col(radius) ** 2)
    return seg.groupBy(path).agg(F.sum("_d").alias("length"), F.min(radius).alias("bottleneck"), F.sum(cone).alias("volume"))
