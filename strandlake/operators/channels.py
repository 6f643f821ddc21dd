"""Channels, pores and voids of structures, on a grid of clearances.

The clearance of a grid point is its distance from the nearest atom's surface.
A large probe coming from outside marks the outside; what a small probe enters
beyond that is void, in connected groups. One task searches one structure (a
value of ``keys``: a structure, a frame, a set of parameters); everything
after the search is joins and sums. Points are ``side`` apart, so lengths and
radii are right to about that.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.operators.neighbours import AXES, pairs_within
from strandlake.operators.surfaces import filled_cells
from strandlake.session import workers_find_package

STEPS = np.array([s for s in itertools.product((-1, 0, 1), repeat=3) if any(s)])
FACES = STEPS[np.abs(STEPS).sum(axis=1) == 1]


def clearances(xyz: np.ndarray, radius: np.ndarray, side: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Lowest corner (in cells) and the box of clearances, not above ``reach``; two cells of margin beyond the reach."""
    far = radius.max() + reach
    low = np.floor((xyz.min(axis=0) - far) / side).astype(int) - 2
    shape = np.ceil((xyz.max(axis=0) + far) / side).astype(int) + 2 - low + 1
    box = np.full(shape, float(reach))
    for p, r in zip(xyz, radius):
        a = np.floor((p - r - reach) / side).astype(int) - low
        b = np.ceil((p + r + reach) / side).astype(int) - low + 1
        axes = [(np.arange(a[k], b[k]) + low[k]) * side - p[k] for k in range(3)]
        d = np.sqrt(axes[0][:, None, None] ** 2 + axes[1][None, :, None] ** 2 + axes[2][None, None, :] ** 2) - r
        part = box[a[0] : b[0], a[1] : b[1], a[2] : b[2]]
        np.minimum(part, d, out=part)
    return low, box


def _shifted(mask: np.ndarray, step: np.ndarray) -> np.ndarray:
    out = np.zeros_like(mask)
    cut = [(slice(max(0, s), n + min(0, s)), slice(max(0, -s), n + min(0, -s))) for s, n in zip(step, mask.shape)]
    out[tuple(c[0] for c in cut)] = mask[tuple(c[1] for c in cut)]
    return out


def _grown(seed: np.ndarray, within: np.ndarray) -> np.ndarray:
    """All of ``within`` that is joined to the seed over faces."""
    found = seed & within
    edge = found
    while edge.any():
        new = np.zeros_like(found)
        for s in FACES:
            new |= _shifted(edge, s)
        edge = new & within & ~found
        found = found | edge
    return found


class Void:
    """The free cells behind a structure's surface: groups, depths and clearances."""

    def __init__(self, xyz: np.ndarray, radius: np.ndarray, side: float, surf: float, inner: float):
        self.side = side
        self.low, self.clear = clearances(xyz, radius, side, surf)
        rim = np.ones_like(self.clear, bool)
        rim[1:-1, 1:-1, 1:-1] = False
        core = _grown(rim, self.clear >= surf)
        # the large probe covers what lies within its radius of its centres
        n = int(np.ceil(surf / side))
        outside = core.copy()
        for s in itertools.product(range(-n, n + 1), repeat=3):
            if 0 < np.linalg.norm(s) * side <= surf:
                outside |= _shifted(core, np.array(s))
        self.outside = outside
        self.free = (self.clear >= inner) & ~outside
        mouth = np.zeros_like(outside)
        for s in FACES:
            mouth |= _shifted(outside & (self.clear >= inner), s)
        self.mouth = mouth & self.free
        self.depth = self._costs(np.argwhere(self.mouth), lambda length, clear: length)[0] if self.mouth.any() else {}

    def _costs(self, starts: np.ndarray, price) -> tuple[dict, dict]:
        """Least cost from the starts over free neighbours, and the cell before."""
        cost = {tuple(map(int, c)): 0.0 for c in starts}
        before: dict = {}
        queue = [(0.0, c) for c in sorted(cost)]
        heapq.heapify(queue)
        steps = [(tuple(map(int, s)), float(np.linalg.norm(s)) * self.side) for s in STEPS]
        free, clear, done = self.free, self.clear, set()
        while queue:
            at, c = heapq.heappop(queue)
            if c in done:
                continue
            done.add(c)
            for s, length in steps:
                n = (c[0] + s[0], c[1] + s[1], c[2] + s[2])
                if not free[n] or n in done:
                    continue
                new = at + price(length, (clear[c] + clear[n]) / 2)
                if new < cost.get(n, np.inf):
                    cost[n] = new
                    before[n] = c
                    heapq.heappush(queue, (new, n))
        return cost, before

    def groups(self) -> list[set]:
        """Cells with a way to a mouth, in groups of neighbours (edges and corners count), by their smallest cell."""
        left, out = set(self.depth), []
        for c in sorted(left):
            if c not in left:
                continue
            group, stack = {c}, [c]
            left.discard(c)
            while stack:
                a = stack.pop()
                for s in STEPS:
                    n = (a[0] + int(s[0]), a[1] + int(s[1]), a[2] + int(s[2]))
                    if n in left:
                        left.discard(n)
                        group.add(n)
                        stack.append(n)
            out.append(group)
        return out

    def place(self, cells) -> np.ndarray:
        return (np.asarray(cells) + self.low) * self.side

    def start(self, group: set, point: Sequence[float] | None, search: float):
        """The deepest cell; near a given point the widest no shallower than the nearest."""
        if point is None:
            return max(group, key=lambda c: (self.depth[c], self.clear[c], [-x for x in c]))
        cells = sorted(group)
        d = np.linalg.norm(self.place(cells) - np.asarray(point, float), axis=1)
        near = cells[int(d.argmin())]
        wide = [c for c, x in zip(cells, d) if x <= search and self.depth[c] >= self.depth[near]]
        return max([near, *wide], key=lambda c: (self.clear[c], [-x for x in c]))

    def paths(self, start, group: set, sparsity: float, similarity: float, tolerance: float) -> list[tuple[float, list]]:
        """Cheapest ways from the start to the mouths; one for each opening and corridor."""
        cost, before = self._costs(np.array([start]), lambda length, clear: length / clear**2)
        kept: list[tuple[float, list, np.ndarray]] = []
        for end in sorted((c for c in np.argwhere(self.mouth).tolist() if tuple(c) in cost), key=lambda c: (cost[tuple(c)], c)):
            way = [tuple(end)]
            while way[-1] != start:
                way.append(before[way[-1]])
            way.reverse()
            xyz = self.place(way)
            if any(np.linalg.norm(xyz[-1] - other[-1]) <= sparsity and _alike(xyz, other, tolerance) >= similarity for _, _, other in kept):
                continue
            kept.append((cost[tuple(end)], way, xyz))
        return [(c, way) for c, way, _ in kept]


def _alike(a: np.ndarray, b: np.ndarray, tolerance: float) -> float:
    """Share of the longer way's points that lie within the tolerance of the other."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    return float((np.linalg.norm(long[:, None] - short[None], axis=2).min(axis=1) <= tolerance).mean())


def _schema(atoms: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{c}` {atoms.schema[c].dataType.simpleString()}, " for c in keys)


def _per_structure(atoms: DataFrame, keys: Sequence[str], radius: str, work, columns: Sequence[str], schema: str, extra: Sequence[str] = ()) -> DataFrame:
    workers_find_package(atoms.sparkSession)
    own = atoms.select(*keys, *AXES, F.col(radius).cast("double").alias("_radius"), *extra).dropna(subset=[*AXES, "_radius"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(work(pdf), columns=list(columns))
        for k, c in enumerate(keys):
            out.insert(k, c, pdf[c].iloc[0])
        return out

    grouped = own.groupBy(*keys) if keys else own.groupBy(F.lit("all"))
    return grouped.applyInPandas(lambda pdf: run(pdf), _schema(atoms, keys) + schema)


def voids(atoms: DataFrame, keys: Sequence[str] = (), radius: str = "radius", side: float = 1.0, surf_radius: float = 4.5, inner_radius: float = 2.0, min_depth: float = 1.5) -> DataFrame:
    """(keys, ``object``, cx, cy, cz, ``depth``): grid points of void with a way out, in groups at least ``min_depth`` deep.

    Atoms without a coordinate or radius take no part; a structure without void
    gives no row.
    """

    def work(pdf: pd.DataFrame) -> list[tuple]:
        v = Void(pdf[list(AXES)].to_numpy(float), pdf["_radius"].to_numpy(float), side, surf_radius, inner_radius)
        deep = [g for g in v.groups() if max(v.depth[c] for c in g) >= min_depth]
        return [(n, *(int(x) for x in np.array(c) + v.low), v.depth[c]) for n, g in enumerate(deep) for c in sorted(g)]

    return _per_structure(atoms, keys, radius, work, ["object", "cx", "cy", "cz", "depth"], "object int, cx int, cy int, cz int, depth double")


def void_parameters(found: DataFrame, side: float, keys: Sequence[str] = ()) -> DataFrame:
    """Points, volume and depth of each object."""
    return found.groupBy(*keys, "object").agg(F.count(F.lit(1)).alias("n_cells"), (F.count(F.lit(1)) * side**3).alias("volume"), F.max("depth").alias("depth"))


def channels(
    atoms: DataFrame,
    keys: Sequence[str] = (),
    radius: str = "radius",
    side: float = 1.0,
    surf_radius: float = 3.0,
    inner_radius: float | str = 0.9,
    min_depth: float | str = 5.0,
    bottleneck: float = 0.0,
    sparsity: float | str = 1.0,
    start_point: Sequence[float] | None = None,
    start_point_search: float = 3.0,
    similarity: float = 0.8,
    route_tolerance: float = 1.0,
) -> DataFrame:
    """Ways from the deepest point of each void to its openings: (keys, ``channel``, ``cavity``, ``step``, cell, x, y, z, ``radius``, ``cost``).

    The way that costs least counts, a step costing its length over the square
    of the clearance. Ways that leave within ``sparsity`` of one another and
    run together for ``similarity`` of the longer one are one channel, the
    cheapest. ``inner_radius``, ``min_depth`` and ``sparsity`` may name columns
    (constant within ``keys``). With ``start_point`` only the void nearest to
    it is searched.
    """
    named = [p for p in (inner_radius, min_depth, sparsity) if isinstance(p, str) and p not in keys]

    def work(pdf: pd.DataFrame) -> list[tuple]:
        given = lambda p: float(pdf[p].iloc[0]) if isinstance(p, str) else p
        v = Void(pdf[list(AXES)].to_numpy(float), pdf["_radius"].to_numpy(float), side, surf_radius, given(inner_radius))
        deep = [(n, g) for n, g in enumerate(v.groups()) if max(v.depth[c] for c in g) >= given(min_depth)]
        if start_point is not None and deep:
            at = np.asarray(start_point, float)
            deep = [min(deep, key=lambda g: np.linalg.norm(v.place(sorted(g[1])) - at, axis=1).min())]
        ways = []
        for n, g in deep:
            ways += [(cost, n, way) for cost, way in v.paths(v.start(g, start_point, start_point_search), g, given(sparsity), similarity, route_tolerance) if len(way) > 1 and min(v.clear[c] for c in way) >= bottleneck]
        ways.sort(key=lambda w: (w[0], w[1], w[2]))
        shape = v.clear.shape
        return [(k, n, s, int(np.ravel_multi_index(c, shape)), *map(float, v.place([c])[0]), float(v.clear[c]), float(cost)) for k, (cost, n, way) in enumerate(ways) for s, c in enumerate(way)]

    columns = ["channel", "cavity", "step", "cell", "x", "y", "z", "radius", "cost"]
    return _per_structure(atoms, keys, radius, work, columns, "channel int, cavity int, step int, cell long, x double, y double, z double, radius double, cost double", named)


def pores(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Two channels of a cavity joined where they part: (keys, ``channel_a``, ``channel_b``, ``step``, x, y, z, ``radius``).

    Channels of a cavity are ways of one tree, so what two share is their
    beginning, and the joined way has no loop. A channel within the other
    makes no pore.
    """
    side = lambda n: found.select(*keys, "cavity", "step", "cell", F.col("channel").alias(n))
    shared = side("channel_a").join(side("channel_b"), [*keys, "cavity", "step", "cell"]).where("channel_a < channel_b")
    branch = shared.groupBy(*keys, "channel_a", "channel_b").agg(F.max("step").alias("_at"))
    ends = found.groupBy(*keys, "channel").agg(F.max("step").alias("_last"))
    for n in ("channel_a", "channel_b"):
        branch = branch.join(ends.withColumnRenamed("channel", n), [*keys, n]).where("_last > _at").drop("_last")
    point = found.select(*keys, "channel", F.col("step").alias("_s"), *AXES, "radius")
    first = branch.join(point.withColumnRenamed("channel", "channel_a"), [*keys, "channel_a"]).where("_s >= _at").withColumn("_k", F.col("_at") - F.col("_s"))
    second = branch.join(point.withColumnRenamed("channel", "channel_b"), [*keys, "channel_b"]).where("_s > _at").withColumn("_k", F.col("_s") - F.col("_at"))
    both = first.select(*keys, "channel_a", "channel_b", "_k", *AXES, "radius").unionByName(second.select(*keys, "channel_a", "channel_b", "_k", *AXES, "radius"))
    order = F.row_number().over(Window.partitionBy(*keys, "channel_a", "channel_b").orderBy("_k")) - 1
    return both.withColumn("step", order).drop("_k").select(*keys, "channel_a", "channel_b", "step", *AXES, "radius")


def way_parameters(spheres: DataFrame, path: Sequence[str] = ("channel",)) -> DataFrame:
    """Length, bottleneck, volume (of the cones between spheres) and distance between the ends of channels or pores."""
    by = Window.partitionBy(*path).orderBy("step")
    d = F.sqrt(sum((F.col(a) - F.lag(a).over(by)) ** 2 for a in AXES))
    seg = spheres.withColumns({"_d": F.coalesce(d, F.lit(0.0)), "_r": F.coalesce(F.lag("radius").over(by), F.col("radius"))})
    cone = np.pi / 3 * F.col("_d") * (F.col("_r") ** 2 + F.col("_r") * F.col("radius") + F.col("radius") ** 2)
    ends = [f(F.struct("step", *AXES)).alias(n) for f, n in ((F.min, "_a"), (F.max, "_b"))]
    out = seg.groupBy(*path).agg(F.sum("_d").alias("length"), F.min("radius").alias("bottleneck"), F.sum(cone).alias("volume"), *ends)
    apart = F.sqrt(sum((F.col(f"_a.{a}") - F.col(f"_b.{a}")) ** 2 for a in AXES))
    return out.withColumn("end_to_end", apart).drop("_a", "_b")


def ways_between(spheres: DataFrame, path: Sequence[str], **bounds: tuple[float | None, float | None]) -> DataFrame:
    """Channels or pores whose parameters lie within bounds, such as ``length=(10, None)``."""
    kept = way_parameters(spheres, path)
    for name, (low, high) in bounds.items():
        kept = kept if low is None else kept.where(F.col(name) >= low)
        kept = kept if high is None else kept.where(F.col(name) <= high)
    return spheres.join(kept.select(*path), list(path), "left_semi").select(*spheres.columns)


def way_atoms(spheres: DataFrame, path: Sequence[str] = ("channel",), samples: int = 5) -> DataFrame:
    """Spheres with ``samples`` points from each to the next, places and radii on straight lines: (path, ``atom``, x, y, z, radius)."""
    by = Window.partitionBy(*path).orderBy("step")
    names = [*AXES, "radius"]
    each = spheres.select(*path, "step", *names, *[F.lead(c).over(by).alias("_n" + c) for c in names])
    share = F.explode(F.when(F.col("_nx").isNull(), F.array(F.lit(0.0))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: k / float(samples))))
    dense = each.withColumn("_t", share)
    at = [(F.col(c) + F.col("_t") * F.coalesce(F.col("_n" + c) - F.col(c), F.lit(0.0))).alias(c) for c in names]
    number = F.row_number().over(Window.partitionBy(*path).orderBy("step", "_t")) - 1
    return dense.select(*path, number.alias("atom"), *at)


def way_residues(spheres: DataFrame, atoms: DataFrame, path: Sequence[str] = ("channel",), keys: Sequence[str] = (), reach: float = 4.0) -> DataFrame:
    """(path, chain, resname, resnum) of residues with an atom within reach of a sphere's surface; ``keys`` (of both) part structures and frames."""
    widest = spheres.agg(F.max("radius")).first()[0] or 0.0
    a = spheres.select(*dict.fromkeys([*keys, *path]), "radius", *[F.col(x).alias("a_" + x) for x in AXES]).withColumnRenamed("radius", "_r")
    b = atoms.select(*keys, "chain", "resname", "resnum", *[F.col(x).alias("b_" + x) for x in AXES])
    near = pairs_within(a, b, widest + reach, keys).where(F.col("distance") <= F.col("_r") + reach)
    return near.select(*path, "chain", "resname", "resnum").distinct()


def ways_near(spheres: DataFrame, chosen: DataFrame, path: Sequence[str] = ("channel",), keys: Sequence[str] = (), reach: float = 5.0) -> DataFrame:
    """Channels, pores or voids with a point within reach of a chosen atom."""
    a = spheres.select(*dict.fromkeys([*keys, *path]), *[F.col(x).alias("a_" + x) for x in AXES])
    b = chosen.select(*keys, *[F.col(x).alias("b_" + x) for x in AXES])
    kept = pairs_within(a, b, reach, keys).select(*path).distinct()
    return spheres.join(kept, list(path), "left_semi").select(*spheres.columns)


def scanned_channels(atoms: DataFrame, inner_radius: Sequence[float] = (1.2, 1.4, 1.6), sparsity: Sequence[float] = (1.0, 3.0, 5.0), min_depth: Sequence[float] = (3.0, 5.0, 10.0), keys: Sequence[str] = (), **others) -> DataFrame:
    """``channels`` for every combination of parameters, each a task of its own; the parameters lead the columns after ``keys``."""
    grid = [(float(i), float(s), float(m)) for i in inner_radius for s in sparsity for m in min_depth]
    combos = atoms.sparkSession.createDataFrame(grid, "inner_radius double, sparsity double, min_depth double")  # as many rows as the caller names
    every = atoms.crossJoin(F.broadcast(combos))
    return channels(every, (*keys, "inner_radius", "sparsity", "min_depth"), inner_radius="inner_radius", sparsity="sparsity", min_depth="min_depth", **others)


def scanned_occupancy(found: DataFrame, n: int, side: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, cx, cy, cz, ``share``): in what share of ``n`` combinations (or frames) a cell lies in a channel; ``found`` has a column ``run``."""
    cells = filled_cells(found, F.col("radius"), side, (*keys, "run"))
    return cells.groupBy(*keys, "cx", "cy", "cz").agg((F.count(F.lit(1)) / n).alias("share"))
