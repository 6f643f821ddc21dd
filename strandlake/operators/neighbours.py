"""Distance joins over grid cells: an equi-join on cells, then the exact distance.

Cells are cubes of side r. Every point of one side stands in its own cell and
every point of the other in the 27 cells around it, so pairs within r meet in
exactly one cell and the join is a hash or sort-merge join however large both
sides are.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
BLOCKS = 8  # of a table all of whose pairs are joined


def squared_distance(a: str, b: str, cell: Sequence[float] | None = None) -> Column:
    """Squared distance between columns ``{a}x`` .. and ``{b}x`` ..; the nearest image in an orthorhombic ``cell``.

    Differences of decimals are exact and squared as doubles, as SQL does. Half
    way between two images either is as far, so a plain rint picks one.
    """
    total: Column | None = None
    for i, axis in enumerate(AXES):
        d = (F.col(f"{a}{axis}") - F.col(f"{b}{axis}")).cast("double")
        if cell is not None:
            d = d - float(cell[i]) * F.rint(d / float(cell[i]))
        total = d * d if total is None else total + d * d
    return total


def _cells(radius: float, cell: Sequence[float] | None) -> list[float]:
    """Cell sides: the radius, or, in a periodic box, the least side not below it that divides the box."""
    if cell is None:
        return [radius] * 3
    return [c / max(1, int(c // radius)) for c in cell]


def _modulo(n: int):
    return lambda c: F.pmod(c, F.lit(n))


def _own(prefix: str, sides: list[float], cell: Sequence[float] | None) -> list[Column]:
    out = []
    for i, axis in enumerate(AXES):
        at = F.col(f"{prefix}{axis}")
        if cell is not None:
            at = at - float(cell[i]) * F.floor(at / float(cell[i]))
        out.append(F.floor(at / sides[i]).cast("long"))
    return out


def pairs_within(
    left: DataFrame,
    right: DataFrame,
    radius: float,
    keys: Sequence[str] = (),
    cell: Sequence[float] | None = None,
    distance: str = "distance",
    half: bool = False,
) -> DataFrame:
    """Rows of ``left`` and ``right`` joined where their points are at most ``radius`` apart.

    ``left`` has columns ``a_x a_y a_z``, ``right`` ``b_x b_y b_z``; ``keys``
    are equal-named columns in both (structure, coordinate set, frame). With a
    periodic orthorhombic ``cell`` distances are to the nearest image. Rows
    with a null coordinate match nothing. The join is sort-merge: estimates of
    size leave out the 27 cells, so a large side may else be broadcast. With
    ``half`` both sides are one table and 14 cells do: pairs of different cells
    come once, either way round; ``_one`` marks pairs of one cell, which come
    both ways, as all do in a box less than three cells wide.
    """
    if radius <= 0:
        raise ValueError("radius has to be positive")
    sides = _cells(radius, cell)
    grid = ["_cx", "_cy", "_cz"]
    near = left
    # in a box less than three cells wide, cells beside one another repeat
    counts = [None if cell is None else max(1, round(cell[i] / sides[i])) for i in range(3)]
    inside = [(lambda c: c) if n is None else _modulo(n) for n in counts]
    for name, own, put in zip(grid, _own("a_", sides, cell), inside):
        near = near.withColumn(name, put(own))
    wide = right
    if half and all(n is None or n > 2 for n in counts):
        steps = [s for s in itertools.product((0, 1, -1), repeat=3) if s >= (0, 0, 0)]
        beside = [F.struct((F.lit(s == (0, 0, 0))).alias("_one"), *[put(own + F.lit(d)).alias(name) for name, own, put, d in zip(grid, _own("b_", sides, cell), inside, s)]) for s in steps]
        wide = wide.withColumn("_to", F.explode(F.array(*beside))).select(*right.columns, "_to.*")
    else:
        for i, (name, own) in enumerate(zip(grid, _own("b_", sides, cell))):
            steps = F.array(*[own + F.lit(d) for d in (-1, 0, 1)])
            if counts[i] is not None:
                steps = F.array_distinct(F.transform(steps, _modulo(counts[i])))
            wide = wide.withColumn(name, F.explode(steps))
        wide = wide.withColumn("_one", F.lit(True)) if half else wide
    d2 = squared_distance("a_", "b_", cell)
    return (
        near.join(wide.hint("merge"), [*keys, *grid]).drop(*grid).withColumn(distance, d2).where(F.col(distance) <= float(radius) ** 2).withColumn(distance, F.sqrt(distance))
    )


def neighbours(
    atoms: DataFrame, radius: float, other: DataFrame | None = None, key: str = "atom_index", keys: Sequence[str] = (),
    cell: Sequence[float] | None = None, least_gap: int | None = None, gap_on: str = "resnum",
) -> DataFrame:
    """(``i``, ``j``, ``distance``) of points within ``radius``: i < j within one table, every pair between two.

    ``least_gap`` keeps pairs whose ``gap_on`` values differ by that much at least.
    """
    extra = [gap_on] if least_gap is not None else []
    name = lambda df, p: df.select(*keys, F.col(key).alias("i" if p == "a_" else "j"), *[F.col(c).alias(p + c) for c in (*AXES, *extra)])
    found = pairs_within(name(atoms, "a_"), name(atoms if other is None else other, "b_"), radius, keys, cell, half=other is None)
    if other is None:
        found = found.where("i < j OR NOT _one AND i <> j")
    if least_gap is not None:
        found = found.where(F.abs(F.col(f"a_{gap_on}") - F.col(f"b_{gap_on}")) >= least_gap)
    ends = ("i", "j") if other is not None else (F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return found.select(*keys, *ends, "distance")


def points_near(atoms: DataFrame, points: DataFrame, radius: float, keys: Sequence[str] = (), cell: Sequence[float] | None = None) -> DataFrame:
    """The rows of ``atoms`` that have one of ``points`` within ``radius``; columns unchanged."""
    marked = atoms.withColumn("_row", F.monotonically_increasing_id()) if "_row" not in atoms.columns else atoms
    a = marked.select("*", *[F.col(c).alias("a_" + c) for c in AXES])
    b = points.select(*keys, *[F.col(c).alias("b_" + c) for c in AXES])
    return pairs_within(a, b, radius, keys, cell, "_d").dropDuplicates(["_row", *keys]).select(*atoms.columns)


def distance_pairs(atoms: DataFrame, key: str, keys: Sequence[str] = (), cell: Sequence[float] | None = None, other: DataFrame | None = None) -> DataFrame:
    """All distances (``i``, ``j``, ``distance``), i < j within one table: the dense matrix in long form.

    Within one table rows are dealt into BLOCKS by a hash of their key, and each
    unordered pair of blocks of one value of ``keys`` is joined: half the pairs
    are never looked at, and a large group is spread over many tasks.
    """
    side = lambda df, p, n: df.select(*keys, F.col(key).alias(n), *[F.col(c).alias(p + c) for c in AXES])
    d = F.sqrt(squared_distance("a_", "b_", cell)).alias("distance")
    if other is not None:
        a, b = side(atoms, "a_", "i"), side(other, "b_", "j")
        return (a.join(b, list(keys)) if keys else a.crossJoin(b)).select(*keys, "i", "j", d)
    own = lambda n: F.pmod(F.xxhash64(n), F.lit(BLOCKS)).cast("int")
    a = side(atoms, "a_", "i").where("i IS NOT NULL").withColumn("_p", own("i")).withColumn("_q", F.explode(F.sequence("_p", F.lit(BLOCKS - 1))))
    b = side(atoms, "b_", "j").where("j IS NOT NULL").withColumn("_q", own("j")).withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_q"))))
    both = a.join(b.hint("merge"), [*keys, "_p", "_q"]).where("_p < _q OR i < j")
    return both.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), d)


def inferred_bonds(atoms: DataFrame, key: str, furthest: float = 1.6, nearest: float | None = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """(``i``, ``j``, ``distance``), i < j: atoms within ``furthest`` and beyond ``nearest`` (None: at one place too) of each other, the rounded root compared with both."""
    side = lambda p, n: atoms.select(*keys, F.col(key).alias(n), *[F.col(c).alias(p + c) for c in AXES])
    close = pairs_within(side("a_", "i"), side("b_", "j"), furthest * (1 + 1e-9), keys)
    bonded = F.lit(True) if nearest is None else F.col("distance") > nearest
    return close.where((F.col("i") < F.col("j")) & (F.col("distance") <= furthest) & bonded).select(*keys, "i", "j", "distance")
