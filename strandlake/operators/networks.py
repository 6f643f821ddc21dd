"""Elastic network models, modes and what is derived from them.

Matrices are rows (``i``, ``j``, ``value``); modes are rows (``mode``,
``eigval``, ``variance``, ``node``, ``axis``, ``v``): axis 0 for one value a
node, 0 to 2 for x, y, z. A model's dense decomposition is one task; any
number of models run side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.operators import blocks as B
from strandlake.operators.neighbours import AXES, pairs_within, squared_distance
from strandlake.plans.iteration import stored
from strandlake.session import workers_find_package

ZERO = 1e-6


def _contacts(atoms: DataFrame, key: str, cutoff: float, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    side = lambda p, n: atoms.select(*keys, F.col(key).alias(n), *[F.col(c).alias(p + c) for c in (*AXES, *extra)])
    return pairs_within(side("a_", "i"), side("b_", "j"), cutoff, keys).where("i <> j")


def kirchhoff(atoms: DataFrame, key: str, cutoff: float = 10.0, gamma: float | Callable[[Column], Column] = 1.0, keys: Sequence[str] = (), squared: bool = False) -> DataFrame:
    """Minus gamma for nodes within the cutoff, contact sums on the diagonal. ``gamma`` may be a function of the distance column, or, with ``squared``, of its square."""
    if cutoff < 4:
        raise ValueError("cutoff has to be 4 or more")
    g = gamma(squared_distance("a_", "b_") if squared else F.col("distance")) if callable(gamma) else F.lit(float(gamma))
    near = _contacts(atoms, key, cutoff, keys).select(*keys, "i", "j", g.alias("value"))
    return laplacian(near, keys)


def steady_sum(value: Column) -> Column:
    """A sum that does not depend on the order of rows: multiples of 2^-20 add up without rounding while the sum is below 2^32, what is left of each value is too small for it to show."""
    v = value.cast("double")
    small = F.abs(v) < 2.0**32  # not so for infinity and NaN
    whole = F.when(small, F.rint(v * 2.0**20) / 2.0**20).otherwise(v)
    return F.sum(whole) + F.sum(F.when(small, v - whole).otherwise(0.0))


def laplacian(weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Degree minus adjacency of symmetric weights (self links left out)."""
    off = weights.where("i <> j")
    diagonal = off.groupBy(*keys, "i").agg(steady_sum(F.col("value")).alias("value")).select(*keys, "i", F.col("i").alias("j"), "value")
    return off.select(*keys, "i", "j", (-F.col("value")).alias("value")).unionByName(diagonal)


def hessian(atoms: DataFrame, key: str, cutoff: float = 15.0, gamma: float | Callable[[Column], Column] = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Super-elements of the anisotropic model: (``i``, ``p``, ``j``, ``q``, ``value``) with axes p, q from 0 to 2; NaN, as 0 over 0, for nodes at one place."""
    if cutoff < 4:
        raise ValueError("cutoff has to be 4 or more")
    near = _contacts(atoms, key, cutoff, keys)
    g = gamma(F.col("distance")) if callable(gamma) else F.lit(float(gamma))
    d = [F.col("b_" + a) - F.col("a_" + a) for a in AXES]
    value = lambda p, q: F.when(F.col("distance") == 0, F.lit(float("nan"))).otherwise(-g * d[p] * d[q] / F.col("distance") ** 2)
    blocks = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), value(p, q).alias("value")) for p in range(3) for q in range(3)])
    off = near.select(*keys, "i", "j", F.explode(blocks).alias("e")).select(*keys, "i", "e.p", "j", "e.q", "e.value")
    diagonal = off.groupBy(*keys, "i", "p", "q").agg((-F.sum("value")).alias("value")).select(*keys, "i", "p", F.col("i").alias("j"), "q", "value")
    return off.unionByName(diagonal)


def gamma_by_sequence(index_gap: Column, ordinary: float = 1.0, neighbour: float = 10.0) -> Column:
    """A stronger spring for nodes next to one another in the chain."""
    return F.when(F.abs(index_gap) <= 1, neighbour).otherwise(ordinary)


def gamma_by_distance(distance: Column, power: float = 2.0) -> Column:
    """A spring by the inverse of the distance to a power: infinite at distance 0."""
    return F.when(distance == 0, F.lit(float("inf"))).otherwise(1.0 / F.pow(distance, F.lit(power)))


def gamma_by_square(square: Column) -> Column:
    """:func:`gamma_by_distance` of the squared distance, without the rounding of a root."""
    return F.when(square == 0, F.lit(float("inf"))).otherwise(1.0 / square)


def modes(matrix: DataFrame, keys: Sequence[str] = (), n_modes: int | None = 20, zeros: bool = False, largest: bool = False, axes: int = 1) -> DataFrame:
    """Eigenpairs of symmetric matrices, one model per value of ``keys``.

    Smallest first without the zero ones (variance 1 / eigenvalue), or largest
    first (variance = eigenvalue, those above zero). Signs: the entry of the
    largest size is positive.
    """
    workers_find_package(matrix.sparkSession)
    row = "i" if axes == 1 else ["i", "p"]
    col = "j" if axes == 1 else ["j", "q"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        dense = pdf.pivot_table(index=row, columns=col, values="value", aggfunc="sum", fill_value=0.0)
        dense = dense.reindex(index=dense.index.union(dense.columns), columns=dense.index.union(dense.columns), fill_value=0.0)
        nodes = list(dense.index)
        m = dense.to_numpy(float)
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        if largest:
            pick = [k for k in np.argsort(values)[::-1] if values[k] > ZERO]
        else:
            pick = [k for k in range(len(values)) if zeros or values[k] > ZERO]
        pick = pick[:n_modes] if n_modes else pick
        out = []
        for n, k in enumerate(pick):
            v = vectors[:, k]
            v = v * (1 if v[np.abs(v).argmax()] > 0 else -1)
            var = values[k] if largest else (1 / values[k] if values[k] > ZERO else 0.0)
            frame = pd.DataFrame({"mode": n, "eigval": values[k], "variance": var, "v": v})
            frame["node"] = [x if axes == 1 else x[0] for x in nodes]
            frame["axis"] = [0 if axes == 1 else x[1] for x in nodes]
            out.append(frame)
        found = pd.concat(out) if out else pd.DataFrame({c: [] for c in ("mode", "eigval", "variance", "v", "node", "axis")})
        for c in keys:
            found[c] = pdf[c].iloc[0]
        return found[[*keys, "mode", "eigval", "variance", "node", "axis", "v"]]

    kinds = "".join(f"`{c}` {matrix.schema[c].dataType.simpleString()}, " for c in keys)
    node = matrix.schema["i"].dataType.simpleString()
    grouped = matrix.groupBy(*keys) if keys else matrix.groupBy(F.lit("all"))
    return grouped.applyInPandas(lambda pdf: solve(pdf), f"{kinds}mode int, eigval double, variance double, node {node}, axis int, v double")


def square_fluctuations(modes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of v^2 times variance of each node."""
    return modes.groupBy(*keys, "node").agg(F.sum(F.col("v") ** 2 * F.col("variance")).alias("sqfluct"))


def temperature_factors(fluct: DataFrame, beta: DataFrame, key: str = "node") -> DataFrame:
    """Fluctuations scaled so that they sum to the experimental factors."""
    joined = fluct.join(beta, key)
    ratio = joined.agg((F.sum("beta") / F.sum("sqfluct")).alias("r"))
    return joined.crossJoin(F.broadcast(ratio)).select(key, (F.col("sqfluct") * F.col("r")).alias("beta"))


def _by_mode(modes: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    a = modes.select(*keys, "mode", F.col("node").alias("i"), F.col("axis").alias("p"), F.col("v").alias("u"), "variance")
    b = modes.select(*keys, "mode", F.col("node").alias("j"), F.col("axis").alias("q"), F.col("v").alias("w"))
    return a, b


def covariance_of(modes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Covariance rebuilt from modes: (``i``, ``p``, ``j``, ``q``, ``value``)."""
    a, b = _by_mode(modes, keys)
    return a.join(b, [*keys, "mode"]).groupBy(*keys, "i", "p", "j", "q").agg(F.sum(F.col("u") * F.col("w") * F.col("variance")).alias("value"))


def cross_correlations(modes: DataFrame, norm: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Trace of each pair's covariance block; over the root of both own ones if ``norm`` (0 over 0 is 0)."""
    a, b = _by_mode(modes, keys)
    c = a.join(b.withColumnRenamed("q", "p"), [*keys, "mode", "p"]).groupBy(*keys, "i", "j").agg(F.sum(F.col("u") * F.col("w") * F.col("variance")).alias("value"))
    return normalised(c, keys) if norm else c


def normalised(c: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    own = c.where("i = j")
    di, dj = own.select(*keys, "i", F.col("value").alias("_di")), own.select(*keys, "j", F.col("value").alias("_dj"))
    size = F.sqrt(F.col("_di") * F.col("_dj"))
    return c.join(di, [*keys, "i"]).join(dj, [*keys, "j"]).select(*keys, "i", "j", F.when(size == 0, 0.0).otherwise(F.col("value") / size).alias("value"))


def distance_fluctuations(c: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """C_ii + C_jj - 2 C_ij."""
    own = c.where("i = j")
    di, dj = own.select(*keys, "i", F.col("value").alias("_di")), own.select(*keys, "j", F.col("value").alias("_dj"))
    return c.join(di, [*keys, "i"]).join(dj, [*keys, "j"]).select(*keys, "i", "j", (F.col("_di") + F.col("_dj") - 2 * F.col("value")).alias("value"))


def variance_shares(modes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each mode's variance over the sum of all."""
    each = modes.select(*keys, "mode", "variance").distinct()
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return each.select(*keys, "mode", (F.col("variance") / F.sum("variance").over(by)).alias("share"))


def collectivity(modes: DataFrame, keys: Sequence[str] = (), masses: DataFrame | None = None) -> DataFrame:
    """exp of the entropy of each mode's node weights, over the number of nodes; squares over masses (``node``, ``mass``) if given.

    A node's weight is its square over the root of the sum of squares, so a
    vector of any length has a value, and a unit vector's weights are its squares.
    """
    nodes = modes.groupBy(*keys, "mode", "node").agg(F.sum(F.col("v") ** 2).alias("u"))
    if masses is not None:
        nodes = nodes.join(masses.select("node", "mass"), "node").withColumn("u", F.col("u") / F.col("mass"))
    total = nodes.groupBy(*keys, "mode").agg(F.sqrt(F.sum("u")).alias("_r"), F.count(F.lit(1)).alias("_n"))
    w = F.col("u") / F.col("_r")
    entropy = -F.sum(w * F.log(w + float(np.finfo(float).eps)))
    return nodes.join(total, [*keys, "mode"]).groupBy(*keys, "mode").agg((F.exp(entropy) / F.max("_n")).alias("collectivity"))


def overlaps(a: DataFrame, b: DataFrame, diagonal: bool = False) -> DataFrame:
    """(``mode_a``, ``mode_b``, ``overlap``): normalised dot products of two sets of modes over shared nodes.

    Modes are packed, and blocks of both multiplied; on the diagonal only modes
    of equal number are joined.
    """
    if not diagonal:
        return _overlap_blocks(a, b, 1024, 1024, "overlap", lambda o: o)
    size = lambda m: m.groupBy("mode").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("s"))
    u = a.select("mode", "node", "axis", F.col("v").alias("u"))
    dots = u.join(b.select("mode", "node", "axis", F.col("v").alias("w")), ["mode", "node", "axis"]).groupBy("mode").agg(F.sum(F.col("u") * F.col("w")).alias("d"))
    sa, sb = size(a).withColumnRenamed("s", "sa"), size(b).withColumnRenamed("s", "sb")
    return dots.join(sa, "mode").join(sb, "mode").select(F.col("mode").alias("mode_a"), F.col("mode").alias("mode_b"), (F.col("d") / (F.col("sa") * F.col("sb"))).alias("overlap"))


def _overlap_blocks(a: DataFrame, b: DataFrame, block_a: int, block_b: int | None, name: str, shown: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Overlaps of all pairs of modes; ``shown`` of a stretch of rows of a whose columns rise with the modes of b."""
    kind = lambda m: m.schema["mode"].dataType.simpleString()

    def work(x, y, _):
        order = np.argsort(y.keys["_bmode"].to_numpy(zero_copy_only=False), kind="stable")
        y.take(order)
        for rows in B.stretches(x, y):
            d, shared, valued = B.products(x, y, rows)
            with np.errstate(divide="ignore", invalid="ignore"):
                d /= x.sizes[rows, None] * y.sizes
            for seen in (shared, valued):
                if seen is not None:
                    d[~seen] = 0.0
            yield B.pair_rows(x, y, rows, shown(d), shared, valued, ("mode_a", "mode_b", name))

    return B.block_pairs(B.packed(a, ["mode"]), ["mode"], B.packed(b, ["mode"]), ["mode"], block_a, block_b, work, f"mode_a {kind(a)}, mode_b {kind(b)}, {name} double")


def cumulative_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """:func:`cumulative_overlap` of all modes of two sets, row by row of a: each task holds the packed modes of b (8 bytes a mode and node, and what names the nodes) and no window is sorted."""
    return _overlap_blocks(a, b, 1024, None, "cumulative", lambda o: np.sqrt(np.cumsum(o * o, axis=1)))


def cumulative_overlap(overlap: DataFrame) -> DataFrame:
    """For each mode of a: root of the running sum of squared overlaps over the modes of b."""
    by = Window.partitionBy("mode_a").orderBy("mode_b").rowsBetween(Window.unboundedPreceding, 0)
    return overlap.select("mode_a", "mode_b", F.sqrt(F.sum(F.col("overlap") ** 2).over(by)).alias("cumulative"))


def subspace_overlap(overlap: DataFrame) -> DataFrame:
    """Root of the sum of squared overlaps over the number of modes of a."""
    return overlap.agg(F.sqrt(F.sum(F.col("overlap") ** 2) / F.countDistinct("mode_a")).alias("rmsip"))


def _variances(m: DataFrame, n: str) -> DataFrame:
    return m.select(F.col("mode").alias(f"mode_{n}"), F.col("variance").alias(f"s{n}")).distinct()


def weighted_inner_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Root of sum(s1 s2 O^2) over sum(s1 s2) of equally numbered modes."""
    full = overlaps(a, b).join(_variances(a, "a"), "mode_a").join(_variances(b, "b"), "mode_b")
    s = F.col("sa") * F.col("sb")
    return full.agg(F.sqrt(F.sum(s * F.col("overlap") ** 2) / F.sum(F.when(F.col("mode_a") == F.col("mode_b"), s))).alias("rwsip"))


def spectral_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """1 - sqrt(sum s1 + sum s2 - 2 sum sqrt(s1 s2) O^2) / sqrt(sum s1 + sum s2), what is under the root 0 at least."""
    va, vb = _variances(a, "a"), _variances(b, "b")
    full = overlaps(a, b).join(va, "mode_a").join(vb, "mode_b").agg(F.sum(F.sqrt(F.col("sa") * F.col("sb")) * F.col("overlap") ** 2).alias("x"))
    total = F.col("ta") + F.col("tb")
    sums = va.agg(F.sum("sa").alias("ta")).crossJoin(vb.agg(F.sum("sb").alias("tb"))).crossJoin(full)
    return sums.select((1 - F.sqrt(F.greatest(total - 2 * F.col("x"), F.lit(0.0)) / total)).alias("overlap"))


def projections(confs: DataFrame, reference: DataFrame, modes: DataFrame, conf: str, rmsd: bool = True) -> DataFrame:
    """(``conf``, ``mode``, ``projection``): deviations times modes, over the root of the number of nodes if ``rmsd``.

    ``confs`` and ``reference`` have (node, axis, value).
    """
    d = confs.join(reference.select("node", "axis", F.col("value").alias("_r")), ["node", "axis"]).select(conf, "node", "axis", (F.col("value") - F.col("_r")).alias("d"))
    kind = lambda m, c: m.schema[c].dataType.simpleString()

    def work(x, y, node):
        nodes = np.unique(node)
        for rows in B.stretches(x, y):
            p, shared, valued = B.products(x, y, rows)
            if rmsd and shared is None:
                p /= np.sqrt(len(nodes))
            elif rmsd:
                n = x.there[rows] @ y.there.T if len(nodes) == len(node) else sum((x.there[rows][:, node == k] @ y.there[:, node == k].T > 0).astype(float) for k in nodes)
                p /= np.sqrt(np.maximum(n, 1))
            yield B.pair_rows(x, y, rows, p, shared, valued, (conf, "mode", "projection"))

    return B.block_pairs(B.packed(d, [conf], "d"), [conf], B.packed(modes, ["mode"]), ["mode"], 4096, 4096, work, f"`{conf}` {kind(confs, conf)}, mode {kind(modes, 'mode')}, projection double")


def perturbation_response(c: DataFrame) -> DataFrame:
    """(``i``, ``j``, ``value``): squared covariance entries of each node pair's block, row i over its diagonal one."""
    axes = "p" in c.columns
    p = c.groupBy("i", "j").agg(F.sum(F.col("value") ** 2).alias("value")) if axes else c.select("i", "j", (F.col("value") ** 2).alias("value"))
    own = p.where("i = j").select("i", F.col("value").alias("_d"))
    return p.join(own, "i").select("i", "j", F.when(F.col("_d") == 0, 0.0).otherwise(F.col("value") / F.col("_d")).alias("value"))


def effectiveness_and_sensitivity(prs: DataFrame) -> DataFrame:
    """Means of each node's row and column without the diagonal."""
    off = prs.where("i <> j")
    e = off.groupBy(F.col("i").alias("node")).agg(F.avg("value").alias("effectiveness"))
    return e.join(off.groupBy(F.col("j").alias("node")).agg(F.avg("value").alias("sensitivity")), "node")


def flexibility_index(response: DataFrame) -> DataFrame:
    """Each node's row sum over the total."""
    rows = response.groupBy(F.col("i").alias("node")).agg(F.sum("value").alias("s"))
    return rows.crossJoin(F.broadcast(response.agg(F.sum("value").alias("t")))).select("node", (F.col("s") / F.col("t")).alias("dfi"))


def coupling_index(response: DataFrame, functional: DataFrame) -> DataFrame:
    """Mean response to the functional nodes (column ``node``) over the mean response to all."""
    f = functional.select(F.col("node").alias("j"), F.lit(1.0).alias("_f")).distinct()
    full = response.join(f, "j", "left")
    return full.groupBy(F.col("i").alias("node")).agg((F.avg(F.when(F.col("_f").isNotNull(), F.col("value"))) / F.avg("value")).alias("dci"))


def hit_times(weights: DataFrame) -> DataFrame:
    """(``i``, ``j``, ``hit``, ``commute``) of a random walk on symmetric weights; one dense pseudo-inverse."""
    workers_find_package(weights.sparkSession)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.union1d(pdf["i"], pdf["j"])
        a = np.zeros((len(nodes), len(nodes)))
        np.add.at(a, (np.searchsorted(nodes, pdf["i"]), np.searchsorted(nodes, pdf["j"])), pdf["value"])
        degree = a.sum(axis=1)
        steady = degree / degree.sum()
        z = np.linalg.pinv(np.eye(len(nodes)) - a / degree[:, None] + np.tile(steady, (len(nodes), 1)))
        hit = (np.diag(z)[None, :] - z) / steady[None, :]
        i, j = np.indices(hit.shape)
        return pd.DataFrame({"i": nodes[i.ravel()], "j": nodes[j.ravel()], "hit": hit.ravel(), "commute": (hit + hit.T).ravel()})

    kind = weights.schema["i"].dataType.simpleString()
    return weights.groupBy(F.lit("all")).applyInPandas(lambda pdf: solve(pdf), f"i {kind}, j {kind}, hit double, commute double")


def mechanical_stiffness(hessian: DataFrame, coords: DataFrame, kbt: float = 1.0) -> DataFrame:
    """(``i``, ``j``, ``stiffness``), i < j: force constant of pulling two nodes apart, from all modes of the model."""
    workers_find_package(hessian.sparkSession)
    m = modes(hessian, n_modes=None, axes=3)
    xyz = coords.select(F.col("node").alias("_n"), *AXES)
    a, b = (m.join(xyz, F.col("node") == F.col("_n")).select("mode", "variance", F.col("node").alias(n), "axis", F.col("v").alias("v" + n), *[F.col(c).alias(n + c) for c in AXES]) for n in "ij")
    pair = a.join(b.drop("variance"), ["mode", "axis"]).where("i < j")
    along = reduce(Column.__add__, [F.when(F.col("axis") == k, F.col("j" + c) - F.col("i" + c)).otherwise(0.0) for k, c in enumerate(AXES)])
    d = F.sqrt(reduce(Column.__add__, [(F.col("j" + c) - F.col("i" + c)) ** 2 for c in AXES]))
    pull = pair.groupBy("i", "j", "mode").agg(F.sum((F.col("vj") - F.col("vi")) * along / d).alias("x"), F.max("variance").alias("s"))
    # weights of the modes that the pull excites, each by its share of the extension
    w = F.abs(F.col("x")) * F.sqrt("s")
    return pull.groupBy("i", "j").agg((kbt * F.sum(w / F.col("s")) / F.sum(w)).alias("stiffness"))


def hinges(modes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(``mode``, ``node``): where a mode changes sign, the side nearer zero.

    From the node before a change the place moves on as long as the next
    node's value is nearer zero; changes that lead to one node count once.
    """
    by = Window.partitionBy(*keys, "mode").orderBy("node")
    rows = modes.select(*keys, "mode", "node", "v", F.lead("v").over(by).alias("_next"))
    stop = F.when(F.col("_next").isNull() | (F.abs("_next") >= F.abs("v")), F.col("node"))
    first = F.min(stop).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    change = F.signum("v") != F.signum("_next")
    return rows.withColumn("_at", first).where(change).select(*keys, "mode", F.col("_at").alias("node")).distinct()


def hinge_regions(modes: DataFrame, keys: Sequence[str] = (), threshold: float = 15.0, space: int | None = None) -> DataFrame:
    """(``mode``, ``region``, ``first``, ``last``): stretches about a mode's sign changes, by place from 0 in order of ``node``.

    A change's stretch is the two nodes beside it and the nodes on from them
    whose values lie inside +- sqrt(1/n)/threshold. Stretches that overlap, or
    begin within ``space`` + 1 places of the end of one before, are one.
    """
    by = Window.partitionBy(*keys, "mode")
    run = by.orderBy("node")
    rows = modes.select(*keys, "mode", "node", "v", (F.row_number().over(run) - 1).alias("k"), F.count(F.lit(1)).over(by).alias("n"), F.lead("v").over(run).alias("_next"))
    inside = F.abs("v") < F.sqrt(1.0 / F.col("n")) / threshold
    outside = F.when(~inside, F.col("k"))
    before = F.coalesce(F.max(outside).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(-1))
    after = F.coalesce(F.min(outside).over(run.rowsBetween(Window.currentRow, Window.unboundedFollowing)), F.col("n"))
    rows = rows.withColumn("_from", F.when(inside, before + 1).otherwise(F.col("k"))).withColumn("_to", F.when(inside, after - 1).otherwise(F.col("k")))
    change = rows.withColumn("_last", F.lead("_to").over(run)).where(F.signum("v") != F.signum("_next")).select(*keys, "mode", "k", F.col("_from").alias("first"), F.col("_last").alias("last"))
    order = by.orderBy("first", "k")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("first") > reach + (0 if space is None else 1 + space), F.lit(True))
    numbered = change.withColumn("_new", new.cast("int")).withColumn("region", F.sum("_new").over(order) - 1)
    return numbered.groupBy(*keys, "mode", "region").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def hinge_bands(modes: DataFrame, keys: Sequence[str] = (), threshold: float = 15.0, space: int | None = None) -> DataFrame:
    """Hinges of :func:`hinge_regions`: (``mode``, ``node``, ``band``), the region's number.

    A region of four places (``space`` + 5) or more gives its two nodes
    nearest zero; a shorter one gives the nearest, unless both its ends have
    one sign. Ties go to the earlier node.
    """
    regions = hinge_regions(modes, keys, threshold, space)
    run = Window.partitionBy(*keys, "mode").orderBy("node")
    rows = modes.select(*keys, "mode", "node", "v", (F.row_number().over(run) - 1).alias("k"))
    within = rows.join(regions, [*keys, "mode"]).where(F.col("k").between(F.col("first"), F.col("last")))
    region = Window.partitionBy(*keys, "mode", "region")
    ends = F.max_by("v", F.col("k")).over(region) * F.min_by("v", F.col("k")).over(region)
    ranked = within.withColumn("_e", ends).withColumn("_r", F.row_number().over(region.orderBy(F.abs("v"), "k")))
    wide = F.col("last") - F.col("first") + 1 >= 4 + (0 if space is None else 1 + space)
    keep = F.when(wide, F.col("_r") <= 2).otherwise((F.col("_r") == 1) & ~(F.col("_e") > 0))
    return ranked.where(keep).select(*keys, "mode", "node", F.col("region").cast("int").alias("band"))


def modes_covering(modes: DataFrame, least: float = 0.33, keys: Sequence[str] = ()) -> DataFrame:
    """The first modes that together hold at least the given share of variance."""
    share = variance_shares(modes, keys)
    by = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("mode").rowsBetween(Window.unboundedPreceding, -1)
    keep = share.withColumn("_before", F.coalesce(F.sum("share").over(by), F.lit(0.0))).where(F.col("_before") < least)
    return modes.join(keep.select(*keys, "mode"), [*keys, "mode"], "left_semi")


def most_mobile(fluct: DataFrame, percentile: float | None = None, cutoff: float | None = None) -> DataFrame:
    """Nodes at or above a percentile, or a value."""
    if percentile is not None:
        limit = fluct.agg(F.expr(f"percentile(sqfluct, {percentile / 100})").alias("_p"))
        fluct = fluct.crossJoin(F.broadcast(limit)).where("sqfluct >= _p").drop("_p")
    return fluct if cutoff is None else fluct.where(F.col("sqfluct") >= cutoff)


def spectral_dimension(modes: DataFrame) -> DataFrame:
    """Slope of the log of the mode's number, from 2 on, against the log of its frequency, over the first quarter of the modes.

    Modes are numbered from 0; a frequency is the root of an eigenvalue. With
    fewer than eight modes there is no slope: null.
    """
    each = modes.select("mode", "eigval").distinct()
    n = each.agg(F.count(F.lit(1)).alias("n"))
    low = each.crossJoin(F.broadcast(n)).where(F.col("mode") < F.floor(F.col("n") * 0.25))
    return low.agg(F.regr_slope(F.log(F.col("mode") + 2), F.log(F.sqrt("eigval"))).alias("dimension"))


# ---- entropy transfer ----------------------------------------------------------

TIMES = (0.000001, *(round(0.1 * k, 1) for k in range(1, 51)))  # time constants of the overall net transfer


def _entropy_terms(modes: DataFrame, times: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(``tau``, ``i``, ``j``, ``now``, ``later``): covariances of two nodes at once, and with the time between them."""
    a, b = _by_mode(modes, keys)
    rate = modes.select(*keys, "mode", "eigval").distinct()
    pair = a.drop("p", "variance").join(b.drop("q"), [*keys, "mode"]).join(rate, [*keys, "mode"])
    share = F.col("u") * F.col("w") / F.col("eigval")
    return pair.crossJoin(F.broadcast(times)).groupBy(*keys, "tau", "i", "j").agg(
        F.sum(share).alias("now"), F.sum(share * F.exp(-F.col("eigval") * F.col("tau"))).alias("later")
    )


def entropy_transfer(modes: DataFrame, tau: float | Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(``tau``, ``i``, ``j``, ``value``), i <> j: what node j's past leaves open about its future less what it leaves open together with node i's.

    ``modes`` have one value a node; sums over modes are combined map-side.
    """
    taus = [float(t) for t in (tau if isinstance(tau, Sequence) else (tau,))]
    c = stored(_entropy_terms(modes, modes.sparkSession.createDataFrame([(t,) for t in taus], "tau double"), keys), "entropy-terms")
    own = c.where("i = j")
    oi = own.select(*keys, "tau", "i", F.col("now").alias("_ci"))
    oj = own.select(*keys, "tau", "j", F.col("now").alias("_cj"), F.col("later").alias("_bj"))
    full = c.where("i <> j").join(oi, [*keys, "tau", "i"]).join(oj, [*keys, "tau", "j"])
    ci, cj, bj, d, e = (F.col(x) for x in ("_ci", "_cj", "_bj", "now", "later"))
    joint = ci * cj * cj + 2 * d * bj * e - (e * e + d * d) * cj - bj * bj * ci
    value = 0.5 * (F.log(cj * cj - bj * bj) - F.log(joint) - F.log(cj) + F.log(ci * cj - d * d))
    return full.select(*keys, "tau", "i", "j", value.alias("value"))


def net_entropy_transfer(transfer: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each pair's transfer less the one the other way."""
    back = transfer.select(*keys, "tau", F.col("i").alias("j"), F.col("j").alias("i"), F.col("value").alias("_back"))
    return transfer.join(back, [*keys, "tau", "i", "j"]).select(*keys, "tau", "i", "j", (F.col("value") - F.col("_back")).alias("value"))


def overall_entropy_transfer(modes: DataFrame, keys: Sequence[str] = (), times: Sequence[float] = TIMES) -> DataFrame:
    """(``i``, ``j``, ``value``): the transfer summed over time constants by the trapezoid rule."""
    transfer = entropy_transfer(modes, times, keys)
    by = Window.partitionBy(*keys, "i", "j").orderBy("tau")
    area = (F.col("tau") - F.lag("tau").over(by)) * (F.col("value") + F.lag("value").over(by)) / 2
    return transfer.withColumn("_a", area).groupBy(*keys, "i", "j").agg(F.sum("_a").alias("value"))


# ---- sampling ------------------------------------------------------------------


def sampled(modes: DataFrame, coords: DataFrame, n: int, rmsd: float = 1.0, seed: int = 0) -> DataFrame:
    """``n`` random conformations along modes with mean RMSD ``rmsd``: (``conf``, node, axis, value)."""
    spark = modes.sparkSession
    each = modes.select("mode", "variance").distinct()
    draw = spark.range(n).select(F.col("id").alias("conf")).crossJoin(F.broadcast(each)).withColumn("_r", F.randn(seed))
    draw = stored(draw, "draws")
    size = draw.groupBy("conf").agg(F.sqrt(F.sum(F.col("_r") ** 2 * F.col("variance"))).alias("_s")).agg(F.avg("_s").alias("_m"))
    nodes = coords.select("node").distinct().agg(F.count(F.lit(1)).alias("_n"))
    scale = F.sqrt("_n") * rmsd / F.col("_m")
    step = draw.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(nodes)).select("conf", "mode", (scale * F.col("_r") * F.sqrt("variance")).alias("_x"))
    moved = step.join(modes.select("mode", "node", "axis", "v"), "mode").groupBy("conf", "node", "axis").agg(F.sum(F.col("_x") * F.col("v")).alias("_d"))
    return moved.join(coords.select("node", "axis", "value"), ["node", "axis"]).select("conf", "node", "axis", (F.col("value") + F.col("_d")).alias("value"))


def traversed(modes: DataFrame, coords: DataFrame, mode: int, steps: int = 10, rmsd: float = 1.5) -> DataFrame:
    """Conformations stepping along one mode to +- ``rmsd``: (``step``, node, axis, value)."""
    one = modes.where(F.col("mode") == mode)
    nodes = coords.select("node").distinct().agg(F.count(F.lit(1)).alias("_n"))
    size = one.agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("_s"))
    joined = coords.join(one.select("node", "axis", "v"), ["node", "axis"]).crossJoin(F.broadcast(nodes)).crossJoin(F.broadcast(size))
    at = F.explode(F.sequence(F.lit(-steps), F.lit(steps)))
    return joined.select("*", at.alias("step")).select("step", "node", "axis", (F.col("value") + F.col("step") / steps * rmsd * F.sqrt("_n") / F.col("_s") * F.col("v")).alias("value"))


def reduced(matrix: DataFrame, keep: DataFrame, keys: Sequence[str] = (), axes: int = 1) -> DataFrame:
    """Schur complement of symmetric matrices, one per value of ``keys``, on the kept nodes (column ``node``): what the others do is folded in."""
    workers_find_package(matrix.sparkSession)
    marked = matrix.join(keep.select(F.col("node").alias("i"), F.lit(True).alias("_k")).distinct(), "i", "left").withColumn("_k", F.coalesce("_k", F.lit(False)))
    shown = ["i", "j", "value"] if axes == 1 else ["i", "p", "j", "q", "value"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.union1d(pdf["i"], pdf["j"])
        row, col = np.searchsorted(nodes, pdf["i"]) * axes, np.searchsorted(nodes, pdf["j"]) * axes
        if axes > 1:
            row, col = row + pdf["p"].to_numpy(), col + pdf["q"].to_numpy()
        m = np.zeros((len(nodes) * axes, len(nodes) * axes))
        np.add.at(m, (row, col), pdf["value"])
        kept = np.repeat(np.isin(nodes, pdf.loc[pdf["_k"], "i"].unique()), axes)
        s, e = np.flatnonzero(kept), np.flatnonzero(~kept)
        out = m[np.ix_(s, s)]
        if len(e):
            out = out - m[np.ix_(s, e)] @ np.linalg.solve(m[np.ix_(e, e)], m[np.ix_(e, s)])
        i, j = (x.ravel() for x in np.indices(out.shape))
        found = pd.DataFrame({"i": nodes[s[i] // axes], "p": s[i] % axes, "j": nodes[s[j] // axes], "q": s[j] % axes, "value": out.ravel()})
        for c in keys:
            found[c] = pdf[c].iloc[0]
        return found[[*keys, *shown]]

    kind = lambda c: matrix.schema[c].dataType.simpleString()
    schema = ", ".join([*[f"`{c}` {kind(c)}" for c in keys], *[f"{c} {'double' if c == 'value' else kind(c)}" for c in shown]])
    grouped = marked.groupBy(*keys) if keys else marked.groupBy(F.lit("all"))
    return grouped.applyInPandas(lambda pdf: solve(pdf), schema)


def sliced(modes: DataFrame, keep: DataFrame, norm: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Modes on the kept nodes; made unit vectors again if ``norm``."""
    part = modes.join(keep.select("node").distinct(), "node", "left_semi").select(*modes.columns)
    if not norm:
        return part
    by = Window.partitionBy(*keys, "mode")
    return part.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") ** 2).over(by)))


def extended(modes: DataFrame, nodes_to_atoms: DataFrame) -> DataFrame:
    """Node rows repeated for every atom: ``nodes_to_atoms`` has (node, atom)."""
    return modes.join(nodes_to_atoms, "node").drop("node").withColumnRenamed("atom", "node")


def principal_components(vectors: DataFrame, vector: str, keys: Sequence[str] = (), n_modes: int = 20) -> DataFrame:
    """Largest eigenpairs of the population covariance of fixed-length vectors.

    Sums of products are aggregated in numpy map-side per batch and then added
    up per coordinate row, so only dims x dims numbers a batch are shuffled.
    """
    workers_find_package(vectors.sparkSession)
    cov = vector_covariance(vectors, vector, keys)
    return modes(cov, keys, n_modes, largest=True)


def vector_covariance(vectors: DataFrame, vector: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ``i``, ``j``, ``value``): population covariance of the components of ``vector``."""
    workers_find_package(vectors.sparkSession)
    kinds = "".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}, " for c in keys)

    def partial(batches):
        for pdf in batches:
            groups = pdf.groupby(list(keys), dropna=False) if keys else [((), pdf)]
            for name, own in groups:
                if not len(own):
                    continue
                x = np.stack(own["_v"].to_numpy()).astype(float)
                row = pd.DataFrame({"i": np.arange(x.shape[1]), "n": float(len(x)), "s": x.sum(axis=0), "p": list(x.T @ x)})
                for c, v in zip(keys, name if isinstance(name, tuple) else (name,)):
                    row[c] = v
                yield row[[*keys, "i", "n", "s", "p"]]

    parts = vectors.select(*keys, F.col(vector).cast("array<double>").alias("_v")).mapInPandas(partial, f"{kinds}i int, n double, s double, p array<double>")
    long = parts.select(*keys, "i", "n", "s", F.posexplode("p").alias("j", "x"))
    sums = long.groupBy(*keys, "i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("x").alias("x"))
    means = sums.where("i = j").select(*keys, F.col("i").alias("j"), (F.col("s") / F.col("n")).alias("m"))
    return sums.join(means, [*keys, "j"]).select(*keys, "i", "j", (F.col("x") / F.col("n") - F.col("s") / F.col("n") * F.col("m")).alias("value"))


def signature(members: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Weighted mean, population deviation, min and max of a value over ensemble members; members of weight 0 do not count."""
    ends = [F.min(value).alias("min"), F.max(value).alias("max")]
    if weight is None:
        return members.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"), *ends)
    w = F.col(weight)
    live = members.where(w > 0)
    middle = live.groupBy(*keys).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("_mean"))
    named = middle.withColumnsRenamed({c: "_k_" + c for c in keys})  # one row a key, nulls included
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col("_k_" + c)) for c in keys]) if keys else F.lit(True)
    about = live.join(named, same)
    return about.groupBy(*keys).agg(F.first("_mean").alias("mean"), F.sqrt(F.sum(w * (F.col(value) - F.col("_mean")) ** 2) / F.sum(w)).alias("stddev"), *ends)
