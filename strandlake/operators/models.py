"""Further network models, classifiers over conformations, mode matching and residue scans.

Dense steps run as grouped tasks, one model each; what feeds them (contacts,
spring constants, extra nodes) is joins and column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.operators import networks as W
from strandlake.operators.neighbours import AXES, pairs_within
from strandlake.plans.iteration import stored
from strandlake.session import workers_find_package

# ---- spring constants --------------------------------------------------------


def springs(
    atoms: DataFrame, key: str, cutoff: float, gamma: Callable[[Column, Callable[[str], Column], Callable[[str], Column]], Column], extra: Sequence[str] = (), keys: Sequence[str] = ()
) -> DataFrame:
    """(``i``, ``j``, ``value``) of all contacts; ``gamma`` is a function of the distance and of both ends' extra columns."""
    side = lambda p, n: atoms.select(*keys, F.col(key).alias(n), *[F.col(c).alias(p + c) for c in (*AXES, *extra)])
    near = pairs_within(side("a_", "i"), side("b_", "j"), cutoff, keys).where("i <> j")
    value = gamma(F.col("distance"), lambda c: F.col("a_" + c), lambda c: F.col("b_" + c))
    return near.select(*keys, "i", "j", value.alias("value"), *[F.col(p + c) for p in ("a_", "b_") for c in AXES]).where("value is not null and value <> 0")


def by_structure(ordinary: float = 1.0, helix: float = 6.0, sheet: float = 6.0, connected: float = 10.0):
    """Chain neighbours stiffest; then i to i + 4 in one helix; then strands within 6 of one another. Needs chain, resnum, secondary."""

    def gamma(d: Column, a, b) -> Column:
        same, gap = a("chain") == b("chain"), F.abs(a("resnum") - b("resnum"))
        return (
            F.when(same & (gap == 1), connected)
            .when(same & (a("secondary") == "H") & (b("secondary") == "H") & (gap <= 4), helix)
            .when((a("secondary") == "E") & (b("secondary") == "E") & (d <= 6.0), sheet)
            .otherwise(ordinary)
        )

    return gamma


def by_radii(default: float = 7.5, value: float = 1.0):
    """A contact where the distance is at most the sum of both radii (column ``radius``, null: the default)."""

    def gamma(d: Column, a, b) -> Column:
        reach = F.coalesce(a("radius"), F.lit(default)) + F.coalesce(b("radius"), F.lit(default))
        return F.when(d <= reach, value)

    return gamma


def by_sequence_and_space(strong: float = 60.0, weak: float = 6.0, power_sequence: float = 2.0, power_space: float = 6.0, reach: int = 3):
    """Near in the chain: falls with the square of the sequence gap; else with the sixth power of the distance."""

    def gamma(d: Column, a, b) -> Column:
        gap = F.abs(a("resnum") - b("resnum"))
        near = (a("chain") == b("chain")) & (gap <= reach) & (gap > 0)
        return F.when(near, strong / F.pow(gap, F.lit(power_sequence))).otherwise(F.pow(weak / d, F.lit(power_space)))

    return gamma


def kirchhoff_from(springs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return W.laplacian(springs.select(*keys, "i", "j", "value"), keys)


def hessian_from(springs: DataFrame, keys: Sequence[str] = (), axis_scale: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Super-elements of given springs; ``axis_scale`` stiffens directions, as an implicit membrane does across it."""
    d = [F.col("b_" + a) - F.col("a_" + a) for a in AXES]
    d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    cell = lambda p, q: -F.col("value") * d[p] * d[q] / d2 * float((axis_scale[p] * axis_scale[q]) ** 0.5)
    blocks = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), cell(p, q).alias("value")) for p in range(3) for q in range(3)])
    off = springs.select(*keys, "i", "j", F.explode(blocks).alias("e")).select(*keys, "i", "e.p", "j", "e.q", "e.value")
    own = off.groupBy(*keys, "i", "p", "q").agg((-F.sum("value")).alias("value")).select(*keys, "i", "p", F.col("i").alias("j"), "q", "value")
    return off.unionByName(own)


def membrane_nodes(atoms: DataFrame, key: str, low: float, high: float, radius: float = 3.1, margin: float = 30.0, clear: float = 5.0) -> DataFrame:
    """Lattice points between two heights around the atoms, none within ``clear`` of one: (``key``, x, y, z), keys above all atoms'."""
    box = atoms.agg(*[(F.min(a) - margin).alias(f"{a}0") for a in "xy"], *[(F.max(a) + margin).alias(f"{a}1") for a in "xy"], F.max(key).alias("last"))
    step = 2 * radius
    along = lambda a: F.explode(F.sequence(F.lit(0), F.floor((F.col(f"{a}1") - F.col(f"{a}0")) / step).cast("int")))
    grid = box.withColumn("ix", along("x")).withColumn("iy", along("y")).withColumn("iz", F.explode(F.sequence(F.lit(0), F.lit(int((high - low) // step)))))
    shift = F.when(F.col("iz") % 2 == 1, radius).otherwise(0.0)
    nodes = grid.select("last", (F.col("x0") + F.col("ix") * step + shift).alias("x"), (F.col("y0") + F.col("iy") * step + shift).alias("y"), (low + F.col("iz") * step).alias("z"))
    a = nodes.select(*[F.col(c).alias("a_" + c) for c in "xyz"])
    b = atoms.select(*[F.col(c).alias("b_" + c) for c in "xyz"])
    close = pairs_within(a, b, clear).select(*[F.col("a_" + c).alias(c) for c in "xyz"]).distinct()
    free = nodes.join(close, list("xyz"), "left_anti")
    by = Window.partitionBy(F.lit(0)).orderBy("z", "y", "x")
    return free.select((F.col("last") + F.row_number().over(by)).alias(key), "x", "y", "z")


def rigid_block_modes(hessian: DataFrame, coords: DataFrame, blocks: DataFrame, n_modes: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """Slow modes of an anisotropic model whose blocks move as rigid bodies.

    ``coords`` has (keys, node, x, y, z), ``blocks`` (keys, node, block). Each
    block has three shifts and, with three nodes or more, three turns; the
    Hessian is projected on them and modes come back on the nodes.
    """
    workers_find_package(hessian.sparkSession)

    def solve(h: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        nodes = c["node"].to_numpy()
        order = np.argsort(nodes)
        nodes, xyz, block = nodes[order], c[list("xyz")].to_numpy()[order], c["block"].to_numpy()[order]
        n = len(nodes)
        m = np.zeros((3 * n, 3 * n))
        np.add.at(m, (3 * np.searchsorted(nodes, h["i"]) + h["p"], 3 * np.searchsorted(nodes, h["j"]) + h["q"]), h["value"])
        basis = []
        for b in np.unique(block):
            own = np.flatnonzero(block == b)
            x = xyz[own] - xyz[own].mean(axis=0)
            move = [np.eye(3)[k] * np.ones((len(own), 1)) for k in range(3)]
            if len(own) > 2:
                move += [np.cross(np.eye(3)[k], x) for k in range(3)]
            q, r = np.linalg.qr(np.array([v.ravel() for v in move]).T)
            q = q[:, np.abs(np.diag(r)) > 1e-9]
            full = np.zeros((3 * n, q.shape[1]))
            full[(3 * own[:, None] + np.arange(3)).ravel()] = q
            basis.append(full)
        p = np.concatenate(basis, axis=1)
        values, vectors = np.linalg.eigh(p.T @ m @ p)
        pick = [k for k in range(len(values)) if values[k] > W.ZERO][:n_modes]
        out = []
        for number, k in enumerate(pick):
            v = p @ vectors[:, k]
            v = v * (1 if v[np.abs(v).argmax()] > 0 else -1)
            out.append(pd.DataFrame({"mode": number, "eigval": values[k], "variance": 1 / values[k], "node": np.repeat(nodes, 3), "axis": np.tile(np.arange(3), n), "v": v}))
        found = pd.concat(out) if out else pd.DataFrame({x: [] for x in ("mode", "eigval", "variance", "node", "axis", "v")})
        for k in keys:
            found[k] = c[k].iloc[0]
        return found[[*keys, "mode", "eigval", "variance", "node", "axis", "v"]]

    kinds = "".join(f"`{c}` {hessian.schema[c].dataType.simpleString()}, " for c in keys)
    node = hessian.schema["i"].dataType.simpleString()
    full = coords.join(blocks, [*keys, "node"])
    by = list(keys) or [F.lit("all").alias("_all")]
    return hessian.groupBy(*by).cogroup(full.groupBy(*by)).applyInPandas(lambda a, b: solve(a, b), f"{kinds}mode int, eigval double, variance double, node {node}, axis int, v double")


# ---- conformations with classes -----------------------------------------------


def discriminant(vectors: DataFrame, vector: str, label: str, n_modes: int | None = None, shrink: float = 1e-3) -> DataFrame:
    """Linear discriminant directions of labelled vectors: (``mode``, ``eigval``, ``node``, ``v``).

    Means and covariances per label are aggregated; only one dims x dims
    problem is solved.
    """
    counts = vectors.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    within = W.vector_covariance(vectors, vector, (label,)).join(counts, label).groupBy("i", "j").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("w"))
    both = within.join(W.vector_covariance(vectors, vector).withColumnRenamed("value", "t"), ["i", "j"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["i"].max()) + 1
        w, t = np.zeros((n, n)), np.zeros((n, n))
        w[pdf["i"], pdf["j"]], t[pdf["i"], pdf["j"]] = pdf["w"], pdf["t"]
        w += shrink * np.trace(w) / n * np.eye(n)
        root = np.linalg.inv(np.linalg.cholesky(w))
        values, vectors_ = np.linalg.eigh(root @ (t - w) @ root.T)
        out = []
        for k, i in enumerate(np.argsort(values)[::-1][: n_modes or n]):
            v = root.T @ vectors_[:, i]
            v = v / np.linalg.norm(v) * (1 if v[np.abs(v).argmax()] > 0 else -1)
            out.append(pd.DataFrame({"mode": k, "eigval": values[i], "node": np.arange(n), "v": v}))
        return pd.concat(out)

    return both.groupBy(F.lit("all")).applyInPandas(lambda pdf: solve(pdf), "mode int, eigval double, node int, v double")


def logistic(vectors: DataFrame, vector: str, label: str) -> DataFrame:
    """Weights of a logistic regression over conformations: (``label``, ``node``, ``v``), the built-in solver."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    fit = LogisticRegression(family="multinomial", regParam=0.01).fit(rows)
    w = fit.coefficientMatrix.toArray()
    out = [(k, i, float(v)) for k, row in enumerate(w) for i, v in enumerate(row)]
    return vectors.sparkSession.createDataFrame(out, "label int, node int, v double")


# ---- modes of several models ----------------------------------------------------


def matched(overlap: DataFrame) -> DataFrame:
    """One to one pairs of modes with the largest sum of absolute overlaps: (``mode_a``, ``mode_b``, ``overlap``)."""
    workers_find_package(overlap.sparkSession)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.unique(pdf["mode_a"]), np.unique(pdf["mode_b"])
        m = np.zeros((len(a), len(b)))
        m[np.searchsorted(a, pdf["mode_a"]), np.searchsorted(b, pdf["mode_b"])] = pdf["overlap"]
        rows = assignment(-np.abs(m))
        return pd.DataFrame([(a[i], b[j], m[i, j]) for i, j in rows], columns=["mode_a", "mode_b", "overlap"])

    return overlap.groupBy(F.lit("all")).applyInPandas(lambda pdf: solve(pdf), "mode_a int, mode_b int, overlap double")


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost pairs of rows and columns, by shortest augmenting paths with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        least, seen, back = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            seen[col] = True
            at = owner[col]
            slack = c[at - 1] - u[at] - v[1:]
            better = ~seen[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            back[1:][better] = col
            free = np.where(seen[1:], np.inf, least[1:])
            nxt = int(free.argmin()) + 1
            delta = least[nxt]
            u[owner[seen]] += delta
            v[seen] -= delta
            least[~seen] -= delta
            col = nxt
            if not owner[col]:
                break
        while col:
            owner[col] = owner[back[col]]
            col = back[col]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((j, i) if flip else (i, j) for i, j in pairs)


def ensemble_spectral_overlaps(modes: DataFrame, member: str) -> DataFrame:
    """(``a``, ``b``, ``overlap``): spectral overlaps of all pairs of members, each pair from sums over shared nodes."""
    each = modes.select(member, "mode", "variance").distinct()
    total = each.groupBy(member).agg(F.sum("variance").alias("t"))
    u = modes.select(F.col(member).alias("a"), F.col("mode").alias("ma"), "node", "axis", F.col("v").alias("x"), F.col("variance").alias("sa"))
    w = modes.select(F.col(member).alias("b"), F.col("mode").alias("mb"), "node", "axis", F.col("v").alias("y"), F.col("variance").alias("sb"))
    dots = u.join(w, ["node", "axis"]).where("a <= b").groupBy("a", "b", "ma", "mb").agg(F.sum(F.col("x") * F.col("y")).alias("o"), F.max("sa").alias("sa"), F.max("sb").alias("sb"))
    shared = dots.groupBy("a", "b").agg(F.sum(F.sqrt(F.col("sa") * F.col("sb")) * F.col("o") ** 2).alias("s"))
    ta, tb = total.select(F.col(member).alias("a"), F.col("t").alias("ta")), total.select(F.col(member).alias("b"), F.col("t").alias("tb"))
    t = F.col("ta") + F.col("tb")
    return shared.join(ta, "a").join(tb, "b").select("a", "b", (1 - F.sqrt(F.greatest(t - 2 * F.col("s"), F.lit(0.0)) / t)).alias("overlap"))


def subfamily_overlaps(overlap: DataFrame, families: DataFrame, member: str, family: str, least: int = 4) -> DataFrame:
    """Mean overlap within (diagonal included) and between families of ``least`` members or more."""
    big = families.groupBy(family).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(family)
    f = families.join(big, family, "left_semi")
    fa, fb = (f.select(F.col(member).alias(n), F.col(family).alias("f" + n)) for n in "ab")
    full = overlap.join(fa, "a").join(fb, "b")
    return full.groupBy(F.least("fa", "fb").alias("family_a"), F.greatest("fa", "fb").alias("family_b")).agg(F.avg("overlap").alias("overlap"))


def anisotropic_factors(modes: DataFrame) -> DataFrame:
    """Six displacement values 11 22 33 12 13 23 of each node: (``node``, ``anisou``)."""
    wide = modes.groupBy("mode", "node").agg(*[F.max(F.when(F.col("axis") == k, F.col("v"))).alias(f"v{k}") for k in range(3)], F.max("variance").alias("s"))
    cell = lambda p, q: F.sum(F.col(f"v{p}") * F.col(f"v{q}") * F.col("s"))
    return wide.groupBy("node").agg(F.array(*[cell(p, q) for p, q in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))]).alias("anisou"))


def pair_deformations(modes: DataFrame, coords: DataFrame, i: int, j: int, kbt: float = 1.0) -> DataFrame:
    """How far each mode changes the distance of two nodes at an energy: (``mode``, ``deformation``)."""
    two = coords.where(F.col("node").isin(i, j))
    xyz = two.select("node", F.posexplode(F.array(*AXES)).alias("axis", "r"))
    side = lambda n, c: modes.where(F.col("node") == n).select("mode", "axis", F.col("v").alias(c), F.col("variance").alias("s" + c))
    line = xyz.groupBy("axis").agg((F.max(F.when(F.col("node") == j, F.col("r"))) - F.max(F.when(F.col("node") == i, F.col("r")))).alias("d"))
    length = line.agg(F.sqrt(F.sum(F.col("d") ** 2)).alias("l"))
    full = side(i, "u").join(side(j, "w"), ["mode", "axis"]).join(F.broadcast(line), "axis").crossJoin(F.broadcast(length))
    return full.groupBy("mode").agg((F.abs(F.sum((F.col("w") - F.col("u")) * F.col("d") / F.col("l"))) * F.sqrt(F.max("su") * kbt)).alias("deformation"))


def rank_scores(collectivity: DataFrame) -> DataFrame:
    """Modes scored by their ranks in number and in collectivity: (``mode``, ``collectivity``, ``score``), the lowest best."""
    by = Window.partitionBy(F.lit(0))
    n = F.count(F.lit(1)).over(by)
    rank = F.rank().over(by.orderBy(F.desc("collectivity"))) + F.rank().over(by.orderBy("mode"))
    return collectivity.select("mode", "collectivity", (rank / (2.0 * n)).alias("score"))


def essential_residues(calphas: DataFrame, heavy: DataFrame, cutoff: float = 10.0, n_modes: int = 10) -> DataFrame:
    """(``residue``, ``shift``, ``zscore``): how much crowding a residue with its heavy atoms stiffens the slowest modes.

    ``calphas`` has (node, x, y, z), ``heavy`` (residue, x, y, z). For each
    residue the network of all CA and its heavy atoms is built, folded back on
    the CA, and the first eigenvalues' mean change in percent is taken; one
    task a residue, each with the CA table.
    """
    workers_find_package(calphas.sparkSession)
    pairs = heavy.select(F.col("residue").alias("_of")).distinct().crossJoin(calphas.select("node", "x", "y", "z"))

    def network(x: np.ndarray) -> np.ndarray:
        d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        off = -((d2 <= cutoff * cutoff) & (d2 > 0)).astype(float)
        return off - np.diag(off.sum(axis=1))

    def slow(m: np.ndarray) -> np.ndarray:
        values = np.linalg.eigvalsh(m)
        return values[values > W.ZERO][:n_modes]

    def scan(ca: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(ca) or not len(own):
            return pd.DataFrame({"residue": [], "shift": []})
        base = ca.sort_values("node")[list("xyz")].to_numpy()
        full = network(np.concatenate((base, own[list("xyz")].to_numpy())))
        n = len(base)
        folded = full[:n, :n] - full[:n, n:] @ np.linalg.pinv(full[n:, n:]) @ full[n:, :n]
        a, b = slow(network(base)), slow(folded)
        k = min(len(a), len(b))
        return pd.DataFrame({"residue": [own["residue"].iloc[0]], "shift": [float((100 * (b[:k] - a[:k]) / a[:k]).mean())]})

    kind = heavy.schema["residue"].dataType.simpleString()
    out = pairs.groupBy("_of").cogroup(heavy.groupBy("residue")).applyInPandas(lambda a, b: scan(a, b), f"residue {kind}, shift double")
    by = Window.partitionBy(F.lit(0))
    sd = F.stddev_pop("shift").over(by)
    return out.withColumn("zscore", F.when(sd == 0, 0.0).otherwise((F.col("shift") - F.avg("shift").over(by)) / sd))


def adaptive_path(start: DataFrame, end: DataFrame, steps: int = 20, cutoff: float = 15.0, n_modes: int = 20, share: float = 0.4) -> DataFrame:
    """A path from one structure to another along its own slow modes: (``step``, node, x, y, z).

    Every step solves the model of the current structure and moves by the part
    of the remaining difference that its modes hold, ``share`` of it; it stops
    early when less than a hundredth of an angstrom is left.
    """
    now = stored(start.select("node", *AXES), "path")
    out = now.withColumn("step", F.lit(0))
    for k in range(1, steps + 1):
        modes = stored(W.modes(W.hessian(now, "node", cutoff), n_modes=n_modes, axes=3), "path-modes")
        gap = now.join(end.select("node", *[F.col(a).alias("t" + a) for a in AXES]), "node")
        long = gap.select("node", F.posexplode(F.array(*[F.col("t" + a) - F.col(a) for a in AXES])).alias("axis", "d"))
        left = long.agg(F.sqrt(F.sum(F.col("d") ** 2) / F.countDistinct("node")).alias("r")).first()["r"]
        if left is None or left < 0.01:
            break
        part = modes.join(long, ["node", "axis"]).groupBy("mode").agg(F.sum(F.col("v") * F.col("d")).alias("c"))
        step = modes.join(part, "mode").groupBy("node", "axis").agg((share * F.sum(F.col("v") * F.col("c"))).alias("m"))
        wide = step.groupBy("node").agg(*[F.max(F.when(F.col("axis") == i, F.col("m"))).alias("m" + a) for i, a in enumerate(AXES)])
        now = stored(now.join(wide, "node").select("node", *[(F.col(a) + F.col("m" + a)).alias(a) for a in AXES]), "path")
        out = out.unionByName(now.withColumn("step", F.lit(k)))
    return out


def realigned(modes: DataFrame, rotation: Sequence[Sequence[float]]) -> DataFrame:
    """Modes of three axes turned into another frame."""
    wide = modes.groupBy("mode", "eigval", "variance", "node").agg(*[F.max(F.when(F.col("axis") == k, F.col("v"))).alias(f"v{k}") for k in range(3)])
    turned = F.array(*[sum((float(rotation[p][k]) * F.col(f"v{k}") for k in range(1, 3)), float(rotation[p][0]) * F.col("v0")) for p in range(3)])
    return wide.select("mode", "eigval", "variance", "node", F.posexplode(turned).alias("axis", "v"))


def interpolated_modes(modes: DataFrame, nodes: DataFrame, atoms: DataFrame, norm: bool = False) -> DataFrame:
    """Modes carried from nodes (node, x, y, z) to atoms (atom, x, y, z) by a smooth spline in space, one mode a task.

    The spline has the distance as kernel and a linear part; it gives the
    node's own value at a node.
    """
    workers_find_package(modes.sparkSession)
    own = modes.join(nodes, "node").select("mode", "eigval", "variance", "node", "axis", "v", *AXES)
    each = modes.select(F.col("mode").alias("_m")).distinct().crossJoin(atoms.select("atom", *[F.col(a).alias(a) for a in AXES]))

    def spline(m: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(m) or not len(a):
            return pd.DataFrame({c: [] for c in ("mode", "eigval", "variance", "node", "axis", "v")})
        wide = m.pivot_table(index="node", columns="axis", values="v")
        x = m.drop_duplicates("node").set_index("node").loc[wide.index, list(AXES)].to_numpy()
        y = a[list(AXES)].to_numpy()
        kernel = lambda p, q: np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2))
        line = lambda p: np.concatenate((np.ones((len(p), 1)), p), axis=1)
        n = len(x)
        big = np.zeros((n + 4, n + 4))
        big[:n, :n], big[:n, n:], big[n:, :n] = kernel(x, x), line(x), line(x).T
        weights = np.linalg.lstsq(big, np.concatenate((wide.to_numpy(), np.zeros((4, wide.shape[1])))), rcond=None)[0]
        v = kernel(y, x) @ weights[:n] + line(y) @ weights[n:]
        if norm:
            v = v / np.sqrt((v**2).sum())
        first = m.iloc[0]
        return pd.DataFrame({"mode": first["mode"], "eigval": first["eigval"], "variance": first["variance"], "node": np.repeat(a["atom"].to_numpy(), v.shape[1]), "axis": np.tile(np.arange(v.shape[1]), len(a)), "v": v.ravel()})

    kind = atoms.schema["atom"].dataType.simpleString()
    return own.groupBy("mode").cogroup(each.groupBy("_m")).applyInPandas(lambda m, a: spline(m, a), f"mode int, eigval double, variance double, node {kind}, axis int, v double")


# ---- chain terms, membranes --------------------------------------------------------


def membrane_scaled(hessian: DataFrame, coords: DataFrame, scale: float = 16.0, low: float = -13.0, high: float = 13.0, keys: Sequence[str] = ()) -> DataFrame:
    """The Hessian with stiffer motion in the plane of a membrane between two heights.

    A link's x and y parts grow by the fourth root of ``scale`` for each of its
    ends inside and each of the two axes; diagonal blocks stay minus the sum of
    the others. ``coords`` has (keys, ``node``, z).
    """
    root = float(scale) ** 0.25
    inside = coords.select(*keys, F.col("node"), ((F.col("z") > low) & (F.col("z") < high)).alias("_in"))
    side = lambda n: inside.withColumnsRenamed({"node": n, "_in": f"_{n}"})
    flat = (F.col("p") < 2).cast("int") + (F.col("q") < 2).cast("int")
    ends = F.col("_i").cast("int") + F.col("_j").cast("int")
    off = hessian.where("i <> j").join(side("i"), [*keys, "i"]).join(side("j"), [*keys, "j"])
    off = off.select(*keys, "i", "p", "j", "q", (F.col("value") * F.pow(F.lit(root), flat * ends)).alias("value"))
    diagonal = off.groupBy(*keys, "i", "p", "q").agg((-F.sum("value")).alias("value")).select(*keys, "i", "p", F.col("i").alias("j"), "q", "value")
    return off.unionByName(diagonal)


def _bend(x: np.ndarray) -> np.ndarray:
    """Gradient of the angle at the middle of three points: (rows, 3, 3)."""
    b, c = x[:, 0] - x[:, 1], x[:, 2] - x[:, 1]
    nb, nc = (np.linalg.norm(v, axis=1, keepdims=True) for v in (b, c))
    u, w = b / nb, c / nc
    cos = (u * w).sum(axis=1, keepdims=True)
    sin = np.sqrt(np.maximum(1 - cos**2, 1e-12))
    first, last = (u * cos - w) / (nb * sin), (w * cos - u) / (nc * sin)
    return np.stack([first, -first - last, last], axis=1)


def _twist(x: np.ndarray) -> np.ndarray:
    """Gradient of the torsion of four points: (rows, 4, 3)."""
    b = np.diff(x, axis=1)
    n, m = np.cross(b[:, 0], b[:, 1]), np.cross(b[:, 1], b[:, 2])
    axis = np.linalg.norm(b[:, 1], axis=1, keepdims=True)
    square = lambda v: (v * v).sum(axis=1, keepdims=True)
    along = lambda k: (b[:, k] * b[:, 1]).sum(axis=1, keepdims=True) / axis**2
    first, last = -axis / square(n) * n, axis / square(m) * m
    second = -(1 + along(0)) * first + along(2) * last
    return np.stack([first, second, -first - second - last, last], axis=1)


def chain_terms(atoms: DataFrame, key: str, bend: float = 10.0, twist: float = 1.0, curve: float = 20.0, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, i, p, j, q, value): second derivatives of angle, torsion and curvature springs along a chain, at rest.

    A spring's part is its constant times the outer product of the gradient of
    what it holds: the angle of three, the torsion of four neighbours in the
    order of ``key``, and the second difference of three places. Straight and
    coinciding neighbours have no torsion. Rows come from windows of four, so
    no chain is held whole.
    """
    workers_find_package(atoms.sparkSession)
    by = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(key)  # one structure's nodes
    names = (key, *AXES)
    four = atoms.select(*keys, *[(F.col(c) if k == 0 else F.lead(c, k).over(by)).alias(f"{'n' if c == key else c}{k}") for k in range(4) for c in names])

    def work(batches):
        for pdf in batches:
            parts = []
            for width, constant, gradient in ((3, bend, _bend), (4, twist, _twist)):
                rows = pdf[pdf[f"n{width - 1}"].notna()]
                if len(rows) == 0:
                    continue
                x = np.stack([rows[[f"{a}{k}" for a in AXES]].to_numpy(float) for k in range(width)], axis=1)
                step = np.diff(x, axis=1)
                sound = (np.linalg.norm(step, axis=2) > 1e-12).all(axis=1)
                if width == 4:
                    for k in (0, 1):
                        sound &= (np.cross(step[:, k], step[:, k + 1]) ** 2).sum(axis=1) >= 1e-10
                rows, x = rows[sound], x[sound]
                if len(rows):
                    parts.append((rows, width, constant, gradient(x)))
                if width == 3:
                    whole = pdf[pdf["n2"].notna()]
                    for axis in range(3):
                        second = np.zeros((len(whole), 3, 3))
                        second[:, :, axis] = (1.0, -2.0, 1.0)
                        parts.append((whole, 3, curve, second))
            for rows, width, constant, g in parts:
                for a in range(width):
                    for b in range(width):
                        block = constant * g[:, a, :, None] * g[:, b, None, :]
                        for p in range(3):
                            for q in range(3):
                                out = rows[list(keys)].copy()
                                out["i"], out["p"], out["j"], out["q"] = rows[f"n{a}"].to_numpy(), p, rows[f"n{b}"].to_numpy(), q
                                out["value"] = block[:, p, q]
                                yield out[out["value"] != 0]

    kind = lambda c: atoms.schema[c].dataType.simpleString()
    lead = "".join(f"`{c}` {kind(c)}, " for c in keys)
    terms = four.mapInPandas(work, f"{lead}i {kind(key)}, p int, j {kind(key)}, q int, value double")
    return terms.groupBy(*keys, "i", "p", "j", "q").agg(F.sum("value").alias("value"))


def generalised_hessian(
    atoms: DataFrame, key: str, cutoff: float = 15.0, gamma: float = 1.0, bend: float = 10.0, twist: float = 1.0, curve: float = 20.0, sequential: bool = True, keys: Sequence[str] = ()
) -> DataFrame:
    """The anisotropic model with ``chain_terms``; ``sequential`` links chain neighbours beyond the cutoff too."""
    pairs = W.hessian(atoms, key, cutoff, gamma, keys)
    parts = pairs.unionByName(chain_terms(atoms, key, bend, twist, curve, keys).select(*pairs.columns))
    if sequential:
        by = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(key)
        nxt = atoms.select(*keys, F.col(key).alias("i"), F.lead(key).over(by).alias("j"), *[F.col(a).alias("a_" + a) for a in AXES], *[F.lead(a).over(by).alias("b_" + a) for a in AXES])
        d = [F.col("b_" + a) - F.col("a_" + a) for a in AXES]
        d2 = d[0] ** 2 + d[1] ** 2 + d[2] ** 2
        far = nxt.where("j is not null").withColumn("_d2", d2).where(F.col("_d2") > float(cutoff) ** 2)
        ends = F.array(*[F.struct(F.col(a).alias("i"), F.col(b).alias("j"), F.lit(s).alias("s")) for a, b, s in (("i", "j", -1.0), ("j", "i", -1.0), ("i", "i", 1.0), ("j", "j", 1.0))])
        axes = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), (gamma * d[p] * d[q] / F.col("_d2")).alias("v")) for p in range(3) for q in range(3)])
        each = far.select(*keys, F.explode(ends).alias("e"), axes.alias("b")).select(*keys, "e", F.explode("b").alias("b"))
        parts = parts.unionByName(each.select(*keys, "e.i", "b.p", "e.j", "b.q", (F.col("e.s") * F.col("b.v")).alias("value")))
    return parts.groupBy(*keys, "i", "p", "j", "q").agg(F.sum("value").alias("value"))
