"""Ensembles: RMSD, fluctuations, superposition, occupancies, refinement.

Conformations in long form have one row per (conformation, atom) with x, y, z;
a missing atom has no row (or weight 0). In wide form a conformation is one
``array<double>``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.neighbours import AXES
from strandlake.plans.iteration import stored
from strandlake.session import workers_find_package


def _w(weights: str | None) -> Column:
    return F.lit(1.0) if weights is None else F.col(weights)


def rmsd_to_reference(confs: DataFrame, reference: DataFrame, conf: str, atom: str, weights: str | None = None) -> DataFrame:
    """sqrt(sum(w d^2) / sum(w)) of each conformation from the reference, over the atoms both have."""
    ref = reference.select(atom, *[F.col(a).alias("_r" + a) for a in AXES])
    d2 = reduce(Column.__add__, [(F.col(a) - F.col("_r" + a)) ** 2 for a in AXES])
    w = _w(weights)
    return confs.join(ref, atom).groupBy(conf).agg(F.sqrt(F.sum(w * d2) / F.sum(w)).alias("rmsd"))


def fluctuations(confs: DataFrame, atom: str | Sequence[str], weights: str | None = None) -> DataFrame:
    """Mean square fluctuation of each atom about its mean, and its root; atoms missing from a conformation do not count."""
    keys = [atom] if isinstance(atom, str) else list(atom)
    if weights is None:
        msf = reduce(Column.__add__, [F.var_pop(a) for a in AXES])
        return confs.groupBy(*keys).agg(msf.alias("msf"), F.sqrt(msf).alias("rmsf"), F.count(F.lit(1)).alias("n"))
    w = _w(weights)
    means = confs.groupBy(*keys).agg(*[(F.sum(w * F.col(a)) / F.sum(w)).alias("_m" + a) for a in AXES])
    d2 = reduce(Column.__add__, [(F.col(a) - F.col("_m" + a)) ** 2 for a in AXES])
    msf = F.sum(w * d2) / F.sum(w)
    return confs.join(means, keys).groupBy(*keys).agg(msf.alias("msf"), F.sqrt(msf).alias("rmsf"), F.sum((w > 0).cast("long")).alias("n"))


def mean_conformation(confs: DataFrame, atom: str, weights: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    w = _w(weights)
    return confs.groupBy(*keys, atom).agg(*[(F.sum(w * F.col(a)) / F.sum(w)).alias(a) for a in AXES])


def deviations(confs: DataFrame, reference: DataFrame, conf: str, atom: str) -> DataFrame:
    """Conformation minus reference."""
    ref = reference.select(atom, *[F.col(a).alias("_r" + a) for a in AXES])
    return confs.join(ref, atom).select(conf, atom, *[(F.col(a) - F.col("_r" + a)).alias("d" + a) for a in AXES])


def kabsch(mobile: np.ndarray, target: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rotation R and shift t for which R m + t is nearest the target in weighted least squares; never a reflection."""
    w = np.ones(len(mobile)) if w is None else w
    share = (w / w.sum())[:, None]
    mid_m, mid_t = (share * mobile).sum(axis=0), (share * target).sum(axis=0)
    u, _, vt = np.linalg.svd((mobile - mid_m).T @ ((target - mid_t) * w[:, None]))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))])
    rotation = vt.T @ flip @ u.T
    return rotation, mid_t - rotation @ mid_m


def transformations(confs: DataFrame, reference: DataFrame, conf: str, atom: str, weights: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``conf, rotation (9 values), shift (3)``: the best superposition of each conformation on the reference.

    The cross moments about the centres are aggregates that Spark combines
    map-side, so that places far from the origin lose no digits; only 16
    numbers a conformation reach the 3 x 3 decomposition. With weights the
    centres are found first and joined back.
    """
    workers_find_package(confs.sparkSession)
    ref = reference.select(*keys, atom, *[F.col(a).alias("_r" + a) for a in AXES])
    joined = confs.join(ref, [*keys, atom])
    if weights is None:
        middles = [F.avg(a).alias("m" + a) for a in AXES] + [F.avg("_r" + a).alias("t" + a) for a in AXES]
        crossed = [(F.covar_pop(a, "_r" + b) * F.count(F.lit(1))).alias(f"c{a}{b}") for a in AXES for b in AXES]
        moments = joined.groupBy(*keys, conf).agg(*middles, *crossed)
    else:
        w = _w(weights)
        mean = lambda c, n: (F.sum(w * F.col(c)) / F.sum(w)).alias(n)
        middles = joined.groupBy(*keys, conf).agg(*[mean(a, "m" + a) for a in AXES], *[mean("_r" + a, "t" + a) for a in AXES])
        crossed = [F.sum(w * (F.col(a) - F.col("m" + a)) * (F.col("_r" + b) - F.col("t" + b))).alias(f"c{a}{b}") for a in AXES for b in AXES]
        same = [F.first(k + a).alias(k + a) for k in "mt" for a in AXES]
        moments = joined.join(middles, [*keys, conf]).groupBy(*keys, conf).agg(*same, *crossed)

    def solve(batches):
        for pdf in batches:
            turns, shifts = [], []
            for row in pdf.itertuples(index=False):
                r = row._asdict()
                mid_m, mid_t = (np.array([r[k + a] for a in AXES]) for k in "mt")
                u, _, vt = np.linalg.svd(np.array([[r[f"c{a}{b}"] for b in AXES] for a in AXES]))
                rotation = vt.T @ np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))]) @ u.T
                turns.append(rotation.ravel())
                shifts.append(mid_t - rotation @ mid_m)
            yield pdf[[*keys, conf]].assign(rotation=turns, shift=shifts)

    kinds = ", ".join(f"`{c}` {confs.schema[c].dataType.simpleString()}" for c in (*keys, conf))
    return moments.mapInPandas(solve, f"{kinds}, rotation array<double>, shift array<double>")


def apply_transformations(confs: DataFrame, moves: DataFrame, conf: str, keys: Sequence[str] = ()) -> DataFrame:
    joined = confs.join(moves.select(*keys, conf, "rotation", "shift"), [*keys, conf])
    at = lambda i: sum((F.col("rotation")[3 * i + k] * F.col(a) for k, a in enumerate(AXES)), F.col("shift")[i])
    return joined.withColumns({a: at(i) for i, a in enumerate(AXES)}).select(*confs.columns)


def superposed(confs: DataFrame, reference: DataFrame, conf: str, atom: str, weights: str | None = None) -> DataFrame:
    """Every conformation moved onto the reference."""
    return apply_transformations(confs, transformations(confs, reference, conf, atom, weights), conf)


def iteratively_superposed(confs: DataFrame, conf: str, atom: str, weights: str | None = None, tolerance: float = 1e-4, most: int = 50) -> DataFrame:
    """Superposes on the first conformation, then on the mean until the mean moves by no more than ``tolerance``; an error if ``most`` rounds do not suffice."""
    first = confs.agg(F.min(conf)).first()[0]
    mean = confs.where(F.col(conf) == first).select(atom, *AXES)
    for _ in range(most):
        confs = stored(superposed(confs, mean, conf, atom, weights), "superposed")
        new = stored(mean_conformation(confs, atom, weights), "mean")
        d2 = reduce(Column.__add__, [(F.col(f"n{a}") - F.col(a)) ** 2 for a in AXES])
        moved = new.select(atom, *[F.col(a).alias(f"n{a}") for a in AXES]).join(mean, atom).agg(F.sqrt(F.avg(d2))).first()[0]
        mean = new
        if moved is None or moved <= tolerance:
            return confs
    raise RuntimeError(f"the mean still moves by more than {tolerance} after {most} rounds")


def pairwise_rmsd(confs: DataFrame, conf: str, vector: str, dims: int = 3) -> DataFrame:
    """(``i``, ``j``, ``rmsd``), i < j: root of the squared distance of flat conformations over their atoms."""
    return _block_rows(confs, conf, vector, lambda x, y: np.sqrt(((x - y) ** 2).sum(axis=1) / max(x.shape[1] / dims, 1)), "rmsd")


def _block_rows(rows: DataFrame, key: str, vector: str, value, name: str, block: int = 512) -> DataFrame:
    """(``i``, ``j``, ``name``), i < j, for all pairs of rows: ``value`` of a row (repeated) and the rows of a block.

    Rows are dealt into blocks and each pair of blocks meets in one task, so
    no task sees more than two blocks and nothing is broadcast.
    """
    workers_find_package(rows.sparkSession)
    blocks = max(1, -(-rows.count() // block))
    kind = rows.schema[key].dataType.simpleString()
    dealt = rows.select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_b"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")), lambda o: F.struct(F.least("_b", o).alias("p"), F.greatest("_b", o).alias("q")))
    spread = dealt.select("_k", "_v", "_b", F.explode(F.array_distinct(others)).alias("_s")).select("_k", "_v", "_b", "_s.p", "_s.q")

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        a, b = pdf[pdf["_b"] == p], pdf[pdf["_b"] == q]
        ka, kb = a["_k"].to_numpy(), b["_k"].to_numpy()
        parts = [(np.empty(0, ka.dtype), np.empty(0, ka.dtype), np.empty(0))]
        if len(a) and len(b):
            x, y = np.stack(a["_v"].to_numpy()), np.stack(b["_v"].to_numpy())
            for i in range(len(a)):
                other = np.flatnonzero(kb > ka[i]) if p == q else np.arange(len(b))
                if len(other):
                    parts.append((np.minimum(ka[i], kb[other]), np.maximum(ka[i], kb[other]), value(np.broadcast_to(x[i], (len(other), x.shape[1])), y[other])))
        return pd.DataFrame(dict(zip(("i", "j", name), map(np.concatenate, zip(*parts)))))

    return spread.groupBy("p", "q").applyInPandas(pairs, f"i {kind}, j {kind}, {name} double")


def occupancies(confs: DataFrame, atom: str, weight: str, normed: bool = False) -> DataFrame:
    """Conformations that hold each atom (weight over 0), or their share."""
    seen = F.sum((F.col(weight) > 0).cast("long"))
    return confs.groupBy(atom).agg((seen / F.count(F.lit(1)) if normed else seen).alias("occupancy"))


def trimmed(confs: DataFrame, atom: str, weight: str, least: float) -> DataFrame:
    """Conformations without the atoms whose share of conformations is below ``least``."""
    good = occupancies(confs, atom, weight, True).where(F.col("occupancy") >= least).select(atom)
    return confs.join(good, atom, "left_semi")


def refined(conflicts: DataFrame, members: DataFrame, key: str, protected: Sequence = ()) -> DataFrame:
    """Members left after greedy removal: the one in most conflicts goes first, until none is left.

    ``conflicts`` has (``i``, ``j``). Each round removes, at once, every
    unprotected member whose number of conflicts is the largest among those it
    conflicts with (ties: the larger key goes), so members far apart in the
    conflict graph are settled in parallel; rounds are counted by conflicts
    left, never by members.
    """
    spark = members.sparkSession
    kind = members.schema[key].dataType
    safe = spark.createDataFrame([(p,) for p in protected], f"i {kind.simpleString()}")
    edges = stored(conflicts.select("i", "j").unionByName(conflicts.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct(), "conflicts")
    gone = spark.createDataFrame([], f"i {kind.simpleString()}")
    while not edges.isEmpty():
        degree = edges.groupBy("i").agg(F.count(F.lit(1)).alias("n")).join(safe.withColumn("s", F.lit(True)), "i", "left")
        rank = degree.select("i", F.when(F.col("s"), F.lit(-1)).otherwise(F.col("n")).alias("n"))
        best = edges.join(rank.select(F.col("i").alias("j"), F.col("n").alias("m")), "j").groupBy("i").agg(F.max(F.struct("m", "j")).alias("o"))
        out = stored(
            rank.join(best, "i").where((F.col("n") >= 0) & (F.struct(F.col("n").alias("m"), F.col("i").alias("j")) > F.col("o"))).select("i"), "removed"
        )
        if out.isEmpty():
            break
        gone = gone.unionByName(out)
        edges = stored(edges.join(out, "i", "left_anti").join(out.select(F.col("i").alias("j")), "j", "left_anti").select("i", "j"), "conflicts")
    return members.join(gone.select(F.col("i").alias(key)), key, "left_anti")


def covariance(confs: DataFrame, conf: str, dims: Sequence[str]) -> DataFrame:
    """Population covariance of coordinates in long form: (``i``, ``j``, ``value``) over the conformations that have both.

    ``confs`` has (conf, dims..., value); the sums of products are grouped by
    coordinate pair, so the shuffle holds coordinates squared, not rows squared.
    """
    a = confs.select(conf, F.struct(*dims).alias("i"), F.col("value").alias("u"))
    b = confs.select(conf, F.struct(*dims).alias("j"), F.col("value").alias("v"))
    return a.join(b, conf).groupBy("i", "j").agg(F.covar_pop("u", "v").alias("value"))
