"""Ensembles of structures and of models: building, signatures, masks, and comparisons of responses and stiffness.

A structure ensemble has rows (``conf``, ``atom``, x, y, z), and no row where a
member lacks an atom. An ensemble of models is mode rows (see ``networks``)
with a member column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.operators import blocks as B
from strandlake.operators import ensembles as E
from strandlake.operators import networks as W
from strandlake.operators.mapping import aligned_pairs, index_map
from strandlake.operators.models import assignment
from strandlake.operators.neighbours import AXES
from strandlake.session import workers_find_package

# ---- structures --------------------------------------------------------------


def _spelled(residues: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    letters = F.transform(F.sort_array(F.collect_list(F.struct("residue", "letter"))), lambda s: s["letter"])
    return residues.groupBy(*keys).agg(F.array_join(letters, "").alias(name))


def structure_ensemble(members: DataFrame, target: DataFrame, conf: str = "conf", least_identity: float = 94.0, least_coverage: float = 85.0, superpose: str | None = "iter") -> DataFrame:
    """(``conf``, ``atom``, ``residue``, x, y, z): members mapped onto the target by sequence, one atom a residue.

    ``members`` has (``conf``, residue, letter, x, y, z) and ``target`` the same
    without ``conf``; ``atom`` counts the target's residues from 0. A member
    stays if, of the aligned letters, ``least_identity`` per cent are equal and
    they cover ``least_coverage`` per cent of the target. ``superpose``: "iter"
    (on the mean, until it is still), "target", or None.
    """
    want = target.select("residue", "letter").distinct()
    pairs = _spelled(members, [conf], "seq_b").crossJoin(F.broadcast(_spelled(want, [], "seq_a")))  # one row, the target's sequence
    aligned = aligned_pairs(pairs)
    cells = F.arrays_zip(F.split("aligned_a", "").alias("p"), F.split("aligned_b", "").alias("q"))
    met = F.filter(cells, lambda s: ~s["p"].isin("-", "") & ~s["q"].isin("-", ""))
    same = F.size(F.filter(met, lambda s: s["p"] == s["q"]))
    fits = (100.0 * same >= least_identity * F.size(met)) & (100.0 * F.size(met) >= least_coverage * F.length("seq_a")) & (F.size(met) > 0)
    places = index_map(aligned.where(fits), [conf])
    rank = F.row_number().over(Window.partitionBy(conf).orderBy("residue")) - 1
    own = members.select(conf, "residue", *AXES, rank.alias("index_b"))
    mapped = own.join(places, [conf, "index_b"]).select(conf, F.col("index_a").alias("atom"), "residue", *AXES)
    if superpose is None:
        return mapped
    if superpose == "iter":
        return E.iteratively_superposed(mapped, conf, "atom")
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("residue")) - 1  # one structure's residues
    return E.superposed(mapped, target.select(order.alias("atom"), *AXES), conf, "atom")


def joined_ensembles(target: DataFrame, mobile: DataFrame, mapping: DataFrame, conf: str = "conf", superpose: bool = True) -> DataFrame:
    """Both ensembles' members on the target's atoms: ``mapping`` has (``atom``: of mobile, ``target``); atoms without a partner go."""
    moved = mobile.join(mapping.select("atom", "target"), "atom").select(conf, F.col("target").alias("atom"), *AXES)
    both = target.select(conf, "atom", *AXES).unionByName(moved)
    return E.iteratively_superposed(both, conf, "atom") if superpose else both


def ensemble_alignment(letters: DataFrame, conf: str = "conf") -> DataFrame:
    """(``conf``, ``seq``): a member's letters at all the atoms of the ensemble, ``-`` for those it lacks.

    ``letters`` has (``conf``, ``atom`` from 0, ``letter``); of a repeated atom
    the smallest letter counts.
    """
    each = letters.groupBy(conf, "atom").agg(F.min("letter").alias("letter"))
    last = letters.agg(F.max("atom").alias("_last"))
    held = each.groupBy(conf).agg(F.map_from_entries(F.collect_list(F.struct("atom", "letter"))).alias("_m"))
    place = F.transform(F.sequence(F.lit(0).cast(letters.schema["atom"].dataType), F.col("_last")), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit("-")))
    return held.crossJoin(F.broadcast(last)).select(conf, F.array_join(place, "").alias("seq"))


def central_conformation(confs: DataFrame, conf: str, atom: str) -> DataFrame:
    """(``conf``, ``distance2``): the member nearest the mean, ties to the first."""
    mean = E.mean_conformation(confs, atom).select(atom, *[F.col(a).alias("_m" + a) for a in AXES])
    d2 = reduce(Column.__add__, [(F.col(a) - F.col("_m" + a)) ** 2 for a in AXES])
    far = confs.join(mean, atom).groupBy(conf).agg(F.sum(d2).alias("distance2"))
    return far.orderBy("distance2", conf).limit(1)


# ---- models of members ---------------------------------------------------------


def ensemble_modes(confs: DataFrame, conf: str = "conf", atom: str = "atom", model: str = "gnm", cutoff: float | None = None, gamma: float = 1.0, keep: DataFrame | None = None, trim: str = "reduce", n_modes: int | None = 20) -> DataFrame:
    """Modes of every member, one task a member: ``model`` "gnm" or "anm".

    With ``keep`` (column ``node``) the model is confined to those atoms:
    "trim" leaves the others out, "slice" cuts the modes, "reduce" folds the
    others in.
    """
    if trim not in ("trim", "slice", "reduce"):
        raise ValueError("trim has to be trim, slice or reduce")
    if model not in ("gnm", "anm"):
        raise ValueError("model has to be gnm or anm")
    if keep is not None and trim == "trim":
        confs = confs.join(keep.select(F.col("node").alias(atom)).distinct(), atom, "left_semi")
    axes = 1 if model == "gnm" else 3
    build = W.kirchhoff if model == "gnm" else W.hessian
    matrix = build(confs, atom, cutoff or (10.0 if model == "gnm" else 15.0), gamma, (conf,))
    if keep is not None and trim == "reduce":
        matrix = W.reduced(matrix, keep, (conf,), axes)
    found = W.modes(matrix, (conf,), n_modes, axes=axes)
    return W.sliced(found, keep, keys=(conf,)) if keep is not None and trim == "slice" else found


def matched_order(modes: DataFrame, member: str, reference: object) -> DataFrame:
    """(``member``, ``mode``, ``place``, ``sign``): each member's modes dealt one to one to the reference member's, by largest overlaps."""
    workers_find_package(modes.sparkSession)
    ref = modes.where(F.col(member) == F.lit(reference)).select(F.col("mode").alias("place"), "node", "axis", F.col("v").alias("_r"))
    dots = modes.join(ref, ["node", "axis"]).groupBy(member, "mode", "place").agg(F.sum(F.col("v") * F.col("_r")).alias("overlap"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.unique(pdf["mode"]), np.unique(pdf["place"])
        m = np.zeros((len(a), len(b)))
        m[np.searchsorted(a, pdf["mode"]), np.searchsorted(b, pdf["place"])] = pdf["overlap"]
        out = pd.DataFrame([(a[i], b[j], 1.0 if m[i, j] >= 0 else -1.0) for i, j in assignment(-np.abs(m))], columns=["mode", "place", "sign"])
        out.insert(0, member, pdf[member].iloc[0])
        return out

    kind = lambda c: modes.schema[c].dataType.simpleString()
    return dots.groupBy(member).applyInPandas(deal, f"`{member}` {kind(member)}, mode {kind('mode')}, place {kind('mode')}, sign double")


def matched_modes(modes: DataFrame, member: str, reference: object) -> DataFrame:
    """Members' modes renumbered and turned as the reference member's; each keeps its eigenvalue."""
    order = matched_order(modes, member, reference)
    return modes.join(order, [member, "mode"]).withColumns({"mode": F.col("place"), "v": F.col("v") * F.col("sign")}).select(*modes.columns)


def reweighted(modes: DataFrame, member: str) -> DataFrame:
    """Eigenvalues (and variances) of each member dealt anew in rising order over the matched numbers."""
    each = modes.select(member, "mode", "eigval", "variance").distinct()
    place = each.withColumn("_k", F.row_number().over(Window.partitionBy(member).orderBy("mode"))).select(member, "mode", "_k")
    value = each.withColumn("_k", F.row_number().over(Window.partitionBy(member).orderBy("eigval"))).select(member, "_k", "eigval", "variance")
    new = place.join(value, [member, "_k"]).drop("_k")
    return modes.drop("eigval", "variance").join(new, [member, "mode"]).select(*modes.columns)


def signature_modes(modes: DataFrame, member: str) -> DataFrame:
    """The model of mean eigenvectors and mean eigenvalues over the members."""
    values = modes.select(member, "mode", "eigval").distinct().groupBy("mode").agg(F.avg("eigval").alias("eigval"))
    vectors = modes.groupBy("mode", "node", "axis").agg(F.avg("v").alias("v"))
    variance = F.when(F.abs("eigval") > W.ZERO, 1 / F.col("eigval")).otherwise(0.0)
    return vectors.join(values, "mode").select("mode", "eigval", variance.alias("variance"), "node", "axis", "v")


def signature_overlaps(modes: DataFrame, member: str, diagonal: bool = True, reference: DataFrame | None = None) -> DataFrame:
    """(``a``, ``b``, ``mode_a``, ``mode_b``, ``overlap``): absolute overlaps between the members' modes, or with a reference model (``b`` null).

    ``diagonal`` keeps modes of equal number. Sums run per pair of modes over
    shared nodes, joined on node and axis (and mode, on the diagonal).
    """
    unit = lambda m, keys: m.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") ** 2).over(Window.partitionBy(*keys))))
    left = unit(modes, [member, "mode"])
    right = left if reference is None else unit(reference.withColumn(member, F.lit(None).cast(modes.schema[member].dataType)), ["mode"])
    u = left.select(F.col(member).alias("a"), F.col("mode").alias("mode_a"), "node", "axis", F.col("v").alias("u"))
    w = right.select(F.col(member).alias("b"), F.col("mode").alias("mode_b"), "node", "axis", F.col("v").alias("w"))
    if diagonal:
        both = u.withColumn("mode_b", F.col("mode_a")).join(w, ["mode_b", "node", "axis"])
    else:
        both = u.join(w, ["node", "axis"])
    return both.groupBy("a", "b", "mode_a", "mode_b").agg(F.abs(F.sum(F.col("u") * F.col("w"))).alias("overlap"))


# ---- given modes, masks --------------------------------------------------------


def modes_from_vectors(pairs: DataFrame, axes: int = 1) -> DataFrame:
    """Mode rows of (``eigval``, ``vector``) pairs, numbered by rising eigenvalue; with three axes a node has x, y, z in turn."""
    numbered = pairs.withColumn("mode", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("eigval", "vector")) - 1).cast("int"))  # one model's modes
    each = numbered.select("mode", F.col("eigval").cast("double").alias("eigval"), F.posexplode("vector").alias("_k", "v"))
    variance = F.when(F.abs("eigval") > W.ZERO, 1 / F.col("eigval")).otherwise(0.0)
    node, axis = F.floor(F.col("_k") / axes).cast("int"), (F.col("_k") % axes).cast("int")
    return each.select("mode", "eigval", variance.alias("variance"), node.alias("node"), axis.alias("axis"), F.col("v").cast("double").alias("v"))


def with_eigenpair(modes: DataFrame, eigval: float, vector: Sequence[float], axes: int = 1) -> DataFrame:
    """One more mode after the last; a vector of another length than the model's is an error."""
    last, n = modes.agg(F.max("mode"), F.countDistinct("node", "axis")).first()
    if n not in (0, len(vector)):
        raise ValueError(f"the vector has {len(vector)} values, the model {n}")
    pair = modes.sparkSession.createDataFrame([(float(eigval), [float(x) for x in vector])], "eigval double, vector array<double>")
    one = modes_from_vectors(pair, axes).withColumn("mode", F.lit(0 if last is None else last + 1))
    return modes.unionByName(one.select(*[F.col(c).cast(modes.schema[c].dataType) for c in modes.columns]))


def masked(matrix: DataFrame, keep: DataFrame) -> DataFrame:
    """The part of a matrix between kept nodes (column ``node``)."""
    k = keep.select("node").distinct()
    return matrix.join(k.withColumnRenamed("node", "i"), "i", "left_semi").join(k.withColumnRenamed("node", "j"), "j", "left_semi").select(*matrix.columns)


def unmasked(modes: DataFrame, nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Modes of masked models on all nodes (column ``node``): zero at those the mask left out."""
    every = modes.select(*keys, "mode", "eigval", "variance", "axis").distinct().crossJoin(nodes.select("node").distinct())  # modes x nodes is the result's own size
    held = modes.select(*keys, "mode", "axis", "node", "v")
    return every.join(held, [*keys, "mode", "axis", "node"], "left").withColumn("v", F.coalesce("v", F.lit(0.0))).select(*modes.columns)


# ---- comparisons ---------------------------------------------------------------


def square_inner_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(``value``): (a.b)^2 / (a.a b.b) of two fluctuation profiles (``node``, ``sqfluct``)."""
    both = a.select("node", F.col("sqfluct").alias("u")).join(b.select("node", F.col("sqfluct").alias("w")), "node")
    return both.agg((F.sum(F.col("u") * F.col("w")) ** 2 / (F.sum(F.col("u") ** 2) * F.sum(F.col("w") ** 2))).alias("value"))


def response_profile(responses: DataFrame, target: DataFrame, stat: str = "max") -> DataFrame:
    """(``perturbed``, ``value``): how well forces on a node drive motion like the target's modes.

    ``responses`` has (``perturbed``, ``force``, node, axis, v). For each force
    the target mode of the largest absolute overlap counts; ``stat`` (max, mean
    or sum) joins the forces of a node. Blocks of forces and of modes are
    multiplied, and each hands on one overlap a force.
    """
    if stat not in ("max", "mean", "sum"):
        raise ValueError("stat has to be max, mean or sum")
    kind = lambda c: responses.schema[c].dataType.simpleString()

    def work(x, y, _):
        best = []
        for rows in B.stretches(x, y):
            d, shared, valued = B.products(x, y, rows)
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.abs(d / (x.sizes[rows, None] * y.sizes))
            for seen in (shared, valued):
                if seen is not None:
                    d[~seen] = -1.0
            best.append(d.max(axis=1))
        o = np.concatenate(best)
        some = pa.array(o != -1.0)
        yield pa.RecordBatch.from_arrays([*[k.filter(some) for k in x.keys.values()], pa.array(o).filter(some)], ["perturbed", "force", "o"])

    forces = ["perturbed", "force"]
    found = B.block_pairs(B.packed(responses, forces), forces, B.packed(target, ["mode"]), ["mode"], 8192, 8192, work, f"perturbed {kind('perturbed')}, force {kind('force')}, o double")
    best = found.groupBy("perturbed", "force").agg(F.max("o").alias("o"))
    return best.groupBy("perturbed").agg({"max": F.max, "mean": F.avg, "sum": F.sum}[stat]("o").alias("value"))


def stiffness_range(stiffness: DataFrame) -> DataFrame:
    """(``least``, ``most``): the smallest and the largest constant; zeros do not count as smallest."""
    return stiffness.agg(F.min(F.when(F.col("stiffness") != 0, F.col("stiffness"))).alias("least"), F.max("stiffness").alias("most"))


def stiffness_count(stiffness: DataFrame, low: float, high: float, gap: int = 0) -> DataFrame:
    """(``n``): pairs more than ``gap`` apart with a constant strictly between; with a gap the last node is left out."""
    pairs = stiffness.select(F.greatest("i", "j").alias("far"), F.abs(F.col("i") - F.col("j")).alias("apart"), "stiffness").where(F.col("apart") > gap)
    if gap:
        last = stiffness.agg(F.max(F.greatest("i", "j")).alias("_last"))
        pairs = pairs.crossJoin(F.broadcast(last)).where("far < _last")
    return pairs.agg(F.sum(((F.col("stiffness") > low) & (F.col("stiffness") < high)).cast("long")).alias("n")).select(F.coalesce("n", F.lit(0)).alias("n"))


def stiffness_extreme(stiffness: DataFrame, largest: bool, gap: int = 20) -> DataFrame:
    """(``i``, ``j``, ``stiffness``): the largest or the smallest non-zero constant of nodes ``gap`` apart or more; ties to the first pair."""
    far = stiffness.where((F.abs(F.col("i") - F.col("j")) >= gap) & (F.col("stiffness") != 0))
    return far.select("i", "j", "stiffness").orderBy(F.desc("stiffness") if largest else F.asc("stiffness"), "i", "j").limit(1)
