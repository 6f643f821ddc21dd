"""Command line: ``python -m strandlake.cli APP ...``; results are written as CSV folders or shown."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import selection as S
from strandlake.operators import alignments as A
from strandlake.operators import ensembles as E
from strandlake.operators import hierarchy as H
from strandlake.operators import networks as W
from strandlake.operators.neighbours import points_near
from strandlake.plans.iteration import stored
from strandlake.session import local_session
from strandlake.sources import matrices as X
from strandlake.sources import sequences as Q
from strandlake.sources import structures as T


def _atoms(spark: SparkSession, path: str) -> DataFrame:
    read = T.read_mmcif if path.endswith(".cif") else T.read_pdb
    return stored(H.indexed(read(spark, path).where("cset = 0"), scope=("structure_id",)), "atoms")


def _selected(atoms: DataFrame, text: str) -> DataFrame:
    return S.select(S.AtomTable(atoms, ("atom_index",), ("structure_id",)), text)


def _modes(spark: SparkSession, a: argparse.Namespace, three: bool) -> DataFrame:
    nodes = _selected(_atoms(spark, a.file), a.select)
    build = W.hessian if three else W.kirchhoff
    return W.modes(build(nodes, "atom_index", a.cutoff, a.gamma), n_modes=a.modes, axes=3 if three else 1)


def _msa(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return stored(Q.read_msa(spark, a.file, a.format), "msa")


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.app == "select":
        return _selected(_atoms(spark, a.file), a.select).drop("anisou")
    if a.app == "contacts":
        atoms = _atoms(spark, a.file)
        return points_near(atoms, _selected(atoms, a.target), a.radius, ("structure_id",)).drop("anisou")
    if a.app == "align":
        ref, mobile = (_selected(_atoms(spark, f), a.select).select(F.lit(k).alias("conf"), F.row_number().over(_by_index()).alias("atom"), "x", "y", "z") for k, f in enumerate((a.file, a.mobile)))
        return E.rmsd_to_reference(E.superposed(mobile, ref, "conf", "atom"), ref, "conf", "atom")
    if a.app in ("gnm", "anm"):
        return _modes(spark, a, a.app == "anm")
    if a.app in ("pca", "eda"):
        frames = X.read_dcd(spark, a.file).select(F.flatten("xyz").alias("v"))
        return W.principal_components(frames, "v", n_modes=a.modes)
    if a.app == "catdcd":
        return X.frame_atoms(X.read_dcd(spark, a.file, a.first, a.last, a.stride))
    msa = _msa(spark, a)
    cells = A.cells(msa)
    if a.app == "occupancy":
        return A.occupancy(cells, "seq_idx" if a.rows else "col")
    if a.app == "conserv":
        return A.column_entropy(cells)
    if a.app == "coevol":
        return A.corrected_mi(A.mutual_information(cells))
    if a.app == "rankorder":
        return A.ranked(A.mutual_information(cells), "mi", a.zscore)
    if a.app == "refine":
        return A.refined(msa, a.label, a.rowocc, a.seqid, a.colocc)
    if a.app == "filter":
        return msa.where(F.col("label").rlike(a.pattern))
    return A.merged(msa, Q.read_msa(spark, a.other, a.format))


def _by_index():
    from pyspark.sql.window import Window

    return Window.partitionBy("structure_id").orderBy("atom_index")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlake", description=__doc__)
    p.add_argument("--out", help="folder for the result as CSV; shown if absent")
    apps = p.add_subparsers(dest="app", required=True)

    def app(name: str, **options) -> None:
        one = apps.add_parser(name)
        one.add_argument("file")
        for key, value in options.items():
            if isinstance(value, bool):
                one.add_argument(f"--{key}", action="store_true")
            else:
                one.add_argument(f"--{key}", default=value, type=type(value) if value is not None else str)

    app("select", select="all")
    app("contacts", target="all", radius=4.0)
    app("align", mobile=None, select="calpha")
    app("gnm", select="calpha", cutoff=10.0, gamma=1.0, modes=10)
    app("anm", select="calpha", cutoff=15.0, gamma=1.0, modes=10)
    for name in ("pca", "eda"):
        app(name, modes=10)
    one = apps.add_parser("catdcd")
    one.add_argument("file")
    for key, value in (("first", 0), ("last", None), ("stride", 1)):
        one.add_argument(f"--{key}", default=value, type=int)
    app("occupancy", format="fasta", rows=False)
    app("conserv", format="fasta")
    app("coevol", format="fasta")
    app("rankorder", format="fasta", zscore=False)
    app("filter", format="fasta", pattern=".")
    app("merge", format="fasta", other=None)
    one = apps.add_parser("refine")
    one.add_argument("file")
    one.add_argument("--format", default="fasta")
    one.add_argument("--label")
    for key in ("rowocc", "seqid", "colocc"):
        one.add_argument(f"--{key}", type=float)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    out = run(spark or local_session(), a)
    if a.out:
        flat = [c for c, t in out.dtypes if not t.startswith(("array", "map", "struct"))]
        out.select(*flat).write.option("header", "true").csv(a.out)
    else:
        out.show(50, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
