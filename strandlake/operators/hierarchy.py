"""Residue, chain and segment indices by first appearance, and one-letter sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.functions import vocabulary as V


def first_appearance(atoms: DataFrame, key: Sequence[str], order: str, name: str, scope: Sequence[str] = ()) -> DataFrame:
    """Groups of ``key`` numbered from 0 by the smallest ``order`` among their rows.

    A group that comes back later keeps its number. Only one row a group is
    ranked; ``scope`` starts the numbers anew.
    """
    first = atoms.groupBy(*scope, *key).agg(F.min(order).alias("_first"))
    by = (Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0))).orderBy("_first")
    ranked = first.withColumn(name, (F.row_number().over(by) - 1).cast("long")).drop("_first")
    renamed = ranked.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate((*scope, *key))], name)
    on = [atoms[c].eqNullSafe(renamed[f"_k{i}"]) for i, c in enumerate((*scope, *key))]
    return atoms.join(renamed, on).drop(*[f"_k{i}" for i in range(len(scope) + len(key))])


def indexed(atoms: DataFrame, order: str = "atom_index", scope: Sequence[str] = ()) -> DataFrame:
    """Adds ``segindex``, ``chindex`` and ``resindex``."""
    out = first_appearance(atoms, ("segment",), order, "segindex", scope)
    out = first_appearance(out, ("segment", "chain"), order, "chindex", scope)
    return first_appearance(out, ("segment", "chain", "resnum", "icode"), order, "resindex", scope)


def sequences(atoms: DataFrame, chain: Sequence[str], residue: str = "resindex", resname: str = "resname") -> DataFrame:
    """(chain, ``sequence``): one letter a residue in order, X for what is no standard residue."""
    letter = F.coalesce(F.create_map(*[F.lit(x) for kv in V.ONE_LETTER.items() for x in kv])[F.col(resname)], F.lit("X"))
    each = atoms.select(*chain, residue, letter.alias("_l")).distinct()
    return each.groupBy(*chain).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(residue, "_l"))), lambda s: s["_l"]), "").alias("sequence"))


def secondary_structure(atoms: DataFrame, ranges: DataFrame, key: Sequence[str] = ("chain", "resnum", "icode"), coil: bool = True) -> DataFrame:
    """Codes of listed residues (key..., ``code``) as ``secondary``; others C, or empty."""
    out = atoms.drop("secondary").join(ranges.select(*key, F.col("code").alias("secondary")), list(key), "left")
    return out.withColumn("secondary", F.coalesce("secondary", F.lit("C" if coil else "")))


def assemblies(atoms: DataFrame, transforms: DataFrame, chain: str = "chain") -> DataFrame:
    """Chains copied through assembly transforms (``biomol``, ``chain``, ``copy``, ``rotation`` of 9, ``shift`` of 3)."""
    joined = atoms.join(transforms, chain)
    at = lambda i: sum((F.col("rotation")[3 * i + k] * F.col(c) for k, c in enumerate("xyz")), F.col("shift")[i])
    return joined.withColumns({c: at(i) for i, c in enumerate("xyz")}).drop("rotation", "shift")


def matched_chains(a: DataFrame, b: DataFrame, least_identity: float = 90.0, least_coverage: float = 90.0) -> DataFrame:
    """Chain pairs by residue number and insertion code: (``chain_a``, ``chain_b``, ``identity``, ``coverage``).

    Identity is equal names over the shorter chain, coverage the matched
    residues over the longer, both in percent.
    """
    of = lambda t, n: t.select(F.col("chain").alias(f"chain_{n}"), "resnum", F.coalesce("icode", F.lit("")).alias("icode"), F.col("resname").alias(f"r{n}")).distinct()
    ra, rb = of(a, "a"), of(b, "b")
    na, nb = (t.groupBy(f"chain_{n}").agg(F.count(F.lit(1)).alias(f"n{n}")) for t, n in ((ra, "a"), (rb, "b")))
    both = ra.join(rb, ["resnum", "icode"]).groupBy("chain_a", "chain_b").agg(F.count(F.lit(1)).alias("m"), F.sum((F.col("ra") == F.col("rb")).cast("long")).alias("s"))
    full = both.join(na, "chain_a").join(nb, "chain_b")
    out = full.select("chain_a", "chain_b", (100.0 * F.col("s") / F.least("na", "nb")).alias("identity"), (100.0 * F.col("m") / F.greatest("na", "nb")).alias("coverage"))
    return out.where((F.col("identity") >= least_identity) & (F.col("coverage") >= least_coverage))
