"""Queries for slices and joins of alignments, ordered rows, and tables of interactions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.atom_queries import ATOMS, atoms
from strandlake.operators import alignments as A
from strandlake.operators import interactions as I
from strandlake.operators import matrices as M
from strandlake.operators import records as R
from strandlake.queries import FLOW, MSA, SMALL, alignment, contact_map, query, r6, small_alignment, table

# ---- alignments ------------------------------------------------------------------

SMALLER = SMALL.replace("msa AS", "msa2 AS").replace("cells AS", "cells2 AS").replace("FROM msa,", "FROM msa2,")


@query(
    f"""WITH {MSA}, {SMALLER} SELECT seq_idx, seq FROM msa
    UNION ALL SELECT seq_idx - (SELECT min(seq_idx) FROM msa2) + (SELECT max(seq_idx) + 1 FROM msa), seq FROM msa2"""
)
def stacked_alignments(spark, d):
    return A.stacked(alignment(spark, d), small_alignment(spark, d))


@query(f"WITH {MSA} SELECT seq_idx, seq[2] || seq[4] || seq[6] || seq[8] AS seq FROM msa WHERE seq_idx >= 2 AND (seq_idx - 2) % 3 = 0")
def alignment_slices(spark, d):
    return A.picked(alignment(spark, d), slice(2, None, 3), slice(1, 9, 2))


@query(f"WITH {MSA} SELECT seq_idx, seq[9] || seq[1] AS seq FROM msa")
def alignment_columns(spark, d):
    return A.picked(alignment(spark, d), None, [8, 0])


@query(f"WITH {MSA}, l AS (SELECT seq[8] || '_x' || (seq_idx % 5) AS name, seq_idx, seq FROM msa), h AS (SELECT * FROM l WHERE contains(name, '_x3')) SELECT seq_idx, name FROM h WHERE name = (SELECT arg_min(name, seq_idx) FROM h)")
def label_rows(spark, d):
    """Rows of the first label that holds a text that is no whole label."""
    label = F.concat(F.substring("seq", 8, 1), F.lit("_x"), (F.col("seq_idx") % 5).cast("string"), F.lit("/1-9"))
    return A.rows_of(alignment(spark, d).withColumn("label", label), "_x3").select("seq_idx", F.split("label", "/")[0].alias("name"))


@query(None)
def sparse_coupling(spark, d):
    return A.sparse_coupling(small_alignment(spark, d)).where("i < j").select("i", "j", r6("value").alias("value"))


# ---- rows in order -----------------------------------------------------------------


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey DESC) - 1 AS position FROM part")
def sorted_atoms(spark, d):
    return R.in_order(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", reverse=True).select("p_partkey", "position")


@query("SELECT p_partkey FROM part WHERE p_partkey >= 20 AND p_partkey < 150 AND (p_partkey - 20) % 4 = 0")
def atoms_by_serial(spark, d):
    return R.by_serial(table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("serial")), 20, 150, 4).select("p_partkey")


@query(
    """WITH s AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - o_orderkey AS gap FROM orders),
    n AS (SELECT o_custkey, gap, count(*) AS n FROM s WHERE gap IS NOT NULL GROUP BY 1, 2),
    u AS (SELECT o_custkey, gap AS usual FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, gap) AS k FROM n) WHERE k = 1)
    SELECT o_custkey, o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_custkey, o_orderkey + usual, NULL FROM s JOIN u USING (o_custkey) WHERE gap <> usual"""
)
def series_with_ends(spark, d):
    """Order keys as a customer's series."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.with_ends(o, "o_orderkey", ["o_totalprice"], ["o_custkey"])


# ---- interactions --------------------------------------------------------------------


@query(f"WITH {ATOMS} SELECT DISTINCT chain, resname, resnum FROM atoms WHERE name = 'CA' AND resname = 'ZN'")
def nonstandard_residues(spark, d):
    return I.nonstandard_residues(atoms(spark, d))


@query("SELECT l_suppkey AS residue, count(DISTINCT l_orderkey) AS frames FROM lineitem GROUP BY 1")
def bridging_histogram(spark, d):
    """Orders as frames, suppliers as residues."""
    return I.bridging_histogram(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_suppkey").alias("residue")))


@query("SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1 HAVING count(*) >= 3")
def structures_with_water(spark, d):
    return I.structures_with_water(table(spark, d, "lineitem"), "l_orderkey", F.col("l_returnflag") == "N", 3)


@query(
    """WITH e AS (SELECT substr(p_name, 1, 3) AS a, substr(p_type, 1, 3) AS b, max(p_size)::DOUBLE AS energy FROM part GROUP BY 1, 2)
    SELECT x.p_partkey, energy FROM part x LEFT JOIN e ON a = substr(x.p_name, 1, 3) AND b = substr(x.p_type, 1, 3)"""
)
def pair_energies(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.substring("p_name", 1, 3).alias("resname1"), F.substring("p_type", 1, 3).alias("resname2"), "p_size")
    energies = p.groupBy(F.col("resname1").alias("first"), F.col("resname2").alias("second")).agg(F.max("p_size").alias("solvated"))
    return I.pair_energies(p, energies, "solvated").select("p_partkey", "energy")


@query(
    """SELECT n1.n_name AS residue_i, n2.n_name AS residue_j, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON s_suppkey = l_suppkey JOIN nation n1 ON n1.n_nationkey = c_nationkey JOIN nation n2 ON n2.n_nationkey = s_nationkey GROUP BY 1, 2"""
)
def bridge_info(spark, d):
    """Counts between customers' and suppliers' nations, under the nations' names."""
    c, o, li, s, n = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "supplier", "nation"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    stats = rows.groupBy(F.col("c_nationkey").alias("i"), F.col("s_nationkey").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    return I.bridge_info(stats, n.select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("residue")))


# ---- matrices ------------------------------------------------------------------------

ORDER = "o AS (SELECT n_nationkey AS node, row_number() OVER (ORDER BY n_name DESC) - 1 AS place FROM nation)"


@query(f"WITH {FLOW}, {ORDER} SELECT x.place::INT AS i, y.place::INT AS j, round(value, 6) + 0.0 AS value FROM m JOIN o x ON x.node = m.i JOIN o y ON y.node = m.j")
def reordered_matrix(spark, d):
    """The contact map in the reverse order of the nations' names."""
    place = F.row_number().over(M.Window.orderBy(F.desc("n_name"))) - 1
    order = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), place.alias("place"))
    return M.reordered(contact_map(spark, d), order).select("i", "j", r6("value").alias("value"))


@query(
    """WITH s AS (SELECT s_nationkey AS k, s_suppkey, abs(s_acctbal - lag(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) > 2500 AS far FROM supplier)
    SELECT s_suppkey, (1 + coalesce(sum(far::INT) OVER (PARTITION BY k ORDER BY s_suppkey), 0))::INT AS subgroup FROM s"""
)
def tree_subgroups(spark, d):
    """A nation's suppliers in the order of their keys as leaves, account balances as places in the tree."""
    s = table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("node"), "s_acctbal")
    leaves = s.select("s_nationkey", "node", F.col("node").alias("place"))
    step = F.lead("node").over(M.Window.partitionBy("s_nationkey").orderBy("node"))
    gap = F.abs(F.lead("s_acctbal").over(M.Window.partitionBy("s_nationkey").orderBy("node")) - F.col("s_acctbal"))
    distances = s.select("s_nationkey", F.col("node").alias("i"), step.alias("j"), gap.cast("double").alias("value")).where("j is not null")
    return M.subgroups(leaves, distances, 2500.0, ("s_nationkey",)).select(F.col("node").alias("s_suppkey"), "subgroup")
