"""Further operators over the same bindings, with their SQL: comparisons of modes, geometry, alignments, maps, codes, ways and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.atom_queries import ATOMS, COVARIANCE, MODES, _written, atoms, embedding_modes, part_dag
from strandlake.ensemble_queries import MEMBERS, member_modes
from strandlake.operators import alignments as A
from strandlake.operators import channels as C
from strandlake.operators import geometry as G
from strandlake.operators import hierarchy as H
from strandlake.operators import interactions as I
from strandlake.operators import matrices as M
from strandlake.operators import models as L
from strandlake.operators import neighbours as N
from strandlake.operators import networks as W
from strandlake.operators import records as R
from strandlake.operators import signatures as S
from strandlake.operators import surfaces as U
from strandlake.queries import FLOW, MSA, PART, alignment, contact_map, points, query, r6, rounded, table
from strandlake.sources import exchange as X
from strandlake.table_queries import SMALLER, small_alignment

# ---- comparisons of two models -------------------------------------------------------

BOTH = f"""{MEMBERS}, half AS (SELECT (label >= 5)::INT AS h, mode, node, avg(v) AS v FROM members GROUP BY 1, 2, 3),
  var AS (SELECT h, mode, 1 / avg(eigval) AS s FROM (SELECT DISTINCT (label >= 5)::INT AS h, label, mode, eigval FROM members) GROUP BY 1, 2),
  unit AS (SELECT h, mode, node, v / sqrt(sum(v ^ 2) OVER (PARTITION BY h, mode)) AS v FROM half),
  o AS (SELECT a.mode AS ma, b.mode AS mb, sum(a.v * b.v) AS o FROM unit a JOIN unit b ON a.h = 0 AND b.h = 1 AND a.node = b.node GROUP BY 1, 2),
  so AS (SELECT o.*, x.s AS sa, y.s AS sb FROM o JOIN var x ON x.h = 0 AND x.mode = ma JOIN var y ON y.h = 1 AND y.mode = mb)"""


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The mean models of the labels below 5 and of the others."""
    m = member_modes(spark, d)
    return S.signature_modes(m.where("label < 5"), "label"), S.signature_modes(m.where("label >= 5"), "label")


@query(f"WITH {BOTH} SELECT ma::INT AS mode_a, mb::INT AS mode_b, round(o, 6) + 0.0 AS overlap FROM o")
def overlap_matrix(spark, d):
    return W.overlaps(*halves(spark, d)).select("mode_a", "mode_b", r6("overlap").alias("overlap"))


@query(f"WITH {BOTH} SELECT ma::INT AS mode_a, mb::INT AS mode_b, round(sqrt(sum(o ^ 2) OVER (PARTITION BY ma ORDER BY mb)), 6) + 0.0 AS cumulative FROM o")
def cumulative_overlaps(spark, d):
    return W.cumulative_overlaps(*halves(spark, d)).select("mode_a", "mode_b", r6("cumulative").alias("cumulative"))


@query(f"WITH {BOTH} SELECT round(sqrt(sum(o ^ 2) / count(DISTINCT ma)), 6) + 0.0 AS rmsip FROM o")
def subspace_overlap(spark, d):
    return W.subspace_overlap(W.overlaps(*halves(spark, d))).select(r6("rmsip").alias("rmsip"))


@query(f"WITH {BOTH} SELECT round(sqrt(sum(sa * sb * o ^ 2) / sum(CASE WHEN ma = mb THEN sa * sb END)), 6) + 0.0 AS rwsip FROM so")
def weighted_inner_product(spark, d):
    return W.weighted_inner_product(*halves(spark, d)).select(r6("rwsip").alias("rwsip"))


@query(f"WITH {BOTH}, t AS (SELECT sum(s) AS t FROM var) SELECT round(1 - sqrt(greatest(0, (SELECT t FROM t) - 2 * sum(sqrt(sa * sb) * o ^ 2)) / (SELECT t FROM t)), 6) + 0.0 AS overlap FROM so")
def spectral_overlap(spark, d):
    return W.spectral_overlap(*halves(spark, d)).select(r6("overlap").alias("overlap"))


@query(
    f"""WITH {BOTH}, l AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS node, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT node, avg(v) AS m FROM l GROUP BY 1)
    SELECT vec_id, h.mode::INT AS mode, round(sum((l.v - c.m) * h.v) / sqrt(count(*)), 6) + 0.0 AS projection FROM l JOIN c USING (node) JOIN half h ON h.h = 0 AND h.node = l.node GROUP BY 1, 2"""
)
def mode_projections(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("node", "value")).select("vec_id", "node", F.lit(0).alias("axis"), F.col("value").cast("double").alias("value"))
    mean = e.groupBy("node", "axis").agg(F.avg("value").alias("value"))
    return W.projections(e, mean, halves(spark, d)[0], "vec_id").select("vec_id", "mode", r6("projection").alias("projection"))


@query(
    f"""WITH {MODES}, f AS (SELECT node, sum(v ^ 2 / eigval) AS w, 10 + node % 7 AS b FROM modes GROUP BY 1)
    SELECT node::INT AS node, round(w * (SELECT sum(b) / sum(w) FROM f), 6) + 0.0 AS beta FROM f"""
)
def temperature_factors(spark, d):
    fluct = W.square_fluctuations(embedding_modes(spark, d))
    return W.temperature_factors(fluct, fluct.select("node", (10.0 + F.col("node") % 7).alias("beta"))).select("node", r6("beta").alias("beta"))


@query(
    """WITH s AS (SELECT vec_id AS mode, 1.0 / (1.0 + vec_id % 7) AS s FROM embeddings),
    c AS (SELECT mode, sum(s) OVER (ORDER BY mode) - s AS before, sum(s) OVER () AS total FROM s) SELECT mode FROM c WHERE before / total < 0.33 - 1e-9"""
)
def covering_modes(spark, d):
    return W.modes_covering(embedding_modes(spark, d), 0.33 - 1e-9).select("mode").distinct()


@query(f"WITH {COVARIANCE} SELECT c.i::INT AS i, c.j::INT AS j, round(exp(-1 * (x.value + y.value - 2 * c.value) ^ 2 / 5000), 6) + 0.0 AS value FROM c JOIN c x ON x.i = c.i AND x.j = c.i JOIN c y ON y.i = c.j AND y.j = c.j")
def fluctuation_similarity(spark, d):
    return M.gaussian_similarity(W.distance_fluctuations(W.covariance_of(embedding_modes(spark, d))), 50.0).select("i", "j", r6("value").alias("value"))


@query(
    """WITH l AS (SELECT vec_id % 5 AS mode, vec_id // 5 AS node, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, 1.0 / (1 + vec_id % 5) AS s FROM embeddings)
    SELECT node, round(sum(a * a * s), 6) + 0.0 AS u11, round(sum(b * b * s), 6) + 0.0 AS u22, round(sum(c * c * s), 6) + 0.0 AS u33,
      round(sum(a * b * s), 6) + 0.0 AS u12, round(sum(a * c * s), 6) + 0.0 AS u13, round(sum(b * c * s), 6) + 0.0 AS u23 FROM l GROUP BY 1"""
)
def anisotropic_factors(spark, d):
    """Five modes over every five vectors as a node, from the vectors' first three values."""
    e = table(spark, d, "embeddings")
    m = (F.col("vec_id") % 5).cast("int")
    node = F.floor(F.col("vec_id") / 5).alias("node")
    long = e.select(m.alias("mode"), node, (1.0 / (1 + m)).alias("variance"), F.posexplode(F.slice("embedding", 1, 3)).alias("axis", "v")).withColumn("v", F.col("v").cast("double"))
    cells = ("u11", "u22", "u33", "u12", "u13", "u23")
    return L.anisotropic_factors(long).select("node", *[r6(F.col("anisou")[k]).alias(c) for k, c in enumerate(cells)])


# ---- geometry --------------------------------------------------------------------------


@query(f"WITH p AS ({PART}) SELECT p_brand, min(x) - 2 AS x_min, min(y) - 2 AS y_min, min(z) - 2 AS z_min, max(x) + 2 AS x_max, max(y) + 2 AS y_max, max(z) + 2 AS z_max FROM p GROUP BY 1")
def bounding_boxes(spark, d):
    return G.bounding_box(points(spark, d), ("p_brand",), 2.0)


@query(f"WITH p AS ({PART}) SELECT a.p_partkey, round(b.x - a.x, 6) + 0.0 AS dx, round(b.y - a.y, 6) + 0.0 AS dy, round(b.z - a.z, 6) + 0.0 AS dz FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1")
def deformation_vectors(spark, d):
    """From each part's place to the next one's."""
    p = points(spark, d)
    return G.deformation(p, p.withColumn("p_partkey", F.col("p_partkey") - 1), "p_partkey").select("p_partkey", *[r6("d" + a).alias("d" + a) for a in "xyz"])


@query(f"WITH p AS ({PART}) SELECT p_partkey, round(x - avg(x) OVER w + 1, 6) + 0.0 AS x, round(y - avg(y) OVER w + 2, 6) + 0.0 AS y, round(z - avg(z) OVER w + 3, 6) + 0.0 AS z FROM p WINDOW w AS (PARTITION BY p_brand)")
def moved_atoms(spark, d):
    return G.move(points(spark, d), to=(1, 2, 3), keys=("p_brand",)).select("p_partkey", *[r6(a).alias(a) for a in "xyz"])


@query(f"WITH p AS ({PART}) SELECT p_partkey, round(0.6 * x - 0.8 * y + 1, 6) + 0.0 AS x, round(0.8 * x + 0.6 * y - 2, 6) + 0.0 AS y, z + 3 AS z FROM p")
def transformed_atoms(spark, d):
    turned = G.transformed(tuple(F.col(a) for a in "xyz"), ((0.6, -0.8, 0), (0.8, 0.6, 0), (0, 0, 1)), (1, -2, 3))
    return points(spark, d).select("p_partkey", *[r6(c).alias(a) for a, c in zip("xyz", turned)])


NEXT = f"p AS ({PART}), q AS (SELECT a.p_partkey, " + ", ".join(f"{t}.{c} AS {t}_{c}" for t in "abc" for c in "xyz") + " FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1 JOIN p c ON c.p_partkey = a.p_partkey + 2)"


@query(
    f"""WITH {NEXT}, n AS (SELECT *, (b_y - a_y) * (c_z - a_z) - (b_z - a_z) * (c_y - a_y) AS nx, (b_z - a_z) * (c_x - a_x) - (b_x - a_x) * (c_z - a_z) AS ny, (b_x - a_x) * (c_y - a_y) - (b_y - a_y) * (c_x - a_x) AS nz FROM q)
    SELECT p_partkey, round(nx, 4) + 0.0 AS nx, round(ny, 4) + 0.0 AS ny, round(nz, 4) + 0.0 AS nz, round(nx * a_x + ny * a_y + nz * a_z, 4) + 0.0 AS shift FROM n"""
)
def atom_planes(spark, d):
    """Planes through each part and the next two."""
    p = points(spark, d)
    step = lambda t, k: p.select((F.col("p_partkey") - k).alias("p_partkey"), *[F.col(c).alias(t + c) for c in "xyz"])
    three = step("a", 0).join(step("b", 1), "p_partkey").join(step("c", 2), "p_partkey")
    n, shift = G.plane([tuple(F.col(t + c) for c in "xyz") for t in "abc"])
    return three.select("p_partkey", *[rounded(c, 4).alias("n" + a) for a, c in zip("xyz", n)], rounded(shift, 4).alias("shift"))


@query(
    f"""WITH p AS ({PART}) SELECT DISTINCT a.p_partkey FROM p a JOIN p b ON b.p_partkey % 50 = 7 AND (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2 <= 64"""
)
def atoms_near_points(spark, d):
    """Parts within 8 of the parts whose key leaves 7 over 50."""
    p = points(spark, d)
    return N.points_near(p, p.where("p_partkey % 50 = 7"), 8.0).select("p_partkey")


@query(f"WITH p AS ({PART}) SELECT p_partkey, round(c * x - s * y + k, 6) + 0.0 AS x, round(s * x + c * y, 6) + 0.0 AS y, z AS z, k AS copy FROM p, (VALUES (0, 1.0, 0.0), (1, 0.0, 1.0)) t(k, c, s)")
def assembly_copies(spark, d):
    """Each brand as a chain, copied as it is and turned by a right angle."""
    brands = table(spark, d, "part").select("p_brand").distinct()
    turns = F.array(*[F.struct(F.lit(k).alias("copy"), F.array(*map(F.lit, r)).alias("rotation"), F.array(F.lit(float(k)), F.lit(0.0), F.lit(0.0)).alias("shift")) for k, r in ((0, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)), (1, (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)))])
    transforms = brands.select("p_brand", F.explode(turns).alias("t")).select("p_brand", "t.*")
    return H.assemblies(points(spark, d), transforms, "p_brand").select("p_partkey", *[r6(a).alias(a) for a in "xyz"], "copy")


@query(f"WITH {ATOMS} SELECT atom_index, CASE resname WHEN 'LYS' THEN 'H' WHEN 'ASP' THEN 'E' ELSE 'C' END AS secondary FROM atoms")
def assigned_structure(spark, d):
    a = atoms(spark, d)
    ranges = a.where("resname in ('LYS', 'ASP')").select("chain", "resnum", F.when(F.col("resname") == "LYS", "H").otherwise("E").alias("code")).distinct()
    return H.secondary_structure(a, ranges, ("chain", "resnum")).select("atom_index", "secondary")


# ---- alignments ------------------------------------------------------------------------


@query(f"WITH {MSA}, {SMALLER} SELECT 's' || a.seq_idx AS label, a.seq || b.seq AS seq FROM msa a JOIN msa2 b USING (seq_idx)")
def merged_alignments(spark, d):
    named = lambda m: m.withColumn("label", F.concat(F.lit("s"), F.col("seq_idx").cast("string")))
    return A.merged(named(alignment(spark, d)), named(small_alignment(spark, d)))


@query(f"WITH {MSA}, c AS (SELECT *, count(*) FILTER (WHERE regexp_matches(ch, '[A-Za-z]')) OVER (PARTITION BY seq_idx ORDER BY col) AS k FROM cells) SELECT seq_idx, col, ch, (seq_idx % 90 + k - 1)::INT AS resnum FROM c WHERE regexp_matches(ch, '[A-Za-z]')")
def residue_numbers(spark, d):
    label = F.concat(F.lit("s/"), (F.col("seq_idx") % 90).cast("string"), F.lit("-200"))
    return A.residue_numbers(alignment(spark, d).withColumn("label", label)).select("seq_idx", "col", "ch", F.col("resnum").cast("int").alias("resnum"))


@query(f"WITH {MSA} SELECT seq_idx, length(regexp_replace(seq, '[^A-Za-z]', '', 'g'))::INT AS n_residues, length(regexp_replace(seq, '[A-Za-z]', '', 'g'))::INT AS n_gaps FROM msa")
def gap_counts(spark, d):
    return alignment(spark, d).select("seq_idx", *A.gap_counts())


@query(f"WITH {MSA} SELECT seq_idx, 'q_' || seq[8] AS name, (seq_idx % 30)::INT AS first, (seq_idx % 30 + 8)::INT AS last, seq[8] AS species FROM msa")
def label_parts(spark, d):
    start = F.col("seq_idx") % 30
    label = F.concat(F.lit("q_"), F.substring("seq", 8, 1), F.lit("/"), start.cast("string"), F.lit("-"), (start + 8).cast("string"))
    return alignment(spark, d).withColumn("label", label).select("seq_idx", *A.label_parts(), A.species().alias("species"))


# ---- contact maps ----------------------------------------------------------------------


@query(f"WITH {FLOW} SELECT i::INT AS i, j::INT AS j, round(value / ((1 + i) * (1 + j)), 6) + 0.0 AS value FROM m")
def vector_normalised(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("at"), (F.col("n_nationkey") + 1).cast("double").alias("f"))
    return M.vector_normalised(contact_map(spark, d), n).select("i", "j", r6("value").alias("value"))


@query(f"WITH {FLOW} SELECT i::INT AS i, j::INT AS j, round(value / (1 + abs(i - j)), 6) + 0.0 AS value FROM m")
def expected_normalised(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("at"), (F.col("n_nationkey") + 1).cast("double").alias("f"))
    return M.vector_normalised(contact_map(spark, d), n, True).select("i", "j", r6("value").alias("value"))


@query(f"WITH {FLOW}, z AS (SELECT i, j, CASE WHEN i % 4 = 0 OR j % 4 = 0 THEN 0 ELSE value END AS value FROM m), l AS (SELECT i FROM z GROUP BY 1 HAVING sum(value) <> 0) SELECT i::INT AS i, j::INT AS j, round(value, 6) + 0.0 AS value FROM z WHERE i IN (SELECT i FROM l) AND j IN (SELECT i FROM l)")
def trimmed_map(spark, d):
    holed = contact_map(spark, d).withColumn("value", F.when((F.col("i") % 4 == 0) | (F.col("j") % 4 == 0), 0.0).otherwise(F.col("value")))
    return M.trimmed(holed).select("i", "j", r6("value").alias("value"))


@query("WITH g AS (SELECT k - lag(k) OVER (ORDER BY k) AS gap FROM (SELECT DISTINCT o_orderkey AS k FROM orders)) SELECT gap AS bin FROM g WHERE gap > 0 GROUP BY 1 ORDER BY count(*) DESC, gap LIMIT 1")
def bin_width(spark, d):
    return M.bin_width(table(spark, d, "orders"), "o_orderkey")


@query("WITH s AS (SELECT n_nationkey AS i, 0.5 * n_nationkey AS v FROM nation WHERE n_nationkey % 3 > 0) SELECT n_nationkey AS i, coalesce(v, 0.0)::DOUBLE AS value FROM nation LEFT JOIN s ON i = n_nationkey")
def full_profile(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("i"))
    return M.onto_full(n.where("i % 3 > 0").withColumn("value", F.col("i") * 0.5), n)


# ---- codes, ranges, numbers --------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE (p_partkey % 3 || '.' || p_size || '.' || p_partkey % 7) LIKE '1.2.%' OR (p_partkey % 3 || '.' || p_size || '.' || p_partkey % 7) = '1.2'")
def dotted_codes(spark, d):
    p = table(spark, d, "part")
    code = F.concat_ws(".", (F.col("p_partkey") % 3).cast("string"), F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"))
    return R.classified(p.withColumn("code", code), "code", "p_name", "1.2").select("p_partkey")


@query("SELECT o_custkey, string_agg('(chain ' || o_orderstatus || ' and resnum ' || o_orderkey || ' to ' || (o_orderkey + 5) || ')', ' or ' ORDER BY o_orderstatus, o_orderkey) AS selection FROM orders GROUP BY 1")
def selection_texts(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", (F.col("o_orderkey") + 5).alias("last"))
    return R.selection_text(o, "o_custkey", "o_orderstatus", "o_orderkey", "last")


@query("SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) + 0.0 AS price FROM lineitem GROUP BY 1")
def weighted_means(spark, d):
    mean = R.weighted_mean(F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(rounded(mean, 4).alias("price"))


@query("SELECT p_partkey, (p_partkey % 2) * 8 + (p_partkey // 2 % 2) * 4 + (p_partkey // 4 % 2) * 2 + p_partkey // 8 % 2 AS value FROM part")
def binary_numbers(spark, d):
    bits = F.array(*[F.floor(F.col("p_partkey") / k) % 2 for k in (1, 2, 4, 8)])
    return table(spark, d, "part").select("p_partkey", R.from_bits(bits).alias("value"))


@query("SELECT p_partkey, p_partkey * 977 % 40000000 AS number FROM part")
def hybrid_numbers(spark, d):
    """Numbers written in base 10 or 36 as they fit, and read back."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 977 % 40_000_000).alias("n"))
    return p.select("p_partkey", R.from_hybrid36(R.to_hybrid36(F.col("n"))).alias("number"))


@query(
    """WITH s AS (SELECT o_custkey AS k, o_orderkey AS x, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice::DOUBLE END AS y FROM orders),
    n AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER w AS ax, last_value(y IGNORE NULLS) OVER w AS ay,
      first_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER v AS bx, first_value(y IGNORE NULLS) OVER v AS b FROM s
      WINDOW w AS (PARTITION BY k ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY k ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT k AS o_custkey, x AS o_orderkey, round(coalesce(y, CASE WHEN ax IS NOT NULL AND bx IS NOT NULL THEN ay + (b - ay) * (x - ax) / (bx - ax) END, ay, b), 4) + 0.0 AS price FROM n"""
)
def interpolated_series(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice").cast("double")).alias("price"))
    return R.interpolated(o, "o_orderkey", "price", ("o_custkey",)).select("o_custkey", "o_orderkey", rounded("price", 4).alias("price"))


@query("WITH e AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 2 UNION SELECT p_partkey, p_partkey // 20 FROM part WHERE p_partkey % 4 = 0 AND p_partkey >= 20) SELECT p_partkey AS term FROM part WHERE p_partkey NOT IN (SELECT parent FROM e)")
def deepest_terms(spark, d):
    terms = table(spark, d, "part").select(F.col("p_partkey").alias("term"))
    return R.deepest_terms(terms, part_dag(spark, d), "term")


# ---- interactions ------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) OR l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def interactions_with(spark, d):
    """Line items with a supplier of negative balance at either end."""
    chosen = table(spark, d, "supplier").where("s_acctbal < 0").select("s_suppkey")
    return I.with_ends_in(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", chosen, "s_suppkey").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, (min(l_quantity) + max(l_quantity)) / 2 AS x FROM lineitem GROUP BY 1")
def dummy_atoms(spark, d):
    """Points half-way between an order's smallest and largest quantity."""
    ends = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").cast("double").alias("x1"), F.max("l_quantity").cast("double").alias("x2"))
    flat = ends.select(F.col("l_orderkey").cast("string").alias("name"), "x1", "x2", *[F.lit(0.0).alias(c) for c in ("y1", "y2")], F.col("l_orderkey").cast("double").alias("z1"), F.col("l_orderkey").cast("double").alias("z2"))
    return I.dummy_atoms(flat).select(F.col("z").cast("long").alias("l_orderkey"), "x")


# ---- channels ----------------------------------------------------------------------------

WAYS = f"""w AS (SELECT p_partkey // 12 AS channel, p_partkey AS step, x, y, z, 1 + p_partkey % 5 AS radius FROM ({PART})),
    s AS (SELECT *, sqrt((x - lag(x) OVER o) ^ 2 + (y - lag(y) OVER o) ^ 2 + (z - lag(z) OVER o) ^ 2) AS d, lag(radius) OVER o AS r0 FROM w WINDOW o AS (PARTITION BY channel ORDER BY step))"""


def ways(spark: SparkSession, d: str) -> DataFrame:
    """Twelve parts in a row as the spheres of a channel."""
    k = F.col("p_partkey")
    return points(spark, d).select(F.floor(k / 12).alias("channel"), k.alias("step"), *"xyz", (1 + k % 5).cast("double").alias("radius"))


WAY = f"""{WAYS}, p AS (SELECT channel, coalesce(sum(d), 0) AS length, min(radius)::DOUBLE AS bottleneck, coalesce(sum(pi() / 3 * d * (r0 ^ 2 + r0 * radius + radius ^ 2)), 0) AS volume,
      sqrt((arg_max(x, step) - arg_min(x, step)) ^ 2 + (arg_max(y, step) - arg_min(y, step)) ^ 2 + (arg_max(z, step) - arg_min(z, step)) ^ 2) AS end_to_end FROM s GROUP BY 1)"""


@query(f"WITH {WAY} SELECT channel, round(length, 4) + 0.0 AS length, bottleneck, round(volume, 4) + 0.0 AS volume, round(end_to_end, 4) + 0.0 AS end_to_end FROM p")
def channel_parameters(spark, d):
    p = C.way_parameters(ways(spark, d))
    return p.select("channel", "bottleneck", *[rounded(c, 4).alias(c) for c in ("length", "volume", "end_to_end")])


@query(f"WITH {WAY} SELECT channel FROM p WHERE length >= 100 AND bottleneck >= 1 AND end_to_end <= 60")
def chosen_channels(spark, d):
    return C.ways_between(ways(spark, d), ("channel",), length=(100.0, None), bottleneck=(1.0, None), end_to_end=(None, 60.0)).select("channel").distinct()


@query(
    f"""WITH {WAYS}, n AS (SELECT *, lead(x) OVER o AS nx, lead(radius) OVER o AS nr FROM w WINDOW o AS (PARTITION BY channel ORDER BY step)),
    k AS (SELECT *, unnest(CASE WHEN nx IS NULL THEN [0] ELSE [0, 1, 2, 3] END) / 4 AS t FROM n)
    SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY step, t)::INT - 1 AS atom, round(x + t * coalesce(nx - x, 0), 4) + 0.0 AS x, round(radius + t * coalesce(nr - radius, 0), 4) + 0.0 AS radius FROM k"""
)
def channel_atoms(spark, d):
    return C.way_atoms(ways(spark, d), ("channel",), 4).select("channel", "atom", rounded("x", 4).alias("x"), rounded("radius", 4).alias("radius"))


@query(
    f"""WITH {WAYS} SELECT DISTINCT channel FROM w, (SELECT x AS px, y AS py, z AS pz FROM w WHERE channel % 8 = 1) c WHERE (x - px) ^ 2 + (y - py) ^ 2 + (z - pz) ^ 2 <= 36"""
)
def channels_near(spark, d):
    """Channels within 6 of those whose number leaves 1 over 8."""
    w = ways(spark, d)
    return C.ways_near(w, w.where("channel % 8 = 1"), ("channel",), (), 6.0).select("channel").distinct()


@query(f"WITH p AS ({PART}), c AS (SELECT DISTINCT p_brand AS object, floor(x / 2)::INT AS cx, floor(y / 2)::INT AS cy, floor(z / 2)::INT AS cz FROM p) SELECT object, count(*) AS n_cells, count(*) * 8.0::DOUBLE AS volume, round((avg(cx) + 0.5) * 2, 6) + 0.0 AS x FROM c GROUP BY 1")
def object_parameters(spark, d):
    cells = points(spark, d).select(F.col("p_brand").alias("object"), *[F.floor(F.col(a) / 2).cast("int").alias("c" + a) for a in "xyz"]).distinct()
    return U.object_parameters(cells, 2.0).select("object", "n_cells", "volume", r6("x").alias("x"))


@query(
    f"""WITH p AS ({PART}), c AS (SELECT DISTINCT p_brand AS object, floor(x / 8)::INT AS cx, floor(y / 8)::INT AS cy, floor(z / 8)::INT AS cz FROM p)
    SELECT a.object AS object_a, b.object AS object_b, count(*) * 512.0::DOUBLE AS volume FROM c a JOIN c b USING (cx, cy, cz) GROUP BY 1, 2"""
)
def object_overlaps(spark, d):
    cells = points(spark, d).select(F.col("p_brand").alias("object"), *[F.floor(F.col(a) / 8).cast("int").alias("c" + a) for a in "xyz"]).distinct()
    return U.overlap_cells(cells, cells, 8.0)


# ---- files -------------------------------------------------------------------------------


@query("SELECT l_suppkey % 9 AS frame, l_orderkey || ' ' || (l_orderkey + 1) AS proteins, l_linenumber::VARCHAR AS waters FROM lineitem")
def bridge_files(spark, d):
    """Line items as bridges of nine frames, written and read back."""
    path = _written(spark, "bridges")
    li = table(spark, d, "lineitem").select(F.lit("all").alias("file"), (F.col("l_suppkey") % 9).cast("int").alias("frame"), F.array("l_orderkey", F.col("l_orderkey") + 1).cast("array<int>").alias("proteins"), F.array("l_linenumber").cast("array<int>").alias("waters"))
    X.write_bridges(li, path)
    text = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), " ")
    return X.read_bridges(spark, f"{path}/*/*").select(F.col("frame").cast("long").alias("frame"), text("proteins").alias("proteins"), text("waters").alias("waters"))


@query(f"WITH {ATOMS} SELECT chain, (row_number() OVER (PARTITION BY chain ORDER BY atom_index) - 1)::INT AS atom_index, name, resname, resnum, round(x::DOUBLE, 2) + 0.0 AS x FROM atoms")
def mmtf_round_trip(spark, d):
    """Chains as structures, packed and unpacked."""
    from strandlake.atom_queries import _structures

    s = _structures(spark, d).withColumns({"segment": F.col("chain"), "charge": F.lit(0)})
    files = X.mmtf_bytes(s)
    names = [c.split()[0] for c in X.BINARY.split(", ")]

    def unpack(batches):
        import pandas as pd

        for pdf in batches:
            for raw in pdf["content"]:
                yield pd.DataFrame(X._binary_atoms(bytes(raw)), columns=names)

    return files.mapInPandas(unpack, X.BINARY).select("chain", "atom_index", "name", "resname", "resnum", rounded("x", 2).alias("x"))
