"""Queries over ``embeddings`` as modes of the labels' models and as conformations, and over ``part`` as atoms, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.atom_queries import ATOMS, atoms, embedding_modes
from strandlake.operators import networks as W
from strandlake.operators import signatures as S
from strandlake.plans import iteration as P
from strandlake.queries import conformations, query, r6, rounded, table

# ---- models of members ---------------------------------------------------------

MEMBERS = """members AS (
  SELECT label, mode, 1.0 + vec_id % 7 AS eigval, generate_subscripts(embedding, 1) - 1 AS node, unnest(embedding)::DOUBLE AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS mode FROM embeddings))"""


def member_modes(spark: SparkSession, d: str) -> DataFrame:
    """A label's rows as the modes of its model, numbered by key."""
    number = table(spark, d, "embeddings").select("label", "vec_id", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("_k"))
    return embedding_modes(spark, d).join(number.withColumnRenamed("vec_id", "mode"), "mode").withColumn("mode", F.col("_k")).drop("_k")


@query(
    f"""WITH {MEMBERS}, e AS (SELECT mode, avg(eigval) AS eigval FROM (SELECT DISTINCT label, mode, eigval FROM members) GROUP BY 1)
    SELECT mode::INT AS mode, node::INT AS node, round(avg(v), 6) + 0.0 AS v, round(any_value(e.eigval), 6) + 0.0 AS eigval FROM members JOIN e USING (mode) GROUP BY 1, 2"""
)
def signature_modes(spark, d):
    return S.signature_modes(member_modes(spark, d), "label").select("mode", "node", r6("v").alias("v"), r6("eigval").alias("eigval"))


@query(
    f"""WITH {MEMBERS}, u AS (SELECT label, mode, node, v / sqrt(sum(v ^ 2) OVER (PARTITION BY label, mode)) AS v FROM members)
    SELECT a.label AS a, b.label AS b, a.mode::INT AS mode, round(abs(sum(a.v * b.v)), 6) + 0.0 AS overlap FROM u a JOIN u b ON a.mode = b.mode AND a.node = b.node GROUP BY 1, 2, 3"""
)
def signature_overlaps(spark, d):
    return S.signature_overlaps(member_modes(spark, d), "label").select("a", "b", F.col("mode_a").alias("mode"), r6("overlap").alias("overlap"))


@query(
    f"""WITH {MEMBERS}, e AS (SELECT DISTINCT label, mode, eigval FROM members),
    p AS (SELECT label, mode, row_number() OVER (PARTITION BY label ORDER BY mode) AS k FROM e), s AS (SELECT label, eigval, row_number() OVER (PARTITION BY label ORDER BY eigval) AS k FROM e)
    SELECT p.label, p.mode::INT AS mode, s.eigval::DOUBLE AS eigval, round(1 / s.eigval, 6) + 0.0 AS variance FROM p JOIN s USING (label, k)"""
)
def reweighted_modes(spark, d):
    return S.reweighted(member_modes(spark, d), "label").select("label", "mode", "eigval", r6("variance").alias("variance")).distinct()


@query(
    f"""WITH {MEMBERS}, f AS (SELECT label, node, sum(v ^ 2 / eigval) AS w FROM members GROUP BY 1, 2)
    SELECT round(sum(a.w * b.w) ^ 2 / (sum(a.w ^ 2) * sum(b.w ^ 2)), 9) + 0.0 AS value FROM
    (SELECT node, sum(w) AS w FROM f WHERE label < 5 GROUP BY 1) a JOIN (SELECT node, sum(w) AS w FROM f WHERE label >= 5 GROUP BY 1) b USING (node)"""
)
def square_inner_product(spark, d):
    """Fluctuation profiles of the lower and of the upper labels against each other."""
    m = member_modes(spark, d)
    low, high = W.square_fluctuations(m.where("label < 5")), W.square_fluctuations(m.where("label >= 5"))
    return S.square_inner_product(low, high).select(rounded("value", 9).alias("value"))


@query(
    f"""WITH {MEMBERS}, u AS (SELECT label, mode, node, v / sqrt(sum(v ^ 2) OVER (PARTITION BY label, mode)) AS v FROM members),
    t AS (SELECT mode, node, v / sqrt(sum(v ^ 2) OVER (PARTITION BY mode)) AS v FROM (SELECT mode, node, avg(v) AS v FROM members GROUP BY 1, 2)),
    o AS (SELECT label, u.mode AS force, t.mode, abs(sum(u.v * t.v)) AS o FROM u JOIN t USING (node) GROUP BY 1, 2, 3),
    b AS (SELECT label, force, max(o) AS o FROM o GROUP BY 1, 2) SELECT label AS perturbed, round(avg(o), 6) + 0.0 AS value FROM b GROUP BY 1"""
)
def response_profile(spark, d):
    """A label's rows as the responses to its forces, against the mean modes."""
    m = member_modes(spark, d)
    responses = m.select(F.col("label").alias("perturbed"), F.col("mode").alias("force"), "node", "axis", "v")
    return S.response_profile(responses, S.signature_modes(m, "label"), "mean").select("perturbed", r6("value").alias("value"))


@query(
    f"""WITH {MEMBERS}, m AS (SELECT DISTINCT label, mode, node, v FROM members WHERE node % 3 = 1)
    SELECT x.label, x.mode::INT AS mode, n.node::INT AS node, coalesce(m.v, 0.0) AS v FROM (SELECT DISTINCT label, mode FROM m) x CROSS JOIN (SELECT DISTINCT node FROM members) n
    LEFT JOIN m ON m.label = x.label AND m.mode = x.mode AND m.node = n.node"""
)
def unmasked_modes(spark, d):
    """The labels' modes on every third node, carried back to all nodes."""
    m = member_modes(spark, d)
    nodes = m.select("node").distinct()
    part = W.sliced(m, nodes.where("node % 3 = 1"), keys=("label",))
    return S.unmasked(part, nodes, ("label",)).select("label", "mode", "node", "v")


# ---- conformations -----------------------------------------------------------------

FLAT = """l AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings),
    d AS (SELECT vec_id, sum((v - m) ^ 2) AS d2 FROM l JOIN (SELECT k, avg(v) AS m FROM l GROUP BY 1) USING (k) GROUP BY 1)"""


@query(f"WITH {FLAT} SELECT vec_id, round(d2, 6) + 0.0 AS distance2 FROM d ORDER BY d2, vec_id LIMIT 1")
def central_conformation(spark, d):
    return S.central_conformation(conformations(spark, d), "vec_id", "atom").select("vec_id", r6("distance2").alias("distance2"))


@query(
    f"""WITH {ATOMS}, m AS (SELECT chain, resnum, list_aggregate(list_transform(range(16), lambda k: coalesce(list_filter(list((atom_index % 16, resname[1])), lambda s: s[1] = k)[1][2], '-')), 'string_agg', '') AS seq
      FROM atoms WHERE (atom_index * 7) % 5 <> 0 GROUP BY 1, 2) SELECT chain, resnum, seq FROM m"""
)
def ensemble_alignment(spark, d):
    """Residues as members of sixteen places, each atom with its residue's first letter and every fifth left out."""
    a = atoms(spark, d).where("(atom_index * 7) % 5 <> 0").select(
        F.struct("chain", "resnum").alias("conf"), (F.col("atom_index") % 16).cast("int").alias("atom"), F.substring("resname", 1, 1).alias("letter")
    )
    return S.ensemble_alignment(a).select("conf.chain", "conf.resnum", "seq")


# ---- stiffness ----------------------------------------------------------------------

STIFF = f"""{MEMBERS}, c AS (SELECT a.node AS i, b.node AS j, abs(sum(a.v * b.v / a.eigval)) AS s FROM members a JOIN members b ON a.label = b.label AND a.mode = b.mode AND a.node < b.node GROUP BY 1, 2)"""


def _stiffness(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the covariances of all modes stand for the constants."""
    c = W.covariance_of(embedding_modes(spark, d)).where("i < j")
    return P.stored(c.select("i", "j", F.abs("value").alias("stiffness")), "stiffness")


@query(f"WITH {STIFF} SELECT round(min(s), 6) + 0.0 AS least, round(max(s), 6) + 0.0 AS most FROM c WHERE s <> 0")
def stiffness_range(spark, d):
    return S.stiffness_range(_stiffness(spark, d)).select(r6("least").alias("least"), r6("most").alias("most"))


@query(f"WITH {STIFF} SELECT count(*) AS n FROM c WHERE j - i > 4 AND j < (SELECT max(j) FROM c) AND s > 0.5 AND s < 1.5")
def stiffness_count(spark, d):
    return S.stiffness_count(_stiffness(spark, d), 0.5, 1.5, 4)


@query(f"WITH {STIFF} SELECT i::INT AS i, j::INT AS j, round(s, 6) + 0.0 AS stiffness FROM c WHERE j - i >= 20 ORDER BY s DESC, i, j LIMIT 1")
def stiffness_extreme(spark, d):
    return S.stiffness_extreme(_stiffness(spark, d), True).select("i", "j", r6("stiffness").alias("stiffness"))
