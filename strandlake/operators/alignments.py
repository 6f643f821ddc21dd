"""Alignment analytics. An alignment is rows of (``seq_idx``, ``label``, ``seq``) of equal length; cells are (``seq_idx``, ``col``, ``ch``)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import vocabulary as V
from strandlake.plans.iteration import stored
from strandlake.session import workers_find_package

GAP = "-"


def cells(msa: DataFrame, seq: str = "seq", keys: Sequence[str] = ("seq_idx",)) -> DataFrame:
    """One row per residue or gap: (keys, ``col`` from 0, ``ch``)."""
    return msa.select(*keys, F.posexplode(F.split(seq, "")).alias("col", "ch")).where("ch <> ''")


def symbols(cell: DataFrame, ambiguity: bool = True) -> DataFrame:
    """Cells with upper-case letters, gaps for everything else, and a ``share``: 1, or that of an ambiguous letter in each it may be."""
    up = F.upper("ch")
    plain = cell.withColumn("ch", F.when(up.rlike("^[A-Z]$"), up).otherwise(F.lit(GAP)))
    if not ambiguity:
        return plain.withColumn("share", F.lit(1.0))
    options = F.create_map(*[x for k, v in V.AMBIGUOUS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    many = F.coalesce(options[F.col("ch")], F.array("ch"))
    return plain.withColumn("share", 1.0 / F.size(many)).withColumn("ch", F.explode(many))


def column_entropy(cell: DataFrame, ambiguity: bool = True, omit_gaps: bool = True) -> DataFrame:
    """Natural-log entropy of each column; gaps are left out, or are one more symbol."""
    counts = symbols(cell, ambiguity).groupBy("col", "ch").agg(F.sum("share").alias("c"))
    if omit_gaps:
        counts = counts.where(F.col("ch") != GAP)
    # H = ln n - sum(c ln c) / n
    h = F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")
    out = counts.groupBy("col").agg(h.alias("entropy"))
    whole = cell.select("col").distinct()
    return whole.join(out, "col", "left").select("col", F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def occupancy(cell: DataFrame, by: str = "col", count: bool = False) -> DataFrame:
    """Letters in each column (``by="col"``) or row (``by="seq_idx"``), as share or count."""
    letter = F.col("ch").rlike("^[A-Za-z]$").cast("double")
    return cell.groupBy(by).agg((F.sum(letter).cast("long") if count else F.avg(letter)).alias("occupancy"))


def percent_identities(cell: DataFrame) -> DataFrame:
    """Share, in percent, of each column's most common symbol among upper-case residues other than O, U, X, Z and B."""
    good = F.col("ch").rlike("^[ACDEFGHIJKLMNPQRSTVWY]$")
    n = cell.groupBy("col").agg(F.count(F.lit(1)).alias("n"))
    top = cell.where(good).groupBy("col", "ch").count().groupBy("col").agg(F.max("count").alias("top"))
    return n.join(top, "col", "left").select("col", (100.0 * F.coalesce("top", F.lit(0)) / F.col("n")).alias("identity"))


def _pairs(cell: DataFrame, ambiguity: bool) -> tuple[DataFrame, DataFrame]:
    """Joint counts (i < j, a, b, c) and single ones (col, ch, c)."""
    sym = symbols(cell, ambiguity)
    a = sym.select("seq_idx", F.col("col").alias("i"), F.col("ch").alias("a"), F.col("share").alias("sa"))
    b = sym.select("seq_idx", F.col("col").alias("j"), F.col("ch").alias("b"), F.col("share").alias("sb"))
    # sizes are estimated as before cells were exploded: without the hint millions of them may be broadcast
    joint = a.join(b.hint("merge"), "seq_idx").where("i < j").groupBy("i", "j", "a", "b").agg(F.sum(F.col("sa") * F.col("sb")).alias("c"))
    single = sym.groupBy("col", "ch").agg(F.sum("share").alias("c"))
    return joint, single


def mutual_information(cell: DataFrame, ambiguity: bool = True, norm: bool = False) -> DataFrame:
    """(``i``, ``j``, ``mi``), i < j: natural-log mutual information with gaps as a symbol; over the joint entropy if ``norm``."""
    joint, single = _pairs(cell, ambiguity)
    n = F.col("n")
    total = cell.select("seq_idx").distinct().agg(F.count(F.lit(1)).alias("n"))
    fi = single.select(F.col("col").alias("i"), F.col("ch").alias("a"), F.col("c").alias("ca"))
    fj = single.select(F.col("col").alias("j"), F.col("ch").alias("b"), F.col("c").alias("cb"))
    full = joint.join(fi, ["i", "a"]).join(fj, ["j", "b"]).crossJoin(F.broadcast(total))
    p = F.col("c") / n
    mi = F.sum(p * F.log(F.col("c") * n / (F.col("ca") * F.col("cb"))))
    h = -F.sum(p * F.log(p))
    return full.groupBy("i", "j").agg((F.when(h > 0, mi / h).otherwise(0.0) if norm else mi).alias("mi"))


def omes(cell: DataFrame, ambiguity: bool = True) -> DataFrame:
    """(``i``, ``j``, ``omes``), i < j: N times the sum of (f_ab - f_a f_b)^2 / (f_a f_b) over all symbol pairs, unseen ones too.

    The sum over all pairs is that of f_ab^2 / (f_a f_b) over the seen ones, less 1.
    """
    joint, single = _pairs(cell, ambiguity)
    total = cell.select("seq_idx").distinct().agg(F.count(F.lit(1)).alias("n"))
    fi = single.select(F.col("col").alias("i"), F.col("ch").alias("a"), F.col("c").alias("ca"))
    fj = single.select(F.col("col").alias("j"), F.col("ch").alias("b"), F.col("c").alias("cb"))
    full = joint.join(fi, ["i", "a"]).join(fj, ["j", "b"]).crossJoin(F.broadcast(total))
    return full.groupBy("i", "j").agg((F.max("n") * (F.sum(F.col("c") * F.col("c") / (F.col("ca") * F.col("cb"))) - 1)).alias("omes"))


def coupling(cell: DataFrame) -> DataFrame:
    """(``i``, ``j``, ``sca``), i <= j: absolute covariance of weight-mapped columns against background frequencies."""
    sym = symbols(cell, False)
    n = sym.select("seq_idx").distinct().agg(F.count(F.lit(1)).alias("n"))
    q = F.create_map(*[F.lit(x) for kv in V.BACKGROUND.items() for x in kv])[F.col("ch")]
    freq = sym.where(F.col("ch") != GAP).groupBy("col", "ch").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(n))
    f = F.col("c") / F.col("n")
    phi = F.when(q.isNull() | (f >= 1), 0.0).otherwise(F.abs(F.log(f * (1 - q) / ((1 - f) * q))))
    weight = freq.select("col", "ch", f.alias("f"), phi.alias("phi"))
    size = weight.groupBy("col").agg(F.sqrt(F.sum((F.col("f") * F.col("phi")) ** 2)).alias("s"))
    weight = weight.join(size, "col").select("col", "ch", F.when(F.col("s") > 0, F.col("f") * F.col("phi") ** 2 / F.col("s")).otherwise(0.0).alias("x"))
    mapped = sym.join(weight, ["col", "ch"], "left").select("seq_idx", "col", F.coalesce("x", F.lit(0.0)).alias("x"))
    a = mapped.select("seq_idx", F.col("col").alias("i"), F.col("x").alias("u"))
    b = mapped.select("seq_idx", F.col("col").alias("j"), F.col("x").alias("v"))
    return a.join(b, "seq_idx").where("i <= j").groupBy("i", "j").agg(F.abs(F.covar_pop("u", "v")).alias("sca"))


def normalised_mi(mi: DataFrame, entropy: DataFrame, norm: str = "sument") -> DataFrame:
    """Mutual information over a divisor of the two columns' entropies: sument, minent, maxent, mincon, maxcon; 0 over 0 is 0."""
    h = lambda p: entropy.select(F.col("col").alias(p), F.col("entropy").alias("h" + p))
    full = mi.join(h("i"), "i").join(h("j"), "j")
    hi, hj, m = F.col("hi"), F.col("hj"), F.col("mi")
    by = {
        "sument": hi + hj, "minent": F.least(hi, hj), "maxent": F.greatest(hi, hj),
        "mincon": F.least(hi - m, hj - m), "maxcon": F.greatest(hi - m, hj - m),
    }[norm]
    return full.select("i", "j", F.when(by == 0, 0.0).otherwise(m / by).alias("mi"))


def corrected_mi(mi: DataFrame, corr: str = "prod") -> DataFrame:
    """Average product (``prod``) or average sum (``sum``) correction; a column's mean is over the other columns."""
    both = mi.unionByName(mi.select(F.col("j").alias("i"), F.col("i").alias("j"), "mi"))
    mean = stored(both.groupBy("i").agg(F.avg("mi").alias("m")), "mi-means")
    m = F.broadcast(mean.agg(F.avg("m").alias("mm")))
    full = mi.join(mean.withColumnRenamed("m", "mi_i"), "i").join(mean.select(F.col("i").alias("j"), F.col("m").alias("mi_j")), "j").crossJoin(m)
    less = F.when(F.col("mm") == 0, 0.0).otherwise(F.col("mi_i") * F.col("mi_j") / F.col("mm")) if corr == "prod" else F.col("mi_i") + F.col("mi_j") - F.col("mm")
    return full.select("i", "j", (F.col("mi") - less).alias("mi"))


def _both_letters(a: str, b: str) -> tuple[Column, Column]:
    """Of two equal-long texts: positions where at least one is a letter, and where both are the same letter."""
    pair = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct((x.rlike("^[A-Za-z]$") | y.rlike("^[A-Za-z]$")).alias("any"), ((x == y) & x.rlike("^[A-Za-z]$")).alias("same")))
    count = lambda f: F.size(F.filter(pair, lambda p: p[f]))
    return count("any"), count("same")


def identities(msa: DataFrame, key: str = "seq_idx", seq: str = "seq") -> DataFrame:
    """(``i``, ``j``, ``identity``), i < j: equal letters over columns where at least one row has a letter; 0 if none has.

    Rows meet block by block in numpy, so a task holds two blocks at most.
    """
    workers_find_package(msa.sparkSession)
    codes = F.transform(F.split(F.col(seq), ""), lambda c: F.when(c.rlike("^[A-Za-z]$"), F.ascii(c)).otherwise(F.lit(0)).cast("double"))
    from strandlake.operators.ensembles import _block_rows

    def identity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        some = (x > 0) | (y > 0)
        same = (x == y) & (x > 0)
        n = some.sum(axis=1)
        return np.where(n > 0, same.sum(axis=1) / np.maximum(n, 1), 0.0)

    return _block_rows(msa.select(key, codes.alias("_codes")), key, "_codes", identity, "identity")


def unique_rows(msa: DataFrame, identity: DataFrame, key: str = "seq_idx", least: float = 0.98) -> DataFrame:
    """Rows kept by a scan in key order that drops a row as alike as ``least`` to an earlier kept one.

    A row is settled once all earlier rows it is alike to are; every round
    settles all rows that can be, so rounds follow the longest chain of alike
    rows, not their number.
    """
    alike = stored(identity.where(F.col("identity") >= least).select("i", "j"), "alike")
    kind = msa.schema[key].dataType.simpleString()
    spark = msa.sparkSession
    open_ = stored(alike.select(F.col("j").alias("k")).distinct(), "open")
    dropped = spark.createDataFrame([], f"k {kind}")
    while not open_.isEmpty():
        live = alike.join(dropped.withColumnRenamed("k", "i"), "i", "left_anti")
        waits = live.join(open_.withColumnRenamed("k", "i"), "i", "left_semi").select(F.col("j").alias("k")).distinct()
        decided_live = live.join(open_.withColumnRenamed("k", "i"), "i", "left_anti").select(F.col("j").alias("k")).distinct()
        gone = stored(open_.join(decided_live, "k", "left_semi"), "gone")
        dropped = dropped.unionByName(gone)
        open_ = stored(open_.join(gone, "k", "left_anti").join(waits, "k", "left_semi"), "open")
    return msa.join(dropped.withColumnRenamed("k", key), key, "left_anti")


def effective_sequences(identity: DataFrame, msa: DataFrame, key: str = "seq_idx", seqid: float = 0.8) -> DataFrame:
    """(``key``, ``weight``): one over the number of rows, itself included, whose mismatch share is below 1 - ``seqid``; their sum is Meff."""
    near = identity.where(F.col("mismatch") < 1 - seqid)
    both = near.select(F.col("i").alias(key)).unionByName(near.select(F.col("j").alias(key)))
    n = both.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return msa.select(key).join(n, key, "left").select(key, (1.0 / (1 + F.coalesce("n", F.lit(0)))).alias("weight"))


def mismatches(msa: DataFrame, key: str = "seq_idx", seq: str = "seq") -> DataFrame:
    """(``i``, ``j``, ``mismatch``): share of columns that differ; upper-case letters are symbols, the rest is one symbol."""
    from strandlake.operators.ensembles import _block_rows

    codes = F.transform(F.split(F.col(seq), ""), lambda c: F.when(c.rlike("^[A-Z]$"), F.ascii(c)).otherwise(F.lit(0)).cast("double"))
    return _block_rows(msa.select(key, codes.alias("_codes")), key, "_codes", lambda x, y: (x != y).mean(axis=1), "mismatch")


def direct_information(msa: DataFrame, weights: DataFrame, key: str = "seq_idx", seq: str = "seq", pseudo: float = 0.5) -> DataFrame:
    """(``i``, ``j``, ``di``): mean-field direct information with sequence weights and a pseudo-count.

    Frequencies of symbol pairs are grouped sums; the inverse of the
    correlation matrix, which is columns x 20 wide, is one dense solve.
    """
    workers_find_package(msa.sparkSession)
    q = 21
    letters = "ACDEFGHIKLMNPQRSTVWY"
    code = F.coalesce(F.create_map(*[F.lit(x) for i, c in enumerate(letters) for x in (c, i)])[F.col("ch")], F.lit(q - 1))
    sym = cells(msa, seq, (key,)).join(weights, key).select(key, "col", code.alias("s"), "weight")
    a = sym.select(key, F.col("col").alias("i"), F.col("s").alias("a"), "weight")
    b = sym.select(key, F.col("col").alias("j"), F.col("s").alias("b"))
    joint = a.join(b, key).where("i <= j").groupBy("i", "j", "a", "b").agg(F.sum("weight").alias("w"))
    meff = weights.agg(F.sum("weight")).first()[0] or 1.0

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        length = int(pdf["j"].max()) + 1
        f = np.zeros((length, length, q, q))
        f[pdf["i"], pdf["j"], pdf["a"], pdf["b"]] = pdf["w"] / meff
        f = np.where(np.arange(length)[:, None, None, None] <= np.arange(length)[None, :, None, None], f, f.transpose(1, 0, 3, 2))
        f = (1 - pseudo) * f + pseudo / q**2
        own = np.einsum("iiab->iab", f)
        single = np.einsum("iaa->ia", (own - pseudo / q**2) / (1 - pseudo)) * (1 - pseudo) + pseudo / q
        for i in range(length):
            f[i, i] = np.diag(single[i])
        c = f - single[:, None, :, None] * single[None, :, None, :]
        c = c[:, :, : q - 1, : q - 1].transpose(0, 2, 1, 3).reshape(length * (q - 1), length * (q - 1))
        inverse = np.linalg.inv(c).reshape(length, q - 1, length, q - 1)
        out = []
        for i in range(length):
            for j in range(i + 1, length):
                w = np.ones((q, q))
                w[: q - 1, : q - 1] = np.exp(-inverse[i, :, j, :])
                mi, mj = np.full(q, 1 / q), np.full(q, 1 / q)
                while True:
                    ni = single[i] / (w @ mj)
                    ni /= ni.sum()
                    nj = single[j] / (w.T @ mi)
                    nj /= nj.sum()
                    moved = max(np.abs(ni - mi).max(), np.abs(nj - mj).max())
                    mi, mj = ni, nj
                    if moved <= 1e-4:
                        break
                p = w * np.outer(mi, mj)
                p /= p.sum()
                out.append((i, j, float((p * np.log((p + 1e-100) / (np.outer(single[i], single[j]) + 1e-100))).sum())))
        return pd.DataFrame(out, columns=["i", "j", "di"])

    return joint.groupBy(F.lit("all")).applyInPandas(lambda pdf: solve(pdf), "i int, j int, di double")


def ranked(matrix: DataFrame, value: str, zscore: bool = False, axis: str = "i") -> DataFrame:
    """Matrix cells with ``rank`` from 1, largest first, ties by (i, j); values as population z-scores of their axis if wanted."""
    from pyspark.sql.window import Window

    if zscore:
        by = Window.partitionBy(axis)
        sd = F.stddev_pop(value).over(by)
        matrix = matrix.withColumn(value, F.when(sd == 0, 0.0).otherwise((F.col(value) - F.avg(value).over(by)) / sd))
    ordered = matrix.orderBy(F.desc(value), "i", "j")
    return _numbered(ordered, [F.desc(value), F.asc("i"), F.asc("j")], "rank")


def _numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Row numbers from 1 in a total order without one task for all rows: sorted partitions, then offsets per partition."""
    from pyspark.sql.window import Window

    parts = stored(df.orderBy(*order).withColumn("_p", F.spark_partition_id()), "ordered")
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    within = Window.partitionBy("_p").orderBy(*order)
    return parts.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn(name, F.row_number().over(within) + F.col("_before")).drop("_p", "_before")


def conservation(cell: DataFrame, target: DataFrame, total: int) -> DataFrame:
    """Per column: the target's residue, its share, base-2 entropy without gaps, consensus and its share, gap share."""
    n = F.lit(float(total))
    up = cell.withColumn("ch", F.upper("ch"))
    counts = up.groupBy("col", "ch").agg(F.count(F.lit(1)).alias("c"))
    letter = F.col("ch").rlike("^[A-Z]$")
    p = F.col("c") / n
    facts = counts.groupBy("col").agg(
        F.coalesce(-F.sum(F.when(letter, p * F.log2(p))), F.lit(0.0)).alias("entropy"),
        F.max_by("ch", F.when(letter, F.struct(F.col("c"), -F.ascii("ch")))).alias("consensus"),
        (F.coalesce(F.max(F.when(letter, F.col("c"))), F.lit(0)) / n).alias("consensus_share"),
        (F.coalesce(F.sum(F.when(~letter, F.col("c"))), F.lit(0)) / n).alias("gap_share"),
    )
    mine = target.select("col", F.upper("ch").alias("residue"))
    share = counts.withColumnRenamed("ch", "residue")
    return mine.join(facts, "col").join(share, ["col", "residue"], "left").select("col", "residue", (F.coalesce("c", F.lit(0)) / n).alias("identity"), "entropy", "consensus", "consensus_share", "gap_share")


def refined(msa: DataFrame, reference: str | None = None, row_occupancy: float | None = None, seqid: float | None = None, column_occupancy: float | None = None, key: str = "seq_idx") -> DataFrame:
    """Columns in which the reference label has a letter; then rows full enough; then rows not too alike; then columns full enough."""
    if reference is not None:
        row = msa.where(F.col("label") == reference).select("seq").first()
        if row is None:
            raise ValueError(f"no row is labelled {reference!r}")
        keep = [i + 1 for i, c in enumerate(row["seq"]) if c.isalpha()]
        msa = msa.withColumn("seq", _columns("seq", keep))
    if row_occupancy is not None:
        msa = msa.where(F.length(F.regexp_replace("seq", "[^A-Za-z]", "")) / F.length("seq") >= row_occupancy)
    if seqid is not None:
        msa = stored(msa, "msa")
        msa = unique_rows(msa, identities(msa, key), key, seqid)
    if column_occupancy is not None:
        msa = stored(msa, "msa")
        full = occupancy(cells(msa, "seq", (key,))).where(F.col("occupancy") >= column_occupancy).select("col").collect()
        msa = msa.withColumn("seq", _columns("seq", sorted(r["col"] + 1 for r in full)))
    return msa


def _columns(seq: str, keep: Sequence[int]) -> Column:
    return F.array_join(F.transform(F.array(*[F.lit(k) for k in keep]), lambda k: F.substring(F.col(seq), k, F.lit(1))), "") if keep else F.lit("")


def merged(a: DataFrame, b: DataFrame, key: Column | str = "label") -> DataFrame:
    """Alignments side by side: rows whose key is unique in both, joined and concatenated."""
    of = lambda m, n: m.select((F.col(key) if isinstance(key, str) else key).alias("label"), F.col("seq").alias(n)).groupBy("label").agg(F.count(F.lit(1)).alias("k"), F.first(n).alias(n)).where("k = 1").drop("k")
    return of(a, "_a").join(of(b, "_b"), "label").select("label", F.concat("_a", "_b").alias("seq"))


def species() -> Column:
    """The species part of a label: what follows the last underscore, before any residue range."""
    return F.regexp_extract("label", r"_([^_/]+)(?:/.*)?$", 1)


def residue_numbers(msa: DataFrame, key: str = "seq_idx") -> DataFrame:
    """(key, ``col``, ``resnum``) of each letter: counted from the start in ``label/start-end`` (1 without), gaps not counted."""
    start = F.coalesce(F.regexp_extract("label", r"/(\d+)-\d+$", 1).try_cast("int"), F.lit(1))
    letters = F.filter(F.transform(F.split("seq", ""), lambda c, i: F.struct(i.alias("col"), c.alias("ch"))), lambda s: s["ch"].rlike("^[A-Za-z]$"))
    return msa.select(key, start.alias("_s"), F.posexplode(letters).alias("_k", "_c")).select(key, F.col("_c.col").alias("col"), F.col("_c.ch").alias("ch"), (F.col("_s") + F.col("_k")).alias("resnum"))


def label_parts(label: str = "label") -> list[Column]:
    """``name``, ``first`` and ``last`` of ``name/first-last``."""
    pattern = r"^(.*)/(\d+)-(\d+)$"
    name = F.regexp_extract(label, pattern, 1)
    return [F.when(name == "", F.col(label)).otherwise(name).alias("name"), *[F.regexp_extract(label, pattern, g).try_cast("int").alias(n) for g, n in ((2, "first"), (3, "last"))]]


def gap_counts(seq: str = "seq") -> list[Column]:
    letters = F.length(F.regexp_replace(seq, "[^A-Za-z]", ""))
    return [letters.alias("n_residues"), (F.length(seq) - letters).alias("n_gaps")]


def filtered_pairs(ranks: DataFrame, distances: DataFrame, n: int, least_gap: int = 0, nearest: float | None = None, furthest: float | None = None) -> DataFrame:
    """The first ``n`` ranked pairs that are far enough in sequence and near (or far) enough in space: rank columns and ``distance``."""
    out = ranks.join(distances.select("i", "j", "distance"), ["i", "j"]).where(F.abs(F.col("i") - F.col("j")) >= least_gap)
    if nearest is not None:
        out = out.where(F.col("distance") >= nearest)
    if furthest is not None:
        out = out.where(F.col("distance") <= furthest)
    return out.orderBy("rank").limit(n)


# ---- rows, columns and joined alignments -----------------------------------------


def rows_of(msa: DataFrame, label: str) -> DataFrame:
    """Rows whose label (without its range) is the given one; if there is none, those of the first label that holds it."""
    name = label_parts()[0]
    hits = msa.withColumn("_name", name).where(F.contains("_name", F.lit(label)))
    first = hits.agg(F.min_by("_name", F.struct(F.col("_name") != label, "seq_idx")).alias("_first"))
    return hits.join(F.broadcast(first), F.col("_name") == F.col("_first"), "left_semi").drop("_name")  # one row


def stacked(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of ``b`` after those of ``a``; alignments of different width are an error."""
    wide = lambda m: {r[0] for r in m.select(F.length("seq")).distinct().limit(2).collect()}
    if len(wide(a) | wide(b)) > 1:
        raise ValueError("alignments of different width")
    shift = a.agg((F.coalesce(F.max("seq_idx"), F.lit(-1)) + 1).alias("_n"))
    low = b.agg(F.min("seq_idx").alias("_low"))
    moved = b.crossJoin(F.broadcast(shift)).crossJoin(F.broadcast(low)).withColumn("seq_idx", F.col("seq_idx") - F.col("_low") + F.col("_n"))
    return a.unionByName(moved.drop("_n", "_low").select(*a.columns))


def picked(msa: DataFrame, rows: slice | Sequence[int | str] | None = None, cols: slice | Sequence[int] | None = None) -> DataFrame:
    """Rows by number (counted from 0 in ``seq_idx``) or label, and columns by number, both as slices without negative ends or as lists."""
    out = msa
    if isinstance(rows, slice):
        start, step = rows.start or 0, rows.step or 1
        out = out.where((F.col("seq_idx") >= start) & ((F.col("seq_idx") - start) % step == 0))
        out = out if rows.stop is None else out.where(F.col("seq_idx") < rows.stop)
    elif rows is not None:
        by_label = any(isinstance(r, str) for r in rows)
        out = out.where((label_parts()[0] if by_label else F.col("seq_idx")).isin(list(rows)))
    if isinstance(cols, slice):
        stop = F.length("seq") if cols.stop is None else F.least(F.length("seq"), F.lit(cols.stop))
        start, step = cols.start or 0, cols.step or 1
        places = F.when(stop > start, F.sequence(F.lit(start), stop - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        out = out.withColumn("seq", F.array_join(F.transform(places, lambda k: F.col("seq").substr(k + 1, F.lit(1))), ""))
    elif cols is not None:
        out = out.withColumn("seq", F.concat(*[F.col("seq").substr(c + 1, 1) for c in cols]) if cols else F.lit(""))
    return out


# ---- sparse inverse covariance -----------------------------------------------------


def graphical_lasso(cov: np.ndarray, rho: np.ndarray, tolerance: float = 1e-4, most: int = 10_000) -> np.ndarray:
    """The precision matrix of largest likelihood under penalties ``rho`` on the sizes of its entries.

    Blockwise coordinate descent: each column of the estimated covariance is a
    lasso on the others. An error if it is not still after ``most`` sweeps.
    """
    n = len(cov)
    w = cov + np.diag(np.diag(rho))
    beta = np.zeros((n, n))
    still = tolerance * np.abs(cov - np.diag(np.diag(cov))).sum() / max(n - 1, 1) / max(n, 1)
    for _ in range(most):
        moved = 0.0
        for j in range(n):
            other = np.arange(n) != j
            v, s, r, b = w[np.ix_(other, other)], cov[other, j], rho[other, j], beta[other, j]
            diagonal, at = np.diag(v), v @ b
            while True:
                largest = 0.0
                # entries that stay at zero need no visit: only those off it, or about to leave it
                for k in np.flatnonzero((b != 0) | (np.abs(s - at) > r)):
                    pull = s[k] - at[k] + diagonal[k] * b[k]
                    new = np.sign(pull) * max(abs(pull) - r[k], 0.0) / diagonal[k]
                    if new != b[k]:
                        at += v[:, k] * (new - b[k])
                        largest = max(largest, abs(new - b[k]) * diagonal[k])
                        b[k] = new
                if largest <= still:
                    break
            beta[other, j] = b
            moved += np.abs(w[other, j] - at).sum()
            w[other, j] = w[j, other] = at
        if moved / max(n * (n - 1), 1) <= still:
            break
    else:
        raise RuntimeError(f"not still after {most} sweeps")
    precision = np.zeros((n, n))
    for j in range(n):
        other = np.arange(n) != j
        precision[j, j] = 1 / (w[j, j] - w[other, j] @ beta[other, j])
        precision[other, j] = -beta[other, j] * precision[j, j]
    return (precision + precision.T) / 2


def sparse_coupling(msa: DataFrame, similar: float | None = None) -> DataFrame:
    """(``i``, ``j``, ``value``): size of the blocks of letters between columns in a sparse inverse covariance.

    Rows weigh one over the number of rows like them; ``similar`` is the share
    of columns that may differ, by default 0.1216 over the mean identity and
    0.5 at most. Frequencies of 21 letters (gaps and unknown letters as one)
    get pseudo-counts, the covariance is shrunk until it is positive definite,
    and the penalty is one over the sum of weights. Columns with more than
    90 % of gaps are not coupled. The solution is one task: columns x 21 rows
    of numbers, however many rows the alignment has.
    """
    workers_find_package(msa.sparkSession)
    from strandlake.operators.ensembles import _block_rows

    letters = "ARNDCQEGHILKMFPSTWYV"
    codes = F.transform(F.split(F.upper("seq"), ""), lambda c: F.greatest(F.instr(F.lit(letters), c), F.lit(0)).cast("double"))
    same = msa.select("seq_idx", codes.alias("_codes"))
    ident = _block_rows(same, "seq_idx", "_codes", lambda x, y: (x == y).mean(axis=1), "identity")  # gaps equal gaps here
    if similar is None:
        mean = ident.agg(F.avg("identity")).first()[0]
        similar = min(0.5, 0.38 * 0.32 / mean) if mean else 0.5
    width = msa.select(F.length("seq")).first()
    if width is None:
        return msa.sparkSession.createDataFrame([], "i int, j int, value double")
    length = width[0]
    # fewer columns differ than the share of the length, cut to a whole number
    near = stored(ident.where(F.round((1 - F.col("identity")) * length) < int(length * similar)), "near")
    like = near.select(F.col("i").alias("seq_idx")).unionByName(near.select(F.col("j").alias("seq_idx"))).groupBy("seq_idx").agg(F.count(F.lit(1)).alias("n"))
    weights = msa.join(like, "seq_idx", "left").select("seq_idx", (1 / (1 + F.coalesce("n", F.lit(0)))).alias("w"), F.upper("seq").alias("seq"))

    def moments(batches):
        """Weighted counts of pairs of (column, letter) of a batch."""
        ndim = length * 21
        total, seen = np.zeros((ndim, ndim)), False
        for pdf in batches:
            code = np.array([[letters.find(c) if c in letters else 20 for c in s] for s in pdf["seq"]], int).reshape(len(pdf), length)
            hot = np.zeros((len(pdf), ndim))
            np.put_along_axis(hot, code + 21 * np.arange(length), 1.0, axis=1)
            total += hot.T @ (hot * pdf["w"].to_numpy()[:, None])
            seen = seen or len(pdf) > 0
        if seen:
            i, j = np.nonzero(total)
            yield pd.DataFrame({"i": i, "j": j, "value": total[i, j]})

    counts = weights.select("seq", "w").mapInPandas(moments, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ndim = length * 21
        raw = np.zeros((ndim, ndim))
        raw[pdf["i"], pdf["j"]] = pdf["value"]
        single = np.diag(raw)
        wsum = single[:21].sum()
        p = (single + 1) / (21 + wsum)
        cov = (raw + 1 / 21) / (21 + wsum) - np.outer(p, p)
        column = np.arange(ndim) // 21
        same = column[:, None] == column[None, :]
        cov[same] = 0.0
        np.fill_diagonal(cov, p - p * p)
        middle = np.diag(cov).mean()
        while True:
            try:
                np.linalg.cholesky(cov)
                break
            except np.linalg.LinAlgError:
                shrunk = 0.8 * cov
                np.fill_diagonal(shrunk, 0.2 * middle + 0.8 * np.diag(cov))
                cov = shrunk
        rho = np.full((ndim, ndim), max(0.001, 1 / wsum))
        off = same & ~np.eye(ndim, dtype=bool)
        gappy = np.repeat(p[20::21] > 0.9, 21)
        off |= gappy[:, None] | gappy[None, :]
        rho[off] = 1e9
        size = np.abs(graphical_lasso(cov, rho))
        kept = (np.arange(ndim) % 21 < 20).astype(float)
        blocks = (size * np.outer(kept, kept)).reshape(length, 21, length, 21).sum(axis=(1, 3))
        np.fill_diagonal(blocks, 0.0)
        i, j = (x.ravel() for x in np.indices(blocks.shape))
        return pd.DataFrame({"i": i, "j": j, "value": blocks.ravel()})

    return counts.groupBy(F.lit("all")).applyInPandas(lambda pdf: solve(pdf), "i int, j int, value double")
