"""Records of searches and annotations: hit filters, ontology distances, hierarchical codes, text helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.plans.iteration import longest_paths, stored

# ---- hits --------------------------------------------------------------------


def hits(rows: DataFrame, identity: Column, coverage: Column, least_identity: float, least_coverage: float, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows identical and covered enough, the best of each group by ``order``."""
    good = rows.withColumns({"percent_identity": identity, "percent_coverage": coverage})
    good = good.where((F.col("percent_identity") >= least_identity) & (F.col("percent_coverage") >= least_coverage))
    by = Window.partitionBy(*group).orderBy(*order)
    return good.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def percent_identity(matches: Column, span: Column) -> Column:
    return F.when(span == 0, 0.0).otherwise(100.0 * matches / span)


def percent_coverage(aligned: Column, gaps: Column, length: Column) -> Column:
    return F.when(length == 0, 0.0).otherwise(100.0 * (aligned - gaps) / length)


def filtered_hits(
    rows: DataFrame, length: str, rmsd: str, z: str, identity: str,
    least_length: float | None = None, least_rmsd: float | None = None, least_z: float | None = None, most_identity: float | None = None,
    strict: bool = False,
) -> DataFrame:
    """Structural hits left after dropping short ones, low Z, and too small RMSD or too high identity; ``strict`` turns the last two round.

    A length up to 1 is a share of the longest; an identity up to 1 is a share of 100.
    """
    drop = F.lit(False)
    if least_length is not None:
        if least_length <= 1:
            longest = rows.agg(F.max(length).alias("_longest"))
            rows = rows.crossJoin(F.broadcast(longest))
            drop = drop | (F.col(length) < least_length * F.col("_longest"))
        else:
            drop = drop | (F.col(length) < least_length)
    if least_z is not None:
        drop = drop | (F.col(z) < least_z)
    if least_rmsd is not None:
        drop = drop | ((F.col(rmsd) > least_rmsd) if strict else (F.col(rmsd) < least_rmsd))
    if most_identity is not None:
        limit = most_identity * 100 if most_identity <= 1 else most_identity
        drop = drop | ((F.col(identity) < limit) if strict else (F.col(identity) > limit))
    return rows.where(~F.coalesce(drop, F.lit(False))).drop("_longest")


# ---- ontologies --------------------------------------------------------------


def depths(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(``node``, ``depth``): the most edges on a path from a node without parents; an error if there is a cycle."""
    return longest_paths(edges, child, parent).groupBy("node").agg(F.max("steps").alias("depth"))


def common_ancestors(up: DataFrame, a: Column | str, b: Column | str) -> DataFrame:
    of = lambda n: up.where(F.col("node") == n).select("ancestor")
    return of(a).intersect(of(b))


def branch_lengths(edges: DataFrame, pairs: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(``a``, ``b``, ``ancestor``, ``length``): depth(a) + depth(b) - 2 depth(deepest common ancestor); none: null."""
    up = longest_paths(edges, child, parent)
    depth = stored(up.groupBy("node").agg(F.max("steps").alias("depth")), "depths")
    side = lambda n: up.select(F.col("node").alias(n), "ancestor")
    of = lambda n, d: depth.select(F.col("node").alias(n), F.col("depth").alias(d))
    both = pairs.join(side("a"), "a").join(side("b"), ["b", "ancestor"]).join(of("ancestor", "_dc"), "ancestor")
    deepest = both.groupBy("a", "b").agg(F.max_by(F.struct("ancestor", "_dc"), F.struct("_dc", "ancestor")).alias("m"))
    full = pairs.join(deepest, ["a", "b"], "left").join(of("a", "_da"), "a", "left").join(of("b", "_db"), "b", "left")
    return full.select("a", "b", F.col("m.ancestor").alias("ancestor"), (F.col("_da") + F.col("_db") - 2 * F.col("m._dc")).alias("length"))


def term_overlap(lengths: DataFrame) -> DataFrame:
    """1 / branch length; equal terms count 1."""
    return lengths.withColumn("overlap", F.when(F.col("length") == 0, 1.0).otherwise(1.0 / F.col("length")))


def deepest_terms(terms: DataFrame, edges: DataFrame, term: str, child: str = "child", parent: str = "parent") -> DataFrame:
    """Terms that are no parent of another."""
    return terms.join(edges.select(F.col(parent).alias(term)).distinct(), term, "left_anti")


# ---- hierarchical codes ------------------------------------------------------


def under(rows: DataFrame, code: str, prefix: str) -> DataFrame:
    """Rows whose dotted code is the prefix or lies below it."""
    return rows.where((F.col(code) == prefix) | F.col(code).startswith(prefix + "."))


def classified(rows: DataFrame, code: str, domain: str, identifier: str) -> DataFrame:
    """Search by a dotted code, a seven-character domain, or a structure with an optional chain letter."""
    if "." in identifier or identifier.isdigit():
        return under(rows, code, identifier)
    return rows.where(F.col(domain) == identifier if len(identifier) == 7 else F.col(domain).startswith(identifier))


def selection_text(ranges: DataFrame, group: str, chain: str, first: str, last: str) -> DataFrame:
    """Domain boundaries as a selection: (``group``, ``selection``)."""
    part = F.concat(F.lit("(chain "), F.col(chain), F.lit(" and resnum "), F.col(first).cast("string"), F.lit(" to "), F.col(last).cast("string"), F.lit(")"))
    return ranges.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(chain, first, part.alias("p")))), lambda s: s["p"]), " or ").alias("selection"))


# ---- text and numbers --------------------------------------------------------


def ranges_text(rows: DataFrame, value: str, keys: Sequence[str] = (), sep: str = " ", to: str = " to ") -> DataFrame:
    """Whole numbers as text of runs, like ``1 to 4 7 9 to 10``: (keys, ``ranges``)."""
    distinct = rows.select(*keys, value).distinct()
    by = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(value)
    runs = distinct.withColumn("_g", F.col(value) - F.row_number().over(by)).groupBy(*keys, "_g").agg(F.min(value).alias("a"), F.max(value).alias("b"))
    one = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit(to), F.col("b").cast("string")))
    return runs.withColumn("_t", one).groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", "_t"))), lambda s: s["_t"]), sep).alias("ranges"))


def alphanumeric(text: Column, other: str = "_", single: bool = False) -> Column:
    """Anything but letters and digits replaced; runs by one ``other`` if ``single``."""
    return F.regexp_replace(text, "[^A-Za-z0-9]+" if single else "[^A-Za-z0-9]", other)


def divided(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or the default where b is 0."""
    return F.when(b == 0, F.lit(default)).otherwise(a / b)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def median_deviation(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Median of the absolute deviations from the median."""
    mid = rows.groupBy(*keys).agg(F.percentile(value, 0.5).alias("_m"))
    joined = rows.join(mid, list(keys)) if keys else rows.crossJoin(F.broadcast(mid))
    return joined.groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("_m")), 0.5).alias("mad"))


def from_bits(bits: Column) -> Column:
    """Integer value of an array of 0 and 1, first the highest."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc * 2 + b.cast("long"))


def interpolated(rows: DataFrame, at: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Gaps (nulls) filled linearly between the nearest values; ends with the nearest one."""
    by = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(at)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("x"), F.col(value).alias("y")))
    a = F.last(known, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(known, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"_a": a, "_b": b})
    line = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * (F.col(at) - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x"))
    return rows.withColumn(value, F.coalesce(F.col(value).cast("double"), line, F.col("_a.y"), F.col("_b.y"))).drop("_a", "_b")


_H36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def to_hybrid36(n: Column, width: int = 5) -> Column:
    """Decimal up to ``width`` digits, then base 36 from A000.., then a000.. in lower case."""
    ten, unit = 10**width, 26 * 36 ** (width - 1)
    first = 10 * 36 ** (width - 1)
    base36 = lambda x: F.conv(x.cast("string"), 10, 36)
    return (
        F.when(n < ten, n.cast("string"))
        .when(n < ten + unit, base36(n - ten + first))
        .otherwise(F.lower(base36(n - ten - unit + first)))
    )


def from_hybrid36(text: Column, width: int = 5) -> Column:
    ten, unit = 10**width, 26 * 36 ** (width - 1)
    first = 10 * 36 ** (width - 1)
    t = F.trim(text)
    number = F.conv(F.upper(t), 36, 10).cast("long")
    plain = t.rlike("^-?[0-9]+$")
    upper = t.rlike("^[A-Z]") & (F.length(t) == width)
    return F.when(plain, t.try_cast("long")).when(upper, number - first + ten).otherwise(number - first + ten + unit)


# ---- rows in order -----------------------------------------------------------


def by_serial(atoms: DataFrame, serial: int, stop: int | None = None, step: int | None = None) -> DataFrame:
    """The atom with a serial number, or those from ``serial`` up to (not with) ``stop``, each ``step``-th number."""
    if stop is None:
        return atoms.where(F.col("serial") == serial)
    inside = (F.col("serial") >= serial) & (F.col("serial") < stop)
    return atoms.where(inside if step is None else inside & ((F.col("serial") - serial) % step == 0))


def in_order(rows: DataFrame, label: str, key: str, reverse: bool = False) -> DataFrame:
    """Rows with ``position`` (from 0) by a label, ties by key; ``reverse`` turns the whole order. Numbered by partition offsets, not in one task."""
    from strandlake.operators.alignments import _numbered

    order = [F.desc(label), F.desc(key)] if reverse else [F.asc(label), F.asc(key)]
    return _numbered(rows, order, "position").withColumn("position", F.col("position") - 1)


def with_ends(rows: DataFrame, x: str, y: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Series with one more row after each break, a usual step further and with null ``y``, so that lines drawn through them part.

    The usual step of a series is its commonest, the smaller of equally common
    ones; a break is a step of any other length. ``keys`` part the series.
    """
    by = Window.partitionBy(*keys).orderBy(x)
    step = rows.select(*keys, x, (F.lead(x).over(by) - F.col(x)).alias("_d")).where("_d is not null")
    usual = step.groupBy(*keys, "_d").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.min_by("_d", F.struct(-F.col("_n"), "_d")).alias("_u"))
    kind = rows.schema[x].dataType
    extra = step.join(usual, list(keys)).where("_d <> _u").select(*keys, (F.col(x) + F.col("_u")).cast(kind).alias(x), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in y])
    return rows.select(*keys, x, *y).unionByName(extra)
