"""Compiler of the selection language: a query becomes Column tests, and joins where it looks at other rows.

A table of atoms is any DataFrame with an ``AtomTable`` description: which
column (expression) each field is, what identifies a row, and where bonds are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandlake.functions import syntax as S
from strandlake.functions import vocabulary as V
from strandlake.functions.syntax import SelectionError
from strandlake.operators.neighbours import AXES, pairs_within

MACROS: dict[str, str] = {}


def define_macro(name: str, text: str) -> None:
    """Names a selection; the name has lower-case letters only and the text has to parse."""
    if not (name.isalpha() and name.islower()):
        raise ValueError("a macro's name has lower-case letters only")
    if name in reserved_words():
        raise ValueError(f"{name!r} is reserved")
    fields = dict.fromkeys((*V.INT_FIELDS, *V.FLOAT_FIELDS), "double") | dict.fromkeys(V.STRING_FIELDS, "string")
    S.Parser(text, fields, flag_names(), MACROS, set()).parse()
    MACROS[name] = text


def delete_macro(name: str) -> None:
    del MACROS[name]


def macro(name: str | None = None) -> str | dict[str, str]:
    return dict(MACROS) if name is None else MACROS[name]


def is_macro(word: str) -> bool:
    return word in MACROS


def flag_names() -> set[str]:
    return {
        *_FLAG_TEXT, *V.RESNAME_FLAGS, *V.CATEGORIES, *V.ELEMENT_PATTERNS, *V.SECONDARY_CODES, *V.FLAG_SYNONYMS,
        "ca", "bb", "bbfull", "stdaa", "nonstdaa", "charged", "all", "none", "dummy", "mapped",
    }


def reserved_words() -> list[str]:
    return sorted(
        flag_names() | set(V.STRING_FIELDS) | set(V.INT_FIELDS) | set(V.FLOAT_FIELDS) | set(V.SYNONYMS) | set(V.FUNCTION_NAMES)
        | {"and", "or", "not", "within", "exwithin", "of", "same", "as", "bonded", "exbonded", "to", "sequence", "index"}
    )


#: Flags that are selections themselves.
_FLAG_TEXT = {
    "protein": "same residue as ca and not water and not ion",
    "sc": "protein and not bbfull",
    "nucleic": "nucleobase or nucleotide or nucleoside",
    "hetero": "not protein and not nucleic",
    "noh": "not hydrogen",
}


@dataclass
class Flags:
    """Definitions that a session may change."""

    nonstandard: dict[str, set[str]] = field(default_factory=lambda: {k: set(v.split()) for k, v in V.NONSTANDARD.items()})
    resnames: dict[str, set[str]] = field(default_factory=lambda: {k: set(v.split()) for k, v in V.RESNAME_FLAGS.items()})
    names: dict[str, set[str]] = field(default_factory=lambda: {"bb": set(V.BACKBONE.split()), "bbfull": set(V.BACKBONE_FULL.split())})
    patterns: dict[str, str] = field(default_factory=lambda: dict(V.ELEMENT_PATTERNS))

    def amino_acids(self) -> set[str]:
        return set(V.STANDARD) | set(self.nonstandard)

    def category(self, name: str) -> set[str]:
        if name == "charged":
            return self.category("acidic") | self.category("basic")
        if name == "stdaa":
            return set(V.STANDARD)
        if name == "nonstdaa":
            return set(self.nonstandard)
        return set(V.CATEGORIES[name].split()) | {r for r, c in self.nonstandard.items() if name in c}

    def add_nonstandard(self, resname: str, *categories: str) -> None:
        unknown = set(categories) - set(V.CATEGORIES)
        if unknown:
            raise ValueError(f"unknown categories: {sorted(unknown)}")
        self.nonstandard[resname] = set(categories)

    def delete_nonstandard(self, resname: str) -> None:
        del self.nonstandard[resname]


@dataclass
class AtomTable:
    """A DataFrame seen as atoms.

    ``fields`` maps field names to columns or expressions (default: columns of
    the same name); ``key`` columns identify a row; ``scope`` columns part the
    table into structures (and coordinate sets) that never look at each other.
    ``bonds`` has columns ``i`` and ``j`` (values of the first key column) and
    the scope. ``user_flags`` are further boolean columns.
    """

    df: DataFrame
    key: Sequence[str] = ("atom_index",)
    scope: Sequence[str] = ()
    fields: Mapping[str, Column | str] = field(default_factory=dict)
    bonds: DataFrame | None = None
    user_flags: Mapping[str, Column | str] = field(default_factory=dict)
    flags: Flags = field(default_factory=Flags)
    points: Mapping[str, Sequence[Sequence[float]]] = field(default_factory=dict)

    def column(self, name: str) -> Column:
        at = self.fields.get(name)
        if at is None:
            at = self.key[0] if name == "index" and "index" not in self.df.columns else name
        return F.col(at) if isinstance(at, str) else at

    def types(self) -> dict[str, str]:
        """Field name to ``string`` or ``double``, of every field the table has."""
        plain = {f.name: f.dataType for f in self.df.schema.fields}
        named = dict(self.fields)
        named.setdefault("index", self.key[0])
        exprs = {k: (F.col(v) if isinstance(v, str) else v) for k, v in named.items()}
        found = {f.name: f.dataType for f in self.df.limit(0).select(*[c.alias(k) for k, c in exprs.items()]).schema.fields} if exprs else {}
        out = {}
        for k, t in {**plain, **found}.items():
            if isinstance(t, T.StringType):
                out[k] = "string"
            elif isinstance(t, T.NumericType):
                out[k] = "double"
        return out


class Compiler:
    def __init__(self, table: AtomTable, text: str) -> None:
        self.table, self.text = table, text
        self.kinds = table.types()
        self.df = table.df
        self.count = 0

    def parse(self, text: str) -> object:
        names = flag_names() | set(self.table.user_flags) | {f.name for f in self.df.schema.fields if isinstance(f.dataType, T.BooleanType)}
        return S.Parser(text, self.kinds, names, MACROS, set(self.table.points)).parse()

    def error(self, at: int, message: str) -> SelectionError:
        return SelectionError(self.text, at, message)

    # -- nodes; a null test counts as false, which only negation has to spell out:
    #    filters drop nulls by themselves, and plain comparisons stay visible to the scan

    def test(self, node: object) -> Column:
        if isinstance(node, S.Many):
            return reduce(Column.__and__ if node.op == "and" else Column.__or__, map(self.test, node.parts))
        if isinstance(node, S.Not):
            return ~F.coalesce(self.test(node.of), F.lit(False))
        if isinstance(node, S.Compare):
            return self.compare(node)
        if isinstance(node, S.Field):
            return self.field(node)
        if isinstance(node, S.Flag):
            return self.flag(node)
        if isinstance(node, S.Within):
            return self.within(node)
        if isinstance(node, S.Same):
            return self.same(V.ENTITIES[node.entity], node.of, node.at)
        if isinstance(node, S.Bonded):
            return self.bonded(node)
        return self.sequence(node)

    def compare(self, node: S.Compare) -> Column:
        sides = [self.value(x, node.at) for x in node.operands]
        ops = {"<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__, "=": Column.__eq__, "!=": Column.__ne__}
        return reduce(Column.__and__, [ops[o](a, b) for a, o, b in zip(sides, node.ops, sides[1:])])

    def value(self, node: object, at: int) -> Column:
        if isinstance(node, S.Number):
            return F.lit(node.value)
        if isinstance(node, S.Data):
            if self.kinds[node.name] != "double":
                raise self.error(node.at, f"{node.name} is no number")
            return self.table.column(node.name)
        if isinstance(node, S.Call):
            arg = self.value(node.arg, at)
            return arg * arg if node.name == "sq" else getattr(F, node.name)(arg)
        a, b = self.value(node.left, at), self.value(node.right, at)
        if node.op == "**":
            return F.pow(a, b)
        if node.op in "/%":
            safe = F.when(b == 0, F.raise_error(F.lit("division by zero in selection")).cast("double")).otherwise(b)
            return a / safe if node.op == "/" else a - safe * F.floor(a / safe)  # sign of the divisor
        return {"+": a + b, "-": a - b, "*": a * b}[node.op]

    def field(self, node: S.Field) -> Column:
        col, kind = self.table.column(node.name), self.kinds[node.name]
        tests = [self.text_value(col, v) if kind == "string" else self.number_value(node, col, v) for v in node.values]
        plain = [v for v in node.values if isinstance(v, str) and v != "_"]
        if kind == "string" and len(plain) > 1:  # one membership test
            tests = [col.isin(*plain)] + [self.text_value(col, v) for v in node.values if not isinstance(v, str) or v == "_"]
        return reduce(Column.__or__, tests)

    def text_value(self, col: Column, v: object) -> Column:
        if isinstance(v, S.Pattern):
            return col.rlike(f"^(?:{v.text})")
        return F.coalesce(F.trim(col), F.lit("")) == "" if v == "_" else col == v

    def number_value(self, node: S.Field, col: Column, v: object) -> Column:
        if isinstance(v, S.Range):
            if v.step is not None:
                steps = (col - v.first) / v.step
                return (col >= v.first) & (col < v.last) & (steps == F.floor(steps))
            return (col >= v.first) & ((col <= v.last) if v.kind == "to" else (col < v.last))
        if isinstance(v, S.Pattern):
            raise self.error(node.at, f"{node.name} takes numbers, not a pattern")
        number = S.numeric(v)
        if number is not None:
            return col == number
        if node.name == "resnum" and len(v) > 1 and S.numeric(v[:-1]) is not None and "icode" in self.kinds:
            code = self.table.column("icode")
            mine = F.coalesce(F.trim(code), F.lit("")) == "" if v[-1] == "_" else code == v[-1]
            return (col == float(v[:-1])) & mine
        raise self.error(node.at, f"{v!r} is no number")

    def need(self, name: str, at: int) -> Column:
        if name not in self.kinds:
            raise self.error(at, f"the table has no {name}")
        return self.table.column(name)

    def flag(self, node: S.Flag) -> Column:
        name, flags, at = node.name, self.table.flags, node.at
        if name in self.table.user_flags:
            own = self.table.user_flags[name]
            return F.col(own) if isinstance(own, str) else own
        if name in ("all", "mapped"):
            return F.lit(True)
        if name in ("none", "dummy"):
            return F.lit(False)
        if name == "ca":
            return (self.need("name", at) == "CA") & self.need("resname", at).isin(*sorted(flags.amino_acids()))
        if name in flags.names:
            return self.test(S.Flag("protein", at)) & self.need("name", at).isin(*sorted(flags.names[name]))
        if name in flags.resnames:
            return self.need("resname", at).isin(*sorted(flags.resnames[name]))
        if name in V.CATEGORIES or name in ("charged", "stdaa", "nonstdaa"):
            chosen = self.need("resname", at).isin(*sorted(flags.category(name)))
            return self.same_where("resindex", self.test(S.Flag("ca", at)) & chosen, at)
        if name in flags.patterns:
            return self.need("name", at).rlike(f"^(?:{flags.patterns[name]})") & self.test(S.Not(S.Flag("ion", at)))
        if name in V.SECONDARY_CODES:
            return self.need("secondary", at) == V.SECONDARY_CODES[name]
        if name in _FLAG_TEXT:
            return self.test(self.parse(_FLAG_TEXT[name]))
        return F.col(name)  # a boolean column

    # -- tests that look at other rows: a marker column joined to the table

    def fresh(self) -> str:
        self.count += 1
        return f"_sel{self.count}"

    def mark(self, keys: Sequence[str], chosen: DataFrame) -> Column:
        """True for the rows whose ``keys`` occur in ``chosen``."""
        name = self.fresh()
        other = chosen.select(*[F.col(k).alias(f"{name}_{i}") for i, k in enumerate(keys)], F.lit(True).alias(name))
        on = reduce(Column.__and__, [F.col(k) == F.col(f"{name}_{i}") for i, k in enumerate(keys)])
        self.df = self.df.join(other, on, "left").drop(*[f"{name}_{i}" for i in range(len(keys))])
        return F.coalesce(F.col(name), F.lit(False))

    def same_where(self, entity: str, inside: Column, at: int) -> Column:
        name = self.fresh()
        if entity not in self.kinds and entity == "fragindex":
            raise self.error(at, "fragments need a fragindex column (see bonds.fragments)")
        key = self.need(entity, at)
        chosen = self.df.where(inside).select(*self.table.scope, key.alias(name)).distinct()
        self.df = self.df.withColumn(name, key)
        return self.mark([*self.table.scope, name], chosen)

    def same(self, entity: str, of: object, at: int) -> Column:
        return self.same_where(entity, self.test(of), at)

    def within(self, node: S.Within) -> Column:
        for axis in AXES:
            self.need(axis, node.at)
        table, scope = self.table, list(self.table.scope)
        xyz = [table.column(c).cast("double") for c in AXES]
        if isinstance(node.of, str):
            inside = None
            here = self.df.sparkSession.createDataFrame([tuple(map(float, p)) for p in table.points[node.of]], "b_x double, b_y double, b_z double")
            if scope:
                here = self.df.select(*scope).distinct().crossJoin(F.broadcast(here))
        else:
            inside = self.test(node.of)
            here = self.df.where(inside).select(*scope, *[c.alias("b_" + a) for c, a in zip(xyz, AXES)])
        if node.radius == 0:
            probe = self.df.select(*scope, *table.key, *[c.alias("b_" + a) for c, a in zip(xyz, AXES)])
            hit = probe.join(here.distinct(), [*scope, "b_x", "b_y", "b_z"], "left_semi")
        else:
            probe = self.df.select(*scope, *table.key, *[c.alias("a_" + a) for c, a in zip(xyz, AXES)])
            hit = pairs_within(probe, here.distinct(), node.radius, scope)
        near = self.mark([*scope, *table.key], hit.select(*scope, *table.key).distinct())
        return near & ~F.coalesce(inside, F.lit(False)) if node.without and inside is not None else near

    def bonded(self, node: S.Bonded) -> Column:
        table, scope = self.table, list(self.table.scope)
        if table.bonds is None:
            raise self.error(node.at, "the table has no bonds")
        key = table.key[0]
        ends = table.bonds.select(*scope, "i", "j")
        ends = ends.unionByName(ends.select(*scope, F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
        if not node.hops:
            return F.lit(False)
        found = self.df.where(self.test(node.of)).select(*scope, F.col(key).alias("i")).distinct()
        for _ in range(node.hops):
            step = found.join(ends, [*scope, "i"]).select(*scope, F.col("j").alias("i")).distinct()
            # the excluding form leaves out the atoms it has just come from
            found = step.join(found, [*scope, "i"], "left_anti") if node.without else found.unionByName(step).distinct()
        return self.mark([*scope, key], found.select(*scope, F.col("i").alias(key)))

    def sequence(self, node: S.Sequence) -> Column:
        table, scope = self.table, list(self.table.scope)
        chain, residue = self.need("chindex", node.at), self.need("resindex", node.at)
        calpha = self.df.where(self.test(S.Flag("ca", node.at))).select(*scope, chain.alias("_ch"), residue.alias("_re"), table.column("resname").alias("_rn")).distinct()
        letters = F.create_map(*[F.lit(x) for kv in V.ONE_LETTER.items() for x in kv])
        by = Window.partitionBy(*scope, "_ch").orderBy("_re")
        rows = calpha.select(*scope, "_ch", "_re", F.coalesce(letters[F.col("_rn")], F.lit("X")).alias("_one")).withColumn("_pos", F.row_number().over(by))
        chains = rows.groupBy(*scope, "_ch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_one"))), lambda s: s["_one"]), "").alias("_seq"))
        hits = None
        for p in node.patterns:
            between, whole = F.split("_seq", p.text, -1), F.regexp_extract_all("_seq", F.lit(p.text), F.lit(0))
            spans = chains.select(*scope, "_ch", F.posexplode(whole).alias("_k", "_m"), between.alias("_b"), whole.alias("_w"))
            length = lambda c: F.aggregate(c, F.lit(0), lambda acc, s: acc + F.length(s))
            first = length(F.slice("_b", 1, F.col("_k") + 1)) + length(F.slice("_w", 1, F.col("_k"))) + 1
            each = spans.where(F.length("_m") > 0).select(*scope, "_ch", F.explode(F.sequence(first, first + F.length("_m") - 1)).alias("_pos"))
            hits = each if hits is None else hits.unionByName(each)
        residues = rows.join(hits.distinct(), [*scope, "_ch", "_pos"]).select(*scope, "_re").distinct()
        name = self.fresh()
        self.df = self.df.withColumn(name, residue)
        return self.mark([*scope, name], residues.select(*scope, F.col("_re").alias(name)))


def select(table: AtomTable, text: str, **points: Sequence) -> DataFrame:
    """The rows of ``table`` that the query selects; columns unchanged.

    ``points`` are coordinates a query can name, as in ``within 5 of centre``:
    one (x, y, z) or several. Two-valued logic: a test on a null is false and
    its negation true.
    """
    c, chosen = _compiled(table, text, points)
    return c.df.where(chosen).select(*table.df.columns)


def flagged(table: AtomTable, text: str, name: str = "_selected", **points: Sequence) -> DataFrame:
    """The whole table with a boolean column: whether the query selects the row."""
    c, chosen = _compiled(table, text, points)
    return c.df.withColumn(name, F.coalesce(chosen, F.lit(False))).select(*table.df.columns, name)


def _compiled(table: AtomTable, text: str, points: Mapping[str, Sequence]) -> tuple[Compiler, Column]:
    named = {k: ([v] if len(v) and not hasattr(v[0], "__len__") else v) for k, v in points.items()}
    clash = set(named) & set(reserved_words())
    if clash:
        raise ValueError(f"reserved words: {sorted(clash)}")
    c = Compiler(replace(table, points={**table.points, **named}), text)
    return c, c.test(c.parse(text))


def uses_coordinates(text: str) -> bool:
    """Whether a query depends on coordinates."""
    words = {t.text for t in S.tokens(text) if t.kind == "word"}
    return bool(words & {"x", "y", "z", "within", "exwithin"})


def intersection(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return a.join(b.select(*key).distinct(), list(key), "left_semi")


def union(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return a.unionByName(b.join(a.select(*key), list(key), "left_anti"))


def complement(whole: DataFrame, a: DataFrame, key: Sequence[str]) -> DataFrame:
    return whole.join(a.select(*key).distinct(), list(key), "left_anti")


def contains(a: DataFrame, b: DataFrame, key: Sequence[str]) -> bool:
    """Whether every row of ``b`` is one of ``a``."""
    return b.select(*key).join(a.select(*key), list(key), "left_anti").isEmpty()


def concatenation(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """Ordered union that keeps repeats: ``position`` numbers the rows of ``a`` and then those of ``b``."""
    tagged = a.withColumn("_part", F.lit(0)).unionByName(b.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    return tagged.withColumn("position", F.row_number().over(Window.orderBy("_part", order)) - 1).drop("_part")
