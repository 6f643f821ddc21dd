"""Readers and writers of structure files: PDB, PQR, mmCIF, PSF, STAR.

Files are read with Spark's text source, one row a line with the file's name,
so any number of files is read in parallel; fixed-width fields become
substrings, and model numbers and column maps come from windows over a file's
lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.operators.records import from_hybrid36, to_hybrid36


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(``file``, ``line_no`` from 0, ``line``): whole files split into lines, so that numbers never depend on partitions."""
    paths = [path] if isinstance(path, str) else list(path)
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def _cut(first: int, last: int) -> Column:
    """Columns ``first`` to ``last`` (from 1) without blanks."""
    return F.trim(F.substring("line", first, last - first + 1))


def _number(c: Column) -> Column:
    return c.try_cast("double")


def read_pdb(
    spark: SparkSession, path: str | Sequence[str], model: int | None = None, chain: str | None = None, subset: str | None = None, altloc: str | None = "A",
) -> DataFrame:
    """Atom rows: structure_id, cset, atom_index, serial, name, altloc, resname, chain, resnum, icode, x, y, z, occupancy, beta, segment, element, charge, hetatm, anisou.

    ``model`` reads one model (from 1), ``chain`` the listed chains, ``subset``
    ``ca`` or ``bb``; ``altloc`` keeps that alternate location beside blank
    ones (None: all). ``cset`` counts models from 0.
    """
    lines = numbered_lines(spark, path)
    record = F.rtrim(F.substring("line", 1, 6))
    kept = lines.where(record.isin("ATOM", "HETATM", "MODEL", "ANISOU")).withColumn("rec", record)
    by = Window.partitionBy("file").orderBy("line_no")
    kept = kept.withColumn("_m", F.sum((F.col("rec") == "MODEL").cast("int")).over(by))
    kept = kept.withColumn("cset", F.greatest(F.col("_m") - 1, F.lit(0)).cast("int"))
    an = F.when((F.lead("rec").over(by) == "ANISOU"), F.lead("line").over(by))
    six = F.array(*[(F.trim(F.substring(an, 29 + 7 * k, 7)).try_cast("double") / 10000.0) for k in range(6)])
    atoms = kept.withColumn("anisou", F.when(an.isNotNull(), six)).where("rec in ('ATOM', 'HETATM')")
    atoms = atoms.select(
        "file", "line_no", "cset",
        from_hybrid36(_cut(7, 11)).cast("int").alias("serial"),
        _cut(13, 16).alias("name"), _cut(17, 17).alias("altloc"), _cut(18, 21).alias("resname"), _cut(22, 22).alias("chain"),
        from_hybrid36(_cut(23, 26), 4).cast("int").alias("resnum"), _cut(27, 27).alias("icode"),
        _number(_cut(31, 38)).alias("x"), _number(_cut(39, 46)).alias("y"), _number(_cut(47, 54)).alias("z"),
        F.coalesce(_number(_cut(55, 60)), F.lit(1.0)).alias("occupancy"), F.coalesce(_number(_cut(61, 66)), F.lit(0.0)).alias("beta"),
        _cut(73, 76).alias("segment"), _cut(77, 78).alias("element"), _cut(79, 80).alias("charge"),
        (F.col("rec") == "HETATM").alias("hetatm"), "anisou",
    )
    if model is not None:
        atoms = atoms.where(F.col("cset") == model - 1)
    if chain is not None:
        atoms = atoms.where(F.col("chain").isin(*chain))
    if subset is not None:
        atoms = atoms.where(F.col("name").isin(*{"ca": ("CA",), "bb": ("CA", "C", "N", "O")}[subset]))
    if altloc is not None:
        atoms = atoms.where(F.col("altloc").isin("", altloc))
    order = Window.partitionBy("file", "cset").orderBy("line_no")
    name = F.regexp_extract("file", r"([^/]+?)(?:\.(?:pdb|ent))?$", 1)
    return atoms.withColumns({"atom_index": F.row_number().over(order) - 1, "structure_id": name}).select(
        "structure_id", "cset", "atom_index", *[c for c in atoms.columns if c not in ("file", "line_no", "cset")]
    )


def pdb_line() -> Column:
    """An atom row as a fixed-width line."""
    name = F.when((F.length("name") >= 4) | (F.length(F.coalesce("element", F.lit(""))) > 1), F.rpad("name", 4, " ")).otherwise(F.rpad(F.concat(F.lit(" "), "name"), 4, " "))
    num = lambda c, w, d: F.lpad(F.format_string(f"%.{d}f", F.col(c)), w, " ")
    text = lambda c, w: F.lpad(F.coalesce(c, F.lit("")), w, " ")
    return F.concat(
        F.when(F.col("hetatm"), "HETATM").otherwise("ATOM  "), F.lpad(to_hybrid36(F.col("serial").cast("long")), 5, " "), F.lit(" "), name, text("altloc", 1),
        F.lpad("resname", 3, " "), F.when(F.length("resname") > 3, "").otherwise(" "), text("chain", 1), F.lpad(to_hybrid36(F.col("resnum").cast("long"), 4), 4, " "), text("icode", 1), F.lit("   "),
        num("x", 8, 3), num("y", 8, 3), num("z", 8, 3), num("occupancy", 6, 2), num("beta", 6, 2), F.lit("      "),
        F.rpad(F.coalesce("segment", F.lit("")), 4, " "), text("element", 2), text("charge", 2),
    )


def write_pdb(atoms: DataFrame, path: str) -> None:
    """One text file a structure, models between MODEL and ENDMDL lines if there are several."""
    several = Window.partitionBy("structure_id")
    rows = atoms.withColumn("_many", F.max("cset").over(several) > 0).select("structure_id", "cset", "atom_index", pdb_line().alias("line"), "_many")
    ends = rows.where("_many").select("structure_id", "cset").distinct()
    first = ends.select("structure_id", "cset", F.lit(-1).alias("atom_index"), F.concat(F.lit("MODEL     "), F.lpad((F.col("cset") + 1).cast("string"), 4, " ")).alias("line"))
    last = ends.select("structure_id", "cset", F.lit(2**31 - 1).alias("atom_index"), F.lit("ENDMDL").alias("line"))
    end = atoms.groupBy("structure_id").agg(F.max("cset").alias("cset")).select("structure_id", (F.col("cset") + 1).alias("cset"), F.lit(0).alias("atom_index"), F.lit("END").alias("line"))
    out = rows.drop("_many").unionByName(first).unionByName(last).unionByName(end)
    out.repartition("structure_id").sortWithinPartitions("structure_id", "cset", "atom_index").select("structure_id", "line").write.partitionBy("structure_id").text(path)


def read_pqr(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Atoms with charge and radius; fields parted by blanks, the chain may be left out."""
    lines = numbered_lines(spark, path).where(F.col("line").rlike("^(ATOM|HETATM)"))
    f = lines.withColumn("f", F.split(F.trim("line"), r"\s+")).withColumn("k", F.size("f") - 10)
    at = lambda i: F.try_element_at("f", F.lit(i + 1) + F.when(F.lit(i > 3), F.col("k")).otherwise(F.lit(0)))
    by = Window.partitionBy("file").orderBy("line_no")
    return f.select(
        F.regexp_extract("file", r"([^/]+?)(?:\.pqr)?$", 1).alias("structure_id"), (F.row_number().over(by) - 1).alias("atom_index"), at(1).try_cast("int").alias("serial"),
        at(2).alias("name"), at(3).alias("resname"), F.when(F.col("k") > 0, F.col("f")[4]).otherwise("").alias("chain"), at(4).try_cast("int").alias("resnum"),
        *[at(5 + i).try_cast("double").alias(c) for i, c in enumerate(("x", "y", "z", "charge", "radius"))], (at(0) == "HETATM").alias("hetatm"),
    )


def write_pqr(atoms: DataFrame, path: str) -> None:
    """One PQR text file a structure; fields are parted by blanks, so what outgrows its columns stays whole."""
    wide = lambda c, w, pad: F.when(F.length(c) < w, pad(c, w, " ")).otherwise(c)
    num = lambda c, w, d: wide(F.format_string(f"%.{d}f", F.col(c)), w, F.lpad)
    line = F.concat_ws(
        " ", F.when(F.col("hetatm"), "HETATM").otherwise("ATOM  "), wide(F.col("serial").cast("string"), 5, F.lpad), wide(F.col("name"), 4, F.rpad), wide(F.col("resname"), 4, F.rpad),
        F.when(F.col("chain") == "", F.lit(None)).otherwise(F.col("chain")), wide(F.col("resnum").cast("string"), 4, F.lpad),
        num("x", 8, 3), num("y", 8, 3), num("z", 8, 3), num("charge", 8, 4), num("radius", 7, 4),
    )
    atoms.select("structure_id", "atom_index", line.alias("line")).repartition("structure_id").sortWithinPartitions("structure_id", "atom_index").select("structure_id", "line").write.partitionBy("structure_id").text(path)


#: mmCIF items and the fields they fill.
CIF_ITEMS = {
    "group_PDB": "group", "id": "serial", "type_symbol": "element", "auth_atom_id": "name", "label_alt_id": "altloc", "auth_comp_id": "resname", "auth_asym_id": "chain",
    "label_asym_id": "segment", "auth_seq_id": "resnum", "pdbx_PDB_ins_code": "icode", "Cartn_x": "x", "Cartn_y": "y", "Cartn_z": "z", "occupancy": "occupancy",
    "B_iso_or_equiv": "beta", "pdbx_formal_charge": "charge", "pdbx_PDB_model_num": "model",
}
_CIF_ELSE = {"name": "label_atom_id", "resname": "label_comp_id", "chain": "label_asym_id", "resnum": "label_seq_id"}
_WORDS = r"""'(?:[^']|'(?=\S))*'(?=\s|$)|"(?:[^"]|"(?=\S))*"(?=\s|$)|[^\s]+"""


def _words(line: Column) -> Column:
    """A line's values, quotation marks taken off."""
    return F.transform(F.regexp_extract_all(line, F.lit(f"({_WORDS})"), F.lit(1)), lambda w: F.regexp_replace(w, r"""^(['"])(.*)\1$""", "$2"))


def read_loops(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """STAR and mmCIF loops in long form: (``file``, ``block``, ``loop``, ``row``, ``item``, ``value``); rows stand on one line each."""
    lines = numbered_lines(spark, path).withColumn("line", F.trim("line")).where("line <> '' and not line like '#%'")
    by = Window.partitionBy("file").orderBy("line_no")
    head = F.col("line") == "loop_"
    data = F.col("line").startswith("data_")
    item = F.col("line").startswith("_")
    marked = lines.withColumns(
        {
            "block": F.last(F.when(data, F.substring("line", 6, 200)), ignorenulls=True).over(by),
            "loop": F.sum((head | data).cast("int")).over(by),
            "is_loop": F.last(F.when(head, True).when(data, False), ignorenulls=True).over(by),
        }
    ).where(~head & ~data)
    single = marked.where(~F.coalesce("is_loop", F.lit(False)) & item).select(
        "file", "block", "loop", F.lit(0).cast("long").alias("row"), F.substring(F.regexp_extract("line", r"^(_\S+)", 1), 2, 200).alias("item"), _words(F.regexp_extract("line", r"^_\S+\s+(.*)$", 1))[0].alias("value")
    )
    looped = marked.where("is_loop")
    names = looped.where(item).groupBy("file", "loop").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda s: F.substring(F.split(s["line"], r"\s")[0], 2, 200)).alias("items"))
    row = Window.partitionBy("file", "loop").orderBy("line_no")
    values = looped.where(~item).withColumn("row", F.row_number().over(row).cast("long") - 1).select("file", "block", "loop", "row", _words(F.col("line")).alias("words"))
    long = values.join(names, ["file", "loop"]).select("file", "block", "loop", "row", F.explode(F.arrays_zip("items", "words")).alias("z"))
    return single.unionByName(long.select("file", "block", "loop", "row", F.col("z.items").alias("item"), F.col("z.words").alias("value")).where("item is not null"))


def read_mmcif(spark: SparkSession, path: str | Sequence[str], model: int | None = None, chain: str | None = None) -> DataFrame:
    """The atom sites of mmCIF files with the columns of :func:`read_pdb` (without anisou)."""
    sites = read_loops(spark, path).where(F.col("item").startswith("atom_site.")).withColumn("item", F.substring("item", 11, 100))
    wanted = list({**CIF_ITEMS, **{v: v for v in _CIF_ELSE.values()}})
    wide = sites.groupBy("file", "loop", "row").pivot("item", wanted).agg(F.first("value"))
    plain = lambda c: F.when(F.col(c).isin(".", "?"), "").otherwise(F.col(c))
    of = {field: F.coalesce(plain(i), plain(_CIF_ELSE[field])) if field in _CIF_ELSE else F.coalesce(plain(i), F.lit("")) for i, field in CIF_ITEMS.items()}
    atoms = wide.select(
        F.regexp_extract("file", r"([^/]+?)(?:\.cif)?$", 1).alias("structure_id"), "file", "loop", "row",
        (F.dense_rank().over(Window.partitionBy("file").orderBy(of["model"].try_cast("int"))) - 1).alias("cset"), of["model"].try_cast("int").alias("model"),
        *[of[c].alias(c) for c in ("name", "altloc", "resname", "chain", "icode", "segment", "element", "charge")],
        *[of[c].try_cast("int").alias(c) for c in ("serial", "resnum")],
        *[of[c].try_cast("double").alias(c) for c in ("x", "y", "z", "occupancy", "beta")], (of["group"] == "HETATM").alias("hetatm"),
    )
    if model is not None:
        atoms = atoms.where(F.col("model") == model)
    if chain is not None:
        atoms = atoms.where(F.col("chain").isin(*chain))
    by = Window.partitionBy("file", "cset").orderBy("loop", "row")  # files in different folders may share a name
    return atoms.withColumn("atom_index", F.row_number().over(by) - 1).drop("file", "loop", "row", "model")


def write_mmcif(atoms: DataFrame, path: str) -> None:
    """One mmCIF text file a structure, with its atom sites."""
    items = list(CIF_ITEMS)
    header = F.array(*[F.lit(h) for h in ("loop_", *[f"_atom_site.{i}" for i in items])])
    quoted = lambda c: F.when(F.coalesce(c, F.lit("")) == "", ".").when(c.rlike(r"\s|'"), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)
    value = {f: F.col(f).cast("string") if f in atoms.columns else F.lit(None).cast("string") for f in CIF_ITEMS.values()}
    value["group"] = F.when(F.col("hetatm"), "HETATM").otherwise("ATOM")
    value["model"] = (F.col("cset") + 1).cast("string")
    row = atoms.select("structure_id", F.col("cset").alias("a"), F.col("atom_index").alias("b"), F.concat_ws(" ", *[quoted(value[CIF_ITEMS[i]]) for i in items]).alias("line"))
    head = atoms.select("structure_id").distinct().select("structure_id", F.lit(-1).alias("a"), F.posexplode(F.concat(F.array(F.concat(F.lit("data_"), "structure_id")), header)).alias("b", "line"))
    head.unionByName(row).repartition("structure_id").sortWithinPartitions("structure_id", "a", "b").select("structure_id", "line").write.partitionBy("structure_id").text(path)


def write_loops(rows: DataFrame, path: str) -> None:
    """STAR text from the long form of :func:`read_loops`, one file a ``file``."""
    quoted = F.when(F.col("value").rlike(r"\s") | (F.col("value") == ""), F.concat(F.lit("'"), "value", F.lit("'"))).otherwise(F.col("value"))
    each = rows.groupBy("file", "block", "loop", "row").agg(F.sort_array(F.collect_list(F.struct("item", quoted.alias("v")))).alias("s"))
    lines = each.select("file", "block", "loop", "row", F.array_join(F.transform("s", lambda s: s["v"]), " ").alias("line"))
    names = each.groupBy("file", "block", "loop").agg(F.min(F.transform("s", lambda s: s["item"])).alias("items"))
    head = names.select("file", "block", "loop", F.posexplode(F.concat(F.array(F.concat(F.lit("data_"), F.coalesce("block", F.lit(""))), F.lit("loop_")), F.transform("items", lambda i: F.concat(F.lit("_"), i)))).alias("k", "line"))
    out = head.select("file", "loop", (F.col("k") - 10_000).cast("long").alias("row"), "line").unionByName(lines.select("file", "loop", "row", "line"))
    out.withColumn("file", F.regexp_extract("file", r"([^/]+)$", 1)).repartition("file").sortWithinPartitions("file", "loop", "row").select("file", "line").write.partitionBy("file").text(path)


def read_psf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A topology's atoms and its bonds (``i``, ``j``: atom indices)."""
    lines = numbered_lines(spark, path)
    by = Window.partitionBy("file").orderBy("line_no")
    part = F.regexp_extract("line", r"!(N[A-Z]+)", 1)
    marked = lines.withColumn("_p", F.last(F.when(part != "", part), ignorenulls=True).over(by)).where(part == "").where(F.trim("line") != "")
    f = lambda i: F.col("f")[i]
    atoms = marked.where("_p = 'NATOM'").withColumn("f", F.split(F.trim("line"), r"\s+")).select(
        "file", (f(0).cast("int") - 1).alias("atom_index"), f(0).cast("int").alias("serial"), f(1).alias("segment"), f(2).cast("int").alias("resnum"), f(3).alias("resname"), f(4).alias("name"), f(5).alias("type"), f(6).cast("double").alias("charge"), f(7).cast("double").alias("mass")
    )
    numbers = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("int"))
    flat = marked.where("_p = 'NBOND'").withColumn("n", numbers)
    pairs = F.transform(F.sequence(F.lit(0), F.size("n") - 2, F.lit(2)), lambda k: F.struct(F.least(F.get("n", k), F.get("n", k + 1)).alias("i"), F.greatest(F.get("n", k), F.get("n", k + 1)).alias("j")))
    bonds = flat.select("file", F.explode(pairs).alias("b")).select("file", (F.col("b.i") - 1).alias("i"), (F.col("b.j") - 1).alias("j")).distinct()
    return atoms, bonds


def header_ranges(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Secondary structure of PDB headers: (``structure_id``, ``chain``, ``resnum``, ``icode``, ``code``) of every listed residue."""
    lines = numbered_lines(spark, path).where(F.col("line").rlike("^(HELIX|SHEET)"))
    helix = F.col("line").startswith("HELIX")
    cut = lambda a, b: F.trim(F.substring("line", a, b - a + 1))
    kinds = F.create_map(*[F.lit(x) for kv in {"1": "H", "3": "I", "5": "G"}.items() for x in kv])
    rows = lines.select(
        F.regexp_extract("file", r"([^/]+?)(?:\.(?:pdb|ent))?$", 1).alias("structure_id"),
        F.when(helix, cut(20, 20)).otherwise(cut(22, 22)).alias("chain"),
        F.when(helix, cut(22, 25)).otherwise(cut(23, 26)).try_cast("int").alias("a"), F.when(helix, cut(34, 37)).otherwise(cut(34, 37)).try_cast("int").alias("b"),
        F.when(helix, F.coalesce(kinds[cut(39, 40)], F.lit("H"))).otherwise("E").alias("code"),
    )
    return rows.where("a <= b").select("structure_id", "chain", F.explode(F.sequence("a", "b")).alias("resnum"), F.lit("").alias("icode"), "code").dropDuplicates(["structure_id", "chain", "resnum"])


def files_by_name(spark: SparkSession, path: str, pattern: str = r"\.(pdb|ent|cif)(\.gz)?$") -> DataFrame:
    """(``name``, ``path``, ``size``) of structure files below a folder."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    return listed.where(F.col("path").rlike(pattern)).select(F.lower(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"^pdb|\..*$", "")).alias("name"), "path", "size")
