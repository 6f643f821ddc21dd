"""Text and binary sources of numbers: matrices, contact maps, modes, trajectories, ontologies."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.session import workers_find_package
from strandlake.sources.structures import numbered_lines


def read_array(spark: SparkSession, path: str, sep: str = r"\s+", skip: int = 0) -> DataFrame:
    """A delimited numeric table in long form: (``i``, ``j``, ``value``), both from 0."""
    lines = numbered_lines(spark, path).where((F.col("line_no") >= skip) & ~F.col("line").rlike(r"^\s*(#.*)?$"))
    by = Window.partitionBy("file").orderBy("line_no")
    rows = lines.withColumn("i", F.row_number().over(by) - 1)
    return rows.select("i", F.posexplode(F.split(F.trim("line"), sep)).alias("j", "v")).select("i", "j", F.col("v").try_cast("double").alias("value"))


def write_array(matrix: DataFrame, path: str, places: int = 2, sep: str = " ") -> None:
    """Rows of a dense matrix as lines, one file."""
    cell = F.sort_array(F.collect_list(F.struct("j", F.format_string(f"%.{places}f", "value").alias("t"))))
    rows = matrix.groupBy("i").agg(cell.alias("s")).select("i", F.array_join(F.transform("s", lambda s: s["t"]), sep).alias("line"))
    rows.repartition(1).sortWithinPartitions("i").select("line").write.text(path)


def read_triples(spark: SparkSession, path: str, sep: str = r"\s+", first: int = 1, symmetric: bool = False) -> DataFrame:
    """(``i``, ``j``, ``value``) from lines of row, column and value; indices made to start at 0, the mirror added if wanted."""
    f = F.split(F.trim("value"), sep)
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$")).select((f[0].cast("long") - first).alias("i"), (f[1].cast("long") - first).alias("j"), f[2].cast("double").alias("value"))
    return rows.unionByName(rows.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value")) if symmetric else rows


def write_triples(matrix: DataFrame, path: str, sep: str = " ", first: int = 1) -> None:
    matrix.select(F.concat_ws(sep, (F.col("i") + first).cast("string"), (F.col("j") + first).cast("string"), F.col("value").cast("string")).alias("line")).write.text(path)


def read_contact_map(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """A contact map: three columns are (locus, locus, count), binned by ``width``; more are a dense matrix. Repeats add up."""
    line = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$")).first()
    sep = r"[\s,;]+"
    if line is None or len([x for x in line["value"].replace(",", " ").replace(";", " ").split()]) != 3:
        return read_array(spark, path, sep).where("value <> 0")
    from strandlake.operators.matrices import binned

    f = F.split(F.trim("value"), sep)
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$")).select(f[0].cast("long").alias("a"), f[1].cast("long").alias("b"), f[2].cast("double").alias("c"))
    return binned(rows, "a", "b", width or 1, "c")


def read_modes(spark: SparkSession, path: str) -> DataFrame:
    """Modes of NMD text: (``mode``, ``variance``, ``node``, ``axis``, ``v``); the number after ``mode`` and its scale come first."""
    lines = numbered_lines(spark, path).where(F.col("line").startswith("mode "))
    f = F.transform(F.slice(F.split(F.trim("line"), r"\s+"), 2, 1_000_000), lambda x: x.cast("double"))
    rows = lines.select(f.alias("f")).withColumn("lead", F.size("f") % 3)
    n = F.when(F.col("lead") >= 1, F.col("f")[0].cast("int")).otherwise(F.lit(1))
    scale = F.when(F.col("lead") == 2, F.col("f")[1]).otherwise(F.lit(1.0))
    each = rows.select((n - 1).alias("mode"), (scale * scale).alias("variance"), F.posexplode(F.slice("f", F.col("lead") + 1, F.size("f"))).alias("k", "v"))
    return each.select("mode", "variance", F.floor(F.col("k") / 3).cast("int").alias("node"), (F.col("k") % 3).cast("int").alias("axis"), "v")


def write_modes(modes: DataFrame, atoms: DataFrame, path: str, name: str = "model") -> None:
    """NMD text of modes (node, axis, v) on atoms (atom_index, name, resname, chain, resnum, x, y, z)."""
    join = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("atom_index", F.col(c).cast("string").alias("t")))), lambda s: s["t"]), " ")
    xyz = F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("atom_index", F.array(*[F.format_string("%.3f", c) for c in "xyz"]).alias("t")))), lambda s: s["t"])), " ")
    facts = atoms.agg(join("name").alias("atomnames"), join("resname").alias("resnames"), join("chain").alias("chainids"), join("resnum").alias("resids"), xyz.alias("coordinates"))
    head = facts.select(F.posexplode(F.array(F.lit(f"name {name}"), *[F.concat(F.lit(f"{c} "), c) for c in facts.columns])).alias("k", "line"))
    v = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "axis", F.format_string("%.6f", "v").alias("t")))), lambda s: s["t"]), " ")
    body = modes.groupBy("mode").agg(F.max("variance").alias("s"), v.alias("v")).select((F.col("mode") + 100).alias("k"), F.concat_ws(" ", F.lit("mode"), (F.col("mode") + 1).cast("string"), F.format_string("%.6f", F.sqrt("s")), "v").alias("line"))
    head.unionByName(body).repartition(1).sortWithinPartitions("k").select("line").write.text(path)


def read_dcd(spark: SparkSession, path: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Frames of binary trajectories: (``file``, ``frame``, ``unitcell``, ``xyz`` as array of [x, y, z]); either byte order."""
    workers_find_package(spark)

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                end = "<" if struct.unpack_from("<i", raw, 0)[0] == 84 else ">"
                head = struct.unpack_from(f"{end}4s20i", raw, 4)
                has_cell = bool(head[11])
                at = 92
                at += 8 + struct.unpack_from(f"{end}i", raw, at)[0]
                n = struct.unpack_from(f"{end}i", raw, at + 4)[0]
                at += 12
                k, out = 0, []
                while at < len(raw) and (stop is None or k < stop):
                    cell = None
                    if has_cell:
                        cell = list(np.frombuffer(raw, f"{end}f8", 6, at + 4))
                        at += 56
                    xyz = np.stack([np.frombuffer(raw, f"{end}f4", n, at + 4 + d * (4 * n + 8)) for d in range(3)], axis=1)
                    at += 3 * (4 * n + 8)
                    if k >= start and (k - start) % step == 0:
                        out.append((name, k, cell, [list(map(float, p)) for p in xyz]))
                    k += 1
                yield pd.DataFrame(out, columns=["file", "frame", "unitcell", "xyz"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(frames, "file string, frame int, unitcell array<double>, xyz array<array<double>>")


def dcd_bytes(xyz: np.ndarray, cell: Sequence[float] | None = None) -> bytes:
    """A little-endian trajectory of frames (frames, atoms, 3) in 32 bits."""
    frames, n, _ = xyz.shape
    block = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
    control = [frames, 0, 1, frames, 0, 0, 0, 0, 0, 0, int(cell is not None)] + [0] * 8 + [24]
    out = [block(b"CORD" + struct.pack("<9i", *control[:9]) + struct.pack("<f", 1.0) + struct.pack("<i", control[10]) + struct.pack("<9i", *control[11:])), block(struct.pack("<i", 1) + b"frames".ljust(80)), block(struct.pack("<i", n))]
    for f in xyz:
        if cell is not None:
            out.append(block(np.asarray(cell, "<f8").tobytes()))
        out += [block(f[:, d].astype("<f4").tobytes()) for d in range(3)]
    return b"".join(out)


def frame_atoms(frames: DataFrame) -> DataFrame:
    """Frames in long form: (``file``, ``frame``, ``atom_index``, ``x``, ``y``, ``z``)."""
    each = frames.select("file", "frame", F.posexplode("xyz").alias("atom_index", "p"))
    return each.select("file", "frame", "atom_index", *[F.col("p")[k].alias(c) for k, c in enumerate("xyz")])


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An ontology's terms (``id``, ``name``, ``namespace``) and is-a edges (``child``, ``parent``); obsolete terms left out."""
    lines = numbered_lines(spark, path)
    by = Window.partitionBy("file").orderBy("line_no")
    lines = lines.withColumn("t", F.sum(F.col("line").startswith("[").cast("int")).over(by)).withColumn("kind", F.last(F.when(F.col("line").startswith("["), F.col("line")), ignorenulls=True).over(by)).where("kind = '[Term]'")
    tag, value = F.regexp_extract("line", r"^(\w+): ", 1), F.regexp_extract("line", r"^\w+: ([^!]*?)\s*(!.*)?$", 1)
    rows = lines.select("t", tag.alias("tag"), value.alias("value")).where("tag <> ''")
    one = lambda n: F.first(F.when(F.col("tag") == n, F.col("value")), ignorenulls=True)
    terms = rows.groupBy("t").agg(one("id").alias("id"), one("name").alias("name"), one("namespace").alias("namespace"), one("is_obsolete").alias("o")).where("o is null or o <> 'true'")
    edges = rows.where("tag = 'is_a'").join(terms.select("t", "id"), "t").select(F.col("id").alias("child"), F.col("value").alias("parent"))
    return terms.drop("t", "o"), edges


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """Annotation rows: database, id, symbol, qualifier, term, evidence, aspect."""
    f = F.split("value", "\t")
    at = {"database": 0, "id": 1, "symbol": 2, "qualifier": 3, "term": 4, "evidence": 6, "aspect": 8}
    return spark.read.text(path).where("not value like '!%'").select(*[f[i].alias(n) for n, i in at.items()])


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """Trees as edges: (``file``, ``child``, ``parent``, ``length``, ``name``); nodes numbered in order of reading, 0 the root."""
    workers_find_package(spark)

    def edges(text: str) -> list[tuple]:
        import re

        out, stack, count, node = [], [], 0, 0
        out.append([0, None, None, ""])
        for t in re.findall(r"[(),;]|:[^(),;]+|[^(),:;\s]+", text):
            if t == "(" or t == ",":
                if t == "(":
                    stack.append(node)
                count += 1
                node = count
                out.append([node, stack[-1], None, ""])
            elif t == ")":
                node = stack.pop()
            elif t.startswith(":"):
                out[node][2] = float(t[1:])
            elif t != ";":
                out[node][3] = t
        return [tuple(o) for o in out]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, *e) for f, v in zip(pdf["file"], pdf["value"]) for e in edges(v)]
            yield pd.DataFrame(rows, columns=["file", "child", "parent", "length", "name"]).astype({"parent": "Int64"})

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.mapInPandas(read, "file string, child long, parent long, length double, name string")


def save(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A snapshot as Parquet, parted by columns such as the structure."""
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
