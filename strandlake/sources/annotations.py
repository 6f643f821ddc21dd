"""Density maps, per-residue annotations and heat maps."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.session import workers_find_package
from strandlake.sources.structures import numbered_lines


def read_density(spark: SparkSession, path: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Voxels of MRC / CCP4 maps: (``file``, ``i``, ``j``, ``k``, ``x``, ``y``, ``z``, ``density``), those within the cutoffs.

    Axes are put in x, y, z order; densities of 8, 16 or 32 bits are read.
    """
    workers_find_package(spark)

    def voxels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                h = struct.unpack_from("<10i6f3i", raw, 0)
                shape, mode, first, grid, cell, axes = h[:3], h[3], h[4:7], h[7:10], h[10:13], h[16:19]
                origin = struct.unpack_from("<3f", raw, 196)
                skip = 1024 + struct.unpack_from("<i", raw, 92)[0]
                kind = {0: "<i1", 1: "<i2", 2: "<f4", 6: "<u2"}[mode]
                data = np.frombuffer(raw, kind, shape[0] * shape[1] * shape[2], skip).reshape(shape[::-1]).astype(float)
                where = [axes.index(a) for a in (1, 2, 3)]  # which of column, row, section runs along x, y, z
                data = data.transpose(*[2 - w for w in where])
                keep = np.ones(data.shape, bool)
                if low is not None:
                    keep &= data >= low
                if high is not None:
                    keep &= data <= high
                at = np.argwhere(keep)
                start = np.array([first[w] for w in where])
                xyz = (at + start) * (np.array(cell) / np.array(grid)) + np.array(origin)
                yield pd.DataFrame({"file": name, **{c: at[:, n].astype(np.int32) for n, c in enumerate("ijk")}, **{c: xyz[:, n] for n, c in enumerate("xyz")}, "density": data[keep]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(voxels, "file string, i int, j int, k int, x double, y double, z double, density double")


def density_bytes(data: np.ndarray, voxel: float = 1.0, origin: Sequence[float] = (0.0, 0.0, 0.0)) -> bytes:
    """An MRC file of a (x, y, z) grid in 32 bits."""
    n = data.shape
    head = struct.pack("<10i6f3i", *n, 2, 0, 0, 0, *n, *[voxel * k for k in n], 90, 90, 90, 1, 2, 3)
    head = head.ljust(196, b"\0") + struct.pack("<3f", *origin) + b"MAP " + b"\x44\x44\0\0"
    return head.ljust(1024, b"\0") + np.ascontiguousarray(data.transpose(2, 1, 0), "<f4").tobytes()


def thresholded(voxels: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Densities outside the cutoffs made 0."""
    d = F.col("density")
    inside: Column = F.lit(True)
    if low is not None:
        inside = inside & (d >= low)
    if high is not None:
        inside = inside & (d <= high)
    return voxels.withColumn("density", F.when(inside, d).otherwise(0.0))


def read_dssp(spark: SparkSession, path: str) -> DataFrame:
    """(``file``, chain, resnum, icode, ``code``, ``accessible``, ``phi``, ``psi``) of the residue lines."""
    lines = numbered_lines(spark, path)
    by = Window.partitionBy("file").orderBy("line_no")
    body = lines.withColumn("_b", F.max(F.col("line").rlike(r"^\s*#\s+RESIDUE").cast("int")).over(by)).where("_b = 1")
    body = body.where(F.substring("line", 6, 5).rlike(r"\d"))
    cut = lambda a, b: F.trim(F.substring("line", a, b - a + 1))
    code = F.when(cut(17, 17) == "", "C").otherwise(cut(17, 17))
    return body.select("file", cut(12, 12).alias("chain"), cut(6, 10).cast("int").alias("resnum"), cut(11, 11).alias("icode"), code.alias("code"), cut(35, 38).try_cast("double").alias("accessible"), cut(104, 109).try_cast("double").alias("phi"), cut(110, 115).try_cast("double").alias("psi"))


def read_stride(spark: SparkSession, path: str) -> DataFrame:
    """(``file``, chain, resnum, icode, ``code``, ``phi``, ``psi``, ``accessible``) of ASG lines."""
    f = F.split(F.trim("line"), r"\s+")
    rows = numbered_lines(spark, path).where(F.col("line").startswith("ASG")).withColumn("f", f)
    num = F.regexp_extract(F.col("f")[3], r"^(-?\d+)", 1).cast("int")
    chain = F.when(F.col("f")[2] == "-", "").otherwise(F.col("f")[2])
    return rows.select("file", chain.alias("chain"), num.alias("resnum"), F.regexp_extract(F.col("f")[3], r"([A-Za-z]?)$", 1).alias("icode"), F.upper(F.col("f")[5]).alias("code"), *[F.col("f")[k].cast("double").alias(n) for k, n in ((7, "phi"), (8, "psi"), (9, "accessible"))])


def read_heatmap(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """A heat map's settings (``-name "value"`` lines) and cells (``i``, ``j``, ``value``): rows are ``number:label:v;v;...``."""
    lines = numbered_lines(spark, path)
    found = lines.where(F.col("line").startswith("-")).select(F.regexp_extract("line", r"^-(\w+)", 1).alias("k"), F.regexp_extract("line", r'^-\w+\s+"?([^"]*)"?', 1).alias("v")).collect()
    rows = lines.where(F.col("line").rlike(r"^\d+:"))
    values = F.split(F.regexp_extract("line", r"^\d+:[^:]*:(.*?);?\s*$", 1), ";")
    cells = rows.select(F.regexp_extract("line", r"^(\d+)", 1).cast("int").alias("i"), F.posexplode(values).alias("j", "v")).select("i", "j", F.col("v").cast("double").alias("value"))
    return {r["k"]: r["v"] for r in found}, cells


def heatmap_lines(cells: DataFrame, **settings: str) -> DataFrame:
    """(``order``, ``line``) of a heat map's text."""
    row = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", F.format_string("%.6f", "value").alias("t")))), lambda s: s["t"]), ";")
    body = cells.groupBy("i").agg(row.alias("r")).select((F.col("i") + 1000).alias("order"), F.concat(F.col("i").cast("string"), F.lit("::"), "r", F.lit(";")).alias("line"))
    head = [(k, f'-{n} "{v}"') for k, (n, v) in enumerate(settings.items())]
    return body.unionByName(cells.sparkSession.createDataFrame(head, "order int, line string")) if head else body


def annotated(atoms: DataFrame, residues: DataFrame, columns: Sequence[str], key: Sequence[str] = ("chain", "resnum", "icode")) -> DataFrame:
    """Residue columns put on every atom of the residue."""
    return atoms.join(residues.select(*key, *columns), list(key), "left")
