"""Alignments: FASTA, SELEX, Stockholm, CLUSTAL and PIR text to rows (``file``, ``seq_idx``, ``label``, ``seq``), and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.sources.structures import numbered_lines

FORMATS = {"fasta": "fasta", "fa": "fasta", "slx": "selex", "sth": "stockholm", "sto": "stockholm", "aln": "clustal", "pir": "pir", "ali": "pir"}


def read_msa(
    spark: SparkSession, path: str | Sequence[str], kind: str, keep: Column | None = None, columns: tuple[int, int] | None = None
) -> DataFrame:
    """Aligned rows of files of one format; ``keep`` filters on label and seq, ``columns`` slices [first, last)."""
    lines = numbered_lines(spark, path)
    rows = {"fasta": _marked, "pir": _pir}.get(kind, _blocks)(lines)
    if keep is not None:
        rows = rows.where(keep)
    if columns is not None:
        rows = rows.withColumn("seq", F.substring("seq", columns[0] + 1, columns[1] - columns[0]))
    by = Window.partitionBy("file").orderBy("_at")
    return rows.withColumn("seq_idx", F.row_number().over(by) - 1).select("file", "seq_idx", "label", "seq")


def _entries(lines: DataFrame) -> DataFrame:
    """Lines grouped under the last line that starts with ``>``."""
    by = Window.partitionBy("file").orderBy("line_no")
    return lines.withColumn("_at", F.sum(F.col("line").startswith(">").cast("int")).over(by)).where("_at > 0")


def _joined(rows: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy("file", "_at").agg(ordered.alias("s"))


def _marked(lines: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.slice("s", 2, 1_000_000), lambda x: F.regexp_replace(x["line"], r"\s", "")), "")
    return _joined(_entries(lines)).select("file", "_at", F.trim(F.substring(F.col("s")[0]["line"], 2, 10_000)).alias("label"), text.alias("seq"))


def _pir(lines: DataFrame) -> DataFrame:
    """The label follows the semicolon; a description line comes before the sequence, an asterisk ends it."""
    text = F.array_join(F.transform(F.slice("s", 3, 1_000_000), lambda x: F.regexp_replace(x["line"], r"[\s*]", "")), "")
    return _joined(_entries(lines)).select("file", "_at", F.trim(F.regexp_extract(F.col("s")[0]["line"], r"^>[^;]*;?(.*)$", 1)).alias("label"), text.alias("seq"))


def _blocks(lines: DataFrame) -> DataFrame:
    """``label sequence`` lines, a label's pieces joined in file order; comments, marks and the title line left out."""
    plain = lines.where(~F.col("line").rlike(r"^\s*$|^#|^//|^CLUSTAL|^\s"))
    f = F.split(F.trim("line"), r"\s+")
    parts = plain.select("file", "line_no", f[0].alias("label"), f[1].alias("piece")).where("piece is not null")
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "piece")))
    grouped = parts.groupBy("file", "label").agg(F.min("line_no").alias("_at"), ordered.alias("s"))
    return grouped.select("file", "_at", "label", F.array_join(F.transform("s", lambda x: x["piece"]), "").alias("seq"))


def msa_lines(msa: DataFrame, kind: str, width: int = 60) -> DataFrame:
    """(``file``, ``a``, ``b``, ``line``): an alignment as text, to be sorted on (a, b)."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length("seq"), F.lit(1)), F.lit(width)), lambda k: F.substring(F.col("seq"), k, F.lit(width)))
    if kind in ("fasta", "pir"):
        head = F.array(F.concat(F.lit(">"), "label")) if kind == "fasta" else F.array(F.concat(F.lit(">P1;"), "label"), F.lit("sequence"))
        tail = F.array().cast("array<string>") if kind == "fasta" else F.array(F.lit("*"))
        return msa.select("file", F.col("seq_idx").alias("a"), F.posexplode(F.concat(head, cut, tail)).alias("b", "line"))
    if kind in ("selex", "stockholm"):
        rows = msa.select("file", F.lit(0).alias("a"), F.col("seq_idx").cast("int").alias("b"), F.concat(F.rpad("label", 40, " "), F.lit(" "), "seq").alias("line"))
        if kind == "selex":
            return rows
        files = msa.select("file").distinct()
        return files.select("file", F.lit(-1).alias("a"), F.lit(0).alias("b"), F.lit("# STOCKHOLM 1.0").alias("line")).unionByName(rows).unionByName(files.select("file", F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit("//").alias("line")))
    rows = msa.select("file", F.posexplode(cut).alias("a", "piece"), F.col("seq_idx").cast("int").alias("b"), "label")
    rows = rows.select("file", "a", "b", F.concat(F.rpad("label", 40, " "), F.lit(" "), "piece").alias("line"))
    return msa.select("file").distinct().select("file", F.lit(-1).alias("a"), F.lit(0).alias("b"), F.lit("CLUSTAL W").alias("line")).unionByName(rows)


def write_msa(msa: DataFrame, path: str, kind: str) -> None:
    """One text file per ``file`` value in a folder named for it."""
    lines = msa_lines(msa.withColumn("file", F.regexp_extract("file", r"([^/]+)$", 1)), kind)
    lines.repartition("file").sortWithinPartitions("file", "a", "b").select("file", "line").write.partitionBy("file").text(path)
