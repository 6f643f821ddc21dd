"""Exact dedup by progressive refinement: byte length, prefix hash, full hash.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import ascii_lower, salted_groups, stored

SALTS = 64
PREFIX_CHARS = 64


BITMAPS = 512  # bitmaps of 32,768 bits each, 2 MB in all, that mark groups of two or more


def _normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _salt(id_: Column) -> Column:
    """Of the id; rows with a null id are dealt by their place."""
    return F.pmod(F.when(id_.isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(id_)), F.lit(SALTS)).cast("int").alias("_salt")


def _level_keys(id_: Column, text: Column) -> list[Column]:
    """Id, byte length, prefix hash, and a salt."""
    whole = F.coalesce(text, F.lit(""))
    return [
        id_.alias("_id"),
        F.octet_length(whole).alias("_len"),
        F.xxhash64(ascii_lower(F.substring(whole, 1, PREFIX_CHARS))).alias("_prefix"),
        _salt(id_),
    ]


def _alike(keys: DataFrame) -> DataFrame:
    """(``_len``, ``_prefix``, ``_salt``) of groups of two or more rows: by length first, those left by prefix hash."""
    alive = keys.withColumn("_one", F.lit(1).cast("long"))
    for level in (["_len"], ["_len", "_prefix"]):
        groups = salted_groups(alive, level, {"_n": ("sum", "_one")}, "_salt", F.col("_n") > 1).drop("_n")
        alive = alive.join(groups, [*level, "_salt"], "left_semi")
    return groups


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdict for every row: which of equal texts stays.

    Texts are equal when identical after lower-casing A-Z; a null text counts
    as empty. Of equal texts the row with the largest id stays.

    One scan derives each row's byte length, the hash of its first 64
    characters and the digest of the whole text (which the result carries for
    every row); texts themselves are never shuffled. Rows are then grouped by
    length; only groups of two or more are regrouped by prefix hash, and only
    what is left by digest. Every level pre-aggregates under a salt of the id.

    Returns ``id_col, keep_id, group_size, kept, text_sha256``, one row for each input row.
    * null ids: such a row stays only if every equal text has a null id (keep_id is then null);
    * repeated rows (same id, same text) count in group_size and share one verdict;
    * an empty table gives an empty result; other columns of any name are not looked at.
    """
    digest = F.unhex(F.sha2(_normal(F.col(text_col)), 256)).alias("_digest")
    keys = stored(docs.select(*_level_keys(F.col(id_col), F.col(text_col)), digest), "exact-keys")
    one = F.lit(1).cast("long")
    alive = keys.join(_alike(keys), ["_len", "_prefix", "_salt"], "left_semi").withColumn("_one", one)
    groups = salted_groups(
        alive, ["_digest"], {"_n": ("sum", "_one"), "_keep": ("max", "_id")}, "_salt", F.col("_n") > 1
    )
    return keys.join(groups, ["_digest", "_salt"], "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", one).alias("group_size"),
        (F.col("_n").isNull() | F.col("_keep").eqNullSafe(F.col("_id"))).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, that of the largest id; columns, of any name, unchanged.

    Lengths and prefix hashes are grouped first; whole texts are hashed and
    compared only in groups of two or more, which a bitmap of fixed size marks
    (a false mark costs a hash and a shuffled row, nothing else). Verdicts meet their rows by id and text
    digest, so null and repeated ids lose no other text. Of several rows under
    the id that stays, that of the smallest text, then hash of the row, is
    left. An empty table gives an empty result.
    """
    rows = docs.select(F.struct("*").alias("row"))
    id_, text = F.col("row").getField(id_col), F.col("row").getField(text_col)
    keys = stored(rows.select(*_level_keys(id_, text)), "exact-lengths")
    bit = F.pmod(F.xxhash64("_len", "_prefix"), F.lit(BITMAPS * 32_768))
    marks = _alike(keys).select(F.floor(bit / 32_768).cast("int").alias("_map"), F.pmod(bit, F.lit(32_768)).alias("_bit"))
    marks = stored(marks.groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "exact-marks")

    # rows of marked groups are suspects; the others stay, and their texts are neither hashed nor shuffled
    held = F.conv(F.hex(F.substring("_bits", (F.floor(F.col("_at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = (
        rows.select("row", *_level_keys(id_, text)[1:3])
        .withColumn("_bit", bit)
        .select("row", F.floor(F.col("_bit") / 32_768).cast("int").alias("_map"), F.pmod("_bit", F.lit(32_768)).cast("int").alias("_at"))
        .join(F.broadcast(marks), "_map", "left")
        .withColumn("_byte", held)
        .select("row", F.coalesce(F.expr("shiftright(_byte, _at % 8) & 1") == 1, F.lit(False)).alias("marked"))
    )
    alone = found.where("not marked").select("row.*")
    found = found.where("marked").select("row", F.unhex(F.sha2(_normal(text), 256)).alias("sha"))
    suspects = stored(found.select(id_.alias("_id"), "sha", _salt(id_)), "exact-suspects")
    counted = suspects.withColumn("_one", F.lit(1).cast("long"))
    same = salted_groups(counted, ["sha"], {"_n": ("sum", "_one"), "_keep": ("max", "_id")}, "_salt", F.col("_n") > 1)
    pairs = suspects.join(same, ["sha", "_salt"]).groupBy(F.col("_id").alias("gone"), F.col("sha").alias("of"))
    stays = F.col("_keep").eqNullSafe(F.col("_id"))
    verdicts = stored(pairs.agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("times")).where("not stays or times > 1"), "exact-dropped")
    met = lambda v: id_.eqNullSafe(v["gone"]) & (F.col("sha") == v["of"])
    left = alone.unionByName(found.join(verdicts, met(verdicts), "left_anti").select("row.*"))
    repeated = verdicts.where("stays")
    if repeated.isEmpty():
        return left
    hashed = [F.col("row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    order = F.struct(F.coalesce(text, F.lit("")), F.xxhash64(*hashed))
    one = found.join(repeated, met(repeated), "left_semi").groupBy("sha").agg(F.min_by("row", order).alias("row"))
    return left.unionByName(one.select("row.*"))
