"""From raw documents to packed training sequences, in five stages of the ``llm`` operators.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import exact_dedup, langid, mixing, near_dedup, packing
from strandlake.llm.common import stored
from strandlake.llm.queries import tokenizer_path

#: A text whose most probable language has less than this pooled probability is rejected. With up to three
#: languages the largest probability is over this anyway, so that only texts without a letter are rejected.
LEAST_LANGUAGE_SCORE = 0.3


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and with four languages or more those whose best one scores under 0.3."""
    found = langid.identify(docs, langid.train(docs), carry=("text", "lang", "source", "n_chars"))
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.where(known).select("doc_id", "text", "lang", "source", "n_chars")


def exact_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the largest id, of each group of equal texts stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate component stays."""
    return near_dedup.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture reads them, each at least once."""
    return mixing.mixed_documents(docs, whole=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language ID", identified),
    ("exact dedup", exact_deduplicated),
    ("near dedup", near_deduplicated),
    ("mixing", mixed),
    ("packing", packed),
]

#: Language ID, the sketches and the tokenizer have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
