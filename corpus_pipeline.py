"""The corpus pipeline: quality filter, near-duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylark.llm import mixing, neardup, packing, pii, quality
from skylark.llm.common import materialise, numbered, table
from skylark.llm.queries import MIX_WEIGHTS, mix_levels
from skylark.llm.vocab import public_path

#: Documents with a lower quality score go.
LEAST_QUALITY = 0.3
#: Thousandths of the tokens that reach the mixture which it takes.
MIX_PERMILLE = 900
#: Words whose ids a worker keeps while it packs: fewer than packing alone keeps, as workers hold other stages' caches too.
KEPT_WORDS = 120_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts by their own text, also of repeated and null ids."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), cut=LEAST_QUALITY)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five words a shingle, a similarity of 0.8 or more.

    The smallest id stays, of rows that share it any one, and a null id only where a group has no other.
    """
    rows = numbered(docs, "_skylark_row")
    groups = neardup.near_duplicates(rows, words=5, percent=80, id_col="_skylark_row").select(F.col("doc_id").alias("_skylark_row"), "component_id")
    groups = groups.join(rows.select("_skylark_row", "doc_id"), "_skylark_row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_skylark_row")).alias("first")
    kept = materialise(groups.groupBy("component_id").agg(first).select("first._skylark_row"), "kept")
    return rows.join(kept.hint("shuffle_hash"), "_skylark_row", "left_semi").select(docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked."""
    return pii.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, as often as it takes them, each cut to the tokens taken.

    Rows are told apart by a number of their own, so repeated and null ids take part as rows.
    """
    rows = numbered(docs, "_skylark_row")
    taken = mixing.mix(rows, row_col="_skylark_row", levels=mix_levels(), weights=MIX_WEIGHTS, permille=MIX_PERMILLE, max_epochs=1)
    taken = taken.select(F.col("row").alias("_skylark_row"), F.col("tokens").alias("_skylark_tokens"), F.col("taken").alias("_skylark_taken"))
    pieces = F.regexp_extract_all(F.col("text"), F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_skylark_taken").cast("int")), "")
    text = F.when(F.col("_skylark_taken") < F.col("_skylark_tokens"), cut).otherwise(F.col("text"))
    mixed = rows.join(taken.hint("shuffle_hash"), "_skylark_row").withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return mixed.select(docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer=public_path("word_bpe_49k.json"), kept_words=KEPT_WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("pii", pii_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]
#: Learnt scores, tokenizers and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents one after the other."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
