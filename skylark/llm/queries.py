"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylark.llm import balltree, chat, crosspolytope, fim, htmltext, langid, mixing, neardup, packing, pii, quality, tokencount, vectorcodes
from skylark.llm.common import table
from skylark.llm.oracles import OP1, OP5, OP7, OP11, OP13
from skylark.llm.vocab import public_path

def mix_levels() -> dict[str, Column]:
    """The mixture's tree: a domain for each group of sources, then language, then source."""
    digit = F.conv(F.substring(F.md5(F.coalesce(F.col("source"), F.lit("")).cast("binary")), 1, 1), 16, 10).cast("int")
    return {"domain": F.concat(F.lit("d"), (digit % 4).cast("string")), "language": F.col("lang"), "origin": F.col("source")}


#: Target weights by level; other values weigh 1.
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "language": {"en": 5, "de": 2, "fr": 2, "es": 1}}
#: Tools that calls in conversations are validated against.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(table(spark, sf_dir, "embeddings"))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.neighbours(table(spark, sf_dir, "embeddings"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer=public_path("word_bpe_49k.json"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"), TOOLS)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), levels=mix_levels(), weights=MIX_WEIGHTS)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer=public_path("byte_bpe_50k.json"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_topk, op2_cross_polytope, op3_pack, op4_chat_format, op5_near_duplicates, op6_quality, op7_mix, op8_token_counts, op9_main_text, op10_pii, op11_vector_codes, op12_languages, op13_fill_in_middle)
}
ORACLE_SQL = {"op1_exact_topk": OP1, "op5_near_duplicates": OP5, "op7_mix": OP7, "op11_vector_codes": OP11, "op13_fill_in_middle": OP13}
