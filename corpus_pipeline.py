"""Corpus preparation: quality rules, language ID, SimHash near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourglass.llm import language_id, packing, quality_rules, simhash_dedup
from hourglass.llm.common import stored, table
from hourglass.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the risk-controlled cutoffs.

    Null, empty and very short texts go; repeated rows stay or go together; no documents or no labels give no error.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network identifies.

    Texts without a letter go; without labelled languages there is nothing to identify and all documents go.
    """
    return language_id.keep_identified(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group.

    Rows without an id stay; of rows that repeat an id one stays; wordless texts are one group.
    """
    return simhash_dedup.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences, one row per piece.

    A null or empty text is its separator alone; repeated rows are packed as often as they occur; no documents give no rows.
    """
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


STAGES = [("quality_rules", quality), ("language_id", language),
          ("simhash_near_dedup", near_duplicates), ("packing", pack)]

#: The network of the language stage and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
