"""One registered query per operator, over its whole table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourglass.llm import (byte_bpe, embedding_dedup, fill_in_middle, html_wrapper, language_id, packing, quality_rules,
                           ranked_search, sentencepiece_lattice, sharding, simhash_dedup, token_counts, warc_zip)
from hourglass.llm.common import bind, table
from hourglass.llm.quality_sql import QUALITY
from hourglass.llm.text_sql import FILL_IN_MIDDLE, RANKED_SEARCH


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; operators take the path as a parameter."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _edits(text):
    """Stand-in edits of a document: four places, lengths and inserts (passages of its own) by hash."""
    def drawn(of):
        def number(k, name: str, below):
            return F.pmod(F.xxhash64(of.hash, k, F.lit(name)), below.cast("long"))
        return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(
            number(k, "start", of.chars + 1).alias("start"), number(k, "length", F.lit(40)).alias("length"),
            F.substring(text, 1 + number(k, "from", of.chars + 1).cast("int"),
                        number(k, "to", F.lit(60)).cast("int")).alias("insert")))
    return bind(F.struct(F.xxhash64(text).alias("hash"), F.length(text).alias("chars")), drawn)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its edits, from its kept segment tree."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    how = (tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    counted = token_counts.count_tokens(docs.withColumn("edits", _edits(F.coalesce("text", F.lit("")))), *how)
    after = token_counts.apply_edits(counted, *how)
    return after.select("doc_id", "n_tokens", F.length("text").alias("n_chars"), "n_edits", "encoded_chars",
                        F.crc32("text").alias("text_crc32"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts of every document and the verdict of the risk-controlled cutoffs."""
    return quality_rules.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, by a network fitted without the held-out third."""
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by sampled splitters over sizes."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every vector at cosine 0.95 or more."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document at four bits or fewer."""
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and CRC of every document's piece ids, and whether they decode to its text."""
    pieces = sentencepiece_lattice.Pieces.load(tokenizer_path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents")
    done = sentencepiece_lattice.encode(docs, pieces)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                       F.crc32("decoded").alias("decoded_crc32"), F.length("decoded").cast("long").alias("n_chars"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives it was written to."""
    back = warc_zip.round_trip(table(spark, sf_dir, "pages"))
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's wrapper."""
    return html_wrapper.extract(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its packed sequence."""
    docs = table(spark, sf_dir, "documents")
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its fill-in-middle form, and the text that this form gives back."""
    done = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_in_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes that they decode to."""
    import public_tokenizers
    ranks = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    done = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_sharding": op4_sharding,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_warc": op8_warc,
    "op9_html_wrapper": op9_html_wrapper,
    "op10_packing": op10_packing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_ranked_search": op12_ranked_search,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE: dict[str, str] = {
    "op2_quality_rules": QUALITY,
    "op11_fill_in_middle": FILL_IN_MIDDLE,
    "op12_ranked_search": RANKED_SEARCH,
}
