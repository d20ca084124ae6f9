"""The llm operators as registered queries over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import chat_format, exact_topk, fill_middle, huffman, jaccard_join, knn_quality, license_scan, packing, prefix_tokens, quality_rules, sentencepiece_tokenizers, source_mix, token_alignment, wordids
from sparkloom.llm.common import discard, scratch_path, spread, written
from sparkloom.plans import Query
from sparkloom.sources import read_table

TOKEN_LIMIT = 1024
PACK_CAPACITY = 4096
TOP_K, QUERY_EVERY = 5, 50


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "documents"))


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Score and verdict of every document by its labelled neighbours."""
    docs = _documents(spark, folder).select("doc_id", "text")
    model = knn_quality.fit(docs, read_table(spark, folder, "labels"))
    scored = knn_quality.score(docs, model)
    return scored.select("doc_id", knn_quality.held_out().alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, whether over the limit, and the longest prefix within it."""
    docs = _documents(spark, folder).select("doc_id", "text")
    out = prefix_tokens.prefix_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), budget=TOKEN_LIMIT, keep_steps=False)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fit_chars")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Word statistics and the verdict of the quality rules on every document."""
    return quality_rules.judge(_documents(spark, folder))


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation rendered and read back, and one whose texts are control strings."""
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.lit(hard).alias("text"))
    return chat_format.digests(rows.unionByName(more))


def op5_huffman_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, written as Huffman-coded files in order of doc_id and read back."""
    docs = _documents(spark, folder)
    ids = written(wordids.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")), "huffman-ids")
    path = scratch_path(spark, "huffman")
    huffman.write(ids, path)
    discard(ids)
    return huffman.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document, whether both libraries agree on them, and whether decoding gives the text."""
    docs = _documents(spark, folder).select("doc_id", "text")
    out = sentencepiece_tokenizers.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "parity", "round_trip")


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of every document."""
    return license_scan.scan(_documents(spark, folder))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Encode, cut and pack documents; their ids are written once, in the shared folder."""
    ids = written(wordids.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")), "packing-ids")
    pieces = packing.cut_pieces(ids, PACK_CAPACITY)
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.assign(slim, PACK_CAPACITY)


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as pieces in as few sequences of 4096 tokens as can be."""
    return pack_documents(_documents(spark, folder))


def op9_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The best five of all vectors for every 50th."""
    vectors = exact_topk.quantised(read_table(spark, folder, "embeddings"))
    return exact_topk.top_k(vectors, vectors.filter(F.col("id") % QUERY_EVERY == 0), TOP_K)


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Class and number of links of every document, by five-word shingles at a similarity of 0.8."""
    return jaccard_join.join(_documents(spark, folder))


def op11_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document a mix of sources to target weights takes."""
    return source_mix.digests(_documents(spark, folder))


def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut in prefix, middle and suffix, put in order for infilling, and rebuilt."""
    return fill_middle.digests(_documents(spark, folder))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of aligned tokens of every document under two tokenizers, and how its links count in the whole corpus."""
    return token_alignment.align(_documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": Query(op1_quality_classifier),
    "op2_token_counts": Query(op2_token_counts),
    "op3_quality_rules": Query(op3_quality_rules, quality_rules.oracle_sql()),
    "op4_chat_format": Query(op4_chat_format, chat_format.oracle_sql()),
    "op5_huffman_ids": Query(op5_huffman_ids),
    "op6_sentencepiece": Query(op6_sentencepiece),
    "op7_license_scan": Query(op7_license_scan, license_scan.oracle_sql()),
    "op8_best_fit_packing": Query(op8_best_fit_packing),
    "op9_exact_topk": Query(op9_exact_topk, exact_topk.oracle_sql(TOP_K, QUERY_EVERY)),
    "op10_jaccard_join": Query(op10_jaccard_join, jaccard_join.oracle_sql()),
    "op11_source_mix": Query(op11_source_mix, source_mix.oracle_sql()),
    "op12_fill_middle": Query(op12_fill_middle, fill_middle.oracle_sql()),
    "op13_token_alignment": Query(op13_token_alignment),
}
