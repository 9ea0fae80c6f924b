"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, caps, chat, cnn, jaccard, lm, packing, phrases, spelling, sstable, suffix, topk, urls
from .tokens import vocabulary


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    docs = _read(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, vocabulary("byte_bpe_50k.json"), finish=bpe.digests, result="n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_cover_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the five best of each query."""
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered maximal conversations."""
    return chat.format_chats(_read(spark, sf_dir, "conversations"))


def op4_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shards."""
    docs = _read(spark, sf_dir, "documents")
    manifest = sstable.write(docs, vocabulary("byte_bpe_50k.json"))
    return sstable.read(manifest, finish=sstable.checksums, result="n_tokens long, ids_crc32 long")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, by strings of suffix.LENGTH bytes; then n_passages
    and passage_bytes, its repeated passages of over suffix.WORDS words or so many bytes."""
    finish = suffix.digests_and_passages(suffix.LENGTH, suffix.WORDS)
    result = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long"
    return suffix.remove_repeats(_read(spark, sf_dir, "documents"), finish=finish, result=result, length=(suffix.LENGTH, suffix.least_bytes(suffix.WORDS)))


def op6_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return caps.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op7_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 2048 ids."""
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), digest=True)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links, component_id, kept of every document."""
    return jaccard.links(_read(spark, sf_dir, "documents")).drop("hash")


def op9_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    return lm.score_documents(_read(spark, sf_dir, "documents"))


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = _read(spark, sf_dir, "documents")
    net = cnn.train(docs, _read(spark, sf_dir, "labels"))
    scored = cnn.score(docs, net)
    return scored.select("doc_id", cnn.in_fold("doc_id", keep=False).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page's url."""
    return urls.judge(_read(spark, sf_dir, "pages"), urls.train(urls.labels(spark)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_cover_topk": op2_cover_topk,
    "op3_chat_format": op3_chat_format,
    "op4_sstable": op4_sstable,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_cap_filters": op6_cap_filters,
    "op7_hilbert_packing": op7_hilbert_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_ngram_trie": op9_ngram_trie,
    "op10_quality_cnn": op10_quality_cnn,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_phrases": op12_phrases,
    "op13_url_filters": op13_url_filters,
}

ORACLES: dict[str, str] = {"op2_cover_topk": topk.ORACLE, "op3_chat_format": chat.ORACLE, "op11_spelling_variants": spelling.ORACLE}
