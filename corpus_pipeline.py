"""A corpus pipeline: quality, near duplicates, repeated passages, packing.

Each stage is a function of (spark, docs, sf_dir) and returns the columns of docs; the last one returns the pieces of the
packed sequences (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).  docs has doc_id and text; other
columns are carried along, whatever their names.  Null and empty texts are documents: the first stage judges them like
any other, the next two leave them, packing gives them their end id.  Null and repeated ids are kept; rows that repeat
id and text are one group for the second stage.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tremor.llm import blocks, cnn, jaccard, packing, suffix
from tremor.llm.tokens import vocabulary

#: A document stays in the corpus from this probability of being good on.
LEAST = 0.7
#: A passage goes if it has over so many words, however short they are, or so many bytes.
WORDS, BYTES = 50, suffix.LENGTH


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network accepts.

    The network learns from the table of documents, not from docs, so that the stage judges a text alike wherever it
    stands in a pipeline.
    """
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = cnn.train(source, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    of = dict(zip(names, plain.columns, strict=True))
    scored = cnn.score(plain, net, id_col=of["doc_id"], text_col=of["text"], keep=tuple(c for c in plain.columns if c != of["doc_id"]), score_col="_score")
    return scored.filter(F.col("_score") >= LEAST).select(*(F.col(of[c]).alias(c) for c in names))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard similarity of 0.8 or more)."""
    return jaccard.deduplicate(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words or of 400 bytes that stand elsewhere too; n_chars follows the text.

    Over WORDS words have 2 * WORDS + 1 bytes at least, so repeats are looked for from that length on; runs of repeated
    bytes with neither the words nor the bytes stay.
    """
    rest = tuple(c for c in docs.columns if c != "text")
    cut = suffix.remove_repeats(docs, keep=rest, finish=suffix.long_runs(BYTES, WORDS), length=2 * WORDS + 1).drop("spans")
    if "n_chars" in rest:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents along the curve."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), digest=True)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", passages), ("packing", packed)]

#: The network and the packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again before the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = blocks.stored(docs, "snappy")
    return docs
