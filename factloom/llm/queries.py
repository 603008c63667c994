"""The registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom.llm import bpe, language_id, quality_classifier as quality, warc
from factloom.llm.centroids import cluster
from factloom.llm.common import read
from factloom.llm.line_dedup import drop_repeated_lines
from factloom.llm.mixing import mix
from factloom.llm.neighbours import nearest
from factloom.llm.ngram_join import jaccard_components
from factloom.llm.resampling import resample
from factloom.llm.substring_dedup import remove_repeated_passages
from factloom.llm.token_counts import count_tokens
from factloom.llm.vector_dedup import near_duplicates

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def sha256(text: str | Column) -> Column:
    return F.sha2((F.col(text) if isinstance(text, str) else text).cast("binary"), 256)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def held_out(doc_id: str = "doc_id") -> Column:
    """The third of the ids that no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), read(spark, sf_dir, "labels")
    weights = quality.train(docs, labels.where(~held_out()).select("doc_id", "quality"))
    return quality.score(docs.withColumn("held_out", held_out()), weights).select("doc_id", "held_out", "score", "predicted")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    rows = read(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"), top=20)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), PIECES).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark, sf_dir)
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    return records.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 20 code points found in at least 3 documents, kept in the largest doc_id."""
    return drop_repeated_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", sha256("text").alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a window of 50 that a smaller doc_id also has, removed."""
    return remove_repeated_passages(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", sha256("text").alias("kept_sha256"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles agree to 80 of 100."""
    return jaccard_components(documents(spark, sf_dir))


def token_digests(docs: DataFrame) -> DataFrame:
    tokens = bpe.encode_decode(docs.select("doc_id", "text"), WORDS)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256(ids).alias("ids_sha256"), sha256("decoded").alias("decoded_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"), least=0.93)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 clusters of the vectors of 64 components in steps of 1/64, three rounds."""
    return cluster(read(spark, sf_dir, "embeddings"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    trees = language_id.train(docs.where("NOT held_out"))
    return language_id.predict(docs.drop("lang"), trees).select("doc_id", "held_out", "lang_pred", "score")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of at least 20 words, drawn to look like the benchmark's texts."""
    return resample(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_neighbours, op3_token_counts, op4_warc, op5_line_dedup, op6_substring_dedup, op7_ngram_join,
        op8_bpe, op9_mixing, op10_vector_dedup, op11_centroids, op12_language_id, op13_resampling,
    )
}
