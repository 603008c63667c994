"""Preparation of a training corpus from ``documents``: stages that each call one operator.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; what it returns is
written as Parquet and read again as the next one's input.  All but the last return the columns of
``documents``; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm import quality_classifier as classifier
from factloom.llm.common import read, written
from factloom.llm.line_dedup import drop_repeated_lines
from factloom.llm.mixing import mix
from factloom.llm.ngram_join import jaccard_components
from factloom.llm.queries import held_out, token_digests

#: A fitted classifier and draws by hash: no SQL.  Tested against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.  A null text counts as empty, which has a score too; repeated rows
    share their fate, a score of 0.5 stays; without labels of both classes all stay.  Columns named score or predicted
    come back as the classifier's."""
    labels = read(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality")
    return classifier.score(docs, classifier.train(docs, labels)).where("predicted = 1").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others repeat.  A null text comes back empty; rows without id lose repeated
    lines and keep none for others, rows of one id are one document.  Columns named n_lines or n_dropped come
    back as the operator's."""
    kept = drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies one row: the one with the smallest id, one without id where all are; of rows that repeat
    an id the first.  Null and empty texts are near to nothing and stay."""
    keyed = written(docs.withColumn("_key", F.monotonically_increasing_id()), "keyed")
    parts = written(jaccard_components(keyed.select("_key", "text"), "_key").select("_key", "component_id"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key")
    first = parts.join(keyed.select("_key", "doc_id"), "_key").groupBy("component_id").agg(F.min(order).alias("k")).select("k._key")
    extra = written(parts.select("_key").join(first, "_key", "left_anti"), "copies")
    return keyed.join(extra, "_key", "left_anti").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, 0 to 2 times.  Null is a source like others; documents without words
    are taken as their source's order has them; rows that repeat an id are taken as far as they fit.  Columns named size,
    source_size, target, copies or taken come back as the operator's."""
    mixed = mix(docs).where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return mixed.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests; null and empty texts have no ids.  A row for each, repeated
    or without id too."""
    return token_digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", mixture),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
