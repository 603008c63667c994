"""Target-distribution importance resampling: documents whose hashed n-grams look like a target's are drawn.

Newlines separate words, so a text is the sequence of its lines.  The feature counts of every distinct line are made
once and multiplied by how often it occurs; n-grams that cross a newline are counted for themselves.  A feature counts
in one of ``buckets`` hash buckets; the log ratio of both corpora's bucket counts is the gain of a feature, and a
document's weight is its mean gain.  Gumbel noise from a hash of the id turns the highest scores into a sample
without replacement that a rerun repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factloom.llm.common import configure, written

#: Digits, small letters and everything beyond ASCII make up words (capital letters are lowered first).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where ``use`` asks for it in a lambda per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def joined(words: Column, at: Column, size: int) -> Column:
    """The runs of ``size`` words that start at the places ``at``."""
    return F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + (j - 1)) for j in range(size)]))


def starts(words: Column, size: int) -> Column:
    """1, 2, ...: where a run of ``size`` words can start."""
    return F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))


def runs(words: Column, most: int) -> Column:
    """All runs of 1 to ``most`` words, repeated ones as often as they occur."""
    if most == 1:
        return words
    return bound(words, lambda w: F.concat(w, *[joined(w, starts(w, k), k) for k in range(2, most + 1)]))


def crossing(lines: Column, most: int) -> Column:
    """All runs of 2 to ``most`` words whose first and last word are on different lines."""
    line = F.flatten(F.transform(lines, lambda w, i: F.array_repeat(i, F.size(w))))

    def of(both: Column) -> Column:
        w, at = both["words"], both["line"]
        crosses = lambda k: F.filter(starts(w, k), lambda i: F.get(at, i - 1) != F.get(at, i + (k - 2)))
        return F.concat(*[joined(w, crosses(k), k) for k in range(2, most + 1)])

    return bound(F.struct(F.flatten(lines).alias("words"), line.alias("line")), of)


def bucket(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def bucket_counts(texts: DataFrame, text_col: str, most: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket, those without any left out."""
    lines = F.split(F.col(text_col), "\n")
    distinct = texts.select(F.explode(lines).alias("line")).groupBy("line").agg(F.count("*").alias("times"))
    parts = [distinct.select("times", F.explode(runs(words_of(F.col("line")), most)).alias("feature"))]
    if most > 1:
        each = texts.select(F.transform(lines, words_of).alias("lines"))
        parts.append(each.select(F.lit(1).cast("long").alias("times"), F.explode(crossing(F.col("lines"), most)).alias("feature")))
    counted = [p.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.sum("times").alias("n")) for p in parts]
    return counted[0] if most == 1 else counted[0].unionByName(counted[1]).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str, most: int, buckets: int) -> DataFrame:
    """One row with one array: the gain of each bucket."""
    both = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    for name, texts in (("s", docs), ("t", target)):
        counts = bucket_counts(texts, text_col, most, buckets).withColumnRenamed("n", name)
        both = both.join(counts, "bucket", "left").fillna(0, [name])
    totals = both.withColumns({f"all_{c}": F.sum(c).over(W.partitionBy()) for c in "st"})
    number = lambda c: F.col(c).cast("double")
    ratio = (number("t") + 1) * (number("all_s") + buckets) / ((number("s") + 1) * (number("all_t") + buckets))
    rows = totals.select(F.struct("bucket", F.floor(F.ln(ratio) * 1000).alias("gain")).alias("r"))
    return rows.agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["gain"]).alias("gain"))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1, buckets: int = 10_000,
    seed: str = "2024", percent: int = 10, least_words: int = 20,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of each document; rank 1, 2, ... for those drawn, else null.

    Features are runs of 1 to ``most`` consecutive words; documents of at least ``least_words`` words may be drawn, and
    of N such the floor(percent * N / 100) with the highest scores are.  Ties go to the smaller id, rows without id (hashed as
    the word ``null``) come last, rows that repeat an id go by their features and weight.  A null or empty text has no
    features and weight 0; an empty target or corpus is a corpus without features.  Other columns of the
    inputs, whatever their names, are not read.
    """
    configure(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("_text"))
    table = written(gains(texts, target.select(F.col(text_col).alias("_text")), "_text", most, buckets), "gains")

    rows = docs.select(F.col(id_col).alias("_id"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("_words"))
    rows = rows.withColumn("_gain", table.scalar())
    n = F.size("_words").cast("long")
    n_features = sum((F.greatest(n - k, F.lit(0)) for k in range(1, most)), n)
    total = F.aggregate(runs(F.col("_words"), most), F.lit(0).cast("long"), lambda s, f: s + F.get("_gain", bucket(f, buckets).cast("int")))
    rows = rows.select("_id", n.alias("_n"), n_features.alias("n_features"), total.alias("_sum"))
    weight = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (_sum - pmod(_sum, n_features)) DIV n_features END")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.ln(-F.ln((h + 0.5) / 4294967296.0)) * -1000)
    rows = rows.select("_id", "n_features", weight.alias("weight"), (F.col("_n") >= least_words).alias("_may"), noise.alias("_noise"))
    scored = written(rows.withColumn("score", F.col("weight") + F.col("_noise")).drop("_noise"), "scored")

    drawn, lowest = cut(scored, percent)
    inside = F.col("_may") & (F.col("score") >= lowest)
    ranked = positions(scored.where(inside)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~inside).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("_id").alias(id_col), "n_features", "weight", "score", "rank")


def cut(scored: DataFrame, percent: int) -> tuple[int, int]:
    """How many documents are drawn, and the score of the last one.  Scores are whole numbers of a narrow range (a
    thousand times a logarithm), so there are some ten thousand rows of counts, whatever the corpus' size."""
    counts = scored.where("_may").groupBy("score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1))
    rows = counts.withColumns({"above": F.coalesce(above, F.lit(0)), "all": F.sum("n").over(W.partitionBy())})
    found = rows.where(F.col("above") < F.expr(f"({percent} * all) DIV 100")).agg(F.first("all").alias("all"), F.min("score").alias("lowest")).first()
    return (0, LONG_MAX) if found.lowest is None else (percent * found["all"] // 100, found.lowest)


LONG_MAX = (1 << 63) - 1


def positions(rows: DataFrame) -> DataFrame:
    """``rows`` with their rank by falling score, then id: dealt by range and put in order range by range; the ranges'
    sizes (as many as partitions) give each its start.  A row number as the last key lets rows that agree in all
    columns, however many, be dealt to several ranges."""
    keys = [F.desc("score"), F.asc_nulls_last("_id"), F.asc("n_features"), F.asc("weight"), F.asc("_row")]
    spread = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = written(spread.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_place")
    ordered = ordered.select("*", part, place)
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", start.alias("_start"))
    return ordered.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.col("_place") + 1).drop("_at", "_part", "_place", "_start")
