"""Seeded shuffles, exact splits and caps without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factloom.functions.draws import DRAW_BITS, digest, lane, word

PREFIX_CHARS = 4  # 16**4 = 65,536 buckets of the hash
NO_KEY = "!" * 32  # sorts before every digest


def shuffle_key(key: str, seed: int, stage: str = "split") -> Column:
    return digest(seed, stage, key)


def split_place(df: DataFrame, key: str, seed: int, share: float, stage: str) -> DataFrame:
    """One row with one struct (h, k): the last place of the seeded shuffle that is still on the train side; no value
    where all rows are.

    The rows are counted per bucket of the hash, 65,536 counts however long the table is; only the keys of the one
    bucket in which the share is reached, each once with its number of copies, are put in order.  So the keys are
    read twice and nothing but counts is shuffled.
    """
    h = F.coalesce(shuffle_key(key, seed, stage), F.lit(NO_KEY))
    hashed = df.select(F.col(key).alias("k"), h.alias("h"), F.substring(h, 1, PREFIX_CHARS).alias("b"))
    upto = F.sum("n").over(W.orderBy("b"))
    wanted = F.floor(F.sum("n").over(W.partitionBy()) * F.lit(share))
    counts = hashed.groupBy("b").agg(F.count("*").alias("n")).select("b", "n", upto.alias("upto"), wanted.alias("wanted"))
    # The bucket in which the running total passes the share; beyond the last one, all are train.
    cut = counts.filter((F.col("upto") - F.col("n") <= F.col("wanted")) & (F.col("wanted") < F.col("upto")))
    cut = cut.select("b", (F.col("wanted") - F.col("upto") + F.col("n")).alias("left"))
    inside = hashed.join(F.broadcast(cut), "b").groupBy("b", "left", "h", "k").agg(F.count("*").alias("n"))
    fits = F.sum("n").over(W.orderBy("h", "k")) <= F.col("left")
    place = F.struct("h", "k")
    # The bucket's own name sorts before all its digests.
    before = F.struct(F.col("b").alias("h"), F.lit(None).cast(df.schema[key].dataType).alias("k"))
    return inside.select(F.when(fits, place).otherwise(before).alias("place")).agg(F.max("place").alias("place"))


def exact_split(df: DataFrame, key: str, seed: int, share: float = 0.9, stage: str = "split") -> DataFrame:
    """Add ``split``: the first ``floor(share * n)`` rows of a seeded shuffle are ``train``, the rest ``eval``.

    The rows themselves are compared with the place of the cut and never shuffled; the source is in the plan three times,
    twice with its key alone.  Copies of a key stay on one side, so with copies the train side may be short; rows without key come first.
    """
    h = F.coalesce(shuffle_key(key, seed, stage), F.lit(NO_KEY))
    last = split_place(df, key, seed, share, stage).scalar()
    is_train = F.coalesce(F.struct(h.alias("h"), F.col(key).alias("k")) <= last, F.lit(True))
    return df.withColumn("split", F.when(is_train, "train").otherwise("eval"))


def threshold_split(df: DataFrame, key: str, seed: int, share: float = 0.9, stage: str = "split") -> DataFrame:
    """Split by hash threshold: the share holds on average, each row is decided alone.  For
    streams."""
    draw = lane(word(digest(seed, stage, key), 0), 0)
    return df.withColumn("split", F.when(draw < int(share * (1 << DRAW_BITS)), "train").otherwise("eval"))


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """All rows, with ``among_first``: whether a row is one of the first ``n`` by an explicit order (its
    place is a top-k of the order column alone, no global sort).  Equal values are all in or all out."""
    last = df.select(order).orderBy(F.col(order).asc_nulls_last()).limit(n).agg(F.max(order).alias("m"))
    return df.withColumn("among_first", F.coalesce(F.col(order) <= last.scalar(), F.lit(False)))


def composition(df: DataFrame, by: str = "scenario") -> DataFrame:
    """Rows and share per value."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    return counts.select(by, "n", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 1).alias("share_pct"))


def summary(df: DataFrame) -> DataFrame:
    """Rows per dataset and split with totals."""
    return df.rollup("dataset", "split").agg(F.count("*").alias("n")).select(
        F.coalesce("dataset", F.lit("(all)")).alias("dataset"),
        F.coalesce("split", F.lit("(all)")).alias("split"),
        "n",
    )
