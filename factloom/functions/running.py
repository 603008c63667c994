"""Running totals in levels, so that no task orders all values of a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factloom.session import written


def join_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the keys come once."""
    b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return a.join(b, on, how).drop(*[f"_{k}" for k in keys])


def sums_before(buckets: DataFrame, keys: list[str], bucket: str, value: str, width: int = 4096) -> DataFrame:
    """(keys, bucket, before): the sum of ``value`` in earlier buckets of the same keys.

    ``buckets`` has one row per keys and (whole-numbered) bucket.  Blocks of ``width`` buckets are summed,
    the running total over blocks gives each its start, and only the buckets of one block are ordered together.
    """
    blocked = buckets.withColumn("_block", F.floor(F.col(bucket) / width))
    blocks = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_n"))
    start = F.sum("_n").over(W.partitionBy(*keys).orderBy("_block")) - F.col("_n")
    starts = blocks.select(*keys, "_block", start.alias("_start"))
    inside = F.sum(value).over(W.partitionBy(*keys, "_block").orderBy(bucket)) - F.col(value)
    return join_keys(blocked.withColumn("_inside", inside), starts, [*keys, "_block"]).select(
        *keys, bucket, (F.col("_start") + F.col("_inside")).alias("before")
    )


def totals_before(rows: DataFrame, group: str, order: list[Column], value: str, also: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``before``, the sum of ``value`` over earlier rows of the same ``group`` in the given order, and
    ``total``, the sum over all of them (``total_<c>`` for further columns); rows without group are a group.

    The rows are dealt by range of (group, order) and written, so a group of any size lies in as many ranges as it
    fills; a range sums up what it holds of a group, the sums of earlier ranges give each range its start, and only
    rows of one range and group are ordered together.  Rows that agree in group and order may come in any order.
    """
    kept = rows.withColumns({"_group": F.struct(group), "_row": F.monotonically_increasing_id()})
    keys = [F.col("_group").asc(), *order, F.col("_row").asc()]
    dealt = kept.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    kept = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    kept = kept.withColumn("_range", F.shiftright("_at", 33))
    of_group = W.partitionBy("_group")
    sums = kept.groupBy("_range", "_group").agg(*[F.sum(c).alias(f"_sum_{c}") for c in (value, *also)])
    start = F.sum(f"_sum_{value}").over(of_group.orderBy("_range")) - F.col(f"_sum_{value}")
    totals = [F.sum(f"_sum_{c}").over(of_group).alias("total" if c == value else f"total_{c}") for c in (value, *also)]
    starts = sums.select("_range", "_group", start.alias("_start"), *totals)
    inside = F.sum(value).over(W.partitionBy("_range", "_group").orderBy("_at")) - F.col(value)
    # A struct is never null, so null groups meet, and both sides are dealt by the same keys.
    placed = kept.withColumn("_inside", inside).join(starts, ["_range", "_group"])
    return placed.withColumn("before", F.col("_start") + F.col("_inside")).drop("_range", "_group", "_at", "_inside", "_start")
