"""Request-log analytics: (request_id, service, start_ts, elapsed_s, status, status_code, error)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factloom.functions.running import join_keys, sums_before

OK_CODE = 200
# The default upper bounds of a request-latency histogram, in seconds.
BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
PERCENTILES = [0.50, 0.90, 0.99]
SKETCH_ACCURACY = 100_000


def requests_by_status(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count("*").alias("n"))


def histogram_columns(value: Column) -> list[Column]:
    return [F.count_if(value <= b).alias(f"le_{i:02d}") for i, b in enumerate(BOUNDS)]


def latency_histogram(log: DataFrame, by: str = "service") -> DataFrame:
    """Cumulative bucket counts in long form, with count and sum per group."""
    wide = log.groupBy(by).agg(
        *histogram_columns(F.col("elapsed_s")),
        F.count("elapsed_s").alias("n"),
        F.round(F.sum("elapsed_s"), 3).alias("total_s"),
    )
    buckets = [
        F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i:02d}").alias("cumulative")) for i, b in enumerate(BOUNDS)
    ]
    buckets.append(F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("cumulative")))
    return wide.select(by, "n", "total_s", F.explode(F.array(*buckets)).alias("b")).select(
        by, "b.le", "b.cumulative", "n", "total_s"
    )


def inflight_requests(log: DataFrame, by: str = "service", bucket_seconds: int = 1) -> DataFrame:
    """(by, ts, inflight): requests in progress after each instant at which one starts or
    ends; ends count before starts.

    Running sum in levels: changes are first combined per instant, then per time bucket; the running
    total over buckets (itself in blocks) gives each bucket its starting level, and the running sum within a bucket
    adds to it.  A second holds at most a million distinct instants, however many requests
    fall into it, so no window grows with the log.
    """
    ends = F.col("start_ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("elapsed_s").cast("decimal(18,6)"))
    points = log.select(
        by,
        F.explode(
            F.array(
                F.struct(F.col("start_ts").alias("ts"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                F.struct(ends.alias("ts"), F.lit(0).alias("up"), F.lit(1).alias("down")),
            )
        ).alias("p"),
    )
    instants = (
        points.groupBy(by, F.col("p.ts").alias("ts"))
        .agg(F.sum("p.up").alias("up"), F.sum("p.down").alias("down"))
        .withColumn("bucket", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (bucket_seconds * 1_000_000)))
    )
    change = F.col("up") - F.col("down")
    per_bucket = instants.groupBy(by, "bucket").agg(F.sum(change).alias("change"))
    starting = sums_before(per_bucket, [by], "bucket", "change")
    inside = F.sum(change).over(W.partitionBy(by, "bucket").orderBy("ts"))
    return join_keys(instants.withColumn("inside", inside), starting, [by, "bucket"]).select(
        by, "ts", (F.col("before") + F.col("inside")).alias("inflight")
    )


def peak_concurrency(log: DataFrame, by: str = "service") -> DataFrame:
    return inflight_requests(log, by).groupBy(by).agg(F.max("inflight").alias("peak"))


def _end_seconds() -> Column:
    return F.unix_micros(F.col("start_ts").cast("timestamp")) / 1e6 + F.col("elapsed_s")


def _start_seconds() -> Column:
    return F.unix_micros(F.col("start_ts").cast("timestamp")) / 1e6


def throughput(log: DataFrame, by: str = "service") -> DataFrame:
    """Requests per second of wall time; 0 if no time passed."""
    per = log.groupBy(by).agg(
        F.count("*").alias("n"), F.max(_end_seconds()).alias("last"), F.min(_start_seconds()).alias("first")
    )
    wall = F.col("last") - F.col("first")
    return per.select(
        by, "n", F.round(wall, 3).alias("wall_s"),
        F.round(F.when(wall > 0, F.col("n") / wall).otherwise(0.0), 9).alias("per_second"),
    )


def success_failure(log: DataFrame, by: str = "service") -> DataFrame:
    ok = F.coalesce(F.col("status_code") == OK_CODE, F.lit(False))
    return log.groupBy(by).agg(F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("failure_count"))


def latency_summary(log: DataFrame, by: str | None = "service") -> DataFrame:
    """Least, mean and greatest latency; 0 for a log without requests."""
    some = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(name)
    grouped = log.groupBy(by) if by else log.groupBy()
    return grouped.agg(
        some(F.min("elapsed_s"), "min_s"), some(F.avg("elapsed_s"), "mean_s"), some(F.max("elapsed_s"), "max_s")
    )


def latency_percentiles(
    log: DataFrame, by: str = "service", value: str = "elapsed_s", percentiles: list[float] = PERCENTILES
) -> DataFrame:
    """Exact percentiles by the rule ``sorted[min(n - 1, floor(n * p))]``.

    A quantile sketch with a guaranteed rank error brackets each percentile.  Values below the
    bracket are only counted; values inside it are counted per distinct value, and only those few
    are ranked.  Nothing sorts a whole group, and equal values are combined before the shuffle.
    """
    slack = 2.0 / SKETCH_ACCURACY
    probes = []
    for p in percentiles:
        probes += [max(0.0, p - slack), min(1.0, p + slack)]
    sketch = log.groupBy(by).agg(
        F.count(value).alias("n"),
        F.percentile_approx(value, F.array(*[F.lit(q) for q in probes]), F.lit(SKETCH_ACCURACY)).alias("q"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
    )
    # Probes that would need a rank outside the data take the extremes, so a bracket never misses.
    brackets = [
        F.struct(
            F.lit(p).alias("p"),
            (F.col("q")[2 * i] if p - slack > 0 else F.col("least")).alias("low"),
            (F.col("q")[2 * i + 1] if p + slack < 1 else F.col("greatest")).alias("high"),
            F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p))).alias("rank"),
        )
        for i, p in enumerate(percentiles)
    ]
    bounds = sketch.select(by, F.array(*brackets).alias("brackets"))
    candidates = (
        join_keys(log.select(by, F.col(value).alias("v")).filter(F.col("v").isNotNull()), bounds, [by])
        .select(by, "v", F.explode(F.filter("brackets", lambda b: F.col("v") <= b["high"])).alias("b"))
        .select(by, "b.p", "b.rank", F.when(F.col("v") >= F.col("b.low"), F.col("v")).alias("inside"))
        .groupBy(by, "p", "rank", "inside")
        .agg(F.count("*").alias("n"))
    )
    upto = F.sum("n").over(W.partitionBy(by, "p").orderBy(F.col("inside").asc_nulls_first()))
    return (
        candidates.withColumn("upto", upto)
        .filter(F.col("upto") > F.col("rank"))
        .groupBy(by, "p")
        .agg(F.min("inside").alias(value))
    )


def failures(log: DataFrame, by: str = "service", bucket_seconds: int = 1) -> DataFrame:
    """All failures with their ``place`` (from 1) within the group, by start and request id.  Places are
    counted inside a second and added to the failures of earlier seconds."""
    failed = log.filter(~F.coalesce(F.col("status_code") == OK_CODE, F.lit(False)))
    second = F.floor(F.unix_micros(F.col("start_ts").cast("timestamp")) / (bucket_seconds * 1_000_000))
    failed = failed.withColumn("_second", second)
    before = sums_before(failed.groupBy(by, "_second").agg(F.count("*").alias("n")), [by], "_second", "n")
    inside = F.row_number().over(W.partitionBy(by, "_second").orderBy("start_ts", "request_id"))
    placed = join_keys(failed.withColumn("_inside", inside), before, [by, "_second"])
    return placed.withColumn("place", F.col("before") + F.col("_inside")).drop("before", "_inside", "_second")


def request_metrics_windowed(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts and latency buckets per tumbling window and status; the same expression serves a
    batch table and a stream with a watermark on ``start_ts``."""
    return (
        log.groupBy(F.window("start_ts", width).alias("w"), "status")
        .agg(F.count("*").alias("n"), F.round(F.sum("elapsed_s"), 3).alias("total_s"), *histogram_columns(F.col("elapsed_s")))
        .select(
            F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "status", "n", "total_s",
            *[f"le_{i:02d}" for i in range(len(BOUNDS))],
        )
    )


# --- percentiles over any time range -----------------------------------------------

#: Values of one bucket of a rank sketch differ by this factor at most.
STEP = 1.001
_OFFSET = 1_000_000


def value_bucket(value: Column) -> Column:
    """Whole number that rises with the value: which power of ``STEP`` its size has, with its sign."""
    power = F.floor(F.ln(F.abs(value)) / math.log(STEP)) + _OFFSET
    return F.when(value > 0, power).when(value < 0, -power).otherwise(F.lit(0).cast("long"))


def rank_sketch(log: DataFrame, width: str = "1 hour", by: str = "service", value: str = "elapsed_s") -> DataFrame:
    """(by, window_start, bucket, n): how many values of each window fall in each bucket, to be stored.

    Sketches of windows add up to those of any range of windows, and tell the exact rank of every bucket's ends.
    Their size follows the spread of the values (2,300 buckets per factor of ten), not their number.  Rows without time or value are in
    none; one without ``by`` is in the group of those.
    """
    some = log.filter(F.col(value).isNotNull() & F.col("start_ts").isNotNull())
    rows = some.select(by, F.window("start_ts", width)["start"].alias("window_start"), value_bucket(F.col(value)).alias("bucket"))
    return rows.groupBy(by, "window_start", "bucket").agg(F.count("*").alias("n"))


def percentiles_over(
    sketch: DataFrame, log: DataFrame, start_of: Callable[[Column], Column], by: str = "service", value: str = "elapsed_s",
    percentiles: list[float] = PERCENTILES,
) -> DataFrame:
    """(by, start, p, value): exact percentiles, ``sorted[min(n - 1, floor(n * p))]``, of every group and period.

    ``start_of`` gives the period of a time, null for times outside the wanted range; periods have to be made of whole windows of the
    sketch.  The stored sketch tells in which bucket a percentile lies and its rank inside; only the values of these
    buckets are taken from the log, counted per distinct value, and put in order.
    """
    counts = sketch.select(by, start_of(F.col("window_start")).alias("start"), "bucket", "n").filter("start IS NOT NULL")
    counts = counts.groupBy(by, "start", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(by, "start")
    placed = counts.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "all": F.sum("n").over(group)})
    wanted = placed.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])))
    rank, before = F.least(F.col("all") - 1, F.floor(F.col("all") * F.col("p"))), F.col("upto") - F.col("n")
    target = wanted.filter((before <= rank) & (rank < F.col("upto"))).select(F.struct(by, "start", "bucket").alias("k"), "p", (rank - before).alias("left"))

    key = F.struct(by, start_of(F.col("start_ts").cast("timestamp")).alias("start"), value_bucket(F.col(value)).alias("bucket"))
    values = log.filter(F.col(value).isNotNull()).select(key.alias("k"), F.col(value).alias("v"))
    # A struct is never null, so groups without name meet.
    inside = values.join(target, "k").groupBy("k", "p", "left", "v").agg(F.count("*").alias("n"))
    inside = inside.withColumn("upto", F.sum("n").over(W.partitionBy("k", "p").orderBy("v")))
    found = inside.filter((F.col("upto") - F.col("n") <= F.col("left")) & (F.col("left") < F.col("upto")))
    return found.select(F.col(f"k.{by}").alias(by), F.col("k.start").alias("start"), "p", F.col("v").alias(value))
