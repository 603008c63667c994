"""Streaming forms of the batch transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.extraction import generate_outputs, respond, with_admission
from factloom.operators.requests import request_metrics_windowed
from factloom.sources.jsonl import exists, is_complete


def request_stream(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """Requests arriving as files.  The schema is stated, never inferred."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def extract_requests(
    requests: DataFrame, generate: Callable[[DataFrame], DataFrame], key: str = "request_id", text: str = "text", limit: int | None = None
) -> DataFrame:
    """Requests to responses, for a batch table or a stream: admission, generation, recovery,
    validation, projection.  A rejected request stays as a row without output and never reaches the model.

    ``generate`` takes (key, text, admission) and gives back the other columns with raw_output, error, loaded and
    latency_ms; everything is row by row, so the stream needs no state."""
    admitted = with_admission(requests.select(key, text), text, limit)
    done = generate(admitted.filter(F.col("admission") == "ok"))
    rejected = admitted.filter(F.col("admission") != "ok").select(
        key, "admission", F.lit(None).cast("string").alias("raw_output"), F.lit(None).cast("string").alias("error"),
        F.lit(True).alias("loaded"), F.lit(0.0).alias("latency_ms"),
    )
    return respond(done.unionByName(rejected), key=key)


def model_generator(load: Callable[[], Callable[[list[str]], list[str]]], key: str, text: str) -> Callable[[DataFrame], DataFrame]:
    """Generation by a plugged-in model for ``extract_requests``."""
    return lambda df: generate_outputs(df, load, key, text)


def windowed_metrics(requests: DataFrame, late_by: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Status counts and latency buckets per window; rows later than the watermark are dropped (``split_late``
    keeps them)."""
    return request_metrics_windowed(requests.withWatermark("start_ts", late_by), width)


def split_late(requests: DataFrame, out: str, checkpoint: str, late_by: str = "10 minutes", width: str = "1 hour") -> StreamingQuery:
    """Land a stream of requests in two tables: ``out/rows``, and ``out/late`` with those whose window was over already.

    A window is over when it ends ``late_by`` before the latest time of an earlier batch, which is the rule of the
    watermark.  The mark is one row per batch, and a batch reads that of the batch before it.  A batch that runs again
    finds the same rows late, and keeps what it has landed.  Rows without time belong to no window and are late.
    """
    spark = requests.sparkSession

    def land(batch: DataFrame, number: int) -> None:
        before = f"{out}/marks/batch={number - 1}"
        mark = spark.read.schema("mark timestamp").parquet(before).first().mark if exists(spark, before) else None
        # A window of a null time would leave the row out.
        over = F.window(F.coalesce("start_ts", F.lit(0).cast("timestamp")), width)["end"] <= F.lit(mark).cast("timestamp")
        marked = batch.withColumn("_late", F.col("start_ts").isNull() | F.coalesce(over, F.lit(False)))
        for name, late in (("rows", False), ("late", True)):
            path = f"{out}/{name}/batch={number}"
            if not is_complete(spark, path):
                marked.filter(F.col("_late") == late).drop("_late").write.mode("overwrite").parquet(path)
        latest = F.max("start_ts").cast("timestamp") - F.expr(f"INTERVAL '{late_by}'")
        batch.agg(F.greatest(F.lit(mark).cast("timestamp"), latest).alias("mark")).write.mode("overwrite").parquet(f"{out}/marks/batch={number}")

    query = requests.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def closed_windows(spark: SparkSession, schema: str, out: str, checkpoint: str, late_by: str = "10 minutes", width: str = "1 hour") -> StreamingQuery:
    """Metrics of the windows that are over, each once, in ``out/windows``: a stream over the rows that ``split_late``
    has landed, in append mode.  Its watermark is never ahead of the mark they were split by, so none is dropped."""
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{out}/rows")
    return run_available(windowed_metrics(rows, late_by, width), f"{out}/windows", checkpoint)


#: Ids live in RocksDB beside the tasks; a batch looks up its own and saves what it changed.
ID_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def intake_once(requests: DataFrame, out: str, checkpoint: str, key: str = "request_id", within: str | None = None, at: str = "start_ts") -> StreamingQuery:
    """Land every id once, however late a copy comes, a folder per batch.

    The ids are the state of the stream, dealt by hash of the id, so a batch costs what it brings and not what came before it;
    with ``within`` (an interval on the time column ``at``) an id is forgotten that long after it came, which bounds the state.
    A batch that runs again finds the state it began with and replaces its folder.  Rows without id cannot be
    told apart and are all kept.
    """
    spark = requests.sparkSession
    known = requests.filter(F.col(key).isNotNull())
    known = known.withWatermark(at, within).dropDuplicatesWithinWatermark([key]) if within else known.dropDuplicates([key])

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    had = {name: spark.conf.get(name, None) for name in ID_STATE}
    try:
        for name, value in ID_STATE.items():
            spark.conf.set(name, value)
        rows = known.unionByName(requests.filter(F.col(key).isNull()))
        query = rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in had.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return query


def latest_totals(totals: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Aggregates of a stream over all it has brought so far; every batch replaces the table in ``out``."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = totals.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what has arrived, then stop.  Offsets and state are in ``checkpoint``, so a lost
    executor or a restarted job goes on where it was."""
    query = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
