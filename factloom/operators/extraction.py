"""Extraction over a table or a stream of requests: admission, prompt, generation, response."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.record_parts import SECTION_FIELDS, with_parts
from factloom.functions.recovery import with_candidate

MAX_CHARS = 8000
TIMEOUT_MS = 120_000.0
PROMPT = (
    "Return one JSON object describing the event in the text below: event_type, entities, "
    "dates, financials, relationships, metrics.\n\n"
)

# Months as printed, currency signs, scale letters.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE_PATTERN = f"(?:{MONTHS}) [0-9]{{1,2}}, [0-9]{{4}}"
AMOUNT_PATTERN = r"[$€£¥][0-9]+(?:\.[0-9]+)?[MB]"
NAME_PATTERN = r"""[A-Z][^\s,.;:()"']*(?: [A-Z&][^\s,.;:()"']*)+"""


def with_admission(requests: DataFrame, text: str = "text", limit: int | None = None) -> DataFrame:
    """``admission``: ok, empty or, above a ``limit``, too_large.  Rejected requests stay as rows."""
    length = F.length(text)
    label = F.when(F.coalesce(length, F.lit(0)) == 0, "empty")
    label = label if limit is None else label.when(length > limit, "too_large")
    return requests.withColumn("admission", label.otherwise("ok"))


def with_prompt(requests: DataFrame, text: str = "text") -> DataFrame:
    return requests.withColumn("prompt", F.concat(F.lit(PROMPT), F.col(text)))


def normalized_date(raw: Column) -> Column:
    """ISO form of a printed date, null if it is none."""
    return F.date_format(F.try_to_timestamp(raw, F.lit("MMMM d, yyyy")), "yyyy-MM-dd")


def amount_value(text: Column) -> Column:
    """Whole units of an amount such as $1.5B."""
    scale = F.when(F.substring(text, -1, 1) == "B", 1_000_000_000).otherwise(1_000_000)
    number = F.regexp_replace(text, "[^0-9.]", "").cast("decimal(20,6)")
    return (number * scale).cast("bigint")


def rule_based_output(text: Column) -> Column:
    """JSON record found by patterns alone; stands in for a model in offline runs."""
    find = lambda pattern: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    names = F.filter(find(NAME_PATTERN), lambda n: ~n.rlike(f"^(?:{MONTHS}) "))
    return F.to_json(
        F.struct(
            F.lit("unknown").alias("event_type"),
            F.transform(names, lambda n: F.struct(F.lit("organization").alias("type"), n.alias("name"))).alias("entities"),
            F.transform(
                find(DATE_PATTERN),
                lambda d: F.struct(d.alias("raw"), normalized_date(d).alias("normalized")),
            ).alias("dates"),
            F.transform(
                find(AMOUNT_PATTERN),
                lambda a: F.struct(
                    F.lit("amount").alias("type"), amount_value(a).alias("amount"), F.substring(a, 1, 1).alias("currency")
                ),
            ).alias("financials"),
        )
    )


def generate_outputs(
    requests: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], key: str = "request_id", text: str = "text"
) -> DataFrame:
    """The requests without ``text``, with raw_output, error, loaded and latency_ms from a model on the executors.

    ``load`` returns the function that turns a list of texts into their outputs; a Python worker calls it once
    and keeps what it returned for its later tasks.  If a batch fails, its texts are tried one by one, and one
    that fails gives a row with ``error``; if the model cannot be loaded, every row says so (``loaded`` false).
    latency_ms is the batch's time shared by its texts.  Size the partitions by inference cost, and write the
    result before recovery, so that changed rules do not repeat inference.
    """
    token = uuid.uuid4().hex
    names = [c for c in requests.columns if c != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sys
        import time

        models = sys.__dict__.setdefault("_loaded_models", {})  # lives as long as the worker process
        if token not in models:
            try:
                models[token] = load(), None
            except Exception as e:
                models[token] = None, f"{type(e).__name__}: {e}"
        generate, failed = models[token]
        for batch in batches:
            texts, start = list(batch[text]), time.perf_counter()
            if generate is None:
                results = [(None, failed)] * len(texts)
            else:
                try:
                    results = [(out, None) for out in generate(texts)]
                    if len(results) != len(texts):
                        raise ValueError(f"{len(results)} outputs for {len(texts)} texts")
                except Exception:
                    results = []
                    for t in texts:
                        try:
                            results.append((generate([t])[0], None))
                        except Exception as e:  # one bad text must not fail the job
                            results.append((None, f"{type(e).__name__}: {e}"))
            took = (time.perf_counter() - start) * 1000 / max(1, len(texts))
            out = batch[names].copy()
            out["raw_output"], out["error"] = [r for r, _ in results], [e for _, e in results]
            out["loaded"], out["latency_ms"] = generate is not None, took
            yield out

    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields if f.name != text)
    return requests.mapInPandas(run, schema=f"{carried}, raw_output string, error string, loaded boolean, latency_ms double")


# --- typed projection -------------------------------------------------------------

def typed_projection(df: DataFrame, json_text: str = "json_text", also: Sequence[str] = ()) -> DataFrame:
    """Add ``typed_ok`` and ``result`` (struct of typed sections, null on mismatch; see ``with_parts``).  This is independent
    of schema validity.  ``df`` holds recovered texts (``recover``) or candidates (``with_candidate``), whose validity and
    parts named in ``also`` are found in the same pass."""
    if "_candidate" in df.columns:
        df = with_parts(df, (*also, "result"))
    else:
        df = with_parts(df.withColumn("_candidate", F.col(json_text)), ("result",), prefix="_typed_")
        df = df.drop("result", "_typed_valid_json", "_typed_is_object").withColumnRenamed("_typed_result", "result")
    return df.withColumn("typed_ok", F.col("result").isNotNull())


def short_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8)


def respond(
    outputs: DataFrame, include_raw: bool = True, raw: str = "raw_output", key: str = "request_id"
) -> DataFrame:
    """Response rows from raw outputs: recover (no truncation repair), validate and project, all in one pass over the text."""
    df = typed_projection(with_candidate(outputs, raw), also=("violations",))
    df = df.withColumn("schema_valid", F.coalesce(F.col("is_object") & (F.size("violations") == 0), F.lit(False)))
    return df.select(
        key,
        "result",
        F.when(F.lit(include_raw), F.col(raw)).alias("raw_output"),
        "valid_json",
        "schema_valid",
        "typed_ok",
        *[c for c in ("latency_ms", "error", "admission", "loaded") if c in outputs.columns],
    )


def request_status(admission: Column, latency_ms: Column, error: Column, valid_json: Column, loaded: Column) -> Column:
    """Outcome label of a request; the first that applies.  An empty text never gets past the
    request check and has no label of its own."""
    return (
        F.when(admission == "empty", "rejected")
        .when(~loaded, "unavailable")
        .when(admission == "too_large", "too_large")
        .when(latency_ms > TIMEOUT_MS, "timeout")
        .when(error.isNotNull(), "error")
        .when(valid_json, "ok")
        .otherwise("invalid_json")
    )


def section_rows(df: DataFrame, section: str, key: str = "example_id") -> DataFrame:
    """One row per element of a section of ``result``; a record without any gives one row
    with nulls."""
    return df.select(key, F.posexplode_outer(f"result.{section}").alias("pos", "e")).select(
        key, "pos", *[F.col(f"e.{f}").alias(f) for f in SECTION_FIELDS[section]]
    )
