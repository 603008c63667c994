"""Aggregation of scores and comparison of models.  Every aggregate is over a small key and
is combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.scoring import ERROR_BELOW, METRICS

# Report labels; other metrics are shown by their name in title case.
LABELS = {
    "entity_f1": "Entity F1",
    "entity_recall": "Entity Recall",
    "entity_precision": "Entity Precision",
    "section_recall": "Section Recall",
    "section_precision": "Section Precision",
    "date_normalization_recall": "Date Recall",
    "date_normalization_precision": "Date Precision",
    "financial_recall": "Financial Recall",
    "financial_precision": "Financial Precision",
    "structural_fidelity": "Structural Fidelity",
    "hallucination_count": "Avg Hallucinations",
}
RATE = "valid_json_rate"
PLACES = 6


def _aggregates() -> list[Column]:
    mean = lambda c: F.round(F.avg(c), PLACES)
    out = [
        F.count("*").alias("total_samples"),
        F.count_if(F.col("valid_json") & (F.col("entity_f1") < ERROR_BELOW)).alias("error_samples"),
        mean(F.col("valid_json").cast("double")).alias(RATE),
    ]
    out += [mean(m).alias(m) for m in METRICS]
    # The plain means are over scored outputs only; these count an unscored one as 0.
    out += [mean(F.coalesce(F.col(m), F.lit(0.0))).alias(f"{m}_all") for m in METRICS if m != "hallucination_count"]
    return out


def model_metrics(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(*_aggregates())


def valid_json_rate(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(
        F.count("*").alias("total_samples"),
        F.count_if("valid_json").alias("valid_samples"),
        F.round(F.avg(F.col("valid_json").cast("double")), PLACES).alias(RATE),
    )


def metrics_by_scenario(scores: DataFrame) -> DataFrame:
    """Means per model and scenario with totals over either and both: sums and counts per model and
    scenario first, and only these few rows are cubed."""
    measured = {RATE: F.col("valid_json").cast("double"), **{m: F.col(m) for m in METRICS}}
    parts = scores.groupBy("model", "scenario").agg(
        F.count("*").alias("n"),
        *[f(c).alias(f"{k}_{m}") for m, c in measured.items() for k, f in (("sum", F.sum), ("n", F.count))],
    )
    cubed = parts.cube("model", "scenario").agg(
        F.sum("n").alias("total_samples"),
        *[F.round(F.try_divide(F.sum(f"sum_{m}"), F.sum(f"n_{m}")), PLACES).alias(m) for m in measured],
    )
    return cubed.withColumns({c: F.coalesce(c, F.lit("(all)")) for c in ("model", "scenario")})


def model_coverage(models: DataFrame, results: DataFrame) -> DataFrame:
    """Every expected model with its result.  One that has an ``error`` failed, one without result was
    skipped; both get rate 0 and no metrics."""
    if "error" not in models.columns:
        models = models.withColumn("error", F.lit(None).cast("string"))
    joined = models.join(results, "model", "left")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("total_samples").isNull(), "skipped").otherwise("evaluated")
    joined = joined.withColumn("status", status)
    ran = F.col("status") == "evaluated"
    rest = [c for c in results.columns if c not in ("model", "total_samples", "error_samples", RATE)]
    return joined.withColumns(
        {
            **{c: F.when(ran, F.col(c)).otherwise(F.lit(0).cast("bigint")) for c in ("total_samples", "error_samples")},
            RATE: F.when(ran, F.col(RATE)).otherwise(0.0),
            **{c: F.when(ran, F.col(c)) for c in rest},
        }
    )


def merge_results(results: list[DataFrame]) -> DataFrame:
    """Union of per-model results whose metric sets may differ."""
    merged = results[0]
    for r in results[1:]:
        merged = merged.unionByName(r, allowMissingColumns=True)
    return merged


def metrics_long(results: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """(model, metric, value); a metric a model lacks is 0."""
    filled = results.select("model", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in metrics])
    return filled.unpivot("model", list(metrics), "metric", "value")


def label(metric: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, metric), F.initcap(F.replace(metric, F.lit("_"), F.lit(" "))))


def fixed(value: Column, places: int) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", value))


def percent(value: Column) -> Column:
    return F.concat(fixed(value * 100, 1), F.lit("%"))


def signed(difference: Column, places: int = 4) -> Column:
    return F.concat(F.when(difference >= 0, "+").otherwise(""), fixed(difference, places))


def metrics_pivot(results: DataFrame, models: list[str], metrics: list[str] = METRICS) -> DataFrame:
    """Metric rows by model columns as report text; N/A where a model has no value."""
    long = results.unpivot("model", [RATE, *metrics], "metric", "value")
    shown = (
        F.when(F.col("metric") == RATE, percent(F.col("value")))
        .when(F.col("metric") == "hallucination_count", fixed(F.col("value"), 2))
        .otherwise(fixed(F.col("value"), 4))
    )
    text = long.select("model", "metric", F.when(F.col("value").isNotNull(), shown).otherwise("N/A").alias("shown"))
    wide = text.groupBy("metric").pivot("model", models).agg(F.first("shown", ignorenulls=True))
    named = F.when(F.col("metric") == RATE, "Valid JSON Rate").otherwise(label(F.col("metric")))
    return wide.select(
        "metric", named.alias("label"), *[F.coalesce(m, F.lit("N/A")).alias(m) for m in models]
    )


def metrics_delta(results: DataFrame, old: str, new: str, metrics: list[str] = METRICS) -> DataFrame:
    """Change of every metric from one model to another; the valid rate in percentage points."""
    long = results.unpivot("model", [RATE, *metrics], "metric", "value")
    both = long.groupBy("metric").pivot("model", [old, new]).agg(F.first("value", ignorenulls=True))
    change = F.col(new) - F.col(old)
    shown = F.when(F.col("metric") == RATE, F.concat(signed(change * 100, 1), F.lit(" pp"))).otherwise(signed(change))
    return both.select(
        "metric", F.round(change, PLACES).alias("change"), F.coalesce(shown, F.lit("N/A")).alias("shown")
    )


def find_model(results: DataFrame, part: str, order: str = "model") -> DataFrame:
    """First model, by the ``order`` column (the place in a list, for one), whose name holds ``part`` in any case."""
    hits = results.filter(F.contains(F.lower("model"), F.lit(part.lower())))
    return hits.agg(F.min_by("model", order).alias("model")).withColumn("part", F.lit(part))
