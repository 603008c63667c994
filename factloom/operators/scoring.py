"""Scoring of predictions against ground truth.

Each side is first reduced to small arrays (section names, entity names, date pairs, amount
texts) and only these are joined, so the shuffle carries no JSON.  All metrics are then
row-local set arithmetic.  With no truth values recall is 1; with no predicted values
precision is 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.plan import staged
from factloom.functions.record_parts import ALL_MADE, NOTE_KEY, PARTS, with_parts  # noqa: F401 (the SQL takes the key from here)
from factloom.functions.recovery import repair_truncated, with_candidate

# Metric names, in the order they are reported.
METRICS = [
    "schema_compliance", "section_recall", "section_precision", "entity_recall", "entity_precision",
    "entity_f1", "date_normalization_recall", "date_normalization_precision", "financial_recall",
    "financial_precision", "structural_fidelity", "hallucination_count",
]
ERROR_BELOW = 0.5

# What a metric is made from beside the section names, which tell whether a side is an object.
MADE_FROM = {
    "schema_compliance": ("violations",), "section_recall": (), "section_precision": (),
    **dict.fromkeys(("entity_recall", "entity_precision", "entity_f1", "hallucination_count"), ("names",)),
    **dict.fromkeys(("date_normalization_recall", "date_normalization_precision"), ("dates",)),
    **dict.fromkeys(("financial_recall", "financial_precision"), ("amounts",)),
    "structural_fidelity": ("structure",),
}
# Metrics that need to know how many values of a part both sides have.
SHARED_BY = {
    "keys": {"section_recall", "section_precision"},
    "names": {"entity_recall", "entity_precision", "hallucination_count"},
    "dates": {"date_normalization_recall", "date_normalization_precision"},
    "amounts": {"financial_recall", "financial_precision"},
}


def needed_for(metrics: Sequence[str]) -> tuple[str, ...]:
    """Names of what has to be made of either side for some metrics."""
    wanted = {made for m in metrics for made in MADE_FROM[m]}
    return ("keys", *[n for n in ALL_MADE if n in wanted and n != "keys"])


def truth_features(
    truth: DataFrame, json_text: str = "record_json", key: str = "example_id", made: Sequence[str] = PARTS
) -> DataFrame:
    """(key, truth_keys, truth_names, truth_dates, truth_amounts, other columns), or the parts that are to be ``made``.  A
    truth that cannot be parsed has null parts, so its predictions get no scores."""
    parts = tuple(p for p in PARTS if p in made)
    df = with_parts(with_candidate(truth.withColumnRenamed(json_text, "_truth_text"), "_truth_text"), parts, truth=True, prefix="truth_")
    extra = [c for c in truth.columns if c not in (key, json_text)]
    return df.select(key, *[f"truth_{p}" for p in parts], *extra)


def _shared(part: str) -> Column:
    """How many values both sides have; both hold each value once."""
    return F.size(F.array_intersect(f"truth_{part}", f"pred_{part}"))


def _recall(part: str) -> Column:
    total = F.size(f"truth_{part}")
    return F.when(total > 0, F.col(f"_shared_{part}") / total).when(total == 0, 1.0)


def _precision(part: str) -> Column:
    total = F.size(f"pred_{part}")
    return F.when(total > 0, F.col(f"_shared_{part}") / total).when(total == 0, 0.0)


def align(predictions: DataFrame, truth: DataFrame, key: str = "example_id", how: str = "left") -> DataFrame:
    """Predictions with their truth.  A sort-merge join, which splits hot keys: both sides are columns made from texts, whose
    estimated size has nothing to do with the real one, so Spark's choice would broadcast a truth of any length."""
    return predictions.join(truth.hint("merge"), key, how)


def with_metrics(aligned: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Metric columns, all or some, from the ``pred_*`` and ``truth_*`` parts; null where either side is no
    object."""
    scorable = F.col("pred_keys").isNotNull() & F.col("truth_keys").isNotNull()
    only = lambda c: F.when(scorable, c)
    wanted = {*metrics, *(("entity_recall", "entity_precision") if "entity_f1" in metrics else ())}
    columns = {
        "schema_compliance": only((F.size("violations") == 0).cast("double")),
        "section_recall": only(_recall("keys")),
        "section_precision": only(_precision("keys")),
        "entity_recall": only(_recall("names")),
        "entity_precision": only(_precision("names")),
        "date_normalization_recall": only(_recall("dates")),
        "date_normalization_precision": only(_precision("dates")),
        "financial_recall": only(_recall("amounts")),
        "financial_precision": only(_precision("amounts")),
        "structural_fidelity": only(F.col("structure")),
        "hallucination_count": only((F.size("pred_names") - F.col("_shared_names")).cast("double")),
    }
    # What both sides share is found once for all metrics that are made from it.
    parts = [p for p, users in SHARED_BY.items() if wanted & users]
    df = staged(aligned, {f"_shared_{p}": _shared(p) for p in parts}) if parts else aligned
    df = df.withColumns({m: c for m, c in columns.items() if m in wanted}).drop(*[f"_shared_{p}" for p in parts])
    if "entity_f1" not in metrics:
        return df
    both = F.col("entity_recall") + F.col("entity_precision")
    return df.withColumn(
        "entity_f1",
        F.when(both > 0, 2 * F.col("entity_recall") * F.col("entity_precision") / both).when(both == 0, 0.0),
    )


def prediction_side(
    predictions: DataFrame, raw: str = "raw_output", key: str = "example_id", repair: bool = True, made: Sequence[str] = ALL_MADE
) -> DataFrame:
    """(model, key, valid_json, is_object, violations, structure, pred_skipped, preview, parts) of every prediction; of
    the broken rules, the structure, what is skipped and the parts those to be ``made``."""
    shown = repair_truncated(predictions, raw, "preview") if repair else predictions.withColumn("preview", F.col(raw))
    found = with_parts(with_candidate(shown.select("model", key, "preview"), "preview"), made)
    return found.select(
        "model", key, "valid_json", "is_object", *[n for n in ("violations", "structure", "pred_skipped") if n in made], "preview",
        *[F.col(p).alias(f"pred_{p}") for p in PARTS if p in made],
    )


def score_features(predicted: DataFrame, truth: DataFrame, key: str = "example_id", metrics: Sequence[str] = METRICS) -> DataFrame:
    """Scores from both sides' features."""
    return with_metrics(align(predicted, truth, key), metrics)


def score(
    predictions: DataFrame,
    truth: DataFrame,
    raw: str = "raw_output",
    key: str = "example_id",
    repair: bool = True,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """(model, key, valid_json, is_object, preview, metrics, parts) for every prediction; ``preview`` is the
    whole output as it was parsed, with ``repair`` the repaired one.  Where only some ``metrics`` are asked for, what no
    other but these is made from is not made."""
    made = ALL_MADE if metrics is None else needed_for(metrics)
    predicted, true = prediction_side(predictions, raw, key, repair, made), truth_features(truth, key=key, made=made)
    return score_features(predicted, true, key, METRICS if metrics is None else metrics)


def stored_features(features: DataFrame, path: str, buckets: int = 64, key: str = "example_id") -> DataFrame:
    """Features of either side, written to ``path`` dealt and ordered by ``key``, and read from there.

    Sides stored with the same number of ``buckets`` are joined bucket by bucket: scoring again, with other metrics, models or
    rules, parses nothing and shuffles nothing.  Choose the number so that a bucket fits a task.  A model's predictions that
    come later are stored for themselves.  The table needs no entry in a catalog: another session registers it
    with ``CREATE TABLE ... USING parquet CLUSTERED BY ... LOCATION``.
    """
    spark, name = features.sparkSession, f"features_{uuid.uuid4().hex}"
    dealt = features.repartition(buckets, key)  # one file a bucket
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    stored = spark.table(name)
    stored.schema  # resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return stored


def error_samples(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("valid_json") & (F.col("entity_f1") < ERROR_BELOW))


def hallucinated_names(scores: DataFrame) -> DataFrame:
    """One row per predicted name the truth does not have."""
    return scores.select("model", "example_id", F.explode(F.array_except("pred_names", "truth_names")).alias("name"))


def missed_names(scores: DataFrame) -> DataFrame:
    return scores.select("model", "example_id", F.explode(F.array_except("truth_names", "pred_names")).alias("name"))
