"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions.chat import chat_example
from factloom.operators import generate as G
from factloom.operators.corrupt import preference_pairs, with_corruption
from factloom.plans.pseudo_models import predictions
from factloom.operators.scoring import prediction_side, score, stored_features, truth_features
from factloom.session import configure, shared_dir, written
from factloom.sources.tables import facts, table

GIVEN = {
    "org_a": "organization", "person_a": "person", "product": "product", "location": "location", "day": "day",
}


def slots(spark: SparkSession, sf: str) -> DataFrame:
    return G.with_slots(table(configure(spark), sf, "orders"), "o_orderkey")


def examples(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """One example per order, with the named columns (all by default; ``example_id`` always)."""
    return G.generate_examples(table(configure(spark), sf, "orders"), "o_orderkey", columns=columns or G.COLUMNS)


def example_ids(spark: SparkSession, sf: str) -> DataFrame:
    return examples(spark, sf, "scenario").select("example_id")


def fact_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Slots taken from the order's own organization, person, product, place and date."""
    return G.missing_slots(G.with_slots(facts(configure(spark), sf), "example_id", given=GIVEN))


def facts_table(spark: SparkSession, sf: str) -> DataFrame:
    return facts(configure(spark), sf)


def fact_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Examples built from the orders' own values; incomplete rows are left out."""
    return G.examples_from_slots(fact_slots(spark, sf).filter(F.size("missing") == 0).drop("missing"))


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Examples without their texts."""
    return examples(spark, sf, "scenario", *G.RECORD_FIELDS, "record_json")


def corrupted(spark: SparkSession, sf: str, kind: str | None = None) -> DataFrame:
    return with_corruption(records(spark, sf), kind=kind)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return preference_pairs(examples(spark, sf))


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Raw outputs of the stand-in models."""
    return predictions(records(spark, sf))


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return examples(spark, sf, "scenario", "record_json")


def scores(spark: SparkSession, sf: str, metrics: list[str] | None = None) -> DataFrame:
    """Scores of the stand-in models, with all metrics or some.  The examples are generated once: what both sides need is
    written."""
    ex = written(records(spark, sf), "examples")
    return score(predictions(ex), ex.select("example_id", "scenario", "record_json"), metrics=metrics)


def stored_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Features of the stand-in models' outputs and of the truth, dealt alike, in tables of their own."""
    ex = written(records(spark, sf), "examples")
    sides = {"predicted": prediction_side(predictions(ex)), "truth": truth_features(ex.select("example_id", "scenario", "record_json"))}
    base = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    return tuple(stored_features(side, f"{base}/{name}") for name, side in sides.items())


def chat_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = examples(spark, sf)
    return df.select("example_id", "scenario", "record_json", chat_example(F.col("text"), F.col("record_json")).alias("messages"))


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    return request_rows(table(configure(spark), sf, "events"))


def request_rows(events: DataFrame) -> DataFrame:
    """Events as requests: the value is the latency in tenths of a second."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "purchase", "invalid_json").when(kind == "signup", "timeout")
        .when(kind == "error", "error").otherwise("ok")
    )
    code = F.when(kind == "signup", 504).when(kind == "error", 500).otherwise(200)
    return events.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")).alias("service"),
        F.col("ts").alias("start_ts"),
        (F.col("value") / 10).alias("elapsed_s"),
        status.alias("status"),
        code.alias("status_code"),
        F.when(code != 200, F.concat(F.lit("failed: "), kind)).alias("error"),
    )


def train_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as log entries of twenty runs: which values an entry has depends on its type."""
    kind, v = F.col("event_type"), F.col("value")
    k = F.get_json_object("props", "$.k").cast("int")
    is_summary = (kind == "purchase") & (k % 5 == 0)
    return table(configure(spark), sf, "events").select(
        F.concat(F.lit("run-"), (F.col("user_id") % 20).cast("string")).alias("run"),
        F.col("event_id").alias("pos"),
        F.when(k % 11 != 0, F.col("event_id") * 5).alias("step"),
        F.when(kind.isin("click", "view", "purchase"), v / 5).alias("loss"),
        F.when(k % 7 != 0, k / 100).alias("mean_token_accuracy"),
        F.when(k % 3 != 0, v / 50).alias("entropy"),
        F.when((kind == "signup") | (is_summary & (k % 2 == 0)), v / 10).alias("eval_loss"),
        F.when(is_summary, v * 60).alias("train_runtime"),
        F.when(is_summary, v / 10).alias("train_loss"),
        F.when(k % 13 != 0, k / 10).alias("rewards_chosen"),
        F.when(k % 17 != 0, v / 10).alias("rewards_rejected"),
        F.when(k % 2 == 0, k / 10 - v / 10 + 0.5).alias("rewards_margins"),
    )
