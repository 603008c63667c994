"""Controlled corruption of records and preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom import vocabulary as V
from factloom.functions.chat import chat_prompt, message
from factloom.functions.plan import built_once, staged
from factloom.functions.draws import pick, with_draws
from factloom.operators.generate import RECORD_FIELDS, SECTIONS, SEED, text_array

# The seven kinds of corruption, the key that holds flattened names and the
# key of the unofficial note.
KINDS = [
    "drop_entity", "hallucinate_entity", "wrong_field_type", "missing_field",
    "flat_instead_of_nested", "bad_normalization", "multiple_errors",
]
FLAT_KEY = "extracted_entities"
NOTE_KEY = "_note"
NOTE = "not checked"
AMOUNT_PREFIX = "about "
SWAP_PER_MILLE = 50
DRAWS = ["kind", "item", "section", "swap"]


def _filled(section: str) -> Column:
    return F.coalesce(F.size(section), F.lit(0)) > 0


@built_once
def _sections() -> Column:
    """Names of the sections that have elements."""
    return F.filter(F.array(*[F.when(_filled(s), F.lit(s)) for s in SECTIONS]), lambda s: s.isNotNull())


@built_once
def _corrupted_fields() -> list[Column]:
    """The record's fields after the corruption named in ``kind``."""
    item, is_kind = F.col("draw_item"), lambda k: F.col("kind") == k
    kept = lambda section: F.coalesce(F.col("_lost") != section, F.lit(True))

    entities, financials, dates = F.col("entities"), F.col("financials"), F.col("dates")
    at = lambda section: F.pmod(item, F.size(section)).cast("int")
    several = F.size(entities) > 1
    fakes = F.array(
        *[F.struct(F.lit(t).alias("type"), F.lit(n).alias("name")) for t, n in V.INVENTED_ENTITIES]
    )
    new_entities = (
        F.when(is_kind("drop_entity") & several, F.filter(entities, lambda e, i: i != at(entities)))
        .when(is_kind("hallucinate_entity"), F.array_append(entities, pick(fakes, item)))
        .when(is_kind("multiple_errors") & several, F.filter(entities, lambda e, i: i != 0))
        .when(is_kind("flat_instead_of_nested") | ~kept("entities"), F.lit(None))
        .otherwise(entities)
    )
    as_text = lambda f: F.concat(F.lit(AMOUNT_PREFIX), f["amount"].cast("string")).cast("variant")
    new_financials = (
        F.when(
            is_kind("wrong_field_type") & _filled("financials"),
            F.transform(financials, lambda f, i: F.when(i == at(financials), f.withField("amount", as_text(f))).otherwise(f)),
        )
        .when(
            is_kind("multiple_errors") & _filled("financials"),
            F.transform(
                financials,
                lambda f, i: F.when(i == 0, f.withField("amount", F.lit(None).cast("variant"))).otherwise(f),
            ),
        )
        .when(kept("financials"), financials)
    )
    new_dates = (
        F.when(
            is_kind("bad_normalization") & _filled("dates"),
            F.transform(dates, lambda d, i: F.when(i == at(dates), d.withField("normalized", d["raw"])).otherwise(d)),
        )
        .when(kept("dates"), dates)
    )
    changed = {
        "entities": new_entities,
        "financials": new_financials,
        "dates": new_dates,
        "relationships": F.when(kept("relationships"), F.col("relationships")),
        "metrics": F.when(kept("metrics"), F.col("metrics")),
    }
    fields = [changed.get(f, F.col(f)).alias(f) for f in RECORD_FIELDS]
    fields.append(
        F.when(is_kind("flat_instead_of_nested"), F.transform(entities, lambda e: e["name"])).alias(FLAT_KEY)
    )
    fields.append(F.when(is_kind("multiple_errors"), F.lit(NOTE)).alias(NOTE_KEY))
    return fields


def with_corruption(examples: DataFrame, seed: int = SEED, kind: str | None = None) -> DataFrame:
    """Add ``kind`` and ``corrupted_json``.  A kind that has nothing to work on (one entity
    left, no amounts, no dates) leaves the record as it is."""
    df = with_draws(examples, "example_id", seed, "pair", DRAWS)
    df = staged(df, {"kind": F.lit(kind) if kind else pick(text_array(KINDS), F.col("draw_kind"))})
    place = F.lit(1) + F.pmod(F.col("draw_section"), F.greatest(F.size(_sections()), F.lit(1)))
    df = staged(df, {"_lost": F.when(F.col("kind") == "missing_field", F.try_element_at(_sections(), place.cast("int")))})
    return staged(df, {"corrupted_json": F.to_json(F.struct(*_corrupted_fields()))}).drop(
        "_lost", "draw_kind", "draw_item", "draw_section"
    )


def preference_pairs(examples: DataFrame, seed: int = SEED) -> DataFrame:
    """(prompt, chosen, rejected) message arrays.  ``chosen`` is the true record; for one pair
    in twenty the two are exchanged, which ``swapped`` records."""
    df = with_corruption(examples, seed)
    df = df.withColumn("swapped", F.pmod("draw_swap", F.lit(1000)) < SWAP_PER_MILLE)
    chosen = F.when(F.col("swapped"), F.col("corrupted_json")).otherwise(F.col("record_json"))
    rejected = F.when(F.col("swapped"), F.col("record_json")).otherwise(F.col("corrupted_json"))
    carried = [c for c in ("source_split",) if c in examples.columns]
    return df.select(
        "example_id", "scenario", "kind", "swapped", *carried,
        chat_prompt(F.col("text")).alias("prompt"),
        F.array(message("assistant", chosen)).alias("chosen"),
        F.array(message("assistant", rejected)).alias("rejected"),
    )


def source_union(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """Train rows and held-out rows; ``source_split`` shows which came from where."""
    return train.withColumn("source_split", F.lit("train")).unionByName(held_out.withColumn("source_split", F.lit("eval")))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Prompt as one string with a generation header; answers as bare content."""
    from factloom.functions.chat import render_messages

    return pairs.select(
        "example_id",
        render_messages(F.col("prompt"), generation_header=True).alias("prompt"),
        F.col("chosen")[0]["content"].alias("chosen"),
        F.col("rejected")[0]["content"].alias("rejected"),
    )
