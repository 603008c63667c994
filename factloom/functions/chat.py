"""Chat messages: assembly, rendering, prompt part, length budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

INSTRUCTION = (
    "Read the text and return one JSON object with its event type, entities, dates, "
    "amounts, relationships and metrics. Return JSON only."
)
REQUEST = "Text to read:\n\n"
# Public ChatML markers; every renderer takes others as arguments.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def chat_prompt(text: Column) -> Column:
    return F.array(
        message("system", F.lit(INSTRUCTION)), message("user", F.concat(F.lit(REQUEST), text))
    )


def chat_example(text: Column, answer: Column) -> Column:
    return F.array(
        message("system", F.lit(INSTRUCTION)),
        message("user", F.concat(F.lit(REQUEST), text)),
        message("assistant", answer),
    )


def render_turn(role: Column, content: Column, opening: str = OPEN, closing: str = CLOSE) -> Column:
    return F.concat(F.lit(opening), role, F.lit("\n"), content, F.lit(closing + "\n"))


def render_messages(
    messages: Column, generation_header: bool = False, opening: str = OPEN, closing: str = CLOSE
) -> Column:
    body = F.array_join(
        F.transform(messages, lambda m: render_turn(m["role"], m["content"], opening, closing)), ""
    )
    return F.concat(body, F.lit(f"{opening}assistant\n")) if generation_header else body


def prompt_part(messages: Column) -> Column:
    """Messages before the first assistant turn (all of them if there is none)."""
    first = F.array_position(F.transform(messages, lambda m: m["role"]), "assistant").cast("int")
    return F.when(first > 0, F.slice(messages, F.lit(1), first - 1)).otherwise(messages)


def first_answer(messages: Column) -> Column:
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(1))["content"]


def role_shape(messages: Column) -> dict[str, Column]:
    roles = F.transform(messages, lambda m: m["role"])
    return {f"has_{role}": F.array_contains(roles, role) for role in ("system", "user", "assistant")}


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(words(text))


def length_pieces(text: Column, limit: int) -> Column:
    """The text in pieces of at most ``limit`` white-space words, which joined give it back."""
    tokens = F.regexp_extract_all(text, F.lit(r"\s*\S+(?:\s+\z)?"), F.lit(0))
    cut = lambda t: F.transform(
        F.sequence(F.lit(1), F.size(t), F.lit(limit)), lambda i: F.array_join(F.slice(t, i, F.lit(limit)), "")
    )
    # Bound once: the words are found by one pass over the text.
    bound = F.transform(F.array(tokens), lambda t: F.when(F.size(t) > 0, cut(t)).otherwise(F.array(text)))
    return F.element_at(bound, 1)


def length_budget(
    df: DataFrame, text: str, limit: int, counter: Callable[[Column], Column] = count_words
) -> DataFrame:
    """One row per piece: ``n_tokens`` of the whole text, ``over_budget``, ``piece_no`` from 0 and ``piece``.

    ``counter`` may be any column function, for instance a ``pandas_udf`` around a real tokenizer; pieces are
    cut by white-space words, and nothing of the text is lost.  A null text gives one null piece.
    """
    counted = df.withColumn("n_tokens", counter(F.col(text)))
    pieces = F.when(F.col("n_tokens") > limit, length_pieces(F.col(text), limit)).otherwise(F.array(text))
    rest = [c for c in counted.columns if c != text]
    return counted.withColumn("over_budget", F.col("n_tokens") > limit).select(
        *rest, "over_budget", F.posexplode(pieces).alias("piece_no", "piece")
    )
