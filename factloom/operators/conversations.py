"""Chat rows stored one turn per row.

A conversation is a sequence of pieces: rows of at most ``TURNS_PER_PIECE`` turns, numbered, the last one marked.  So a
conversation may be as long as the table, and no task and no row holds a whole one.  Turns without a conversation
id are a conversation like any other.  ``to_messages`` gives whole conversations as rows where they are
known to be short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions import chat
from factloom.functions.running import totals_before

TURNS_PER_PIECE = 256
BODY_WORD = r"\s*\S+(?:\s+\z)?"


def turn_order() -> list[Column]:
    """Order within a conversation: by turn, those without turn first; rows that share one by role and a hash of the text."""
    return [F.asc("turn"), F.asc("role"), F.xxhash64("text").asc()]


def message_pieces(turns: DataFrame, size: int = TURNS_PER_PIECE) -> DataFrame:
    """(conv_id, piece, last, messages) from (conv_id, turn, role, text): ``size`` turns a piece, numbered from 0."""
    rows = turns.select("conv_id", "turn", "role", "text", F.lit(1).alias("n"))
    placed = totals_before(rows, "conv_id", turn_order(), "n")
    piece = F.floor(F.col("before") / size)
    turns_of = F.array_sort(F.collect_list(F.struct("before", "role", "text")))
    message = lambda m: chat.message(m["role"], m["text"])
    return placed.groupBy("conv_id", piece.alias("piece"), "total").agg(turns_of.alias("t")).select(
        "conv_id", "piece", ((F.col("piece") + 1) * size >= F.col("total")).alias("last"), F.transform("t", message).alias("messages")
    )


def to_messages(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): whole conversations as rows.  A view for conversations that a row can hold."""
    pieces = message_pieces(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", "messages"))).alias("p"))
    return pieces.select("conv_id", F.flatten(F.transform("p", lambda p: p["messages"])).alias("messages"))


def rendered_pieces(pieces: DataFrame, generation_header: bool = False) -> DataFrame:
    """(conv_id, piece, last, n_messages, rendered); the header comes once, behind a conversation's last piece."""
    text = chat.render_messages(F.col("messages"))
    if generation_header:
        text = F.concat(text, F.when(F.col("last"), F.lit(f"{chat.OPEN}assistant\n")).otherwise(F.lit("")))
    return pieces.select("conv_id", "piece", "last", F.size("messages").cast("long").alias("n_messages"), text.alias("rendered"))


def rendered_whole(pieces: DataFrame, generation_header: bool = False) -> DataFrame:
    """(conv_id, n_messages, rendered): every conversation as one text.  Its turns are dealt and rendered by piece, and only
    the pieces' texts are put together."""
    texts = F.array_sort(F.collect_list(F.struct("piece", "rendered")))
    return rendered_pieces(pieces, generation_header).groupBy("conv_id").agg(
        F.sum("n_messages").alias("n_messages"), F.array_join(F.transform(texts, lambda p: p["rendered"]), "").alias("rendered")
    )


def budget_pieces(
    turns: DataFrame, limit: int, counter: Callable[[Column], Column] = chat.count_words, opening: str = chat.OPEN, closing: str = chat.CLOSE
) -> DataFrame:
    """(conv_id, n_tokens, over_budget, piece_no, piece): every rendered conversation in pieces of at most ``limit`` words.

    Pieces run across turn borders, as if the conversation were one text, and joined they give it back; one within its
    budget is one piece.  A turn's place is the running total of words before it, and each turn gives its part of
    every piece it touches, so a piece is made of at most ``limit`` parts and no conversation is gathered.  n_tokens
    adds up ``counter`` over the turns.  Markers have to begin and end with a word, for no word may
    cross a turn's border.  A turn without role or text is not rendered; a conversation of such turns is one
    empty piece.
    """
    if not opening.strip() == opening != "" or not closing.strip() == closing != "":
        raise ValueError("markers have to be words")
    body = F.coalesce(F.concat(F.lit(opening), "role", F.lit("\n"), "text", F.lit(closing)), F.lit(""))
    rows = turns.select("conv_id", "turn", "role", "text", body.alias("body"))
    rows = rows.select("*", chat.count_words(F.col("body")).cast("long").alias("words"), counter(F.col("body")).cast("long").alias("tokens"))
    placed = totals_before(rows, "conv_id", turn_order(), "words", ("tokens",)).withColumn("over", F.col("total_tokens") > limit)

    before, words = F.col("before"), F.col("words")
    text = F.concat(
        F.when(before > 0, F.lit("\n")).otherwise(F.lit("")), "body", F.when(before + words == F.col("total"), F.lit("\n")).otherwise(F.lit(""))
    )
    first = F.when(F.col("over"), F.floor(before / limit)).otherwise(F.lit(0))
    last = F.when(F.col("over") & (words > 0), F.floor((before + words - 1) / limit)).otherwise(first)

    def part(found: Column, number: Column) -> Column:
        start = F.greatest(number * limit - before, F.lit(0))
        end = F.when(F.col("over"), F.least((number + 1) * limit - before, words)).otherwise(words)
        return F.array_join(F.slice(found, (start + 1).cast("int"), (end - start).cast("int")), "")

    of_turn = lambda found: F.transform(F.sequence(first, last), lambda k: F.struct(k.alias("piece_no"), part(found, k).alias("text")))
    parts = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(BODY_WORD), F.lit(0))), of_turn), F.lit(0))
    cut = placed.select("conv_id", F.col("total_tokens").alias("n_tokens"), F.col("over").alias("over_budget"), "before", "words", F.explode(parts).alias("p"))
    said = F.when(F.col("words") > 0, F.struct("before", "p.text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda s: s["text"]), "")
    return cut.groupBy("conv_id", "n_tokens", "over_budget", F.col("p.piece_no").alias("piece_no")).agg(joined.alias("piece"))


def prompt_turns(turns: DataFrame) -> DataFrame:
    """Turns before the conversation's first assistant turn, without conversation id too.  The first
    assistant turn is a partial-aggregated minimum, so no conversation is gathered."""
    first = (
        turns.filter(F.col("role") == "assistant")
        .groupBy(F.col("conv_id").alias("answered"))
        .agg(F.min("turn").alias("first_answer"))
    )
    return (
        turns.join(first, F.col("conv_id").eqNullSafe(F.col("answered")), "left")
        .filter(F.col("first_answer").isNull() | (F.col("turn") < F.col("first_answer")))
        .drop("answered", "first_answer")
    )


def first_answers(turns: DataFrame) -> DataFrame:
    return (
        turns.filter(F.col("role") == "assistant")
        .groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("answer"))
    )
