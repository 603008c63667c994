"""Seeded draws.  Every random choice is a pure function of (seed, stage, row id), so a
retried task, another partitioning or another engine gives the same value.

One md5 digest carries six 20-bit draws: two words of 15 hex digits, three draws in each.
A stage with sixteen draws therefore costs three digests per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.plan import staged

DRAWS_PER_DIGEST = 6
DRAWS_PER_WORD = 3
DRAW_BITS = 20


def digest(seed: int, stage: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:{stage}:"), key.cast("string")))


def word(digest_col: Column, number: int) -> Column:
    """60-bit integer from the first or second 15 hex digits of a digest."""
    return F.conv(F.substring(digest_col, 1 + 15 * number, 15), 16, 10).cast("bigint")


def lane(word_col: Column, number: int) -> Column:
    """20-bit integer from a word."""
    return F.shiftright(word_col, DRAW_BITS * number).bitwiseAND((1 << DRAW_BITS) - 1)


def with_draws(
    df: DataFrame, key: str, seed: int, stage: str, names: Sequence[str]
) -> DataFrame:
    """Add one BIGINT column ``draw_<name>`` per name."""
    digests = (len(names) + DRAWS_PER_DIGEST - 1) // DRAWS_PER_DIGEST
    words = (len(names) + DRAWS_PER_WORD - 1) // DRAWS_PER_WORD
    out = df.withColumns({f"_digest{d}": digest(seed, f"{stage}{d}", key) for d in range(digests)})
    out = staged(out, {f"_word{w}": word(F.col(f"_digest{w // 2}"), w % 2) for w in range(words)})
    out = out.withColumns(
        {
            f"draw_{name}": lane(F.col(f"_word{i // DRAWS_PER_WORD}"), i % DRAWS_PER_WORD)
            for i, name in enumerate(names)
        }
    )
    return out.drop(*[f"_digest{d}" for d in range(digests)], *[f"_word{w}" for w in range(words)])


def pick(items: Column, draw: Column, without: Sequence[Column] = ()) -> Column:
    """Item of an array chosen by a draw, avoiding the values in ``without``; if those
    leave nothing, the whole array is used again."""
    if without:
        left = F.array_except(items, F.array(*without))
        items = F.when(F.size(left) > 0, left).otherwise(items)
    return F.element_at(items, (F.lit(1) + F.pmod(draw, F.size(items))).cast("int"))


def places_of(values: Sequence[str], slot: Column) -> Column:
    """1-based place of a value among fixed ones, 0 if it is none of them."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), slot), F.lit(0))


def pick_from(values: Sequence[str], draw: Column, taken: Sequence[Column] = ()) -> Column:
    """``pick`` from distinct fixed values, of which there are more than ``taken``, the places (``places_of``) of at most two
    values to avoid.  The free places are counted through instead of building the array of what is left."""
    assert len(taken) <= 2 and len(taken) < len(values) == len(set(values))
    first, second = [F.lit(0).cast("long")] * (2 - len(taken)) + list(taken)
    low, high = F.when(first == second, 0).otherwise(F.least(first, second)), F.greatest(first, second)
    left = F.lit(len(values)) - (low > 0).cast("int") - (high > 0).cast("int")
    place = F.lit(1) + F.pmod(draw, left)
    for gone in (low, high):
        place = place + ((gone > 0) & (place >= gone)).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), place.cast("int"))


def between(draw: Column, low: int, high: int) -> Column:
    """Whole number in [low, high]."""
    return F.lit(low) + F.pmod(draw, F.lit(high - low + 1))
