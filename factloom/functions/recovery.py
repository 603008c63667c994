"""Recovery of a JSON object from raw model output, as columns.

The steps are staged in separate projections, because every step reads the one before it
several times.  Parsing is strict: exactly one JSON value, nothing after it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.plan import staged

FENCE = "```"
# The characters Unicode counts as white space.
SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Spark's parser stops after the first value.  The candidate is therefore parsed inside an
# array that ends with this mark: the mark is found in second place only if the candidate
# is one value and nothing else.
END_MARK = "␞end␞"


def strip(text: Column) -> Column:
    """The text without white space around.  Trimming the end goes through the whole text, so it is done only where
    the end is white space; ``text`` is read many times and should be a staged column."""
    blank_end = reduce(or_, [text.endswith(c) for c in SPACE])
    return F.when(text.endswith("}") | ~blank_end, F.ltrim(text, F.lit(SPACE))).otherwise(F.btrim(text, F.lit(SPACE)))


def unfence(text: Column, parts: Column) -> Column:
    """Inside of the first closed code fence, without a ``json`` tag; the text itself if no
    fence is closed.  ``parts`` is the text split at its first two fences, null without a fence."""
    inside = F.try_element_at(parts, F.lit(2))
    tagless = F.when(inside.startswith("json"), inside.substr(F.lit(5), F.length(inside))).otherwise(inside)
    return F.when(F.coalesce(F.size(parts) == 3, F.lit(False)), tagless).otherwise(text)


def fence_parts(text: Column) -> Column:
    return F.when(text.contains(FENCE), F.split(text, FENCE, 3))


def _last_brace(text: Column) -> Column:
    """1-based position of the last closing brace, 0 if there is none."""
    after = F.substring_index(text, "}", -1)
    return F.when(text.contains("}"), F.length(text) - F.length(after)).otherwise(0)


def repair_truncated(df: DataFrame, raw: str = "raw_output", out: str = "repaired") -> DataFrame:
    """An output that starts as an object but does not end as one is cut after its last
    closing brace; all others stay as they are.  ``was_truncated`` marks the former."""
    df = staged(df, {"_bare": strip(F.col(raw))})
    bare, end = F.col("_bare"), F.col("_end")
    cut_off = bare.startswith("{") & ~bare.endswith("}")
    df = staged(df, {"was_truncated": cut_off, "_end": F.when(cut_off, _last_brace(bare))})
    cut = F.when(end > 0, bare.substr(F.lit(1), end)).otherwise(bare)
    return staged(df, {out: F.when(F.col("was_truncated"), cut).otherwise(F.col(raw))}).drop("_bare", "_end")


def with_candidate(df: DataFrame, raw: str = "raw_output") -> DataFrame:
    """Add ``_candidate``: the text that has to be one JSON value, null if there is none."""
    df = staged(df, {"_parts": fence_parts(F.col(raw))})
    df = staged(df, {"_inside": unfence(F.col(raw), F.col("_parts"))}).drop("_parts")
    df = staged(df, {"_body": strip(F.col("_inside"))}).drop("_inside")
    body = F.col("_body")
    # Braces are looked for only where the body does not begin and end with them.
    partial = ~(body.startswith("{") & body.endswith("}"))
    df = staged(df, {"_start": F.when(partial, F.instr("_body", "{")), "_end": F.when(partial, _last_brace(body))})
    return staged(
        df,
        {
            "_candidate": F.when(~partial, body)
            .when(
                (F.col("_start") > 0) & (F.col("_end") > F.col("_start")),
                body.substr(F.col("_start"), F.col("_end") - F.col("_start") + 1),
            )
            .when(F.col("_start") == 0, body)
        },
    ).drop("_body", "_start", "_end")


def recover(df: DataFrame, raw: str = "raw_output", repair: bool = False) -> DataFrame:
    """Add ``json_text`` (text of the recovered value), ``parsed`` (VARIANT), ``valid_json``
    and ``is_object``.  With ``repair`` a cut-off output is shortened first."""
    if repair:
        df = repair_truncated(df, raw, "repaired")
        raw = "repaired"
    df = with_candidate(df, raw)
    candidate = F.col("_candidate")
    df = staged(df, {"_wrapped": F.try_parse_json(F.concat(F.lit("["), candidate, F.lit(f',"{END_MARK}"]')))})
    one_value = (F.try_variant_get("_wrapped", "$[1]", "string") == END_MARK) & F.try_variant_get(
        "_wrapped", "$[2]", "variant"
    ).isNull()
    # A candidate that contains the mark itself is also parsed in a second frame, which no
    # text can close at the same place as the first.
    framed = F.try_parse_json(F.concat(F.lit('{"v":'), candidate, F.lit("}"))).isNotNull()
    strict = one_value & (~candidate.contains(END_MARK) | framed)
    # Taking the value out builds it anew, so validity does not look at it and a JSON null is told by its text: a
    # candidate without braces is stripped.
    df = staged(df, {"valid_json": F.coalesce(strict & (candidate != "null"), F.lit(False))})
    valid = F.col("valid_json")
    df = df.withColumns(
        {
            "parsed": F.when(valid, F.try_variant_get("_wrapped", "$[0]", "variant")),
            "json_text": F.when(valid, candidate),
            "is_object": valid & F.coalesce(candidate.startswith("{"), F.lit(False)),
        }
    )
    return df.drop("_candidate", "_wrapped", "repaired")
