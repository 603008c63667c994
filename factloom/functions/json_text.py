"""Indented JSON as a column, built from the type of the value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _block(items: Column, opening: str, closing: str, outer: str) -> Column:
    body = lambda parts: F.when(F.size(parts) == 0, F.lit(opening + closing)).otherwise(
        F.concat(F.lit(f"{opening}\n"), F.array_join(parts, ",\n"), F.lit(f"\n{outer}{closing}"))
    )
    return _bound(items, body)


def indented(value: Column, kind: T.DataType, width: int = 2, level: int = 0) -> Column:
    """The value as JSON over several lines, ``width`` blanks a level, a blank behind each colon.

    Null fields of objects are left out, null elements of arrays are ``null``, a null value gives null; keys keep
    the order of the type.  Texts and numbers look as ``to_json`` writes them.
    """
    outer, inner = " " * (width * level), " " * (width * (level + 1))
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(f'{inner}"{f.name}": '), indented(value[f.name], f.dataType, width, level + 1)) for f in kind.fields]
        return F.when(value.isNotNull(), _block(F.array_compact(F.array(*fields)), "{", "}", outer))
    if isinstance(kind, T.ArrayType):
        item = lambda e: F.concat(F.lit(inner), F.coalesce(indented(e, kind.elementType, width, level + 1), F.lit("null")))
        return F.when(value.isNotNull(), _block(F.transform(value, item), "[", "]", outer))
    text = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(text, F.lit(2), F.length(text) - 2))
