"""Staging of expensive columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import wraps
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

STAGE = "_stage"


def staged(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``withColumns`` whose columns are computed once and not inlined further up.

    Catalyst copies the definition of a column into every later filter and projection that uses it,
    which for a parse or a long conditional multiplies plan size and work.  It does not look into a
    generator, so the columns are made as the one row of an inlined array; filters on other columns
    still pass below it, down to the scan.  The array is a column of a projection below the generator: a
    projection runs compiled however long its columns are, a generator that is too long for one method does not.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    made = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    return df.select(*kept, made.alias(STAGE)).select(*kept, F.inline_outer(STAGE))


def built_once(build: Callable) -> Callable:
    """Keep the columns a function of plain arguments builds.  Columns depend on neither data nor
    session, but building a long one takes a call into the JVM for every part of it."""
    kept: WeakKeyDictionary = WeakKeyDictionary()

    @wraps(build)
    def get(*args, **kwargs):
        of_gateway = kept.setdefault(SparkContext._gateway, {})
        key = (args, tuple(sorted(kwargs.items())))
        if key not in of_gateway:
            of_gateway[key] = build(*args, **kwargs)
        return of_gateway[key]

    return get
