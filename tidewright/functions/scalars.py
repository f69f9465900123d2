"""Scalar functions that need Python's own arithmetic or a parser: vectorised over Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from ..sources.classfile import source_types


def half_even(value: Column, digits: int = 6) -> Column:
    """A double rounded as the binary number that it is, exact halves to even: 2.675 to two digits is 2.67. Null, infinite and NaN values stay."""
    @F.pandas_udf("double")
    def rounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: round(v, digits), na_action="ignore")

    return rounded(value.cast("double"))


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """``part`` / ``whole`` rounded half to even; null if the whole is null or 0."""
    return half_even(F.when(whole != 0, part.cast("double") / whole.cast("double")), digits)


def descriptor_types(descriptor: Column) -> Column:
    """The types of a JVM descriptor in source form, the result last; null where it isn't one."""
    @F.pandas_udf("array<string>")
    def types(x: pd.Series) -> pd.Series:
        def read(d: str | None) -> list[str] | None:
            try:
                return None if d is None else source_types(d)
            except (KeyError, ValueError, IndexError):
                return None

        return x.map(read)

    return types(descriptor)
