"""Whole-number columns through pandas as text, so that nulls don't turn them into floats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def whole_numbers(df: DataFrame, names: list[str]) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields if f.name in names and isinstance(f.dataType, T.IntegralType)}


def as_text(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in whole_numbers(df, names)})


def restored(df: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    return df.withColumns({n: F.col(n).cast(t) for n, t in types.items()})
