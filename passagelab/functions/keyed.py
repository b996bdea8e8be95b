"""Joins of a series frame with a table of few rows for each series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_series(df: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """``df`` with the columns of ``right`` for its series; null keys are keys like others.

    Without keys ``right`` has one row, which every row gets.
    """
    if not keys:
        return df.crossJoin(F.broadcast(right))
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return df.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])
