"""Small helpers on whole DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns whose expressions are costly and read by later filters.

    They are produced by a generator of one row. Filters on them stop above it, where Catalyst
    would otherwise push them down and repeat the expressions in every condition.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def frame_bytes(df: DataFrame) -> int:
    """The measured size of a table's rows, as text: what a broadcast of it is judged by."""
    return df.select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def told_apart(df: DataFrame, *keys: str) -> bool:
    """Whether the key is never null and never comes twice."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    missing = F.col(keys[0]).isNull()
    for k in keys[1:]:
        missing |= F.col(k).isNull()
    return n.where(missing | (F.col("__n") > 1)).isEmpty()
