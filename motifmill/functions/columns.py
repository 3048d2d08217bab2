"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, each computed once a row.

    They are generated rows of one, which a filter on them stays above; a filter on a projected column would be moved
    below the projection and repeat the column's expression there.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
