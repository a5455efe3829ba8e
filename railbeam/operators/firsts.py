"""First row per key in a total order.

Written as an aggregate, so rows are reduced before the shuffle and a key that holds most of the
table costs one row per input partition, not one huge group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), by).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    return _pick(df, keys, order, F.min_by)


def last_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key."""
    return _pick(df, keys, order, F.max_by)
