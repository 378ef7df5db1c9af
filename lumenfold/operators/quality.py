"""Reports of rows and keys that break constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, **checks: Column) -> DataFrame:
    """(key, violation) for every named check that does not hold; a check that is null counts as held, as in SQL."""
    names = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]))
    return rows.select(key, F.explode(names).alias("violation"))


def repeated_keys(rows: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys (without nulls) that more than one of the rows under `where` has."""
    held = rows if where is None else rows.where(where)
    return held.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
