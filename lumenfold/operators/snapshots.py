"""Writes as functions from a table's snapshot to its next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order (name a tie-break in it)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def _tie(rows: DataFrame) -> Column:
    """What orders rows that are equal in all else: a hash of their values."""
    return F.xxhash64(*rows.columns)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Changes replace rows of the same key; of several changes to a key that with the largest version holds, among equal versions the one whose values hash highest."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return keep_latest(both, keys, F.desc("_new"), F.desc(version), F.desc(_tie(current))).drop("_new")


def insert_missing(current: DataFrame, rows: DataFrame, keys: list[str], live: Column | None = None) -> DataFrame:
    """Rows whose key no live row has are appended, for each key the one whose values hash lowest."""
    held = current if live is None else current.where(live)
    fresh = keep_latest(rows, keys, _tie(rows)).join(held.select(*keys), keys, "left_anti")
    return current.unionByName(fresh.select(*current.columns))


def update(current: DataFrame, where: Column, **changes: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return current.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in changes.items()})


def soft_delete(current: DataFrame, where: Column, as_of: Column) -> DataFrame:
    return update(current, where & F.col("deleted_at").isNull(), deleted_at=as_of)


def purge(current: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with the number of rows that went)."""
    hit = F.coalesce(where, F.lit(False))
    return current.where(~hit), current.where(hit).agg(F.count("*").alias("purged"))


def consume(tokens: DataFrame, where: Column, as_of: Column) -> DataFrame:
    """Mark the chosen tokens as used, where they are unused and not expired. A snapshot function: two jobs at once are not kept apart."""
    return update(tokens, where & F.col("consumed_at").isNull() & (F.col("expires_at") > as_of), consumed_at=as_of)


def overlay(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several layers by key; a later layer's row hides those of earlier ones, within a layer the one whose values hash lowest holds."""
    out, tie = None, _tie(layers[0])
    for i, layer in enumerate(layers):
        layer = layer.withColumn("_layer", F.lit(i))
        out = layer if out is None else out.unionByName(layer)
    return keep_latest(out, keys, F.desc("_layer"), tie).drop("_layer")
