"""Reading tables, single rows and objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by their keys to as many tasks as the session's shuffles have.

    For narrow rows of which much is made afterwards: a compressed file of millions of them is one task's work or two.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(rows, schema)


#: The most rows of a table of constants that becomes expressions of a plan.
MOST_CONSTANTS = 10_000


def constants(df: DataFrame, most: int = MOST_CONSTANTS) -> list:
    """The rows of a table of constants, such as rules, in the driver; an error if there are more than `most`."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows of constants")
    return rows


def maybe_one(df: DataFrame):
    """The only row, or None; an error if there are two."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one row")
    return rows[0] if rows else None


def exactly_one(df: DataFrame):
    row = maybe_one(df)
    if row is None:
        raise LookupError("no row")
    return row


def page(df: DataFrame, *order: Column, limit: int | None = None, offset: int | None = None, most: int = 100) -> DataFrame:
    """One page in a given order: 25 rows unless asked otherwise, at most `most`; more rows are skipped by offset (0 at least)."""
    n = min(25 if limit is None else limit, most)
    return df.orderBy(*order).offset(max(offset or 0, 0)).limit(max(n, 0))


def page_with_total(df: DataFrame, *order: Column, limit: int | None = None, offset: int | None = None, most: int = 100) -> DataFrame:
    """A page as page() gives it, with total (the number of all rows) and has_more (whether rows follow the page)."""
    end = max(offset or 0, 0) + max(min(25 if limit is None else limit, most), 0)
    total = df.agg(F.count("*").alias("total"))  # one row
    return page(df, *order, limit=limit, offset=offset, most=most).join(F.broadcast(total)).withColumn("has_more", F.col("total") > end)


def given(**filters) -> Column:
    """Equality with every parameter that is not None."""
    out = F.lit(True)
    for name, value in filters.items():
        if value is not None:
            out &= F.col(name) == value
    return out


def objects(spark: SparkSession, folder: str) -> DataFrame:
    """Stored objects: path, modificationTime, length and content."""
    return spark.read.format("binaryFile").load(folder)
