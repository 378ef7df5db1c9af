"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; where that is unset on one machine (tests), under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


#: While a table is written, Spark deletes an execution's shuffle files when it ends, not when the driver happens to
#: collect its garbage, and Python workers get few bytes of text at a time (a longer row still comes whole).
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20),
}


_made: ContextVar[list | None] = ContextVar("made", default=None)


def table(df: DataFrame) -> DataFrame:
    """df, written once and read from there: later jobs neither recompute it nor depend on an executor."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    made = spark.read.schema(df.schema).parquet(path)
    if _made.get() is not None:
        _made.get().append(made)
    return made


def scoped(f):
    """f with its result written as a table (if it is a DataFrame and none yet) and all other tables that it made deleted. Use it where the result is small beside them."""

    @functools.wraps(f)
    def run(*args, **options):
        outer = _made.set(made := [])
        try:
            result = f(*args, **options)
            if isinstance(result, DataFrame) and not any(result is t for t in made):
                result = table(result)
        finally:
            _made.reset(outer)
        for t in made:
            if t is not result:
                release(t)
        if isinstance(result, DataFrame) and _made.get() is not None:
            _made.get().append(result)
        return result

    return run


def release(df: DataFrame) -> None:
    """Delete a table that nothing will read any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
