"""Sinks: tables that refuse to be empty, append once, and resume where they stopped."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; an empty table is an error."""
    if df.isEmpty():
        raise ValueError(f"no rows for {path}")
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_role(df: DataFrame, path: str, role: str = "window_role") -> None:
    """Parquet parted by role, in place of what was there; a null role has a part of its own."""
    df.write.mode("overwrite").partitionBy(role).parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str], partition: str | None = None) -> int:
    """Append the rows whose keys the target lacks, each key once; returns how many there were. Running it again adds nothing.

    For one writer at a time: two at once may both add a key.
    """
    new = df.dropDuplicates(keys)
    try:
        known = df.sparkSession.read.parquet(path).select(*keys)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        new = new.join(known, keys, "left_anti")
    new = new.persist()
    try:
        n = new.count()
        if n:
            writer = new.write.mode("append")
            (writer.partitionBy(partition) if partition else writer).parquet(path)
    finally:
        new.unpersist()
    return n


def json_safe(df: DataFrame) -> Column:
    """Each row as JSON with NaN and infinities as null, at any depth."""
    return F.to_json(F.struct(*[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]), {"ignoreNullFields": "false"})


def _safe(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _safe(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: _safe(v, kind.valueType))
    return value


def write_report(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON without NaN; an empty table is an error."""
    if df.isEmpty():
        raise ValueError(f"no rows for {path}")
    df.select(json_safe(df).alias("value")).write.mode("overwrite").text(path)


def run_batches(inventory: DataFrame, keys: list[str], work, out: str, log: str, batch: int, stop: str | None = None) -> int:
    """Work through an inventory, `batch` keys at a time in their order; returns how many keys were done.

    work: from a batch's rows to a table with the keys and `status`. Results are appended, then their
    keys to the log, so that a run that broke off goes on after the last logged batch and adds no key
    twice. A file named `stop` ends the run between two batches.
    """
    spark, total = inventory.sparkSession, 0
    while not (stop and _exists(spark, stop)):
        known = spark.read.parquet(log).select(*keys) if _exists(spark, log) else None
        pending = inventory if known is None else inventory.join(known, keys, "left_anti")
        rows = pending.orderBy(*keys).limit(batch).persist()
        try:
            if rows.isEmpty():
                return total
            made = work(rows)
            append_new(made, out, keys)
            total += append_new(spark.read.parquet(out).select(*keys, "status").join(rows.select(*keys), keys, "left_semi"), log, keys)
        finally:
            rows.unpersist()
    return total


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
