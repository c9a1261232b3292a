"""Helpers shared by the operators: shared folder, materialising, Arrow mapping, components."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that an Arrow kernel holds at a time; rows of narrow tables that go to a file.
SLICE_BYTES, FILE_ROWS = 1 << 20, 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; where the session names none, one of our own, but in local mode alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="vitalspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """Keep on the executors' disks what is read more than once; what a lost executor held is made again.

    For tables a short way from their source. Cached tables go with spark.catalog.clearCache().
    """
    return df.persist(StorageLevel.DISK_ONLY)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Remove a written table that nothing reads any more."""
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(batch: pa.RecordBatch, column: pa.Array, most: int = SLICE_BYTES):
    """Cut a record batch so that each piece holds about `most` bytes of one column, a row at least."""
    start, size = 0, 0
    lengths = pc.binary_length(column).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield batch.slice(start, i - start), column.slice(start, i - start)
            start, size = i, 0
        size += n
    if len(lengths) > start:
        yield batch.slice(start), column.slice(start)


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES):
    """Pieces of a record batch of a bounded number of bytes of text."""
    for piece, _ in cut(batch, batch.column(batch.schema.get_field_index(text)), most):
        yield piece


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def append_columns(df: DataFrame, text: str, fields: list[T.StructField], start, drop: tuple[str, ...] = (), most: int = SLICE_BYTES) -> DataFrame:
    """Add columns computed from one text column, in Arrow batches; text may be a field, as in row.text.

    start() gives, once a task, a function from texts, about `most` bytes of them, to one list or
    array a field. An existing column named as a new one is replaced; columns in `drop` stay behind.
    """
    new = {f.name for f in fields}
    keep = [c for c in df.columns if c not in new and c not in drop]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    first, _, inner = text.partition(".")
    if first in keep:
        given, place = df.select(*keep), keep.index(first)
    else:
        given, place = df.select(*keep, F.col(text).alias("__text")), len(keep)
        inner = ""

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kernel, arrow = start(), to_arrow_schema(schema)
        for batch in batches:
            column = batch.column(place)
            column = pc.struct_field(column, inner) if inner else column
            for part, texts in cut(batch, column, most):
                made = kernel([x or "" for x in texts.to_pylist()])
                columns = [part.column(i) for i in range(len(keep))]
                columns += [x if isinstance(x, pa.Array) else pa.array(x, arrow.field(len(keep) + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(arrow.field(i).name, columns[i].type) for i in range(len(columns))]))

    return given.mapInArrow(run, schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the smallest node.

    Alternates large-star and small-star steps on canonical edges (a > b). Each is one grouped
    minimum joined back, so a hub is pre-aggregated on the map side and split by adaptive
    skew joins. Every round is written to the shared folder, and the one before removed. Null ends
    link nothing; a table without edges gives no rows.
    """
    kind = edges.schema["a"].dataType
    files = lambda n: max(1, -(-n // FILE_ROWS))
    current = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    signature, size = None, current.count()
    for _ in range(rounds):
        # Large star: the neighbours above u, and u itself, go to the smallest of all neighbours.
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.where("m < a").select("a", F.col("m").alias("b"))
        starred = large.unionByName(own).distinct()
        # Small star: the neighbours below u, and u itself, go to the smallest of them.
        low = starred.groupBy("a").agg(F.min("b").alias("m"))
        small = starred.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = materialise(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct().coalesce(files(size)), "edges")
        found = step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(edges.sparkSession, current)
        current, size = step, found[0]
        if found == signature:
            break
        signature = found
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
