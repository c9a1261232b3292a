"""Vectors as whole numbers: kept as raw floats, compared and summed exactly, summed by Spark in limbs.

A state table holds a row a vector and, in the same files, a few rows of partial sums that each task
made: a round of clustering reads the vectors once and writes once, and its sums are then read from
those rows alone. If a task runs again, its rows and its sums are replaced together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a limb of a partial sum: 2^23 tasks' limbs add up within a long.
LIMB = 40
#: Whole numbers up to this are exact as doubles.
EXACT = 1 << 52

#: Columns of the rows of partial sums; null in the rows of vectors.
SUMS = [T.StructField("entry", T.IntegerType()), T.StructField("limb", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))]


def usable(embedding: str, dimensions: int) -> Column:
    """Whether a vector has exactly so many components, none null or non-finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(embedding) == dimensions) & finite, F.lit(False))


def packed(rows: DataFrame, embedding: str) -> DataFrame:
    """The vectors as bytes, eight a component, in a column `vector`; all have to be usable."""
    keep = [c for c in rows.columns if c != embedding]
    given = rows.select(*keep, F.col(embedding).cast("array<double>").alias("vector"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("vector", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.num_columns - 1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()
            width = len(flat) // batch.num_rows
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * width
            made = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=batch.schema.names)

    return given.mapInArrow(run, schema)


def floats(column: pa.Array) -> np.ndarray:
    """Packed vectors as a matrix of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), -1)


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, exact for scales that are powers of two: doubles, or Python's integers where doubles couldn't hold what is made of them."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not scaled.size or np.abs(scaled).max() < 1 << 21:
        return scaled
    made = np.empty(values.size, dtype=object)
    made[:] = [int(s) if np.isfinite(s) else int(v) * scale for v, s in zip(values.ravel().tolist(), scaled.ravel().tolist())]
    return made.reshape(values.shape)


def distances(rows: np.ndarray, centres: list[list[int]]) -> np.ndarray:
    """Exact squared distances of every row to every centre, as doubles where these are exact, else Python's integers."""
    c = np.array(centres, dtype=object)
    most = max((abs(int(x)) for x in c.ravel()), default=0) + (int(np.abs(rows).max()) if rows.size else 0)
    if rows.dtype != object and rows.shape[1] * most * most < EXACT:
        c = c.astype(float)
        return (rows * rows).sum(axis=1)[:, None] - 2 * (rows @ c.T) + (c * c).sum(axis=1)[None, :]
    if rows.dtype != object:
        rows = exact(rows)
    return np.stack([((rows - centre) ** 2).sum(axis=1) for centre in c], axis=1)


def exact(rows: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python's integers."""
    if rows.dtype == object:
        return rows
    made = np.empty(rows.size, dtype=object)
    made[:] = [int(x) for x in rows.ravel().tolist()]
    return made.reshape(rows.shape)


def as_longs(numbers: np.ndarray) -> pa.Array:
    """Whole numbers as longs; null where a long can't hold one."""
    return pa.array([int(x) if x < 1 << 63 else None for x in numbers.tolist()], pa.int64())


class Sums:
    """Counts and componentwise sums of entries, plus and minus, of any size."""

    def __init__(self, entries: int, width: int) -> None:
        self.n, self.sums = [0] * entries, np.zeros((entries, width), dtype=object)

    def add(self, entry: int, rows: np.ndarray, sign: int = 1) -> None:
        if len(rows):
            self.n[entry] += sign * len(rows)
            self.sums[entry] += sign * exact(rows.sum(axis=0))

    def limbs(self) -> list[tuple[int, int, int, list[int]]]:
        """Rows (entry, limb, n, sums) of the entries that changed; n goes with limb 0."""
        made = []
        for entry, (n, rest) in enumerate(zip(self.n, self.sums, strict=True)):
            if not n and not any(rest):
                continue
            limb = 0
            while True:
                last = all(abs(x) < 1 << LIMB for x in rest)
                made.append((entry, limb, 0 if limb else n, [int(x if last else x & (1 << LIMB) - 1) for x in rest]))
                if last:
                    break
                rest, limb = rest >> LIMB, limb + 1
        return made

    def collect(self, state: DataFrame) -> int:
        """Add the partial sums that a state table holds: at most entries * limbs rows come to the driver. Returns the number of entries that changed."""
        width = self.sums.shape[1]
        rows = state.where("entry is not null").groupBy("entry", "limb").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")).collect()
        for r in rows:
            self.n[r["entry"]] += r["n"]
            self.sums[r["entry"]] += np.array([int(x) << LIMB * r["limb"] for x in r["sums"]], dtype=object)
        return len({r["entry"] for r in rows})

    def means(self, before: list[list[int]]) -> list[list[int]]:
        """floor(sum / count) of every entry, componentwise; entries without rows stay as before."""
        return [[int(s) // n for s in total] if n else list(old) for n, total, old in zip(self.n, self.sums, before, strict=True)]


def stepped(rows: DataFrame, fields: list[T.StructField], start: Callable[[], tuple[Callable[[pa.RecordBatch], list], Sums]]) -> DataFrame:
    """Rows with columns `fields` made anew, then a task's partial sums as rows of their own.

    start() gives, once a task, a function from a batch to one array a field, and the sums that it fills.
    """
    keep = [c for c in rows.columns if c not in {f.name for f in fields}]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.select(*keep).schema], *fields, *SUMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        kernel, sums = start()
        for batch in batches:
            if not batch.num_rows:
                continue
            made = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(kernel(batch), list(arrow)[len(keep) :])]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep] + made + [pa.nulls(batch.num_rows, f.type) for f in list(arrow)[-len(SUMS) :]]
            yield pa.RecordBatch.from_arrays(columns, names=arrow.names)
        rest = sums.limbs()
        if rest:
            head = [pa.nulls(len(rest), f.type) for f in list(arrow)[: -len(SUMS)]]
            yield pa.RecordBatch.from_arrays(head + [pa.array(list(x), f.type) for x, f in zip(zip(*rest), list(arrow)[-len(SUMS) :])], names=arrow.names)

    return rows.mapInArrow(run, schema)
