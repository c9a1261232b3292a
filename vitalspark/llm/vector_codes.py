"""Codes of vectors by parts, with codebooks fitted by delta-maintained Lloyd rounds in whole numbers.

Every vector keeps the codebook entry of each of its parts. A round finds the entries anew; a part
whose entry changed is added to its new entry's sum and taken from its old one's, and only these
contributions, summed within a task, are shuffled. The running integer sums give the next
codebooks. Once most parts have settled, a round shuffles next to nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise
from .whole import Sums, as_longs, distances, floats, packed, stepped, usable, whole

STATE = [T.StructField("codes", T.BinaryType())]

Codebooks = list[list[list[int]]]


def nearest(rows: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every part, ties to the lower, and the squared distances summed over parts."""
    codes, error = np.zeros((len(rows), len(books)), dtype=np.uint8), 0
    width = rows.shape[1] // len(books)
    for p, book in enumerate(books):
        squared = distances(rows[:, p * width : (p + 1) * width], book)
        codes[:, p] = squared.argmin(axis=1)
        error = error + squared[np.arange(len(rows)), codes[:, p]]
    return codes, error


def dimensions_of(vectors: DataFrame, embedding: str, parts: int) -> int:
    """The most frequent length that parts into `parts`, the shorter of equals; 0 without any."""
    sizes = vectors.groupBy(F.size(embedding).alias("d")).count().where((F.col("d") > 0) & (F.col("d") % parts == 0))
    best = sizes.orderBy(F.desc("count"), "d").limit(1).collect()
    return best[0]["d"] if best else 0


def recoded(state: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """The state with this round's codes and the plus and minus sums of parts whose code changed."""
    parts, entries, width = len(books), len(books[0]), len(books[0][0])

    def start():
        sums = Sums(parts * entries, width)

        def kernel(batch: pa.RecordBatch) -> list:
            rows = whole(floats(batch.column(batch.schema.get_field_index("vector"))), scale)
            codes, _ = nearest(rows, books)
            if "codes" in batch.schema.names:
                old = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("codes")).to_pylist()), dtype=np.uint8).reshape(codes.shape).astype(int)
            else:
                old = np.full(codes.shape, -1)
            for p in range(parts):
                changed = np.flatnonzero(codes[:, p] != old[:, p])
                part = rows[changed, p * width : (p + 1) * width]
                for k in np.union1d(codes[changed, p], old[changed, p]):
                    if k >= 0:
                        sums.add(p * entries + int(k), part[codes[changed, p] == k])
                        sums.add(p * entries + int(k), part[old[changed, p] == k], -1)
            return [pa.array([c.tobytes() for c in codes], pa.binary())]

        return kernel, sums

    return stepped(state, STATE, start)


def encode(vectors: DataFrame, key: str, embedding: str, label: str, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, dimensions: int | None = None) -> DataFrame:
    """key, code, error, label_error, codebooks_sha256: a row a usable vector.

    Usable are vectors of `dimensions` components (unless given: the most frequent length that is a
    multiple of `parts`), none null or non-finite; each component x becomes floor(scale * x).
    Codebooks start as the parts of the vectors of the smallest keys, null keys last, ties by
    the vectors themselves; with fewer usable vectors they are as many. At most 256 entries. Repeated rows and
    keys count each; null labels are one label. Where codebooks no longer change, the rounds left
    would change nothing and are not run. Errors that a long can't hold are null. A table
    without usable vectors gives no rows. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    width = dimensions or dimensions_of(vectors, embedding, parts)
    rows = vectors.where(usable(embedding, width) & F.lit(width > 0)).select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    first = rows.select("key", F.col("embedding").cast("array<double>").alias("e")).orderBy(F.asc_nulls_last("key"), "e").limit(entries).collect()
    if not first:
        return rows.select(F.col("key").alias(key), *[F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))]).where("false")
    start = whole(np.array([r["e"] for r in first]), scale)
    size = width // parts
    books = [[[int(x) for x in row[p * size : (p + 1) * size]] for row in start] for p in range(parts)]
    entries = len(first)
    state, sums, written = packed(rows, "embedding"), Sums(parts * entries, size), None
    for _ in range(rounds):
        state = materialise(recoded(state, books, scale), "codes")
        if written is not None:
            discard(vectors.sparkSession, written)
        written = state
        sums.collect(state)
        means, before = sums.means([entry for book in books for entry in book]), books
        books = [means[p * entries : (p + 1) * entries] for p in range(parts)]
        state = state.where("entry is null").select("key", "label", "vector", "codes")
        if books == before:
            break
    coded = materialise(_coded(state.select("key", "label", "vector"), books, scale), "coded")
    if written is not None:
        discard(vectors.sparkSession, written)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = F.when((F.count_if(F.col("error").isNull()) == 0) & (total < float(1 << 63)), total).try_cast("long")
    labels = coded.groupBy(F.col("label").alias("other")).agg(fits.alias("label_error"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("other"))).select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _coded(rows: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """key, label, code in hex and the exact error."""
    schema = T.StructType([rows.schema["key"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                codes, error = nearest(whole(floats(batch.column(2)), scale), books)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), as_longs(error)], names=["key", "label", "code", "error"])

    return rows.mapInArrow(run, schema)
