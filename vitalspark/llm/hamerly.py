"""Centroid clustering in whole numbers, by Hamerly's bounds.

Every vector keeps its cluster, an upper bound of its distance to that centroid and a lower bound of
its distance to the second nearest. After the centroids moved, the upper bound grows by the drift of
its own centroid and the lower one shrinks by the largest drift of the others; a vector whose upper
bound is below its lower one, or below half the way from its centroid to the nearest other, stays
without a look at its components. Of the rest the upper bound is made exact first, and those that
are still in doubt are compared with every centroid in exact integers. Bounds are rounded
outwards, and a tie is always in doubt, so clusters are those of a full comparison.

A round reads and writes the vectors once and shuffles only what vectors that changed their cluster
add to and take from the sums, a few rows a task.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise
from .whole import Sums, as_longs, distances, floats, packed, stepped, usable, whole

#: What bounds are widened by for rounding.
SLACK = 1e-12

STATE = [T.StructField("cluster", T.IntegerType()), T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType())]


def root(squared) -> float:
    """Square root of a whole number of any size."""
    return math.sqrt(squared) if squared < 1 << 1000 else math.inf


def roots(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared) if squared.dtype != object else np.array([root(x) for x in squared.tolist()], dtype=float)


class Movement:
    """Centroids of a round with what its bounds need: drifts since the round before and half gaps."""

    def __init__(self, centres: list[list[int]], before: list[list[int]]) -> None:
        squared = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        self.centres = centres
        drift = [root(squared(a, b)) * (1 + SLACK) for a, b in zip(centres, before, strict=True)]
        others = [max((d for j, d in enumerate(drift) if j != i), default=0.0) for i in range(len(centres))]
        gaps = [min((root(squared(a, b)) for j, b in enumerate(centres) if j != i), default=math.inf) / 2 * (1 - SLACK) for i, a in enumerate(centres)]
        self.drift, self.others, self.gaps = np.array(drift), np.array(others), np.array(gaps)

    def assign(self, vectors: pa.Array, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scale: int, sums: Sums) -> int:
        """Bring clusters and bounds of a batch to this round's centroids, in place; returns how many vectors were compared with all."""
        known = cluster >= 0
        upper[known] = (upper[known] + self.drift[cluster[known]]) * (1 + SLACK)
        lower[known] = (lower[known] - self.others[cluster[known]]) * (1 - SLACK)
        bound = np.where(known, np.maximum(lower, self.gaps[cluster]), -math.inf)
        doubt = np.flatnonzero(~(upper < bound))
        if not len(doubt):
            return 0
        rows = whole(floats(vectors.take(pa.array(doubt))), scale)
        squared = distances(rows, self.centres)
        at = np.arange(len(doubt))
        upper[doubt] = np.where(known[doubt], roots(squared[at, cluster[doubt]]) * (1 + SLACK), math.inf)
        full = np.flatnonzero(~(upper[doubt] < bound[doubt]))
        if not len(full):
            return 0
        scanned, old = squared[full], cluster[doubt[full]]
        new = scanned.argmin(axis=1)
        best = scanned[np.arange(len(full)), new]
        rest = scanned.copy()
        rest[np.arange(len(full)), new] = 1 << 62 if rest.dtype != object else max(x for x in rest.ravel()) + 1
        place = doubt[full]
        upper[place] = roots(best) * (1 + SLACK)
        lower[place] = roots(rest.min(axis=1)) * (1 - SLACK) if len(self.centres) > 1 else math.inf
        cluster[place] = new
        for k in range(len(self.centres)):
            sums.add(k, rows[full[(new == k) & (old != k)]])
            sums.add(k, rows[full[(old == k) & (new != k)]], -1)
        return len(full)


def moved(state: DataFrame, movement: Movement, scale: int) -> DataFrame:
    """The state with clusters and bounds of this round, and the partial sums of what changed."""
    width = len(movement.centres[0])

    def start():
        sums = Sums(len(movement.centres), width)

        def kernel(batch: pa.RecordBatch) -> list:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            if "cluster" in batch.schema.names:
                cluster, upper, lower = (column(n).to_numpy(zero_copy_only=False).copy() for n in ("cluster", "upper", "lower"))
            else:
                cluster, upper, lower = np.full(batch.num_rows, -1, dtype=np.int32), np.full(batch.num_rows, math.inf), np.full(batch.num_rows, -math.inf)
            movement.assign(column("vector"), cluster, upper, lower, scale, sums)
            return [cluster.astype(np.int32), upper, lower]

        return kernel, sums

    return stepped(state, STATE, start)


def cluster(vectors: DataFrame, key: str, embedding: str, k: int = 8, rounds: int = 10, scale: int = 1024, dimensions: int = 64, seed: str = "3") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row a usable vector.

    Usable are vectors of exactly `dimensions` components, none null or non-finite; each component x
    becomes floor(scale * x). The first centroids are the vectors with the smallest sha256 of
    `seed:key`, null keys last, ties by the vectors themselves; with under k usable vectors there
    are so many centroids. Repeated rows and keys count each. Where centroids no longer change, the
    rounds left would change nothing and are not run. Distances and inertias that a long can't hold
    are null. A table without usable vectors gives no rows. Other columns are not read.

    One state table is in the shared folder at a time, and the one before until it is written; a
    table of keys, clusters and distances stays for the result.
    """
    rows = vectors.where(usable(embedding, dimensions)).select(F.col(key).alias("key"), F.col(embedding).alias("embedding"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = rows.select(order.alias("h"), F.col("embedding").cast("array<double>").alias("e")).orderBy(F.asc_nulls_last("h"), "e").limit(k).collect()
    centres = [[int(x) for x in r] for r in whole(np.array([r["e"] for r in first]), scale).tolist()] if first else []
    named = {"key": F.col("key").alias(key)}
    if not centres:
        return rows.select(named["key"], *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]).where("false")
    state, before, sums, written = packed(rows, "embedding"), centres, Sums(len(centres), dimensions), None
    for left in range(rounds, -1, -1):
        state = materialise(moved(state, Movement(centres, before), scale), "clusters")
        if written is not None:
            discard(vectors.sparkSession, written)
        written = state
        if left:
            sums.collect(state)
            before, centres = centres, sums.means(centres)
            if before == centres:
                break
        state = state.where("entry is null").select("key", "vector", *[f.name for f in STATE])
    found = materialise(_measured(written.where("entry is null").select("key", "vector", "cluster"), centres, scale), "distances")
    discard(vectors.sparkSession, written)
    totals = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()
    fits = lambda x, lost: int(x) if not lost and x < 1 << 63 else None
    each = {r["cluster"]: fits(r["d"] or 0, r["lost"]) for r in totals}
    whole_inertia = fits(sum(each.values()), 0) if None not in each.values() else None
    at = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return found.select(
        named["key"], "cluster", "distance", at([each.get(i) for i in range(len(centres))], "long").alias("cluster_inertia"), F.lit(whole_inertia).cast("long").alias("inertia"), at(digests, "string").alias("centroid_sha256")
    )


def _measured(rows: DataFrame, centres: list[list[int]], scale: int) -> DataFrame:
    """key, cluster and the exact squared distance to its centroid."""
    schema = T.StructType([rows.schema["key"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                squared = distances(whole(floats(batch.column(1)), scale), centres)
                own = squared[np.arange(batch.num_rows), batch.column(2).to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), as_longs(own)], names=["key", "cluster", "distance"])

    return rows.mapInArrow(run, schema)
