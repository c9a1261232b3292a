"""Ordered scans of recordings of any length, over many tasks.

A recording is cut into buckets of its order's first column, so that one long recording is many
small windows. Each bucket is summed up (last known value, first known value, sum, least), the
summaries are scanned, again in buckets, and what comes before or after a bucket enters its
window as one more row at its head or tail. No window is over a recording as a whole, and the rows
are shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets whose summaries are scanned together; above that, a recording's groups of buckets are an array.
GROUP = 1024


@dataclass(frozen=True)
class Carried:
    """What a scan carries along: kind is last, previous, next, sum or least."""

    kind: str
    value: Column


def last(value: Column) -> Carried:
    """The last known value, the row's own included."""
    return Carried("last", value)


def previous(value: Column) -> Carried:
    """The last known value before the row; wrap the value in a struct to take the row before, be it null or not."""
    return Carried("previous", value)


def following(value: Column) -> Carried:
    """The first known value from the row on."""
    return Carried("next", value)


def running_sum(value: Column) -> Carried:
    return Carried("sum", value)


def running_least(value: Column) -> Carried:
    return Carried("least", value)


def scan(rows: DataFrame, keys: list[str], order: list[str], width: float, found: dict[str, Carried]) -> DataFrame:
    """Rows with a column for each carried value, in the order of `order` within `keys`.

    order[0] is a number, such as a time in seconds, and `width` is what of it a bucket spans: it
    bounds the rows that a task holds, as a device has so many samples in a time. Null
    keys are a recording of their own, null places come first, ties are in no stated order. Columns
    of the same names as those found are replaced.
    """
    marks = {name: f"__m_{name}" for name in found}
    place = F.coalesce(F.floor(F.col(order[0]) / width).cast("long"), F.lit(-(1 << 62)))
    given = rows.withColumns({"__b": place, "__side": F.lit(1), **{marks[n]: c.value for n, c in found.items()}}).drop(*found)
    ordered = [F.struct(*[F.col(c) for c in order], F.col(marks[n]).alias("__v")) for n in found]
    known = [F.when(F.col(marks[n]).isNotNull(), s) for n, s in zip(found, ordered, strict=True)]
    sums = [_summary(c.kind, F.col(marks[n]), s).alias(marks[n]) for (n, c), s in zip(found.items(), known, strict=True)]
    # Dealt anew by bucket, here and below: else rows that come dealt by recording are joined, summed up and sorted both ways in the same tasks, all of it in their memory at once.
    buckets = given.repartition(*keys, "__b").groupBy(*keys, "__b").agg(*sums)
    kinds = {marks[n]: c.kind for n, c in found.items()}
    ahead = {m: k for m, k in kinds.items() if k != "next"}
    behind = {m: k for m, k in kinds.items() if k == "next"}
    every = given
    if ahead:
        every = every.unionByName(_before(buckets, keys, ahead).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    if behind:
        turned = _before(buckets.withColumn("__b", -F.col("__b")), keys, behind)
        every = every.unionByName(turned.withColumns({"__b": -F.col("__b"), "__side": F.lit(2)}), allowMissingColumns=True)
    up = Window.partitionBy(*keys, "__b").orderBy("__side", *order)
    down = Window.partitionBy(*keys, "__b").orderBy(F.desc("__side"), *[F.desc(c) for c in order])
    made = [_over(k, F.col(m), down if k == "next" else up, -1 if k == "previous" else 0).alias(n) for n, (m, k) in zip(found, kinds.items(), strict=True)]
    kept = [c for c in rows.columns if c not in found]
    return every.repartition(*keys, "__b").select(*kept, "__side", *made).where("__side = 1").drop("__side")


def _summary(kind: str, value: Column, known: Column) -> Column:
    if kind in ("last", "previous"):
        return F.max(known)["__v"]
    if kind == "next":
        return F.min(known)["__v"]
    return F.sum(value) if kind == "sum" else F.min(value)


def _over(kind: str, value: Column, window, upto: int) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, upto)
    if kind == "sum":
        return F.sum(value).over(frame)
    if kind == "least":
        return F.min(value).over(frame)
    return F.last(value, ignorenulls=True).over(frame)


def _before(buckets: DataFrame, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    """keys, __b and what all buckets before it come to."""
    last_of = lambda place, m: F.struct(F.col(place), F.col(m).alias("__v"))
    summed = lambda place: [_summary("last" if k == "next" else k, F.col(m), F.when(F.col(m).isNotNull(), last_of(place, m))).alias(m) for m, k in kinds.items()]
    grouped = buckets.select(*keys, "__b", *kinds).withColumn("__c", F.floor(F.col("__b") / GROUP))
    groups = grouped.groupBy(*keys, "__c").agg(*summed("__b"))
    listed = groups.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__c", *kinds))).alias("__l"))
    each = listed.select(*keys, "__l", F.posexplode("__l").alias("__i", "__g"))
    past = lambda m: F.slice(F.col("__l")[m], 1, F.col("__i"))
    heads = each.select(*keys, F.col("__g.__c").alias("__c"), F.lit(0).alias("__side"), *[_folded(k, past(m), buckets.schema[m].dataType).alias(m) for m, k in kinds.items()])
    both = grouped.withColumn("__side", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    up = Window.partitionBy(*keys, "__c").orderBy("__side", "__b")
    return both.select(*keys, "__b", "__side", *[_over(k, F.col(m), up, -1).alias(m) for m, k in kinds.items()]).where("__side = 1").drop("__side")


def _folded(kind: str, values: Column, of: T.DataType) -> Column:
    """What an array of summaries comes to; null for none."""
    known = F.filter(values, lambda x: x.isNotNull())
    if kind == "sum":
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast(of), lambda a, x: (a + x).cast(of)))
    if kind == "least":
        return F.array_min(known)
    return F.try_element_at(known, F.lit(-1))
