"""Splits, sampling and weights."""

from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import at_shares

#: Subjects that a seeded shuffle on the driver takes; beyond it only the hash split scales.
DRIVER_SUBJECTS = 100_000


def hash_split(rows: DataFrame, key: str, cuts: tuple[float, float] = (0.70, 0.85), seed: str = "42") -> DataFrame:
    """Add split train, val or test of a subject by a hash of its key: no shuffle, the same at any scale."""
    share = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + seed))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("split", F.when(share < cuts[0], "train").when(share < cuts[1], "val").otherwise("test"))


def shuffled_split(rows: DataFrame, key: str, seed: int = 42, generator: str = "numpy", shares: tuple[float, float] = (0.70, 0.15)) -> DataFrame:
    """Add split by a seeded shuffle of the sorted subjects, cut by whole numbers; for at most DRIVER_SUBJECTS subjects.

    numpy: default_rng and truncated cuts; python: random.Random, cuts rounded and at least one.
    """
    subjects = sorted(r[0] for r in rows.select(key).distinct().limit(DRIVER_SUBJECTS + 1).collect())
    if len(subjects) > DRIVER_SUBJECTS:
        raise ValueError("too many subjects for a shuffle on the driver: use hash_split")
    n = len(subjects)
    if generator == "numpy":
        np.random.default_rng(seed).shuffle(subjects)
        a, b = int(n * shares[0]), int(n * shares[0]) + int(n * shares[1])
    else:
        random.Random(seed).shuffle(subjects)
        a = max(1, round(n * shares[0]))
        b = a + max(1, round(n * shares[1]))
    names = [(s, "train" if i < a else "val" if i < b else "test") for i, s in enumerate(subjects)]
    table = rows.sparkSession.createDataFrame(names, f"{key} {rows.schema[key].dataType.simpleString()}, split string")
    return rows.join(F.broadcast(table), key)


def with_sampling_weights(rows: DataFrame, group: str, target: Column, power: float, high: float, tachy: float, favoured: Column, factor: float) -> DataFrame:
    """Add `balanced`, one over the rows of the group, and `weight`, by group size to a power, high targets and a favoured group.

    Sizes are counted once and joined back, so that a large group stays spread over tasks.
    """
    sizes = rows.groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("__m"))
    known = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("__m").alias("__n"))))
    base = F.pow(F.col("__n") / F.col("__m"), F.lit(power))
    weight = base * F.when(target >= 100, high).otherwise(1.0) * F.when(target >= 120, tachy).otherwise(1.0) * F.when(favoured, factor).otherwise(1.0)
    joined = rows.join(known, F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumns({"balanced": 1 / F.col("__m"), "weight": weight}).drop("__group", "__m", "__n")


def seeded_sample(rows: DataFrame, groups: list[str], key: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows of every group, those of the smallest seeded hashes."""
    order = Window.partitionBy(*groups).orderBy(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))), *key)
    return rows.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n).drop("__k")


def checked_weights(rows: DataFrame, weight: str) -> DataFrame:
    """The table itself; a weight that is no positive number is an error when it is computed."""
    good = F.coalesce((F.col(weight) > 0) & ~F.isnan(weight) & (F.col(weight) < float("inf")), F.lit(False))
    return rows.where(F.when(good, True).otherwise(F.raise_error(F.lit(f"{weight} has to be a positive number")).cast("boolean")))


def weighted_sample(rows: DataFrame, weight: str, key: str, draws: int, seed: int = 42, buckets: int = 1024) -> DataFrame:
    """Exactly `draws` draws with replacement in proportion to weights: rows that are drawn, with `times`.

    Rows lie on a line, each as long as its weight, in the order of hashed buckets and keys; a draw
    is a hashed point of it. Points and rows meet by sorting within their bucket, whose place on
    the line is known from the buckets' sums alone.
    """
    share = lambda text: F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)
    bucket = F.pmod(F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")
    placed = checked_weights(rows, weight).withColumn("__b", bucket)
    sums = placed.groupBy("__b").agg(F.sum(F.col(weight).cast("double")).alias("__s"))
    edges = sums.withColumn("__from", F.sum("__s").over(Window.orderBy("__b")) - F.col("__s"))  # at most `buckets` rows
    line = F.broadcast(edges.agg(F.array_sort(F.collect_list(F.struct("__from", "__b"))).alias("__line"), F.sum("__s").alias("__total")))
    points = rows.sparkSession.range(draws).crossJoin(line).withColumn("__at", share(F.concat(F.col("id").cast("string"), F.lit(f":draw:{seed}"))) * F.col("__total"))
    hit = F.element_at("__line", F.greatest(F.lit(1), F.size(F.filter("__line", lambda e: e["__from"] <= F.col("__at")))))
    points = points.select(hit["__b"].alias("__b"), F.col("__at"), F.lit(1).alias("__side"))
    upto = F.sum(F.col(weight).cast("double")).over(Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    starts = placed.join(F.broadcast(edges.drop("__s")), "__b").select("__b", (F.col("__from") + upto - F.col(weight)).alias("__at"), F.lit(0).alias("__side"), F.col(key).alias("__key"))
    order = Window.partitionBy("__b").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    met = starts.unionByName(points, allowMissingColumns=True).withColumn("__key", F.last("__key", ignorenulls=True).over(order)).where("__side = 1")
    times = met.groupBy("__key").agg(F.count(F.lit(1)).alias("times"))
    return rows.join(times, rows[key] == times["__key"]).drop("__key")


def assigned_roles(rows: DataFrame, subject: str, roles: DataFrame) -> DataFrame:
    """Rows with the role of their subject (roles: subject, role); a subject without one is an error when it is computed."""
    joined = rows.join(roles, subject, "left")
    wrong = F.raise_error(F.concat(F.lit("no role for subject "), F.coalesce(F.col(subject).cast("string"), F.lit("null")))).cast("string")
    return joined.withColumn("role", F.when(F.col("role").isNotNull(), F.col("role")).otherwise(wrong))


def counted_roles(subjects: DataFrame, subject: str, counts: dict[str, int], seed: int = 42) -> DataFrame:
    """subject and role: the stated numbers of subjects for each role, in the order of a seeded hash; the rest have none."""
    hashed = subjects.select(subject).distinct().withColumn("__h", F.md5(F.concat(F.col(subject).cast("string"), F.lit(f":{seed}"))))
    # The first digits of the hash are buckets in its own order: places are sizes of buckets before, and numbers within.
    spread = hashed.withColumn("__b", F.substring("__h", 1, 3))
    sizes = spread.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))  # 4096 rows at most
    within = F.row_number().over(Window.partitionBy("__b").orderBy("__h", subject))
    placed = spread.withColumn("__k", within).join(F.broadcast(before), "__b").withColumn("__k", F.col("__k") + F.col("__before"))
    upto, role = 0, None
    for name, n in counts.items():
        upto += n
        role = F.when(F.col("__k") <= upto, name) if role is None else role.when(F.col("__k") <= upto, name)
    return placed.select(subject, role.alias("role"))


def drawn_shares(draws: int, seed: int) -> dict[int, float]:
    """Shares from 0 to under 1 by the md5 of seed and number: the same anywhere."""
    return {i: int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) / float(1 << 32) for i in range(draws)}


def random_spread(rows: DataFrame, order: str, value: str, draws: int, seed: int = 0) -> DataFrame:
    """One row: how many of `draws` rows, drawn at random with replacement, have a finite value, and its least, median and most.

    A draw is a place in the order of a unique number; the row is found by its place, and one that is drawn again
    counts again. Rows without that number are never drawn. Without rows nothing is known.
    """
    found = at_shares(rows, F.col(order), drawn_shares(draws, seed)).groupBy("v").agg(F.count(F.lit(1)).alias("__times"))
    met = rows.select(F.col(order).cast("double").alias("v"), F.col(value).cast("double").alias("x")).join(found, "v").where(~F.isnan("x") & (F.abs("x") < float("inf")))
    summary = met.agg(F.coalesce(F.sum("__times"), F.lit(0)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    return summary.crossJoin(F.broadcast(met.agg(F.percentile("x", F.lit(0.5), F.col("__times")).alias("median"))))  # of `draws` numbers at most
