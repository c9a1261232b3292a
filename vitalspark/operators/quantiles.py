"""Exact quantiles and ranks of groups of any size.

`percentile` keeps a group's distinct values in one task. Here approximate quantiles of all rows cut
the numbers into `CELLS` ranges, the same for every group, so that no range holds more than its share of all rows
but for repeats of one value. Values are counted once within their range; the counts of the
ranges tell which of them hold a wanted rank, and only these are looked at value by value. Windows are over the ranges of a
group, or the values of a range. Several measures go through the same passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the values are cut into, a power of two.
CELLS = 1024


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of keys in which null equals null."""
    return reduce(lambda a, k: a & left[k].eqNullSafe(right[k]), keys, F.lit(True))


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the left side's keys stay. Without keys the right side is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    named = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"__{k}")), keys[1:], F.col(keys[0]).eqNullSafe(F.col(f"__{keys[0]}")))
    return left.join(named, on, how).drop(*[f"__{k}" for k in keys])


def counted(rows: DataFrame, keys: list[str], values: list[Column]) -> DataFrame:
    """g (struct of keys and __m, the number of a measure), cell, v, times: how often each known value comes; rows may have a `__times` of their own."""
    weight = F.col("__times") if "__times" in rows.columns else F.lit(1).cast("long")
    given = rows.select(*keys, weight.alias("__times"), *[v.cast("double").alias(f"__v{i}") for i, v in enumerate(values)])
    shares = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    known = lambda i: F.when(~F.isnan(f"__v{i}"), F.col(f"__v{i}") + 0.0)
    cuts = given.agg(*[F.coalesce(F.percentile_approx(known(i), shares, 4 * CELLS), F.array().cast("array<double>")).alias(f"__c{i}") for i in range(len(values))])
    both = given.crossJoin(F.broadcast(cuts)).withColumns({f"__p{i}": F.lit(0) for i in range(len(values))} | {f"__v{i}": known(i) for i in range(len(values))})
    step = CELLS // 2
    while step:  # a binary search, its steps as columns
        both = both.withColumns({f"__p{i}": F.col(f"__p{i}") + F.when(F.get(f"__c{i}", F.col(f"__p{i}") + (step - 1)) < F.col(f"__v{i}"), step).otherwise(0) for i in range(len(values))})
        step //= 2
    measured = both.select(*keys, "__times", F.inline(F.array(*[F.struct(F.lit(i).alias("__m"), F.col(f"__v{i}").alias("__v"), F.col(f"__p{i}").alias("__cell")) for i in range(len(values))])))
    placed = measured.where("__v is not null")
    return placed.groupBy(F.struct(*keys, "__m").alias("g"), F.col("__cell").alias("cell"), F.col("__v").alias("v")).agg(F.sum("__times").alias("times"))


def cells_of(values: DataFrame) -> DataFrame:
    """g, cell, size, before (the values of the group in the ranges below), n (of the group)."""
    sizes = values.groupBy("g", "cell").agg(F.sum("times").alias("size"))
    whole = Window.partitionBy("g")
    below = F.sum("size").over(whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return sizes.withColumns({"before": below, "n": F.sum("size").over(whole)})


def quantiles(rows: DataFrame, keys: list[str], value: Column, wanted: dict[str, float]) -> DataFrame:
    """keys and one column for each wanted share: exact quantiles with linear interpolation; nulls and NaN don't count.

    Groups without known values are left out. A column `__times` of the rows says how often each counts.
    """
    return _quantiles(rows, keys, [value], {name: (0, share) for name, share in wanted.items()})


def _met(found: DataFrame, ranks: Column) -> DataFrame:
    """g, n, v and r: the value at each wanted rank. ranks: an array of structs with m (a measure's number) and rank, made from n."""
    here = lambda r: (r["m"] == F.col("g.__m")) & (r["rank"] >= F.col("before")) & (r["rank"] < F.col("before") + F.col("size"))
    asked = cells_of(found).withColumn("ranks", F.filter(ranks, here)).where(F.size("ranks") > 0).select("g", "cell", "before", "n", "ranks")
    held = found.join(asked, ["g", "cell"])
    upto = F.col("before") + F.sum("times").over(Window.partitionBy("g", "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("upto", upto).select("g", "n", "v", F.explode(F.filter("ranks", lambda r: (r["rank"] < F.col("upto")) & (r["rank"] >= F.col("upto") - F.col("times")))).alias("r"))


def at_shares(rows: DataFrame, value: Column, shares: dict[int, float]) -> DataFrame:
    """draw, v: the value whose place in the order of all rows is floor(share * n), for each numbered share from 0 to under 1.

    A row by its place without numbering the rows: only the ranges of values that hold a wanted place are looked at.
    """
    ranks = F.array(*[F.struct(F.lit(k).alias("draw"), F.lit(0).alias("m"), F.floor(F.lit(u) * F.col("n")).alias("rank")) for k, u in shares.items()])
    return _met(counted(rows, [], [value]), ranks).select(F.col("r.draw").alias("draw"), "v")


def _quantiles(rows: DataFrame, keys: list[str], values: list[Column], wanted: dict[str, tuple[int, float]]) -> DataFrame:
    place = lambda name: F.lit(wanted[name][1]) * (F.col("n") - 1)
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(m).alias("m"), end(place(name)).cast("long").alias("rank"), F.lit(k).alias("upper")) for name, (m, _) in wanted.items() for k, end in enumerate((F.floor, F.ceil))])
    met = _met(counted(rows, keys, values), ranks)
    pick = lambda name, upper: F.max(F.when((F.col("r.name") == name) & (F.col("r.upper") == upper), F.col("v")))
    number = lambda m: F.max(F.when(F.col("g.__m") == m, F.col("n")))
    group = F.struct(*[F.col(f"g.{k}") for k in keys]) if keys else F.lit(0)
    measures = sorted({m for m, _ in wanted.values()})
    both = met.groupBy(group.alias("k")).agg(*[number(m).alias(f"__n{m}") for m in measures], *[pick(name, k).alias(f"{name}__{k}") for name in wanted for k in (0, 1)])
    part = lambda name: F.lit(wanted[name][1]) * (F.col(f"__n{wanted[name][0]}") - 1)
    line = lambda name: F.col(f"{name}__0") + (F.col(f"{name}__1") - F.col(f"{name}__0")) * (part(name) - F.floor(part(name)))
    return both.select(*[F.col(f"k.{k}").alias(k) for k in keys], *[line(name).alias(name) for name in wanted])


def with_quantiles(summary: DataFrame, rows: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """A summary by keys with quantile columns (value, share) of its rows, all found together."""
    values: dict[str, Column] = {}
    for value, _ in wanted.values():
        values.setdefault(str(value), value)
    numbers = {text: i for i, text in enumerate(values)}
    found = _quantiles(rows, keys, list(values.values()), {name: (numbers[str(value)], share) for name, (value, share) in wanted.items()})
    return joined(summary, found, keys, "left")


def mean_ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys, v and `name`: the rank of each distinct value in its group, ties sharing their mean rank."""
    found = counted(rows, keys, [F.col(value)])
    inside = F.sum("times").over(Window.partitionBy("g", "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = found.join(cells_of(found).select("g", "cell", "before"), ["g", "cell"]).withColumn("inside", inside)
    return ranked.select(*[F.col(f"g.{k}").alias(k) for k in keys], "v", (F.col("before") + F.col("inside") - (F.col("times") - 1) / 2).alias(name))
