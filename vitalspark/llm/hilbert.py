"""Shards along a Hilbert curve over document metadata, in DataFrame expressions only.

Each dimension is cut at its own quantiles, which keeps its order, so a shard's least and greatest
values of every dimension stay close and files can be pruned by any of them. Rows are put in the
order of the curve and cut into runs whose counts differ by one at most.

The global rank of a row needs no sort in one task: cells of the curve are counted, crowded cells
are split by hash into buckets of a bounded share of the rows, rows are numbered within their
bucket, and running sums over the counts of cells and buckets give each bucket's first rank.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits a dimension; buckets that a partition's share of rows is split into.
BITS, SPLIT = 4, 4


def _rotate(n: int, value: int, by: int) -> int:
    by %= n
    return (value << by | value >> (n - by)) & ((1 << n) - 1)


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of integer coordinates of `bits` bits each, as a long.

    One fold over the bit planes. The state is the index so far and the orientation of the
    current subcube (entry corner and direction); the corner tables depend on the number of
    dimensions alone.
    """
    n = len(coordinates)
    gray = [w ^ w >> 1 for w in range(1 << n)]
    rank = [gray.index(x) for x in range(1 << n)]
    trailing = lambda w: ((w ^ (w + 1)).bit_length() - 1) if w else 0
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(1 << n)]
    turn = [0 if w == 0 else (trailing(w - 1) if w % 2 == 0 else trailing(w)) % n for w in range(1 << n)]
    # Rotations of a corner right by d + 1, and of an entry left by d + 1.
    right = [[_rotate(n, x, -(d + 1)) for x in range(1 << n)] for d in range(n)]
    left = [[_rotate(n, entry[w], d + 1) for w in range(1 << n)] for d in range(n)]
    flat = lambda rows: F.array(*[F.lit(x) for row in rows for x in row])
    at = lambda table, place: F.element_at(table, place + 1)
    right_t, left_t, rank_t, turn_t = flat(right), flat(left), flat([rank]), flat([turn])
    cast = [F.coalesce(c, F.lit(0)).cast("int") for c in coordinates]
    # The corner of each plane, the first coordinate in the lowest bit.
    planes = F.array(*[sum(((F.shiftright(c, i).bitwiseAND(F.lit(1))) * (1 << k) for k, c in enumerate(cast)), F.lit(0)) for i in range(bits - 1, -1, -1)])
    size = 1 << n
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))

    def step(s: Column, corner: Column) -> Column:
        w = at(rank_t, at(right_t, s["d"] * size + corner.bitwiseXOR(s["e"])))
        return F.struct((s["h"] * size + w).cast("long").alias("h"), s["e"].bitwiseXOR(at(left_t, s["d"] * size + w)).alias("e"), F.pmod(s["d"] + at(turn_t, w) + 1, F.lit(n)).cast("int").alias("d"))

    return F.aggregate(planes, start, step, lambda s: s["h"])


def text_cuts(df: DataFrame, value: Column, parts: int) -> list[str]:
    """Strings that cut a column into `parts` of near equal counts, by the order of its distinct values.

    Distinct values are counted and range-partitioned; running sums within a partition and over the
    partitions' totals place them, and only the first value of each part comes to the driver.
    """
    counts = df.select(value.cast("string").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange("v").withColumn("p", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)  # the numbers of partitions have to stay
    sums = ranged.groupBy("p").agg(F.sum("n").alias("n"))
    order = Window.orderBy("p")
    before = sums.select("p", (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("p").orderBy("v"))
    level = F.floor((upto + F.col("before")) * parts / F.col("total")).cast("int")
    found = ranged.join(F.broadcast(before), "p").select("v", level.alias("level")).groupBy("level").agg(F.min("v").alias("v")).collect()  # parts + 1 rows at most
    ranged.unpersist()
    return sorted({min(r["v"] for r in found if r["level"] >= i) for i in range(1, parts) if any(r["level"] >= i for r in found)})


def quantised(df: DataFrame, dimensions: dict[str, Column], bits: int = BITS) -> DataFrame:
    """Add each dimension as `q_<name>`, its quantile from 0 to 2^bits - 1; nulls are 0.

    Strings are cut in their own order, other types as numbers. The cuts, 2^bits - 1 values a
    dimension, are all that comes to the driver.
    """
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    kinds = {name: df.select(c).dtypes[0][1] for name, c in dimensions.items()}
    numbers = [F.percentile_approx(c, shares, 10_000).alias(name) for name, c in dimensions.items() if kinds[name] != "string"]
    row = df.agg(*numbers).first() if numbers else None
    made = {}
    for name, c in dimensions.items():
        cuts = text_cuts(df, c, 1 << bits) if kinds[name] == "string" else sorted(set(row[name] or []))
        made[f"q_{name}"] = F.coalesce(sum(((c > x).cast("int") for x in cuts), F.lit(0)), F.lit(0))
    return df.withColumns(made)


def ranked(df: DataFrame, cell: str, order: list[Column], total: int) -> DataFrame:
    """Add `rank` long, from 0 without gaps: by cell, within a cell by hash bucket, then by `order`.

    A bucket holds at most about a SPLIT-th of a shuffle partition's mean share of the rows.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = df.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
    share = cells.select(cell, F.ceil(F.col("n") * (SPLIT * partitions) / max(1, total)).cast("int").alias("buckets"))
    dealt = df.join(F.broadcast(share), cell).withColumn("bucket", F.pmod(F.xxhash64(*order), F.col("buckets")).cast("int")).drop("buckets")  # 2^(bits x dimensions) cells at most
    sizes = dealt.groupBy(cell, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = sizes.withColumn("in_cell", before(Window.partitionBy(cell).orderBy("bucket")))
    outside = cells.withColumn("in_all", before(Window.orderBy(cell)))
    first = inside.join(F.broadcast(outside.select(cell, "in_all")), cell).select(cell, "bucket", (F.col("in_all") + F.col("in_cell")).alias("first"))
    number = F.row_number().over(Window.partitionBy(cell, "bucket").orderBy(*order)) - 1
    return dealt.withColumn("number", number).join(first, [cell, "bucket"]).withColumn("rank", F.col("first") + F.col("number")).drop("bucket", "first", "number")


def shard(df: DataFrame, dimensions: dict[str, Column], shards: int, order: list[Column], bits: int = BITS) -> DataFrame:
    """Add curve long, shard int and slot long (gapless from 0 in each shard); shards differ by one row at most.

    Null dimensions count as the least. Ties on the curve follow a hash of `order` and then `order`;
    rows that agree in all of it are alike and may take each other's places. An empty table gives
    an empty one. Columns of the new names are replaced. Every column of df is kept once on the
    executors' disks, and made again from df where an executor is lost, so give the light ones alone.
    """
    placed = quantised(df, dimensions, bits)
    placed = placed.withColumn("curve", hilbert_index([F.col(f"q_{name}") for name in dimensions], bits)).drop(*[f"q_{name}" for name in dimensions])
    placed = placed.persist(StorageLevel.DISK_ONLY)
    total = placed.count()
    small, extra = divmod(total, shards)
    cut = extra * (small + 1)
    rank = F.col("rank")
    number = F.when(rank < cut, F.floor(rank / (small + 1))).otherwise(extra + F.floor((rank - cut) / max(1, small))).cast("long")
    start = number * small + F.least(number, F.lit(extra))
    return ranked(placed, "curve", order, total).withColumns({"shard": number.cast("int"), "slot": (rank - start).cast("long")}).drop("rank")
