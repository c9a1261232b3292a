"""From a manifest and recordings to ordered tensors: number the rows, cut and scale the windows, write them by role, check them when read.

A folder of tensors holds three tables: `rows` (the manifest's columns with a gapless row_index
within each role), `tensors` (row_index, x, y by role, x the channels one after another) and `shapes` (a row a
role: rows, channels, frames, extremes of y, a checksum). Readers compare the first two with the third.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..functions import signals as S
from ..operators.quantiles import joined
from . import sweeps
from .live import CHANNELS

#: What tells rows of a role apart and orders them, and the role that is chosen by its own flag.
ORDER, TRAIN = ["dataset", "subject_id", "recording_id", "start_frame"], "finetune_train"
RECORDING = ORDER[:3]
#: Columns of what is written for each row.
BUILT = "row_index long, y float, x array<float>, failure string, window_role string"
#: Frames of a recording whose windows are gathered in one row; rows of a role in a file.
CHUNK, FILE_ROWS = 1 << 16, 50_000


def chosen(manifest: DataFrame, roles: list[str]) -> DataFrame:
    """The rows of some roles that are to be used: by include_in_finetune for training, by include_in_eval for the others."""
    use = F.when(F.col("window_role") == TRAIN, F.col("include_in_finetune")).otherwise(F.col("include_in_eval"))
    return manifest.where(F.col("window_role").isin(roles) & F.coalesce(use, F.lit(False)))


def numbered(rows: DataFrame, folder: str) -> DataFrame:
    """Rows with row_index from 0 within their role, in the order of ORDER and then of all else that can be ordered; written to `folder`.

    Rows are dealt out by ranges of that order and written with the number of their range, so that it stays;
    a row's index is its place in its range after the rows of the role's ranges before. No role is
    sorted in one task. Repeated rows have indexes one after another.
    """
    others = [f.name for f in rows.schema.fields if f.name not in ("window_role", *ORDER) and f.dataType.typeName() in ("string", "integer", "long", "double", "float", "boolean")]
    order = ["window_role", *ORDER, *others]
    spark = rows.sparkSession
    # The number of a range and a row's place in it are the upper and lower bits of Spark's increasing id, so no range is sorted again.
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).write.parquet(f"{folder}/ranges")
    dealt = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("__at", T.LongType())])).parquet(f"{folder}/ranges").withColumn("__part", F.shiftright("__at", 33))
    # As many rows as there are ranges and roles.
    sizes = dealt.groupBy("window_role", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy("window_role").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    offsets = sizes.select("window_role", "__part", (before - F.col("__first")).alias("__shift"))
    made = dealt.join(F.broadcast(offsets), ["window_role", "__part"]).withColumn("row_index", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")
    made.write.partitionBy("window_role").parquet(f"{folder}/rows")
    return spark.read.schema(made.schema).parquet(f"{folder}/rows")


def _gathered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """RECORDING and `windows`, the rows of a recording that start in one chunk of its frames: a recording's arrays meet each chunk once."""
    chunk = F.floor(F.col("start_frame") / CHUNK).alias("__chunk")
    return rows.groupBy(*RECORDING, chunk).agg(F.collect_list(F.struct(*columns)).alias("windows")).drop("__chunk")


def _stacked(channels: dict[str, Column]) -> Column:
    return F.concat(*[channels[c] for c in CHANNELS]).cast("array<float>")


def stored_tensors(rows: DataFrame, recordings: DataFrame, frames: int) -> DataFrame:
    """window_role, row_index, y, x and failure of every row, from the recordings' stored channels.

    rows: the numbered manifest with RECORDING, start_frame, end_frame, window_role, row_index and
    target_hr_mean; recordings: RECORDING, pos, chrom and green, a row a recording. Windows are cut
    by frames, resampled to `frames` and scaled; x is the channels in their order as floats. Failures
    have a reason and no x: no recording, outside of it, no finite signal, no finite target.
    """
    windows = _gathered(rows, ["window_role", "row_index", "start_frame", "end_frame", "target_hr_mean"])
    met = joined(windows, recordings.select(*RECORDING, *CHANNELS), RECORDING, "left")
    fits = lambda w: (w["start_frame"] >= 0) & (w["end_frame"] > w["start_frame"]) & (w["end_frame"] <= F.size("pos"))
    part = lambda c, w: F.when(fits(w), F.slice(F.col(c), w["start_frame"] + 1, w["end_frame"] - w["start_frame"]))
    cut = met.select(F.col("pos").isNull().alias("absent"), F.inline(F.transform("windows", lambda w: F.struct(w.alias("w"), *[part(c, w).alias(c) for c in CHANNELS]))))
    ready = K.mapped(K.model_ready, frames)
    made = cut.select("w.window_role", "w.row_index", F.col("w.target_hr_mean").cast("float").alias("y"), "absent", F.col("pos").isNull().alias("outside"), _stacked({c: ready(F.col(c)) for c in CHANNELS}).alias("x"))
    return _judged(made, frames)


def buffered_tensors(rows: DataFrame, recordings: DataFrame, fps: float, buffer_seconds: float, frames: int) -> DataFrame:
    """The same from colours: each window out of a buffer that ends with it, projected and filtered; equal buffers of a recording once.

    recordings: RECORDING, r, g and b, arrays of regions, each an array of frames.
    """
    buffer = F.greatest(F.lit(0), F.col("end_frame") - int(round(buffer_seconds * fps)))
    given = rows.select("*", F.least(buffer, F.col("start_frame")).alias("buffer_start"), F.col("end_frame").alias("buffer_end"), F.col("start_frame").alias("start"), F.col("end_frame").alias("end"))
    windows = _gathered(given, ["window_role", "row_index", "target_hr_mean", "buffer_start", "buffer_end", "start", "end"])
    met = joined(windows, recordings.select(*RECORDING, "r", "g", "b"), RECORDING, "left")
    n = F.size(F.get("r", F.lit(0)))
    fits = lambda w: F.coalesce((w["start"] >= 0) & (w["end"] > w["start"]) & (w["end"] <= n), F.lit(False))
    cut = sweeps.cut_windows(met.withColumn("windows", F.filter("windows", fits)), fps, "windows", frames)
    inside = cut.select("w.window_role", "w.row_index", F.col("w.target_hr_mean").cast("float").alias("y"), F.lit(False).alias("absent"), F.lit(False).alias("outside"), _stacked({c: F.col(f"made.{c}") for c in CHANNELS}).alias("x"))
    left = met.select(F.col("r").isNull().alias("absent"), F.explode(F.filter("windows", lambda w: ~fits(w))).alias("w"))
    rest = left.select("w.window_role", "w.row_index", F.col("w.target_hr_mean").cast("float").alias("y"), "absent", F.lit(True).alias("outside"), F.lit(None).cast("array<float>").alias("x"))
    return _judged(inside.unionByName(rest), frames)


def _judged(made: DataFrame, frames: int) -> DataFrame:
    # Null for a null among the numbers; NaN is the greatest.
    known = ~F.array_contains("x", F.lit(float("inf")).cast("float"))
    whole = F.coalesce((F.size("x") == len(CHANNELS) * frames) & known & (F.array_max("x") < float("inf")) & (F.array_min("x") > float("-inf")), F.lit(False))
    failure = F.when(F.col("absent"), "no recording").when(F.col("outside"), "outside the recording").when(~whole, "no finite signal").when(S.finite(F.col("y")).isNull(), "no finite target")
    return made.select("window_role", "row_index", "y", F.when(failure.isNull(), F.col("x")).alias("x"), failure.alias("failure"))


def checksum() -> Column:
    """A sum over rows that tells tables with other rows, orders or numbers apart."""
    return F.sum(F.xxhash64("row_index", "x", "y").cast("decimal(38,0)"))


def _shape(size: Column, frames: Column | int) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.min("row_index").alias("first"), F.max("row_index").alias("last"), F.count_distinct("row_index").alias("places"), F.count_if(size).alias("whole"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), checksum().alias("checksum")]


def write(made: DataFrame, folder: str, frames: int, strict: bool = True) -> DataFrame:
    """Write tensors by role in the order of row_index, and their shapes; returns these.

    Failures are an error and leave no shapes, so that the folder can't be read; not strict, they go to a
    table `failures` and their rows have no tensor.
    """
    spark = made.sparkSession
    made.withColumn("__file", F.floor(F.col("row_index") / FILE_ROWS)).repartition("window_role", "__file").sortWithinPartitions("window_role", "row_index").drop("__file").write.partitionBy("window_role").parquet(f"{folder}/built")
    built = spark.read.schema(BUILT).parquet(f"{folder}/built")
    failed = built.where("failure is not null").groupBy("window_role", "failure").count()
    if strict and not failed.isEmpty():
        raise ValueError("windows failed: " + ", ".join(f"{r['count']} {r['failure']}" for r in failed.orderBy("failure").limit(10).collect()))
    good = F.size("x") == len(CHANNELS) * frames
    shapes = built.where("failure is null").groupBy("window_role").agg(*_shape(good, frames)).withColumns({"channels": F.lit(len(CHANNELS)), "frames": F.lit(frames)})
    shapes.coalesce(1).write.parquet(f"{folder}/shapes")
    return spark.read.parquet(f"{folder}/shapes")


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """window_role, row_index and failure of the rows that have no tensor."""
    return spark.read.schema(BUILT).parquet(f"{folder}/built").where("failure is not null").select("window_role", "row_index", "failure")


def read(spark: SparkSession, folder: str, role: str, complete: bool = True) -> DataFrame:
    """row_index, x, y and the manifest's columns of a role, checked: as many rows as written, each of the shape, the same checksum, and if complete no index left out.

    A role that was never written, or a table that differs from its shapes, is an error.
    """
    shapes = spark.read.parquet(f"{folder}/shapes").where(F.col("window_role") == role).collect()
    if len(shapes) != 1:
        raise ValueError(f"no tensors of {role}")
    want = shapes[0]
    found = spark.read.parquet(f"{folder}/built").where((F.col("window_role") == role) & F.col("failure").isNull()).select("row_index", "x", "y")
    have = found.agg(*_shape(F.size("x") == want["channels"] * want["frames"], want["frames"])).first()
    wrong = [c for c in ("rows", "first", "last", "places", "whole", "y_min", "y_max", "checksum") if have[c] != want[c]]
    if have["whole"] != have["rows"] or have["places"] != have["rows"] or (complete and (have["first"] != 0 or have["last"] != have["rows"] - 1)):
        wrong.append("row_index")
    if wrong:
        raise ValueError(f"tensors of {role} are not those written: {', '.join(wrong)}")
    rows = spark.read.parquet(f"{folder}/rows").where(F.col("window_role") == role).drop("window_role")
    return found.join(rows, "row_index")


def build(manifest: DataFrame, recordings: DataFrame, roles: list[str], folder: str, frames: int, strict: bool = True) -> DataFrame:
    """All steps from stored channels; returns the shapes."""
    return write(stored_tensors(numbered(chosen(manifest, roles), folder), recordings, frames), folder, frames, strict)
