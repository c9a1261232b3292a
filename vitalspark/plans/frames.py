"""The image routes as plans: a frame's summary, its regions' colours and quality, and the compact sample of the live loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import images
from ..operators import rules


def frame_summaries(frames: DataFrame, url: str = "image_data_url") -> DataFrame:
    """Frames with the columns of images.FRAME in place of their data URL; one that can't be decoded says why."""
    return frames.withColumn("__f", images.frame_summary(F.col(url))).select(*[c for c in frames.columns if c != url], "__f.*")


def frame_regions(frames: DataFrame, keys: list[str], url: str = "image_data_url", boxes: str = "boxes") -> DataFrame:
    """A row a frame and region: pixels, colours, quality status and reasons; `usable` unless it is rejected, and a region without pixels is `empty`.

    boxes: an array of structs region, x_min, x_max, y_min, y_max, the upper ends left out. Frames that can't
    be decoded give one row with their status and no region.
    """
    read = frames.select(*keys, images.frame_regions(F.col(url), F.col(boxes)).alias("f")).select(*keys, "f.status", "f.message", F.explode_outer("f.regions").alias("r"))
    r = lambda c: F.col(f"r.{c}")
    mean = [r(f"mean_rgb.{c}") for c in "rgb"]
    quality = rules.image_quality(r("saturated"), r("red_saturated"), r("green_saturated"), r("dark"), mean[1], F.greatest(*mean) - F.least(*mean))
    none, empty = F.col("r").isNull(), r("pixels") == 0
    verdict = F.when(none, F.lit(None)).when(empty, "reject").otherwise(quality["status"])
    rows = read.select(*keys, "status", "message", "r.*", verdict.alias("quality_status"), F.when(none, F.lit(None)).when(empty, "empty").otherwise(quality["reasons"]).alias("reasons"))
    return rows.withColumn("usable", F.col("quality_status") != "reject")


def overall(statuses: Column) -> Column:
    """The worst of an array of statuses: reject, warning or ok; unknown without any."""
    has = lambda s: F.array_contains(statuses, s)
    return F.when(F.size(statuses) == 0, "unknown").when(has("reject"), "reject").when(has("warning"), "warning").otherwise("ok")


def roi_samples(frames: DataFrame, keys: list[str], url: str = "image_data_url", boxes: str = "boxes", method: str = "boxes") -> DataFrame:
    """A row a frame: status, message and `debug`, the compact struct that the live loop keeps of its regions; and `rois`, the map of colours that the live analysis reads.

    debug: method, roi_count, usable_roi_count, quality_summary and rois (name, usable, mean_rgb,
    status), by name. Regions without pixels have no colours.
    """
    rows = frame_regions(frames, keys, url, boxes)
    held = F.col("region").isNotNull()
    roi = F.struct(F.col("region").alias("name"), "usable", "mean_rgb", F.col("quality_status").alias("status"))
    made = rows.groupBy(*keys, "status", "message").agg(F.array_sort(F.collect_list(F.when(held, roi))).alias("l"))
    debug = F.struct(
        F.lit(method).alias("method"), F.size("l").alias("roi_count"), F.size(F.filter("l", lambda x: x["usable"])).alias("usable_roi_count"),
        overall(F.transform("l", lambda x: x["status"])).alias("quality_summary"), F.col("l").alias("rois"),
    )
    seen = F.filter("l", lambda x: x["mean_rgb"].isNotNull())
    colours = F.transform(seen, lambda x: F.struct(x["mean_rgb"]["r"].alias("r"), x["mean_rgb"]["g"].alias("g"), x["mean_rgb"]["b"].alias("b"), x["status"].alias("quality_status")))
    return made.select(*keys, F.when(F.col("status") == "received", "processed").otherwise(F.col("status")).alias("status"), "message", debug.alias("debug"), F.map_from_arrays(F.transform(seen, lambda x: x["name"]), colours).alias("rois"))
