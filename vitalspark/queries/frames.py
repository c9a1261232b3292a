"""Frames of `embeddings`: each vector painted as a PNG of 8 by 8 pixels, sent as a data URL and decoded again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images
from ..plans import frames
from . import Registry, rounded
from .signals import R
from .signals import windows as signals_of

registry = Registry()

PIXELS = "p AS (SELECT vec_id, i::int // 8 AS y, i::int % 8 AS x, greatest(0, least(255, floor(150 + 400 * embedding[i + 1]::double))) AS r, greatest(0, least(255, floor(130 + 400 * embedding[(i + 21) % 64 + 1]::double))) AS g, greatest(0, least(255, floor(100 + 400 * embedding[(i + 42) % 64 + 1]::double))) AS b FROM embeddings, range(64) t(i))"
#: Boxes of the regions: left half, lower right quarter, and one that reaches outside; the last has no pixels.
BOXES = {"left": (0, 4, 0, 8), "corner": (4, 8, 4, 8), "edge": (6, 20, 0, 3), "outside": (9, 12, 0, 8)}


def paint(x: np.ndarray) -> np.ndarray:
    """Three channels of a vector, each turned by a third, as an 8 by 8 frame."""
    planes = [np.clip(np.floor(base + 400 * np.roll(x, -shift)), 0, 255) for base, shift in ((150, 0), (130, 21), (100, 42))]
    return np.stack(planes, axis=-1).reshape(8, 8, 3).astype(np.uint8)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = F.array(*[F.struct(F.lit(n).alias("region"), *[F.lit(v).alias(c) for c, v in zip(("x_min", "x_max", "y_min", "y_max"), box, strict=True)]) for n, box in BOXES.items()])
    return signals_of(spark, sf_dir).select("vec_id", images.painted(F.col("x"), 8, 8, paint).alias("image_data_url"), boxes.alias("boxes"))


@registry.add(f"WITH {PIXELS} SELECT vec_id, 'received' AS status, 8 AS width, 8 AS height, 'RGB' AS mode, " + ", ".join(f"{R(f'{f}({c})', 5)} AS {c}_{n}" for c in "rgb" for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + " FROM p GROUP BY vec_id")
def frame_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = frames.frame_summaries(payloads(spark, sf_dir))
    return rounded(made.select("vec_id", "status", "width", "height", "mode", *[F.col(f"{n}_rgb.{c}").alias(f"{c}_{n}") for c in "rgb" for n in ("mean", "std", "min", "max")]), 5)


INSIDE = ", ".join(f"('{n}', {a}, {b}, {c}, {d})" for n, (a, b, c, d) in BOXES.items())


@registry.add(f"""WITH {PIXELS}, b(region, x0, x1, y0, y1) AS (VALUES {INSIDE}), e AS (SELECT vec_id, region FROM embeddings, b),
 m AS (SELECT vec_id, region, count(*) AS pixels, avg(r) AS r, avg(g) AS g, avg(p.b) AS b, avg((greatest(r, g, p.b) >= 250)::int) AS sat, avg((r >= 250)::int) AS red, avg((g >= 250)::int) AS green, avg((least(r, g, p.b) <= 10)::int) AS dark FROM p JOIN b ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY vec_id, region)
 SELECT vec_id, e.region, coalesce(pixels, 0) AS pixels, {R('r', 5)} AS r, {R('g', 5)} AS g, {R('b', 5)} AS b,
 CASE WHEN pixels IS NULL OR sat >= 0.10::double OR red >= 0.30::double OR green >= 0.20::double OR dark >= 0.20::double OR g < 20 THEN 'reject' WHEN sat >= 0.02::double OR red >= 0.05::double OR g < 40 OR g > 220 OR dark >= 0.05::double OR greatest(r, g, b) - least(r, g, b) > 120 THEN 'warning' ELSE 'ok' END AS quality_status FROM e LEFT JOIN m USING (vec_id, region)""")
def frame_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = frames.frame_regions(payloads(spark, sf_dir), ["vec_id"])
    return rounded(made.select("vec_id", "region", "pixels", *[F.col(f"mean_rgb.{c}").alias(c) for c in "rgb"], "quality_status"), 5)
