"""Tensors of windows: the manifest from `orders`, recordings from `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals as S
from ..plans import tensors
from ..session import shared_path
from . import Registry, rounded
from .series import MANIFEST, manifest
from .signals import R
from .signals import windows as signals_of

registry = Registry()
ROLES, FRAMES = ["finetune_train", "finetune_val", "finetune_test"], 32

#: Windows of 32 frames of recordings of 64; some recordings and targets are missing, and some windows end outside.
TENSORS = f"""{MANIFEST}, m AS (SELECT dataset, (recording % 97)::varchar AS subject_id, (subject % 520)::varchar AS recording_id, ((recording % 6) * 8)::int AS start_frame, recording AS window_id, 'finetune_' || split AS window_role, hr::double AS target FROM p WHERE CASE WHEN split = 'train' THEN recording % 3 <> 0 ELSE recording % 4 <> 0 END),
 n AS (SELECT *, row_number() OVER (PARTITION BY window_role ORDER BY dataset, subject_id, recording_id, start_frame, window_id) - 1 AS row_index FROM m),
 f AS (SELECT n.*, CASE WHEN vec_id IS NULL THEN 'no recording' WHEN start_frame + 32 > 64 THEN 'outside the recording' WHEN target IS NULL THEN 'no finite target' END AS failure, embedding[start_frame + 1:start_frame + 32]::double[] AS a, list_transform(range(32), lambda i: embedding[(start_frame + i + 9) % 64 + 1])::double[] AS c FROM n LEFT JOIN embeddings ON vec_id::varchar = recording_id)"""


def built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The shapes and the folder of the tensors."""
    rows = manifest(spark, sf_dir)
    r = F.col("recording")
    windows = rows.select(
        "dataset", (r % 97).cast("string").alias("subject_id"), (F.col("subject") % 520).cast("string").alias("recording_id"), (r % 6 * 8).cast("int").alias("start_frame"), (r % 6 * 8 + 32).cast("int").alias("end_frame"),
        r.alias("window_id"), F.concat(F.lit("finetune_"), "split").alias("window_role"), (r % 3 != 0).alias("include_in_finetune"), (r % 4 != 0).alias("include_in_eval"), F.col("hr").cast("double").alias("target_hr_mean"),
    )
    x = F.col("x")
    signals = signals_of(spark, sf_dir).select(F.col("vec_id").cast("string").alias("recording_id"), x.alias("pos"), S.rotated(x, 3).alias("chrom"), S.rotated(x, 9).alias("green"))
    # A recording is of every dataset and subject that the manifest names it with.
    keys = windows.select("dataset", "subject_id", "recording_id").distinct()
    folder = shared_path(spark, "tensors")
    return tensors.build(windows, keys.join(signals, "recording_id"), ROLES, folder, FRAMES, strict=False), folder


@registry.add(f"""WITH {TENSORS}, g AS (SELECT * FROM f WHERE failure IS NULL) SELECT window_role, row_index, window_id, start_frame, target AS y, {R('(a[1] - list_avg(a)) / list_stddev_pop(a)', 4)} AS first, {R('(c[32] - list_avg(c)) / list_stddev_pop(c)', 4)} AS last FROM g""")
def ordered_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by role, read back with their checks: place, target and two of the numbers of every tensor."""
    _, folder = built(spark, sf_dir)
    every = None
    for role in ROLES:
        rows = tensors.read(spark, folder, role, complete=False).select(F.lit(role).alias("window_role"), "row_index", "window_id", "start_frame", F.col("y").cast("double").alias("y"), F.get("x", F.lit(0)).alias("first"), F.get("x", F.lit(3 * FRAMES - 1)).alias("last"))
        every = rows if every is None else every.unionByName(rows)
    return rounded(every, 4)


@registry.add(f"""WITH {TENSORS} SELECT window_role, count(*) FILTER (failure IS NULL) AS rows, 3 AS channels, 32 AS frames, min(target) FILTER (failure IS NULL) AS y_min, max(target) FILTER (failure IS NULL) AS y_max, min(row_index) FILTER (failure IS NULL) AS "first", max(row_index) FILTER (failure IS NULL) AS "last", count(*) FILTER (failure = 'no recording') AS absent, count(*) FILTER (failure = 'outside the recording') AS outside, count(*) FILTER (failure = 'no finite target') AS unlabelled FROM f GROUP BY window_role""")
def tensor_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of shapes of each role, with what failed."""
    shapes, folder = built(spark, sf_dir)
    failed = tensors.failures(spark, folder)
    counts = {"absent": "no recording", "outside": "outside the recording", "unlabelled": "no finite target"}
    left = failed.groupBy("window_role").agg(*[F.count_if(F.col("failure") == f).alias(c) for c, f in counts.items()])
    named = shapes.select("window_role", "rows", "channels", "frames", F.col("y_min").cast("double").alias("y_min"), F.col("y_max").cast("double").alias("y_max"), "first", "last")
    return named.join(left, "window_role", "left").fillna(0, list(counts))
