"""Sweeps of buffers over `embeddings` read as recordings of 64 frames at 8 Hz, and the band-pass as a recursion in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals as S
from ..plans import sweeps
from . import Registry, rounded
from .filters import filtered_sql
from .signals import FPS, R
from .signals import windows as signals_of

registry = Registry()
CHANNELS = ("pos", "chrom", "green")
#: Frames of a window and the frame rate's bins of its spectrum.
WINDOW = 24


#: Channels of each buffer (s, e): every region projected by itself within the buffer, then averaged, a row a frame and channel.
PROJECTED = """c AS (SELECT vec_id, s, e, i::int AS i, j::int AS j, 120 + 10 * embedding[(i + 7 * j) % 64 + 1]::double AS r, 110 + 10 * embedding[(i + 7 * j + 21) % 64 + 1]::double AS g, 100 + 10 * embedding[(i + 7 * j + 42) % 64 + 1]::double AS b FROM embeddings, buffers, range(64) t(i), range(3) u(j) WHERE i >= s AND i < e),
 d AS (SELECT vec_id, s, e, i, j, r / (avg(r) OVER w + 1e-8::double) AS r, g / (avg(g) OVER w + 1e-8::double) AS g, b / (avg(b) OVER w + 1e-8::double) AS b FROM c WINDOW w AS (PARTITION BY vec_id, s, e, j)),
 p AS (SELECT vec_id, s, e, i, j, g, g - b AS p1, g + b - 2 * r AS p2, 3 * r - 2 * g AS c1, 1.5::double * r + g - 1.5::double * b AS c2 FROM d),
 q AS (SELECT vec_id, s, e, i, j, g, p1 + stddev_pop(p1) OVER w / (stddev_pop(p2) OVER w + 1e-8::double) * p2 AS pos, c1 - stddev_pop(c1) OVER w / (stddev_pop(c2) OVER w + 1e-8::double) * c2 AS chrom FROM p WINDOW w AS (PARTITION BY vec_id, s, e, j)),
 m AS (SELECT vec_id, s, e, i, avg(g) AS green, avg(pos) AS pos, avg(chrom) AS chrom FROM q GROUP BY vec_id, s, e, i),
 sig AS MATERIALIZED (UNPIVOT (SELECT vec_id, s, e, e - s AS n, i - s AS i, pos, chrom, green FROM m) ON pos, chrom, green INTO NAME ch VALUE x)"""

#: Windows (tag, s, e, a, z) of what was stored and of what was filtered, with rates, correlations and labels.
COMPARED = f"""stored AS (SELECT vec_id, i::int AS i, unnest(['pos', 'chrom', 'green']) AS ch, unnest([embedding[i + 1], embedding[(i + 3) % 64 + 1], embedding[(i + 9) % 64 + 1]])::double AS y FROM embeddings, range(64) t(i)),
 pairs AS MATERIALIZED (SELECT f.vec_id, tag, f.ch, f.i + f.s - a AS i, x, y FROM filtered f JOIN wanted w ON f.s = w.s AND f.e = w.e AND f.i + f.s >= a AND f.i + f.s < z JOIN stored t ON t.vec_id = f.vec_id AND t.ch = f.ch AND t.i = f.i + f.s),
 agree AS (SELECT vec_id, tag, ch, corr(x, y) AS r FROM pairs GROUP BY ALL),
 hann AS (SELECT vec_id, tag, ch, i, (x - avg(x) OVER w) * h AS x, (y - avg(y) OVER w) * h AS y FROM (SELECT *, 0.5::double - 0.5::double * cos(2 * pi() * i / {WINDOW - 1}) AS h FROM pairs) WINDOW w AS (PARTITION BY vec_id, tag, ch)),
 power AS (SELECT vec_id, tag, ch, k::int AS k, power(sum(x * cos(2 * pi() * k * i / {WINDOW})), 2) + power(sum(x * sin(2 * pi() * k * i / {WINDOW})), 2) AS px, power(sum(y * cos(2 * pi() * k * i / {WINDOW})), 2) + power(sum(y * sin(2 * pi() * k * i / {WINDOW})), 2) AS py FROM hann, range(3, 11) t(k) GROUP BY ALL),
 rates AS (SELECT vec_id, tag, median(hx) AS hr, median(hy) AS stored_hr FROM (SELECT vec_id, tag, ch, 20.0::double * arg_max(k, px) AS hx, 20.0::double * arg_max(k, py) AS hy FROM power GROUP BY ALL) GROUP BY ALL),
 labels AS (SELECT vec_id, tag, avg(v) AS mean, median(v) AS middle, min(v) AS low, max(v) AS high FROM (SELECT vec_id, tag, CASE WHEN vec_id % 10 <> 0 AND i % 9 <> 0 THEN 70 + 40 * embedding[i + 1]::double END AS v FROM embeddings, wanted, range(64) t(i) WHERE i >= a AND i < z) GROUP BY ALL),
 told AS (SELECT *, coalesce(mean, 75.0::double) AS target FROM rates JOIN labels USING (vec_id, tag) JOIN (SELECT vec_id, tag, max(r) FILTER (ch = 'pos') AS pos_r, max(r) FILTER (ch = 'chrom') AS chrom_r, max(r) FILTER (ch = 'green') AS green_r FROM agree GROUP BY ALL) USING (vec_id, tag))"""

SHOWN = f"{R('stored_hr', 4)} AS stored_hr, {R('abs(stored_hr - target)', 4)} AS stored_error, {R('hr', 4)} AS hr, {R('abs(hr - target)', 4)} AS error, {R('pos_r', 4)} AS pos_r, {R('chrom_r', 4)} AS chrom_r, {R('green_r', 4)} AS green_r"


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id with colours of three regions, stored channels, labels by frame and their mean."""
    x = F.col("x")
    colours = [F.array(*[S.scaled(S.rotated(x, 7 * j + shift), 10.0, base) for j in range(3)]).alias(c) for c, shift, base in (("r", 0, 120.0), ("g", 21, 110.0), ("b", 42, 100.0))]
    stored = F.struct(x.alias("pos"), S.rotated(x, 3).alias("chrom"), S.rotated(x, 9).alias("green"))
    labels = F.when(F.col("vec_id") % 10 != 0, F.transform(x, lambda v, i: F.when(i % 9 != 0, v * 40 + 70)))
    return signals_of(spark, sf_dir).select("vec_id", *colours, stored.alias("stored"), labels.alias("hr"), F.lit(75.0).alias("hr_mean"))


SCORE = sweeps.median_rate(FPS, refine=False)


@registry.add(f"""WITH RECURSIVE wanted(tag, s, e, a, z) AS (VALUES (-1.0::double, 0, 64, 24, 48), (0.0, 12, 48, 24, 48), (1.0, 12, 56, 24, 48), (2.0, 12, 64, 24, 48), (10.0, 12, 64, 24, 48)), buffers AS (SELECT DISTINCT s, e FROM wanted), {PROJECTED}, {filtered_sql('sig', 'vec_id, s, e, ch')}, {COMPARED}
 SELECT vec_id, CASE WHEN tag >= 0 THEN tag END AS future_s, 'ok' AS status, CASE WHEN tag >= 0 THEN 1.5::double END AS actual_pre_s, CASE WHEN tag >= 0 THEN least(tag, 2.0::double) END AS actual_future_s, {R('target', 4)} AS target, {SHOWN} FROM told""")
def future_context_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three seconds in eight, by the seconds after them that were filtered along."""
    return rounded(sweeps.future_context(recordings(spark, sf_dir), ["vec_id"], FPS, 6.0, 3.0, 1.5, [0.0, 1.0, 2.0, 10.0], WINDOW, SCORE), 4)


@registry.add(f"""WITH RECURSIVE wanted(tag, s, e, a, z) AS (VALUES (3.5::double, 0, 28, 4, 28), (6.0, 16, 48, 24, 48), (8.0, 32, 64, 40, 64)), buffers AS (SELECT DISTINCT s, e FROM wanted), {PROJECTED}, {filtered_sql('sig', 'vec_id, s, e, ch')}, {COMPARED}
 SELECT vec_id, tag AS end_s, 'ok' AS status, a AS start_frame, z AS end_frame, {R('mean', 4)} AS hr_mean, {R('middle', 4)} AS hr_median, {R('low', 4)} AS hr_low, {R('high', 4)} AS hr_high, {SHOWN} FROM told JOIN wanted USING (tag)
 UNION ALL SELECT vec_id, v, 'skip', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM embeddings, (VALUES (2.0::double), (9.0)) t(v)""")
def end_second_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three seconds by their end, from stored channels and from buffers of four seconds."""
    return rounded(sweeps.end_seconds(recordings(spark, sf_dir), ["vec_id"], FPS, [2.0, 3.5, 6.0, 8.0, 9.0], 3.0, 4.0, WINDOW, SCORE), 4)
