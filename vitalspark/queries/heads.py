"""A fitted head against the spectrum on windows of `embeddings`, and the peaks beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import heads
from . import Registry, rounded
from .signals import FPS, ROI, R, channels, spectrum_sql

registry = Registry()

GATED = f"""{ROI}, c AS MATERIALIZED (SELECT vec_id, i, channel, CASE channel WHEN 'pos' THEN pos WHEN 'chrom' THEN chrom ELSE green END AS x FROM z, (VALUES ('pos'), ('chrom'), ('green')) t(channel)),
 {spectrum_sql('c', 'vec_id, channel')},
 h AS (SELECT vec_id, count(*) FILTER (sqi >= 0.5) AS good, count(*) FILTER (sqi >= 0.3) AS moderate, max(bpm) FILTER (sqi >= 0.3) - min(bpm) FILTER (sqi >= 0.3) AS spread, median(bpm) AS median_bpm, avg(sqi) AS mean_sqi FROM quality GROUP BY vec_id),
 a AS MATERIALIZED (SELECT *, moderate >= 2 AND coalesce(spread <= 20, false) AS ok, 60.1::double + vec_id % 60 AS target FROM h),
 s2 AS (SELECT var_pop(median_bpm) AS xx, var_pop(mean_sqi) AS zz, covar_pop(median_bpm, mean_sqi) AS xz, covar_pop(median_bpm, target) AS xy, covar_pop(mean_sqi, target) AS zy, avg(median_bpm) AS mx, avg(mean_sqi) AS mz, avg(target) AS my FROM a WHERE vec_id % 5 <> 0),
 wt AS (SELECT (zz * xy - xz * zy) / (xx * zz - xz * xz) AS u, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS v, mx, mz, my FROM s2),
 made AS MATERIALIZED (SELECT a.*, greatest(40.0::double, least(180.0::double, my + u * (median_bpm - mx) + v * (mean_sqi - mz))) AS direct_hr, greatest(40.0::double, least(180.0::double, median_bpm)) AS spectral_hr FROM a, wt)"""


def fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, heads.Head]:
    """Windows with their gate and target, and the head fitted on four fifths of them."""
    gated = heads.with_gate(channels(spark, sf_dir), FPS).withColumn("target", F.lit(60.1) + F.col("vec_id") % 60)
    return gated, heads.fit(gated.where(F.col("vec_id") % 5 != 0), heads.FEATURES, "target")


@registry.add(f"""WITH {GATED} SELECT vec_id, vec_id % 5 = 0 AS held_out, {R('target', 4)} AS target, {R('direct_hr', 4)} AS direct_hr, {R('abs(direct_hr - target)', 4)} AS direct_error, {R('CASE WHEN ok THEN direct_hr END', 4)} AS gated_hr, {R('CASE WHEN ok THEN abs(direct_hr - target) END', 4)} AS gated_error, {R('spectral_hr', 4)} AS spectral_hr, {R('abs(spectral_hr - target)', 4)} AS spectral_error,
 CASE WHEN NOT ok THEN 'rejected' WHEN good >= 1 THEN 'good' ELSE 'moderate' END AS confidence, CASE WHEN moderate < 2 THEN 'few_supported_channels' WHEN NOT ok THEN 'channels_disagree' WHEN good >= 1 THEN 'good_channel' ELSE 'moderate_channels_only' END AS reasons FROM made""")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window by the head, behind the gate and by the spectrum; a fifth is held out of the fit."""
    gated, head = fitted(spark, sf_dir)
    found = heads.comparison(gated, ["vec_id"], head, "target")
    return rounded(found.withColumn("held_out", F.col("vec_id") % 5 == 0), 4)


@registry.add(f"""WITH {GATED}, nb AS (SELECT *, lag(pw) OVER o AS l, lead(pw) OVER o AS r FROM w WINDOW o AS (PARTITION BY vec_id, channel ORDER BY bin)),
 bd AS (SELECT vec_id, channel, sum(pw) AS band FROM w WHERE bin BETWEEN 6 AND 28 GROUP BY ALL),
 pk AS (SELECT vec_id, channel, bin * 7.5::double AS bpm, pw / band AS share, row_number() OVER (PARTITION BY vec_id, channel ORDER BY pw DESC, bin) AS place FROM nb JOIN bd USING (vec_id, channel) WHERE bin BETWEEN 6 AND 28 AND pw >= l AND pw >= r QUALIFY place <= 3),
 qr AS (SELECT vec_id, unnest(['reference', 'model', 'consensus']) AS point, unnest([target, direct_hr, spectral_hr]) AS rate FROM made)
 SELECT vec_id, channel, point, place::int AS place, {R('bpm', 4)} AS bpm, {R('share', 4)} AS share, {R('abs(bpm - rate)', 4)} AS distance FROM pk JOIN qr USING (vec_id) QUALIFY row_number() OVER (PARTITION BY vec_id, channel, point ORDER BY abs(bpm - rate), place) = 1""")
def peak_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each channel's three strongest peaks the one nearest to the reference, the head and the spectral rate."""
    gated, head = fitted(spark, sf_dir)
    compared = heads.comparison(gated, ["vec_id"], head, "target").select("vec_id", F.col("target").alias("reference"), F.col("direct_hr").alias("model"), F.col("spectral_hr").alias("consensus"))
    points = {n: n for n in ("reference", "model", "consensus")}
    told = heads.peak_table(gated.select("vec_id", *heads.CHANNELS).join(compared, "vec_id"), ["vec_id"], FPS, points)
    rows = told.select("vec_id", "channel", F.explode(F.array(*[F.struct(F.lit(n).alias("point"), F.col(n).alias("p")) for n in points])).alias("e")).where("e.p is not null")
    return rounded(rows.select("vec_id", "channel", F.col("e.point").alias("point"), *[F.col(f"e.p.{c}").alias(c) for c in ("place", "bpm", "share", "distance")]), 4)
