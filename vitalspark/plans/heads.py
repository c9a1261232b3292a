"""Model against spectrum: a linear head fitted by sums that Spark makes, applied in batches beside the spectral scorer, with the peaks that explain both."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import rates
from ..functions import signals as S
from ..operators import rules
from .live import CHANNELS, SCORERS, scored


@dataclass(frozen=True)
class Head:
    """Weights of named features and a bias; a head without a bias predicts nothing."""

    names: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float | None

    def apply(self, features: dict[str, Column] | None = None) -> Column:
        """The prediction of every row, in batches; null where a feature is unknown. Features are columns of their names unless given."""
        if self.bias is None:
            return F.lit(None).cast("double")
        weights, bias = np.array(self.weights), self.bias
        columns = [(features or {}).get(n, F.col(n)).cast("double") for n in self.names]
        known = reduce(lambda a, c: a & S.finite(c).isNotNull(), columns, F.lit(True))
        return scored(F.when(known, F.array(*columns)), lambda x: x @ weights + bias)


def fit(rows: DataFrame, features: list[str], target: str, ridge: float = 0.0) -> Head:
    """Least squares of a target on a few features: one pass that sums products, one row of which comes to the driver.

    Rows with an unknown or non-finite number don't count. ridge is added to each feature's own
    product, about the means. Without rows there is no bias; features that depend on each other share their
    weight (the shortest solution).
    """
    names = [*features, target]
    known = rows.select(*[F.col(n).cast("double").alias(n) for n in names]).where(reduce(lambda a, n: a & S.finite(F.col(n)).isNotNull(), names, F.lit(True)))
    products = [F.covar_pop(a, b).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    r = known.agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(f"m_{i}") for i, n in enumerate(names)], *products).first()
    p = len(features)
    if not r["n"]:
        return Head(tuple(features), (0.0,) * p, None)
    at = lambda i, j: r[f"{min(i, j)}_{max(i, j)}"]
    matrix = np.array([[at(i, j) + (ridge / r["n"] if i == j else 0.0) for j in range(p)] for i in range(p)]).reshape(p, p)
    weights = np.linalg.lstsq(matrix, np.array([at(i, p) for i in range(p)]), rcond=1e-12)[0]
    return Head(tuple(features), tuple(weights.tolist()), float(r[f"m_{p}"] - sum(w * r[f"m_{i}"] for i, w in enumerate(weights))))


FEATURES = ["median_bpm", "mean_sqi"]


def with_gate(signals: DataFrame, fps: float) -> DataFrame:
    """Signals with the gate's columns, mean_sqi and n and fps, as the scorers take them."""
    found = signals.withColumns({f"__q_{c}": K.quality(F.col(c), fps) for c in CHANNELS})
    quality = {c: F.col(f"__q_{c}") for c in CHANNELS}
    gate = rules.quality_gate({c: q["bpm"] for c, q in quality.items()}, {c: q["sqi"] for c, q in quality.items()})
    known = F.array_compact(F.array(*[S.finite(q["sqi"]) for q in quality.values()]))
    return found.withColumns({**gate, "mean_sqi": S.mean(known), "n": F.size(CHANNELS[0]), "fps": F.lit(float(fps))}).drop(*[f"__q_{c}" for c in CHANNELS])


def comparison(gated: DataFrame, keys: list[str], head: Head, target: str, spectral: str = "spectral", low: float = 40.0, high: float = 180.0) -> DataFrame:
    """A row a window: the head by itself, behind the gate, and the spectral scorer, each with its error, and what the gate says.

    gated: with_gate's columns and a target, which may be null. Rates are clamped to a plausible range.
    """
    direct = S.clamped(head.apply(), low, high)
    made = gated.withColumns({"direct_hr": direct, "spectral_hr": S.clamped(SCORERS[spectral](gated), low, high)})
    made = made.withColumn("gated_hr", F.when(F.col("accepted"), F.col("direct_hr")))
    errors = {f"{n}_error": F.abs(F.col(f"{n}_hr") - F.col(target)) for n in ("direct", "gated", "spectral")}
    return made.withColumns(errors).select(*keys, F.col(target).alias("target"), *[f"{n}_{m}" for n in ("direct", "gated", "spectral") for m in ("hr", "error")], "confidence", "reasons")


def nearest_peak(peaks: Column, rate: Column) -> Column:
    """Struct of the peak that is nearest to a rate: bpm, share, distance and place; the stronger of equally near ones, null without rate or peaks."""
    told = F.transform(peaks, lambda p, i: F.struct(F.abs(p["bpm"] - rate).alias("distance"), (i + 1).alias("place"), p["bpm"].alias("bpm"), p["share"].alias("share")))
    return F.when(rate.isNotNull(), F.array_min(told))


def peak_table(signals: DataFrame, keys: list[str], fps: float, points: dict[str, str], count: int = 3) -> DataFrame:
    """A row a window and channel: its strongest peaks of the cardiac band, and for each named point (a column of a rate) the nearest of them."""
    strongest = rates.measured(rates.strongest, "bpm array<double>, share array<double>", fps, count)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), strongest(F.col(c)).alias("m")) for c in CHANNELS]))
    rows = signals.select(*keys, *points.values(), each.alias("e"))
    told = rows.select(*keys, *points.values(), F.col("e.channel").alias("channel"), F.arrays_zip("e.m.bpm", "e.m.share").alias("peaks"))
    return told.select(*keys, "channel", "peaks", *[nearest_peak(F.col("peaks"), F.col(column)).alias(name) for name, column in points.items()])
