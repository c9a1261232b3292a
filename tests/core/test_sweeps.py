"""Sweeps against the kernels, window by window, with recordings that are too short, empty or without labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspark.functions import kernels as K
from vitalspark.plans import sweeps
from vitalspark.queries.filters import recursion

FPS, WINDOW = 8.0, 24
SCORE = sweeps.median_rate(FPS)


def test_the_recursion_is_the_filter():
    b, a = recursion(0.7, 3.5, FPS)
    for mine, theirs in zip((b, a), K.butterworth(4, 0.7, 3.5, FPS), strict=True):
        np.testing.assert_allclose(mine, theirs, atol=1e-12)


@pytest.fixture(scope="module")
def recordings(spark):
    rng = np.random.default_rng(5)
    rows = []
    for name, n in (("long", 200), ("edge", 60), ("short", 20), ("none", 0)):
        colour = [(100 + rng.normal(size=(3, n)).cumsum(axis=1)).tolist() for _ in range(3)]
        stored = {c: rng.normal(size=n).tolist() for c in ("pos", "chrom", "green")}
        labels = None if name == "edge" else [None if i % 7 == 0 else float(60 + i % 30) for i in range(n)]
        rows.append((name, *colour, stored, labels, 71.0))
    rows.append(("null", None, None, None, None, None, None))
    kind = "name string, r array<array<double>>, g array<array<double>>, b array<array<double>>, stored struct<pos:array<double>,chrom:array<double>,green:array<double>>, hr array<double>, hr_mean double"
    return spark.createDataFrame(rows, kind), {r[0]: r for r in rows}


def window_of(row, s, e, a, z):
    cube = np.stack([np.array(c)[:, s:e] for c in row[1:4]], axis=-1)[None]
    made = {c: K.model_ready(x[:, a - s : z - s], WINDOW) for c, x in K.training_signals(cube, FPS).items()}
    stored = {c: K.model_ready(np.array(row[4][c])[None, a:z], WINDOW) for c in made}
    rate = float(np.median([K.spectral_quality(x, FPS)[0][0] for x in made.values()]))
    held = float(np.median([K.spectral_quality(x, FPS)[0][0] for x in stored.values()]))
    labels = [v for v in (row[5] or [])[a:z] if v is not None]
    return {"hr": rate, "stored_hr": held, "target": float(np.mean(labels)) if labels else row[6], **{f"{c}_r": float(np.corrcoef(stored[c][0], made[c][0])[0, 1]) for c in made}}


def test_future_context(recordings):
    df, rows = recordings
    found = {(r["name"], r["future_s"]): r for r in sweeps.future_context(df, ["name"], FPS, 6.0, 3.0, 1.5, [0.0, 1.0, 4.0], WINDOW, SCORE).collect()}
    assert len(found) == 5 * 4
    for name, n in (("long", 200), ("edge", 60)):
        for future, (s, e) in {None: (0, n), 0.0: (12, 48), 1.0: (12, 56), 4.0: (12, min(n, 80))}.items():
            want, r = window_of(rows[name], s, e, 24, 48), found[name, future]
            assert r["status"] == "ok" and {k: r[k] for k in want} == pytest.approx(want, abs=1e-9)
            assert r["error"] == pytest.approx(abs(want["hr"] - want["target"]))
            assert (r["actual_pre_s"], r["actual_future_s"]) == ((None, None) if future is None else (1.5, (e - 48) / FPS))
    assert all(found[name, f]["status"] == "outside" and found[name, f]["hr"] is None for name in ("short", "none", "null") for f in (None, 0.0, 1.0, 4.0))


def test_end_seconds(recordings):
    df, rows = recordings
    made = sweeps.end_seconds(df, ["name"], FPS, [2.0, 3.0, 4.0, 7.0, 25.0], 3.0, 5.0, WINDOW, SCORE)
    found = {(r["name"], r["end_s"]): r for r in made.collect()}
    assert len(found) == 5 * 5
    for end, s in ((4.0, 0), (7.0, 16), (25.0, 160)):
        z = int(end * FPS)
        want, r = window_of(rows["long"], s, z, z - WINDOW, z), found["long", end]
        want.pop("target")
        assert r["status"] == "ok" and (r["start_frame"], r["end_frame"]) == (z - WINDOW, z) and {k: r[k] for k in want} == pytest.approx(want, abs=1e-9)
    # A buffer of 24 frames is as long as the window but too short for the filter: the stored rate alone.
    assert found["long", 3.0]["status"] == "ok" and found["long", 3.0]["hr"] is None and found["long", 3.0]["stored_hr"] is not None
    assert {e for (n, e), r in found.items() if n == "long" and r["status"] == "skip"} == {2.0}
    assert all(r["status"] == "skip" for (n, e), r in found.items() if n in ("short", "none", "null"))
    less = sweeps.end_seconds(df, ["name"], FPS, [7.0], 3.0, 2.0, WINDOW, SCORE).where("name = 'long'").first()
    assert less["status"] == "short" and less["hr"] is None and less["stored_hr"] is not None


def test_equal_buffers_are_filtered_once(recordings):
    df, _ = recordings
    given = df.withColumn("wanted", F.expr("transform(array(0, 1, 2, 3), k -> struct(0 as buffer_start, 40 as buffer_end, k as start, k + 24 as end))")).where("name = 'long'")
    seen = given.select(F.explode(F.array_distinct(F.transform("wanted", lambda p: F.struct(p["buffer_start"], p["buffer_end"]))))).count()
    assert seen == 1 and sweeps.cut_windows(given, FPS, "wanted", WINDOW).count() == 4
