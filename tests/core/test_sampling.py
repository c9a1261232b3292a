import math

from vitalspark.queries import series


def frames_of(n_frames):
    """Frames at 30 a second that a camera of 10 a second sees, one by one."""
    count = math.ceil(n_frames / 30.0 / 0.1)
    times = [k * 0.1 for k in range(count)]
    if count < 2 or times[-1] < n_frames / 30.0 - 0.075:
        times.append(n_frames / 30.0 - 1 / 30.0)
    return {max(0, min(round(t * 30), n_frames - 1)) for t in times}


def test_every_recording_is_sampled(spark, tmp_path):
    keys = [*range(1, 80), 353, 359, 360, 599, 600, 1199, 60001]
    rows = [(k, k % 7, "F", 1000.5 + k) for k in keys]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    found = {r["recording"]: (r["frames"], r["total"]) for r in series.registry.queries["simulated_sampling_all"](spark, str(tmp_path)).collect()}
    want = {k: frames_of(240 + k % 600) for k in keys}
    assert found == {k: (len(x), sum(x)) for k, x in want.items()}
