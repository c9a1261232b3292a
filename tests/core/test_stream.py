"""The live analysis as a stream against the batch, on shuffled, late and repeated samples, with a restart."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vitalspark.plans import live
from vitalspark.streaming import analysis
from vitalspark.streaming.live import keep_history

SCHEMA = "session_id string, run_id bigint, t_s double, rois map<string,struct<r:double,g:double,b:double,quality_status:string>>"


def sample(session, run, t, bpm):
    p = math.sin(2 * math.pi * bpm / 60 * t)
    return (session, run, t, {r: {"r": 100 + 0.25 * k + 1.8 * p, "g": 105 + 0.25 * k + 3 * p, "b": 95 + 0.25 * k + 1.2 * p, "quality_status": "ok"} for k, r in enumerate(live.REGIONS)})


@pytest.fixture
def arrivals():
    """Batches of samples as they arrive: out of order by up to a second, some again in a later batch, some too late, some of a run that is over."""
    rnd = random.Random(4)
    rows = [sample(s, 1, i / 30.0, bpm) for s, bpm in (("a", 72.0), ("b", 96.0)) for i in range(300)] + [sample("c", 1, i / 30.0, 60.0) for i in range(12)] + [sample("d", 1, i / 30.0, 60.0) for i in range(60)] + [sample("d", 2, i / 30.0, 84.0) for i in range(250)]
    rows += [("e", 1, None, sample("e", 1, 0.0, 60.0)[3]), ("e", 1, 0.1, {})]
    order = sorted(rows, key=lambda r: ((r[2] or 0) + (3 if r[0] == "d" and r[1] == 2 else 0) + rnd.random(), rnd.random()))
    size = -(-len(order) // 6)
    parts = [order[i * size : (i + 1) * size] for i in range(6)]
    for k in range(1, 6):
        parts[k] = parts[k] + rnd.sample(parts[k - 1], 30)
    parts[5] += [sample("a", 1, 0.0, 72.0), sample("d", 1, 1.5, 60.0)]
    for p in parts:
        rnd.shuffle(p)
    return parts


def put(spark, rows, folder, k):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{k}")


def run(spark, folder):
    samples = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    query = keep_history(analysis.predictions(samples), f"{folder}/out", f"{folder}/check")
    query.awaitTermination()
    assert query.exception() is None


@pytest.mark.filterwarnings("ignore")
def test_the_stream_is_the_batch_after_a_restart(spark, arrivals, tmp_path):
    before = spark.conf.get(analysis.STORE[0], None)
    spark.conf.set(*analysis.STORE)
    spark.conf.set(*analysis.ENDS)
    try:
        for k, rows in enumerate(arrivals):
            put(spark, rows, tmp_path, k)
            if k in (2, 3, 5):
                run(spark, tmp_path)
    finally:
        spark.conf.unset(analysis.ENDS[0])
        spark.conf.set(analysis.STORE[0], before) if before else spark.conf.unset(analysis.STORE[0])
    history = spark.read.parquet(f"{tmp_path}/out")
    assert history.count() == history.select("session_id", "run_id", "revision").distinct().count() > 12
    last = {r["session_id"]: r for r in history.collect() if r["revision"] == max(x["revision"] for x in history.where(F.col("session_id") == r["session_id"]).select("revision").collect())}
    every = {(r[0], r[1], r[2]): r for part in arrivals for r in part if r[0] != "e" and not (r[0] == "d" and r[1] == 1)}
    batch = live.predict(live.analyse(spark.createDataFrame(list(every.values()), SCHEMA), ["session_id", "run_id"]))
    want = {r["session_id"]: r for r in batch.collect()}
    assert set(last) == set(want) == {"a", "b", "c", "d"}
    for name, w in want.items():
        got = last[name]
        assert got["run_id"] == w["run_id"] and (got["n"], got["accepted"], got["state"]) == (w["n"], w["accepted"], w["state"]), name
        for c in ("fps", "value", "median_bpm", "pos_bpm", "chrom_sqi", "green_sqi"):
            assert got[c] == (pytest.approx(w[c], rel=1e-9) if w[c] is not None else None), (name, c)
    assert last["a"]["value"] == pytest.approx(72, abs=4) and last["d"]["value"] == pytest.approx(84, abs=4)
