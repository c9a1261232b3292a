"""Session builder with the settings that the engine expects."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(name: str = "vitalspark", master: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; sizes stay with the cluster's own settings."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | (extra or {})
    session = builder.config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Bytes of an Arrow batch that goes to a Python worker: long texts would fill far more memory by Spark's own default.
BATCH_BYTES = 4 << 20


def ship(session: SparkSession) -> None:
    """Send this package to the executors, once a session, for clusters that don't have it installed.

    Also sets Arrow batches to BATCH_BYTES where the session has Spark's own default.
    """
    if session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m") in ("67108864b", "64m"):
        session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = session.sparkContext
    if getattr(context, "_vitalspark_shipped", False):
        return
    context._vitalspark_shipped = True
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="vitalspark-code-")) / "vitalspark.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))


def shared_path(session: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares, spark.checkpoint.dir; where it is unset, in a temporary one, but in local mode alone."""
    folder = session.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not session.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="vitalspark-")
        session.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"
