"""Session defaults: adaptive execution, skew handling, UTC, Arrow."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "veriframe", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()})
    return ship((builder.master(master) if master else builder).getOrCreate())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's Python workers, once an application; they needn't have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="veriframe-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it from the driver whenever they start
        with zipfile.ZipFile(archive := f"{folder}/veriframe.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"veriframe/{f.relative_to(root)}")
        spark.sparkContext.addPyFile(archive)
    return spark
