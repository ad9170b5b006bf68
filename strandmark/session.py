"""Spark session with the settings that the operators assume."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "strandmark", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; pass other settings by name with '_' for '.'."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless they find it by PYTHONPATH, their folder or an installation."""
    package = Path(__file__).resolve().parent
    known = {os.path.abspath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    name = f"{package.name}.zip"
    if str(package.parent) in known or package.parent.name == "site-packages" or any(f.endswith(name) for f in spark.sparkContext.listFiles):
        return
    target = Path(tempfile.mkdtemp()) / name
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
