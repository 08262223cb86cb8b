"""A session with the settings that the library counts on, and the package on its executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; on a cluster, master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName("vicinal").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each context, as spark-submit's --py-files does."""
    context = spark.sparkContext
    if getattr(context, "_has_vicinal", None) != context.applicationId:
        here = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="vicinal-")) / "vicinal.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(here.rglob("*.py")):
                z.write(source, source.relative_to(here.parent))
        context.addPyFile(str(target))
        context._has_vicinal = context.applicationId
