"""Session construction shared by the command line, the bench and the tests."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on (UTC, AQE, Parquet statistics).

    On a cluster `master` stays unset, so spark-submit decides it; shuffle
    partitions are then left to the cluster's configuration and AQE.
    """
    builder = SparkSession.builder.appName("tideline")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once per Spark context.

    Workers import it by name; they need not share the driver's path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tideline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tideline-"), "tideline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tideline", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._tideline_shipped = True
