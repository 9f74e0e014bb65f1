"""Session builder and shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Most bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = 8 << 20

_SHIPPED: dict[str, str] = {}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "lexloom") -> SparkSession:
    return (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Prepare a session for operators that run Python: small Arrow batches, and this package's sources on the executors.

    A worker holds a batch several times over, so batches are held to ARROW_BYTES unless the session asks for less.

    Functions of a package are pickled by name; workers that were not started with it on their path need a copy.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lexloom-"), "lexloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lexloom", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED[app] = path
