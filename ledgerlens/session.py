"""Session construction and the few cluster settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every ledgerlens job expects.  AQE re-plans joins and coalesces
# shuffle partitions at runtime, and splits skewed sort-merge-join partitions;
# UTC keeps timestamp maths identical to the SQL oracle.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(
    app_name: str = "ledgerlens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with ledgerlens' base configuration.

    ``master`` is only set when given: on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is read, never
    replaced; without it there is nowhere executors could share a table, so
    that is an error.  Only a local master, whose driver and executors are one
    process, gets a scratch folder when the setting is absent.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    return current


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for a written table, in this application's part of the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{_folder(spark)}/{name}"


def _folder(spark: SparkSession) -> str:
    application = spark.sparkContext.applicationId
    if application not in _CLEARED_AT_EXIT:
        _CLEARED_AT_EXIT.add(application)
        atexit.register(_clear, spark)
    return f"ledgerlens-{application}"


_CLEARED_AT_EXIT: set[str] = set()


def clear_shared(spark: SparkSession) -> None:
    """Delete the tables this application has written to the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/ledgerlens-{spark.sparkContext.applicationId}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _clear(spark: SparkSession) -> None:
    try:
        clear_shared(spark)
    except Exception:  # the session has ended before the process; its folder stays for the operator to remove
        pass


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    They import it for functions that run inside tasks; they may be other
    machines, or start with another path than the driver.
    """
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        _SHIPPED.add(application)
        package = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-package-"), "ledgerlens")
        archive = f"{base}-{application}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(package):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("ledgerlens", os.path.relpath(path, package)))
        spark.sparkContext.addPyFile(archive)
