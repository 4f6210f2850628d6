"""Sinks: publish result tables, replace loads, category overwrite, exports.

K1 publish_tables, K2 audit_trail_replace, K3/K4 observations_write,
K5/K6 versions of a table (write_snapshot / current_snapshot), K8 export_csv.

A workflow table is a folder of immutable versions.  A version is complete
when Spark has committed its write (its ``_SUCCESS`` file is there), which is
one atomic step; the highest complete version is the table.  So a writer never
touches what a reader scans, a failed write changes nothing, and what belongs
to a version (such as the stream batch it applied) is part of its name.
All paths are used through Hadoop's file systems: any store Spark reads.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import shared_path

#: Of written tables: fewer bytes to write and to read than with Parquet's default.
COMPRESSION = "zstd"
COMPRESSION_LEVEL = 6
_VERSION = re.compile(r"v(\d+)(?:-t(-?\d+))?$")


def _path(spark: SparkSession, name: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path, and the path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, name: str) -> bool:
    fs, path = _path(spark, name)
    return fs.exists(path)


def child_names(spark: SparkSession, name: str) -> list[str]:
    """Names of what a folder holds; none where it doesn't exist."""
    fs, path = _path(spark, name)
    return [status.getPath().getName() for status in fs.listStatus(path)] if fs.exists(path) else []


def list_files(spark: SparkSession, name: str) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of the data files of a file or folder; names with _ or . in front are none."""
    fs, path = _path(spark, name)
    found = []
    if fs.exists(path):
        files = fs.listFiles(path, True)
        while files.hasNext():
            status = files.next()
            if status.getPath().getName()[0] not in "_.":
                found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return found


def remove(spark: SparkSession, name: str) -> None:
    fs, path = _path(spark, name)
    fs.delete(path, True)


def publish_tables(tables: dict[str, DataFrame], out_dir: str) -> list[str]:
    """K1: overwrite each named result table under ``out_dir`` as parquet."""
    written = []
    for name, df in tables.items():
        path = f"{out_dir}/{name}"
        df.write.mode("overwrite").parquet(path)
        written.append(path)
    return written


def stored_tables(spark: SparkSession, in_dir: str, required: list[str], filled: tuple[str, ...] = ("purchases",)) -> dict[str, DataFrame] | None:
    """Read the published tables when all are present, else None (caller recomputes).

    Those named in ``filled`` must hold at least one row too.
    """
    out = {}
    for name in required:
        path = f"{in_dir}/{name}"
        if not exists(spark, path):
            return None
        out[name] = spark.read.parquet(path)
    return None if any(name in out and out[name].isEmpty() for name in filled) else out


def audit_trail_replace(df: DataFrame, source_file: str, out_dir: str) -> DataFrame:
    """K2: full replace of the audit-trail table, stamped with source file and load time."""
    stamped = df.withColumn("source_file", F.lit(source_file)).withColumn("created_at", F.current_timestamp())
    return write_snapshot(stamped, out_dir)


def observations_write(loaded: DataFrame, table_dir: str, mode: str = "replace") -> None:
    """K3 / K4: write observation rows partitioned by category.

    ``replace``: dynamic partition overwrite -- only the categories present
    in this load are replaced, others stay untouched.  ``append``: seeding.
    """
    writer = loaded.write.partitionBy("category")
    if mode == "append":
        writer.mode("append").parquet(table_dir)
    else:
        (writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(table_dir))


def _versions(spark: SparkSession, table_dir: str) -> list[tuple[int, int | None, str]]:
    """(number, tag, path) of the complete versions, in their order."""
    fs, path = _path(spark, table_dir)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        match = _VERSION.match(status.getPath().getName())
        own = f"{table_dir}/{status.getPath().getName()}"
        if match and exists(spark, f"{own}/_SUCCESS"):
            found.append((int(match[1]), int(match[2]) if match[2] else None, own))
    return sorted(found)


def write_snapshot(df: DataFrame, table_dir: str, tag: int | None = None) -> DataFrame:
    """Write ``df`` as the next version of the table; ``tag`` becomes part of the commit.

    One writer at a time: a second one of the same version fails, as its folder exists.
    """
    spark = df.sparkSession
    fs, path = _path(spark, table_dir)
    names = [_VERSION.match(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []
    number = 1 + max((int(m[1]) for m in names if m), default=0)
    version = f"{table_dir}/v{number:012d}" + (f"-t{tag}" if tag is not None else "")
    df.write.mode("error").parquet(version)
    return spark.read.parquet(version)


def current_snapshot(spark: SparkSession, table_dir: str) -> DataFrame | None:
    """The table's latest complete version; None before the first."""
    versions = _versions(spark, table_dir)
    return spark.read.parquet(versions[-1][2]) if versions else None


def current_tag(spark: SparkSession, table_dir: str) -> int | None:
    """The tag that the latest complete version was committed with."""
    versions = _versions(spark, table_dir)
    return versions[-1][1] if versions else None


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts lineage (and plan size) at a stored table, as the reference's
    workflow reads its stored observation table rather than the upload.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("error").option("compression", COMPRESSION).parquet(path)
    return spark.read.parquet(path)


def compressed(df: DataFrame) -> DataFrameWriter:
    """A writer for large tables: a higher level than the codec's own, for fewer bytes still."""
    return df.write.option("compression", COMPRESSION).option("parquet.compression.codec.zstd.level", COMPRESSION_LEVEL)


@contextmanager
def set_within(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session's settings, changed within and as they were after."""
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def export_csv(df: DataFrame, path: str) -> str | None:
    """K8: labelled CSV report; no file when the report has no rows.

    The report is computed once, into a table, which is then looked at and written.
    """
    report = materialize(df, "report")
    if report.isEmpty():
        return None
    report.write.mode("overwrite").option("header", True).csv(path)
    return path
