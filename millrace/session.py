"""A session with the settings that the library expects where the user has no session of their own."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "millrace", **settings: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; other settings as ``spark_sql_shuffle_partitions="200"``."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local session may do without it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if spark.conf.get("millrace.shared.folder", None) is None:
        spark.conf.set("millrace.shared.folder", tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("millrace.shared.folder")


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Has Hadoop's file system delete a folder, which must exist, when the driver's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, however often it is used, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
