"""Writers: partitioned publication with an index, append-only logs, compact projections."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.validation import same_rows


def write_documents(df: DataFrame, path: str) -> None:
    """Replaces a JSON table: it is written beside the old one, which stays until the new one is whole, and then renamed."""
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.json(beside)
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path))
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{beside} is whole but could not be renamed to {path}")


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a JSON-lines log."""
    df.write.mode("append").json(path)


def publish(df: DataFrame, path: str, by: str) -> DataFrame:
    """Writes one folder for each value of ``by`` and gives the index of what was written: value, folder, rows.

    A large value's rows are split among tasks and files; small ones share a task.
    """
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).json(path)
    written = df.sparkSession.read.schema(df.schema).json(path)
    return written.groupBy(by).agg(F.count("*").alias("rows")).withColumn("folder", F.concat(F.lit(f"{by}="), F.col(by).cast("string")))


def is_stale(rendered: DataFrame, committed: DataFrame) -> bool:
    """Whether a rendered table differs from the committed one."""
    return bool(same_rows(rendered, committed).limit(1).count())


def compact(df: DataFrame, keep: dict[str, str], drop_null: bool = True) -> DataFrame:
    """The columns of ``keep`` under new names; rows without any of them are left out."""
    out = df.select(*[F.col(a).alias(b) for a, b in keep.items()])
    return out.dropna(how="all") if drop_null else out


def report_lines(df: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """One text for each key, its lines in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, line)))
    return df.groupBy(key).agg(F.array_join(F.transform(rows, lambda s: s[line]), "\n").alias("report"))


def drop_private(df: DataFrame, private: Sequence[str]) -> DataFrame:
    return df.drop(*private)
