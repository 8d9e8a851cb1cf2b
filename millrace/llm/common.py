"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])
_held: dict[Any, Any] = {}

#: Keys up to which a list of them is broadcast; beyond, the rows are shuffled to it.
BROADCAST_KEYS = 1_000_000
#: The key that stands for a null doc_id inside an operator; results carry the null again.
NULL_KEY = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local session may do without it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if spark.conf.get("millrace.shared.dir", None) is None:
        spark.conf.set("millrace.shared.dir", tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("millrace.shared.dir")


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back; cuts the lineage, survives lost executors.

    The table is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Has Hadoop's file system delete a folder, which must exist, when the driver's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def key_of(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_KEY))


def id_of(key: str = "key") -> Column:
    return F.when(F.col(key) != F.lit(NULL_KEY), F.col(key))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def hash_of(column: str = "text") -> Column:
    """A number for a text. With the key it tells rows apart whose doc_id is null or repeated."""
    return F.xxhash64(text_of(column))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id (or the key of a null) and text are not in ``gone``: key, and hash of the text."""
    gone = materialize(gone.toDF("__gone", "__text").distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return docs.join(side, (key_of() == F.col("__gone")) & (hash_of() == F.col("__text")), "left_anti")


def hash_sample(df: DataFrame, by: list[str], most: int, spare: float = 2.0) -> DataFrame:
    """At most ``most`` rows, the first in order of a hash of ``by``.

    The hash must lie below a share that lets about ``spare`` times as many rows through, so that only these, and not the
    first rows of every partition, are sorted. Small tables pass as a whole.
    """
    share = min(1.0, spare * most / max(1, df.count()))
    hashed = df.withColumn("__hash", F.xxhash64(*by))
    return hashed.where(F.col("__hash") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)).orderBy("__hash", *by).limit(most).drop("__hash")


def each(column: pa.Array) -> Iterator[Any]:
    """The values of a column one by one, so that a batch of long texts is not held a second time."""
    return (x.as_py() for x in column)


def numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """``values`` as lists of the given lengths, one after the other."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)


def give_back() -> None:
    """Gives memory that is free already back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release() -> None:
    """Drops what a worker keeps from earlier stages, and gives what they have freed back to the system."""
    _held.clear()
    gc.collect()
    give_back()


def giving_back(run: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """As ``run``, but a worker that waits for its next task does not keep what this one has freed."""

    def giving(batches: Iterator[Any]) -> Iterator[Any]:
        yield from run(batches)
        give_back()

    return giving


def held(key: Any, make: Callable[[], Any]) -> Any:
    """A large object that a Python worker keeps between tasks; only the last one asked for is kept."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. Where this package is not on the path already, Python workers get it there."""
    set_to = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if _ROOT not in set_to.split(":") and os.getcwd() != _ROOT:
        spark.sparkContext.environment["PYTHONPATH"] = f"{_ROOT}:{set_to}" if set_to else _ROOT
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
