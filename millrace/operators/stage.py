"""A resumable stage: each item is answered once by a model, and answers are read anew from what the model said.

The log has a folder for each run, written by Spark's commit as a whole. A run that is started again leaves out its own
folder and replaces it, so that it may be repeated after any failure without a second answer to an item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.slots import Model
from .ranking import best_per_group


def _log(spark: SparkSession, folder: str, key: str, kind: str, before: int | None) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    schema = f"{key} {kind}, model string, raw string, run int"
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    log = spark.read.schema(schema).parquet(folder)
    return log if before is None else log.where(F.col("run") < before)


def stage_results(log: DataFrame, key: str, model: str, parse: Callable[[Column], Column], reject: Column) -> DataFrame:
    """key, payload, run and parsed: the last answer of this model to each item; an answer without a model's name is anyone's.

    What the model said is parsed here and now, so that a better parser needs no new answers. An answer that cannot be
    parsed is an answer all the same: its payload is ``reject``.
    """
    own = log.where(F.coalesce("model", F.lit(model)) == model)
    last = best_per_group(own, [key], [F.col("run")], largest=True).withColumn("__parsed", parse(F.col("raw")))
    return last.select(key, F.coalesce("__parsed", reject).alias("payload"), "run", F.col("__parsed").isNotNull().alias("parsed"))


def run_stage(todo: DataFrame, folder: str, *, key: str, model: str, call: Model, parse: Callable[[Column], Column], reject: Column, run: int) -> DataFrame:
    """Answers what this model has not answered yet, as run number ``run``, and gives ``stage_results`` for ``todo``.

    ``call`` maps Arrow batches of ``todo`` to key and raw. Items of one key are asked once; without a key never.
    """
    spark, kind = todo.sparkSession, dict(todo.dtypes)[key]
    done = stage_results(_log(spark, folder, key, kind, run), key, model, parse, reject).select(key)
    left = todo.where(F.col(key).isNotNull()).dropDuplicates([key]).join(done, key, "left_anti").select(*todo.columns)
    answers = left.mapInArrow(call, f"{key} {kind}, raw string").select(key, F.lit(model).alias("model"), "raw")
    answers.write.mode("overwrite").parquet(f"{folder}/run={run}")
    found = stage_results(_log(spark, folder, key, kind, None), key, model, parse, reject)
    return found.join(todo.select(key).distinct(), key, "left_semi")
