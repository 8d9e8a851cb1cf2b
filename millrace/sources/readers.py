"""Readers that hold a table against its contract before any query runs on it."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A tab-separated table of strings whose header must be exactly ``columns``."""
    found = spark.read.csv(path, sep="\t", header=True, inferSchema=False).columns
    if found != list(columns):
        raise ValueError(f"header {found} is not {list(columns)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, sep="\t", header=True, enforceSchema=False)


def read_json_document(spark: SparkSession, path: str, version: str | None = None, schema: str | None = None) -> DataFrame:
    """JSON files of one document each; with ``version`` every file's schema_version must be it."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    if version is not None:
        wrong = df.where(~F.coalesce(F.col("schema_version") == version, F.lit(False))).limit(1).count() if "schema_version" in df.columns else 1
        if wrong:
            raise ValueError(f"{path} has another schema_version than {version}")
    return df


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, or an empty table where the path does not exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object to a line; blank lines are skipped, broken ones give null columns."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("x")).select("x.*")


def read_sharded(spark: SparkSession, root: str, index: DataFrame, column: str, schema: str) -> DataFrame:
    """The shards that an index names, each once; names that leave the root are an error."""
    names = sorted({r[0] for r in index.select(column).distinct().collect()})
    for n in names:
        if PurePosixPath(n).is_absolute() or ".." in PurePosixPath(n).parts:
            raise ValueError(f"{n} lies outside of {root}")
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{root}/{n}" for n in names])


def read_packages(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A file of a given name in every folder under ``root``, with the folder it comes from."""
    df = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/{name}")
    return df.withColumn("package", F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1))


def keyed(df: DataFrame, key: str) -> DataFrame:
    """``df``, whose key must be set and unique; otherwise an error names some offenders."""
    bad = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "") | (F.col("n") > 1)).limit(5).collect()
    if bad:
        raise ValueError(f"blank or repeated {key}: {[r[0] for r in bad]}")
    return df


def last_wins(df: DataFrame, key: str, seq: str) -> DataFrame:
    """For each key the row with the greatest ``seq``."""
    from ..operators.ranking import best_per_group

    return best_per_group(df, [key], [F.col(seq)], largest=True)


def seconds_to_ms(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.bround(F.col(c) * 1000).cast("long"))
    return df


def _yaml_items(spark: SparkSession, path: str | Sequence[str], schema: str, kind: type) -> DataFrame:
    """Items of YAML files, each with its file and its place in it; parsed in the tasks, a file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
                doc = yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
                if not isinstance(doc, kind):
                    raise ValueError(f"{file} is no YAML {kind.__name__}")
                items = doc if kind is list else [doc]
                yield pa.RecordBatch.from_pydict({"file": [file] * len(items), "seq": pa.array(range(len(items)), pa.int64()), "item": [json.dumps(x, default=str) for x in items]})

    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    rows = text.mapInArrow(run, "file string, seq long, item string")
    return rows.select("file", "seq", F.from_json("item", schema).alias("x")).select("file", "seq", "x.*")


def read_yaml_list(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """The items of YAML lists, with file and seq; a missing file, or a document that is no list, is an error."""
    return _yaml_items(spark, path, schema, list)


def read_yaml_mapping(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A YAML mapping as a row; a missing file gives an empty table, another document is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return _yaml_items(spark, path, schema, dict).drop("file", "seq")


def in_file_order(items: DataFrame, key: str | None = None) -> DataFrame:
    """Items of several files in one sequence: __order, by path and place; with ``key`` the last item of each key stays."""
    ordered = items.withColumn("__order", F.struct("file", "seq"))
    return last_wins(ordered, key, "__order") if key else ordered


def named_like_file(df: DataFrame, key: str, file: str = "file") -> DataFrame:
    """``df``, whose key must equal the stem of the file that a row comes from; otherwise an error names some files."""
    stem = F.regexp_extract(file, "([^/]+?)(?:\\.[^./]*)?$", 1)
    wrong = df.where(~F.coalesce(F.col(key) == stem, F.lit(False))).select(file).limit(5).collect()
    if wrong:
        raise ValueError(f"{key} is not the file's name in {[r[0] for r in wrong]}")
    return df


def load_lessons(lessons: DataFrame, sources: DataFrame, *, key: str, source: str, seconds: Sequence[str]) -> DataFrame:
    """Lessons with unique keys and known sources (else an error), and the columns ``seconds`` in milliseconds."""
    from ..operators.validation import require_known

    return seconds_to_ms(require_known(keyed(lessons, key), source, sources, source), seconds)
