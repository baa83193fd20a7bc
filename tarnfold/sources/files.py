"""Files: JSON lines, JSON arrays, CSV, Markdown and partitioned tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.sources import positions


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a local one only where none is set and there is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tarnfold-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped; a line that isn't an object of the schema fails the job, naming `path:line`.

    Stores that Arrow has no access to are read by Spark's text reader, whose message names the file and the line's text.
    """
    if positions.readable(path):
        return positions.read(spark, path, schema)
    return parse_lines(spark.read.text(path).withColumn("_file", F.col("_metadata.file_path")), schema)


def parse_lines(lines: DataFrame, schema: T.StructType, *keep: str) -> DataFrame:
    """(value, _file, and what to keep) -> the schema's fields. Lines are parsed as text, as the JSON reader takes an array of objects for several rows."""
    corrupt = "_corrupt_line"
    parsed = F.from_json("value", T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    rows = lines.where(F.trim("value") != "").withColumn("_r", parsed)
    bad = ~F.ltrim("value").startswith("{") | F.col("_r").isNull() | F.col(f"_r.{corrupt}").isNotNull()
    told = F.concat(F.lit("Malformed line, no object of the schema, in "), "_file", F.lit(": "), F.substring("value", 1, 200))
    checked = rows.withColumn("_r", F.when(bad, F.raise_error(told).cast(rows.schema["_r"].dataType)).otherwise(F.col("_r")))
    return checked.select(*[F.col("_r")[f.name].alias(f.name) for f in schema.fields], *keep)


def read_json_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files of JSON lines, of one JSON array, or of one object over several lines, mixed as they come: each file's head tells."""
    return positions.read(spark, path, schema)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The file's rows, or none of the schema where it is missing."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def discover(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files under a path or glob, each row with its file as `source_file`."""
    return spark.read.parquet(path).withColumn("source_file", F.col("_metadata.file_path"))


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).json(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def digest(df: DataFrame, *cols: str) -> DataFrame:
    """One row, `digest`: of a table's content, whatever its rows' order. The rows' SHA-256, in four words of 64 bits, are added up."""
    h = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256)
    words = [F.conv(F.substring(h, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = df.select(*[w.alias(f"w{i}") for i, w in enumerate(words)]).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"w{i}"), F.lit(0)).cast("string").alias(f"s{i}") for i in range(4)])
    return sums.select(F.sha2(F.concat_ws("|", "n", "s0", "s1", "s2", "s3"), 256).alias("digest"))


def to_json_array(df: DataFrame) -> DataFrame:
    """One row, a JSON array: for reports of a few rows, as the array is one value."""
    return df.agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*df.columns))), ","), F.lit("]")).alias("value"))


def write_text(spark: SparkSession, df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").text(path)
    return path


def summary(row: Row) -> str:
    """Pretty JSON with sorted keys, of one report row."""
    return json.dumps(row.asDict(recursive=True), indent=2, sort_keys=True, ensure_ascii=False, default=str)


def summaries(df: DataFrame) -> DataFrame:
    """The same of each row of a table of reports, as `summary`."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_pydict({"summary": pa.array([summary(Row(**r)) for r in batch.to_pylist()], pa.string())})

    return df.mapInArrow(run, "summary string")


def markdown(rows: list[Row], columns: list[str]) -> str:
    """A Markdown table of a report's rows; None is a dash, floats have four digits."""
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows]) + "\n"
