"""An append-only log of JSON lines that a stream writes exactly once, and its reading.

A micro-batch is written to a folder of its own and then entered in the ledger, one small file per batch, put in place by a rename. A
batch that is computed again after a failure has the same number and the same records: if it is in the ledger it is passed over, if not, its folder
is written anew. Readers take the folders that the ledger names, so a half-written batch is never seen.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tarnfold.sources import files


class Ledger:
    """Which batches of a log are whole: number -> entry."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = f"{path}/_ledger"
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(hadoop.Path(self.path))

    def _place(self, batch: int) -> str:
        return f"{self.path}/{batch:012d}.json"

    def holds(self, batch: int) -> bool:
        return self._fs.exists(self._path(self._place(batch)))

    def enter(self, batch: int, **entry: object) -> None:
        """Put the entry in place as a whole; a second entry of a batch is an error."""
        part = self._path(f"{self._place(batch)}.part")
        out = self._fs.create(part, True)
        try:
            out.write(json.dumps({"batch": batch, **entry}, sort_keys=True).encode())
        finally:
            out.close()
        if not self._fs.rename(part, self._path(self._place(batch))):
            raise FileExistsError(self._place(batch))

    def batches(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def append(stream: DataFrame, path: str, checkpoint: str, name: str | None = None, before_entry: Callable[[int], None] | None = None) -> StreamingQuery:
    """Append all that is there to the log, restarting where the checkpoint ends. before_entry: called between data and ledger (tests)."""
    spark = stream.sparkSession
    ledger = Ledger(spark, path)

    def write(batch: DataFrame, number: int) -> None:
        if ledger.holds(number):
            return
        batch.write.mode("overwrite").json(f"{path}/batch={number}")
        if before_entry:
            before_entry(number)
        ledger.enter(number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of whole batches, with the batch that brought them."""
    batches = Ledger(spark, path).batches()
    columns = [f.name for f in schema.fields]
    if not batches:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
    folders = [f"{path}/batch={n}" for n in batches]
    lines = spark.read.option("basePath", path).text(folders)
    return files.parse_lines(lines.withColumn("_file", F.col("_metadata.file_path")), schema, "batch").select(*columns, F.col("batch").cast("long").alias("batch"))
