"""What streams report while they run, as a table: rows read and observed metrics of each micro-batch."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SCHEMA = "query string, batch long, input_rows long, metrics map<string,double>"


class Progress(StreamingQueryListener):
    """Collects the progress of named queries while it is registered; one row per micro-batch, so it is small."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.rows, self.ended, self.lock = spark, {}, {}, threading.Condition()

    def __enter__(self) -> Progress:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        p = event.progress
        seen = {f"{name}.{k}": float(v) for name, row in p.observedMetrics.items() for k, v in row.asDict().items() if isinstance(v, int | float)}
        with self.lock:
            self.rows[p.name, p.batchId] = (p.name, p.batchId, p.numInputRows, seen)  # a batch reported twice counts once

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        with self.lock:
            self.ended[str(event.runId)] = event.exception
            self.lock.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until the query has ended and all its events are here: they come in order, its end last."""
        query.awaitTermination()
        with self.lock:
            if not self.lock.wait_for(lambda: str(query.runId) in self.ended, seconds):
                raise TimeoutError("the stream's last event didn't come")

    def table(self) -> DataFrame:
        with self.lock:
            return self.spark.createDataFrame(sorted(self.rows.values(), key=lambda r: (str(r[0]), r[1])), SCHEMA)
