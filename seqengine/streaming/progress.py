"""Progress of streaming queries as rows of a table (SNK16)."""

from __future__ import annotations

import threading
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

ROWS = "query string, run string, batch long, at string, rows long, rows_per_second double, millis long, measure string, value double"


def measured(df: DataFrame, name: str, **measures: Column) -> DataFrame:
    """df, whose micro-batches give these aggregates as they pass, under a name that progress rows show."""
    first, *rest = (column.alias(key) for key, column in measures.items())
    return df.observe(name, first, *rest)


class Progress(StreamingQueryListener):
    """Keeps the last `most` micro-batches of the queries of a session; a batch is a row for each measure, or one without any.

    with watching(spark) as progress: ... progress.table(spark)
    """

    def __init__(self, most: int = 10_000):
        self.seen: deque[tuple] = deque(maxlen=most)
        self.ended: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        head = (p.name, str(p.runId), p.batchId, p.timestamp, p.numInputRows, p.processedRowsPerSecond, p.batchDuration)
        measures = {f"{name}.{key}": value for name, row in p.observedMetrics.items() for key, value in row.asDict().items()}
        self.seen.append(tuple((*head, key, None if value is None else float(value)) for key, value in measures.items()) or ((*head, None, None),))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def wait(self, query, seconds: float = 30.0) -> bool:
        """Waits until all progress of a query that has ended is here."""
        return self._end(str(query.runId)).wait(seconds)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([row for rows in list(self.seen) for row in rows], ROWS)


class watching:  # noqa: N801
    """A context in which a listener sees the queries of a session; of those that are over, it has seen all when the context ends."""

    def __init__(self, spark: SparkSession, most: int = 10_000):
        self.spark, self.progress = spark, Progress(most)

    def __enter__(self) -> Progress:
        self.spark.streams.addListener(self.progress)
        return self.progress

    def __exit__(self, *error) -> None:
        running = {str(query.runId) for query in self.spark.streams.active}
        for run, ended in list(self.progress.ended.items()):
            if run not in running:
                ended.wait(30.0)
        self.spark.streams.removeListener(self.progress)
