"""Counters of a running stream, from what its plan observes: no job of their own, and a log line a batch."""

from __future__ import annotations

import logging
import threading
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

log = logging.getLogger("foliate.streaming")
#: Seconds that the last events of a query that has ended may take to arrive.
PATIENCE = 60


class Counters(StreamingQueryListener):
    """Sums of the observed metrics of a named query's batches: totals[observation, metric], and batches."""

    def __init__(self, name: str):
        self.name, self.totals, self.batches = name, Counter(), 0
        self._runs: set[str] = set()
        self._ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._runs.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name != self.name or not progress.observedMetrics:
            return
        here = {(of, k): v for of, row in progress.observedMetrics.items() for k, v in row.asDict().items() if v is not None}
        self.totals.update(here)
        self.batches += 1
        log.info("%s, batch %d: %s", self.name, progress.batchId, ", ".join(f"{of} {v} {k}" for (of, k), v in here.items()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self._runs:
            self._ended.set()

    def wait(self, query: StreamingQuery) -> Counters:
        """Waits for the query to end and for its last events."""
        query.awaitTermination()
        if not self._ended.wait(PATIENCE):
            log.warning("the last counters of %s have not arrived", self.name)
        return self


@contextmanager
def counted(spark: SparkSession, name: str) -> Iterator[Counters]:
    """Counters of the query of that name while it runs in the block."""
    counters = Counters(name)
    spark.streams.addListener(counters)
    try:
        yield counters
    finally:
        spark.streams.removeListener(counters)
