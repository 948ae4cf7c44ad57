"""New and changed rows of a stream, by a state that Spark keeps for each key.

The state of a key is the version and the hash last met, in RocksDB, of which
each batch writes what has changed; a batch that is run again starts from the
state before it. Rows of one key meet in one task, one row at a time; of the
rows of an Arrow batch only the newest of each key goes there. Keys are many
and their rows few, so the state's step takes rows: a frame a key costs more
than the state does. Spark refuses a checkpoint whose state was kept by frames
(transformWithStateInPandas), as earlier versions did.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),  # long texts on their way to Python
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB and send bounded batches to Python; the session's settings are put back behind it."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    try:
        for k, v in _STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _newest(frame: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """One row a key: the greatest version, and of equal versions the greatest hash."""
    return frame.sort_values(names, kind="stable").drop_duplicates(names[0], keep="last")


class _Latest(StatefulProcessor):
    def __init__(self, key: str, version: str, digest: str):
        self.names = [key, version, digest]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "version bigint, digest string")

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        _, version, digest = self.names
        best = now = None
        for row in rows:  # as they arrive, one held
            met = row[version], row[digest]
            if best is None or met >= now:
                best, now = row, met
        if best is None:
            return
        old = self.last.get()
        if old is not None and now <= (old[0], old[1]):
            return
        self.last.update(now)
        if old is None or now[1] != old[1]:
            yield Row(**best.asDict(), status="new" if old is None else "changed")

    def close(self) -> None:
        pass


def changes(stream: DataFrame, key: str = "url", version: str = "version", digest: str = "hash") -> DataFrame:
    """Rows of a stream whose key is new or whose digest (string) differs from the key's last, with status: new or changed.

    version: bigint; of several rows of a key in a batch the one of greatest version (then digest) counts, and one that is
    not above the last met, whatever the batch, does not count. Rows without key, version or digest are left out.
    """
    rows = stream.where(" and ".join(f"`{c}` is not null" for c in (key, version, digest)))
    names = [key, version, digest]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows = rows.mapInPandas(lambda frames: (_newest(f, names) for f in frames), schema)
    return rows.groupBy(key).transformWithState(_Latest(key, version, digest), f"{schema}, status string", "Append", "None")
