"""Events of a key in their order, each once, from a stream that delivers them late, repeated and out of order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BUCKETS = 2048
_CHUNK = 10_000
_SCHEMA = "key string, event_id string, event_type string, at long, place long, before string"
_WAITING = pa.schema([("key", pa.string()), ("at", pa.int64()), ("event_id", pa.string()), ("event_type", pa.string())])
_TOLD = pa.schema([("key", pa.string()), ("through", pa.int64()), ("place", pa.int64()), ("event_type", pa.string())])
_EVENT = ["key", "at", "event_id"]


def _packed(frame: pd.DataFrame, schema: pa.Schema) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_pandas(frame[schema.names], schema, preserve_index=False))
    return (sink.getvalue().to_pybytes(),)


def _unpacked(row: tuple) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(row[0])).read_all()


class _InOrder(StatefulProcessor):
    """Waiting events of a bucket's keys lie in the state store until the watermark has passed them; a timer stands at the
    earliest. Both states hold Arrow tables, as a call to the store costs far more than a row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.told = handle.getValueState("told", "keys binary")

    def _wake(self, at: int) -> None:
        timer = -(-at // 1000)  # milliseconds
        standing = [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]
        if not standing or timer < min(standing):
            for t in standing:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            self.waiting.appendValue(_packed(frame.drop_duplicates(_EVENT), _WAITING))
            first = min(int(frame["at"].min()), first if first is not None else int(frame["at"].min()))
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        through = timerValues.getCurrentWatermarkInMs() * 1000
        before = self.told.get()
        told = (_unpacked(before) if before else _TOLD.empty_table()).to_pandas().set_index("key")
        waiting = pa.concat_tables([_WAITING.empty_table(), *map(_unpacked, self.waiting.get())]).sort_by([(c, "ascending") for c in _EVENT]).to_pandas()
        waiting = waiting.drop_duplicates(_EVENT, keep="last")
        waiting = waiting[waiting["at"].to_numpy() > told["through"].reindex(waiting["key"], fill_value=np.iinfo("int64").min).to_numpy()]
        due = waiting["at"] <= through
        later, now = waiting[~due], waiting[due]
        self.waiting.clear()
        if len(later):
            self.waiting.put([_packed(later[i : i + _CHUNK], _WAITING) for i in range(0, len(later), _CHUNK)])
            self.handle.registerTimer(-(-int(later["at"].min()) // 1000))
        if not len(now):
            return
        first = ~now["key"].duplicated()
        place = now.groupby("key", sort=False).cumcount() + 1 + told["place"].reindex(now["key"], fill_value=0).to_numpy()
        ahead = now["event_type"].shift().where(~first, told["event_type"].reindex(now["key"]).to_numpy())
        now = now.assign(place=place, before=ahead, through=through)
        last = now[~now["key"].duplicated(keep="last")].set_index("key")[told.columns]
        told = pd.concat([told.drop(last.index, errors="ignore"), last]) if len(told) else last
        self.told.update(_packed(told.reset_index(), _TOLD))
        yield now[["key", "event_id", "event_type", "at", "place", "before"]]

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str = "user_id", event: str = "event_id", kind: str = "event_type", time: str = "ts", late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """key, event_id, event_type, at (microseconds), place (from 1) and before (type of the event ahead, null for the first).

    An event is told once the watermark, late behind the newest event, has passed its time; so no earlier one can follow. Ties
    go by event_id as text. One delivered again (same event_id and time) counts once; it or any other that comes after its turn
    is dropped. Rows without key, event or time are dropped. What waits lies in the store (RocksDB, set for the session). Keys
    share buckets by a hash, as a call for each key costs far more than its rows: a task reads what waits of one bucket, about
    as much as arrives of its keys within late, and what was told last of each; a key's order is one task's work. For very many
    keys, set more buckets; their number must stay the same for the life of a checkpoint.
    """
    rows = events.filter(F.col(key).isNotNull() & F.col(event).isNotNull() & F.col(time).isNotNull())
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(event).cast("string").alias("event_id"), F.col(kind).cast("string").alias("event_type"), F.col(time).cast("timestamp").alias("ts"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"))
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return rows.withWatermark("ts", late).groupBy("bucket").transformWithStateInPandas(_InOrder(), _SCHEMA, "Append", "EventTime")
