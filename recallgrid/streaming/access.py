"""The log of which search a recall followed, as events arrive: keyed state with timers.

A session's events may come out of order within the watermark's delay, so they are held, one map entry each, until the watermark
has passed their time; a timer for that time then takes them up in order. Beyond what is held, a session's state is the one
search that no recall has taken yet. What comes later than the watermark is dropped by Spark. A search that is not taken is
replaced by the next, or with forget_after_ms forgotten when that much time has passed after it.

The state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``), as for all keyed state of this kind.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

SEARCH, RECALL = 0, 1
LOG = "session_id string, search_id long, result_ids string, recall_id long, recalled long"


def _row(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


class TakeOnce(StatefulProcessor):
    """Pairs each recall with the search right before it in its session."""

    def __init__(self, forget_after_ms: int | None = None) -> None:
        self.forget_after_ms = forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", _row(("at", LongType()), ("kind", LongType()), ("event", LongType())), _row(("result_ids", StringType()), ("recalled", LongType())))
        self.open = handle.getValueState("open", _row(("search_id", LongType()), ("result_ids", StringType()), ("at", LongType())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        times = set()
        for frame in rows:
            for at, kind, event, result_ids, recalled in zip(frame["at_ms"].tolist(), frame["kind"].tolist(), frame["event"].tolist(), frame["result_ids"].tolist(), frame["recalled"].tolist(), strict=True):
                self.held.updateValue((int(at), int(kind), int(event)), (None if pd.isna(result_ids) else str(result_ids), None if pd.isna(recalled) else int(recalled)))
                times.add(int(at))
        for at in times:
            self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((tuple(k), tuple(v)) for k, v in self.held.iterator() if k[0] <= now)
        pending = tuple(self.open.get()) if self.open.exists() else None
        if pending is not None and self.forget_after_ms is not None and pending[2] + self.forget_after_ms <= now:
            pending = None
        told = []
        for (at, kind, event), (result_ids, recalled) in due:
            self.held.removeKey((at, kind, event))
            if kind == SEARCH:
                pending = (event, result_ids, at)
                if self.forget_after_ms is not None:
                    self.handle.registerTimer(at + self.forget_after_ms)
            else:
                if pending is not None and (self.forget_after_ms is None or at < pending[2] + self.forget_after_ms):
                    told.append((str(key[0]), pending[0], pending[1], event, recalled))
                pending = None
        if pending is None:
            self.open.clear()
        else:
            self.open.update(pending)
        if told:
            yield pd.DataFrame(told, columns=[c.split()[0] for c in LOG.split(", ")])

    def close(self) -> None:
        pass


def access_log(searches: DataFrame, recalls: DataFrame, watermark: str = "10 minutes", forget_after_ms: int | None = None) -> DataFrame:
    """What ``sessions.access_log`` gives, of streams: searches (session_id, at, search_id, result_ids), recalls (session_id, at, recall_id,
    recalled); result_ids come as text. At one time a search comes before a recall."""
    none = F.lit(None)
    asked = searches.select("session_id", "at", F.lit(SEARCH).alias("kind"), F.col("search_id").cast("long").alias("event"), F.col("result_ids").cast("string").alias("result_ids"), none.cast("long").alias("recalled"))
    met = recalls.select("session_id", "at", F.lit(RECALL).alias("kind"), F.col("recall_id").cast("long").alias("event"), none.cast("string").alias("result_ids"), F.col("recalled").cast("long").alias("recalled"))
    rows = asked.unionByName(met).withColumn("session_id", F.col("session_id").cast("string")).withWatermark("at", watermark)
    rows = rows.withColumn("at_ms", F.unix_millis("at"))
    return rows.groupBy("session_id").transformWithStateInPandas(TakeOnce(forget_after_ms), LOG, "Append", "EventTime")
