"""Context of contests as a stream: keyed state that takes records in the order of their time and freezes when the contest starts.

Records wait in their key's state until the watermark has passed them; a timer then applies them in the order (time, id), however they
arrived. So micro-batches don't matter: what has come no later than ``late`` behind the newest record gives the batch twin's result
(``sources.context.context_log``, ``logs.snapshots``). After the ``lock`` nothing changes, but that a key's very first record is taken even then, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldbook.sources.context import FIELDS
from fieldbook.streaming.logs import SNAPSHOTS

OUT = "key long, weather double, predictor double, odds double, passers double, locked boolean, snapshots array<struct<us:bigint,value:double>>, version long"
_RECORD = "us long, id long, kind string, value double"
_STATE = "weather double, predictor double, odds double, passers double, locked boolean, had boolean, version long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ContextLog(StatefulProcessor):
    """The records that wait, the fields, and the last changes of the odds of a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _RECORD)
        self.fields = handle.getValueState("fields", _STATE)
        self.changes = handle.getListState("changes", "us long, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(r.us), int(r.id), r.kind, None if pd.isna(r.value) else float(r.value)) for b in rows for r in b.itertuples(index=False)]
        self.waiting.appendList(fresh)
        yield from self.drain(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.drain(key, timerValues)

    def drain(self, key, timerValues) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        ready, rest = [r for r in rows if r[0] <= upto], [r for r in rows if r[0] > upto]
        if rest:
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        if not ready:
            return
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        state = list(self.fields.get()) if self.fields.exists() else [None] * len(FIELDS) + [False, False, 0]
        values, (locked, had, version) = dict(zip(FIELDS, state)), state[len(FIELDS) :]
        changes = [tuple(x) for x in self.changes.get()] if self.changes.exists() else []
        for us, _, kind, value in ready:
            version += 1
            if kind == "lock":
                locked = True
            elif kind in FIELDS:
                if not locked or not had:
                    values[kind] = value
                if not locked and kind == "odds" and (not changes or changes[-1][1] != value):
                    changes = [*changes, (us, value)][-SNAPSHOTS:]
                had = True
        self.fields.update((*[values[f] for f in FIELDS], locked, had, version))
        if changes:
            self.changes.put(changes)
        row = {"key": key[0], **values, "locked": locked, "snapshots": [{"us": u, "value": v} for u, v in changes], "version": version}
        out = pd.DataFrame([row])
        yield out.astype({f: "float64" for f in FIELDS})

    def close(self) -> None:
        pass


def context_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The changed context of each key (``events``: ``key``, ``ts``, ``id``, ``kind``, ``value``); the last version of a key counts.

    Needs the state store that keeps timers, which ``run`` sets for its query.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select("key", "ts", F.unix_micros("ts").alias("us"), "id", "kind", F.col("value").cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(ContextLog(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def run(events: DataFrame, spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """Process what there is and read the last version of each key."""
    from fieldbook.streaming.logs import run_to_end

    name, provider = _PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        out = run_to_end(context_stream(events, late), spark, path)
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    last = out.groupBy("key").agg(F.max_by(F.struct(*[c for c in out.columns if c != "key"]), "version").alias("x"))
    return last.select("key", "x.*")
