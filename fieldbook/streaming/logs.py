"""Keyed logs that lock when a contest starts, as streams and as batch twins.

An event has ``key``, ``ts``, ``id`` (breaks ties), ``kind`` and ``value``. Kinds: ``line`` moves the line, before and
after the start; ``price`` (a probability) is taken while no live price is locked, and one that isn't live never
replaces one that is; ``start`` locks. Late events of a key are taken in the order in which they come with their batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SNAPSHOTS = 24
LINE_LOG = "key long, line double, price double, locked boolean, version long"


def live(p: Column) -> Column:
    return (p > 0.02) & (p < 0.98)


def line_log_stream(events: DataFrame) -> DataFrame:
    """The changed state of each key after each batch; the last version of a key counts."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        line, price, locked, version = state.get if state.exists else (None, None, False, 0)
        for r in pd.concat(list(frames)).sort_values(["ts", "id"]).itertuples(index=False):
            held = price is not None and 0.02 < price < 0.98
            if r.kind == "line":
                line = float(r.value)
            elif r.kind == "price" and not (locked and held) and (not held or 0.02 < r.value < 0.98):
                price = float(r.value)
            elif r.kind == "start":
                locked = True
            version += 1
        state.update((line, price, locked, version))
        yield pd.DataFrame({"key": [key[0]], "line": [line], "price": [price], "locked": [locked], "version": [version]})

    return events.groupBy("key").applyInPandasWithState(update, LINE_LOG, "line double, price double, locked boolean, version long", "append", GroupStateTimeout.NoTimeout)


def line_log(events: DataFrame) -> DataFrame:
    """The same final state from all events at once, without state."""
    at = F.struct("ts", "id")
    start = events.where("kind = 'start'").groupBy(F.col("key").alias("k")).agg(F.min(at).alias("start"))
    met = events.join(start, F.col("key") == F.col("k"), "left").withColumn("at", at)
    early = F.col("start").isNull() | (F.col("at") < F.col("start"))
    price, is_live = F.col("kind") == "price", live(F.col("value"))
    out = met.groupBy("key").agg(
        F.max_by("value", F.when(F.col("kind") == "line", F.col("at"))).alias("line"), F.max_by("value", F.when(price & is_live & early, F.col("at"))).alias("before"),
        F.min_by("value", F.when(price & is_live & ~early, F.col("at"))).alias("after"), F.max_by("value", F.when(price, F.col("at"))).alias("any"),
        F.coalesce(F.bool_or(F.col("kind") == "start"), F.lit(False)).alias("locked"), F.count(F.lit(1)).alias("version"),
    )
    return out.select("key", "line", F.coalesce("before", "after", "any").alias("price"), "locked", "version")


def snapshots(events: DataFrame, cap: int = SNAPSHOTS) -> DataFrame:
    """Changes of each key's value before its lock, the last ``cap`` of them."""
    w = Window.partitionBy("key").orderBy("ts", "id")
    lock = events.where("kind = 'start'").groupBy(F.col("key").alias("k")).agg(F.min("ts").alias("lock"))
    open_ = events.where("kind = 'line'").join(lock, F.col("key") == F.col("k"), "left").where(F.col("lock").isNull() | (F.col("ts") < F.col("lock")))
    changed = open_.withColumn("was", F.lag("value").over(w)).where(F.col("was").isNull() | (F.col("was") != F.col("value")))
    back = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("id"))
    return changed.withColumn("age", F.row_number().over(back)).where(F.col("age") <= cap).select("key", "ts", "id", "value", "age")


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream gets its watermark, which needs timestamps with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def daily_card(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts and sums for each day and kind; a day closes when the watermark has passed it."""
    day = F.window("ts", "1 day")
    base = _timed(events, late)
    return base.groupBy(day.alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("day"), "kind", "n", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    base = _timed(events, late)
    return base.groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def rating_stream(games: DataFrame) -> DataFrame:
    """Live Elo by margin of victory: a pool's ratings are its state; contests of a slate older than the state's are marked late and move nothing."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, values, upto = state.get if state.exists else ([], [], -1)
        now = dict(zip(names, values))
        rows = []
        for r in pd.concat(list(frames)).sort_values(["slate_no", "game_id"]).itertuples(index=False):
            late = r.slate_no < upto
            h, a = now.get(r.home, 1500.0), now.get(r.away, 1500.0)
            if not late:
                upto = r.slate_no
                ahead, won = h + 55.0 - a, r.margin > 0
                by = math.log(abs(r.margin) + 1) * 2.2 / ((ahead if won else -ahead) * 0.001 + 2.2)
                move = 20.0 * by * (float(won) - 1 / (1 + 10 ** (-ahead / 400)))
                now[r.home], now[r.away] = h + move, a - move
            rows.append((r.game_id, late, h, a))
        state.update((list(now), list(now.values()), int(upto)))
        yield pd.DataFrame(rows, columns=["game_id", "late", "home_before", "away_before"])

    return games.groupBy("pool").applyInPandasWithState(
        update, "game_id long, late boolean, home_before double, away_before double", "names array<string>, values array<double>, upto long", "append", GroupStateTimeout.NoTimeout
    )


def stamp(projections: DataFrame, scores: DataFrame) -> DataFrame:
    """Projections with actual scores where known. Probabilities never move; a line is filled only where it is missing."""
    s = scores.select(F.col("game_id").alias("g"), F.col("margin").alias("actual"), F.col("spread").alias("seen"))
    met = projections.join(s, F.col("game_id") == F.col("g"), "left")
    return met.select("game_id", "p", F.coalesce("spread", "seen").alias("spread"), "actual", (F.col("spread").isNull() & F.col("seen").isNotNull()).alias("filled"))


def run_to_end(stream: DataFrame, spark: SparkSession, path: str, mode: str = "append") -> DataFrame:
    """Process what there is into a table under ``path`` and read it."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
