"""Scores and lines stamped onto frozen projections as they come.

Each micro-batch is joined with the projections, which stand still, and leaves one row for each contest that it knows in a folder of
the batch's number. A batch that runs again overwrites its own folder, so doing it twice changes nothing, and no batch
rewrites what others wrote. The stamped table is a view: projections with the newest score and the first line that was
seen; a projection's probability is never touched, and its own line, where it has one, stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAMPS = "game_id long, batch long, at struct<ts:timestamp,id:long>, actual double, seen double, seen_at struct<ts:timestamp,id:long>"


def batch_stamps(scores: DataFrame, projections: DataFrame, number: int) -> DataFrame:
    """A batch's rows (``game_id``, ``ts``, ``id``, ``margin``, ``spread``) for contests that have a projection: the newest margin, the first line."""
    at = F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"))
    s = scores.withColumn("at", at)
    line = F.when(F.col("spread").isNotNull(), F.col("at"))
    score = F.when(F.col("margin").isNotNull(), F.col("at"))
    one = s.groupBy("game_id").agg(F.max(score).alias("at"), F.max_by(F.col("margin").cast("double"), score).alias("actual"), F.min_by(F.col("spread").cast("double"), line).alias("seen"), F.min(line).alias("seen_at"))
    known = projections.select("game_id").distinct()
    return one.join(known.hint("merge"), "game_id", "left_semi").select("game_id", F.lit(number).cast("long").alias("batch"), "at", "actual", "seen", "seen_at")


def write_batch(scores: DataFrame, number: int, projections: DataFrame, path: str) -> None:
    batch_stamps(scores, projections, number).drop("batch").write.mode("overwrite").parquet(f"{path}/batch={number}")


def stamp_stream(scores: DataFrame, projections: DataFrame, path: str) -> None:
    """Process what a stream of scores has into the stamps under ``path``."""
    writer = scores.writeStream.foreachBatch(lambda df, number: write_batch(df, number, projections, f"{path}/stamps"))
    writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def stamps_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STAMPS).parquet(f"{path}/stamps")


def stamped(projections: DataFrame, stamps: DataFrame) -> DataFrame:
    """``game_id``, ``p``, ``spread``, ``actual`` and whether the line was ``filled``."""
    s = stamps.groupBy(F.col("game_id").alias("g")).agg(F.max_by("actual", "at").alias("actual"), F.min_by("seen", "seen_at").alias("seen"))
    met = projections.join(s.hint("merge"), F.col("game_id") == F.col("g"), "left")
    return met.select("game_id", "p", F.coalesce("spread", "seen").alias("spread"), "actual", (F.col("spread").isNull() & F.col("seen").isNotNull()).alias("filled"))
