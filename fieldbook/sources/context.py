"""Context of a contest from nested JSON: weather, predictor, odds and passers; and its log, which freezes when the contest starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.scalars import share

SHAPE = (
    "struct<weather:struct<temperature:double,displayValue:string>,predictor:struct<homeTeam:struct<gameProjection:string>>,"
    "odds:array<struct<provider:string,spread:double>>,leaders:array<struct<name:string,position:string>>>"
)
FIELDS = ("weather", "predictor", "odds", "passers")


def parse_context(events: DataFrame, payload: str = "payload") -> DataFrame:
    """One row for each event: temperature, sky, home's chance as a fraction, the first line, and the passers' names, each once in their order.

    What a payload lacks is null; a payload that is no JSON gives nulls throughout.
    """
    e = events.withColumn("_e", F.from_json(payload, SHAPE))
    line = F.get(F.filter("_e.odds", lambda o: o["spread"].isNotNull()), F.lit(0))["spread"]
    names = F.array_distinct(F.transform(F.filter("_e.leaders", lambda x: x["position"] == "QB"), lambda x: x["name"]))
    return e.select(
        *[c for c in events.columns if c != payload], F.col("_e.weather.temperature").alias("temperature"), F.col("_e.weather.displayValue").alias("sky"),
        share(F.col("_e.predictor.homeTeam.gameProjection").try_cast("double")).alias("home_chance"), line.alias("line"), names.alias("passers"),
    )


def context_log(events: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The last value of each field before the lock. What comes later changes nothing, but that a key's very first record is taken even then.

    ``events``: ``key``, ``ts``, ``id``, ``kind`` (a field, or ``lock``), ``value``.
    """
    at = F.struct("ts", "id")
    e = events.withColumn("at", at)
    lock = e.where("kind = 'lock'").groupBy(F.col("key").alias("k")).agg(F.min("at").alias("lock"))
    met = e.join(lock.hint("merge"), F.col("key") == F.col("k"), "left")
    early = F.col("lock").isNull() | (F.col("at") < F.col("lock"))
    known: Column = F.col("kind").isin(*fields)
    one = lambda f, when: F.max_by("value", F.when((F.col("kind") == f) & when, F.col("at")))
    late = F.min_by(F.struct("kind", "value"), F.when(known & ~early, F.col("at")))
    agg = met.groupBy("key").agg(*[one(f, early).alias(f) for f in fields], F.coalesce(F.bool_or(known & early), F.lit(False)).alias("_had"), late.alias("_late"), F.max(F.col("lock").isNotNull()).alias("locked"))
    first = lambda f: F.when(~F.col("_had") & (F.col("_late.kind") == f), F.col("_late.value"))
    return agg.select("key", *[F.coalesce(F.col(f), first(f)).alias(f) for f in fields], "locked")
