"""Market events with JSON inside JSON, and their binding into one line for each contest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.scalars import mid_price, split_versus


def json_list(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.from_json(F.lit("[]"), "array<string>"))


def parse_events(events: DataFrame) -> DataFrame:
    """``title``, ``slug`` and ``markets`` (kind, outcomes, prices, line) as a row for each event; the first of a slug."""
    a, b = split_versus(F.col("title"))
    kind = lambda k: F.get(F.filter("markets", lambda m: m["kind"] == k), F.lit(0))
    ml, spread = kind("moneyline"), kind("spreads")
    prices = F.transform(json_list(ml["prices"]), lambda p: p.try_cast("double"))
    df = events.select("slug", a.alias("side_a"), b.alias("side_b"), F.get(prices, F.lit(0)).alias("ml_a"), F.get(prices, F.lit(1)).alias("ml_b"), spread["line"].alias("line"))
    w = Window.partitionBy("slug").orderBy("side_a")
    return df.withColumn("i", F.row_number().over(w)).where("i = 1").drop("i")


def settled(prices: Column) -> Column:
    return F.forall(prices, lambda p: (p <= 0.001) | (p >= 0.999))


def exchange_spreads(markets: DataFrame) -> DataFrame:
    """The spread contract of each event whose price is nearest one half, then of the narrowest quote."""
    m = markets.withColumn("p", mid_price(F.col("bid"), F.col("ask"), F.col("last")))
    points = F.regexp_extract("title", r"wins by over (\d+(?:\.\d+)?) points", 1).try_cast("double")
    m = m.withColumn("points", points).where(F.col("points").isNotNull())
    return m.groupBy("event").agg(F.min_by(F.struct("points", "p"), F.struct(F.abs(F.col("p") - 0.5), F.col("ask") - F.col("bid"))).alias("x")).select("event", "x.*")


def preferred_line(lines: DataFrame, providers: list[str]) -> DataFrame:
    """One line for each contest: that of the first listed provider that has one, else any."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in providers]), F.col("provider")).cast("int"), F.lit(0))
    order = F.struct(F.when(rank == 0, len(providers) + 1).otherwise(rank), F.col("provider"))
    return lines.where(F.col("spread").isNotNull()).groupBy("game_id").agg(F.min_by("spread", order).alias("spread"))
