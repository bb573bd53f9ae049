"""What a side's earlier slates say: every value at a slate comes from strictly earlier slates of the season.

Sums are taken per slate first and then cumulated over rows, so contests of one slate never see each other and a
window holds one row for each slate. The wide row of all features is in ``form``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.scalars import portable_round

def prior(keys: tuple[str, ...] = ("season", "team")) -> Window:
    return Window.partitionBy(*keys).orderBy("slate").rowsBetween(Window.unboundedPreceding, -1)


def cumulated(two: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """A row for each season, slate and team: sums over earlier slates, and the last slate played."""
    by = two.groupBy("season", "slate", "team").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    w = prior()
    return by.select("season", "slate", "team", F.max("slate").over(w).alias("last_slate"), *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in sums])


def year_over_year(two: DataFrame) -> DataFrame:
    """Mean margin so far less the final mean of the last earlier season that had contests (0 without one)."""
    now = cumulated(two, {"games": F.lit(1), "margin_sum": F.col("margin")})
    final = two.groupBy("season", "team").agg((F.sum("margin") / F.count(F.lit(1))).alias("mean"))
    last = final.select("team", "season", F.lag("mean").over(Window.partitionBy("team").orderBy("season")).alias("was"))
    met = now.join(last.hint("merge"), ["season", "team"])
    value = F.when(F.col("was").isNotNull() & (F.col("games") > 0), F.col("margin_sum") / F.col("games") - F.col("was")).otherwise(0.0)
    return met.select("season", "slate", "team", portable_round(value).alias("yoy_margin"))
