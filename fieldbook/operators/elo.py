"""Elo by margin of victory, with contests spread by what depends on what.

A contest depends on the last ones of its two sides only. Seasons follow each other; within one, contests fall into parts that
share no side, and parts are folded side by side, a group for each. A part of more than ``FOLD_ROWS`` contests isn't folded
whole: it goes slate by slate, each slate's own parts side by side, and a part that is still too large goes in rounds, in each of which
every side has one contest at most, so that a round is a join with the ratings and plain columns. Ratings are a table
that every step reads and writes anew; no group holds more than ``FOLD_ROWS`` contests.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.operators import graph as G
from fieldbook.sources.store import scratch

MEAN, K, HOME, CARRY = 1500.0, 20.0, 55.0, 0.75
FOLD_ROWS = 100_000
WALK = "game_id long, season int, slate int, home string, away string, home_before double, away_before double, home_after double, away_after double, pool long"
_BOOK = "pool long, team string, elo double"


def shift(lead: float, margin: float) -> float:
    """What home gains and away loses; ``lead`` is home's, with the home edge. A tie is a loss at home that moves nothing."""
    won = margin > 0
    return K * math.log(abs(margin) + 1) * 2.2 / ((lead if won else -lead) * 0.001 + 2.2) * (float(won) - 1 / (1 + 10 ** (-lead / 400)))


def shift_column(lead: Column, margin: Column) -> Column:
    won = margin > 0
    return K * F.log(F.abs(margin) + 1) * 2.2 / (F.when(won, lead).otherwise(-lead) * 0.001 + 2.2) * (won.cast("double") - 1 / (1 + F.pow(F.lit(10.0), -lead / 400)))


def with_parts(games: DataFrame, *within: str) -> DataFrame:
    """``part``: the smallest side of those that contests of the same pool and ``within`` connect."""
    key = F.struct("pool", *within)
    label = G.components(games.select(key.alias("g"), F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b"), F.lit(1).alias("w")).distinct())
    label = label.select(F.col("g").alias("part_g"), F.col("u").alias("part_u"), F.col("label").alias("part"))
    return games.drop("part").join(label.hint("merge"), (key == F.col("part_g")) & (F.col("home") == F.col("part_u"))).drop("part_g", "part_u")


def _rated(games: DataFrame, book: DataFrame) -> DataFrame:
    """Both sides' ratings as ``home_before`` and ``away_before``; a new side has the mean. The book is read from files, so Spark chooses the join by its size."""
    for side in ("home", "away"):
        b = book.select(F.col("pool").alias("bp"), F.col("team").alias("bt"), F.col("elo").alias(f"{side}_before"))
        games = games.join(b, (F.col("pool") == F.col("bp")) & (F.col(side) == F.col("bt")), "left").drop("bp", "bt")
        games = games.withColumn(f"{side}_before", F.coalesce(f"{side}_before", F.lit(MEAN)))
    return games


def _folded(games: DataFrame, book: DataFrame) -> DataFrame:
    """Contests of parts in their order, a group for each pool and part."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        now: dict[str, float] = {}
        rows = []
        for r in g.sort_values(["slate", "game_id"]).itertuples(index=False):
            h, a = now.get(r.home, r.home_before), now.get(r.away, r.away_before)
            by = shift(h + HOME - a, r.margin)
            now[r.home], now[r.away] = h + by, a - by
            rows.append((r.game_id, r.season, r.slate, r.home, r.away, h, a, h + by, a - by, r.pool))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in WALK.split(", ")])

    return _rated(games, book).groupBy("pool", "part").applyInPandas(fold, WALK)


def _round(games: DataFrame, book: DataFrame) -> DataFrame:
    """Contests of which no two share a side, all at once."""
    met = _rated(games, book)
    by = shift_column(F.col("home_before") + HOME - F.col("away_before"), F.col("margin"))
    met = met.withColumn("by", by)
    return met.select("game_id", "season", "slate", "home", "away", "home_before", "away_before", (F.col("home_before") + F.col("by")).alias("home_after"), (F.col("away_before") - F.col("by")).alias("away_after"), "pool")


def _sides(games: DataFrame, *more: Column | str) -> DataFrame:
    side = F.explode(F.array(*[F.struct(F.col(s).alias("team"), F.lit(s).alias("role")) for s in ("home", "away")]))
    return games.select("pool", *more, side.alias("x")).select("pool", "x.*", *[m for m in more])


def _next_round(left: DataFrame) -> DataFrame:
    """Contests that are the first left for both of their sides, in the order of their numbers."""
    first = _sides(left, "game_id").groupBy(F.col("pool").alias("fp"), F.col("team").alias("ft")).agg(F.min("game_id").alias("first"))
    for side in ("home", "away"):
        left = left.join(first.hint("merge"), (F.col("pool") == F.col("fp")) & (F.col(side) == F.col("ft")) & (F.col("game_id") == F.col("first"))).drop("fp", "ft", "first")
    return left


def _after(book: DataFrame, walk: DataFrame) -> DataFrame:
    """The book with what its sides have after their last contests of a step."""
    after = F.explode(F.array(*[F.struct(F.col(s).alias("team"), F.col(f"{s}_after").alias("elo")) for s in ("home", "away")]))
    new = walk.select("pool", F.struct("slate", "game_id").alias("at"), after.alias("x")).select("pool", "x.team", "x.elo", "at")
    old = book.withColumn("at", F.struct(F.lit(-1).alias("slate"), F.lit(None).cast("long").alias("game_id")))
    return old.unionByName(new).groupBy("pool", "team").agg(F.max_by("elo", "at").alias("elo"))


def elo(games: DataFrame, pool: str | None = None, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Elo before and after each contest, in the order (season, slate, game_id) within a pool.

    A new season of a pool draws all its ratings back to the mean. The driver sees the lists of seasons and slates.
    """
    spark, path = games.sparkSession, scratch(games.sparkSession)
    keyed = games.select("game_id", F.col("season").cast("int").alias("season"), F.col("slate").cast("int").alias("slate"), "home", "away", "margin", (F.col(pool) if pool else F.lit(0)).cast("long").alias("pool"))
    keyed.write.parquet(f"{path}/games")
    keyed = spark.read.parquet(f"{path}/games")
    book, steps = spark.createDataFrame([], _BOOK), 0

    def take(walk: DataFrame) -> None:
        nonlocal book, steps
        walk.write.parquet(f"{path}/walk/step={steps}")
        _after(book, spark.read.schema(WALK).parquet(f"{path}/walk/step={steps}")).write.parquet(f"{path}/book/{steps}")
        book = spark.read.schema(_BOOK).parquet(f"{path}/book/{steps}")
        steps += 1

    def split(part: DataFrame, *within: str) -> tuple[DataFrame, DataFrame]:
        """What can be folded, and what is too large for it."""
        part = with_parts(part, *within)
        part.write.parquet(where := f"{scratch(spark)}/parts")
        part = spark.read.parquet(where)
        sizes = part.groupBy(F.col("pool").alias("sp"), F.col("part").alias("sl")).agg(F.count(F.lit(1)).alias("rows"))
        large = sizes.where(F.col("rows") > fold_rows).drop("rows").hint("merge")
        on = (F.col("pool") == F.col("sp")) & (F.col("part") == F.col("sl"))
        return part.join(large, on, "left_anti"), part.join(large, on, "left_semi")

    counts = keyed.groupBy("season", "pool").agg(F.count(F.lit(1)).alias("rows")).groupBy("season").agg(F.max("rows").alias("most")).collect()
    for season, most in sorted(map(tuple, counts)):
        mine = keyed.where(F.col("season") == season).withColumn("part", F.lit(""))
        starting = mine.select("pool").distinct().withColumn("starts", F.lit(True))
        drawn = book.join(starting, "pool", "left")
        book = drawn.select("pool", "team", F.when(F.col("starts"), MEAN + CARRY * (F.col("elo") - MEAN)).otherwise(F.col("elo")).alias("elo"))
        if most <= fold_rows:
            take(_folded(mine, book))
            continue
        few, many = split(mine, "season")
        take(_folded(few, book))
        for (slate,) in sorted(map(tuple, many.select("slate").distinct().collect())):
            few, left = split(many.where(F.col("slate") == slate), "season", "slate")
            take(_folded(few, book))
            while not left.isEmpty():
                take(_round(_next_round(left), book))
                left = left.join(spark.read.schema(WALK).parquet(f"{path}/walk/step={steps - 1}").select("game_id").hint("merge"), "game_id", "left_anti")
                left.write.parquet(where := f"{scratch(spark)}/left")
                left = spark.read.schema(left.schema).parquet(where)
    if not steps:
        return spark.createDataFrame([], WALK).drop("pool")
    return spark.read.schema(f"{WALK}, step int").parquet(f"{path}/walk").drop("pool", "step")
