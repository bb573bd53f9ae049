"""Game cards: fixtures with lines and prices, what may still change on them, picks, and what they come to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import scalars as X
from fieldbook.sources.markets import preferred_line


def slate(fixtures: DataFrame, lines: DataFrame, providers: Sequence[str]) -> DataFrame:
    """Fixtures of which a side is in the top division, with the preferred line, result and place in the order (slate, start, home, away).

    ``fixtures``: ``game_id``, ``season``, ``slate``, ``start``, ``home``, ``away``, ``home_div``, ``away_div``, ``home_points``, ``away_points`` (null: not played).
    """
    top = (F.col("home_div") == "fbs") | (F.col("away_div") == "fbs")
    out = fixtures.where(top).join(preferred_line(lines, list(providers)).hint("merge"), "game_id", "left")
    margin = F.col("home_points") - F.col("away_points")
    order = Window.partitionBy("season").orderBy("slate", "start", "home", "away")
    return out.select(
        "game_id", "season", "slate", "start", "home", "away", "spread", margin.isNotNull().alias("completed"), margin.alias("margin"),
        F.when(margin > 0, F.col("home")).when(margin < 0, F.col("away")).alias("winner"), F.row_number().over(order).alias("place"),
    )


def kickoff_passed(as_of: Column) -> Column:
    """Completed, or with a score, or begun; an unknown start hasn't."""
    return F.col("completed") | F.col("margin").isNotNull() | F.coalesce(F.col("start") <= as_of, F.lit(False))


def needs_refresh(as_of: Column, days: int = 3) -> Column:
    """Something is missing, or the start is near; never once it is locked."""
    near = F.col("start").between(as_of, as_of + F.make_dt_interval(F.lit(days)))
    return ~F.coalesce(F.col("locked"), F.lit(False)) & (F.col("spread").isNull() | F.coalesce(near, F.lit(False)))


def days_to_fetch(cards: DataFrame, today: Column, most: int = 16) -> DataFrame:
    """The first days of unfinished contests and today."""
    open_ = cards.where(~F.col("completed") & F.col("start").isNotNull()).select(F.to_date("start").alias("day"))
    return open_.unionByName(cards.sparkSession.range(1).select(today.alias("day"))).distinct().orderBy("day").limit(most)


def live_season(cards: DataFrame) -> DataFrame:
    """The last season with contests still to play."""
    return cards.where(~F.col("completed")).agg(F.max("season").alias("season"))


def merge_quotes(moneylines: DataFrame, spreads: DataFrame) -> DataFrame:
    """Both kinds of events of one pair and day in one row; either may be missing."""
    keys = ["home", "away", "day"]
    return moneylines.join(spreads.hint("merge"), keys, "full")


def stamp_log(cards: DataFrame, log: DataFrame) -> DataFrame:
    """What a log says of each contest by its key; contests without an entry stay as they are."""
    return cards.join(log.hint("merge"), "key", "left")


def merge_picks(book: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("owner", "game_id")) -> DataFrame:
    """Pick books in one; an incoming pick takes the place of the one before."""
    both = book.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"))
    return both.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i", "_new")


def facts(cards: DataFrame, teams: DataFrame) -> DataFrame:
    """Contests beside both sides' final ratings (``season``, ``team``, ``pom``, ``tempo``): gap, mean tempo, favourite, error of the margin and of the total."""
    out = cards
    for side in ("home", "away"):
        t = teams.select(F.col("season").alias("ts"), F.col("team").alias("tt"), F.col("pom").alias(f"{side}_pom"), F.col("tempo").alias(f"{side}_tempo"))
        out = out.join(t.hint("merge"), F.expr(f"season = ts and {side} = tt"), "left").drop("ts", "tt")
    return out.select(
        "game_id", X.portable_round(F.col("home_pom") - F.col("away_pom"), 2).alias("gap"), X.portable_round((F.col("home_tempo") + F.col("away_tempo")) / 2, 2).alias("mean_tempo"),
        F.when(F.col("p") >= 0.5, F.col("home")).otherwise(F.col("away")).alias("favourite"), X.portable_round(F.abs(F.col("pred_margin") - F.col("margin")), 2).alias("margin_error"),
        X.portable_round(F.col("pred_home") + F.col("pred_away") - F.col("total"), 1).alias("total_error"),
    )


def pick_line(explicit: Column, side: Column, home_line: Column) -> Column:
    """The line a pick locks: its own, else the market's from the side chosen."""
    return F.coalesce(explicit, F.when(side == "home", home_line).when(side == "away", -home_line))


def pick_label(team: Column, kind: Column, line: Column) -> Column:
    """``Name -3.5``, ``Name PK`` or ``Name ML``."""
    spread = F.when(line == 0, "PK").otherwise(F.concat(F.when(line > 0, "+").otherwise("-"), F.format_string("%.1f", F.abs(line))))
    return F.concat(team, F.lit(" "), F.when(kind == "ml", "ML").otherwise(spread))


def moneyline(p: Column, market: Column) -> dict[str, Column]:
    """The side with an edge over the market's chance of a home win, the edge, and fair and market odds of that side."""
    edge = p - market
    home = edge >= 0
    own, theirs = F.when(home, p).otherwise(1 - p), F.when(home, market).otherwise(1 - market)
    return {"side": F.when(home, "home").otherwise("away"), "edge": X.portable_round(F.abs(edge)), "fair_odds": X.american(own), "market_odds": X.american(theirs)}


def consensus(probabilities: Column) -> Column:
    """The mean of the models' probabilities in a map; models that have none don't count."""
    known = F.filter(F.map_values(probabilities), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def grade(picks: DataFrame) -> DataFrame:
    """Picks (``kind``: score, ats or ml; ``side``, ``line``, ``pick_margin``) by owner and kind: hits, misses, pushes, pending, and for scores the error and the mean residual."""
    won = F.when(F.col("margin") == 0, "push").when((F.col("margin") > 0) == (F.col("side") == "home"), "hit").otherwise("miss")
    ats = F.when(F.col("line").isNull(), "pending").otherwise(X.settle(F.col("side"), F.col("margin"), F.when(F.col("side") == "home", F.col("line")).otherwise(-F.col("line"))))
    straight = F.when(F.col("margin") == 0, "push").when((F.col("pick_margin") > 0) == (F.col("margin") > 0), "hit").otherwise("miss")
    result = F.when(~F.col("completed"), "pending").when(F.col("kind") == "ats", ats).when(F.col("kind") == "ml", won).otherwise(straight)
    n = lambda x: F.sum(F.coalesce((F.col("result") == x).cast("int"), F.lit(0))).alias({"hit": "hits", "miss": "misses", "push": "pushes", "pending": "pending"}[x])
    scored = (F.col("kind") == "score") & F.col("completed")
    off = F.when(scored, F.col("pick_margin") - F.col("margin"))
    return picks.withColumn("result", result).groupBy("owner", "kind").agg(n("hit"), n("miss"), n("push"), n("pending"), X.portable_round(F.avg(F.abs(off)), 3).alias("mae"), X.portable_round(F.avg(-off), 3).alias("residual"))
