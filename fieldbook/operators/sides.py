"""Contests as two sides: scores, rates and the opponent's view of the same play."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.scalars import garbage, portable_round, ratio, win_probability

DEAD = ("Timeout", "End Period", "End of Half", "End of Game")


def live(plays: DataFrame) -> DataFrame:
    """Without dead plays and plays that a penalty undid; an unknown play type is live."""
    kind = F.col("play_type") if "play_type" in plays.columns else F.lit(None).cast("string")
    penalty = F.col("penalty_no_play") if "penalty_no_play" in plays.columns else F.lit(0)
    return plays.where(~F.coalesce(kind.isin(*DEAD), F.lit(False)) & (F.coalesce(penalty, F.lit(0)) == 0))


#: Flags of plays that aren't from scrimmage, whichever unit is on the field.
KICKS = ("kickoff_play", "punt", "fg_inds")


def scrimmage(plays: DataFrame) -> Column:
    """Offence with a known value, without kickoffs, punts and field goals where the plays are flagged for them (null: isn't one)."""
    use = (F.col("pos_unit") == "Offense") & F.col("epa").isNotNull()
    for c in KICKS:
        if c in plays.columns:
            use &= F.coalesce(F.col(c).cast("double"), F.lit(0.0)) == 0
    return use


def special() -> Column:
    return ~F.col("pos_unit").eqNullSafe("Offense") & F.col("epa").isNotNull()


def top_offence(div: str = "fbs") -> Column:
    """Whether the side with the ball is in a division."""
    return F.coalesce(F.when(F.col("pos") == F.col("home"), F.col("home_div")).otherwise(F.col("away_div")) == div, F.lit(False))


#: What the first play of a contest says of it.
FIRST = ("season", "slate", "home", "away", "home_conf", "away_conf", "home_div", "away_div")
SUMS = ("off_sum", "off_n", "st_sum", "giveaways", "rush_yds", "rush_n")


def _of_games(plays: DataFrame) -> dict[str, Column]:
    return {
        "first": F.min("game_play_number"), "home_points": F.max("home_score"), "away_points": F.max("away_score"), "periods": F.max("period"),
        "tempo": F.sum(scrimmage(plays).cast("int")),
    }


def final_scores(plays: DataFrame) -> DataFrame:
    """A row for each contest. Contests short of four periods go.

    Plays are added up under all that they say of their contest, by hashing; only those few sums are put in order.
    """
    per = plays.groupBy("game_id", *FIRST).agg(*[c.alias(k) for k, c in _of_games(plays).items()])
    return per.groupBy("game_id").agg(
        *[F.min_by(c, "first").alias(c) for c in FIRST],
        F.max("home_points").alias("home_points"), F.max("away_points").alias("away_points"), F.max("periods").alias("periods"), F.sum("tempo").alias("tempo"),
    ).where("periods >= 4")


def _of_sides(plays: DataFrame) -> dict[str, Column]:
    """Sums of a side with the ball; decided plays count for tempo and special teams only."""
    decided = garbage(F.col("period"), F.col("pos_margin"))
    use = scrimmage(plays) & ~decided
    count = lambda c: F.sum(c.cast("int"))
    pick = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    return {
        "off_sum": pick(use, F.col("epa")), "off_n": count(use), "st_sum": pick(special(), F.col("epa")),
        "giveaways": count(F.col("turnover")), "rush_yds": pick(F.col("rush") & (F.col("pos_unit") == "Offense"), F.col("yards")),
        "rush_n": count(F.col("rush") & (F.col("pos_unit") == "Offense")),
    }


def side_sums(plays: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of plays that agree in ``keys``, which tell the contest, the side with the ball and what the plays say of the contest."""
    return plays.groupBy(*keys).agg(*[c.alias(k) for k, c in (_of_games(plays) | _of_sides(plays)).items()])


def sides(plays: DataFrame) -> DataFrame:
    """Two rows for each contest, each with its own and the opponent's sums.

    One aggregate reads the plays; what follows works on its rows, a few for each contest.
    """
    return sides_of_sums(side_sums(plays, ["game_id", "pos", *FIRST]))


def sides_of_sums(per: DataFrame) -> DataFrame:
    """The same from sums of plays (``side_sums``); a side's plays may be spread over several rows."""
    per = per.withColumnRenamed("pos", "with_ball")
    whole = Window.partitionBy("game_id")
    per = per.select("game_id", "with_ball", *[F.min_by(c, "first").over(whole).alias(c) for c in FIRST], "home_points", "away_points", "periods", "tempo", *SUMS)
    of = lambda side, c: F.coalesce(F.sum(F.when(F.col("with_ball") == F.col(side), F.col(c))), F.lit(0)).alias(f"{side}_{c}")
    games = per.groupBy("game_id", *FIRST).agg(
        F.max("home_points").alias("home_points"), F.max("away_points").alias("away_points"), F.max("periods").alias("periods"), F.sum("tempo").alias("tempo"),
        *[of(side, c) for side in ("home", "away") for c in SUMS],
    ).where("periods >= 4")

    def seen(side: str, other: str) -> Column:
        pairs = {"team": side, "opponent": other, "points": f"{side}_points", "opp_points": f"{other}_points", "conf": f"{side}_conf", "opp_conf": f"{other}_conf", "div": f"{side}_div", "opp_div": f"{other}_div"}
        pairs |= {c: f"{side}_{c}" for c in SUMS} | {f"opp_{c}": f"{other}_{c}" for c in SUMS}
        return F.struct(*[F.col(c).alias(k) for k, c in pairs.items()], F.lit(side == "home").alias("is_home"))

    two = games.select("game_id", "season", "slate", "home", "away", "tempo", F.explode(F.array(seen("home", "away"), seen("away", "home"))).alias("s"))
    two = two.select("game_id", "season", "slate", "home", "away", "tempo", "s.*")
    return two.select(
        "game_id", "season", "slate", "home", "away", "team", "opponent", "conf", "opp_conf", "div", "opp_div", "is_home", "points", "opp_points",
        (F.col("points") - F.col("opp_points")).alias("margin"), F.col("tempo"), *SUMS, *[f"opp_{c}" for c in SUMS],
        (F.col("st_sum") - F.col("opp_st_sum")).alias("st"),
    )


def listed_games(two: DataFrame) -> DataFrame:
    return two.where("team = home")


def teams_of(two: DataFrame, div: str = "fbs") -> DataFrame:
    """Distinct teams of a division, seen on either side."""
    return two.where(F.col("div") == div).select("team").union(two.where(F.col("opp_div") == div).select("opponent")).distinct()


def conference_of(two: DataFrame) -> DataFrame:
    """Each team's most frequent conference; of equally frequent ones the first by name."""
    n = two.where(F.col("conf").isNotNull()).groupBy("team", "conf").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("team").orderBy(F.desc("n"), "conf")
    return n.withColumn("i", F.row_number().over(first)).where("i = 1").select("team", "conf")


def board(two: DataFrame, min_games: int = 8) -> DataFrame:
    """Season records with luck, offence and defence rates and a rank by point difference.

    Luck is the share of wins less the mean probability that the margins stand for.
    """
    luck = F.sum(portable_round(win_probability(F.col("margin"), 9.5), 6))
    out = two.groupBy("season", "team").agg(
        F.sum((F.col("margin") > 0).cast("int")).alias("wins"), F.sum((F.col("margin") < 0).cast("int")).alias("losses"), F.countDistinct("game_id").alias("games"),
        F.sum("margin").alias("margin_sum"), F.sum("off_sum").alias("o"), F.sum("off_n").alias("on_"), F.sum("opp_off_sum").alias("d"), F.sum("opp_off_n").alias("dn"),
        F.sum("st").alias("st_sum"), F.sum("tempo").alias("tempo_sum"), luck.alias("luck_sum"),
    ).where(F.col("games") >= min_games)
    order = Window.partitionBy("season").orderBy(F.desc(F.col("margin_sum") / F.col("games")), "team")
    return out.select(
        "season", "team", "wins", "losses", "games", portable_round(ratio(F.col("o"), F.col("on_"))).alias("off_epa"), portable_round(ratio(F.col("d"), F.col("dn"))).alias("def_epa"),
        portable_round(ratio(F.col("st_sum"), F.col("games"))).alias("st_epa"), portable_round(ratio(F.col("tempo_sum"), F.col("games"))).alias("tempo"),
        portable_round((F.col("wins") - F.col("luck_sum")) / F.col("games"), 3).alias("luck"), F.row_number().over(order).alias("rank"),
    )


def rated_board(two: DataFrame, book: DataFrame, min_games: int = 8) -> DataFrame:
    """Season records with luck, adjusted values and the mean rating of the opponents faced (an unknown one is eight under the mean), ranked."""
    final = book.where("cutoff = 99").select(F.col("season").alias("bs"), F.col("team").alias("bt"), F.floor(F.col("pom") + 0.500001).alias("whole"), "pom", "adjo", "adjd", F.col("tempo").alias("pace"))
    expected = F.floor(win_probability(F.col("margin"), 9.5) * 1_000_000 + 0.500001)
    met = two.join(final.select(F.col("bs").alias("os"), F.col("bt").alias("ot"), F.col("whole").alias("opp")).hint("merge"), F.expr("season = os and opponent = ot"), "left")
    rec = met.groupBy("season", "team").agg(
        F.sum((F.col("margin") > 0).cast("int")).alias("wins"), F.sum((F.col("margin") < 0).cast("int")).alias("losses"), F.count(F.lit(1)).alias("played"),
        F.sum(expected).alias("e"), F.sum(F.coalesce("opp", F.lit(-800))).alias("o"),
    )
    out = rec.where(F.col("played") >= min_games).join(final.hint("merge"), F.expr("season = bs and team = bt"))
    part = lambda c, k=100.0: portable_round(F.col(c) / k, 2).alias(c)
    return out.select(
        "season", "team", "wins", "losses", "played", part("pom"), part("adjo"), part("adjd"), portable_round(F.col("pace") / 2, 2).alias("tempo"),
        portable_round((F.col("wins") - F.col("e") / 1_000_000) / F.col("played"), 3).alias("luck"), portable_round(F.col("o") / (F.col("played") * 100.0), 2).alias("sos"),
        F.row_number().over(Window.partitionBy("season").orderBy(F.desc("whole"), "team")).alias("rank"),
    )


def strength_of_schedule(two: DataFrame, ratings: DataFrame, unknown: float = -8.0) -> DataFrame:
    """Mean rating (``team``, ``season``, ``rating`` in hundredths) of the opponents faced."""
    r = ratings.select(F.col("team").alias("o"), F.col("season").alias("s"), "rating")
    met = two.join(r.hint("merge"), (F.col("opponent") == F.col("o")) & (F.col("season") == F.col("s")), "left")
    return met.groupBy("season", "team").agg(portable_round(F.sum(F.coalesce("rating", F.lit(int(unknown * 100)))) / 100.0 / F.count(F.lit(1))).alias("sos"))


def conference_record(two: DataFrame) -> DataFrame:
    """Records inside the conference and of the whole conference."""
    inside = two.where(F.col("conf") == F.col("opp_conf"))
    mine = inside.groupBy("season", "conf", "team").agg(F.sum((F.col("margin") > 0).cast("int")).alias("conf_wins"), F.sum((F.col("margin") < 0).cast("int")).alias("conf_losses"))
    order = Window.partitionBy("season", "conf").orderBy(F.desc("conf_wins"), "conf_losses", "team")
    return mine.withColumn("place", F.row_number().over(order))


def schedule(two: DataFrame, team: str) -> DataFrame:
    """One team's contests from its own side."""
    return two.where(F.col("team") == team).select(
        "season", "slate", "game_id", "opponent", F.when(F.col("is_home"), "home").otherwise("away").alias("venue"), "margin",
        F.when(F.col("margin") > 0, "W").when(F.col("margin") < 0, "L").otherwise("T").alias("result"),
    )
