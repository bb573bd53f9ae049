"""What one contest says about pace, kicking, passers, quarters and players."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.scalars import portable_round, ratio
from fieldbook.operators.sides import scrimmage


def gaps(plays: DataFrame, least: int, most: int) -> DataFrame:
    """Wall seconds between a team's consecutive snaps in a period, kept within bounds: sums and counts.

    The lag is taken after the filter, so a play that isn't a snap doesn't part two snaps.
    """
    w = Window.partitionBy("game_id").orderBy("game_play_number")
    snaps = plays.where(scrimmage(plays)).withColumns({
        "gap": F.col("wall") - F.lag("wall").over(w), "same": (F.lag("pos").over(w) == F.col("pos")) & (F.lag("period").over(w) == F.col("period")),
    })
    use = F.col("same") & F.col("gap").between(least, most)
    return snaps.groupBy("game_id", F.col("pos").alias("team")).agg(
        F.coalesce(F.sum(F.when(use, F.col("gap"))), F.lit(0)).alias("gap_sum"), F.sum(F.coalesce(use, F.lit(False)).cast("int")).alias("gap_n")
    )


def side_snaps(plays: DataFrame, wall: tuple[int, int] = (0, 20_000_000), clock: tuple[int, int] = (1, 400)) -> DataFrame:
    """For each contest and team with the ball: seconds between snaps by the wall and by the clock, kicks with their expected makes, punts and plays.

    Wall gaps need the same team and period, clock gaps the same period. A chance over 1 is a percentage; expected makes are in hundredths.
    """
    w = Window.partitionBy("game_id").orderBy("game_play_number")
    same, period = F.lag("pos").over(w) == F.col("pos"), F.lag("period").over(w) == F.col("period")
    snaps = plays.where(scrimmage(plays)).select("game_id", "pos", (F.col("wall") - F.lag("wall").over(w)).alias("gap"), (F.lag("clock").over(w) - F.col("clock")).alias("tick"), same.alias("same"), period.alias("samep"))
    use = F.coalesce(F.col("same") & F.col("samep") & F.col("gap").between(*wall), F.lit(False))
    run = F.coalesce(F.col("samep") & F.col("tick").between(*clock), F.lit(False))
    pick = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    gaps_ = snaps.groupBy("game_id", F.col("pos").alias("team")).agg(pick(use, F.col("gap")).alias("gap_sum"), pick(use, 1).alias("gap_n"), pick(run, F.col("tick")).alias("clock_sum"), pick(run, 1).alias("clock_n"))
    chance = F.when(F.col("fg_chance") > 1, F.col("fg_chance")).otherwise(F.col("fg_chance") * 100)
    kick = F.col("pos_unit") == "Special"
    out = plays.groupBy("game_id", F.col("pos").alias("team")).agg(*_kick_sums(plays), pick(kick & (F.col("points") > 0), chance).alias("fg_exp"))
    out = out.where("game_id is not null and team is not null").join(gaps_.hint("merge"), ["game_id", "team"], "left")
    return out.fillna(0, ["gap_sum", "gap_n", "clock_sum", "clock_n"])


def takeaways(plays: DataFrame) -> DataFrame:
    """Giveaways by the offence are takeaways of the defence."""
    lost = plays.groupBy("game_id", "pos", "def").agg(F.sum(F.col("turnover").cast("int")).alias("n"))
    own = lost.select("game_id", F.col("pos").alias("team"), F.col("n").alias("giveaways"), F.lit(0).cast("long").alias("takeaways"))
    other = lost.select("game_id", F.col("def").alias("team"), F.lit(0).cast("long").alias("giveaways"), F.col("n").alias("takeaways"))
    return own.unionByName(other).groupBy("game_id", "team").agg(F.sum("giveaways").alias("giveaways"), F.sum("takeaways").alias("takeaways"))


def _kick_sums(plays: DataFrame) -> list[Column]:
    kick = F.col("pos_unit") == "Special"
    made = kick & (F.col("points") == 3)
    return [
        F.sum((kick & (F.col("points") > 0)).cast("int")).alias("fg_att"), F.sum(made.cast("int")).alias("fg_made"),
        F.coalesce(F.sum(F.when(made, F.col("yards"))), F.lit(0)).alias("fg_yds"), F.sum((kick & (F.col("points") == 0)).cast("int")).alias("punt_n"),
        F.coalesce(F.sum(F.when(kick & (F.col("points") == 0), F.col("yards"))), F.lit(0)).alias("punt_yds"), F.sum(scrimmage(plays).cast("int")).alias("plays"),
    ]


def kicks(plays: DataFrame) -> DataFrame:
    """Special-teams plays as kicks: attempts, those that scored, their distance, and punts."""
    return plays.groupBy("game_id", F.col("pos").alias("team")).agg(*_kick_sums(plays))


def modal_passers(plays: DataFrame) -> DataFrame:
    """The most frequent passer of each side with his sums; of equally frequent ones the first by name."""
    n = plays.where(F.col("pass") & scrimmage(plays)).groupBy("game_id", F.col("pos").alias("team"), F.lower(F.trim("player")).alias("passer")).agg(
        F.count(F.lit(1)).alias("epa_cnt"), F.sum("epa").alias("epa_sum")
    )
    w = Window.partitionBy("game_id", "team").orderBy(F.desc("epa_cnt"), "passer")
    return n.withColumn("i", F.row_number().over(w)).where("i = 1").drop("i")


def quarter_points(plays: DataFrame) -> DataFrame:
    """Points of each period, from the scores at its end; contests with a missing or negative one go."""
    ends = plays.groupBy("game_id", "period").agg(F.max_by("home_score", "game_play_number").alias("h"), F.max_by("away_score", "game_play_number").alias("a"))
    wide = ends.groupBy("game_id").pivot("period", [1, 2, 3, 4]).agg(F.first("h").alias("h"), F.first("a").alias("a"))
    cols = {"q1_home": F.col("1_h"), "q1_away": F.col("1_a")}
    for q in (2, 3, 4):
        cols |= {f"q{q}_{s}": F.col(f"{q}_{s[0]}") - F.col(f"{q - 1}_{s[0]}") for s in ("home", "away")}
    out = wide.select("game_id", *[c.alias(n) for n, c in cols.items()])
    return out.where(F.least(*cols) >= 0).dropna()


def leaders(plays: DataFrame, minimum: int = 3, limit: int = 60) -> DataFrame:
    """Rushing and receiving boards: sums, rates and ranks; a player needs ``minimum`` attempts."""
    kinds = F.when(F.col("rush"), "rush").when(F.col("pass"), "receive")
    n = plays.where(F.col("pos_unit") == "Offense").groupBy("season", kinds.alias("board"), "player", F.col("pos").alias("team")).agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("yards").alias("yards"), F.sum((F.col("points") == 7).cast("int")).alias("scores")
    ).where(F.col("attempts") >= minimum)
    w = Window.partitionBy("season", "board").orderBy(F.desc("yards"), F.desc("attempts"), "player", "team")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).withColumn("average", portable_round(ratio(F.col("yards"), F.col("attempts"))))


def passing_board(plays: DataFrame, minimum: int = 3, limit: int = 60) -> DataFrame:
    """Passers by yards: attempts, completions (of ten yards or more), yards per attempt and rank."""
    n = plays.where(F.col("pass") & scrimmage(plays)).groupBy("season", "player", F.col("pos").alias("team")).agg(
        F.count(F.lit(1)).alias("attempts"), F.sum((F.col("yards") >= 10).cast("int")).alias("completions"), F.sum("yards").alias("yards"), F.sum("epa").alias("epa"),
    ).where(F.col("attempts") >= minimum)
    w = Window.partitionBy("season").orderBy(F.desc("yards"), F.desc("attempts"), "player", "team")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).withColumn("per_attempt", portable_round(ratio(F.col("yards"), F.col("attempts"))))


def quarter_bundles(quarters: DataFrame) -> DataFrame:
    """Training rows made of quarter combinations, scaled to a whole contest; ties go. The real row comes first."""
    sets = [(q,) for q in range(1, 5)] + [(1, 2), (3, 4), (1, 3), (2, 4), (1, 2, 3), (2, 3, 4)]
    combos = [F.struct(F.lit("".join(map(str, s))).alias("quarters"), F.lit(4.0 / len(s)).alias("scale"),
                       sum((F.col(f"q{q}_home") for q in s), F.lit(0)).alias("home"), sum((F.col(f"q{q}_away") for q in s), F.lit(0)).alias("away")) for s in [(1, 2, 3, 4), *sets]]
    rows = quarters.select("game_id", F.explode(F.array(*combos)).alias("c")).select("game_id", "c.*")
    return rows.where("home <> away").select(
        "game_id", "quarters", (F.col("quarters") == "1234").alias("real"), F.col("scale"), ((F.col("home") - F.col("away")) * F.col("scale")).alias("margin"), (F.col("home") > F.col("away")).cast("int").alias("won"),
    )


def newest_bundles(bundles: DataFrame, cap: int, per_block: int = 10_000) -> DataFrame:
    """Whole bundles, newest contests first, until ``cap`` rows are reached; none is split.

    Rows are counted by blocks of contest numbers first (a block of ``per_block`` numbers is a month), so no task orders all contests.
    """
    n = bundles.groupBy("game_id").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("game_id") / per_block))
    newer = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = n.groupBy(F.col("block").alias("b")).agg(F.sum("n").alias("rows")).select("b", F.coalesce(F.sum("rows").over(newer), F.lit(0)).alias("before"))
    upto = Window.partitionBy("block").orderBy(F.desc("game_id")).rowsBetween(Window.unboundedPreceding, 0)
    keep = n.join(blocks.hint("merge"), F.col("block") == F.col("b")).withColumn("total", F.col("before") + F.sum("n").over(upto)).where(F.col("total") <= cap).select("game_id")
    return bundles.join(keep.hint("merge"), "game_id", "left_semi")
