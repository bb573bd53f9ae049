"""All that is known of a side before a slate, in one row, and the menus of features made from it.

Contests of one slate never see each other: sums and lists are taken for each slate first and then over earlier slates of the
season. Sums of numbers that aren't whole are kept in whole millionths, so that they don't depend on the order of adding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.scalars import portable_round, ratio, signed_log, win_probability
from fieldbook.operators.sides import listed_games

POWER = ("AMERICA", "EUROPE")
SNAPS = ("gap_sum", "gap_n", "clock_sum", "clock_n", "fg_att", "fg_made", "fg_yds", "fg_exp", "punt_n", "punt_yds", "plays")


def rows(two: DataFrame, before: DataFrame, walk: DataFrame, snaps: DataFrame) -> DataFrame:
    """Sides with ``won`` (a tie is the away side's), the opponent's rating at the time, the own Elo before the contest, and the snaps."""
    opp = before.select(F.col("season").alias("rs"), F.col("slate").alias("rl"), F.col("team").alias("rt"), F.col("rating").alias("opp_rating"))
    out = two.join(opp.hint("merge"), (F.col("season") == F.col("rs")) & (F.col("slate") == F.col("rl")) & (F.col("opponent") == F.col("rt"))).drop("rs", "rl", "rt")
    elo = walk.select(F.col("game_id").alias("eg"), "home_before", "away_before")
    out = out.join(elo.hint("merge"), F.col("game_id") == F.col("eg")).withColumn("elo_b", F.when(F.col("is_home"), F.col("home_before")).otherwise(F.col("away_before")))
    s = snaps.select(F.col("game_id").alias("sg"), F.col("team").alias("st_"), *SNAPS)
    out = out.join(s.hint("merge"), (F.col("game_id") == F.col("sg")) & (F.col("team") == F.col("st_")), "left").drop("eg", "home_before", "away_before", "sg", "st_")
    won = (F.col("margin") > 0) | ((F.col("margin") == 0) & ~F.col("is_home"))
    return out.withColumn("won", won.cast("int")).withColumn("same_conf", F.coalesce(F.col("conf") == F.col("opp_conf"), F.lit(False)))


def _sums() -> dict[str, Column]:
    won, margin, rating, same = F.col("won"), F.col("margin"), F.col("opp_rating"), F.col("same_conf")
    only = lambda c, x: F.when(c, x).otherwise(0)
    micro = lambda x: F.floor(x * 1_000_000 + 0.500001)
    tier = F.when(rating > 1000, 24).when(rating > 0, 16).when(rating > -1500, 8).otherwise(1)
    close, late = F.abs(margin) <= 8, F.col("slate") >= 8
    return {
        "games": F.lit(1), "wins": won, "margin_sum": margin, "pf": F.col("points"), "pa": F.col("opp_points"), "home_n": F.col("is_home").cast("int"), "home_margin": only(F.col("is_home"), margin),
        "away_margin": only(~F.col("is_home"), margin), "close_n": only(close, 1), "close_wins": only(close, won), "margin_sq": margin * margin, "late_n": only(late, 1), "late_wins": only(late, won),
        "conf_n": only(same, 1), "conf_wins": only(same, won), "conf_m": only(same, margin), "give": F.col("giveaways"), "take": F.col("opp_giveaways"), "ryds": F.col("rush_yds"), "rn": F.col("rush_n"),
        "expected": micro(win_probability(margin, 9.5)), "logm": micro(signed_log(margin)), "opp": rating, "res": margin * 100 - rating, "q_n": only(rating > 0, 1), "q_wins": only(rating > 0, won),
        "nc": only(~same, rating), "tiers": won * tier, **{c: F.coalesce(F.col(c), F.lit(0)) for c in SNAPS}, "snap_games": F.col("plays").isNotNull().cast("int"),
    }


def before_slate(rows: DataFrame, before: DataFrame) -> DataFrame:
    """The wide row of every season, slate and team."""
    sums = _sums()
    item = F.struct("game_id", "margin", "won", "points", "opp_points", (F.col("margin") * 100 - F.col("opp_rating")).alias("res"), "elo_b")
    by = rows.groupBy("season", "slate", "team").agg(*[F.sum(c).alias(k) for k, c in sums.items()], F.sort_array(F.collect_list(item)).alias("now"), F.min_by("elo_b", "game_id").alias("elo"))
    w = Window.partitionBy("season", "team").orderBy("slate").rowsBetween(Window.unboundedPreceding, -1)
    c = by.select("season", "slate", "team", "elo", F.max("slate").over(w).alias("last_slate"), *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in sums], F.flatten(F.collect_list("now").over(w)).alias("h"))
    c = c.withColumn("m", F.transform("h", lambda x: x["margin"]))
    f = lambda a, b, d=0.0, k=1.0: portable_round(ratio(F.col(a), F.col(b) * k if k != 1.0 else F.col(b), d))
    g = F.col("games")
    tail = lambda x, k: F.expr(f"transform(slice(h, greatest(games - {k} + 1, 1), {k}), x -> x.{x})")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    mean = lambda x, k, d=0.0: portable_round(ratio(total(tail(x, k)), F.least(g, F.lit(k)), d))
    median = F.expr("case when games = 0 then 0.0 when games % 2 = 1 then double(get(array_sort(m), cast(games div 2 as int))) else (get(array_sort(m), cast(games div 2 - 1 as int)) + get(array_sort(m), cast(games div 2 as int))) / 2.0 end")
    cut = F.when(g >= 5, F.greatest(F.floor(g / 10), F.lit(1))).otherwise(0).cast("int")
    kept = F.slice(F.array_sort("m"), cut + 1, F.greatest(g.cast("int") - 2 * cut, F.lit(0)))
    var = g * F.col("margin_sq") - F.col("margin_sum") * F.col("margin_sum")
    pf, pa = F.col("pf"), F.col("pa")
    out_n = g - F.col("conf_n")
    start = F.expr("get(h, cast(greatest(games - 4, 0) as int)).elo_b")
    wide = c.select(
        "season", "slate", "team", "games", f("wins", "games", 0.5).alias("winpct"), f("margin_sum", "games").alias("avg_margin"), f("pf", "games").alias("avg_pf"), f("pa", "games").alias("avg_pa"),
        portable_round(F.when(g > 0, pf * pf / (pf * pf + pa * pa + 1e-9)).otherwise(0.5)).alias("pythag"), f("home_margin", "home_n").alias("home_venue"), portable_round(ratio(F.col("away_margin"), g - F.col("home_n"))).alias("away_venue"),
        f("close_wins", "close_n", 0.5).alias("close_winpct"), f("late_wins", "late_n", 0.5).alias("late_winpct"), f("conf_wins", "conf_n", 0.5).alias("conf_winpct"), f("conf_m", "conf_n").alias("conf_margin"),
        portable_round(ratio(F.col("wins") - F.col("conf_wins"), out_n, 0.5)).alias("out_winpct"), portable_round(ratio(F.col("margin_sum") - F.col("conf_m"), out_n)).alias("out_margin"),
        portable_round(F.when(g >= 2, F.sqrt(var.cast("double")) / g).otherwise(0.0), 3).alias("margin_std"), (F.col("slate") - F.coalesce("last_slate", "slate")).alias("rest"),
        portable_round(F.when(g > 0, (F.col("wins") - F.col("expected") / 1_000_000) / g).otherwise(0.0)).alias("luck"), f("logm", "games", k=1_000_000.0).alias("log_margin"),
        f("opp", "games", k=100.0).alias("sos"), f("res", "games", k=100.0).alias("residual"), f("q_wins", "q_n", 0.5).alias("quality_winpct"), portable_round(ratio(F.col("nc"), out_n * 100.0)).alias("ncsos"), (F.col("tiers") / 4.0).alias("tier_wins"),
        portable_round(ratio(F.col("take") - F.col("give"), g)).alias("turnover_margin"), f("ryds", "rn").alias("yards_per_carry"), f("gap_sum", "gap_n").alias("snap_seconds"), f("clock_sum", "clock_n").alias("clock_seconds"),
        f("fg_yds", "fg_made").alias("fg_distance"), portable_round(ratio(F.col("fg_made") * 100 - F.col("fg_exp"), F.col("fg_att") * 100.0)).alias("fg_residual"), portable_round(ratio(F.col("punt_n"), F.col("punt_n") + F.col("plays"))).alias("punt_rate"),
        f("punt_yds", "punt_n").alias("punt_yards"), f("plays", "snap_games").alias("plays_pg"), mean("won", 4, 0.5).alias("form4_win"), mean("won", 10, 0.5).alias("form10_win"), mean("margin", 2).alias("form2_margin"), mean("margin", 4).alias("form4_margin"),
        mean("margin", 8).alias("form8_margin"), mean("points", 4).alias("form4_pf"), mean("opp_points", 4).alias("form4_pa"), portable_round(ratio(total(tail("res", 4)), F.least(g, F.lit(4)) * 100.0)).alias("form4_residual"), median.alias("median_margin"),
        portable_round(F.aggregate("m", F.lit(0.0), lambda v, x: v * 0.45 + x * 0.55), 3).alias("ewma_margin"),
        F.expr("aggregate(h, 0, (s, x) -> case when x.won = 1 then case when s > 0 then s + 1 else 1 end else case when s < 0 then s - 1 else -1 end end)").alias("streak"),
        portable_round(ratio(total(kept), F.size(kept))).alias("trimmed_margin"), portable_round(F.when(g >= 2, total(tail("margin", 4)) / F.least(g, F.lit(4)) - F.col("margin_sum") / g).otherwise(0.0)).alias("momentum"),
        portable_round("elo", 3).alias("elo"), portable_round(F.when(g > 0, F.col("elo") - start).otherwise(0.0), 3).alias("elo_momentum"), portable_round(F.when(g > 0, (F.col("elo") - F.get("h", F.lit(0))["elo_b"]) / g).otherwise(0.0), 3).alias("elo_slope"),
    )
    mine = before.select("season", "slate", "team", (F.col("rating") / 100.0).alias("pom"), *[portable_round(F.col(x) / 100.0).alias(x) for x in ("adjo", "adjd", "adjst")], portable_round("tempo_pg").alias("tempo_pg"), "rated_games")
    return wide.join(mine.hint("merge"), ["season", "slate", "team"])


def last_known(values: DataFrame, two: DataFrame, value: str) -> DataFrame:
    """For each conference and slate the mean of its teams' last known ``value``, the slate's own included; teams of earlier seasons still count.

    A team's value stays known until its next one, so a change adds the difference to the running sum of its conference.
    """
    conf = two.select("season", "slate", "team", "conf").distinct()
    r = values.join(conf.hint("merge"), ["season", "slate", "team"]).withColumn("sl", F.col("season") * 100 + F.col("slate"))
    mine = Window.partitionBy("team").orderBy("sl")
    scaled = F.floor(F.col(value) * 1000 + 0.500001).cast("long")
    d = r.withColumn("v", scaled).withColumns({"move": F.col("v") - F.coalesce(F.lag("v").over(mine), F.lit(0)), "new": F.lag("v").over(mine).isNull().cast("int")})
    per = d.groupBy("conf", "season", "slate", "sl").agg(F.sum("move").alias("move"), F.sum("new").alias("new"))
    upto = Window.partitionBy("conf").orderBy("sl").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("conf", "season", "slate", portable_round(F.sum("move").over(upto) / (F.sum("new").over(upto) * 1000.0)).alias(f"conf_{value}"))


def starters(passers: DataFrame, two: DataFrame) -> DataFrame:
    """Before each slate: the expected passer (the last contest's, else last season's most frequent) and what he has done.

    ``starter_epa`` is for this team this season, ``starter_change`` is 0 only if he was last season's, ``starter_log`` the logarithm of one more than his starts,
    and ``starter_last`` his rate for any team in the last earlier season in which he played.
    """
    slates = two.select("season", "slate", "team").distinct()
    p = passers.join(two.select("game_id", "season", "slate", "team").hint("merge"), ["game_id", "team"])
    modal = p.groupBy("season", "team", "passer").agg(F.count(F.lit(1)).alias("n"), F.min("game_id").alias("first"))
    modal = modal.groupBy("season", "team").agg(F.min_by("passer", F.struct(-F.col("n"), "first")).alias("modal"))
    every = Window.partitionBy("team").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    known = slates.select("season", "team").distinct().join(modal.hint("merge"), ["season", "team"], "left").withColumn("last_modal", F.last("modal", ignorenulls=True).over(every)).drop("modal")
    w = Window.partitionBy("season", "team").orderBy("slate").rowsBetween(Window.unboundedPreceding, -1)
    recent = p.groupBy("season", "slate", "team").agg(F.max_by("passer", "game_id").alias("passer"))
    s = slates.join(recent.hint("merge"), ["season", "slate", "team"], "left").withColumn("recent", F.last("passer", ignorenulls=True).over(w)).drop("passer")
    s = s.join(known.hint("merge"), ["season", "team"]).withColumn("starter", F.coalesce("recent", "last_modal"))
    did = p.groupBy("season", "team", F.col("passer").alias("starter"), F.col("slate").alias("ds")).agg(F.sum("epa_sum").alias("s"), F.sum("epa_cnt").alias("n"), F.count(F.lit(1)).alias("g"))
    now = s.select("season", "slate", "team", "starter").join(did.hint("merge"), ["season", "team", "starter"]).where("ds < slate").groupBy("season", "slate", "team").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("g").alias("g"))
    any_ = p.groupBy("passer", "season").agg((F.sum("epa_sum") / F.sum("epa_cnt")).alias("rate"))
    next_ = any_.select(F.col("passer").alias("lp"), "rate", F.col("season").alias("ls"), F.lead("season", 1, 9999).over(Window.partitionBy("passer").orderBy("season")).alias("until"))
    out = s.join(now.hint("merge"), ["season", "slate", "team"], "left").join(next_.hint("merge"), F.expr("starter = lp and ls < season and season <= until"), "left")
    some = F.col("starter").isNotNull()
    return out.select(
        "season", "slate", "team", "starter", portable_round(ratio(F.coalesce("s", F.lit(0)), F.coalesce("n", F.lit(0)))).alias("starter_epa"),
        F.when(~some, 0.0).when(F.col("last_modal") == F.col("starter"), 0.0).otherwise(1.0).alias("starter_change"), portable_round(F.log1p(F.coalesce("g", F.lit(0)))).alias("starter_log"), portable_round(F.coalesce("rate", F.lit(0.0))).alias("starter_last"),
    )


def last_meeting(two: DataFrame) -> DataFrame:
    """Home's margin when the two last met in an earlier slate of any season, wherever that was (0)."""
    w = Window.partitionBy("team", "opponent").orderBy("sl").rangeBetween(Window.unboundedPreceding, -1)
    rows = two.withColumn("sl", F.col("season") * 100 + F.col("slate"))
    return rows.withColumn("h2h", F.coalesce(F.last("margin").over(w), F.lit(0))).where("is_home").select("game_id", "h2h")


#: The columns of each menu, as SQL over the rows ``h`` (home), ``a`` (away) and ``g`` (the contest).
_DIFF = lambda *names: {f"{n}_diff": f"h.{n} - a.{n}" for n in names}
_LOG = "sign(h.pom - a.pom) * ln(1.0 + abs(h.pom - a.pom))"
MENUS: dict[str, dict[str, str]] = {
    "locked": {"pom_diff": "h.pom - a.pom", "home_pom": "h.pom", "away_pom": "a.pom", **_DIFF("adjo", "adjd", "adjst", "tempo_pg"), "is_home": "1.0", "home_games": "h.rated_games * 1.0", "away_games": "a.rated_games * 1.0"},
    "extras": _DIFF("elo", "form4_win", "form4_margin", "winpct", "avg_margin", "close_winpct", "sos", "rest", "luck", "quality_winpct"),
    "signal": _DIFF("elo", "elo_momentum", "avg_margin", "median_margin", "form2_margin", "form4_margin", "form8_margin", "ewma_margin", "avg_pf", "avg_pa", "form4_pf", "form4_pa", "pythag")
    | {"venue_diff": "h.home_venue - a.away_venue"} | _DIFF("sos", "residual", "form4_residual") | {"h2h": "g.h2h * 1.0"},
    "craft": _DIFF("srs", "colley", "ncsos", "margin_std") | {
        "pom_sum": "h.pom + a.pom", "pom_abs": "abs(h.pom - a.pom)", "tempo_abs": "abs(h.tempo_pg - a.tempo_pg)", "log_pom": _LOG, "elo_tanh": "tanh((h.elo - a.elo) / 200.0)", "pom_elo": "(h.pom - a.pom) * (h.elo - a.elo) / 400.0",
        "form_sos": "(h.form4_margin - a.form4_margin) * (h.sos - a.sos) / 20.0", "srs_elo": "(h.srs - a.srs) * (h.elo - a.elo) / 400.0"},
    "loso": {"glm_diff": "h.glm - a.glm", "glm_sum": "h.glm + a.glm", "elo_ratio": "h.elo / a.elo - 1.0", **_DIFF("log_margin"), "conf_pom_diff": "h.conf_pom - a.conf_pom", **_DIFF("tier_wins", "form10_win"),
             "close_margin": "(h.close_winpct - a.close_winpct) * (h.avg_margin - a.avg_margin)", **_DIFF("late_winpct", "yoy_margin")},
    "conference": {"conf_pom_diff": "h.conf_pom - a.conf_pom", "conf_elo_diff": "h.conf_elo - a.conf_elo", "power_diff": "h.power - a.power", "same_conf": "g.same_conf * 1.0"} | _DIFF("conf_winpct", "conf_margin", "out_winpct", "out_margin"),
    "glm4": {"home_glm": "h.glm", "away_glm": "a.glm", "glm_diff": "h.glm - a.glm", "glm_sum": "h.glm + a.glm"},
    "time": {"season_no": "g.season - 2014.0", "week_share": "g.slate / 52.0"},
    "thin": {"thin": "case when least(h.games, a.games) < 3 then 1.0 else 0.0 end"},
    "pace": _DIFF("turnover_margin", "yards_per_carry", "snap_seconds", "clock_seconds"),
    "specials": _DIFF("momentum", "streak", "fg_distance", "fg_residual", "punt_rate", "punt_yards", "plays_pg"),
    "passer": _DIFF("starter_epa", "starter_change", "starter_log", "starter_last"),
}


def menu(games: DataFrame, wide: DataFrame, *names: str) -> DataFrame:
    """The union of the named menus, a row for each contest; a column stands once. ``games`` has what the menus ask of ``g``."""
    columns = {k: v for n in names for k, v in MENUS[n].items()}
    h = wide.alias("h").hint("merge")
    a = wide.alias("a").hint("merge")
    met = games.alias("g").join(h, F.expr("h.season = g.season and h.slate = g.slate and h.team = g.home")).join(a, F.expr("a.season = g.season and a.slate = g.slate and a.team = g.away"))
    return met.select("g.game_id", "g.season", "g.slate", *[portable_round(F.expr(v)).alias(k) for k, v in columns.items()])


def contests(two: DataFrame) -> DataFrame:
    """One row for each contest, with the last meeting and whether both sides are of one conference."""
    g = listed_games(two).select("game_id", "season", "slate", "home", "away", "margin", F.coalesce(F.col("conf") == F.col("opp_conf"), F.lit(False)).cast("int").alias("same_conf"), "conf", "opp_conf", "div", "opp_div")
    return g.join(last_meeting(two).hint("merge"), "game_id")
