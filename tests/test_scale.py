"""Plans that must not change their kind as tables grow, and the results of the steps in them."""

import shutil

from fieldbook.operators import sides as S
from fieldbook.operators import snaps as N
from fieldbook.plans.contest_queries import live_plays, live_sides, plays_of, sides_of
from fieldbook.plans.form_queries import QUERIES as FORM
from fieldbook.plans.model_queries import QUERIES as MODEL
from fieldbook.sources.contests import contest_plays, numbered_plays
from fieldbook.sources.store import is_stored

ROOT = "/root/testdata/sf0.001"
PLAY = "game_id long, game_play_number int, season int, slate int, home string, away string, home_conf string, away_conf string, home_div string, away_div string, pos string, home_score int, away_score int, period int, pos_unit string, epa int, pos_margin int, turnover boolean, rush boolean, yards int"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plays_meet_by_the_same_joins_at_any_size(spark):
    plan = _plan(contest_plays(spark, ROOT).select("game_id", "home_score", "clock", "home", "pos_unit"))
    assert plan.count("SortMergeJoin") == 2  # orders and customers grow with the line items, so they are never sent whole
    to_contests = plan[plan.index("Window") :]
    assert "clock" not in to_contests and "home_k#" not in to_contests.split("\n", 1)[1]  # derived again after the shuffle


def test_ratings_and_predictions_write_no_plays(spark, tmp_path):
    shutil.copytree(ROOT, d := f"{tmp_path}/d")
    FORM["r5_colley"](spark, d).collect()
    assert is_stored(spark, d, "sides") and not is_stored(spark, d, "plays")
    MODEL["m20_blend_weights"](spark, d).collect()
    assert not is_stored(spark, d, "plays")
    straight = sides_of(spark, d)
    through = S.sides(plays_of(spark, d))
    assert is_stored(spark, d, "plays") and straight.count() == through.count() > 0
    assert straight.select(*through.columns).exceptAll(through).count() == through.exceptAll(straight.select(*through.columns)).count() == 0


def test_sides_move_only_what_they_are_made_of(spark):
    plan = _plan(S.sides(live_plays(spark, ROOT)))
    assert not any(f"{c}#" in plan for c in ("c_name", "l_shipdate", "player", "wall"))
    assert "Sort [game_id#" in plan and "Sort [season#" not in plan  # a season as the first key would tell few rows apart


def test_only_sums_of_plays_get_names(spark):
    plan = _plan(live_sides(spark, ROOT))
    above, below = plan[: (k := plan.index("Window [row_number()"))], plan[k:]
    assert above.count("BroadcastHashJoin") == 4 and above.rindex("HashAggregate(") > above.rindex("BroadcastHashJoin")  # a row for each contest and side meets the nations
    to_contests = below[below.index("Exchange hashpartitioning(game_id") :].split("\n", 2)[1]
    assert all(f"{c}#" not in to_contests for c in ("season", "slate", "points", "_w0", "l_quantity"))  # derived again after the shuffle


def test_plays_are_nearly_in_order_before_they_are_compared(spark):
    plan = _plan(numbered_plays(spark, ROOT))
    assert "Sort [(shiftleft(game_id#" in plan[plan.index("Sort [game_id#") :]


def test_sides_read_plays_once(spark, tmp_path):
    spark.createDataFrame([], PLAY).write.parquet(f"{tmp_path}/p")
    plan = _plan(S.sides(spark.read.parquet(f"{tmp_path}/p")))
    assert plan.count("FileScan") == 1 and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


def test_snaps_read_plays_twice(spark, tmp_path):
    more = f"{PLAY}, wall long, clock int, points int, fg_chance int"
    spark.createDataFrame([], more).write.parquet(f"{tmp_path}/p")
    assert _plan(N.side_snaps(spark.read.parquet(f"{tmp_path}/p"))).count("FileScan") == 2  # once for the kicks, once for the gaps
    row = (1, 1, 2000, 1, "A", "B", "x", "y", "fbs", "fcs", "A", 0, 0, 1, "Special", 5, 0, False, True, 40, 100, 10)
    rows = [(*row, 3, 60), (None, *row[1:], 3, 60)]  # a play without a contest counts nowhere
    out = N.side_snaps(spark.createDataFrame(rows, more)).collect()
    assert [(r.game_id, r.team, r.fg_att, r.fg_made, r.fg_yds, r.fg_exp, r.punt_n, r.plays, r.gap_n) for r in out] == [(1, "A", 1, 1, 40, 60, 0, 0, 0)]


def test_sides_follow_the_first_play(spark):
    def play(g, n, pos, home="A", away="B", conf="x", score=(0, 0), period=1, unit="Offense", epa=10, turnover=False, rush=True, yards=3):
        return (g, n, 2000, 1, home, away, conf, "y", "fbs", "fcs", pos, *score, period, unit, epa, 0, turnover, rush, yards)

    rows = [
        play(1, 2, "A", conf="later", epa=20), play(1, 1, "B", score=(0, 3), turnover=True), play(1, 3, "A", home="C", score=(7, 3), period=4, epa=None),
        play(1, 4, "A", unit="Special", epa=-5, period=4), play(1, 5, "E", epa=90), play(2, 1, "A", period=3), play(3, 1, "B", period=4, epa=None, rush=None),
    ]
    out = {(r.game_id, r.team): r for r in S.sides(spark.createDataFrame(rows, PLAY)).collect()}
    assert set(out) == {(1, "A"), (1, "B"), (3, "A"), (3, "B")}  # contest 2 is short of four periods
    a, b = out[1, "A"], out[1, "B"]
    assert (a.opponent, a.conf, a.opp_conf, a.is_home, a.points, a.opp_points, a.margin, a.tempo) == ("B", "x", "y", True, 7, 3, 4, 3)
    assert (a.off_sum, a.off_n, a.st_sum, a.giveaways, a.rush_yds, a.rush_n, a.st) == (20, 1, -5, 0, 6, 2, -5)
    assert (b.off_sum, b.off_n, b.opp_off_sum, b.opp_off_n, b.giveaways, b.opp_giveaways, b.margin, b.is_home, b.st) == (10, 1, 20, 1, 1, 0, -4, False, 5)
    assert (out[3, "A"].off_n, out[3, "B"].off_n, out[3, "B"].rush_n) == (0, 0, 0)
    games = {r.game_id: r for r in S.final_scores(spark.createDataFrame(rows, PLAY)).collect()}
    assert set(games) == {1, 3} and (games[1].home, games[1].home_conf, games[1].home_points, games[1].away_points, games[1].tempo) == ("A", "x", 7, 3, 3)
