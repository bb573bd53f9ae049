"""Queries over the contest model, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.operators import sides as S
from fieldbook.operators import snaps as N
from fieldbook.plans.contest_sql import PLAYS, SIDES, div, r
from fieldbook.sources.contests import contest_plays, named, numbered_plays, top_division_plays
from fieldbook.sources.store import is_stored, stored

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def live_plays(spark: SparkSession, d: str, by_season: bool = False) -> DataFrame:
    """Live plays of rated sides, straight from the given tables."""
    return S.live(_rated(contest_plays(spark, d, by_season)))


def _rated(df: DataFrame) -> DataFrame:
    return top_division_plays(df.withColumnsRenamed({"pos": "pos_team", "def": "def_pos_team"})).withColumnsRenamed({"pos_team": "pos", "def_pos_team": "def"})


def live_sides(spark: SparkSession, d: str) -> DataFrame:
    """Sides straight from the given tables: plays are added up under the numbers of their nations, and only the sums get names."""
    sums = S.side_sums(S.live(numbered_plays(spark, d)), ["game_id", "season", "slate", "pos_k", "def_k", "home_k", "away_k"])
    return S.sides_of_sums(_rated(named(sums, d)))


def plays_of(spark: SparkSession, d: str) -> DataFrame:
    """Plays in folders by season, written once a session."""
    return stored(spark, d, "plays", lambda: live_plays(spark, d, by_season=True), by="season")


def sides_of(spark: SparkSession, d: str) -> DataFrame:
    """Two rows for each contest, in folders by season, written once a session; most queries start here.

    They come from the stored plays where these are there, else straight from the given tables: a query that needs no plays writes none and
    moves only the columns that sides are made of. A query that needs both asks for its plays first.
    """
    return stored(spark, d, "sides", lambda: S.sides(plays_of(spark, d)) if is_stored(spark, d, "plays") else live_sides(spark, d), by="season")


@query("s1_plays_scan", f"WITH {PLAYS} SELECT season, period, pos_unit, count(*) AS n, sum(epa)::BIGINT AS epa, max(pm)::BIGINT AS top_margin, sum(num)::BIGINT AS order_sum FROM plays GROUP BY ALL")
def plays_scan(spark, d):
    return plays_of(spark, d).groupBy("season", "period", "pos_unit").agg(F.count(F.lit(1)).alias("n"), F.sum("epa").alias("epa"), F.max("pos_margin").alias("top_margin"), F.sum("game_play_number").alias("order_sum"))


@query("a1_final_scores", f"WITH {SIDES} SELECT game_id, season, slate, home, away, home_points, away_points, tempo FROM games")
def final_scores(spark, d):
    return S.final_scores(plays_of(spark, d)).select("game_id", "season", "slate", "home", "away", "home_points", "away_points", "tempo")


_SIDE = "game_id, season, slate, team, opponent, conf, opp_conf, is_home, points, opp_points, margin, tempo, off_sum, off_n, opp_off_sum, opp_off_n, st, giveaways, opp_giveaways, rush_yds, rush_n"


@query("u1_sides", f"WITH {SIDES} SELECT {_SIDE} FROM sides")
def sides_query(spark, d):
    return sides_of(spark, d).select(*_SIDE.split(", "))


@query("a5_a6_teams", f"""WITH {SIDES}, n AS (SELECT team, conf, count(*) AS n FROM sides GROUP BY ALL),
 c AS (SELECT team, conf FROM n QUALIFY row_number() OVER (PARTITION BY team ORDER BY n DESC, conf) = 1)
 SELECT team, conf, team IN (SELECT team FROM sides WHERE div = 'fbs') AS top FROM c""")
def teams(spark, d):
    two = sides_of(spark, d)
    top = S.teams_of(two).select(F.col("team").alias("t"))
    return S.conference_of(two).join(top, F.col("team") == F.col("t"), "left").select("team", "conf", F.col("t").isNotNull().alias("top"))


_LUCK = "floor((1.0 / (1.0 + exp(-margin / 9.5))) * 1000000.0 + 0.500001) / 1000000.0"


@query("a14_board", f"""WITH {SIDES}, b AS (SELECT season, team, count(*) FILTER (margin > 0) AS wins, count(*) FILTER (margin < 0) AS losses, count(DISTINCT game_id) AS games, sum(margin) AS ms,
  sum(off_sum) AS o, sum(off_n) AS n1, sum(opp_off_sum) AS d, sum(opp_off_n) AS n2, sum(st) AS st, sum(tempo) AS t, sum({_LUCK}) AS l FROM sides GROUP BY ALL)
 SELECT season, team, wins, losses, games, {div("o", "n1")} AS off_epa, {div("d", "n2")} AS def_epa, {div("st", "games")} AS st_epa, {div("t", "games")} AS tempo,
  {r("(wins - l) / games", 3)} AS luck, row_number() OVER (PARTITION BY season ORDER BY ms::DOUBLE / games DESC, team) AS rank FROM b WHERE games >= 8""")
def board(spark, d):
    return S.board(sides_of(spark, d))


@query("a16_schedule_strength", f"""WITH {SIDES}, m AS (SELECT season, team, floor(sum(margin) * 100 / count(*))::BIGINT AS rating FROM sides GROUP BY ALL HAVING count(*) >= 8)
 SELECT s.season, s.team, {r("sum(coalesce(rating, -800)) / 100.0 / count(*)")} AS sos FROM sides s LEFT JOIN m ON m.season = s.season AND m.team = s.opponent GROUP BY ALL""")
def schedule_strength(spark, d):
    two = sides_of(spark, d)
    ratings = two.groupBy("season", "team").agg(F.floor(F.sum("margin") * 100 / F.count(F.lit(1))).alias("rating"), F.count(F.lit(1)).alias("n")).where("n >= 8")
    return S.strength_of_schedule(two, ratings)


@query("j14_conference_record", f"""WITH {SIDES}, c AS (SELECT season, conf, team, count(*) FILTER (margin > 0) AS conf_wins, count(*) FILTER (margin < 0) AS conf_losses FROM sides WHERE conf = opp_conf GROUP BY ALL)
 SELECT *, row_number() OVER (PARTITION BY season, conf ORDER BY conf_wins DESC, conf_losses, team) AS place FROM c""")
def conference_record(spark, d):
    return S.conference_record(sides_of(spark, d))


@query("q17_team_schedule", f"""WITH {SIDES} SELECT season, slate, game_id, opponent, CASE WHEN is_home THEN 'home' ELSE 'away' END AS venue, margin,
 CASE WHEN margin > 0 THEN 'W' WHEN margin < 0 THEN 'L' ELSE 'T' END AS result FROM sides WHERE team = 'NATION_3'""")
def team_schedule(spark, d):
    return S.schedule(sides_of(spark, d), "NATION_3")


@query("a7_turnovers", f"""WITH {PLAYS}, l AS (SELECT game_id, pos, def, count(*) FILTER (turnover) AS n FROM plays GROUP BY ALL)
 SELECT game_id, team, sum(g)::BIGINT AS giveaways, sum(t)::BIGINT AS takeaways FROM (SELECT game_id, pos AS team, n AS g, 0 AS t FROM l UNION ALL SELECT game_id, def, 0, n FROM l) GROUP BY ALL""")
def turnovers(spark, d):
    return N.takeaways(plays_of(spark, d))


@query("a9_wn1_snap_gaps", f"""WITH {PLAYS}, s AS (SELECT game_id, pos, period, wall - lag(wall) OVER w AS gap, lag(pos) OVER w = pos AND lag(period) OVER w = period AS same
  FROM plays WHERE pos_unit = 'Offense' WINDOW w AS (PARTITION BY game_id ORDER BY num))
 SELECT game_id, pos AS team, coalesce(sum(gap) FILTER (same AND gap BETWEEN 0 AND 20000000), 0)::BIGINT AS gap_sum, count(*) FILTER (same AND gap BETWEEN 0 AND 20000000) AS gap_n FROM s GROUP BY ALL""")
def snap_gaps(spark, d):
    return N.gaps(plays_of(spark, d), 0, 20_000_000)


@query("a10_a11_kicks", f"""WITH {PLAYS} SELECT game_id, pos AS team, count(*) FILTER (pos_unit = 'Special' AND points > 0) AS fg_att, count(*) FILTER (pos_unit = 'Special' AND points = 3) AS fg_made,
 coalesce(sum(yards) FILTER (pos_unit = 'Special' AND points = 3), 0)::BIGINT AS fg_yds, count(*) FILTER (pos_unit = 'Special' AND points = 0) AS punt_n,
 coalesce(sum(yards) FILTER (pos_unit = 'Special' AND points = 0), 0)::BIGINT AS punt_yds, count(*) FILTER (pos_unit = 'Offense') AS plays FROM plays GROUP BY ALL""")
def kicks(spark, d):
    return N.kicks(plays_of(spark, d))


_PASSERS = """n AS (SELECT game_id, pos AS team, lower(trim(player)) AS passer, count(*) AS epa_cnt, sum(epa)::BIGINT AS epa_sum FROM plays WHERE pass AND pos_unit = 'Offense' GROUP BY ALL),
passers AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY game_id, team ORDER BY epa_cnt DESC, passer) = 1)"""


@query("a12_modal_passers", f"WITH {PLAYS}, {_PASSERS} SELECT * FROM passers")
def modal_passers(spark, d):
    return N.modal_passers(plays_of(spark, d))


_QUARTERS = """e AS (SELECT game_id, period, max_by(hs, num)::BIGINT AS h, max_by(aws, num)::BIGINT AS a FROM plays GROUP BY ALL),
p AS (SELECT game_id, max(h) FILTER (period = 1) AS h1, max(h) FILTER (period = 2) AS h2, max(h) FILTER (period = 3) AS h3, max(h) FILTER (period = 4) AS h4,
  max(a) FILTER (period = 1) AS a1, max(a) FILTER (period = 2) AS a2, max(a) FILTER (period = 3) AS a3, max(a) FILTER (period = 4) AS a4 FROM e GROUP BY game_id),
quarters AS (SELECT game_id, h1 AS q1_home, a1 AS q1_away, h2 - h1 AS q2_home, a2 - a1 AS q2_away, h3 - h2 AS q3_home, a3 - a2 AS q3_away, h4 - h3 AS q4_home, a4 - a3 AS q4_away FROM p
  WHERE h1 IS NOT NULL AND h2 IS NOT NULL AND h3 IS NOT NULL AND h4 IS NOT NULL)"""


@query("a13_quarter_points", f"WITH {PLAYS}, {_QUARTERS} SELECT * FROM quarters")
def quarter_points(spark, d):
    return N.quarter_points(plays_of(spark, d))


@query("a35_wn35_leaders", f"""WITH {PLAYS}, n AS (SELECT season, CASE WHEN rush THEN 'rush' WHEN pass THEN 'receive' END AS board, player, pos AS team, count(*) AS attempts, sum(yards)::BIGINT AS yards,
  count(*) FILTER (points = 7) AS scores FROM plays WHERE pos_unit = 'Offense' GROUP BY ALL HAVING count(*) >= 3)
 SELECT *, row_number() OVER (PARTITION BY season, board ORDER BY yards DESC, attempts DESC, player, team) AS rank, {div("yards", "attempts")} AS average FROM n QUALIFY rank <= 60""")
def leaders(spark, d):
    return N.leaders(plays_of(spark, d))


_SETS = ["1234", "1", "2", "3", "4", "12", "34", "13", "24", "123", "234"]
_COMBOS = " UNION ALL ".join(f"SELECT game_id, '{s}' AS quarters, 4.0::DOUBLE / {len(s)} AS scale, {' + '.join(f'q{q}_home' for q in s)} AS h, {' + '.join(f'q{q}_away' for q in s)} AS a FROM quarters" for s in _SETS)
_BUNDLES = f"""{_QUARTERS}, combos AS ({_COMBOS}),
bundles AS (SELECT game_id, quarters, quarters = '1234' AS real, scale, (h - a) * scale AS margin, (h > a)::INT AS won FROM combos WHERE h <> a)"""


@query("m23_m24_quarter_bundles", f"""WITH {PLAYS}, {_BUNDLES}, c AS (SELECT game_id, sum(count(*)) OVER (ORDER BY game_id DESC) AS total FROM bundles GROUP BY game_id)
 SELECT b.* FROM bundles b JOIN c USING (game_id) WHERE total <= 8000""")
def quarter_bundles(spark, d):
    return N.newest_bundles(N.quarter_bundles(N.quarter_points(plays_of(spark, d))), 8000)
