"""Ratings before each slate, Elo, side features and their menus, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions.scalars import portable_round
from fieldbook.operators import form as FM
from fieldbook.operators import history as H
from fieldbook.operators import ratings as R
from fieldbook.operators import sides as S
from fieldbook.operators import snaps as N
from fieldbook.operators.elo import elo as elo_walk
from fieldbook.plans.contest_queries import _PASSERS, plays_of, sides_of
from fieldbook.plans.contest_sql import ELO, SIDES, book, div, r
from fieldbook.sources.store import stored

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- stored tables


def book_of(spark: SparkSession, d: str) -> DataFrame:
    """Opponent-adjusted ratings before every slate and of whole seasons."""
    return stored(spark, d, "book", lambda: R.adjusted(R.statistics(sides_of(spark, d), cutoffs=True)))


def before_of(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "before", lambda: R.before(sides_of(spark, d), book_of(spark, d)))


def walk_of(spark: SparkSession, d: str) -> DataFrame:
    """Elo before and after each contest."""
    return stored(spark, d, "walk", lambda: elo_walk(S.listed_games(sides_of(spark, d))))


def snaps_of(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "snaps", lambda: N.side_snaps(plays_of(spark, d)))


def rows_of(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "form_rows", lambda: FM.rows(sides_of(spark, d), before_of(spark, d), walk_of(spark, d), snaps_of(spark, d)))


def conference_of(spark: SparkSession, d: str) -> DataFrame:
    """Mean rating and Elo of each conference by slate."""
    two = sides_of(spark, d)
    pom = FM.last_known(before_of(spark, d).select("season", "slate", "team", (F.col("rating") / 100.0).alias("pom")), two, "pom")
    elo = FM.last_known(R.elo_before(walk_of(spark, d)), two, "elo")
    return pom.join(elo.hint("merge"), ["conf", "season", "slate"])


def strengths_of(spark: SparkSession, d: str) -> DataFrame:
    """SRS, Colley and Bradley-Terry before every slate and of whole seasons (cutoff 99)."""
    return stored(spark, d, "strengths", lambda: R.strengths(R.statistics(sides_of(spark, d), cutoffs=True)))


def form_of(spark: SparkSession, d: str) -> DataFrame:
    """The wide row of every season, slate and team: all that any menu needs."""

    def make() -> DataFrame:
        plays = plays_of(spark, d)  # before the sides, which are then made of them
        two = sides_of(spark, d)
        keys = ["season", "slate", "team"]
        wide = FM.before_slate(rows_of(spark, d), before_of(spark, d))
        conf = two.select(*keys, "conf").distinct().join(conference_of(spark, d).hint("merge"), ["conf", "season", "slate"], "left")
        conf = conf.select(*keys, F.coalesce("conf_pom", F.lit(0.0)).alias("conf_pom"), F.coalesce("conf_elo", F.lit(1500.0)).alias("conf_elo"), F.coalesce(F.col("conf").isin(*FM.POWER), F.lit(False)).cast("int").alias("power"))
        strong = strengths_of(spark, d).select("season", F.col("cutoff").alias("slate"), "team", "srs", "colley", "glm")
        for part, how in ((conf, "inner"), (H.year_over_year(two), "inner"), (FM.starters(N.modal_passers(plays), two), "inner"), (strong, "left")):
            wide = wide.join(part.hint("merge"), keys, how)
        return wide.fillna({"srs": 0.0, "colley": 0.5, "glm": 0.0})

    return stored(spark, d, "form", make)


# ---------------------------------------------------------------- SQL of the same

_BEFORE = f"""{book()}, before AS MATERIALIZED (SELECT s.season, s.slate, s.team, coalesce(floor(pom + 0.500001), -800)::BIGINT AS rating, coalesce(adjo, -400.0) AS adjo, coalesce(adjd, 400.0) AS adjd, coalesce(st, 0.0) AS adjst, coalesce(tempo, 130.0) / 2 AS tempo_pg, coalesce(b.games, 0) AS rated_games
  FROM (SELECT DISTINCT season, slate, team FROM sides) s LEFT JOIN book b ON b.season = s.season AND b.cutoff = s.slate AND b.team = s.team)"""
_SNAPS = """gp AS (SELECT game_id, pos, period, wall - lag(wall) OVER w AS gap, clock - lag(clock) OVER w AS tick, lag(pos) OVER w = pos AS same, lag(period) OVER w = period AS samep FROM plays WHERE pos_unit = 'Offense' WINDOW w AS (PARTITION BY game_id ORDER BY num)),
ga AS (SELECT game_id, pos AS team, coalesce(sum(gap) FILTER (same AND samep AND gap BETWEEN 0 AND 20000000), 0)::BIGINT AS gap_sum, count(*) FILTER (same AND samep AND gap BETWEEN 0 AND 20000000) AS gap_n,
  coalesce(sum(-tick) FILTER (samep AND -tick BETWEEN 1 AND 400), 0)::BIGINT AS clock_sum, count(*) FILTER (samep AND -tick BETWEEN 1 AND 400) AS clock_n FROM gp GROUP BY ALL),
ka AS (SELECT game_id, pos AS team, count(*) FILTER (pos_unit = 'Special' AND points > 0) AS fg_att, count(*) FILTER (pos_unit = 'Special' AND points = 3) AS fg_made, coalesce(sum(yards) FILTER (pos_unit = 'Special' AND points = 3), 0)::BIGINT AS fg_yds,
  coalesce(sum(CASE WHEN fg_chance > 1 THEN fg_chance ELSE fg_chance * 100 END) FILTER (pos_unit = 'Special' AND points > 0), 0)::BIGINT AS fg_exp, count(*) FILTER (pos_unit = 'Special' AND points = 0) AS punt_n,
  coalesce(sum(yards) FILTER (pos_unit = 'Special' AND points = 0), 0)::BIGINT AS punt_yds, count(*) FILTER (pos_unit = 'Offense') AS plays FROM plays GROUP BY ALL),
snaps AS MATERIALIZED (SELECT ka.*, coalesce(gap_sum, 0) AS gap_sum, coalesce(gap_n, 0) AS gap_n, coalesce(clock_sum, 0) AS clock_sum, coalesce(clock_n, 0) AS clock_n FROM ka LEFT JOIN ga USING (game_id, team))"""
_SN = ("gap_sum", "gap_n", "clock_sum", "clock_n", "fg_att", "fg_made", "fg_yds", "fg_exp", "punt_n", "punt_yds", "plays")
_ROWS = f"""{_BEFORE}, {ELO}, {_SNAPS}, fr AS MATERIALIZED (SELECT s.*, b.rating AS opp_rating, e.b AS elo_b, {", ".join(f"n.{c}" for c in _SN)}, (margin > 0 OR (margin = 0 AND NOT is_home))::INT AS won, coalesce(conf = opp_conf, false) AS same_conf
  FROM sides s JOIN before b ON b.season = s.season AND b.slate = s.slate AND b.team = s.opponent JOIN elo_rows e ON e.game_id = s.game_id AND e.team = s.team LEFT JOIN snaps n ON n.game_id = s.game_id AND n.team = s.team)"""
_only = lambda c, x: f"CASE WHEN {c} THEN {x} ELSE 0 END"
_micro = lambda x: f"floor(({x}) * 1000000 + 0.500001)"
_SUMS = {
    "games": "1", "wins": "won", "margin_sum": "margin", "pf": "points", "pa": "opp_points", "home_n": "is_home::INT", "home_margin": _only("is_home", "margin"), "away_margin": _only("NOT is_home", "margin"),
    "close_n": _only("abs(margin) <= 8", "1"), "close_wins": _only("abs(margin) <= 8", "won"), "margin_sq": "margin * margin", "late_n": _only("slate >= 8", "1"), "late_wins": _only("slate >= 8", "won"), "conf_n": _only("same_conf", "1"),
    "conf_wins": _only("same_conf", "won"), "conf_m": _only("same_conf", "margin"), "give": "giveaways", "take": "opp_giveaways", "ryds": "rush_yds", "rn": "rush_n", "expected": _micro("1.0::DOUBLE / (1.0 + exp(-margin / 9.5::DOUBLE))"),
    "logm": _micro("sign(margin) * ln(1.0::DOUBLE + abs(margin))"), "opp": "opp_rating", "res": "margin * 100 - opp_rating", "q_n": _only("opp_rating > 0", "1"), "q_wins": _only("opp_rating > 0", "won"), "nc": _only("NOT same_conf", "opp_rating"),
    "tiers": "won * CASE WHEN opp_rating > 1000 THEN 24 WHEN opp_rating > 0 THEN 16 WHEN opp_rating > -1500 THEN 8 ELSE 1 END", **{c: f"coalesce({c}, 0)" for c in _SN}, "snap_games": "(plays IS NOT NULL)::INT",
}
_tail = lambda x, k: f"coalesce(list_sum([y.{x} FOR y IN h[greatest(games - {k} + 1, 1):games]]), 0)"
_mean = lambda x, k, d="0.0": div(_tail(x, k), f"least(games, {k})", d)
_FORM = f"""{_ROWS},
fp AS (SELECT season, slate, team, {", ".join(f"sum({x})::BIGINT AS {k}" for k, x in _SUMS.items())}, arg_min(elo_b, game_id) AS elo,
  list({{'game_id': game_id, 'margin': margin, 'won': won, 'points': points, 'opp_points': opp_points, 'res': margin * 100 - opp_rating, 'elo_b': elo_b}} ORDER BY game_id) AS now FROM fr GROUP BY ALL),
fc AS (SELECT season, slate, team, elo, max(slate) OVER w AS last_slate, {", ".join(f"coalesce(sum({k}) OVER w, 0)::BIGINT AS {k}" for k in _SUMS)}, coalesce(flatten(list(now) OVER w), []) AS h FROM fp
  WINDOW w AS (PARTITION BY season, team ORDER BY slate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fm AS (SELECT *, [y.margin FOR y IN h] AS m, list_sort([y.margin FOR y IN h]) AS o, CASE WHEN games >= 5 THEN greatest(games // 10, 1) ELSE 0 END AS cut FROM fc),
form AS MATERIALIZED (SELECT season, slate, team, games, {div("wins", "games", "0.5")} AS winpct, {div("margin_sum", "games")} AS avg_margin, {div("pf", "games")} AS avg_pf, {div("pa", "games")} AS avg_pa,
 {r("CASE WHEN games > 0 THEN (pf * pf) / (pf * pf + pa * pa + 1e-9) ELSE 0.5 END")} AS pythag, {div("home_margin", "home_n")} AS home_venue, {div("away_margin", "games - home_n")} AS away_venue, {div("close_wins", "close_n", "0.5")} AS close_winpct,
 {div("late_wins", "late_n", "0.5")} AS late_winpct, {div("conf_wins", "conf_n", "0.5")} AS conf_winpct, {div("conf_m", "conf_n")} AS conf_margin, {div("wins - conf_wins", "games - conf_n", "0.5")} AS out_winpct, {div("margin_sum - conf_m", "games - conf_n")} AS out_margin,
 {r("CASE WHEN games >= 2 THEN sqrt((games * margin_sq - margin_sum * margin_sum)::DOUBLE) / games ELSE 0.0 END", 3)} AS margin_std, slate - coalesce(last_slate, slate) AS rest, {r("CASE WHEN games > 0 THEN (wins - expected / 1000000::DOUBLE) / games ELSE 0.0 END")} AS luck,
 {div("logm", "games * 1000000.0")} AS log_margin, {div("opp", "games * 100.0")} AS sos, {div("res", "games * 100.0")} AS residual, {div("q_wins", "q_n", "0.5")} AS quality_winpct, {div("nc", "(games - conf_n) * 100.0")} AS ncsos, tiers / 4.0 AS tier_wins,
 {div("take - give", "games")} AS turnover_margin, {div("ryds", "rn")} AS yards_per_carry, {div("gap_sum", "gap_n")} AS snap_seconds, {div("clock_sum", "clock_n")} AS clock_seconds, {div("fg_yds", "fg_made")} AS fg_distance, {div("fg_made * 100 - fg_exp", "fg_att * 100.0")} AS fg_residual,
 {div("punt_n", "punt_n + plays")} AS punt_rate, {div("punt_yds", "punt_n")} AS punt_yards, {div("plays", "snap_games")} AS plays_pg, {_mean("won", 4, "0.5")} AS form4_win, {_mean("won", 10, "0.5")} AS form10_win, {_mean("margin", 2)} AS form2_margin, {_mean("margin", 4)} AS form4_margin,
 {_mean("margin", 8)} AS form8_margin, {_mean("points", 4)} AS form4_pf, {_mean("opp_points", 4)} AS form4_pa, {div(_tail("res", 4), "least(games, 4) * 100.0")} AS form4_residual,
 CASE WHEN games = 0 THEN 0.0::DOUBLE WHEN games % 2 = 1 THEN o[games // 2 + 1]::DOUBLE ELSE (o[games // 2] + o[games // 2 + 1])::DOUBLE / 2 END AS median_margin,
 {r("list_reduce([x::DOUBLE FOR x IN m], lambda v, x: v * 0.45::DOUBLE + x * 0.55::DOUBLE, 0.0::DOUBLE)", 3)} AS ewma_margin,
 list_reduce([y.won::BIGINT FOR y IN h], lambda s, x: CASE WHEN x = 1 THEN CASE WHEN s > 0 THEN s + 1 ELSE 1 END ELSE CASE WHEN s < 0 THEN s - 1 ELSE -1 END END, 0::BIGINT)::INT AS streak, {div("coalesce(list_sum(o[cut + 1:games - cut]), 0)", "games - 2 * cut")} AS trimmed_margin,
 {r(f"CASE WHEN games >= 2 THEN {_tail('margin', 4)}::DOUBLE / least(games, 4) - margin_sum::DOUBLE / games ELSE 0.0 END")} AS momentum, {r("elo", 3)} AS elo, {r("CASE WHEN games > 0 THEN elo - h[greatest(games - 4, 0) + 1].elo_b ELSE 0.0 END", 3)} AS elo_momentum,
 {r("CASE WHEN games > 0 THEN (elo - h[1].elo_b) / games ELSE 0.0 END", 3)} AS elo_slope, b.rating / 100.0::DOUBLE AS pom, {r("b.adjo / 100.0::DOUBLE")} AS adjo, {r("b.adjd / 100.0::DOUBLE")} AS adjd, {r("b.adjst / 100.0::DOUBLE")} AS adjst, {r("b.tempo_pg")} AS tempo_pg, b.rated_games
 FROM fm JOIN before b USING (season, slate, team))"""
_KNOWN = lambda v, source: f"""kn_{v} AS (SELECT x.season, x.slate, x.team, floor(x.{v} * 1000 + 0.500001)::BIGINT AS v, conf, x.season * 100 + x.slate AS sl FROM {source} x JOIN (SELECT DISTINCT season, slate, team, conf FROM sides) USING (season, slate, team)),
mv_{v} AS (SELECT *, v - coalesce(lag(v) OVER w, 0) AS move, (lag(v) OVER w IS NULL)::INT AS new FROM kn_{v} WINDOW w AS (PARTITION BY team ORDER BY sl)),
cf_{v} AS (SELECT conf, season, slate, {r('sum(sum(move)) OVER w / (sum(sum(new)) OVER w * 1000.0::DOUBLE)')} AS conf_{v} FROM mv_{v} GROUP BY conf, season, slate, sl WINDOW w AS (PARTITION BY conf ORDER BY sl))"""  # noqa: E731
_CONF = f"""{_KNOWN("pom", "(SELECT season, slate, team, rating / 100.0::DOUBLE AS pom FROM before)")}, {_KNOWN("elo", "elo_at")},
cf AS MATERIALIZED (SELECT * FROM cf_pom JOIN cf_elo USING (conf, season, slate))"""
_STARTERS = f"""{_PASSERS}, pz AS MATERIALIZED (SELECT p.*, season, slate FROM passers p JOIN games USING (game_id)),
ml AS (SELECT season, team, arg_min(passer, {{'n': -n, 'f': f}}) AS modal FROM (SELECT season, team, passer, count(*) AS n, min(game_id) AS f FROM pz GROUP BY ALL) GROUP BY ALL),
sl0 AS (SELECT DISTINCT season, slate, team FROM sides), kn AS (SELECT season, team, last_value(modal IGNORE NULLS) OVER (PARTITION BY team ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_modal FROM (SELECT DISTINCT season, team FROM sl0) LEFT JOIN ml USING (season, team)),
rc AS (SELECT season, slate, team, max_by(passer, game_id) AS passer FROM pz GROUP BY ALL),
sn AS (SELECT season, slate, team, last_value(passer IGNORE NULLS) OVER (PARTITION BY season, team ORDER BY slate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS recent FROM sl0 LEFT JOIN rc USING (season, slate, team)),
sk AS (SELECT season, slate, team, coalesce(recent, last_modal) AS starter, last_modal FROM sn JOIN kn USING (season, team)),
dn AS (SELECT k.season, k.slate, k.team, sum(epa_sum) AS s, sum(epa_cnt) AS n, count(*) AS g FROM sk k JOIN pz ON pz.season = k.season AND pz.team = k.team AND pz.passer = starter AND pz.slate < k.slate GROUP BY ALL),
pr AS (SELECT passer, season, sum(epa_sum)::DOUBLE / sum(epa_cnt) AS rate FROM pz GROUP BY ALL), pl AS (SELECT passer, rate, season AS ls, coalesce(lead(season) OVER (PARTITION BY passer ORDER BY season), 9999) AS until FROM pr),
starters AS MATERIALIZED (SELECT k.season, k.slate, k.team, starter, {div("coalesce(s, 0)", "coalesce(n, 0)")} AS starter_epa, CASE WHEN starter IS NULL OR last_modal = starter THEN 0.0::DOUBLE ELSE 1.0 END AS starter_change, {r("ln(1.0::DOUBLE + coalesce(g, 0))")} AS starter_log, {r("coalesce(rate, 0.0)")} AS starter_last
  FROM sk k LEFT JOIN dn USING (season, slate, team) LEFT JOIN pl ON pl.passer = starter AND ls < k.season AND k.season <= until)"""
_YOY = f"""yc AS (SELECT season, slate, team, sum(count(*)) OVER w AS g, sum(sum(margin)) OVER w AS m FROM sides GROUP BY season, slate, team WINDOW w AS (PARTITION BY season, team ORDER BY slate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
yl AS (SELECT season, team, lag(mean) OVER (PARTITION BY team ORDER BY season) AS was FROM (SELECT season, team, sum(margin)::DOUBLE / count(*) AS mean FROM sides GROUP BY ALL)),
yy AS MATERIALIZED (SELECT season, slate, team, {r("CASE WHEN was IS NOT NULL AND coalesce(g, 0) > 0 THEN m::DOUBLE / g - was ELSE 0.0 END")} AS yoy_margin FROM yc JOIN yl USING (season, team))"""
_H2H = """hh AS MATERIALIZED (SELECT game_id, coalesce(last_value(margin) OVER (PARTITION BY team, opponent ORDER BY season * 100 + slate RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h2h, is_home FROM sides),
gx AS MATERIALIZED (SELECT g.*, h2h, coalesce(home_conf = away_conf, false)::INT AS same_conf FROM games g JOIN hh ON hh.game_id = g.game_id AND hh.is_home)"""
def _wide(tables: str = "", columns: str = "", joins: str = "") -> str:
    """All that menus need, with further tables, columns and joins."""
    return f"""{_FORM}, {_CONF}, {_STARTERS}, {_YOY}, {_H2H}{tables}, wide AS MATERIALIZED (SELECT f.*{columns}, conf_pom, conf_elo, (conf IN {FM.POWER})::INT AS power, yoy_margin, starter_epa, starter_change, starter_log, starter_last
  FROM form f JOIN (SELECT DISTINCT season, slate, team, conf FROM sides) s USING (season, slate, team) JOIN cf USING (conf, season, slate) JOIN yy USING (season, slate, team) JOIN starters USING (season, slate, team){joins})"""


def menu_sql(*names: str, wide: str = "") -> str:
    columns = {k: v for n in names for k, v in FM.MENUS[n].items()}
    return f"""WITH RECURSIVE {SIDES}, {wide or _wide()} SELECT g.game_id, g.season, g.slate, {", ".join(f"{r(v)} AS {k}" for k, v in columns.items())} FROM gx g
 JOIN wide h ON h.season = g.season AND h.slate = g.slate AND h.team = g.home JOIN wide a ON a.season = g.season AND a.slate = g.slate AND a.team = g.away"""


# ---------------------------------------------------------------- queries


@query("r1_adjusted_ratings", f"WITH {SIDES}, {book()} SELECT season, team, games, {r('off', 3)} AS off, {r('def', 3)} AS def, {r('st', 3)} AS st, {r('tempo', 3)} AS tempo, {r('home_adv', 3)} AS home_adv, {r('pom', 2)} AS pom FROM book WHERE cutoff = 99")
def adjusted_ratings(spark, d):
    b = book_of(spark, d).where("cutoff = 99")
    return b.select("season", "team", "games", *[portable_round(c, k).alias(c) for c, k in (("off", 3), ("def", 3), ("st", 3), ("tempo", 3), ("home_adv", 3), ("pom", 2))])


@query("m1_j10_ratings_before_slates", f"WITH {SIDES}, {_BEFORE} SELECT season, slate, team, rating, {r('adjo', 3)} AS adjo, {r('adjd', 3)} AS adjd, {r('tempo_pg', 3)} AS tempo_pg, rated_games FROM before")
def ratings_before(spark, d):
    """All cutoffs at once: each sees earlier slates only."""
    return before_of(spark, d).select("season", "slate", "team", "rating", portable_round("adjo", 3).alias("adjo"), portable_round("adjd", 3).alias("adjd"), portable_round("tempo_pg", 3).alias("tempo_pg"), "rated_games")


@query("m1_walk_forward_ratings")
def carried_ratings(spark, d):
    """Season after season, with the last season's final ratings as the prior."""
    return R.carried(sides_of(spark, d))


@query("r2_elo", f"WITH RECURSIVE {SIDES}, {ELO} SELECT game_id, season, slate, home, away, {r('hb', 3)} AS home_before, {r('ab', 3)} AS away_before, {r('hb + move', 3)} AS home_after, {r('ab - move', 3)} AS away_after FROM walk")
def elo(spark, d):
    w = walk_of(spark, d)
    return w.select("game_id", "season", "slate", "home", "away", *[portable_round(c, 3).alias(c) for c in ("home_before", "away_before", "home_after", "away_after")])


@query("r3_elo_snapshots", f"WITH RECURSIVE {SIDES}, {ELO} SELECT season, team, {r('arg_max(af, slate * 100000000 + game_id % 100000000)', 3)} AS elo FROM elo_rows GROUP BY ALL")
def elo_snapshots(spark, d):
    return R.elo_snapshots(walk_of(spark, d)).withColumn("elo", portable_round("elo", 3))


#: Colley's system of each cutoff as a list of rows (coefficients, right side), eliminated column by column; the diagonal dominates, so no rows need be exchanged.
_SOLVED = """sg AS MATERIALIZED (SELECT season, slate, team, opponent, count(*) AS n, sum(margin) AS m, count(*) FILTER (margin > 0 OR (margin = 0 AND NOT is_home)) AS w FROM sides GROUP BY ALL),
sc AS (SELECT DISTINCT season, slate AS cutoff FROM sides UNION SELECT DISTINCT season, 99 FROM sides),
pw AS MATERIALIZED (SELECT season, cutoff, team, opponent, sum(n)::DOUBLE AS n, sum(m)::DOUBLE AS m, sum(w)::DOUBLE AS w FROM sg JOIN sc USING (season) WHERE slate < cutoff GROUP BY ALL),
tk AS MATERIALIZED (SELECT season, cutoff, team, row_number() OVER (PARTITION BY season, cutoff ORDER BY team) AS k, count(*) OVER (PARTITION BY season, cutoff) AS size, sum(n) AS n, sum(m) AS m, sum(w) AS w FROM pw GROUP BY season, cutoff, team),
mx AS (SELECT season, cutoff, size, list(c ORDER BY k) AS c FROM (SELECT t.season, t.cutoff, any_value(t.size) AS size, t.k, list(CASE WHEN o.k = t.k THEN 2 + t.n ELSE -coalesce(p.n, 0) END ORDER BY o.k) || [any_value((2 + 2 * t.w - t.n) / 2)] AS c
  FROM tk t JOIN tk o USING (season, cutoff) LEFT JOIN pw p ON p.season = t.season AND p.cutoff = t.cutoff AND p.team = t.team AND p.opponent = o.team GROUP BY t.season, t.cutoff, t.k) GROUP BY ALL),
ge AS (SELECT season, cutoff, size, 1 AS i, c FROM mx UNION ALL SELECT season, cutoff, size, i + 1, list_transform(c, lambda x, j: CASE WHEN j = i THEN [y / x[i] FOR y IN x] ELSE list_transform(x, lambda y, q: y - x[i] / c[i][i] * c[i][q]) END) FROM ge WHERE i <= size),
colley AS MATERIALIZED (SELECT t.season, t.cutoff, t.team, g.c[t.k][t.size + 1] AS colley FROM tk t JOIN ge g ON g.season = t.season AND g.cutoff = t.cutoff WHERE g.i = g.size + 1)"""


_SRS = """mr AS (SELECT season, cutoff, size, list(c ORDER BY k) AS c FROM (SELECT t.season, t.cutoff, any_value(t.size) AS size, t.k, list(CASE WHEN t.k = t.size THEN 1.0::DOUBLE WHEN o.k = t.k THEN t.n ELSE -coalesce(p.n, 0) END ORDER BY o.k) || [any_value(CASE WHEN t.k = t.size THEN 0.0::DOUBLE ELSE t.m END)] AS c
  FROM tk t JOIN tk o USING (season, cutoff) LEFT JOIN pw p ON p.season = t.season AND p.cutoff = t.cutoff AND p.team = t.team AND p.opponent = o.team GROUP BY t.season, t.cutoff, t.k) GROUP BY ALL),
gr AS (SELECT season, cutoff, size, 1 AS i, c FROM mr UNION ALL SELECT season, cutoff, size, i + 1, list_transform(c, lambda x, j: CASE WHEN j = i THEN [y / x[i] FOR y IN x] ELSE list_transform(x, lambda y, q: y - x[i] / c[i][i] * c[i][q]) END) FROM gr WHERE i <= size),
srs AS MATERIALIZED (SELECT t.season, t.cutoff, t.team, g.c[t.k][t.size + 1] AS srs FROM tk t JOIN gr g ON g.season = t.season AND g.cutoff = t.cutoff WHERE g.i = g.size + 1)"""


_P = lambda a, b: f"(1.0 / (1.0 + exp(-(x[{a}] - x[{b}]))))"
#: Bradley-Terry: a dozen Newton steps on the pairs' counts, each an elimination, column by column; by then no step moves anything.
_GLM = f"""gn AS (SELECT season, cutoff, any_value(size)::INT AS size, list(nr ORDER BY k) AS nm, list(wr ORDER BY k) AS wm FROM (SELECT t.season, t.cutoff, any_value(t.size) AS size, t.k, list(coalesce(p.n, 0.0) ORDER BY o.k) AS nr, list(coalesce(p.w, 0.0) ORDER BY o.k) AS wr
  FROM tk t JOIN tk o USING (season, cutoff) LEFT JOIN pw p ON p.season = t.season AND p.cutoff = t.cutoff AND p.team = t.team AND p.opponent = o.team GROUP BY t.season, t.cutoff, t.k) GROUP BY ALL),
nt AS (SELECT season, cutoff, size, nm, wm, 0 AS step, size + 1 AS i, [0.0::DOUBLE FOR y IN nm] AS x, [[0.0::DOUBLE FOR z IN range(size + 1)] FOR y IN nm] AS c FROM gn
 UNION ALL SELECT season, cutoff, size, nm, wm, CASE WHEN i > size THEN step + 1 ELSE step END, CASE WHEN i > size THEN 1 ELSE i + 1 END, x, CASE WHEN i > size THEN list_transform(nm, lambda nr, k: list_transform(nr, lambda nn, o: CASE WHEN o = k THEN 1.0 + list_sum(list_transform(nr, lambda m, q: m * {_P("k", "q")} * (1 - {_P("k", "q")}))) ELSE -nn * {_P("k", "o")} * (1 - {_P("k", "o")}) END)
   || [list_sum(list_transform(nr, lambda m, q: wm[k][q] - m * {_P("k", "q")})) - x[k]]) ELSE list_transform(c, lambda y, j: CASE WHEN j = i THEN [z / y[i] FOR z IN y] ELSE list_transform(y, lambda z, q: z - y[i] / c[i][i] * c[i][q]) END) END
  FROM (SELECT season, cutoff, size, nm, wm, step, i, CASE WHEN i > size THEN list_transform(x, lambda v, j: v + c[j][size + 1]) ELSE x END AS x, c FROM nt WHERE step <= 12)),
glm AS MATERIALIZED (SELECT t.season, t.cutoff, t.team, g.x[t.k] - list_avg(g.x) AS glm FROM tk t JOIN nt g ON g.season = t.season AND g.cutoff = t.cutoff WHERE g.step = 13 AND g.i = 1)"""


@query("r6_bradley_terry", f"WITH RECURSIVE {SIDES}, {_SOLVED}, {_GLM} SELECT season, cutoff, team, {r('glm', 5)} AS glm FROM glm")
def bradley_terry(spark, d):
    return strengths_of(spark, d).select("season", "cutoff", "team", portable_round("glm", 5).alias("glm"))


@query("r4_srs", f"WITH RECURSIVE {SIDES}, {_SOLVED}, {_SRS} SELECT season, cutoff, team, {r('srs', 5)} AS srs FROM srs")
def srs(spark, d):
    return strengths_of(spark, d).select("season", "cutoff", "team", portable_round("srs", 5).alias("srs"))


@query("r5_colley", f"WITH RECURSIVE {SIDES}, {_SOLVED} SELECT season, cutoff, team, {r('colley', 6)} AS colley FROM colley")
def colley(spark, d):
    return strengths_of(spark, d).select("season", "cutoff", "team", portable_round("colley", 6).alias("colley"))


@query("a16_a17_r10_rated_board", f"""WITH {SIDES}, {book()}, rec AS (SELECT season, team, count(*) FILTER (margin > 0) AS wins, count(*) FILTER (margin < 0) AS losses, count(*) AS played, sum(floor((1.0::DOUBLE / (1.0 + exp(-margin / 9.5::DOUBLE))) * 1000000 + 0.500001))::BIGINT AS e, sum((margin > 0)::INT) AS w FROM sides GROUP BY ALL),
 sos AS (SELECT s.season, s.team, sum(coalesce(floor(pom + 0.500001), -800))::BIGINT AS o FROM sides s LEFT JOIN book b ON b.season = s.season AND b.team = s.opponent AND b.cutoff = 99 GROUP BY ALL)
 SELECT b.season, b.team, wins, losses, played, {r('pom / 100.0::DOUBLE', 2)} AS pom, {r('adjo / 100.0::DOUBLE', 2)} AS adjo, {r('adjd / 100.0::DOUBLE', 2)} AS adjd, {r('tempo / 2', 2)} AS tempo, {r('(w - e / 1000000::DOUBLE) / played', 3)} AS luck, {r('o / (played * 100.0::DOUBLE)', 2)} AS sos,
  row_number() OVER (PARTITION BY b.season ORDER BY floor(pom + 0.500001) DESC, b.team) AS rank FROM book b JOIN rec USING (season, team) JOIN sos USING (season, team) WHERE cutoff = 99 AND played >= 8""")
def rated_board(spark, d):
    return S.rated_board(sides_of(spark, d), book_of(spark, d))


_WIDE = ["winpct", "avg_margin", "avg_pf", "avg_pa", "pythag", "home_venue", "away_venue", "close_winpct", "late_winpct", "conf_winpct", "conf_margin", "out_winpct", "out_margin", "margin_std", "rest", "turnover_margin", "yards_per_carry", "plays_pg"]
_RECENT = ["form4_win", "form10_win", "form2_margin", "form4_margin", "form8_margin", "form4_pf", "form4_pa", "median_margin", "ewma_margin", "streak", "trimmed_margin", "momentum"]
_SCHEDULE = ["sos", "residual", "form4_residual", "quality_winpct", "ncsos", "tier_wins"]
_RATES = ["snap_seconds", "clock_seconds", "fg_distance", "fg_residual", "punt_rate", "punt_yards"]
_OTHER = ["luck", "log_margin", "elo", "elo_momentum", "elo_slope"]
for _name, _columns in (("wn2_side_features", ["games", *_WIDE]), ("wn3_recent_form", _RECENT), ("wn12_schedule_features", _SCHEDULE), ("wn30_wn31_rates", _RATES), ("wn10_wn13_wn19_wn23_luck_and_elo", _OTHER)):
    QUERIES[_name] = lambda spark, d, c=_columns: form_of(spark, d).select("season", "slate", "team", *c)
    ORACLE_SQL[_name] = f"WITH RECURSIVE {SIDES}, {_FORM} SELECT season, slate, team, {', '.join(_columns)} FROM form"


@query("wn24_year_over_year", f"WITH {SIDES}, {_YOY} SELECT * FROM yy")
def year_over_year(spark, d):
    return H.year_over_year(sides_of(spark, d))


@query("wn25_last_meeting", f"WITH {SIDES}, {_H2H} SELECT game_id, h2h FROM gx")
def last_meeting(spark, d):
    return FM.last_meeting(sides_of(spark, d))


@query("wn26_wn27_conference_means", f"WITH RECURSIVE {SIDES}, {_BEFORE}, {ELO}, {_CONF} SELECT * FROM cf")
def conference_means(spark, d):
    return conference_of(spark, d)


@query("wn32_wn33_starters", f"WITH {SIDES}, {_STARTERS} SELECT * FROM starters")
def starters(spark, d):
    return FM.starters(N.modal_passers(plays_of(spark, d)), sides_of(spark, d))


def _menu(*names: str):
    def run(spark, d):
        wide = form_of(spark, d)  # before the sides, as it needs plays
        return FM.menu(FM.contests(sides_of(spark, d)), wide, *names)

    return run


for _row, _names in (("f1_locked_menu", ["locked"]), ("f2_extras_menu", ["extras"]), ("f3_signal_menu", ["signal"]), ("f6_conference_menu", ["conference"]), ("f8_time_menu", ["time"]), ("f9_thin_menu", ["thin"]),
                     ("f10_pace_menu", ["pace"]), ("f11_specials_menu", ["specials"]), ("f12_passer_menu", ["passer"]), ("f14_extras_pace_specials", ["locked", "extras", "pace", "specials"])):
    QUERIES[_row], ORACLE_SQL[_row] = _menu(*_names), menu_sql(*_names)
_STRONG = " LEFT JOIN {t} ON {t}.season = f.season AND {t}.cutoff = f.slate AND {t}.team = f.team"
_SYSTEMS = _wide(f", {_SOLVED}, {_SRS}, {_GLM}", ", coalesce(srs, 0.0) AS srs, coalesce(colley, 0.5) AS colley, coalesce(glm, 0.0) AS glm", "".join(_STRONG.format(t=t) for t in ("srs", "colley", "glm")))
for _row, _names in (("f4_craft_menu", ["craft"]), ("f5_loso_menu", ["loso"]), ("f7_glm4_menu", ["glm4"]), ("f13_all_menus", list(FM.MENUS))):
    QUERIES[_row], ORACLE_SQL[_row] = _menu(*_names), menu_sql(*_names, wide=_SYSTEMS)
