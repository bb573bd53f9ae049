"""The contest model in SQL, which the queries' SQL twins start from."""

PLAYS = """
nat AS (SELECT n_nationkey AS k, n_name AS nm, r_name AS conf, CASE WHEN n_regionkey < 4 THEN 'fbs' ELSE 'fcs' END AS div
        FROM nation JOIN region ON n_regionkey = r_regionkey),
raw AS (SELECT year(o_orderdate) AS season, month(o_orderdate) AS slate, s_nationkey AS pk, c_nationkey AS dk,
          l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_discount * 100) AS int) * 10 - 50 AS epa,
          CASE WHEN l_returnflag = 'R' THEN 'Special' ELSE 'Offense' END AS pos_unit, l_linestatus = 'O' AS rush, l_linestatus = 'F' AS pass,
          l_tax >= 0.08 AS turnover, CASE WHEN l_quantity >= 40 THEN 7 WHEN l_quantity >= 30 THEN 3 ELSE 0 END AS points,
          cast(l_quantity AS int) AS yards, c_name AS player, epoch(l_shipdate)::BIGINT AS wall,
          (l_partkey % 900)::INT AS clock, round(l_tax * 100)::INT * 10 AS fg_chance
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        WHERE s_nationkey <> c_nationkey),
keyed AS (SELECT *, season * 1000000 + slate * 10000 + least(pk, dk) * 100 + greatest(pk, dk) AS game_id,
            CASE WHEN (pk + dk + slate) % 2 = 0 THEN least(pk, dk) ELSE greatest(pk, dk) END AS hk FROM raw),
scored AS (SELECT *, pk + dk - hk AS ak, row_number() OVER w AS num, ntile(4) OVER w AS period,
             sum(CASE WHEN pk = hk THEN points ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS hs,
             sum(CASE WHEN pk <> hk THEN points ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS aws
           FROM keyed WINDOW w AS (PARTITION BY game_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)),
plays AS (SELECT s.*, p.nm AS pos, d.nm AS def, h.nm AS home, a.nm AS away, h.conf AS home_conf, a.conf AS away_conf, h.div AS home_div, a.div AS away_div,
            CASE WHEN pk = hk THEN hs - aws ELSE aws - hs END AS pm
          FROM scored s JOIN nat p ON p.k = pk JOIN nat d ON d.k = dk JOIN nat h ON h.k = hk JOIN nat a ON a.k = ak)"""

SIDES = (
    PLAYS
    + """,
flags AS (SELECT *, pos_unit = 'Offense' AND NOT abs(pm) >= CASE WHEN period <= 1 THEN 42 WHEN period = 2 THEN 38 WHEN period = 3 THEN 28 ELSE 22 END AS use FROM plays),
games AS (SELECT game_id, min(season) AS season, min(slate) AS slate, min(home) AS home, min(away) AS away, min(home_conf) AS home_conf, min(away_conf) AS away_conf,
            min(home_div) AS home_div, min(away_div) AS away_div, max(hs)::BIGINT AS home_points, max(aws)::BIGINT AS away_points,
            count(*) FILTER (pos_unit = 'Offense') AS tempo FROM plays GROUP BY game_id HAVING max(period) >= 4),
rates AS (SELECT game_id, pos AS team, coalesce(sum(epa) FILTER (use), 0)::BIGINT AS off_sum, count(*) FILTER (use) AS off_n,
            coalesce(sum(epa) FILTER (pos_unit <> 'Offense'), 0)::BIGINT AS st_sum, count(*) FILTER (turnover) AS giveaways,
            coalesce(sum(yards) FILTER (rush AND pos_unit = 'Offense'), 0)::BIGINT AS rush_yds, count(*) FILTER (rush AND pos_unit = 'Offense') AS rush_n
          FROM flags GROUP BY ALL),
two AS (SELECT game_id, season, slate, home, away, tempo, home AS team, away AS opponent, home_points AS points, away_points AS opp_points, home_conf AS conf, away_conf AS opp_conf, home_div AS div, away_div AS opp_div, true AS is_home FROM games
        UNION ALL SELECT game_id, season, slate, home, away, tempo, away, home, away_points, home_points, away_conf, home_conf, away_div, home_div, false FROM games),
sides AS (SELECT t.*, points - opp_points AS margin, coalesce(m.off_sum, 0) AS off_sum, coalesce(m.off_n, 0) AS off_n, coalesce(m.st_sum, 0) AS st_sum, coalesce(m.giveaways, 0) AS giveaways,
            coalesce(m.rush_yds, 0) AS rush_yds, coalesce(m.rush_n, 0) AS rush_n, coalesce(o.off_sum, 0) AS opp_off_sum, coalesce(o.off_n, 0) AS opp_off_n, coalesce(o.st_sum, 0) AS opp_st_sum,
            coalesce(o.giveaways, 0) AS opp_giveaways, coalesce(o.rush_yds, 0) AS opp_rush_yds, coalesce(o.rush_n, 0) AS opp_rush_n, coalesce(m.st_sum, 0) - coalesce(o.st_sum, 0) AS st
          FROM two t LEFT JOIN rates m USING (game_id, team) LEFT JOIN rates o ON o.game_id = t.game_id AND o.team = t.opponent)"""
)


def book(passes: int = 40) -> str:
    """The opponent-adjusted ratings before each slate, and of whole seasons (cutoff 99), as a chain of tables that ends in ``book``."""
    out = """pair_s AS MATERIALIZED (SELECT season, slate, team, opponent, div, is_home, count(*) AS n, sum(off_sum::DOUBLE / off_n) AS o, sum(opp_off_sum::DOUBLE / opp_off_n) AS d, sum(st) AS s, sum(tempo) AS t
  FROM sides WHERE off_n > 0 AND opp_off_n > 0 GROUP BY ALL),
cuts AS (SELECT DISTINCT season, slate AS cutoff FROM sides UNION SELECT DISTINCT season, 99 FROM sides),
raws AS MATERIALIZED (SELECT season, cutoff, team, opponent, div, CASE WHEN is_home THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign, sum(n)::DOUBLE AS n, sum(o) / sum(n) AS o, sum(d) / sum(n) AS d, sum(s)::DOUBLE / sum(n) AS s, sum(t)::DOUBLE / sum(n) AS t
  FROM pair_s JOIN cuts USING (season) WHERE slate < cutoff GROUP BY ALL),
lg AS MATERIALIZED (SELECT season, cutoff, sum(n * o) / sum(n) AS league, sum(n * t) / sum(n) AS pace FROM raws GROUP BY ALL),
tops AS MATERIALIZED (SELECT DISTINCT season, cutoff, team FROM raws WHERE div = 'fbs'),
p0 AS MATERIALIZED (SELECT season, cutoff, team, games, 0.0::DOUBLE AS o, 0.0::DOUBLE AS d, 0.0::DOUBLE AS s, pace AS t FROM (SELECT season, cutoff, team, sum(n)::BIGINT AS games FROM raws GROUP BY ALL) JOIN lg USING (season, cutoff)),
h0 AS MATERIALIZED (SELECT season, cutoff, 2.0::DOUBLE AS h FROM lg)"""
    for k in range(passes):
        out += f""",
x{k + 1} AS MATERIALIZED (SELECT r.season, r.cutoff, r.team, any_value(z.games) AS games, sum(r.n * (r.o - q.d - league - h * sign)) / sum(r.n) AS o, sum(r.n * (r.d - q.o - league + h * sign)) / sum(r.n) AS d,
  sum(r.n * (r.s + q.s)) / sum(r.n) AS s, sum(r.n * (r.t + pace - q.t)) / sum(r.n) AS t FROM raws r JOIN p{k} q ON q.season = r.season AND q.cutoff = r.cutoff AND q.team = r.opponent JOIN p0 z ON z.season = r.season AND z.cutoff = r.cutoff AND z.team = r.team
  JOIN lg ON lg.season = r.season AND lg.cutoff = r.cutoff JOIN h{k} hh ON hh.season = r.season AND hh.cutoff = r.cutoff GROUP BY r.season, r.cutoff, r.team),
c{k + 1} AS (SELECT season, cutoff, avg(o) AS o, avg(d) AS d, avg(s) AS s, avg(t) AS t FROM x{k + 1} SEMI JOIN tops USING (season, cutoff, team) GROUP BY ALL),
p{k + 1} AS MATERIALIZED (SELECT x.season, x.cutoff, team, x.games, x.o - coalesce(c.o, 0) AS o, x.d - coalesce(c.d, 0) AS d, x.s - coalesce(c.s, 0) AS s, CASE WHEN c.t IS NULL THEN x.t ELSE x.t - c.t + pace END AS t FROM x{k + 1} x LEFT JOIN c{k + 1} c USING (season, cutoff) JOIN lg USING (season, cutoff)),
h{k + 1} AS MATERIALIZED (SELECT r.season, r.cutoff, coalesce((sum(r.n * (r.o - me.o - q.d - league)) FILTER (sign > 0) / sum(r.n) FILTER (sign > 0) - sum(r.n * (r.o - me.o - q.d - league)) FILTER (sign < 0) / sum(r.n) FILTER (sign < 0)) / 2, 0) AS h
  FROM raws r JOIN p{k + 1} me ON me.season = r.season AND me.cutoff = r.cutoff AND me.team = r.team JOIN p{k + 1} q ON q.season = r.season AND q.cutoff = r.cutoff AND q.team = r.opponent JOIN lg ON lg.season = r.season AND lg.cutoff = r.cutoff GROUP BY ALL)"""
    return out + f""",
book AS MATERIALIZED (SELECT season, cutoff, team, p.games, o AS off, d AS def, s AS st, t AS tempo, h AS home_adv, pace / 2 AS plays_pg, (o - d) * pace / 2 + s AS pom, o * pace / 2 AS adjo, d * pace / 2 AS adjd FROM p{passes} p JOIN h{passes} USING (season, cutoff) JOIN lg USING (season, cutoff))"""


#: Elo before and after each contest, by steps over a list with a number for each team. The query must say WITH RECURSIVE.
ELO = """tm AS MATERIALIZED (SELECT team, row_number() OVER (ORDER BY team) AS k FROM (SELECT DISTINCT team FROM sides)),
gm AS MATERIALIZED (SELECT row_number() OVER w AS i, game_id, season, slate, home, away, h.k AS hk, a.k AS ak, home_points - away_points AS margin, season <> coalesce(lag(season) OVER w, season) AS fresh
  FROM games JOIN tm h ON h.team = home JOIN tm a ON a.team = away WINDOW w AS (ORDER BY season, slate, game_id)),
el AS (SELECT 0::BIGINT AS i, [1500.0::DOUBLE FOR x IN range(count(*))] AS e, 0.0::DOUBLE AS hb, 0.0::DOUBLE AS ab, 0.0::DOUBLE AS move FROM tm
 UNION ALL SELECT i, list_transform(e, lambda x, j: CASE WHEN j = hk THEN x + move WHEN j = ak THEN x - move ELSE x END), e[hk], e[ak], move FROM (
  SELECT i, e, hk, ak, 20.0::DOUBLE * ln(abs(margin) + 1.0::DOUBLE) * 2.2::DOUBLE / ((CASE WHEN margin > 0 THEN ahead ELSE -ahead END) * 0.001::DOUBLE + 2.2::DOUBLE) * ((margin > 0)::INT - 1 / (1 + pow(10.0::DOUBLE, -ahead / 400))) AS move FROM (
   SELECT g.i, hk, ak, margin, e, e[hk] + 55 - e[ak] AS ahead FROM (SELECT CASE WHEN fresh THEN list_transform(e, lambda x: 1500.0::DOUBLE + 0.75::DOUBLE * (x - 1500)) ELSE e END AS e, g.* FROM el JOIN gm g ON g.i = el.i + 1) g))),
walk AS MATERIALIZED (SELECT g.game_id, g.season, g.slate, home, away, hb, ab, move FROM el JOIN gm g USING (i)),
elo_rows AS (SELECT game_id, season, slate, home AS team, hb AS b, hb + move AS af FROM walk UNION ALL SELECT game_id, season, slate, away, ab, ab - move FROM walk),
elo_at AS MATERIALIZED (SELECT season, slate, team, arg_min(b, game_id) AS elo FROM elo_rows GROUP BY ALL)"""


#: The same with every season a pool of its own.
ELO_BY_SEASON = ELO.replace("1500.0::DOUBLE + 0.75::DOUBLE * (x - 1500)", "1500.0::DOUBLE")


def r(x: str, places: int = 4) -> str:
    """Rounding that both engines do alike."""
    k = 10**places
    return f"floor(({x}) * {k}.0 + 0.500001) / {k}.0"


def div(a: str, b: str, default: str = "0.0", places: int = 4) -> str:
    return r(f"CASE WHEN ({b}) <> 0 THEN ({a})::DOUBLE / ({b}) ELSE {default} END", places)
