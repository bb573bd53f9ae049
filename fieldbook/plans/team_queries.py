"""Queries of teams, people, money and names, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldbook.functions import scalars as X
from fieldbook.operators import elo as EL
from fieldbook.operators import lookup as LK
from fieldbook.operators import match as M
from fieldbook.operators import people as PP
from fieldbook.operators import sides as S
from fieldbook.plans.contest_queries import plays_of, sides_of
from fieldbook.plans.contest_sql import ELO, PLAYS, SIDES, book, div, r
from fieldbook.plans.form_queries import book_of, walk_of
from fieldbook.operators import ratings as R
from fieldbook.plans.live_queries import _KEY, read
from fieldbook.sources import pages as P
from fieldbook.sources.store import stored

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- money


def payroll_of(spark: SparkSession, d: str) -> DataFrame:
    """Point estimates of each nation: its suppliers' balances, in ten-thousands; the tier is the region."""
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    points = s.join(n.hint("merge"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("team"), F.concat(F.lit("tier"), F.col("n_regionkey")).alias("tier"), F.floor(F.abs("s_acctbal") * 1000).cast("double").alias("amount"))
    return PP.payroll_estimate(points, {"tier0": 2_000_000, "tier1": 5_000_000, "tier2": 1_000_000, "tier3": 3_000_000})


_MONEY = """po AS (SELECT n_name AS team, 'tier' || n_regionkey AS tier, floor(abs(s_acctbal) * 1000)::DOUBLE AS amount FROM supplier JOIN nation ON s_nationkey = n_nationkey),
pa AS (SELECT team, tier, quantile_cont(amount, 0.5) AS med, count(*) AS n FROM po GROUP BY ALL),
money AS (SELECT team, (round(greatest(med, CASE tier WHEN 'tier0' THEN 2000000 WHEN 'tier1' THEN 5000000 WHEN 'tier2' THEN 1000000 WHEN 'tier3' THEN 3000000 ELSE 0 END) / 10000) * 10000)::BIGINT AS amount, CASE WHEN n >= 3 THEN 'good' WHEN n = 2 THEN 'fair' ELSE 'thin' END AS quality FROM pa)"""


@query("a32_payroll_estimates", f"WITH {_MONEY} SELECT * FROM money")
def payroll(spark, d):
    return payroll_of(spark, d)


@query("j11_q13_money_and_rating", f"""WITH RECURSIVE {SIDES}, {book()}, {ELO}, {_MONEY}, fz AS (SELECT n_name AS team, n_nationkey * 100000 + 1000000 AS amount FROM nation WHERE n_nationkey % 3 = 0),
 el2 AS (SELECT season, team, arg_max(af, slate * 100000000 + game_id % 100000000) AS elo FROM elo_rows GROUP BY ALL), b AS (SELECT season, team, pom FROM book WHERE cutoff = 99), l AS (SELECT season + 1 AS season, team, pom AS was FROM b)
 SELECT b.season, b.team, {r('b.pom / 100.0::DOUBLE', 2)} AS pom, {r('was / 100.0::DOUBLE', 2)} AS last_pom, coalesce(fz.amount, money.amount)::BIGINT AS payroll, {r('coalesce(elo, 1500.0)', 2)} AS elo FROM b LEFT JOIN money USING (team) LEFT JOIN fz USING (team) LEFT JOIN el2 USING (season, team) LEFT JOIN l USING (season, team)""")
def money_and_rating(spark, d):
    """Ratings with payroll (a frozen table where it has the team, else the estimate), Elo, and last season's rating."""
    b = book_of(spark, d).where("cutoff = 99").select("season", "team", "pom")
    frozen = read(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("team"), (F.col("n_nationkey") * 100_000 + 1_000_000).cast("long").alias("frozen"))
    money = payroll_of(spark, d).select("team", "amount")
    last = b.select((F.col("season") + 1).alias("season"), "team", F.col("pom").alias("was"))
    elo = R.elo_snapshots(walk_of(spark, d))
    out = b.join(money.hint("merge"), "team", "left").join(frozen.hint("merge"), "team", "left").join(elo.hint("merge"), ["season", "team"], "left").join(last.hint("merge"), ["season", "team"], "left")
    two = lambda c: X.portable_round(c, 2)
    return out.select("season", "team", two(F.col("pom") / 100.0).alias("pom"), two(F.col("was") / 100.0).alias("last_pom"), F.coalesce("frozen", "amount").alias("payroll"), two(F.coalesce("elo", F.lit(1500.0))).alias("elo"))


@query("m27_a37_payroll_slope", f"""WITH {SIDES}, {_MONEY}, g AS (SELECT season, ln(h.amount::DOUBLE / a.amount) AS x, (home_points - away_points)::DOUBLE AS y FROM games JOIN money h ON h.team = home JOIN money a ON a.team = away),
 f AS (SELECT season, count(*) AS n, sum(x * y) / sum(x * x) AS b FROM g GROUP BY season HAVING count(*) >= 20)
 SELECT f.season, f.n, {r('f.b', 3)} AS slope, count(*) AS next_n, {r('sum((y - b * x) * (y - b * x)) / count(*)', 2)} AS next_mse, {r('sum(y * y) / count(*)', 2)} AS plain_mse FROM f JOIN g ON g.season = f.season + 1 GROUP BY ALL HAVING count(*) >= 20""")
def payroll_slope(spark, d):
    """The margin on the log ratio of payrolls without an intercept, fitted on a season and scored on the next."""
    money = payroll_of(spark, d).select("team", "amount")
    g = S.listed_games(sides_of(spark, d)).select("season", "home", "away", F.col("margin").cast("double").alias("y"))
    for side in ("home", "away"):
        g = g.join(money.select(F.col("team").alias(side), F.col("amount").alias(f"{side}_money")).hint("merge"), side)
    g = g.select("season", F.log(F.col("home_money").cast("double") / F.col("away_money")).alias("x"), "y")
    n = F.count(F.lit(1))
    fit = g.groupBy("season").agg(n.alias("n"), (F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("b")).where("n >= 20")
    e = F.col("y") - F.col("b") * F.col("x")
    met = g.select((F.col("season") - 1).alias("season"), "x", "y").join(fit.hint("merge"), "season")
    out = met.groupBy("season", "n", "b").agg(n.alias("next_n"), X.portable_round(F.sum(e * e) / n, 2).alias("next_mse"), X.portable_round(F.sum(F.col("y") * F.col("y")) / n, 2).alias("plain_mse"))
    return out.where("next_n >= 20").select("season", "n", X.portable_round("b", 3).alias("slope"), "next_n", "next_mse", "plain_mse")


# ---------------------------------------------------------------- boards


@query("r11_week_zero_board", f"""WITH {SIDES}, {book()} SELECT season + 1 AS season, team, {r('pom / 100.0::DOUBLE', 2)} AS pom, row_number() OVER (PARTITION BY season ORDER BY floor(pom + 0.500001) DESC, team) AS rank, 0 AS games FROM book WHERE cutoff = 99""")
def week_zero(spark, d):
    """A season's board before its first contest: last season's final values, ranked anew."""
    b = book_of(spark, d).where("cutoff = 99")
    w = Window.partitionBy("season").orderBy(F.desc(F.floor(F.col("pom") + 0.500001)), "team")
    return b.select((F.col("season") + 1).alias("season"), "team", X.portable_round(F.col("pom") / 100.0, 2).alias("pom"), F.row_number().over(w).alias("rank"), F.lit(0).alias("games"))


@query("r12_live_projection", f"""WITH RECURSIVE {SIDES}, {book()}, {ELO}, f AS (SELECT season, team, pom / 100.0::DOUBLE AS pom FROM book WHERE cutoff = 99), e AS (SELECT season, team, arg_max(af, slate * 100000000 + game_id % 100000000) AS elo FROM elo_rows GROUP BY ALL),
 p AS (SELECT f.season + 1 AS season, f.team, pom, 1500 + 0.75::DOUBLE * (coalesce(elo, 1500) - 1500) AS elo FROM f LEFT JOIN e USING (season, team)),
 g AS (SELECT g.game_id, g.season, coalesce(h.pom, -8.0) - coalesce(a.pom, -8.0) + 2.5::DOUBLE AS m, coalesce(h.elo, 1500.0) - coalesce(a.elo, 1500.0) AS d FROM games g LEFT JOIN p h ON h.season = g.season AND h.team = home LEFT JOIN p a ON a.season = g.season AND a.team = away)
 SELECT game_id, season, {r('m', 2)} AS pred_margin, {r('1.0 / (1.0 + exp(-m / 14.5::DOUBLE))')} AS p, {r('d', 2)} AS elo_diff FROM g""")
def live_projection(spark, d):
    """A season seen from before it: the last one's final book and Elo drawn to the mean, nothing of its own contests."""
    f = book_of(spark, d).where("cutoff = 99").select("season", "team", (F.col("pom") / 100.0).alias("pom"))
    e = R.elo_snapshots(walk_of(spark, d))
    p = f.join(e.hint("merge"), ["season", "team"], "left").select((F.col("season") + 1).alias("ps"), F.col("team").alias("pt"), "pom", (EL.MEAN + EL.CARRY * (F.coalesce("elo", F.lit(EL.MEAN)) - EL.MEAN)).alias("elo"))
    g = S.listed_games(sides_of(spark, d)).select("game_id", "season", "home", "away")
    for side in ("home", "away"):
        g = g.join(p.hint("merge"), F.expr(f"season = ps and {side} = pt"), "left").drop("ps", "pt").withColumnsRenamed({"pom": f"{side}_pom", "elo": f"{side}_elo"})
    m = F.coalesce("home_pom", F.lit(-8.0)) - F.coalesce("away_pom", F.lit(-8.0)) + 2.5
    return g.select("game_id", "season", X.portable_round(m, 2).alias("pred_margin"), X.portable_round(X.win_probability(m)).alias("p"), X.portable_round(F.coalesce("home_elo", F.lit(1500.0)) - F.coalesce("away_elo", F.lit(1500.0)), 2).alias("elo_diff"))


@query("j12_q3_team_dossier", f"""WITH {SIDES}, {book()}, {_MONEY}, o AS (SELECT team, count(DISTINCT opponent) AS opponents FROM sides WHERE season = 2000 GROUP BY team),
 l AS (SELECT team, array_to_string(list(season || ':' || slate || ':' || opponent || ':' || margin ORDER BY slate DESC, game_id DESC)[1:24], ' ') AS recent FROM sides WHERE season = 2000 GROUP BY team), asked AS (SELECT unnest(['NATION_3', 'NATION_11', 'ATLANTIS']) AS asked)
 SELECT asked, b.team IS NULL AS missing, {r('pom / 100.0::DOUBLE', 2)} AS pom, amount AS payroll, opponents, recent FROM asked LEFT JOIN (SELECT * FROM book WHERE cutoff = 99 AND season = 2000) b ON b.team = asked LEFT JOIN money ON money.team = asked LEFT JOIN o ON o.team = asked LEFT JOIN l ON l.team = asked""")
def team_dossiers(spark, d):
    """Several teams side by side: rating, money, opponents, the last contests; names that no team has are said to be missing."""
    two = sides_of(spark, d).where("season = 2000")
    asked = spark.createDataFrame([("NATION_3",), ("NATION_11",), ("ATLANTIS",)], "asked string")
    item = F.struct("slate", "game_id", F.concat_ws(":", "season", "slate", "opponent", "margin").alias("x"))
    per = two.groupBy("team").agg(F.countDistinct("opponent").alias("opponents"), F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(item), asc=False), 1, 24), lambda s: s["x"]), " ").alias("recent"))
    b = book_of(spark, d).where("cutoff = 99 and season = 2000").select("team", "pom")
    known = b.join(payroll_of(spark, d).select("team", F.col("amount").alias("payroll")).hint("merge"), "team", "left").join(per.hint("merge"), "team", "left")
    out = asked.join(known.hint("merge"), F.col("asked") == F.col("team"), "left")
    return out.select("asked", F.col("team").isNull().alias("missing"), X.portable_round(F.col("pom") / 100.0, 2).alias("pom"), "payroll", "opponents", "recent")


_UNITS = [("pass_ypp", "py", "pn"), ("rush_ypp", "ry", "rn"), ("yards_per_play", "y", "n"), ("plays_per_game", "n", "g"), ("pass_share", "pn", "n"), ("third_rate", "tc", "tn")]


@query("a31_unit_rates", f"""WITH {PLAYS}, u AS (SELECT season, pos AS team, sum(yards) FILTER (pass) AS py, count(*) FILTER (pass) AS pn, sum(yards) FILTER (rush) AS ry, count(*) FILTER (rush) AS rn, sum(yards) AS y, count(*) AS n, count(DISTINCT game_id) AS g,
  count(*) FILTER (num % 4 = 3) AS tn, count(*) FILTER (num % 4 = 3 AND yards >= 30) AS tc FROM plays WHERE pos_unit = 'Offense' GROUP BY ALL) SELECT season, team, {", ".join(f"CASE WHEN {b} > 0 THEN {r(f'coalesce({a}, 0)::DOUBLE / {b}')} END AS {n}" for n, a, b in _UNITS)} FROM u""")
def unit_rates(spark, d):
    """Null-safe rates of a team's units: every fourth play counts as a third down, made with thirty yards."""
    p, third = plays_of(spark, d).where("pos_unit = 'Offense'"), F.col("game_play_number") % 4 == 3
    pick = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    u = p.groupBy("season", F.col("pos").alias("team")).agg(pick(F.col("pass"), F.col("yards")).alias("py"), pick(F.col("pass"), 1).alias("pn"), pick(F.col("rush"), F.col("yards")).alias("ry"), pick(F.col("rush"), 1).alias("rn"), F.sum("yards").alias("y"),
                                                            F.count(F.lit(1)).alias("n"), F.countDistinct("game_id").alias("g"), pick(third, 1).alias("tn"), pick(third & (F.col("yards") >= 30), 1).alias("tc"))
    return u.select("season", "team", *[X.portable_round(F.try_divide(F.col(a), F.col(b))).alias(n) for n, a, b in _UNITS])


@query("a40_coverage", f"""WITH {PLAYS}, n AS (SELECT game_id, any_value(season) AS season, max(period) AS p, count(DISTINCT period) AS k FROM plays GROUP BY game_id) SELECT season, count(*) AS games, count(*) FILTER (k = 4) AS with_quarters, count(*) FILTER (p >= 4) AS completed FROM n GROUP BY season""")
def coverage(spark, d):
    n = plays_of(spark, d).groupBy("game_id").agg(F.first("season").alias("season"), F.max("period").alias("p"), F.countDistinct("period").alias("k"))
    return n.groupBy("season").agg(F.count(F.lit(1)).alias("games"), F.sum((F.col("k") == 4).cast("int")).alias("with_quarters"), F.sum((F.col("p") >= 4).cast("int")).alias("completed"))


@query("p6_top_offence", f"WITH {PLAYS}, c AS (SELECT k, div FROM nat) SELECT season, count(*) AS plays, count(*) FILTER (c.div = 'fbs') AS top_offence FROM plays JOIN c ON c.k = pk GROUP BY season")
def top_offence(spark, d):
    """Plays whose side with the ball is in the top division, told by the side's own division."""
    return plays_of(spark, d).groupBy("season").agg(F.count(F.lit(1)).alias("plays"), F.sum(S.top_offence().cast("int")).alias("top_offence"))


@query("t3_t9_boards", f"""WITH {SIDES}, m AS (SELECT team, avg(points) AS x, CASE WHEN count(*) >= 10 THEN avg(margin) END AS y FROM sides WHERE season = 2001 GROUP BY team), a AS (SELECT 'x' AS axis, team, x AS v, row_number() OVER (ORDER BY x DESC NULLS LAST, team) AS place FROM m UNION ALL SELECT 'y', team, y, row_number() OVER (ORDER BY y DESC NULLS LAST, team) FROM m)
 SELECT axis, team, {r('v', 3)} AS value, place FROM a WHERE place <= 6""")
def boards(spark, d):
    """The first six by each of two measures; teams without a measure come last."""
    m = sides_of(spark, d).where("season = 2001").groupBy("team").agg(F.avg("points").alias("x"), F.when(F.count(F.lit(1)) >= 10, F.avg("margin")).alias("y"))
    out = None
    for axis in ("x", "y"):
        one = m.select(F.lit(axis).alias("axis"), "team", X.portable_round(axis, 3).alias("value"), F.row_number().over(Window.orderBy(F.desc_nulls_last(axis), "team")).alias("place")).where("place <= 6")  # a row for each team
        out = one if out is None else out.unionByName(one)
    return out


@query("t1_boards_by_metric", f"""WITH {SIDES}, {book()}, c AS (SELECT season, team, any_value(conf) AS conf FROM sides GROUP BY ALL), v AS (SELECT season, team, unnest(['pom', 'adjo', 'adjd', 'tempo']) AS metric, unnest([pom, adjo, adjd, tempo]) AS value FROM book WHERE cutoff = 99)
 SELECT season, conf, metric, team, {r('value', 2)} AS value, row_number() OVER (PARTITION BY season, conf, metric ORDER BY CASE WHEN metric = 'adjd' THEN {r('value', 2)} ELSE -({r('value', 2)}) END, team) AS place FROM v JOIN c USING (season, team) QUALIFY place <= 5""")
def boards_by_metric(spark, d):
    """The first five of each conference, season and metric. What is allowed goes up, all else down."""
    conf = sides_of(spark, d).groupBy("season", "team").agg(F.first("conf").alias("conf"))
    one = lambda c: F.struct(F.lit(c).alias("metric"), X.portable_round(c, 2).alias("value"))
    v = book_of(spark, d).where("cutoff = 99").select("season", "team", F.explode(F.array(*[one(c) for c in ("pom", "adjo", "adjd", "tempo")])).alias("x")).select("season", "team", "x.*")
    w = Window.partitionBy("season", "conf", "metric").orderBy(F.when(F.col("metric") == "adjd", F.col("value")).otherwise(-F.col("value")), "team")
    return v.join(conf.hint("merge"), ["season", "team"]).withColumn("place", F.row_number().over(w)).where("place <= 5")


@query("a38_gain_share", f"WITH {SIDES}, m AS (SELECT season, team, sum(margin) AS v FROM sides GROUP BY ALL) SELECT season, team, {r('v::DOUBLE / sum(abs(v)) OVER (PARTITION BY season)', 5)} AS share FROM m")
def gain_share(spark, d):
    m = sides_of(spark, d).groupBy("season", "team").agg(F.sum("margin").alias("v"))
    return m.select("season", "team", X.portable_round(F.col("v") / F.sum(F.abs("v")).over(Window.partitionBy("season")), 5).alias("share"))


@query("u4_u5_u7_set_operations", f"WITH {SIDES}, a AS (SELECT DISTINCT season FROM sides WHERE season <= 1999), b AS (SELECT DISTINCT season FROM sides WHERE season >= 1998) SELECT 'both' AS part, season FROM a SEMI JOIN b USING (season) UNION ALL SELECT 'left', season FROM a ANTI JOIN b USING (season) UNION ALL SELECT 'all', season FROM (SELECT * FROM a UNION SELECT * FROM b)")
def set_operations(spark, d):
    s = sides_of(spark, d).select("season").distinct()
    a, b = s.where("season <= 1999"), s.where("season >= 1998")
    part = lambda n, x: x.select(F.lit(n).alias("part"), "season")
    return part("both", a.intersect(b)).unionByName(part("left", a.exceptAll(b))).unionByName(part("all", a.union(b).distinct()))


@query("j3_outer_spine", f"""WITH {PLAYS}, a AS (SELECT game_id, pos AS team, count(*) AS lost FROM plays WHERE turnover GROUP BY ALL), b AS (SELECT game_id, def AS team, count(*) AS taken FROM plays WHERE turnover AND points > 0 GROUP BY ALL)
 SELECT game_id, team, coalesce(lost, 0) AS lost, coalesce(taken, 0) AS taken FROM a FULL JOIN b USING (game_id, team)""")
def outer_spine(spark, d):
    """Keys of either kind of row, with nought where one is missing: one aggregate of conditional sums over both roles."""
    p = plays_of(spark, d).where("turnover")
    role = lambda who, lost, taken: p.select("game_id", F.col(who).alias("team"), lost.alias("lost"), taken.alias("taken"))
    both = role("pos", F.lit(1), F.lit(0)).unionByName(role("def", F.lit(0), (F.col("points") > 0).cast("int")))
    return both.groupBy("game_id", "team").agg(F.sum("lost").alias("lost"), F.sum("taken").alias("taken")).where("lost > 0 or taken > 0")


# ---------------------------------------------------------------- names


_ALIAS = "CASE n_regionkey WHEN 0 THEN 'the ' || n_name ELSE n_name || ' land' END"


@query("x2_j16_canonical_names", f"""WITH a AS (SELECT {_ALIAS} AS alias, n_name AS name FROM nation), q AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN {_ALIAS} WHEN 1 THEN n_name ELSE 'Miami' END AS raw, CASE WHEN s_suppkey % 2 = 0 THEN r_name END AS conf FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
 SELECT s_suppkey, coalesce(CASE WHEN raw = 'Miami' AND conf = 'AMERICA' THEN 'Miami (OH)' END, a.name, raw) AS name, left(conf, 3) AS abbr FROM q LEFT JOIN a ON a.alias = raw""")
def canonical_names(spark, d):
    """Names by an alias table, one of them by its conference, and conferences by their short name."""
    n, reg = read(spark, d, "nation"), read(spark, d, "region")
    alias = F.when(F.col("n_regionkey") == 0, F.concat(F.lit("the "), "n_name")).otherwise(F.concat("n_name", F.lit(" land")))
    table = n.select(alias.alias("alias"), F.col("n_name").alias("name"))
    q = read(spark, d, "supplier").join(n.hint("merge"), F.col("s_nationkey") == F.col("n_nationkey")).join(reg.hint("merge"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey") % 3
    q = q.select("s_suppkey", F.when(k == 0, alias).when(k == 1, F.col("n_name")).otherwise("Miami").alias("raw"), F.when(F.col("s_suppkey") % 2 == 0, F.col("r_name")).alias("conf"))
    return M.canonical(q, table, [("Miami", "AMERICA", "Miami (OH)")]).select("s_suppkey", "name", F.left("conf", F.lit(3)).alias("abbr"))


@query("q2_x5_resolve_query", f"""WITH q AS (SELECT unnest(['NATION_3', 'nation 2', 'Supplier', 'nat-ion 1']) AS query), k AS (SELECT n_name AS name, {_KEY('n_name')} AS key FROM nation), m AS (SELECT query, {_KEY('query')} AS qk, name, key FROM q, k),
 t AS (SELECT query, name, 0 AS tier FROM m WHERE qk = key UNION ALL SELECT query, name, 1 FROM m WHERE contains(key, qk) OR contains(qk, key) UNION ALL SELECT query, name, 2 FROM m WHERE left(key, 4) = left(qk, 4)),
 b AS (SELECT * FROM t QUALIFY tier = min(tier) OVER (PARTITION BY query)) SELECT query, tier, name, row_number() OVER (PARTITION BY query ORDER BY name) AS place FROM b QUALIFY place <= 8""")
def resolve_query(spark, d):
    index = stored(spark, d, "team-names", lambda: LK.index_names(read(spark, d, "nation").select(F.lit("team").alias("kind"), F.col("n_name").alias("name"))))
    asked = spark.createDataFrame([(x,) for x in ("NATION_3", "nation 2", "Supplier", "nat-ion 1")], "query string")
    return LK.resolve(index, asked)


@query("x10_a36_after_catch", f"""WITH {PLAYS}, ab AS (SELECT k, chr((65 + k % 26)::INT) || chr((65 + (k * 7) % 26)::INT) || 'X' AS abbr FROM nat), t AS (SELECT s.game_id, s.num, s.yards, p.abbr AS own, o.abbr AS other, CASE num % 4 WHEN 0 THEN lower(p.abbr) WHEN 1 THEN o.abbr WHEN 2 THEN 'ZZZ' ELSE o.abbr END AS token, num % 49 + 1 AS spot, yards + 20 AS togo FROM plays s JOIN ab p ON p.k = pk JOIN ab o ON o.k = dk WHERE pass),
 y AS (SELECT game_id, num, yards - (togo - CASE WHEN upper(token) = own THEN 100 - spot WHEN upper(token) = other THEN spot END) AS v FROM t) SELECT game_id, num AS play, v::DOUBLE AS after_catch FROM y WHERE v BETWEEN -4 AND 80""")
def after_catch(spark, d):
    n = read(spark, d, "nation")
    k = F.col("n_nationkey")
    ab = n.select(F.col("n_name").alias("name"), F.concat(F.char(65 + k % 26), F.char(65 + (k * 7) % 26), F.lit("X")).alias("abbr"))
    p = plays_of(spark, d).where("pass").select("game_id", F.col("game_play_number").alias("play"), "yards", "pos", "def")
    p = p.join(ab.select(F.col("name").alias("pos"), F.col("abbr").alias("own")).hint("merge"), "pos").join(ab.select(F.col("name").alias("def"), F.col("abbr").alias("other")).hint("merge"), "def")
    i = F.col("play") % 4
    token = F.when(i == 0, F.lower("own")).when(i == 2, "ZZZ").otherwise(F.col("other"))
    text = F.concat(F.lit("pass complete, Caught at "), F.when(i == 1, "the ").otherwise(""), token, F.lit(" "), F.col("play") % 49 + 1)
    return p.select("game_id", "play", X.after_catch(text, F.col("yards").cast("double"), F.col("own"), F.col("other"), F.col("yards") + 20.0).alias("after_catch")).where("after_catch is not null")


@query("a36_modal_abbreviation", "WITH t AS (SELECT n_name AS team, CASE WHEN l_linenumber % 4 = 0 THEN 'OTH' ELSE 'N' || (n_nationkey % 10) || 'A' END AS abbr FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey), c AS (SELECT team, abbr, count(*) AS n FROM t GROUP BY ALL) SELECT team, arg_min(abbr, {'n': -n, 'a': abbr}) AS abbr FROM c GROUP BY team")
def modal_abbreviation(spark, d):
    """The most frequent abbreviation in a team's play texts; of equally frequent ones the first."""
    l, s, n = (read(spark, d, t) for t in ("lineitem", "supplier", "nation"))
    t = l.join(s.hint("merge"), F.col("l_suppkey") == F.col("s_suppkey")).join(n.hint("merge"), F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.concat(F.lit("kick to the "), F.when(F.col("l_linenumber") % 4 == 0, "OTH").otherwise(F.concat(F.lit("N"), F.col("n_nationkey") % 10, F.lit("A"))), F.lit(" 25"))
    return M.modal_token(t.select(F.col("n_name").alias("team"), text.alias("text")), r"the ([A-Z0-9]{2,4}) \d+", "abbr")


# ---------------------------------------------------------------- people


def roster_of(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").join(read(spark, d, "nation").hint("merge"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("pid"), F.col("c_name").alias("name"), F.col("n_name").alias("team"), (F.col("c_custkey") % 5).alias("class_year"), F.col("c_mktsegment").alias("city"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("state"))


@query("x24_labels", """SELECT c_custkey AS pid, CASE c_custkey % 5 WHEN 1 THEN 'FR' WHEN 2 THEN 'SO' WHEN 3 THEN 'JR' WHEN 4 THEN 'SR' END AS class, concat_ws(', ', c_mktsegment, CASE WHEN c_custkey % 7 <> 0 THEN 'R' || n_regionkey END) AS home FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def labels(spark, d):
    p = roster_of(spark, d)
    return p.select("pid", X.class_label(F.col("class_year")).alias("class"), X.home_town(F.col("city"), F.when(F.col("pid") % 7 != 0, F.col("state"))).alias("home"))


@query("s12_p19_t10_draft", """WITH p AS (SELECT o_orderkey AS overall, year(o_orderdate) AS year, o_orderkey % 7 + 1 AS round, CASE o_orderkey % 3 WHEN 0 THEN 'Defensive Lineman' WHEN 1 THEN 'Quarterback' ELSE 'Wide Receiver' END AS position, c_mktsegment AS college FROM orders JOIN customer ON o_custkey = c_custkey)
 SELECT year, round, overall, position, college FROM p WHERE round = 2 AND year = 1998 AND position = 'Defensive Lineman' AND college = 'BUILDING' ORDER BY overall LIMIT 40""")
def draft(spark, d):
    """Picks of a year and round at a position by its short name; yearly files write the college's field in two ways."""
    o = read(spark, d, "orders").join(read(spark, d, "customer").hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey") % 3
    base = o.select(F.col("o_orderkey").alias("overall"), F.year("o_orderdate").alias("year"), (F.col("o_orderkey") % 7 + 1).alias("round"), F.when(k == 0, "Defensive Lineman").when(k == 1, "Quarterback").otherwise("Wide Receiver").alias("position"), F.col("c_mktsegment").alias("college"))
    old, new = base.where("year % 2 = 0").withColumnRenamed("college", "collegeTeam"), base.where("year % 2 = 1").withColumnRenamed("college", "college_team")
    return PP.draft_list(PP.draft_index([old, new]), year=1998, round_=2, position="DL", college="building")


@query("j7_q10_player", f"""WITH ro AS (SELECT c_custkey AS pid, c_name AS name, n_name AS team FROM customer JOIN nation ON c_nationkey = n_nationkey), us AS (SELECT o_custkey AS pid, max(o_totalprice) AS usage FROM orders WHERE year(o_orderdate) = 1998 GROUP BY ALL),
 mv AS (SELECT o_custkey AS pid, count(*) AS moves FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL) SELECT ro.pid, name, team, usage, coalesce(moves, 0) AS moves FROM ro LEFT JOIN us USING (pid) LEFT JOIN mv USING (pid) WHERE {_KEY('name')} LIKE '%00000001%'""")
def player(spark, d):
    """Dossiers of players whose name holds the text: roster, usage of a season, and moves, which follow the person."""
    ro = roster_of(spark, d)
    names = ro.select("pid", "name", "team")
    o = read(spark, d, "orders").join(names.hint("merge"), F.col("o_custkey") == F.col("pid"))
    usage = o.where(F.year("o_orderdate") == 1998).select("name", "team", F.col("o_totalprice").alias("usage"))
    stats = names.select(F.col("name").alias("player"), "team", F.create_map(F.lit("all"), F.lit(1.0)).alias("stats"))
    none = names.limit(0).select("name", F.lit(1).alias("year"), F.lit(1).alias("stars"))
    moves = o.where("o_orderstatus = 'P'").select("name", F.year("o_orderdate").alias("season"), F.lit("a").alias("origin"), F.lit("b").alias("destination"))
    all_ = PP.dossiers(names.where(F.contains(X.name_key(F.col("name")), F.lit("00000001"))), usage, stats, none, moves)
    return all_.select("pid", "name", "team", "usage", F.coalesce(F.when(F.size("moves") >= 0, F.size("moves")), F.lit(0)).cast("long").alias("moves"))


@query("q9_drafted", f"""WITH q AS (SELECT c_name AS asked, 1997 AS year FROM customer WHERE c_custkey % 97 = 0), p AS (SELECT o_orderkey AS overall, year(o_orderdate) AS year, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey)
 SELECT asked, p.year, overall FROM q JOIN p ON {_KEY('asked')} = {_KEY('name')} AND p.year BETWEEN q.year AND q.year + 1 QUALIFY row_number() OVER (PARTITION BY asked ORDER BY p.year, overall) = 1""")
def drafted(spark, d):
    """The draft entry of names; a year means that year or the next."""
    c = read(spark, d, "customer")
    picks = read(spark, d, "orders").join(c.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("overall"), F.year("o_orderdate").alias("year"), F.col("c_name").alias("name"))
    asked = c.where("c_custkey % 97 = 0").select(F.col("c_name").alias("asked"), F.lit(1997).alias("wanted"))
    return PP.drafted(asked, picks)


@query("q12_open_top_hit", f"""WITH e AS (SELECT 'nation' AS kind, n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier), s AS (SELECT *, CASE WHEN {_KEY('name')} = 'nation 3' THEN 0 WHEN contains({_KEY('name')}, 'nation 3') THEN 1 WHEN split_part({_KEY('name')}, ' ', -1) = '3' THEN 2 END AS score FROM e),
 t AS (SELECT * FROM s WHERE score IS NOT NULL ORDER BY score, kind, name LIMIT 1) SELECT t.kind, t.name, n.n_regionkey AS region FROM t LEFT JOIN nation n ON t.kind = 'nation' AND n.n_nationkey = t.id""")
def open_top_hit(spark, d):
    """The best hit over several kinds, opened in its own table."""
    n = read(spark, d, "nation")
    e = n.select(F.lit("nation").alias("kind"), F.col("n_name").alias("name")).unionByName(read(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name")))
    top = M.search(e, "NATION_3", 1)
    return top.join(n.hint("merge"), (F.col("kind") == "nation") & (F.col("name") == F.col("n_name")), "left").select("kind", "name", F.col("n_regionkey").alias("region"))


# ---------------------------------------------------------------- free text


@query("x27_pick_text", r"""WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role || ' ML' WHEN 1 THEN role || ' -' || (turn % 20) || '.5' ELSE text END AS s FROM conversations),
 k AS (SELECT *, CASE WHEN regexp_matches(lower(s), '\bml\s*$') THEN 'ml' WHEN regexp_extract(s, '([+-]\d+(?:\.\d+)?)\s*$', 1) <> '' THEN 'line' END AS kind FROM t)
 SELECT conv_id, turn, kind, CASE WHEN kind IS NOT NULL THEN trim(regexp_replace(s, '(?i)\s*(ml|[+-]\d+(?:\.\d+)?)\s*$', '')) END AS name, CASE WHEN kind = 'line' THEN regexp_extract(s, '([+-]\d+(?:\.\d+)?)\s*$', 1)::DOUBLE END AS line FROM k""")
def pick_text(spark, d):
    """Picks in free text; a text that is none, a null one too, has neither kind nor name."""
    c = read(spark, d, "conversations")
    k = F.col("turn") % 3
    s = F.when(k == 0, F.concat("role", F.lit(" ML"))).when(k == 1, F.concat("role", F.lit(" -"), F.col("turn") % 20, F.lit(".5"))).otherwise(F.col("text"))
    name, kind, line = X.pick_text(s)
    return c.select("conv_id", "turn", kind.alias("kind"), F.when(kind.isNotNull(), name).alias("name"), line.alias("line"))


@query("x31_lenient_numbers", "SELECT page_id, try_cast(regexp_replace(CASE page_id % 4 WHEN 0 THEN '$' || page_id || ',000' WHEN 1 THEN page_id || '.25' WHEN 2 THEN 'n/a' END, '[$,]', '', 'g') AS DOUBLE) AS value FROM pages")
def lenient_numbers(spark, d):
    k = F.col("page_id") % 4
    text = F.when(k == 0, F.concat(F.lit("$"), "page_id", F.lit(",000"))).when(k == 1, F.concat("page_id", F.lit(".25"))).when(k == 2, "n/a")
    return read(spark, d, "pages").select("page_id", X.number(text).alias("value"))


@query("s14_user_slate", f"""WITH {SIDES} SELECT game_id, slate AS week, away, home, CASE WHEN game_id % 4 = 0 THEN NULL ELSE (game_id % 21 - 10) / 2.0::DOUBLE END AS line, CASE game_id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' ELSE 'prose' END AS form FROM games WHERE season = 2001""")
def user_slate(spark, d):
    """A user's rows in three forms (CSV with quotes, JSON with other field names, prose), read as one table."""
    g = S.listed_games(sides_of(spark, d).where("season = 2001")).select("game_id", "slate", "away", "home", F.when(F.col("game_id") % 4 != 0, (F.col("game_id") % 21 - 10) / 2.0).alias("line"))
    num = F.coalesce(F.col("line").cast("string"), F.lit(""))
    csv = F.concat("slate", F.lit(',"'), "away", F.lit('","'), "home", F.lit('",'), num)
    js = F.to_json(F.struct(F.col("slate").alias("wk"), F.col("away").alias("visitor"), F.col("home").alias("home_team"), F.col("line").alias("spread")))
    prose = F.concat(F.lit("week "), "slate", F.lit(": "), "away", F.lit(" at "), "home", F.lit(" "), F.when(F.col("line") >= 0, F.concat(F.lit("+"), num)).otherwise(num))
    lines = g.select("game_id", F.when(F.col("game_id") % 3 == 0, csv).when(F.col("game_id") % 3 == 1, js).otherwise(prose).alias("value"))
    return P.user_rows(lines)


@query("s13_cost_pages", r"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a href="[^"]*">([^<]*)</a>', 1)) AS cell FROM pages WHERE html IS NOT NULL) SELECT page_id, 'roster' AS route, count(*) AS cells FROM c GROUP BY page_id""")
def cost_pages(spark, d):
    """Link lists of pages routed by what their cells look like."""
    return P.routed(read(spark, d, "pages"))


@query("a22_engine_counts", f"""WITH {SIDES} SELECT season, CASE WHEN game_id % 5 = 0 THEN 'prior' WHEN game_id % 7 = 0 THEN 'carried' ELSE 'logistic' END AS engine, count(*) AS n FROM games GROUP BY ALL""")
def engine_counts(spark, d):
    g = S.listed_games(sides_of(spark, d))
    return g.groupBy("season", F.when(F.col("game_id") % 5 == 0, "prior").when(F.col("game_id") % 7 == 0, "carried").otherwise("logistic").alias("engine")).agg(F.count(F.lit(1)).alias("n"))


@query("a35_passing_board", f"""WITH {PLAYS}, n AS (SELECT season, player, pos AS team, count(*) AS attempts, count(*) FILTER (yards >= 10) AS completions, sum(yards)::BIGINT AS yards, sum(epa)::BIGINT AS epa FROM plays WHERE pass AND pos_unit = 'Offense' GROUP BY ALL HAVING count(*) >= 3)
 SELECT *, row_number() OVER (PARTITION BY season ORDER BY yards DESC, attempts DESC, player, team) AS rank, {div("yards", "attempts")} AS per_attempt FROM n QUALIFY rank <= 60""")
def passing_board(spark, d):
    from fieldbook.operators import snaps as N

    return N.passing_board(plays_of(spark, d))


@query("q8_average_after_catch", f"""WITH {PLAYS}, c AS (SELECT season, player, count(*) AS n, sum(yards - 20)::BIGINT AS y FROM plays WHERE pass AND yards >= 20 GROUP BY ALL HAVING count(*) >= 10)
 SELECT season, player, n, {div("y", "n", places=2)} AS average, row_number() OVER (PARTITION BY season ORDER BY {div("y", "n", places=2)} DESC, player) AS place FROM c QUALIFY place <= 10""")
def average_after_catch(spark, d):
    """Players by the mean of what they gain past the first twenty yards, ten plays at least."""
    c = plays_of(spark, d).where(F.col("pass") & (F.col("yards") >= 20)).groupBy("season", "player").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("yards") - 20).alias("y")).where("n >= 10")
    c = c.select("season", "player", "n", X.portable_round(X.ratio(F.col("y"), F.col("n")), 2).alias("average"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("season").orderBy(F.desc("average"), "player"))).where("place <= 10")


@query("a29_conference_elo", f"""WITH RECURSIVE {SIDES}, {book()}, {ELO}, e AS (SELECT season, team, arg_max(af, slate * 100000000 + game_id % 100000000) AS elo FROM elo_rows GROUP BY ALL), t AS (SELECT season, team, any_value(conf) AS conf, count(*) FILTER (margin > 0) AS w, count(*) FILTER (margin < 0) AS l FROM sides GROUP BY ALL)
 SELECT t.season, conf, count(*) AS teams, {r("avg(coalesce(pom, 0) / 100.0::DOUBLE)", 2)} AS mean_pom, {r("avg(coalesce(elo, 1500.0))", 2)} AS mean_elo, sum(w)::BIGINT AS wins, sum(l)::BIGINT AS losses FROM t LEFT JOIN e USING (season, team) LEFT JOIN (SELECT season, team, pom FROM book WHERE cutoff = 99) b USING (season, team) GROUP BY ALL""")
def conference_elo(spark, d):
    """Means of final rating and Elo by conference, with summed records; an unknown team counts as 0 and 1500."""
    t = sides_of(spark, d).groupBy("season", "team").agg(F.first("conf").alias("conf"), F.sum((F.col("margin") > 0).cast("int")).alias("w"), F.sum((F.col("margin") < 0).cast("int")).alias("l"))
    t = t.join(R.elo_snapshots(walk_of(spark, d)).hint("merge"), ["season", "team"], "left").join(book_of(spark, d).where("cutoff = 99").select("season", "team", "pom").hint("merge"), ["season", "team"], "left")
    return t.groupBy("season", "conf").agg(F.count(F.lit(1)).alias("teams"), X.portable_round(F.avg(F.coalesce("pom", F.lit(0.0)) / 100.0), 2).alias("mean_pom"), X.portable_round(F.avg(F.coalesce("elo", F.lit(1500.0))), 2).alias("mean_elo"), F.sum("w").alias("wins"), F.sum("l").alias("losses"))


def name_index(spark, d) -> DataFrame:
    """Names of all kinds by their pieces, written once."""

    def make() -> DataFrame:
        one = lambda k, t, c: read(spark, d, t).select(F.lit(k).alias("kind"), c.alias("name"))
        e = one("team", "nation", F.col("n_name")).unionByName(one("player", "customer", F.col("c_name"))).unionByName(one("draft", "orders", F.concat(F.lit("Order "), "o_orderkey")))
        return LK.index_names(e.unionByName(one("part", "part", F.concat("p_name", F.lit(" "), "p_partkey"))))

    return stored(spark, d, "names", make)


@query("q11_cross_search", f"""WITH e AS (SELECT 'team' AS kind, n_name AS name FROM nation UNION ALL SELECT 'player', c_name FROM customer UNION ALL SELECT 'draft', 'Order ' || o_orderkey FROM orders UNION ALL SELECT 'part', p_name || ' ' || p_partkey FROM part), s AS (SELECT kind, name, CASE WHEN {_KEY('name')} = 'order 12' THEN 0 WHEN contains({_KEY('name')}, 'order 12') THEN 1 WHEN split_part({_KEY('name')}, ' ', -1) = '12' THEN 2 END AS score FROM e)
 SELECT * FROM s WHERE score IS NOT NULL ORDER BY score, kind, name LIMIT 20""")
def cross_search(spark, d):
    asked = spark.createDataFrame([("Order 12",)], "query string")
    return LK.find(name_index(spark, d), asked).select("kind", "name", "score")


@query("s2_s3_module_scans", f"WITH {SIDES} SELECT season, sum(tempo)::BIGINT AS plays, count(*) AS games FROM games GROUP BY season")
def module_scans(spark, d):
    """Seasons scanned one by one with a short list of columns, a column that one lacks included, and put together again."""
    from fieldbook.sources.contests import seasons

    p = sides_of(spark, d).where("is_home").select("season", "game_id", "tempo")
    parts = [p.where("season < 1998"), p.where("season >= 1998").withColumn("extra", F.lit(1))]
    return seasons(parts).groupBy("season").agg(F.sum("tempo").alias("plays"), F.count(F.lit(1)).alias("games"))
