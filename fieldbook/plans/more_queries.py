"""Feature menus, grading, conference tables and lists, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import scalars as X
from fieldbook.operators import sides as S
from fieldbook.plans.contest_queries import sides_of
from fieldbook.plans.contest_sql import SIDES, div, r
from fieldbook.plans.model_queries import _PRED, predictions_of

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("a25_scorecard", f"""WITH {_PRED}, w AS (SELECT *, season * 100 + slate AS day FROM pred), s AS (SELECT 'to date' AS part, * FROM w UNION ALL SELECT 'last' AS part, * FROM w WHERE day = (SELECT max(day) FROM w))
 SELECT part, count(*) AS n, count(*) FILTER ((p >= 0.5) = (won = 1)) AS wins, {r("sum((p - won) * (p - won)) / count(*)")} AS brier, max(day) AS day FROM s GROUP BY part""")
def scorecard(spark, d):
    w = predictions_of(spark, d).withColumn("day", F.col("season") * 100 + F.col("slate"))
    last = w.agg(F.max("day").alias("last"))
    s = w.withColumn("part", F.lit("to date")).unionByName(w.join(F.broadcast(last), F.col("day") == F.col("last")).drop("last").withColumn("part", F.lit("last")))  # one row
    right = ((F.col("p") >= 0.5) == (F.col("won") == 1)).cast("int")
    return s.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("wins"), X.portable_round(F.sum((F.col("p") - F.col("won")) * (F.col("p") - F.col("won"))) / F.count(F.lit(1))).alias("brier"), F.max("day").alias("day"))


@query("a29_conference_means", f"""WITH {SIDES}, t AS (SELECT season, conf, team, sum(margin) AS m, count(*) AS g, count(*) FILTER (margin > 0) AS w FROM sides GROUP BY ALL)
 SELECT season, conf, count(*) AS teams, {r("sum(m::DOUBLE / g) / count(*)", 3)} AS mean_margin, sum(w)::BIGINT AS wins, sum(g - w)::BIGINT AS others FROM t GROUP BY ALL""")
def conference_means(spark, d):
    t = sides_of(spark, d).groupBy("season", "conf", "team").agg(F.sum("margin").alias("m"), F.count(F.lit(1)).alias("g"), F.sum((F.col("margin") > 0).cast("int")).alias("w"))
    return t.groupBy("season", "conf").agg(F.count(F.lit(1)).alias("teams"), X.portable_round(F.sum(F.col("m") / F.col("g")) / F.count(F.lit(1)), 3).alias("mean_margin"), F.sum("w").alias("wins"), F.sum(F.col("g") - F.col("w")).alias("others"))


@query("a39_g5_scaled", f"""WITH {SIDES}, t AS (SELECT season, team, count(*) FILTER (margin > 0)::DOUBLE / count(*) AS v FROM sides GROUP BY ALL)
 SELECT season, team, {r("CASE WHEN max(v) OVER w = min(v) OVER w THEN 17.0 ELSE 8 + 18 * (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END", 3)} AS size FROM t WINDOW w AS (PARTITION BY season)""")
def scaled(spark, d):
    t = sides_of(spark, d).groupBy("season", "team").agg((F.sum((F.col("margin") > 0).cast("int")) / F.count(F.lit(1))).alias("v"))
    w = Window.partitionBy("season")
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    return t.select("season", "team", X.portable_round(F.when(hi == lo, 17.0).otherwise(8 + 18 * (F.col("v") - lo) / (hi - lo)), 3).alias("size"))


@query("q4_t1_leaderboard", f"WITH {SIDES} SELECT team, {div('sum(margin)', 'count(*)', places=3)} AS value FROM sides WHERE season = 1998 GROUP BY team ORDER BY sum(margin)::DOUBLE / count(*) DESC, team LIMIT 25")
def leaderboard(spark, d):
    t = sides_of(spark, d).where("season = 1998").groupBy("team").agg(F.sum("margin").alias("m"), F.count(F.lit(1)).alias("n"))
    return t.orderBy(F.desc(F.col("m") / F.col("n")), "team").limit(25).select("team", X.portable_round(X.ratio(F.col("m"), F.col("n")), 3).alias("value"))


@query("q6_j13_matchup", f"WITH {SIDES} SELECT season, slate, game_id, home, away, home_points, away_points FROM games WHERE least(home, away) = 'NATION_11' AND greatest(home, away) = 'NATION_3'")
def matchup(spark, d):
    g = S.listed_games(sides_of(spark, d)).where((F.least("home", "away") == "NATION_11") & (F.greatest("home", "away") == "NATION_3"))
    return g.select("season", "slate", "game_id", "home", "away", F.col("points").alias("home_points"), F.col("opp_points").alias("away_points"))


@query("q7_backtest", f"WITH {_PRED} SELECT season, count(*) AS n, {r('sum((p - won) * (p - won)) / count(*)')} AS brier, count(*) FILTER ((p >= 0.5) = (won = 1)) AS hits FROM pred GROUP BY season")
def backtest(spark, d):
    p = predictions_of(spark, d)
    return p.groupBy("season").agg(F.count(F.lit(1)).alias("n"), X.portable_round(F.sum((F.col("p") - F.col("won")) * (F.col("p") - F.col("won"))) / F.count(F.lit(1))).alias("brier"), F.sum(((F.col("p") >= 0.5) == (F.col("won") == 1)).cast("int")).alias("hits"))


@query("q16_comparison", f"""WITH {SIDES}, m AS (SELECT team, sum(margin) AS a, sum(off_sum) AS o, sum(rush_yds) AS ry FROM sides GROUP BY team),
 l AS (SELECT team, unnest(['margin', 'offence', 'rushing']) AS stat, unnest([a, o, ry])::BIGINT AS value FROM m)
 SELECT team, stat, value, {r("(rank() OVER (PARTITION BY stat ORDER BY value) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY stat, value)) / count(*) OVER (PARTITION BY stat)")} AS pct FROM l QUALIFY team IN ('NATION_3', 'NATION_11')""")
def comparison(spark, d):
    m = sides_of(spark, d).groupBy("team").agg(F.sum("margin").alias("a"), F.sum("off_sum").alias("o"), F.sum("rush_yds").alias("ry"))
    one = lambda n, c: F.struct(F.lit(n).alias("stat"), F.col(c).alias("value"))
    l = m.select("team", F.explode(F.array(one("margin", "a"), one("offence", "o"), one("rushing", "ry"))).alias("x")).select("team", "x.*")
    pool = Window.partitionBy("stat")
    pct = (F.rank().over(pool.orderBy("value")) - 1 + 0.5 * F.count(F.lit(1)).over(Window.partitionBy("stat", "value"))) / F.count(F.lit(1)).over(pool)
    return l.withColumn("pct", X.portable_round(pct)).where(F.col("team").isin("NATION_3", "NATION_11"))
