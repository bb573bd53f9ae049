"""Queries of ratings, predictions, evaluation and graphs, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.functions import scalars as X
from fieldbook.operators import evaluate as E
from fieldbook.operators import graph as G
from fieldbook.operators import history as H
from fieldbook.operators import ratings as R
from fieldbook.operators import sides as S
from fieldbook.plans.contest_queries import sides_of
from fieldbook.plans.contest_sql import SIDES, r
from fieldbook.plans.form_queries import _BEFORE, before_of
from fieldbook.sources.store import stored

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def predictions_of(spark, d) -> DataFrame:
    """Baseline predictions from the opponent-adjusted ratings before each slate, beside a line made from the contest's number."""

    def make() -> DataFrame:
        two = sides_of(spark, d)
        games = S.listed_games(two).select("game_id", "season", "slate", "home", "away", "margin", "div", "opp_div")
        for side in ("home", "away"):
            one = before_of(spark, d).select(F.col("season").alias("rs"), F.col("slate").alias("rl"), F.col("team").alias("rt"), (F.col("rating") / 100.0).alias(f"{side}_rating"), (F.col("adjo") / 100.0).alias(f"{side}_adjo"), (F.col("adjd") / 100.0).alias(f"{side}_adjd"))
            games = games.join(one.hint("merge"), (F.col("season") == F.col("rs")) & (F.col("slate") == F.col("rl")) & (F.col(side) == F.col("rt"))).drop("rs", "rl", "rt")
        out = R.predict(games).withColumnRenamed("home_win_prob", "p").withColumn("won", (F.col("margin") > 0).cast("int"))
        return out.withColumn("spread", F.when(F.col("game_id") % 10 != 0, (F.col("game_id") % 41 - 20) / 2.0))

    return stored(spark, d, "predictions", make)


_PRED = f"""{SIDES}, {_BEFORE},
base AS (SELECT g.game_id, g.season, g.slate, g.home, g.away, g.home_div AS div, g.away_div AS opp_div, g.home_points - g.away_points AS margin, h.rating / 100.0::DOUBLE AS hr, a.rating / 100.0::DOUBLE AS ar, h.adjo / 100.0::DOUBLE AS ho, h.adjd / 100.0::DOUBLE AS hd, a.adjo / 100.0::DOUBLE AS ao, a.adjd / 100.0::DOUBLE AS ad FROM games g
  JOIN before h ON h.season = g.season AND h.slate = g.slate AND h.team = home JOIN before a ON a.season = g.season AND a.slate = g.slate AND a.team = away),
pred AS MATERIALIZED (SELECT *, hr - ar + 2.5::DOUBLE AS pred_margin, 1.0 / (1.0 + exp(-(hr - ar + 2.5::DOUBLE) / 14.5::DOUBLE)) AS p, (margin > 0)::INT AS won, CASE WHEN game_id % 10 <> 0 THEN (game_id % 41 - 20) / 2.0::DOUBLE END AS spread FROM base)"""
_LOSS = lambda p: f"-(CASE WHEN won = 1 THEN ln(least(greatest({p}, 1e-6), 1 - 1e-6)) ELSE ln(1 - least(greatest({p}, 1e-6), 1 - 1e-6)) END)"
_METRICS = f"""count(*) AS n, {r("sum(((p >= 0.5) = (won = 1))::INT)::DOUBLE / count(*)")} AS accuracy, {r("sum((p - won) * (p - won)) / count(*)")} AS brier, {r(f"sum({_LOSS('p')}) / count(*)")} AS log_loss,
 {r("sum(abs(pred_margin - margin)) / count(*)")} AS mae, count(*) FILTER (spread IS NOT NULL AND abs(margin + spread) >= 1e-9) AS line_n,
 count(*) FILTER (spread IS NOT NULL AND abs(margin + spread) >= 1e-9 AND (pred_margin > -spread) = (margin + spread > 0)) AS line_hits, {r("sum(abs(p - 0.5)) / count(*)")} AS sharpness, {r("sum(p * (1 - p)) / count(*)")} AS expected_brier"""


@query("r8_r9_predictions", f"WITH {_PRED} SELECT game_id, {r('pred_margin', 2)} AS pred_margin, {r('p')} AS p, {r('50.0::DOUBLE / 2 + (hr + 2.5::DOUBLE) / 2', 1)} AS pred_home, {r('50.0::DOUBLE / 2 - (hr - ar - 2.5::DOUBLE) / 2', 1)} AS pred_away, {r('50.0::DOUBLE / 2 + ho + ad + 1.25::DOUBLE', 1)} AS single_home, {r('50.0::DOUBLE / 2 + ao + hd - 1.25::DOUBLE', 1)} AS single_away FROM pred")
def predictions(spark, d):
    """The batch form's points, whose difference isn't the margin, and the single form's by offence and defence."""
    p = predictions_of(spark, d)
    one = lambda c, k: X.portable_round(F.col(c), k).alias(c)
    return p.select("game_id", one("pred_margin", 2), one("p", 4), one("pred_home", 1), one("pred_away", 1), one("single_home", 1), one("single_away", 1))


@query("a18_metrics", f"WITH {_PRED} SELECT {_METRICS} FROM pred")
def metrics(spark, d):
    return E.score(predictions_of(spark, d))


@query("a22_by_slate", f"WITH {_PRED} SELECT season, slate, {_METRICS} FROM pred GROUP BY ALL")
def by_slate(spark, d):
    return E.score(predictions_of(spark, d), ["season", "slate"])


@query("a23_slices", f"WITH {_PRED} SELECT season, CASE WHEN slate <= 3 THEN 'early' WHEN slate <= 8 THEN 'mid' ELSE 'late' END AS part, {_METRICS} FROM pred GROUP BY ALL")
def slices(spark, d):
    return E.score(predictions_of(spark, d), ["season", X.week_slice(F.col("slate")).alias("part")])


@query("a21_calibration", f"WITH {_PRED} SELECT least(floor(p * 10), 9)::INT AS bucket, count(*) AS n, {r('avg(p)')} AS mean_p, {r('sum(won)::DOUBLE / count(*)')} AS rate FROM pred GROUP BY ALL")
def calibration(spark, d):
    return E.calibration(predictions_of(spark, d))


_T = [round(0.4 + 0.1 * i, 1) for i in range(22)]
_CLIP = "least(greatest(p, 1e-6), 1 - 1e-6)"


@query("m2_temperature_grid", f"WITH {_PRED}, c AS (SELECT unnest({_T}::DOUBLE[]) AS value) SELECT value, {r(f'avg({_LOSS(f"1.0 / (1.0 + exp(-ln({_CLIP} / (1 - {_CLIP})) / value))")})', 6)} AS loss FROM pred, c GROUP BY value")
def temperature_grid(spark, d):
    return E.fit_grid(predictions_of(spark, d), _T, E.temperature)


_SG = [float(s) for s in range(6, 29)]


@query("m3_sigma_grid", f"WITH {_PRED}, c AS (SELECT unnest({_SG}::DOUBLE[]) AS value) SELECT value, {r(f'avg({_LOSS("1.0 / (1.0 + exp(-pred_margin / value))")})', 6)} AS loss FROM pred, c GROUP BY value")
def sigma_grid(spark, d):
    return E.fit_grid(predictions_of(spark, d), _SG, E.sigma)


@query("m4_shrink_weight", f"WITH {_PRED} SELECT {r('least(greatest(-sum((p - won) * (0.5 - p)) / sum((0.5 - p) * (0.5 - p)), 0.0), 0.5)')} AS weight FROM pred")
def shrink_weight(spark, d):
    return E.shrink_weight(predictions_of(spark, d))


_BLEND = [(i, j, 10 - i - j) for i in range(11) for j in range(11 - i)]
_BLEND_SQL = ", ".join(f"({i / 10}::DOUBLE, {j / 10}::DOUBLE, {k / 10}::DOUBLE)" for i, j, k in _BLEND)


@query("m20_blend_weights", f"WITH {_PRED}, q AS (SELECT won, p AS a, 1.0 / (1.0 + exp(-pred_margin / 9.5::DOUBLE)) AS b, 0.5::DOUBLE AS c FROM pred), w AS (SELECT * FROM (VALUES {_BLEND_SQL}) t(w0, w1, w2)) SELECT w0, w1, w2, {r(f'avg({_LOSS("(a * w0 + b * w1 + c * w2)")})', 6)} AS loss FROM q, w GROUP BY ALL")
def blend_weights(spark, d):
    p = predictions_of(spark, d)
    return E.blend_weights(p.select("won", F.col("p").alias("a"), X.win_probability(F.col("pred_margin"), 9.5).alias("b"), F.lit(0.5).alias("c")), ["a", "b", "c"])


@query("a24_m9_stability", f"""WITH {_PRED}, a AS (SELECT season, {r("sum((p - won) * (p - won)) / count(*)")} AS x FROM pred GROUP BY season),
 b AS (SELECT season, {r("sum((q - won) * (q - won)) / count(*)")} AS x FROM (SELECT season, won, 1.0 / (1.0 + exp(-pred_margin / 9.5::DOUBLE)) AS q FROM pred) GROUP BY season)
 SELECT count(*) AS years, count(*) FILTER (b.x - a.x < -1e-9) AS better, {r("quantile_cont(b.x - a.x, 0.5)")} AS median_delta FROM a JOIN b USING (season)""")
def stability(spark, d):
    p = predictions_of(spark, d)
    sharp = p.withColumn("p", X.win_probability(F.col("pred_margin"), 9.5))
    return E.stability(E.score(p, ["season"]), E.score(sharp, ["season"]))


@query("a37_residual_slope", f"WITH {_PRED} SELECT season, count(*) AS n, {r('sum((hr - ar) * (margin - pred_margin)) / sum((hr - ar) * (hr - ar))')} AS slope FROM pred GROUP BY season HAVING count(*) >= 20")
def residual_slope(spark, d):
    p = predictions_of(spark, d).withColumn("x", F.col("home_rating") - F.col("away_rating"))
    e = F.col("margin") - F.col("pred_margin")
    return p.groupBy("season").agg(F.count(F.lit(1)).alias("n"), X.portable_round(F.sum(F.col("x") * e) / F.sum(F.col("x") * F.col("x"))).alias("slope")).where("n >= 20")


@query("x12_x22_prices", f"""WITH {_PRED}, q AS (SELECT *, CASE WHEN abs(pred_margin) < 0.5 OR abs(ln(p / (1 - p))) < 0.02 OR pred_margin * ln(p / (1 - p)) < 0 THEN 14.5 ELSE least(greatest(pred_margin / ln(p / (1 - p)), 10.0), 22.0) END AS sg FROM pred WHERE spread IS NOT NULL),
 c AS (SELECT *, 1.0 / (1.0 + exp(-(pred_margin + spread) / sg)) AS cover FROM q)
 SELECT game_id, (CASE WHEN p >= 0.5 THEN -round(100 * p / (1 - p)) ELSE round(100 * (1 - p) / p) END)::INT AS american, {r("sg", 3)} AS sigma, {r("cover")} AS cover, CASE WHEN cover >= 0.5 THEN 'home' ELSE 'away' END AS side,
  {r("greatest(cover, 1 - cover) * 100 - (1 - greatest(cover, 1 - cover)) * 110", 3)} AS value,
  CASE WHEN abs(margin + spread) < 1e-9 THEN 'push' WHEN (margin + spread > 0) = (cover >= 0.5) THEN 'hit' ELSE 'miss' END AS result FROM c""")
def prices(spark, d):
    p = predictions_of(spark, d).where("spread is not null").withColumn("sg", X.implied_sigma(F.col("pred_margin"), F.col("p")))
    p = p.withColumn("cover", X.cover_probability(F.col("pred_margin"), F.col("spread"), F.col("sg"))).withColumn("side", F.when(F.col("cover") >= 0.5, "home").otherwise("away"))
    best = F.greatest(F.col("cover"), 1 - F.col("cover"))
    return p.select("game_id", X.american(F.col("p")).alias("american"), X.portable_round(F.col("sg"), 3).alias("sigma"), X.portable_round(F.col("cover")).alias("cover"), "side",
                    X.portable_round(X.value_at_juice(best), 3).alias("value"), X.settle(F.col("side"), F.col("margin"), F.col("spread")).alias("result"))


@query("p12_t2_upsets", f"WITH {_PRED} SELECT season, slate, game_id, home, away, {r('p')} AS p, margin FROM pred WHERE (p < 0.4 AND margin > 0) OR (p > 0.6 AND margin < 0)")
def upsets(spark, d):
    p = predictions_of(spark, d)
    return p.where(((F.col("p") < 0.4) & (F.col("margin") > 0)) | ((F.col("p") > 0.6) & (F.col("margin") < 0))).select("season", "slate", "game_id", "home", "away", X.portable_round(F.col("p")).alias("p"), "margin")


@query("a30_percentiles", f"WITH {SIDES}, m AS (SELECT season, team, sum(margin) AS v FROM sides GROUP BY ALL) SELECT season, team, {r('(rank() OVER (PARTITION BY season ORDER BY v) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY season, v)) / count(*) OVER (PARTITION BY season)')} AS pct FROM m")
def percentiles(spark, d):
    m = sides_of(spark, d).groupBy("season", "team").agg(F.sum("margin").alias("v"))
    return m.select("season", "team", X.portable_round(E.mid_rank("v", ["season"])).alias("pct"))


@query("a30_lower_is_better", f"WITH {SIDES}, m AS (SELECT season, team, sum((margin < 0)::INT) AS v FROM sides GROUP BY ALL) SELECT season, team, v::BIGINT AS losses, {r('(rank() OVER (PARTITION BY season ORDER BY v DESC) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY season, v)) / count(*) OVER (PARTITION BY season)')} AS pct FROM m")
def percentiles_of_losses(spark, d):
    """Fewer losses beat more."""
    m = sides_of(spark, d).groupBy("season", "team").agg(F.sum((F.col("margin") < 0).cast("int")).alias("losses"))
    return m.select("season", "team", "losses", X.portable_round(E.mid_rank("losses", ["season"], higher=False)).alias("pct"))


@query("x26_scores", f"""WITH {SIDES}, p AS (SELECT game_id, margin::DOUBLE AS margin, CASE WHEN game_id % 5 > 0 THEN 20.0::DOUBLE + game_id % 100 END AS total, CASE WHEN game_id % 7 = 0 THEN (game_id % 130)::DOUBLE END AS h, CASE WHEN game_id % 7 = 0 AND game_id % 2 = 0 THEN 21.0::DOUBLE END AS a FROM sides WHERE is_home),
 s AS (SELECT *, CASE WHEN h IS NULL AND a IS NULL THEN (total + margin) / 2 ELSE h END AS x, CASE WHEN h IS NULL AND a IS NULL THEN (total - margin) / 2 ELSE a END AS y, CASE WHEN coalesce(h, 0) + coalesce(a, 0) > 0 THEN coalesce(h, 0) + coalesce(a, 0) ELSE 50 END AS t FROM p)
 SELECT game_id, CASE WHEN x BETWEEN 0 AND 120 AND y BETWEEN 0 AND 120 THEN {r('x')} END AS home_score, CASE WHEN x BETWEEN 0 AND 120 AND y BETWEEN 0 AND 120 THEN {r('y')} END AS away_score, {r('(t + margin) / 2')} AS engine_home, {r('(t - margin) / 2')} AS engine_away FROM s""")
def scores(spark, d):
    """Scores of contests from lines, and of an engine that only knows the margin; lines and scores follow from the contest's number."""
    k = F.col("game_id")
    p = S.listed_games(sides_of(spark, d)).select("game_id", F.col("margin").cast("double").alias("margin"), F.when(k % 5 > 0, 20.0 + k % 100).alias("total"), F.when(k % 7 == 0, (k % 130).cast("double")).alias("h"), F.when((k % 7 == 0) & (k % 2 == 0), 21.0).alias("a"))
    home, away = X.scores_of(F.col("h"), F.col("a"), F.col("margin"), F.col("total"))
    e_home, e_away = X.engine_scores(F.col("margin"), F.col("h"), F.col("a"))
    return p.select("game_id", *[X.portable_round(c).alias(n) for n, c in (("home_score", home), ("away_score", away), ("engine_home", e_home), ("engine_away", e_away))])


@query("p8_slates", "SELECT o_orderkey, (coalesce(CASE WHEN o_orderkey % 9 > 0 THEN month(o_orderdate) END, 0) + CASE WHEN o_orderstatus = 'P' THEN 20 ELSE 0 END)::INT AS slate FROM orders")
def slates(spark, d):
    """A contest's slate from its week, which may be unknown; orders that are open in part stand for the postseason."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderstatus")
    week = F.when(F.col("o_orderkey") % 9 > 0, F.month("o_orderdate"))
    return o.select("o_orderkey", X.slate_of(week, F.col("o_orderstatus") == "P").alias("slate"))


# ---------------------------------------------------------------- graphs: one for each month

_GRAPH = f"""{SIDES}, gs AS (SELECT season * 100 + slate AS g, home, away, margin FROM sides WHERE is_home),
we AS (SELECT g, CASE WHEN margin > 0 THEN home ELSE away END AS src, CASE WHEN margin > 0 THEN away ELSE home END AS dst, abs(margin) AS w FROM gs WHERE margin <> 0),
ue AS (SELECT g, least(src, dst) AS a, greatest(src, dst) AS b, max(w) AS w FROM we GROUP BY ALL), bw AS (SELECT g, a AS u, b AS v, w FROM ue UNION ALL SELECT g, b, a, w FROM ue),
rt AS (SELECT g, team AS u, sum(m) AS rating FROM (SELECT g, home AS team, margin AS m FROM gs UNION ALL SELECT g, away, -margin FROM gs) GROUP BY ALL)"""


def games_of(spark, d) -> DataFrame:
    return S.listed_games(sides_of(spark, d)).select((F.col("season") * 100 + F.col("slate")).alias("g"), "home", "away", "margin")


def node_ratings(games: DataFrame) -> DataFrame:
    one = F.explode(F.array(F.struct(F.col("home").alias("u"), F.col("margin").alias("m")), F.struct(F.col("away").alias("u"), (-F.col("margin")).alias("m"))))
    return games.select("g", one.alias("x")).groupBy("g", F.col("x.u").alias("u")).agg(F.sum("x.m").alias("rating"))


@query("g1_g2_edges", f"WITH {_GRAPH} SELECT g, a, b, w FROM ue")
def graph_edges(spark, d):
    return G.undirected(G.win_edges(games_of(spark, d)))


@query("g6_degrees", f"WITH {_GRAPH}, dg AS (SELECT g, u, count(*) AS d FROM bw GROUP BY ALL) SELECT g, count(*) AS nodes, (sum(d) // 2)::BIGINT AS edges, min(d) AS min_degree, max(d) AS max_degree, {r('sum(d)::DOUBLE / count(*)')} AS mean_degree FROM dg GROUP BY g")
def graph_degrees(spark, d):
    return G.degrees(graph_edges(spark, d))


def _pagerank_sql(passes: int) -> str:
    out = f"""WITH {_GRAPH}, fl AS (SELECT g, dst AS src, src AS dst, sum(w)::DOUBLE AS w FROM we GROUP BY ALL), f AS MATERIALIZED (SELECT g, src, dst, w / sum(w) OVER (PARTITION BY g, src) AS share FROM fl),
 nd AS MATERIALIZED (SELECT g, u, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, src AS u FROM fl UNION SELECT g, dst FROM fl)), r0 AS (SELECT g, u, n, 1.0::DOUBLE / n AS r FROM nd)"""
    for k in range(passes):
        out += f""", l{k + 1} AS (SELECT g, sum(r) AS loose FROM r{k} ANTI JOIN (SELECT g, src AS u FROM f) USING (g, u) GROUP BY g), q{k + 1} AS (SELECT f.g, f.dst AS u, sum(r * share) AS got FROM r{k} r JOIN f ON f.g = r.g AND f.src = r.u GROUP BY ALL),
 r{k + 1} AS MATERIALIZED (SELECT nd.g, nd.u, n, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * (coalesce(got, 0) + coalesce(loose, 0) / n) AS r FROM nd LEFT JOIN q{k + 1} USING (g, u) LEFT JOIN l{k + 1} ON l{k + 1}.g = nd.g)"""
    return out + f" SELECT g, u, {r('r', 6)} AS r FROM r{passes}"


@query("g3_pagerank", _pagerank_sql(60))
def graph_pagerank(spark, d):
    """To convergence, so that the passes that SQL goes on for change nothing."""
    return G.pagerank(G.win_edges(games_of(spark, d)), 1e-9).withColumn("r", X.portable_round(F.col("r"), 6))


@query("g4_neighbours", f"WITH {_GRAPH} SELECT b.g, b.u, count(*) AS opponents, {r('sum(x.rating)::DOUBLE / count(*) ')} AS near, {r('max(m.rating) - sum(x.rating)::DOUBLE / count(*)')} AS above FROM bw b JOIN rt x ON x.g = b.g AND x.u = b.v JOIN rt m ON m.g = b.g AND m.u = b.u GROUP BY ALL")
def graph_neighbours(spark, d):
    games = games_of(spark, d)
    return G.neighbours(G.win_edges(games), node_ratings(games))




@query("g7_components", f"WITH RECURSIVE {_GRAPH}, rc AS (SELECT DISTINCT g, u, u AS label FROM bw UNION SELECT b.g, b.v, c.label FROM rc c JOIN bw b ON b.g = c.g AND b.u = c.u) SELECT g, u, min(label) AS label FROM rc GROUP BY ALL")
def graph_components(spark, d):
    return G.components(graph_edges(spark, d))


@query("g8_distances", f"""WITH RECURSIVE {_GRAPH}, bfs AS (SELECT DISTINCT g, u AS s, u, 0 AS d FROM bw UNION SELECT f.g, f.s, b.v, f.d + 1 FROM bfs f JOIN bw b ON b.g = f.g AND b.u = f.u WHERE f.d < 12),
 sp AS (SELECT g, s, u, min(d) AS d FROM bfs GROUP BY ALL), far AS (SELECT g, s, max(d) AS ecc, sum(d) AS t, count(*) AS n FROM sp WHERE d > 0 GROUP BY ALL)
 SELECT g, max(ecc) AS diameter, min(ecc) AS radius, {r("sum(t)::DOUBLE / sum(n)")} AS mean_path FROM far GROUP BY g""")
def graph_distances(spark, d):
    return G.distance_summary(graph_edges(spark, d))


@query("g11_triangles", f"WITH {_GRAPH} SELECT x.g, count(*) AS triangles FROM ue x JOIN ue y ON x.g = y.g AND x.b = y.a JOIN ue z ON z.g = x.g AND z.a = x.a AND z.b = y.b GROUP BY x.g")
def graph_triangles(spark, d):
    return G.triangles(graph_edges(spark, d))


@query("g14_cycles", f"""WITH {_GRAPH}, e AS (SELECT DISTINCT w.g, src, dst, greatest(0, d.rating - s.rating) AS t FROM we w JOIN rt s ON s.g = w.g AND s.u = src JOIN rt d ON d.g = w.g AND d.u = dst),
 c AS (SELECT x.g, array_to_string(list_sort([x.src, y.src, z.src]), ',') AS teams, max(x.t + y.t + z.t)::BIGINT AS tension FROM e x JOIN e y ON x.g = y.g AND x.dst = y.src JOIN e z ON z.g = x.g AND y.dst = z.src AND z.dst = x.src WHERE x.src < y.src AND x.src < z.src GROUP BY ALL)
 SELECT *, row_number() OVER (PARTITION BY g ORDER BY tension DESC, teams) AS place FROM c QUALIFY place <= 12""")
def graph_cycles(spark, d):
    games = games_of(spark, d)
    return G.cycles(G.win_edges(games), node_ratings(games))


@query("g13_spanning_tree", f"""WITH RECURSIVE {_GRAPH}, e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY w DESC, a DESC, b DESC) AS i FROM ue), x AS MATERIALIZED (SELECT g, a AS u, b AS v, i FROM e UNION ALL SELECT g, b, a, i FROM e),
 rc AS (SELECT g, i, a AS u FROM e UNION SELECT rc.g, rc.i, x.v FROM rc JOIN x ON x.g = rc.g AND x.u = rc.u AND x.i < rc.i) SELECT g, a, b, w FROM e ANTI JOIN rc ON rc.g = e.g AND rc.i = e.i AND rc.u = e.b""")
def graph_spanning_tree(spark, d):
    return G.spanning_tree(graph_edges(spark, d))


def _between_sql(levels: int) -> str:
    out = f"""WITH RECURSIVE {_GRAPH}, bfs AS (SELECT DISTINCT g, u AS s, u, 0 AS d FROM bw UNION SELECT f.g, f.s, b.v, f.d + 1 FROM bfs f JOIN bw b ON b.g = f.g AND b.u = f.u WHERE f.d < {levels}),
 sp AS MATERIALIZED (SELECT g, s, u, min(d) AS d FROM bfs GROUP BY ALL), n0 AS MATERIALIZED (SELECT g, s, u, 1.0::DOUBLE AS n FROM sp WHERE d = 0)"""
    for k in range(1, levels + 1):
        out += f""", n{k} AS MATERIALIZED (SELECT p.g, p.s, p.u, sum(q.n) AS n FROM sp p JOIN bw b ON b.g = p.g AND b.v = p.u JOIN n{k - 1} q ON q.g = p.g AND q.s = p.s AND q.u = b.u WHERE p.d = {k} GROUP BY ALL)"""
    out += f", x{levels} AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS x FROM n{levels})"
    for k in range(levels, 0, -1):
        out += f""", x{k - 1} AS MATERIALIZED (SELECT p.g, p.s, p.u, any_value(p.n) AS n, any_value(p.n) * coalesce(sum((1 + q.x) / q.n), 0) AS x FROM n{k - 1} p LEFT JOIN (SELECT q.*, b.v FROM x{k} q JOIN bw b ON b.g = q.g AND b.u = q.u) q ON q.g = p.g AND q.s = p.s AND q.v = p.u GROUP BY p.g, p.s, p.u)"""
    all_ = " UNION ALL ".join(f"SELECT g, u, x FROM x{k}" for k in range(1, levels + 1))
    return out + f""" SELECT g, u, {r("coalesce(sum(x), 0) / greatest((n - 1) * (n - 2), 1)", 6)} AS betweenness FROM (SELECT g, u, count(*) OVER (PARTITION BY g) AS n FROM (SELECT DISTINCT g, u FROM bw)) LEFT JOIN ({all_}) USING (g, u) GROUP BY g, u, n"""


@query("g10_betweenness", _between_sql(8))
def graph_betweenness(spark, d):
    return G.betweenness(graph_edges(spark, d)).withColumn("betweenness", X.portable_round("betweenness", 6))


@query("g12_bridges", f"""WITH RECURSIVE {_GRAPH}, rc AS (SELECT g, a, b, a AS u FROM ue UNION SELECT rc.g, rc.a, rc.b, x.v FROM rc JOIN bw x ON x.g = rc.g AND x.u = rc.u WHERE NOT (least(x.u, x.v) = rc.a AND greatest(x.u, x.v) = rc.b))
 SELECT g, a, b FROM ue ANTI JOIN rc ON rc.g = ue.g AND rc.a = ue.a AND rc.b = ue.b AND rc.u = ue.b""")
def graph_bridges(spark, d):
    return G.bridges(graph_edges(spark, d))


@query("g15_spectrum")
def graph_spectrum(spark, d):
    return G.spectrum(graph_edges(spark, d))
