"""Queries of calibration, folds, model studies and schedule graphs, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldbook.functions import scalars as X
from fieldbook.operators import calibrate as C
from fieldbook.operators import evaluate as E
from fieldbook.operators import folds as D
from fieldbook.operators import form as FM
from fieldbook.operators import graph as G
from fieldbook.operators import sides as S
from fieldbook.plans.contest_queries import sides_of
from fieldbook.plans.contest_sql import SIDES, r
from fieldbook.plans.form_queries import form_of
from fieldbook.plans.model_queries import _GRAPH, _LOSS, _PRED, games_of, graph_edges, node_ratings, predictions_of
from fieldbook.sources.store import stored

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- calibration

_CL = "least(greatest(p, 1e-6), 1 - 1e-6)"
_SPLIT = 1999


def _scale_sql(out: str, source: str, x: str, bounds: tuple[float, float]) -> str:
    """The bracketing passes as a chain of tables that ends in ``out`` with ``season`` and ``s``."""
    n = C.PROBES + 1
    sql = f"""{out}x AS MATERIALIZED (SELECT season, {x} AS x, won FROM {source}), {out}0 AS (SELECT DISTINCT season, {1 / bounds[1]!r}::DOUBLE AS lo, {1 / bounds[0]!r}::DOUBLE AS hi FROM {out}x)"""
    for k in range(C.PASSES):
        sql += f""", {out}{k + 1} AS MATERIALIZED (SELECT season, lo + (hi - lo) * m / {n} AS lo, lo + (hi - lo) * (m + 1) / {n} AS hi FROM (SELECT season, lo, hi, count(*) FILTER (g <= 0) AS m FROM
 (SELECT season, lo, hi, j, sum((1.0 / (1.0 + exp(-(lo + (hi - lo) * (j / {n}.0::DOUBLE)) * x)) - won) * x) AS g FROM {out}x JOIN {out}{k} USING (season), (SELECT unnest(range(1, {n})) AS j) GROUP BY ALL) GROUP BY ALL))"""
    return f"{sql}, {out} AS (SELECT season, 2.0 / (lo + hi) AS s FROM {out}{C.PASSES})"


def _newton_sql(out: str, source: str, steps: int = C.NEWTON) -> str:
    """Platt's Newton steps as a chain that ends in ``out`` with ``season``, ``a`` and ``b``."""
    q = "1.0 / (1.0 + exp(-(a + b * z)))"
    sql = f"""{out}z AS MATERIALIZED (SELECT season, ln({_CL} / (1 - {_CL})) AS z, won FROM {source}), {out}0 AS (SELECT DISTINCT season, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b FROM {out}z)"""
    for k in range(steps):
        sql += f""", {out}t{k} AS (SELECT season, a, b, sum(won - {q}) AS ga, sum((won - {q}) * z) AS gb, sum({q} * (1 - {q})) AS haa, sum({q} * (1 - {q}) * z) AS hab, sum({q} * (1 - {q}) * z * z) AS hbb FROM {out}{k} JOIN {out}z USING (season) GROUP BY ALL),
 {out}{k + 1} AS MATERIALIZED (SELECT season, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM {out}t{k})"""
    return f"{sql}, {out} AS (SELECT * FROM {out}{steps})"


def _parameters_sql(out: str, source: str) -> str:
    """All fitted numbers of the seasons of ``source``, unrounded."""
    return f"""{_scale_sql(out + "t", source, f"ln({_CL} / (1 - {_CL}))", C.TEMPERATURES)}, {_scale_sql(out + "g", source, "pred_margin", C.SIGMAS)}, {_newton_sql(out + "p", source)},
 {out}r AS (SELECT season, avg(won) AS rate FROM {source} GROUP BY season), {out}w AS (SELECT season, any_value(rate) AS rate, least(greatest(-sum((p - won) * (rate - p)) / sum((rate - p) * (rate - p)), 0.0), 0.5) AS w FROM {source} JOIN {out}r USING (season) GROUP BY season),
 {out} AS MATERIALIZED (SELECT season, t.s AS temperature, g.s AS sigma, w AS shrink, rate, a, b FROM {out}t t JOIN {out}g g USING (season) JOIN {out}w USING (season) JOIN {out}p USING (season))"""


_ROUNDED = ", ".join(f"{r(c, k)} AS {c}" for c, k in C.PLACES.items())
#: Seasons before the split are one training group (0), the rest one holdout (1).
_HOLD = f"{_PRED}, train AS (SELECT * REPLACE (0 AS season) FROM pred WHERE season < {_SPLIT}), hold AS (SELECT * REPLACE (1 AS season) FROM pred WHERE season >= {_SPLIT}), {_parameters_sql('ft', 'train')}"
_APPLIED = {
    "identity": "p", "clip05": "least(greatest(p, 0.05), 0.95)", "clip10": "least(greatest(p, 0.1), 0.9)", "temperature": f"1.0 / (1.0 + exp(-ln({_CL} / (1 - {_CL})) / temperature))", "sigma": "1.0 / (1.0 + exp(-pred_margin / sigma))",
    "shrink": "(1 - shrink) * p + shrink * rate", "platt": f"1.0 / (1.0 + exp(-(a + b * ln({_CL} / (1 - {_CL})))))",
}


def split_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = predictions_of(spark, d)
    return p.where(F.col("season") < _SPLIT), p.where(F.col("season") >= _SPLIT)


def published(spark: SparkSession, d: str) -> DataFrame:
    """The numbers fitted before the holdout, as they are published: one row."""
    return stored(spark, d, "calibration", lambda: C.rounded(C.parameters(split_of(spark, d)[0])))


@query("m2_m3_m4_fitted", f"WITH {_HOLD} SELECT {_ROUNDED} FROM ft")
def fitted(spark, d):
    """The numbers that do best before the holdout, by bracketing and Newton steps."""
    return published(spark, d)


@query("m2_m3_m5_by_season", f"WITH {_PRED}, {_parameters_sql('fs', 'pred')} SELECT season, {_ROUNDED} FROM fs")
def fitted_by_season(spark, d):
    """The same for every season by itself, all seasons in each pass."""
    return C.rounded(C.parameters(predictions_of(spark, d), ["season"]))


_NAMES = lambda names, prefix="": ", ".join(f"{{'name': '{prefix}{n}', 'q': {_APPLIED[n]}}}" for n in names)
_CAL = lambda source, out: f"""{out} AS (SELECT u.name, u.q, won FROM (SELECT won, unnest([{_NAMES(_APPLIED)}]) AS u FROM {source} CROSS JOIN pub) UNION ALL SELECT u.name, u.q, won FROM (SELECT won, unnest([{_NAMES(("temperature", "platt"), "oracle_")}]) AS u FROM {source} CROSS JOIN fh))"""
_SCORES = lambda source: f"(SELECT name, count(*) AS n, {r('sum((q - won) * (q - won)) / count(*)', 5)} AS brier, {r('avg(' + _LOSS('q') + ')', 5)} AS log_loss FROM {source} GROUP BY name)"
_FREE = "CASE regexp_replace(name, '^oracle_', '') " + " ".join(f"WHEN '{n}' THEN {k}" for n, k in C.FREE.items()) + " END"


@query("m6_m7_m10_calibration_study", f"""WITH {_HOLD}, {_parameters_sql('fho', 'hold')}, fh AS (SELECT * EXCLUDE (season) FROM fho), pub AS (SELECT {_ROUNDED} FROM ft), {_CAL('hold', 'ch')}, {_CAL('train', 'ct')}, sc AS {_SCORES('ch')}, tr AS {_SCORES('ct')}, b AS (SELECT brier AS b0, log_loss AS l0 FROM sc WHERE name = 'identity'),
 o AS (SELECT s.name, s.n, s.brier, s.log_loss, t.brier AS train_brier, t.log_loss AS train_log_loss, b0 - s.brier AS drop, s.name NOT LIKE 'oracle%' AND s.name <> 'identity' AND b0 - s.brier >= 0.002 AND s.log_loss <= l0 AS passes FROM sc s JOIN tr t USING (name), b)
 SELECT name, n, brier, log_loss, train_brier, train_log_loss, {r('drop', 5)} AS brier_drop, passes, {_FREE} AS parameters, row_number() OVER (ORDER BY CASE WHEN passes THEN 2 WHEN name = 'identity' THEN 1 ELSE 0 END DESC, {_FREE}, brier, name) = 1 AS promoted FROM o""")
def calibration_study(spark, d):
    """Seven calibrations fitted before the holdout and scored on it and at home, with two ceilings fitted on the holdout itself."""
    return C.study(*split_of(spark, d))


@query("m8_reapplied", f"""WITH {_HOLD}, pub AS (SELECT {_ROUNDED} FROM ft) SELECT game_id, {r('p', 6)} AS raw, {r(_APPLIED['temperature'], 6)} AS p FROM hold, pub""")
def reapplied(spark, d):
    """A calibration applied twice is applied once: the raw probability is kept and taken each time."""
    hold = split_of(spark, d)[1].crossJoin(F.broadcast(published(spark, d)))  # one row
    once = E.apply_kept(hold, lambda p: C.applied(p, F.col("pred_margin"))["temperature"])
    twice = E.apply_kept(once, lambda p: C.applied(p, F.col("pred_margin"))["temperature"])
    return twice.select("game_id", X.portable_round("raw_p", 6).alias("raw"), X.portable_round("p", 6).alias("p"))


@query("m5_platt_by_season", f"WITH {_PRED}, {_newton_sql('fp', 'pred')}, n AS (SELECT season, count(*) AS n FROM pred GROUP BY season) SELECT season, {r('a', 5)} AS a, {r('b', 5)} AS b, n FROM fp JOIN n USING (season)")
def platt_by_season(spark, d):
    """Slope and intercept on the logit of each season, by Newton steps on five sums a step."""
    p = predictions_of(spark, d)
    n = p.groupBy("season").agg(F.count(F.lit(1)).alias("n"))
    return C.fit_platt(p, ["season"]).join(n.hint("merge"), "season").select("season", X.portable_round("a", 5).alias("a"), X.portable_round("b", 5).alias("b"), "n")


@query("m9_a24_promotion", f"""WITH {_PRED}, s AS (SELECT season, sum((p - won) * (p - won)) / count(*) AS a, sum((q - won) * (q - won)) / count(*) AS b, avg({_LOSS("p")}) AS la, avg({_LOSS("q")}) AS lb FROM (SELECT *, 1.0 / (1.0 + exp(-pred_margin / 40.0::DOUBLE)) AS q FROM pred) GROUP BY season)
 SELECT count(*) AS years, count(*) FILTER (b - a < -1e-9) AS better, {r("quantile_cont(b - a, 0.5)", 5)} AS median_delta, avg(a) - avg(b) >= 0.002 AND avg(lb) <= avg(la) AND (quantile_cont(b - a, 0.5) < 0 OR count(*) FILTER (b - a < -1e-9) >= 8) AS promoted FROM s""")
def promotion(spark, d):
    """A flatter model beside the baseline: better in how many seasons, and whether the fixed rule takes it."""
    p = predictions_of(spark, d).withColumn("q", X.win_probability(F.col("pred_margin"), 40.0))
    return E.promotion(p, "p", "q")


# ---------------------------------------------------------------- folds and studies without a learner


@query("m11_m12_m13_folds", f"""WITH {_PRED}, k AS (SELECT *, div = 'fbs' AND opp_div = 'fbs' AS top FROM pred), f AS (SELECT 'expanding' AS kind, a.season * 100 AS fold, b.game_id, false AS scored FROM (SELECT DISTINCT season FROM k) a JOIN k b ON b.season < a.season UNION ALL SELECT 'audit', a.season * 100, b.game_id, false FROM (SELECT DISTINCT season FROM k) a JOIN k b ON b.season <> a.season
 UNION ALL SELECT 'walk', a.season * 100 + a.slate, b.game_id, false FROM (SELECT DISTINCT season, slate FROM k) a JOIN k b ON b.season * 100 + b.slate < a.season * 100 + a.slate)
 SELECT kind, fold, count(*) AS train FROM f GROUP BY ALL""")
def folds(spark, d):
    """How many contests each fold trains on: earlier seasons, all other seasons, earlier slates. Counts are cumulated, rows are never copied to folds."""
    return E.fold_sizes(predictions_of(spark, d))


def fold_scores(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Contests of both top sides under fits of one kind of folds on the baseline's and the extras' columns: scores of each fold, raw and clipped."""
    f = features_of(spark, d)
    out = D.ridge_folds(f, columns_of("locked", "extras"), kind)
    top = f.where("top").select("game_id")
    n, e = F.count(F.lit(1)), lambda q: F.sum((q - F.col("won")) * (q - F.col("won"))) / F.count(F.lit(1))
    clip = F.least(F.greatest("p", F.lit(0.05)), F.lit(0.95))
    return out.join(top.hint("merge"), "game_id").groupBy("fold", "trained").agg(n.alias("n"), e(F.col("p")).alias("brier"), e(clip).alias("brier_clip"), F.avg(X.log_loss(F.col("p"), F.col("won"))).alias("log_loss"))


@query("m12_leave_one_season_out")
def leave_one_out(spark, d):
    """Each season under a fit to all other seasons (an audit: later ones are among them)."""
    return fold_scores(spark, d, "audit")


@query("m11_expanding_years")
def expanding_years(spark, d):
    """Each season under a fit to the earlier ones."""
    return fold_scores(spark, d, "expanding")


@query("m1_m13_slate_walk")
def slate_walk(spark, d):
    """Each slate under a fit to all earlier slates: a probability for every contest that has enough before it."""
    out = D.ridge_folds(features_of(spark, d), columns_of("locked", "extras"), "walk")
    return out.select("game_id", "season", "slate", "won", "trained", X.portable_round("p", 6).alias("p"))


@query("m21_equal_ensemble", f"WITH {_PRED} SELECT game_id, {r('(p + 1.0 / (1.0 + exp(-pred_margin / 9.5::DOUBLE)) + 0.5::DOUBLE) / 3')} AS p, {r('(pred_margin + hr - ar) / 2', 3)} AS margin FROM pred")
def ensemble(spark, d):
    p = predictions_of(spark, d)
    mean = lambda *x: sum(x[1:], x[0]) / len(x)
    return p.select("game_id", X.portable_round(mean(F.col("p"), X.win_probability(F.col("pred_margin"), 9.5), F.lit(0.5))).alias("p"), X.portable_round(mean(F.col("pred_margin"), F.col("home_rating") - F.col("away_rating")), 3).alias("margin"))


@query("m29_trial_history", f"""WITH {_PRED}, t AS (SELECT season * 100 + slate AS trial, sum((p - won) * (p - won)) / count(*) AS brier FROM pred GROUP BY ALL) SELECT trial, {r('brier')} AS brier, {r('min(brier) OVER (ORDER BY trial)')} AS best, brier <= min(brier) OVER (ORDER BY trial) AS kept FROM t""")
def trial_history(spark, d):
    p = predictions_of(spark, d)
    t = p.groupBy((F.col("season") * 100 + F.col("slate")).alias("trial")).agg((F.sum((F.col("p") - F.col("won")) * (F.col("p") - F.col("won"))) / F.count(F.lit(1))).alias("brier"))
    best = F.min("brier").over(Window.orderBy("trial").rowsBetween(Window.unboundedPreceding, 0))  # a row for each trial
    return t.select("trial", X.portable_round("brier").alias("brier"), X.portable_round(best).alias("best"), (F.col("brier") <= best).alias("kept"))


@query("t8_training_tail", f"""WITH {SIDES}, o AS (SELECT game_id, season, slate, row_number() OVER (ORDER BY season DESC, slate DESC, game_id DESC) AS i FROM games) SELECT game_id, season, slate, i <= 400 AS calibration FROM o WHERE i <= 8000""")
def training_tail(spark, d):
    """The last 8,000 contests in the total order, of which the last 400 are kept for calibration."""
    g = S.listed_games(sides_of(spark, d)).select("game_id", "season", "slate")
    order = [F.desc("season"), F.desc("slate"), F.desc("game_id")]
    tail = g.orderBy(*order).limit(8000)
    return tail.withColumn("calibration", F.row_number().over(Window.orderBy(*order)) <= 400)  # 8,000 rows at most


# ---------------------------------------------------------------- studies with learners

_SETS = {"locked": ["locked"], "extras": ["locked", "extras"], "pace": ["locked", "extras", "pace"], "specials": ["locked", "extras", "specials"], "conference": ["locked", "extras", "conference"], "glm4": ["locked", "glm4"], "passer": ["locked", "extras", "passer"], "craft": ["locked", "craft"], "time": ["locked", "time"], "thin": ["locked", "thin"]}


def features_of(spark: SparkSession, d: str) -> DataFrame:
    """All menus' columns of each contest with its result."""

    def make() -> DataFrame:
        wide = form_of(spark, d)  # before the sides, as it needs plays
        c = FM.contests(sides_of(spark, d))
        y = c.select("game_id", F.col("margin"), (F.col("margin") > 0).cast("int").alias("won"), ((F.col("div") == "fbs") & (F.col("opp_div") == "fbs")).alias("top"))
        return FM.menu(c, wide, *FM.MENUS).join(y.hint("merge"), "game_id")

    return stored(spark, d, "features", make)


def columns_of(*names: str) -> list[str]:
    return list({k: None for n in names for k in FM.MENUS[n]})


@query("m14_m18_m19_set_comparison")
def set_comparison(spark, d):
    """Every named set of menus under expanding-year ridge logistic fits: pooled and by slices of the season."""
    out = E.ridge_logistic_sets(features_of(spark, d), {n: columns_of(*m) for n, m in _SETS.items()})
    scored = out.withColumn("part", X.week_slice(F.col("slate")))
    n, e = F.count(F.lit(1)), (F.col("p") - F.col("won")) * (F.col("p") - F.col("won"))
    return scored.rollup("set", "part").agg(n.alias("n"), (F.sum(e) / n).alias("brier"), (F.sum(X.log_loss(F.col("p"), F.col("won"))) / n).alias("log_loss")).where("set is not null")


@query("m22_subset_scan")
def subset_scan(spark, d):
    """Groups of menus, then the best group without each of its columns: selected on the season before the last, scored on the last."""
    return E.subset_scan(features_of(spark, d), {n: columns_of(*m) for n, m in _SETS.items()})


@query("m26_margin_head")
def margin_head(spark, d):
    """A ridge regression of the margin on each set, by expanding years: its mean absolute error beside the baseline's, and the rule of three tenths of a point."""
    f = features_of(spark, d)
    out = None
    for name in ("locked", "extras", "thin"):
        p = E.ridge_margin_folds(f, columns_of(*_SETS[name])).withColumn("set", F.lit(name))
        out = p if out is None else out.unionByName(p)
    out = out.join(f.select("game_id", "pom_diff").hint("merge"), "game_id")
    base = F.abs(F.col("pom_diff") + 2.5 - F.col("margin"))
    return out.groupBy("set").agg(F.avg(F.abs(F.col("pred") - F.col("margin"))).alias("mae"), F.avg(base).alias("base_mae")).withColumn("promoted", F.col("base_mae") - F.col("mae") >= 0.3)


@query("m15_m17_boosted_trees")
def boosted_trees(spark, d):
    """200 boosted trees each for the result and the margin on the extras, trained before the last season and scored on it, with shares of the gain."""
    return E.boosted(features_of(spark, d), columns_of("locked", "extras"), rounds=200)


@query("m16_permutation_importance")
def permutation(spark, d):
    """The rise of the Brier score when a side's rating is dealt to other contests, over five seeded deals."""
    p = predictions_of(spark, d)
    return E.permutation_importance(p, ["home_rating", "away_rating"], lambda c: X.win_probability(c("home_rating") - c("away_rating") + 2.5), repeats=5)


@query("m25_synthetic_rows")
def synthetic_rows(spark, d):
    """Training rows made of quarters beside real ones: one slope of the result on the rating gap, fitted with and without them, scored on real contests of the last season."""
    from fieldbook.operators import snaps as N
    from fieldbook.plans.contest_queries import plays_of

    quarters = N.quarter_points(plays_of(spark, d))  # plays before predictions, whose sides are then made of them
    p = predictions_of(spark, d).select("game_id", "season", (F.col("home_rating") - F.col("away_rating") + 2.5).alias("z"))
    rows = N.quarter_bundles(quarters).select("game_id", "real", "won").join(p.hint("merge"), "game_id")
    last = rows.agg(F.max("season")).first()[0]
    train, test = rows.where(F.col("season") < last), rows.where((F.col("season") == last) & F.col("real"))
    out = None
    for name, part in (("real", train.where("real")), ("synthetic", train)):
        b = E.one_slope(part, "z")
        q = 1.0 / (1.0 + F.exp(-F.lit(b) * F.col("z")))
        one = test.agg(F.count(F.lit(1)).alias("n"), F.avg((q - F.col("won")) * (q - F.col("won"))).alias("brier")).select(F.lit(name).alias("variant"), F.lit(b).alias("slope"), "n", "brier")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- graphs


@query("g2_directed", f"WITH {_GRAPH}, ev AS (SELECT season * 100 + slate AS g, game_id, CASE WHEN margin > 0 THEN home ELSE away END AS src, CASE WHEN margin > 0 THEN away ELSE home END AS dst, abs(margin) AS w FROM sides WHERE is_home AND margin <> 0) SELECT season AS g, src, dst, arg_max(w, game_id) AS w FROM (SELECT *, g // 100 AS season FROM ev) GROUP BY ALL")
def directed(spark, d):
    """One edge for each winner and loser of a season: the last contest's margin."""
    g = S.listed_games(sides_of(spark, d)).where("margin <> 0")
    won = F.col("margin") > 0
    e = g.select(F.col("season").alias("g"), "game_id", F.when(won, F.col("home")).otherwise(F.col("away")).alias("src"), F.when(won, F.col("away")).otherwise(F.col("home")).alias("dst"), F.abs("margin").alias("w"))
    return e.groupBy("g", "src", "dst").agg(F.max_by("w", "game_id").alias("w"))


@query("g8_g9_distance_histogram", f"""WITH RECURSIVE {_GRAPH}, bfs AS (SELECT DISTINCT g, u AS s, u, 0 AS d FROM bw UNION SELECT f.g, f.s, b.v, f.d + 1 FROM bfs f JOIN bw b ON b.g = f.g AND b.u = f.u WHERE f.d < 12),
 sp AS (SELECT g, s, u, min(d) AS d FROM bfs GROUP BY ALL), n AS (SELECT g, count(DISTINCT u) AS n, count(*)::DOUBLE AS ends FROM bw GROUP BY g) SELECT sp.g, d, count(*)::BIGINT AS pairs, {r("any_value(2 - (ends / n) / (n - 1))")} AS bound FROM sp JOIN n USING (g) WHERE d > 0 GROUP BY ALL""")
def distance_histogram(spark, d):
    return G.distance_histogram(graph_edges(spark, d))


@query("g4_g16_signed_margins", f"""WITH {_GRAPH}, sm AS (SELECT g, team AS u, sum(m)::BIGINT AS total, count(*) AS n FROM (SELECT g, home AS team, margin AS m FROM gs UNION ALL SELECT g, away, -margin FROM gs) GROUP BY ALL), dg AS (SELECT g, u, count(*) AS degree FROM bw GROUP BY ALL), wr AS (SELECT g, src AS u, count(*) AS wins FROM we GROUP BY ALL)
 SELECT g, u, {r("total::DOUBLE / n")} AS signed, coalesce(degree, 0) AS degree, {r("coalesce(wins, 0)::DOUBLE / n")} AS win_rate FROM sm LEFT JOIN dg USING (g, u) LEFT JOIN wr USING (g, u)""")
def signed_margins(spark, d):
    """Measures of the nodes side by side: mean signed margin, degree and share of wins."""
    return G.attach(games_of(spark, d))


@query("g17_ego", f"""WITH {_GRAPH} SELECT w.g, w.src, w.dst, w.w, d.rating - s.rating > 3 AS surprise FROM we w JOIN rt s ON s.g = w.g AND s.u = src JOIN rt d ON d.g = w.g AND d.u = dst WHERE 'NATION_3' IN (src, dst)""")
def ego(spark, d):
    """One team's wins and losses, and which came against the ratings."""
    games = games_of(spark, d)
    return G.ego(G.win_edges(games), node_ratings(games), "NATION_3")


@query("g18_conference_top", f"""WITH {SIDES}, m AS (SELECT season, conf, team, sum(margin)::BIGINT AS rating FROM sides GROUP BY ALL) SELECT season, conf, team, rating, row_number() OVER (PARTITION BY season, conf ORDER BY rating DESC, team) AS place FROM m QUALIFY place <= 10""")
def conference_top(spark, d):
    m = sides_of(spark, d).groupBy("season", "conf", "team").agg(F.sum("margin").alias("rating"))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("season", "conf").orderBy(F.desc("rating"), "team"))).where("place <= 10")
