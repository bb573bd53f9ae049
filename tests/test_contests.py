"""Operators of the contest model on tiny tables whose results can be worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbook.functions import scalars as X
from fieldbook.operators.elo import elo
from fieldbook.operators import calibrate as C
from fieldbook.operators import evaluate as E
from fieldbook.operators import form as FM
from fieldbook.operators import graph as G
from fieldbook.operators import history as H
from fieldbook.operators import match as M
from fieldbook.operators import ratings as R
from fieldbook.operators import sides as S
from fieldbook.operators import snaps as N
from fieldbook.streaming import logs as L

SIDE = "game_id long, season int, slate int, home string, away string, team string, opponent string, conf string, opp_conf string, div string, opp_div string, is_home boolean, points int, opp_points int, margin int, tempo int, off_sum int, off_n int, st_sum int, giveaways int, rush_yds int, rush_n int, opp_off_sum int, opp_off_n int, opp_st_sum int, opp_giveaways int, opp_rush_yds int, opp_rush_n int, st int"


def two_sides(games):
    """(season, slate, game_id, home, away, home points, away points) as sides."""
    rows = []
    for season, slate, gid, h, a, hp, ap in games:
        for team, opp, home, p, o in ((h, a, True, hp, ap), (a, h, False, ap, hp)):
            rows.append((gid, season, slate, h, a, team, opp, "c" + team[0], "c" + opp[0], "fbs", "fbs", home, p, o, p - o, 60, 10 * p, 30, 5, 1, 100, 20, 10 * o, 30, 5, 2, 90, 20, 0))
    return rows


GAMES = [(2020, 1, 1, "a", "b", 20, 10), (2020, 1, 2, "a", "c", 3, 30), (2020, 2, 3, "b", "a", 7, 14), (2020, 3, 4, "c", "a", 10, 12), (2020, 4, 5, "a", "b", 1, 0), (2021, 1, 6, "b", "a", 9, 0)]


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame(two_sides(GAMES), SIDE).cache()


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


SNAP = "game_id long, team string, gap_sum long, gap_n long, clock_sum long, clock_n long, fg_att long, fg_made long, fg_yds long, fg_exp long, punt_n long, punt_yds long, plays long"


def wide_of(spark, two):
    """The wide rows of a small table, from its own ratings and Elo."""
    before = R.before(two, R.adjusted(R.statistics(two, cutoffs=True), 5))
    walk = elo(S.listed_games(two))
    snaps = spark.createDataFrame([(g, t, 10 * g, g, 6, 2, 2, 1, 30, 150, 3, 120, 40) for g, t in [(r.game_id, r.team) for r in two.select("game_id", "team").collect()]], SNAP)
    return FM.before_slate(FM.rows(two, before, walk, snaps), before)


def test_history_sees_only_earlier_slates(spark, two):
    f = by(wide_of(spark, two), "season", "slate", "team")
    assert f[2020, 1, "a"].games == 0 and f[2020, 1, "a"].winpct == 0.5 and f[2020, 1, "a"].pom == -8.0 and f[2020, 1, "a"].elo == 1500
    assert f[2020, 2, "a"].games == 2 and f[2020, 2, "a"].winpct == 0.5 and f[2020, 2, "a"].avg_margin == -8.5
    assert f[2020, 3, "a"].rest == 1 and f[2021, 1, "a"].games == 0
    assert f[2020, 2, "a"].snap_seconds == 10.0 and f[2020, 2, "a"].fg_residual == -0.25 and f[2020, 2, "a"].punt_rate == pytest.approx(3 / 43, abs=1e-4)


@pytest.mark.parametrize("slate", [2, 3])
def test_no_feature_leaks(spark, two, slate):
    """Changing anything from a slate on changes no feature up to it."""
    other = [(s, w, g, h, a, hp + 50 * (w >= slate), ap) for s, w, g, h, a, hp, ap in GAMES if s == 2020]
    changed = spark.createDataFrame(two_sides(other), SIDE)
    one, new = (sorted(map(tuple, wide_of(spark, t).where((F.col("season") == 2020) & (F.col("slate") <= slate)).collect())) for t in (two, changed))
    assert one == new


def test_recent(spark, two):
    f = by(wide_of(spark, two), "season", "slate", "team")
    r = f[2020, 4, "a"]
    assert r.streak == 2 and r.median_margin == 4.5
    v = 0.0
    for m in (10, -27, 7, 2):
        v = 0.45 * v + 0.55 * m
    assert r.ewma_margin == pytest.approx(v, abs=1e-3)
    assert f[2020, 1, "a"].median_margin == 0 and f[2020, 1, "a"].form4_win == 0.5
    logs = [np.sign(m) * np.log1p(abs(m)) for m in (10, -27, 7, 2)]
    assert r.log_margin == pytest.approx(np.mean(logs), abs=1e-3) and r.luck == pytest.approx(0.75 - np.mean([1 / (1 + np.exp(-m / 9.5)) for m in (10, -27, 7, 2)]), abs=1e-3)
    walk = by(elo(S.listed_games(two)), "game_id")
    assert r.elo == pytest.approx(walk[5,].home_before, abs=1e-3) and r.elo_momentum == pytest.approx(walk[5,].home_before - 1500, abs=1e-3)


def test_ties_and_unknown_conferences(spark):
    """A tie is the away side's; two unknown conferences aren't the same one."""
    rows = [list(r) for r in two_sides([(2020, 1, 1, "a", "b", 7, 7), (2020, 2, 2, "a", "b", 9, 7)])]
    for r in rows:
        r[7] = r[8] = None
    f = by(wide_of(spark, spark.createDataFrame([tuple(r) for r in rows], SIDE)), "slate", "team")
    assert f[2, "a"].winpct == 0.0 and f[2, "b"].winpct == 1.0 and f[2, "a"].streak == -1
    assert f[2, "a"].conf_winpct == 0.5 and f[2, "b"].out_winpct == 1.0


def test_year_over_year_and_meetings(two):
    met = by(FM.last_meeting(two), "game_id")
    assert met[1,].h2h == 0 and met[3,].h2h == -10 and met[5,].h2h == 7 and met[6,].h2h == -1
    assert by(H.year_over_year(two), "season", "slate", "team")[2020, 2, "a"].yoy_margin == 0


def test_starters(spark, two):
    passers = spark.createDataFrame([(1, "a", "x", 3, 60), (3, "a", "y", 2, 10), (4, "a", "y", 2, 30), (6, "a", "y", 1, 5)], "game_id long, team string, passer string, epa_cnt long, epa_sum long")
    f = by(FM.starters(passers, two), "season", "slate", "team")
    assert f[2020, 1, "a"].starter is None and f[2020, 2, "a"].starter == "x" and f[2020, 2, "a"].starter_epa == 20.0 and f[2020, 2, "a"].starter_change == 1.0
    assert f[2020, 4, "a"].starter == "y" and f[2020, 4, "a"].starter_log == pytest.approx(np.log(3), abs=1e-4)
    assert f[2021, 1, "a"].starter == "y" and f[2021, 1, "a"].starter_change == 0.0 and f[2021, 1, "a"].starter_last == 10.0 and f[2021, 1, "a"].starter_epa == 0.0


def test_menus(spark, two):
    wide = wide_of(spark, two).withColumns({c: F.lit(v) for c, v in {"srs": 2.0, "colley": 0.5, "glm": 0.3, "conf_pom": 0.0, "conf_elo": 1500.0, "power": 0, "yoy_margin": 0.0, "starter_epa": 0.0, "starter_change": 0.0, "starter_log": 0.0, "starter_last": 0.0}.items()})
    m = by(FM.menu(FM.contests(two), wide, *FM.MENUS), "game_id")
    h, a = (by(wide, "season", "slate", "team")[2020, 4, t] for t in "ab")
    r = m[5,]
    assert r.avg_margin_diff == pytest.approx(h.avg_margin - a.avg_margin, abs=1e-4) and r.h2h == 7.0 and r.glm_sum == 0.6 and r.srs_diff == 0.0
    assert r.elo_tanh == pytest.approx(np.tanh((h.elo - a.elo) / 200), abs=1e-4) and r.log_pom == pytest.approx(np.sign(h.pom - a.pom) * np.log1p(abs(h.pom - a.pom)), abs=1e-4)
    assert [len(x) for x in FM.MENUS.values()] == [10, 10, 18, 12, 10, 8, 4, 2, 1, 4, 7, 4]


def test_carried_prior(two):
    """Before a season's first slate the book is the last one's final; its rows then count as four contests."""
    got = by(R.carried(two), "season", "cutoff", "team")
    final, first = got[2020, 99, "a"], got[2021, 1, "a"]
    assert first.off == final.off and first.pom == pytest.approx(final.pom) and first.games == 0
    assert got[2021, 99, "c"]["off"] is not None and got[2021, 99, "a"].games == 1


def test_garbage_and_money(spark):
    df = spark.createDataFrame([(1, 42, "$1,234"), (3, 27, "x"), (4, -22, None), (None, None, "7")], "p int, m int, t string")
    got = df.select(X.garbage(F.col("p"), F.col("m")).alias("g"), X.money(F.col("t")).alias("n")).collect()
    assert [r.g for r in got] == [True, False, True, False] and [r.n for r in got] == [1234, None, None, 7]


def test_names(spark):
    df = spark.createDataFrame([("D'Andre  Smith-Jones Jr.",)], "n string").select(X.name_key(F.col("n")).alias("k"), X.person_key(F.col("n")).alias("p")).first()
    assert df.k == "d andre smith jones jr" and df.p == "d andre smith jones"
    raw = spark.createDataFrame([("Ohio State Buckeyes",), ("Miami",), ("Zzz",)], "raw string")
    known = spark.createDataFrame([("Ohio State",), ("Ohio",), ("Miami (FL)",), ("Rice",)], "name string")
    assert {r.raw: r.name for r in M.longest_prefix(raw, known).collect()} == {"Ohio State Buckeyes": "Ohio State", "Miami": "Miami (FL)"}  # no known name starts as Zzz does


def test_prices(spark):
    r = spark.range(1).select(X.american(F.lit(0.6)).alias("a"), X.american(F.lit(0.4)).alias("b"), X.implied_sigma(F.lit(-3.0), F.lit(0.7)).alias("s"), X.settle(F.lit("home"), F.lit(3), F.lit(-3.0)).alias("x"), X.value_at_juice(F.lit(0.5)).alias("v")).first()
    assert (r.a, r.b, r.s, r.x, r.v) == (-150, 150, 14.5, "push", -5.0)


def test_adjusted_ratings_against_plain_loops(two):
    """One pass, for one season, by hand."""
    stats = R.statistics(two.where("season = 2020"))
    got = {r.team: r for r in R.adjusted(stats, 3).collect()}
    rows = [(t, o, 1 if home else -1, p * 10 / 30, q * 10 / 30) for _, s, _, h, a, hp, ap in [g for g in GAMES if g[0] == 2020] for t, o, home, p, q in ((h, a, True, hp, ap), (a, h, False, ap, hp)) for s in [s]]
    league = np.mean([r[3] for r in rows])
    off, dfn, home = dict.fromkeys("abc", 0.0), dict.fromkeys("abc", 0.0), R.START_HOME
    for _ in range(3):
        no = {t: np.mean([r[3] - dfn[r[1]] - league - home * r[2] for r in rows if r[0] == t]) for t in "abc"}
        nd = {t: np.mean([r[4] - off[r[1]] - league + home * r[2] for r in rows if r[0] == t]) for t in "abc"}
        off, dfn = ({t: v - np.mean(list(x.values())) for t, v in x.items()} for x in (no, nd))
        left = [(r[2], r[3] - off[r[0]] - dfn[r[1]] - league) for r in rows]
        home = (np.mean([x for s, x in left if s == 1]) - np.mean([x for s, x in left if s == -1])) / 2
    for t in "abc":
        assert got[t]["off"] == pytest.approx(off[t]) and got[t]["def"] == pytest.approx(dfn[t]) and got[t].home_adv == pytest.approx(home)


@pytest.mark.parametrize("few", [1000, 0])
def test_statistics_before_each_slate(spark, monkeypatch, few):
    """Running sums are what adding up all earlier slates gives, for every cutoff; no join compares slates."""
    monkeypatch.setattr(R, "FEW_SEASONS", few)
    rng = np.random.default_rng(11)
    games = []
    for i in range(80):
        h, a = (str(t) for t in rng.choice(list("abcde"), 2, replace=False))
        games.append((2020 + i % 2, int(rng.integers(1, 9)), i, h, a, int(rng.integers(0, 30)), int(rng.integers(0, 30))))
    two = spark.createDataFrame(two_sides(games), SIDE)
    found = R.statistics(two, cutoffs=True)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
    assert joins and not any("<" in x for x in joins)
    got = {(r.season, r.cutoff, r.team, r.opponent, r.sign): (r.games, r.margin, r.wins, r.n) for r in found.collect()}
    want: dict = {}
    for season, slate, _, h, a, x, y in games:
        for cutoff in {g[1] for g in games if g[0] == season} | {99}:
            if slate < cutoff:
                for t, o, sign, m in ((h, a, 1, x - y), (a, h, -1, y - x)):
                    n, total, wins = want.get((season, cutoff, t, o, sign), (0, 0, 0))
                    want[season, cutoff, t, o, sign] = n + 1, total + m, wins + (m > 0 or (m == 0 and sign < 0))
    assert {k: v[:3] for k, v in got.items()} == want
    whole = {(r.season, r.team, r.opponent, r.sign): (r.games, r.margin, r.wins) for r in R.statistics(two).collect()}
    assert whole == {(k[0], *k[2:]): v for k, v in want.items() if k[1] == 99}


def test_elo_is_zero_sum_and_reverts(two):
    walk = by(elo(S.listed_games(two)), "game_id")
    first = walk[1,]
    assert first.home_before == 1500 and first.home_after + first.away_after == pytest.approx(3000)
    assert walk[6,].away_before == pytest.approx(1500 + 0.75 * (walk[5,].home_after - 1500))


def test_linear_strengths(two):
    got = {r.team: r for r in R.strengths(R.statistics(two.where("season = 2020"))).collect()}
    assert sum(r.srs for r in got.values()) == pytest.approx(0, abs=1e-9) and sum(r.glm for r in got.values()) == pytest.approx(0, abs=1e-9)
    assert sum(r.colley for r in got.values()) == pytest.approx(1.5)
    for t, margin in (("a", (10 - 27 + 7 + 2 + 1)), ("b", -10 - 7 - 1)):
        n = {"a": 5, "b": 3}[t]
        opp = {"a": [("b", 3), ("c", 2)], "b": [("a", 3)]}[t]
        assert n * got[t].srs - sum(k * got[o].srs for o, k in opp) == pytest.approx(margin)


def test_bradley_terry_before_each_slate(spark):
    """Against Newton steps on a row for each contest, ties being the away side's."""
    games = [*[g for g in GAMES if g[0] == 2020], (2020, 5, 9, "b", "c", 7, 7), (2020, 6, 10, "c", "a", 1, 0)]
    two = spark.createDataFrame(two_sides(games), SIDE)
    got = {(r.cutoff, r.team): r.glm for r in R.strengths(R.statistics(two, cutoffs=True)).collect()}
    for cutoff in (3, 6, 99):
        played = [g for g in games if g[1] < cutoff]
        names = sorted({t for g in played for t in g[3:5]})
        x = np.array([[(t == g[3]) - (t == g[4]) for t in names] for g in played], dtype=float)
        y, b = np.array([float(g[5] > g[6]) for g in played]), np.zeros(len(names))
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ b))
            b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(names)), x.T @ (y - p) - b)
        assert [got[cutoff, t] for t in names] == pytest.approx(list(b - b.mean()), abs=1e-6)


def test_metrics_and_calibration(spark):
    p = spark.createDataFrame([(0.9, 3.0, 1, 7, -3.0), (0.2, -2.0, 1, 1, None), (1.0, 9.0, 1, 3, -3.0)], "p double, pred_margin double, won int, margin int, spread double")
    r = E.score(p).first()
    assert r.n == 3 and r.line_n == 1 and r.brier == pytest.approx((0.01 + 0.64) / 3, abs=1e-4) and r.accuracy == pytest.approx(2 / 3, abs=1e-4)
    assert {x.bucket for x in E.calibration(p).collect()} == {9, 2}


def test_graph(spark):
    e = spark.createDataFrame([(1, "a", "b", 5), (1, "b", "c", 4), (1, "a", "c", 3), (1, "c", "d", 2), (1, "x", "y", 1)], "g int, a string, b string, w int")
    assert {(r.u, r.label) for r in G.components(e).collect()} == {(u, "a") for u in "abcd"} | {("x", "x"), ("y", "x")}
    assert G.triangles(e).first().triangles == 1
    assert {(r.a, r.b) for r in G.spanning_tree(e).collect()} == {("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")}
    assert {(r.a, r.b) for r in G.bridges(e).collect()} == {("c", "d"), ("x", "y")}
    s = {r.u: r.betweenness for r in G.betweenness(e.where("a <> 'x'")).collect()}
    assert s == {"a": 0, "b": 0, "c": pytest.approx(4 / 6), "d": 0}
    lap = np.array([[2, -1, -1, 0], [-1, 2, -1, 0], [-1, -1, 3, -1], [0, 0, -1, 1]])
    f = {r.u: r for r in G.spectrum(e).collect()}
    assert set(f) == set("abcd") and f["a"].connectivity == pytest.approx(np.linalg.eigvalsh(lap)[1])
    v = np.array([f[x].fiedler for x in "abcd"])
    assert np.allclose(lap @ v, f["a"].connectivity * v)
    d = G.distance_summary(e).first()
    assert d.diameter == 2 and d.radius == 1
    flow = e.select("g", F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    assert sum(r.r for r in G.pagerank(flow).collect()) == pytest.approx(1.0)


def test_ridge_folds_against_plain_newton(spark):
    """All sets and folds at once give what a fit of each by itself does."""
    rng = np.random.default_rng(3)
    rows = [(i, 2000 + i % 3, 1, int(y * 5 - 2), int(y), *map(float, x)) for i, (x, y) in enumerate(zip(rng.normal(size=(240, 2)), rng.integers(0, 2, 240)))]
    f = spark.createDataFrame(rows, "game_id long, season int, slate int, margin long, won int, u double, v double").repartition(3)
    got = by(E.ridge_logistic_sets(f, {"one": ["u"], "two": ["u", "v"]}), "set", "game_id")
    data = np.array([[r[1], r[4], r[5], r[6]] for r in rows])
    for name, k in (("one", 1), ("two", 2)):
        for year in (2001, 2002):
            t, h = data[data[:, 0] < year], data[data[:, 0] == year]
            mean, sd = t[:, 2 : 2 + k].mean(axis=0), t[:, 2 : 2 + k].std(axis=0)
            z, b = np.hstack([np.ones((len(t), 1)), (t[:, 2 : 2 + k] - mean) / sd]), np.zeros(k + 1)
            for _ in range(30):
                p = 1 / (1 + np.exp(-z @ b))
                pen = np.diag([0.0] + [1.0] * k)
                b = b + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pen, z.T @ (t[:, 1] - p) - pen @ b)
            want = 1 / (1 + np.exp(-np.hstack([np.ones((len(h), 1)), (h[:, 2 : 2 + k] - mean) / sd]) @ b))
            ids = [r[0] for r in rows if r[1] == year]
            assert [got[name, i].p for i in ids] == pytest.approx(list(want), abs=1e-5)


def test_platt_and_permutation(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=400)
    won = (rng.random(400) < 1 / (1 + np.exp(-(0.4 + 1.7 * z)))).astype(int)
    p = spark.createDataFrame([(i, 2000, float(1 / (1 + np.exp(-x))), int(w), float(x)) for i, (x, w) in enumerate(zip(z, won))], "game_id long, season int, p double, won int, z double")
    r = C.fit_platt(p, ["season"]).first()
    q = 1 / (1 + np.exp(-(r.a + r.b * z)))
    assert abs((won - q).sum()) < 1e-5 and abs(((won - q) * z).sum()) < 1e-4
    rise = E.permutation_importance(p, ["z"], lambda c: 1.0 / (1.0 + F.exp(-c("z")))).first()
    assert rise.repeats == 5 and rise.increase > 0.02


def test_line_log_stream_equals_batch(spark, tmp_path):
    rows = [(1, 1, 1, "line", 3.0), (1, 2, 2, "price", 0.5), (1, 3, 3, "price", 1.0), (1, 4, 4, "start", 0.0), (1, 5, 5, "price", 0.7), (1, 6, 6, "line", 4.0), (2, 1, 7, "price", 0.99), (2, 2, 8, "start", 0.0), (2, 3, 9, "price", 0.6), (2, 4, 10, "price", 0.3)]
    events = spark.createDataFrame(rows, "key long, ts long, id long, kind string, value double")
    events.where("id <= 5").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    run = lambda: L.run_to_end(L.line_log_stream(stream), spark, f"file://{tmp_path}/run")
    run()
    events.where("id > 5").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = run().groupBy("key").agg(F.max_by(F.struct("line", "price", "locked"), "version").alias("x")).select("key", "x.*")
    batch = L.line_log(events).select("key", "line", "price", "locked")
    assert sorted(out.collect()) == sorted(batch.collect())
    assert {r.key: (r.line, r.price) for r in batch.collect()} == {1: (4.0, 0.5), 2: (None, 0.6)}


def test_quarters(spark):
    rows = [(1, 1, 1, 7, 0), (1, 2, 2, 7, 3), (1, 3, 3, 14, 3), (1, 4, 4, 14, 10), (2, 1, 1, 7, 0)]
    q = N.quarter_points(spark.createDataFrame(rows, "game_id long, period int, game_play_number int, home_score int, away_score int"))
    assert [tuple(r) for r in q.collect()] == [(1, 7, 0, 0, 3, 7, 0, 0, 7)]
    b = {r.quarters: r for r in N.quarter_bundles(q).collect()}
    assert b["1"].margin == 28.0 and b["1234"].real and "24" in b


def test_every_query_has_its_oracle_columns():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scrimmage_scores_money_and_ranks(spark):
    plays = spark.createDataFrame([("Offense", 0.1, None, 0, 0.0), ("Offense", 0.1, 1, 0, 0.0), ("Offense", 0.1, 0, 1, None), ("Offense", 0.1, 0, 0, 1.0), ("Offense", None, 0, 0, 0.0), ("Special", 0.1, 1, 0, 0.0)], "pos_unit string, epa double, kickoff_play int, punt int, fg_inds double")
    assert [bool(r[0]) for r in plays.select(S.scrimmage(plays)).collect()] == [True, False, False, False, False, False]
    bare = plays.select("pos_unit", "epa")
    assert [bool(r[0]) for r in bare.select(S.scrimmage(bare)).collect()] == [True, True, True, True, False, False]
    rows = spark.createDataFrame([(1, None, None, 3.0, 45.0), (2, 30.0, None, 3.0, 45.0), (3, 10.0, 121.0, 3.0, 45.0), (4, None, None, 3.0, None), (5, 7.0, 14.0, None, None)], "i int, h double, a double, m double, t double")
    h, a = X.scores_of(F.col("h"), F.col("a"), F.col("m"), F.col("t"))
    assert [tuple(r) for r in rows.orderBy("i").select(h, a).collect()] == [(24.0, 21.0), (None, None), (None, None), (None, None), (7.0, 14.0)]
    h, a = X.engine_scores(F.lit(4.0), F.col("h"), F.col("a"))
    assert [tuple(r) for r in rows.orderBy("i").select(h, a).limit(2).collect()] == [(27.0, 23.0), (17.0, 13.0)]
    text = spark.createDataFrame([(0, "$1,234"), (1, "\u2212$7"), (2, "about 5"), (3, None)], "i int, t string").orderBy("i")
    assert [r[0] for r in text.select(X.money(F.col("t"))).collect()] == [1234, -7, None, None]
    n = spark.createDataFrame([(0, 1_234_567), (1, 45_600), (2, 999)], "i int, n long").orderBy("i")
    assert [r[0] for r in n.select(X.money_label(F.col("n"))).collect()] == ["$1.2M", "$46K", "$999"]
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 2), (1, "d", 5), (1, "e", None)], "g int, u string, v int")
    up, down = E.mid_rank("v", ["g"]).alias("up"), E.mid_rank("v", ["g"], higher=False).alias("down")
    assert {r.u: (r.up, r.down) for r in v.select("u", up, down).collect()} == {"a": (0.125, 0.875), "b": (0.5, 0.5), "c": (0.5, 0.5), "d": (0.875, 0.125), "e": (None, None)}
