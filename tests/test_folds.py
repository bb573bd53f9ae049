"""Folds of every kind against plain refits, one fold after another."""

import numpy as np
import pytest

from fieldbook.operators.folds import fold_of, learns, ridge_folds


def refit(x, y, ridge=1.0):
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 1e-9, sd, 1.0)
    z, b = np.hstack([np.ones((len(x), 1)), (x - mean) / sd]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        pen = np.diag([0.0] + [ridge] * x.shape[1])
        b = b + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pen, z.T @ (y - p) - pen @ b)
    return lambda q: 1 / (1 + np.exp(-(b[0] + ((q - mean) / sd) @ b[1:])))


@pytest.fixture(scope="module")
def games():
    rng = np.random.default_rng(3)
    out = []
    for season in (2000, 2001, 2003):
        for slate in (1, 2, 3, 7):
            for _ in range(15):
                a, b = rng.normal(3, 5), rng.normal()
                out.append((len(out), season, slate, int(rng.random() < 1 / (1 + np.exp(-0.2 * a - 0.5 * b))), float(a), float(b), 4.0))
    return out


@pytest.mark.parametrize("kind", ["expanding", "audit", "walk"])
def test_every_contest_gets_the_probability_of_a_plain_refit(spark, games, kind):
    df = spark.createDataFrame(games, "game_id long, season int, slate int, won int, a double, b double, same double").repartition(3)
    got = {r["game_id"]: (r["p"], r["trained"]) for r in ridge_folds(df, ["a", "b", "same"], kind, least=30).collect()}
    g = np.array(games, dtype=float)
    cells, want = (g[:, 1] * 100 + g[:, 2]).astype(int), {}
    for f in np.unique(fold_of(kind, cells)):
        train = learns(kind, int(f), cells)
        if train.sum() >= 30:
            model = refit(g[train][:, 4:], g[train][:, 3])
            for r in g[fold_of(kind, cells) == f]:
                want[int(r[0])] = model(r[4:]), int(train.sum())
    assert got.keys() == want.keys() and len(want) == {"expanding": 120, "audit": 180, "walk": 150}[kind]
    for i, (p, n) in want.items():
        assert got[i][0] == pytest.approx(p, abs=1e-7) and got[i][1] == n


def test_later_results_change_no_walk(spark, games):
    schema = "game_id long, season int, slate int, won int, a double, b double, same double"
    turned = [(*r[:3], 1 - r[3] if r[1:3] >= (2001, 3) else r[3], *r[4:]) for r in games]
    one, other = ({r["game_id"]: r["p"] for r in ridge_folds(spark.createDataFrame(x, schema), ["a", "b"], "walk").where("season * 100 + slate <= 200103").collect()} for x in (games, turned))
    assert one.keys() == other.keys() and len(one) and all(one[i] == pytest.approx(other[i], abs=1e-7) for i in one)


def test_empty(spark):
    assert ridge_folds(spark.createDataFrame([], "game_id long, season int, slate int, won int, a double"), ["a"], "walk").collect() == []
