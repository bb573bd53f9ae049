"""Elo in folds, slates and rounds against one plain loop."""

import math
import random

import pytest

from fieldbook.operators.elo import elo


def plain(games):
    """(game, season, slate, home, away, margin, pool) in order, pool by pool."""
    out, now, season = {}, {}, {}
    for g, s, _, h, a, m, p in sorted(games, key=lambda x: (x[6], x[1], x[2], x[0])):
        if p in season and season[p] != s:
            for k in [k for k in now if k[0] == p]:
                now[k] = 1500 + 0.75 * (now[k] - 1500)
        season[p] = s
        eh, ea = now.get((p, h), 1500.0), now.get((p, a), 1500.0)
        lead = eh + 55 - ea
        won = 1.0 if m > 0 else 0.0
        by = 20 * math.log(abs(m) + 1) * 2.2 / ((lead if won else -lead) * 0.001 + 2.2) * (won - 1 / (1 + 10 ** (-lead / 400)))
        now[p, h], now[p, a] = eh + by, ea - by
        out[g] = eh, ea, eh + by, ea - by
    return out


def contests(seed, teams, pools, slates, per_slate):
    rng, out = random.Random(seed), []
    for pool in pools:
        for season in (2000, 2001, 2003):
            if pool == 2 and season == 2001:
                continue  # away for a season: drawn back once only
            for slate in slates:
                for _ in range(per_slate):
                    h, a = rng.sample(teams, 2)
                    out.append((len(out), season, slate, h, a, rng.choice([-20, -3, 0, 1, 7, 30]), pool))
    return out


@pytest.mark.parametrize("fold_rows, pools, slates, per_slate", [(100_000, (0, 1, 2), (1, 2, 5), 6), (2, (2,), (3, 4), 5)])
def test_all_ways_agree(spark, fold_rows, pools, slates, per_slate):
    games = contests(fold_rows, list("abcdefgh"), pools, slates, per_slate)
    df = spark.createDataFrame(games, "game_id long, season int, slate int, home string, away string, margin int, pool long").repartition(3)
    walk = {r["game_id"]: (r["home_before"], r["away_before"], r["home_after"], r["away_after"]) for r in elo(df, "pool", fold_rows).collect()}
    expected = plain(games)
    assert walk.keys() == expected.keys()
    for g, values in expected.items():
        assert walk[g] == pytest.approx(values, abs=1e-9)


def test_without_contests(spark):
    assert elo(spark.createDataFrame([], "game_id long, season int, slate int, home string, away string, margin int")).collect() == []
