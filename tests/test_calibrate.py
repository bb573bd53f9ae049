"""Fitted calibrations against plain minimisers."""

import math
import random

import pytest

from fieldbook.operators import calibrate as C


def rows(seed, n, season):
    rng, out = random.Random(seed), []
    for _ in range(n):
        m = rng.gauss(2, 12)
        p = min(max(1 / (1 + math.exp(-m / rng.choice([6, 9]))), 0), 1)
        out.append((season, p, m, int(rng.random() < 1 / (1 + math.exp(-m / 15)))))
    return out


def loss(q, y):
    q = min(max(q, 1e-12), 1 - 1e-12)
    return -math.log(q if y else 1 - q)


def golden(f, lo, hi):
    r = (math.sqrt(5) - 1) / 2
    for _ in range(120):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if f(a) < f(b) else (a, hi)
    return (lo + hi) / 2


def logit(p):
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


@pytest.fixture(scope="module")
def data():
    flat = [(3, 0.5, 0.0, 1), (3, 0.5, 0.0, 0), (3, 0.9, 4.0, 1), (3, 0.2, -3.0, 0)]  # always right: both scales end at a bound
    return rows(1, 400, 1) + rows(2, 150, 2) + flat


@pytest.mark.parametrize("few", [10_000, 1])
def test_all_groups_at_once_against_golden_sections(spark, data, monkeypatch, few):
    monkeypatch.setattr(C, "FEW", few)
    df = spark.createDataFrame(data, "season int, p double, pred_margin double, won int")
    got = {r["season"]: r for r in C.parameters(df.where("season < 3"), ["season"]).collect()}
    for s in (1, 2):
        mine = [x for x in data if x[0] == s]
        t = golden(lambda t: sum(loss(sigmoid(logit(p) / t), y) for _, p, _, y in mine), 0.4, 2.5)
        g = golden(lambda v: sum(loss(sigmoid(m / v), y) for _, _, m, y in mine), 6, 28)
        rate = sum(x[3] for x in mine) / len(mine)
        w = golden(lambda w: sum(((1 - w) * p + w * rate - y) ** 2 for _, p, _, y in mine), 0, 0.5)
        assert got[s]["temperature"] == pytest.approx(t, abs=1e-5) and got[s]["sigma"] == pytest.approx(g, abs=1e-4)
        assert got[s]["shrink"] == pytest.approx(w, abs=1e-6) and got[s]["rate"] == pytest.approx(rate)
        a, b = got[s]["a"], got[s]["b"]
        at = lambda a, b: sum(loss(sigmoid(a + b * logit(p)), y) for _, p, _, y in mine)
        assert all(at(a, b) <= at(a + da, b + db) + 1e-12 for da, db in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)))


def test_scales_end_at_their_bounds(spark, data):
    df = spark.createDataFrame([x for x in data if x[0] == 3], "season int, p double, pred_margin double, won int")
    from pyspark.sql import functions as F

    r = C.fit_scales(df, [], {"t": (C.logit(F.col("p")), C.TEMPERATURES), "s": (F.col("pred_margin"), C.SIGMAS)}).first()
    assert r["t"] == pytest.approx(0.4, abs=1e-6) and r["s"] == pytest.approx(6, abs=1e-6)


def test_study_promotes_by_rule_and_never_a_ceiling(spark, data):
    df = spark.createDataFrame([x for x in data if x[0] < 3], "season int, p double, pred_margin double, won int")
    got = {r["name"]: r for r in C.study(df.where("season = 1"), df.where("season = 2")).collect()}
    assert set(got) == {*C.FREE, "oracle_temperature", "oracle_platt"}
    base = got["identity"]
    passed = [r for n, r in got.items() if not n.startswith("oracle") and n != "identity" and base["brier"] - r["brier"] >= 0.002 and r["log_loss"] <= base["log_loss"]]
    assert {r["name"] for r in passed} == {n for n, r in got.items() if r["passes"]}
    best = min(passed, key=lambda r: (r["parameters"], r["brier"], r["name"]))["name"] if passed else "identity"
    assert [n for n, r in got.items() if r["promoted"]] == [best]
    assert got["oracle_temperature"]["log_loss"] <= got["temperature"]["log_loss"] + 1e-5 and not got["oracle_platt"]["passes"]
