"""Scores of predictions, calibration, and rules for what is promoted.

A prediction has ``p`` (home wins), ``pred_margin``, ``won`` (1 or 0), ``margin`` and perhaps ``spread`` (home's line).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.scalars import log_loss, logit, portable_round, win_probability


def metrics() -> list[Column]:
    """One aggregate pass: n, accuracy, Brier, log loss, error, against the line, sharpness and expected Brier."""
    p, won = F.col("p"), F.col("won")
    edge = F.col("margin") + F.col("spread")
    bet = F.col("spread").isNotNull() & (F.abs(edge) >= 1e-9)
    right = (F.col("pred_margin") > -F.col("spread")) == (edge > 0)
    mean = lambda x: portable_round(F.sum(x) / F.count(F.lit(1)))
    return [
        F.count(F.lit(1)).alias("n"), mean(((p >= 0.5) == (won == 1)).cast("int")).alias("accuracy"), mean((p - won) * (p - won)).alias("brier"), mean(log_loss(p, won)).alias("log_loss"),
        mean(F.abs(F.col("pred_margin") - F.col("margin"))).alias("mae"), F.sum(F.coalesce(bet, F.lit(False)).cast("int")).alias("line_n"), F.sum(F.coalesce(bet & right, F.lit(False)).cast("int")).alias("line_hits"),
        mean(F.abs(p - 0.5)).alias("sharpness"), mean(p * (1 - p)).alias("expected_brier"),
    ]


def score(predictions: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    return predictions.groupBy(*by).agg(*metrics()) if by else predictions.agg(*metrics())


def calibration(predictions: DataFrame) -> DataFrame:
    """Tenths of the probability; the last holds 1."""
    return predictions.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), portable_round(F.avg("p")).alias("mean_p"), portable_round(F.sum("won") / F.count(F.lit(1))).alias("rate")
    )


def fit_grid(predictions: DataFrame, candidates: Sequence[float], transform, places: int = 6) -> DataFrame:
    """Log loss of every candidate parameter in one pass over the data; a row for each candidate."""
    row = predictions.agg(*[F.avg(log_loss(transform(F.col("p"), F.col("pred_margin"), c), F.col("won"))).alias(f"c{i}") for i, c in enumerate(candidates)])
    one = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("value"), portable_round(F.col(f"c{i}"), places).alias("loss")) for i, c in enumerate(candidates)]))
    return row.select(one.alias("x")).select("x.*")


def temperature(p: Column, _: Column, t: float) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1.0 / (1.0 + F.exp(-logit(q) / t))


def sigma(_: Column, margin: Column, s: float) -> Column:
    return win_probability(margin, s)


def shrink_weight(predictions: DataFrame, places: int = 4) -> DataFrame:
    """The weight on one half that minimises the Brier score, in closed form, held in [0, 0.5]."""
    a, b = F.col("p") - F.col("won"), F.lit(0.5) - F.col("p")
    w = -F.sum(a * b) / F.sum(b * b)
    return predictions.agg(portable_round(F.least(F.greatest(w, F.lit(0.0)), F.lit(0.5)), places).alias("weight"))


def blend_weights(predictions: DataFrame, columns: Sequence[str], step: int = 10) -> DataFrame:
    """Log loss of every point of the weight simplex, in one pass."""
    points = [(i, j, step - i - j) for i in range(step + 1) for j in range(step + 1 - i)]
    mix = lambda w: sum((F.col(c) * (k / step) for c, k in zip(columns, w)), F.lit(0.0))
    row = predictions.agg(*[F.avg(log_loss(mix(w), F.col("won"))).alias(f"w{i}") for i, w in enumerate(points)])
    one = F.explode(F.array(*[F.struct(*[F.lit(k / step).alias(f"w{n}") for n, k in enumerate(w)], portable_round(F.col(f"w{i}"), 6).alias("loss")) for i, w in enumerate(points)]))
    return row.select(one.alias("x")).select("x.*")


def stability(left: DataFrame, right: DataFrame) -> DataFrame:
    """Seasons that both have: how many, in how many the right is better, and the median difference of Brier."""
    met = left.select("season", F.col("brier").alias("a")).join(right.select("season", F.col("brier").alias("b")).hint("merge"), "season").withColumn("delta", F.col("b") - F.col("a"))
    return met.agg(F.count(F.lit(1)).alias("years"), F.sum((F.col("delta") < -1e-9).cast("int")).alias("better"), portable_round(F.percentile("delta", F.lit(0.5))).alias("median_delta"))


def promoted(brier_drop: Column, loss_delta: Column, better_years: Column, median: Column) -> Column:
    return (brier_drop >= 0.002) & (loss_delta <= 0) & ((median < 0) | (better_years >= 8))


def apply_kept(predictions: DataFrame, calibrate) -> DataFrame:
    """Calibrate ``p`` and keep it as ``raw_p``; where that is there already it is what is calibrated, so doing it again changes nothing."""
    raw = F.coalesce("raw_p", "p") if "raw_p" in predictions.columns else F.col("p")
    return predictions.withColumn("raw_p", raw).withColumn("p", calibrate(F.col("raw_p")))


def promotion(predictions: DataFrame, base: str, candidate: str) -> DataFrame:
    """Both probabilities scored by season, and whether the fixed rule takes the candidate."""
    n = F.count(F.lit(1))
    sq = lambda c: F.sum((F.col(c) - F.col("won")) * (F.col(c) - F.col("won"))) / n
    s = predictions.groupBy("season").agg(sq(base).alias("a"), sq(candidate).alias("b"), F.avg(log_loss(F.col(base), F.col("won"))).alias("la"), F.avg(log_loss(F.col(candidate), F.col("won"))).alias("lb"))
    d = F.col("b") - F.col("a")
    out = s.agg(n.alias("years"), F.sum((d < -1e-9).cast("int")).alias("better"), F.percentile(d, F.lit(0.5)).alias("m"), (F.avg("a") - F.avg("b")).alias("drop"), (F.avg("lb") - F.avg("la")).alias("loss"))
    return out.select("years", "better", portable_round("m", 5).alias("median_delta"), promoted(F.col("drop"), F.col("loss"), F.col("better"), F.col("m")).alias("promoted"))


def fold_sizes(predictions: DataFrame) -> DataFrame:
    """Training rows of each fold: of earlier seasons (``expanding``), of all other seasons (``audit``), of earlier slates (``walk``). Folds without any are left out."""
    n = F.count(F.lit(1))
    year = predictions.groupBy("season").agg(n.alias("n"))
    slate = predictions.groupBy("season", "slate").agg(n.alias("n"))
    before = lambda *o: F.sum("n").over(Window.orderBy(*o).rowsBetween(Window.unboundedPreceding, -1))  # noqa: E731  # a row for each season or slate
    fold = F.col("season") * 100
    out = year.select(F.lit("expanding").alias("kind"), fold.alias("fold"), before("season").alias("train"))
    out = out.unionByName(year.select(F.lit("audit").alias("kind"), fold.alias("fold"), (F.sum("n").over(Window.partitionBy()) - F.col("n")).alias("train")))
    out = out.unionByName(slate.select(F.lit("walk").alias("kind"), (fold + F.col("slate")).alias("fold"), before("season", "slate").alias("train")))
    return out.where("train > 0")


# ---------------------------------------------------------------- ridge fits over folds, by sums that Spark adds up


def _summed(data: DataFrame, run, schema: str) -> list:
    """Partial sums of all partitions, added up for each fold; a row of a few hundred numbers for each fold reaches the driver."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": [key[0]], "sums": [np.sum(np.stack(rows["sums"].to_list()), axis=0)]})

    return data.mapInPandas(run, schema).groupBy("fold").applyInPandas(add, schema).collect()


_SUMS = "fold int, sums array<double>"


def _folds(f: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[int, tuple[np.ndarray, np.ndarray, float]]]:
    """The data, and for each expanding fold the training rows' means, deviations and number."""
    data = f.select("game_id", "season", "slate", "margin", "won", *columns)
    k = len(columns)

    def moments(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x = b[columns].to_numpy(float)
            one = np.hstack([np.ones((len(x), 1)), x, x * x])
            for s in np.unique(b["season"]):
                total[int(s)] = total.get(int(s), 0) + one[(b["season"] == s).to_numpy()].sum(axis=0)
        yield pd.DataFrame({"fold": list(total), "sums": list(total.values())})

    per = {r["fold"]: np.array(r["sums"]) for r in _summed(data, moments, _SUMS)}
    out = {}
    for year in sorted(per)[1:]:
        t = sum(v for s, v in per.items() if s < year)
        mean = t[1 : k + 1] / t[0]
        sd = np.sqrt(np.maximum(t[k + 1 :] / t[0] - mean**2, 0))
        out[year] = mean, np.where(sd > 1e-12, sd, 1.0), t[0]
    return data, out


def _design(b: pd.DataFrame, columns: list[str], stat: tuple) -> np.ndarray:
    x = (b[columns].to_numpy(float) - stat[0]) / stat[1]
    return np.hstack([np.ones((len(x), 1)), x])


def _apply(data: DataFrame, columns: list[str], stats: dict, betas: dict, out: str, link) -> DataFrame:
    keep = ["game_id", "season", "slate", "margin", "won"]

    def run(batches):
        for b in batches:
            for year, beta in betas.items():
                part = b[b["season"] == year]
                if len(part):
                    yield part[keep].assign(**{out: link(_design(part, columns, stats[year]) @ beta)})

    return data.mapInPandas(run, f"game_id long, season int, slate int, margin long, won int, {out} double")


def ridge_logistic_sets(f: DataFrame, sets: dict[str, list[str]], ridge: float = 1.0, steps: int = 40) -> DataFrame:
    """Probabilities of each season from ridge logistic fits to all earlier ones, a fit for each named set of columns, standardised, the intercept free.

    All sets and folds take a Newton step in one pass over the data, from gradients and curvatures that partitions add up.
    """
    every = list({c: None for columns in sets.values() for c in columns})
    data, stats = _folds(f, every)
    names, years = list(sets), list(stats)
    index = {n: [0] + [1 + every.index(c) for c in sets[n]] for n in names}
    betas = {i * 10_000 + y: np.zeros(len(index[n])) for i, n in enumerate(names) for y in years}
    for _ in range(steps):

        def sums(batches, betas=betas):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for year in years:
                    part = b[b["season"] < year]
                    if not len(part):
                        continue
                    whole, won = _design(part, every, stats[year]), part["won"].to_numpy(float)
                    for key, beta in betas.items():
                        if key % 10_000 == year:
                            z = whole[:, index[names[key // 10_000]]]
                            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
                            h = (z * (p * (1 - p))[:, None]).T @ z
                            total[key] = total.get(key, 0) + np.concatenate([z.T @ (won - p), h.ravel()])
            yield pd.DataFrame({"fold": list(total), "sums": list(total.values())})

        left = {}
        for r in _summed(data, sums, _SUMS):
            v, beta = np.array(r["sums"]), betas[r["fold"]]
            k = len(beta)
            penalty = np.diag([0.0] + [ridge] * (k - 1))
            move = np.linalg.solve(v[k:].reshape(k, k) + penalty + 1e-9 * np.eye(k), v[:k] - penalty @ beta)
            left[r["fold"]] = float(np.abs(move).max()), beta + move
        betas = betas | {key: beta for key, (_, beta) in left.items()}
        if max((m for m, _ in left.values()), default=0) < 1e-6:
            break
    keep = ["game_id", "season", "slate", "margin", "won"]

    def apply(batches):
        for b in batches:
            for key, beta in betas.items():
                part = b[b["season"] == key % 10_000]
                if len(part):
                    z = _design(part, every, stats[key % 10_000])[:, index[names[key // 10_000]]]
                    yield part[keep].assign(p=1 / (1 + np.exp(-np.clip(z @ beta, -30, 30))), set=names[key // 10_000])

    return data.mapInPandas(apply, "game_id long, season int, slate int, margin long, won int, p double, set string")


def ridge_margin_folds(f: DataFrame, columns: list[str], ridge: float = 1.0) -> DataFrame:
    """Margins of each season from a ridge regression on all earlier ones: one pass of sums."""
    data, stats = _folds(f, columns)
    k = len(columns) + 1

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for year in stats:
                part = b[b["season"] < year]
                if len(part):
                    z = _design(part, columns, stats[year])
                    total[year] = total.get(year, 0) + np.concatenate([z.T @ part["margin"].to_numpy(float), (z.T @ z).ravel()])
        yield pd.DataFrame({"fold": list(total), "sums": list(total.values())})

    penalty = np.diag([0.0] + [ridge] * (k - 1)) + 1e-9 * np.eye(k)
    betas = {r["fold"]: np.linalg.solve(np.array(r["sums"][k:]).reshape(k, k) + penalty, np.array(r["sums"][:k])) for r in _summed(data, sums, _SUMS)}
    return _apply(data, columns, stats, betas, "pred", lambda x: x)


def one_slope(data: DataFrame, x: str, steps: int = 25) -> float:
    """The slope of the result's logit on one column without an intercept, by Newton steps of two sums."""
    b = 0.0
    for _ in range(steps):
        p = 1.0 / (1.0 + F.exp(-F.lit(b) * F.col(x)))
        g, h = data.agg(F.sum((F.col("won") - p) * F.col(x)), F.sum(p * (1 - p) * F.col(x) * F.col(x))).first()
        move = (g or 0.0) / (h or 1.0)
        b += move
        if abs(move) < 1e-9:
            break
    return b


def subset_scan(f: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Brier scores of the groups and of the best one without each of its columns, on the season before the last; its choice's score on the last one.

    The best group is the one with the lowest score on the season before the last.
    """
    last, chosen_on = [r[0] for r in f.select("season").distinct().orderBy(F.desc("season")).limit(2).collect()]
    sq = F.avg((F.col("p") - F.col("won")) * (F.col("p") - F.col("won")))

    def scores(sets: dict[str, list[str]]) -> dict[str, dict[int, float]]:
        out: dict[str, dict[int, float]] = {}
        for r in ridge_logistic_sets(f, sets).groupBy("set", "season").agg(sq.alias("b")).collect():
            out.setdefault(r["set"], {})[r["season"]] = r["b"]
        return out

    found = scores(groups)
    best = min(found, key=lambda n: (found[n][chosen_on], n))
    found |= scores({f"{best} without {c}": [x for x in groups[best] if x != c] for c in groups[best]})
    pick = min(found, key=lambda n: (found[n][chosen_on], n))
    return f.sparkSession.createDataFrame([(n, v[chosen_on], v[last], n == pick) for n, v in found.items()], "subset string, selected_on double, scored_on double, chosen boolean")


def boosted(f: DataFrame, columns: list[str], rounds: int = 200, seed: int = 7) -> DataFrame:
    """Gradient-boosted trees for the result and the margin before the last season: scores on it, and each column's share of the gain."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor

    parts = max(1, f.count() // 20_000)
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(f).select("season", "features", F.col("won").cast("double").alias("won"), F.col("margin").cast("double").alias("margin")).repartition(parts).persist()
    last = data.agg(F.max("season")).first()[0]
    train, test = data.where(F.col("season") < last), data.where(F.col("season") == last)
    same = {"maxIter": rounds, "stepSize": 0.05, "maxDepth": 4, "minInstancesPerNode": 40, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": seed}
    win, by = GBTClassifier(labelCol="won", **same).fit(train), GBTRegressor(labelCol="margin", predictionCol="pred", **same).fit(train)
    scored = by.transform(win.transform(test)).withColumn("p", vector_to_array("probability")[1])
    row = scored.agg(F.count(F.lit(1)), F.avg((F.col("p") - F.col("won")) * (F.col("p") - F.col("won"))), F.avg(F.abs(F.col("pred") - F.col("margin")))).first()
    data.unpersist()
    gain = [float(x) for x in win.featureImportances.toArray()]
    total = sum(map(abs, gain)) or 1.0
    return f.sparkSession.createDataFrame([(c, g / total, *row) for c, g in zip(columns, gain)], "feature string, gain_share double, n long, brier double, mae double")


def slope(predictions: DataFrame, x: str, by: Sequence[str] = ("season",)) -> DataFrame:
    """No-intercept slope of the margin's residual on ``x``; twenty rows or more."""
    e = F.col("margin") - F.col("pred_margin")
    return predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), portable_round(F.sum(F.col(x) * e) / F.sum(F.col(x) * F.col(x))).alias("slope")).where("n >= 20")


def permutation_importance(predictions: DataFrame, features: Sequence[str], model, repeats: int = 5, seed: int = 7) -> DataFrame:
    """Mean rise of the Brier score when a feature's values are dealt to other rows of the season; ``model`` gives p from columns.

    All features and deals are one join for each deal and one aggregate in all.
    """
    n = Window.partitionBy("season")
    base = predictions.withColumn("_i", F.row_number().over(n.orderBy(F.xxhash64("game_id"))))
    out = None
    for k in range(repeats):
        dealt = predictions.select(F.col("season").alias("_s"), *[F.col(f).alias(f"_{f}") for f in features], F.row_number().over(n.orderBy(F.xxhash64("game_id", F.lit(seed + k)))).alias("_j"))
        met = base.join(dealt.hint("merge"), (F.col("season") == F.col("_s")) & (F.col("_i") == F.col("_j")))
        sq = lambda p: F.avg((p - F.col("won")) * (p - F.col("won")))
        plain = sq(model(F.col))
        row = met.agg(*[(sq(model(lambda c, f=f: F.col(f"_{c}") if c == f else F.col(c))) - plain).alias(f) for f in features])
        one = row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("increase")) for f in features])).alias("x")).select("x.*")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("feature").agg(F.avg("increase").alias("increase"), F.count(F.lit(1)).alias("repeats"))


def mid_rank(value: str, pool: list[str], higher: bool = True) -> Column:
    """Share of a pool that a value beats, equal ones (itself, too) counting half. With ``higher`` false a lower value beats; a null value has none."""
    v = F.col(value)
    order = Window.partitionBy(*pool).orderBy(v.asc_nulls_last() if higher else v.desc_nulls_last())
    same, n = F.count(v).over(Window.partitionBy(*pool, v)), F.count(v).over(Window.partitionBy(*pool))
    return F.when(v.isNotNull(), (F.rank().over(order) - 1 + 0.5 * same) / n)
