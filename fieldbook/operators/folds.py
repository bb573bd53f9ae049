"""Ridge logistic fits over folds of any kind: a probability for each contest from a fit that its fold's rule allows.

A fold is a span of contests that is scored and a rule of what it learns from: all other seasons (``audit``), earlier seasons
(``expanding``) or earlier slates (``walk``). Contests shrink to cells, one for each season and slate: every Newton step adds up
gradients and curvatures by cell and fold inside Spark's tasks, folds take what their rule lets them, and all folds step together. Each
starts from the fit to everything, which is near, so two or three steps do; no fold sees a contest that its rule forbids
but in that start, and a convex fit that has converged doesn't remember where it started.

The driver holds the fits: a few dozen numbers for each fold, and folds are as many as slates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RIDGE, STEPS, TOLERANCE = 1.0, 40, 1e-8
KINDS = ("expanding", "audit", "walk")
#: Rows of one batch's design matrix.
_ROWS = 4096


def learns(kind: str, fold: int, cells: np.ndarray) -> np.ndarray:
    """Which cells (season * 100 + slate) a fold learns from; a fold is a season times 100, for ``walk`` plus the slate."""
    return cells < fold if kind != "audit" else cells // 100 != fold // 100


def fold_of(kind: str, cells: np.ndarray) -> np.ndarray:
    return cells if kind == "walk" else cells // 100 * 100


def _add_up(data: DataFrame, run) -> list:
    """Sums of all tasks by an integer key; one row of numbers for each key reaches the driver."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "sums": [np.sum(np.stack(rows["sums"].to_list()), axis=0)]})

    form = "k long, sums array<double>"
    return data.mapInPandas(run, form).groupBy("k").applyInPandas(add, form).collect()


def _designs(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for at in range(0, len(b), _ROWS):
            p = b.iloc[at : at + _ROWS]
            yield np.hstack([np.ones((len(p), 1)), p[columns].to_numpy(float)]), p["won"].to_numpy(float), p["cell"].to_numpy(np.int64)


def _standard(moments: dict[int, np.ndarray], allowed: np.ndarray, cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the training rows, from sums and squares by cell."""
    t = sum((moments[c] for c in cells[allowed]), np.zeros(2 * k + 1))
    mean = t[1 : k + 1] / t[0]
    sd = np.sqrt(np.maximum(t[k + 1 :] / t[0] - mean**2, 0))
    return mean, np.where(sd > 1e-9 * np.maximum(1.0, np.abs(mean)), sd, 1.0)


def ridge_folds(contests: DataFrame, columns: list[str], kind: str, ridge: float = RIDGE, least: int = 50) -> DataFrame:
    """``game_id``, ``season``, ``slate``, ``won``, ``fold``, ``trained`` (rows learnt from) and ``p``; columns are standardised on the training rows, the intercept is free.

    Contests of folds with fewer than ``least`` training rows are left out.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of folds: {kind}")
    spark, k = contests.sparkSession, len(columns)
    data = contests.select("game_id", "season", "slate", "won", (F.col("season") * 100 + F.col("slate")).cast("long").alias("cell"), *[F.col(c).cast("double").alias(c) for c in columns])

    def moments(batches):
        total: dict[int, np.ndarray] = {}
        for x, _, cell in _designs(batches, columns):
            one = np.hstack([x, x[:, 1:] ** 2])
            for c in np.unique(cell):
                total[int(c)] = total.get(int(c), 0) + one[cell == c].sum(axis=0)
        if total:
            yield pd.DataFrame({"k": list(total), "sums": list(total.values())})

    by_cell = {r["k"]: np.array(r["sums"]) for r in _add_up(data, moments)}
    cells = np.array(sorted(by_cell), dtype=np.int64)
    if not len(cells):
        return spark.createDataFrame([], "game_id long, season int, slate int, won int, fold long, trained long, p double")
    count = np.array([by_cell[c][0] for c in cells])
    folds = [int(f) for f in np.unique(fold_of(kind, cells)) if count[learns(kind, int(f), cells)].sum() >= least]
    trained = {f: int(count[learns(kind, f, cells)].sum()) for f in folds}
    scale = {f: _standard(by_cell, learns(kind, f, cells), cells, k) for f in folds}
    penalty = np.diag([0.0] + [ridge] * k)

    def newton(folds: list[int], allowed, scale: dict, start: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Folds step until none moves; in raw columns, so that the numbers of a row are the same for all folds."""
        beta, open_ = dict(start), list(folds)
        for _ in range(STEPS):

            def sums(batches, beta=beta, open_=tuple(open_)):
                total: dict[int, np.ndarray] = {}
                for x, won, cell in _designs(batches, columns):
                    for f in open_:
                        take = allowed(f, cell)
                        if take.any():
                            z = x[take].copy()
                            z[:, 1:] = (z[:, 1:] - scale[f][0]) / scale[f][1]
                            p = 1 / (1 + np.exp(-np.clip(z @ beta[f], -30, 30)))
                            total[f] = total.get(f, 0) + np.concatenate([z.T @ (won[take] - p), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])
                if total:
                    yield pd.DataFrame({"k": list(total), "sums": list(total.values())})

            moved = {}
            for r in _add_up(data, sums):
                f, v = r["k"], np.array(r["sums"])
                step = np.linalg.solve(v[k + 1 :].reshape(k + 1, k + 1) + penalty + 1e-12 * np.eye(k + 1), v[: k + 1] - penalty @ beta[f])
                beta = beta | {f: beta[f] + step}
                moved[f] = np.abs(step).max()
            open_ = [f for f in open_ if moved.get(f, 0) > TOLERANCE]
            if not open_:
                break
        return beta

    everything = {0: _standard(by_cell, np.ones(len(cells), bool), cells, k)}
    whole = newton([0], lambda f, cell: np.ones(len(cell), bool), everything, {0: np.zeros(k + 1)})[0]
    mean, sd = everything[0]
    slopes = whole[1:] / sd
    start = {f: np.concatenate([[whole[0] + slopes @ (scale[f][0] - mean)], slopes * scale[f][1]]) for f in folds}
    fits = newton(folds, lambda f, cell: learns(kind, f, cell), scale, start) if folds else {}

    def score(batches):
        for b in batches:
            fold = fold_of(kind, b["cell"].to_numpy(np.int64))
            for f in np.unique(fold):
                if int(f) in fits:
                    own = b[fold == f]
                    z = (own[columns].to_numpy(float) - scale[int(f)][0]) / scale[int(f)][1]
                    logits = fits[int(f)][0] + z @ fits[int(f)][1:]
                    yield own[["game_id", "season", "slate", "won"]].assign(fold=int(f), trained=trained[int(f)], p=1 / (1 + np.exp(-np.clip(logits, -30, 30))))

    return data.mapInPandas(score, "game_id long, season int, slate int, won int, fold long, trained long, p double")
