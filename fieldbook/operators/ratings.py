"""Ratings of sides: opponent-adjusted rates, linear-system strengths, and what is read off the Elo walk.

Contests shrink to sufficient statistics in Spark (a row for each season, cutoff, side, opponent and venue); only these
are iterated. The statistics of one season and cutoff, at most the square of its sides, are a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.scalars import win_probability
from fieldbook.sources.store import shared_folder

#: Values are in hundredths of a point. An unknown team is eight points under the mean.
PASSES, PRIOR_GAMES, START_HOME, UNKNOWN = 40, 4.0, 2.0, -800

#: The cutoff that takes a whole season, and the seasons up to which their lists of slates are broadcast.
WHOLE, FEW_SEASONS = 99, 1000


def statistics(two: DataFrame, cutoffs: bool = False) -> DataFrame:
    """Counts and sums for each pair and venue, of whole seasons (cutoff 99) and on request before each of their slates.

    ``n`` contests have rates on both sides and count for those; ``games``, ``margin`` and ``wins`` take all. A tie is the away side's win.
    Sums run over the slates in which a pair met and hold until it meets again, so only sums are copied to cutoffs, after the shuffle, and no
    join compares slates.
    """
    use = (F.col("off_n") > 0) & (F.col("opp_off_n") > 0)
    one = lambda x: F.sum(F.when(use, x).otherwise(0))
    pair = ["season", "team", "opponent", "div", "sign"]
    signed = two.withColumn("sign", F.when(F.col("is_home"), 1).otherwise(-1)).where(F.col("slate") < WHOLE)
    per = signed.groupBy(*pair, *(["slate"] if cutoffs else [])).agg(
        one(1).alias("n"), one(F.col("off_sum") / F.col("off_n")).alias("off"), one(F.col("opp_off_sum") / F.col("opp_off_n")).alias("def"), one(F.col("st")).alias("st"), one(F.col("tempo")).alias("tempo"),
        F.count(F.lit(1)).alias("games"), F.sum("margin").alias("margin"), F.sum(((F.col("margin") > 0) | ((F.col("margin") == 0) & ~F.col("is_home"))).cast("int")).alias("wins"),
    )
    sums = ("n", "off", "def", "st", "tempo", "games", "margin", "wins")
    columns = ["season", "cutoff", "team", "opponent", "div", "sign", *sums]
    if not cutoffs:
        return per.withColumn("cutoff", F.lit(WHOLE)).select(*columns)
    ends = signed.groupBy("season").agg(F.array_append(F.sort_array(F.collect_set("slate")), F.lit(WHOLE)).alias("ends"))  # a season has few slates
    few = len(ends.select("season").take(FEW_SEASONS + 1)) <= FEW_SEASONS
    w = Window.partitionBy(*pair).orderBy("slate")
    so_far = per.select(*pair, "slate", F.lead("slate").over(w).alias("next"), *[F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in sums])
    met = so_far.join(F.broadcast(ends) if few else ends.hint("merge"), "season")
    holds = F.filter("ends", lambda c: (c > F.col("slate")) & (c <= F.coalesce("next", c)))
    return met.withColumn("cutoff", F.explode(holds)).select(*columns)


BOOK = "season int, cutoff int, team string, games long, off double, def double, st double, tempo double, home_adv double, plays_pg double, pom double, adjo double, adjd double"


def adjusted(stats: DataFrame, passes: int = PASSES, prior: dict[str, tuple[float, float, float, float]] | None = None) -> DataFrame:
    """Offence, defence, special teams and tempo, each given the opponents' values of the pass before.

    Rates are means of the contests' points per play; a side's value is drawn to its prior with the weight of four contests where it
    has one. Each pass centres the values on the top division and re-estimates the home advantage from the residuals.
    ``pom`` is offence less what is allowed, over half a contest's plays, and special teams.
    """
    known = prior or {}

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(g["team"]) | set(g["opponent"]) | set(known))
        at = {t: i for i, t in enumerate(names)}
        i, j = g["team"].map(at).to_numpy(), g["opponent"].map(at).to_numpy()
        n, sign = g["n"].to_numpy(float), g["sign"].to_numpy(float)
        raw = [g[c].to_numpy(float) / n for c in ("off", "def", "st", "tempo")]
        total = n.sum()
        league, pace = (n * raw[0]).sum() / total, (n * raw[3]).sum() / total
        top = np.zeros(len(names), dtype=bool)
        top[i[g["div"].to_numpy() == "fbs"]] = True
        has = np.array([t in known for t in names])
        start = np.array([known.get(t, (0.0, 0.0, 0.0, pace)) for t in names])
        off, dfn, st, tempo = start.T.copy()
        home = START_HOME
        count = np.bincount(i, n, len(names))

        def step(target: np.ndarray, k: int) -> np.ndarray:
            return (np.bincount(i, n * target, len(names)) + PRIOR_GAMES * has * start[:, k]) / np.maximum(count + PRIOR_GAMES * has, 1)

        centre = lambda x: x - (x[top].mean() if top.any() else 0.0)
        for _ in range(passes):
            h = home * sign
            new = step(raw[0] - dfn[j] - league - h, 0), step(raw[1] - off[j] - league + h, 1), step(raw[2] + st[j], 2), step(raw[3] + pace - tempo[j], 3)
            off, dfn, st, tempo = centre(new[0]), centre(new[1]), centre(new[2]), centre(new[3]) + (pace if top.any() else 0.0)
            left = raw[0] - off[i] - dfn[j] - league
            means = [(n * left)[sign == s].sum() / max(n[sign == s].sum(), 1) for s in (1, -1)]
            home = (means[0] - means[1]) / 2 if (sign > 0).any() and (sign < 0).any() else home
        half = pace / 2
        return pd.DataFrame({"season": key[0], "cutoff": key[1], "team": names, "games": count.astype(int), "off": off, "def": dfn, "st": st, "tempo": tempo, "home_adv": home,
                             "plays_pg": half, "pom": (off - dfn) * half + st, "adjo": off * half, "adjd": dfn * half})

    return stats.where("n > 0").groupBy("season", "cutoff").applyInPandas(fit, BOOK)


def carried(two: DataFrame) -> DataFrame:
    """Ratings before each slate, season after season: a season starts from the last one's final values.

    At a season's first slate the book is the last final one itself. The final values of one season, a row for each team, go by the driver.
    """
    shared_folder(two.sparkSession)  # for the checkpoints
    out, prior, pace = None, None, 0.0
    for (season,) in sorted(map(tuple, two.select("season").distinct().collect())):
        mine = two.where(F.col("season") == season)
        book = adjusted(statistics(mine, cutoffs=True), prior=prior).checkpoint()
        final = book.where("cutoff = 99").collect()
        if prior:
            first = mine.agg(F.min("slate")).first()[0]
            rows = [(season, first, t, 0, *v, 0.0, pace, (v[0] - v[1]) * pace + v[2], v[0] * pace, v[1] * pace) for t, v in prior.items()]
            book = book.unionByName(two.sparkSession.createDataFrame(rows, BOOK))
        prior = {r["team"]: (r["off"], r["def"], r["st"], r["tempo"]) for r in final}
        pace = final[0]["plays_pg"] if final else pace
        out = book if out is None else out.unionByName(book)
    return out


def before(two: DataFrame, book: DataFrame) -> DataFrame:
    """For each season, slate and team the values before it: ``rating`` (``pom`` rounded to whole hundredths) and the others; with none, those of an unknown team."""
    rows = two.select("season", "slate", "team").distinct()
    b = book.select(F.col("season").alias("bs"), F.col("cutoff").alias("bc"), F.col("team").alias("bt"), "pom", "adjo", "adjd", F.col("st").alias("adjst"), F.col("tempo").alias("pace"), F.col("games").alias("rated_games"))
    met = rows.join(b.hint("merge"), (F.col("season") == F.col("bs")) & (F.col("slate") == F.col("bc")) & (F.col("team") == F.col("bt")), "left").drop("bs", "bc", "bt")
    known = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c)
    return met.select(
        "season", "slate", "team", F.coalesce(F.floor(F.col("pom") + 0.500001), F.lit(UNKNOWN)).cast("long").alias("rating"),
        known("adjo", -400.0), known("adjd", 400.0), known("adjst", 0.0), (F.coalesce("pace", F.lit(130.0)) / 2).alias("tempo_pg"), known("rated_games", 0),
    )


def elo_snapshots(walk: DataFrame) -> DataFrame:
    """The last value of each side and season."""
    sides = walk.select("season", "slate", "game_id", F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("home_after").alias("elo")), F.struct(F.col("away").alias("team"), F.col("away_after").alias("elo")))).alias("s"))
    return sides.groupBy("season", F.col("s.team").alias("team")).agg(F.max_by("s.elo", F.struct("slate", "game_id")).alias("elo"))


def elo_before(walk: DataFrame) -> DataFrame:
    """Each team's value when a slate starts."""
    sides = F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("home_before").alias("b")), F.struct(F.col("away").alias("team"), F.col("away_before").alias("b"))))
    rows = walk.select("season", "slate", "game_id", sides.alias("s"))
    return rows.groupBy("season", "slate", F.col("s.team").alias("team")).agg(F.min_by("s.b", "game_id").alias("elo"))


def srs(pairs: pd.DataFrame, names: list[str]) -> np.ndarray:
    """Ratings whose differences explain the margins; they add up to nothing."""
    at = {t: i for i, t in enumerate(names)}
    a, b = np.zeros((len(names), len(names))), np.zeros(len(names))
    for r in pairs.itertuples(index=False):
        a[at[r.team], at[r.team]] += r.n
        a[at[r.team], at[r.opponent]] -= r.n
        b[at[r.team]] += r.margin
    a[-1], b[-1] = 1.0, 0.0
    return np.linalg.lstsq(a, b, rcond=None)[0]


def colley(pairs: pd.DataFrame, names: list[str]) -> np.ndarray:
    at = {t: i for i, t in enumerate(names)}
    a, b = 2.0 * np.eye(len(names)), np.ones(len(names))
    for r in pairs.itertuples(index=False):
        a[at[r.team], at[r.team]] += r.n
        a[at[r.team], at[r.opponent]] -= r.n
        b[at[r.team]] += (2 * r.wins - r.n) / 2
    return np.linalg.solve(a, b)


def bradley_terry(pairs: pd.DataFrame, names: list[str], ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Ridge logistic strengths by Newton steps, centred."""
    at = {t: i for i, t in enumerate(names)}
    one = pairs[pairs["team"] < pairs["opponent"]]
    i, j = one["team"].map(at).to_numpy(), one["opponent"].map(at).to_numpy()
    n, w, x = one["n"].to_numpy(float), one["wins"].to_numpy(float), np.zeros(len(names))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x[i] - x[j], -30, 30)))
        grad = np.bincount(i, w - n * p, len(x)) - np.bincount(j, w - n * p, len(x)) - ridge * x
        v = n * p * (1 - p)
        hess = np.diag(np.bincount(i, v, len(x)) + np.bincount(j, v, len(x)) + ridge)
        np.add.at(hess, (i, j), -v)
        np.add.at(hess, (j, i), -v)
        move = np.linalg.solve(hess, grad)
        x += move
        if np.abs(move).max(initial=0) < 1e-6:
            break
    return x - x.mean()


def strengths(stats: DataFrame) -> DataFrame:
    """SRS, Colley and Bradley-Terry of each season and cutoff from pair counts."""

    def solve(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        pairs = g.groupby(["team", "opponent"], as_index=False)[["games", "margin", "wins"]].sum().rename(columns={"games": "n"})
        names = sorted(set(pairs["team"]))
        return pd.DataFrame({"season": key[0], "cutoff": key[1], "team": names, "srs": srs(pairs, names), "colley": colley(pairs, names), "glm": bradley_terry(pairs, names)})

    return stats.groupBy("season", "cutoff").applyInPandas(solve, "season int, cutoff int, team string, srs double, colley double, glm double")


def predict(games: DataFrame, home_edge: float = 2.5, league_points: float = 25.0) -> DataFrame:
    """Margin, win probability and points from ``home_`` and ``away_`` values (``rating``, ``adjo``, ``adjd``, in points).

    Two forms of points: ``pred_`` from ratings, in which home's own rating counts for its points and the difference for the other side's, and ``single_`` from
    offence against defence. Only the margin stands for the result; neither pair has to differ by it.
    """
    margin: Column = F.col("home_rating") - F.col("away_rating") + home_edge
    return games.withColumns({
        "pred_margin": margin, "home_win_prob": win_probability(margin), "pred_home": league_points + (F.col("home_rating") + home_edge) / 2, "pred_away": league_points - (F.col("home_rating") - F.col("away_rating") - home_edge) / 2,
        "single_home": league_points + F.col("home_adjo") + F.col("away_adjd") + home_edge / 2, "single_away": league_points + F.col("away_adjo") + F.col("home_adjd") - home_edge / 2,
    })
