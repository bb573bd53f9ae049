"""Fits of calibrations, for all groups at once, and the study that compares them.

A probability is stretched by one number (temperature: its logit over ``T``; sigma: the margin over ``s``), drawn to the training rate (shrink), or
given a slope and an intercept (Platt). In ``u = 1 / T`` the log loss is convex and the sign of its derivative says on which side the
minimum lies: each pass tries ``PROBES`` places inside every group's bracket in one aggregate and keeps the gap in which the sign turns.
All passes are one plan; no row of a group ever reaches the driver, only the number of groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.scalars import log_loss, logit, portable_round
from fieldbook.sources.store import written

PROBES, PASSES, NEWTON = 15, 8, 9
TEMPERATURES, SIGMAS = (0.4, 2.5), (6.0, 28.0)
#: A table of groups up to so many rows is sent to all tasks; a larger one meets the rows by a shuffle.
FEW = 10_000
#: Numbers that each calibration has to fit; the order in which the study prefers them.
FREE = {"identity": 0, "clip05": 0, "clip10": 0, "temperature": 1, "sigma": 1, "shrink": 2, "platt": 2}
PLACES = {"temperature": 4, "sigma": 3, "shrink": 4, "rate": 4, "a": 4, "b": 4}


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def _meet(rows: DataFrame, table: DataFrame, by: Sequence[str], few: bool) -> DataFrame:
    """Rows with their group's row of ``table``."""
    renamed = table.select(*[F.col(c).alias(f"_{c}") if c in by else F.col(c) for c in table.columns])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(F.broadcast(renamed) if few else renamed.hint("merge"), on).drop(*[f"_{c}" for c in by])


def few_groups(rows: DataFrame, by: Sequence[str]) -> bool:
    return not by or rows.select(*by).distinct().limit(FEW + 1).count() <= FEW


def fit_scales(rows: DataFrame, by: Sequence[str], fits: dict[str, tuple[Column, tuple[float, float]]], few: bool | None = None) -> DataFrame:
    """For each group and each named ``x`` the ``s`` inside its bounds for which ``sigmoid(x / s)`` has the lowest log loss, as a column of that name."""
    few = few_groups(rows, by) if few is None else few
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.cast("double").alias("x")) for k, (x, _) in fits.items()]))
    data = rows.select(*by, "won", one.alias("_x")).select(*by, "won", "_x.kind", "_x.x")
    keys, n = [*by, "kind"], PROBES + 1
    end = lambda i: F.coalesce(*[F.when(F.col("kind") == k, 1 / bounds[i]) for k, (_, bounds) in fits.items()])
    bracket = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, end(1).alias("lo"), end(0).alias("hi"))
    for _ in range(PASSES):
        at = lambda j: F.col("lo") + (F.col("hi") - F.col("lo")) * (j / n)
        slopes = [F.sum((sigmoid(at(j) * F.col("x")) - F.col("won")) * F.col("x")).alias(f"g{j}") for j in range(1, n)]
        low = _meet(data, bracket, keys, few).groupBy(*keys, "lo", "hi").agg(*slopes)
        below = sum((F.when(F.col(f"g{j}") <= 0, 1).otherwise(0) for j in range(1, n)), F.lit(0))
        low = low.select(*keys, "lo", (F.col("hi") - F.col("lo")).alias("w"), below.alias("m"))
        bracket = low.select(*keys, (F.col("lo") + F.col("w") * F.col("m") / n).alias("lo"), (F.col("lo") + F.col("w") * (F.col("m") + 1) / n).alias("hi"))
    return bracket.groupBy(*by).agg(*[F.max(F.when(F.col("kind") == k, 2.0 / (F.col("lo") + F.col("hi")))).alias(k) for k in fits])


def fit_platt(rows: DataFrame, by: Sequence[str], few: bool | None = None) -> DataFrame:
    """Intercept ``a`` and slope ``b`` on the logit of each group, by Newton steps on five sums."""
    few = few_groups(rows, by) if few is None else few
    data = rows.select(*by, logit(clipped(F.col("p"))).alias("z"), "won")
    now = data.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(*by, F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    p, z = sigmoid(F.col("a") + F.col("b") * F.col("z")), F.col("z")
    e, w = F.col("won") - p, p * (1 - p)
    for _ in range(NEWTON):
        t = _meet(data, now, by, few).groupBy(*by, "a", "b").agg(F.sum(e).alias("ga"), F.sum(e * z).alias("gb"), F.sum(w).alias("haa"), F.sum(w * z).alias("hab"), F.sum(w * z * z).alias("hbb"))
        det = F.col("haa") * F.col("hbb") - F.col("hab") * F.col("hab")
        step = lambda x: F.when(det > 1e-12, x / det).otherwise(0.0)
        now = t.select(*by, (F.col("a") + step(F.col("hbb") * F.col("ga") - F.col("hab") * F.col("gb"))).alias("a"), (F.col("b") + step(F.col("haa") * F.col("gb") - F.col("hab") * F.col("ga"))).alias("b"))
    return now


def fit_shrink(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The training rate of home wins and the weight on it in [0, 0.5] with the lowest Brier score, in closed form."""
    s = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("won").alias("rate"), F.sum("p").alias("sp"), F.sum(F.col("p") * F.col("p")).alias("spp"), F.sum(F.col("p") - F.col("won")).alias("e"), F.sum((F.col("p") - F.col("won")) * F.col("p")).alias("ep"))
    r = F.col("rate")
    w = -(r * F.col("e") - F.col("ep")) / (F.col("n") * r * r - 2 * r * F.col("sp") + F.col("spp"))
    return s.select(*by, F.least(F.greatest(w, F.lit(0.0)), F.lit(0.5)).alias("shrink"), "rate")


def parameters(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All fitted numbers of each group: ``temperature``, ``sigma``, ``shrink``, ``rate``, ``a``, ``b``."""
    few = few_groups(rows, by)
    out = fit_scales(rows, by, {"temperature": (logit(clipped(F.col("p"))), TEMPERATURES), "sigma": (F.col("pred_margin"), SIGMAS)}, few)
    for other in (fit_shrink(rows, by), fit_platt(rows, by, few)):
        out = _meet(out, other, by, few)
    return out


def applied(p: Column, margin: Column) -> dict[str, Column]:
    """A probability under every calibration, from the columns of ``parameters``."""
    clip = lambda e: F.least(F.greatest(p, F.lit(e)), F.lit(1 - e))
    z = logit(clipped(p))
    return {
        "identity": p, "clip05": clip(0.05), "clip10": clip(0.1), "temperature": sigmoid(z / F.col("temperature")), "sigma": sigmoid(margin / F.col("sigma")),
        "shrink": (1 - F.col("shrink")) * p + F.col("shrink") * F.col("rate"), "platt": sigmoid(F.col("a") + F.col("b") * z),
    }


def rounded(fitted: DataFrame, places: dict[str, int] = PLACES) -> DataFrame:
    """The numbers as they are published, which are the ones applied."""
    return fitted.select(*[portable_round(c, places[c]).alias(c) if c in places else F.col(c) for c in fitted.columns])


def under_all(rows: DataFrame, fitted: DataFrame, names: Sequence[str] = tuple(FREE), prefix: str = "") -> DataFrame:
    """``name``, ``q``, ``won`` of every row under the named calibrations; ``fitted`` is one row."""
    met = rows.crossJoin(F.broadcast(fitted))
    every = applied(F.col("p"), F.col("pred_margin"))
    one = F.explode(F.array(*[F.struct(F.lit(prefix + n).alias("name"), every[n].cast("double").alias("q")) for n in names]))
    return met.select(*rows.columns, one.alias("_x")).select(*rows.columns, "_x.name", "_x.q")


def scores(calibrated: DataFrame, prefix: str = "") -> DataFrame:
    n = F.count(F.lit(1))
    e = F.col("q") - F.col("won")
    return calibrated.groupBy("name").agg(n.alias("n"), portable_round(F.sum(e * e) / n, 5).alias(f"{prefix}brier"), portable_round(F.avg(log_loss(F.col("q"), F.col("won"))), 5).alias(f"{prefix}log_loss"))


def study(train: DataFrame, hold: DataFrame) -> DataFrame:
    """Every calibration fitted on ``train`` and scored on ``hold``, and what it scores on its own ground.

    A calibration passes if the Brier score drops by two thousandths and the log loss doesn't rise; of those that pass the one with the fewest fitted
    numbers, then the lowest Brier score, is promoted, else the raw probability stays. Rows ``oracle_`` are fitted on ``hold`` itself: a
    ceiling, never promoted.
    """
    both = train.select("p", "pred_margin", "won", F.lit(0).alias("part")).unionByName(hold.select("p", "pred_margin", "won", F.lit(1).alias("part")))
    both = written(parameters(both, ["part"]), "fitted")
    fitted, ceiling = (both.where(F.col("part") == k).drop("part") for k in (0, 1))
    fitted = rounded(fitted)
    held = scores(under_all(hold, fitted).unionByName(under_all(hold, ceiling, ("temperature", "platt"), "oracle_")))
    back = scores(under_all(train, fitted).unionByName(under_all(train, ceiling, ("temperature", "platt"), "oracle_")), "train_").drop("n")
    base = held.where("name = 'identity'").select(F.col("brier").alias("b0"), F.col("log_loss").alias("l0"))  # one row
    own = ~F.col("name").startswith("oracle_")
    plain = F.regexp_replace("name", "^oracle_", "")
    free = F.coalesce(*[F.when(plain == n, k) for n, k in FREE.items()])
    drop = F.col("b0") - F.col("brier")
    met = held.join(back.hint("merge"), "name").crossJoin(F.broadcast(base)).withColumn("free", free)
    met = met.withColumn("passes", own & (F.col("name") != "identity") & (drop >= 0.002) & (F.col("log_loss") <= F.col("l0")))
    first = F.row_number().over(Window.orderBy(F.desc(F.when(F.col("passes"), 2).when(F.col("name") == "identity", 1).otherwise(0)), "free", "brier", "name"))  # nine rows
    return met.select("name", "n", "brier", "log_loss", "train_brier", "train_log_loss", portable_round(drop, 5).alias("brier_drop"), "passes", F.col("free").alias("parameters"), (first == 1).alias("promoted"))
