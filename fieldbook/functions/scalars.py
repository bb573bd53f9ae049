"""Scalar functions of contests, prices and names. Each takes and returns columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGMA_LUCK = 9.5
SIGMA_PREDICTION = 14.5


def portable_round(x: Column | str, places: int = 4) -> Column:
    """Round in plain double arithmetic, which any engine repeats; halves go up."""
    k, x = 10.0**places, F.col(x) if isinstance(x, str) else x
    return F.floor(x * k + 0.500001) / k


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(default))


# -- names


def name_key(c: Column) -> Column:
    """Lower case; whatever isn't a letter or digit becomes one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def person_key(c: Column) -> Column:
    """The name key without a generation suffix."""
    return F.trim(F.regexp_replace(name_key(c), r"\b(jr|sr|ii|iii|iv)\b", ""))


def college_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name_key(c), r"\b(state|st|university|univ)\b", ""), " +", " "))


def name_score(name: Column, query: Column) -> Column:
    """0 equal, 1 contained, 2 equal last word, else null."""
    a, b = name_key(name), name_key(query)
    return (
        F.when(a == b, 0).when(F.contains(a, b), 1)
        .when(F.element_at(F.split(a, " "), -1) == F.element_at(F.split(b, " "), -1), 2)
    )


# -- contests


def garbage(period: Column, margin: Column) -> Column:
    """Whether a play comes when the contest is decided; a null margin never is."""
    limit = F.when(F.coalesce(period, F.lit(0)) <= 1, 42).when(period == 2, 38).when(period == 3, 28).otherwise(22)
    return F.coalesce(F.abs(margin) >= limit, F.lit(False))


def slate_of(week: Column, postseason: Column) -> Column:
    return F.coalesce(week, F.lit(0)) + F.when(postseason, 20).otherwise(0)


def win_probability(margin: Column, sigma: float = SIGMA_PREDICTION) -> Column:
    return 1.0 / (1.0 + F.exp(-margin / sigma))


def log_loss(p: Column, won: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return -F.when(won == 1, F.log(q)).otherwise(F.log(1 - q))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def week_slice(week: Column) -> Column:
    return F.when(week <= 3, "early").when(week <= 8, "mid").otherwise("late")


# -- prices


def american(p: Column) -> Column:
    """American odds of a probability."""
    return F.when((p <= 0) | (p >= 1), None).when(p >= 0.5, -F.round(100 * p / (1 - p))).otherwise(F.round(100 * (1 - p) / p)).cast("int")


def mid_price(bid: Column, ask: Column, last: Column) -> Column:
    return F.when(ask > 0, (bid + ask) / 2).otherwise(F.coalesce(last, bid, ask))


def implied_sigma(margin: Column, p: Column) -> Column:
    """Spread of margins that a margin and a win probability imply, held in [10, 22]."""
    z = logit(p)
    plain = (F.abs(margin) < 0.5) | (F.abs(z) < 0.02) | (margin * z < 0) | (p <= 0) | (p >= 1)
    return F.when(plain, SIGMA_PREDICTION).otherwise(F.least(F.greatest(margin / z, F.lit(10.0)), F.lit(22.0)))


def cover_probability(margin: Column, spread: Column, sigma: Column) -> Column:
    """Probability that home covers; ``spread`` is home's line, negative for a favourite."""
    return 1.0 / (1.0 + F.exp(-(margin + spread) / sigma))


def value_at_juice(p: Column, risk: float = 110.0) -> Column:
    """Expected gain of risking ``risk`` to win 100."""
    return p * 100.0 - (1 - p) * risk


def settle(side: Column, margin: Column, spread: Column) -> Column:
    """``hit``, ``miss`` or ``push`` of a bet on a side at home's line."""
    edge = margin + spread
    return F.when(F.abs(edge) < 1e-9, "push").when((edge > 0) == (side == "home"), "hit").otherwise("miss")


def money(text: Column) -> Column:
    """Whole amounts with ``$``, commas and either minus sign; null for anything else."""
    return F.regexp_replace(F.translate(text, "\u2212", "-"), r"[$,\s]", "").try_cast("bigint")


def money_label(n: Column) -> Column:
    return F.when(F.abs(n) >= 1_000_000, F.concat(F.lit("$"), F.format_number(n / 1e6, 1), F.lit("M"))).when(
        F.abs(n) >= 1000, F.concat(F.lit("$"), F.format_number(n / 1e3, 0), F.lit("K"))
    ).otherwise(F.concat(F.lit("$"), n.cast("string")))


def share(x: Column) -> Column:
    """A percentage or a fraction as a fraction."""
    return F.when(x > 1, x / 100).otherwise(x)


def scores_of(home: Column, away: Column, margin: Column, total: Column) -> tuple[Column, Column]:
    """Scores as given, or from margin and total if both scores are unknown; null if one is missing or outside 0 to 120."""
    made = home.isNull() & away.isNull()
    h, a = F.when(made, (total + margin) / 2).otherwise(home), F.when(made, (total - margin) / 2).otherwise(away)
    ok = h.between(0, 120) & a.between(0, 120)
    return F.when(ok, h), F.when(ok, a)


def engine_scores(margin: Column, home: Column, away: Column) -> tuple[Column, Column]:
    """An engine's margin as scores: the total is that of the scores given (null: 0), or 50 if that is none."""
    given = F.coalesce(home, F.lit(0.0)) + F.coalesce(away, F.lit(0.0))
    total = F.when(given > 0, given).otherwise(50.0)
    return (total + margin) / 2, (total - margin) / 2


# -- days


def eastern_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "America/New_York"))


def next_saturday(day: Column) -> Column:
    """The day itself if it is a Saturday."""
    return F.next_day(F.date_sub(day, 1), "Sat")


# -- free text


def split_versus(title: Column) -> tuple[Column, Column]:
    """Both names of ``A vs. B``, without what follows a colon."""
    parts = F.split(F.regexp_replace(title, r":.*$", ""), r"\s+(?:vs\.?|at|@)\s+")
    return F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))


def pick_text(text: Column) -> tuple[Column, Column, Column]:
    """Name, kind (``ml`` or ``line``) and line of ``Name +3.5`` or ``Name ML``."""
    line = F.regexp_extract(text, r"([+-]\d+(?:\.\d+)?)\s*$", 1)
    ml = F.lower(text).rlike(r"\bml\s*$")
    kind = F.when(ml, "ml").when(line != "", "line")
    return F.trim(F.regexp_replace(text, r"(?i)\s*(ml|[+-]\d+(?:\.\d+)?)\s*$", "")), kind, F.when(kind == "line", line.try_cast("double"))


def after_catch(text: Column, yards: Column, own: Column, other: Column, yards_to_goal: Column) -> Column:
    """Yards after the catch from ``caught at [the] ABC 30``, whatever the case: kept within -4 and 80, to one decimal.

    The team's letters say on whose side the spot is; letters of neither side give null.
    """
    pattern = r"(?i)caught at (?:the )?([A-Z]{2,4}) ?(\d{1,2})\b"
    token, spot = F.upper(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2).try_cast("double")
    left = F.when(token == F.upper(own), 100 - spot).when(token == F.upper(other), spot)
    got = yards - (yards_to_goal - left)
    return F.when(got.between(-4, 80), F.round(got, 1))


# -- people


def class_label(year: Column) -> Column:
    return F.when(year == 1, "FR").when(year == 2, "SO").when(year == 3, "JR").when(year == 4, "SR")


def home_town(city: Column, state: Column) -> Column:
    """``City, State``, or the one that is known."""
    return F.concat_ws(", ", city, state)


def number(text: Column) -> Column:
    """A number in a text that may have a currency sign and commas; null if it is none."""
    return F.regexp_replace(text, "[$,]", "").try_cast("double")
