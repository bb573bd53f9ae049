"""Queries of game cards, markets and picks, with their SQL twins.

Seasons before the last and the last one's first five slates count as played. Lines, starts and quotes are made from the contests' numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldbook.functions import scalars as X
from fieldbook.operators import cards as C
from fieldbook.operators import sides as S
from fieldbook.plans.contest_queries import sides_of
from fieldbook.plans.contest_sql import SIDES, book, r
from fieldbook.plans.form_queries import _BEFORE, book_of
from fieldbook.plans.live_queries import _LINE, as_log, read
from fieldbook.plans.model_queries import _PRED, predictions_of
from fieldbook.sources import markets as MK
from fieldbook.sources.store import scratch, stored
from fieldbook.streaming import logs as L

QUERIES, ORACLE_SQL = {}, {}
AS_OF = "2001-03-02 00:00:00"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- fixtures and their state


def fixtures_of(spark: SparkSession, d: str) -> DataFrame:
    two = sides_of(spark, d)
    g = S.listed_games(two)
    last = two.agg(F.max("season").alias("last"))  # one row
    played = (F.col("season") < F.col("last")) | (F.col("slate") < 6)
    start = F.make_timestamp("season", "slate", F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(F.col("game_id") % 28, F.col("game_id") % 24)
    return g.crossJoin(F.broadcast(last)).select(
        "game_id", "season", "slate", start.alias("start"), "home", "away", F.col("div").alias("home_div"), F.col("opp_div").alias("away_div"),
        F.when(played, F.col("points")).alias("home_points"), F.when(played, F.col("opp_points")).alias("away_points"),
    )


def lines_of(fixtures: DataFrame) -> DataFrame:
    """Up to three providers' lines; any may lack one."""
    one = lambda name, k: F.struct(F.lit(name).alias("provider"), F.when(F.col("game_id") % k != 0, (F.col("game_id") % (37 + k) - 18) / 2.0).alias("spread"))
    return fixtures.select("game_id", F.explode(F.array(one("north", 3), one("south", 5), one("west", 2))).alias("x")).select("game_id", "x.*")


def cards_of(spark: SparkSession, d: str) -> DataFrame:
    def make() -> DataFrame:
        f = fixtures_of(spark, d)
        return C.slate(f, lines_of(f), ["south", "north"])

    return stored(spark, d, "cards", make)


_CARDS = f"""{SIDES}, fx AS (SELECT game_id, season, slate, make_timestamp(season, slate, 1, 0, 0, 0) + to_days((game_id % 28)::INT) + to_hours(game_id % 24) AS start, home, away, home_div, away_div,
  CASE WHEN season < (SELECT max(season) FROM games) OR slate < 6 THEN home_points END AS hp, CASE WHEN season < (SELECT max(season) FROM games) OR slate < 6 THEN away_points END AS ap FROM games),
cards AS MATERIALIZED (SELECT game_id, season, slate, start, home, away, coalesce(CASE WHEN game_id % 5 <> 0 THEN (game_id % 42 - 18) / 2.0::DOUBLE END, CASE WHEN game_id % 3 <> 0 THEN (game_id % 40 - 18) / 2.0::DOUBLE END, CASE WHEN game_id % 2 <> 0 THEN (game_id % 39 - 18) / 2.0::DOUBLE END) AS spread,
  hp IS NOT NULL AS completed, hp - ap AS margin, CASE WHEN hp > ap THEN home WHEN hp < ap THEN away END AS winner, row_number() OVER (PARTITION BY season ORDER BY slate, start, home, away) AS place FROM fx WHERE home_div = 'fbs' OR away_div = 'fbs')"""


@query("s6_p11_j4_t7_slate", f"WITH {_CARDS} SELECT game_id, season, slate, home, away, spread, completed, margin, winner, place FROM cards")
def slate(spark, d):
    return cards_of(spark, d).drop("start")


@query("s7_earlier_predictions", f"WITH {_PRED} SELECT season, slate, count(*) AS n, count(*) FILTER (spread IS NOT NULL) AS with_line FROM pred WHERE season < (SELECT max(season) FROM pred) GROUP BY ALL")
def earlier_predictions(spark, d):
    p = predictions_of(spark, d)
    last = p.agg(F.max("season")).first()[0]
    return p.where(F.col("season") < last).groupBy("season", "slate").agg(F.count(F.lit(1)).alias("n"), F.count("spread").alias("with_line"))


@query("p11_both_sides", f"WITH {SIDES} SELECT season, count(*) AS games, count(*) FILTER (home_div = 'fbs' OR away_div = 'fbs') AS eligible, count(*) FILTER (home_div = 'fbs' AND away_div = 'fbs') AS both_top FROM games GROUP BY season")
def both_sides(spark, d):
    g = S.listed_games(sides_of(spark, d))
    h, a = F.col("div") == "fbs", F.col("opp_div") == "fbs"
    return g.groupBy("season").agg(F.count(F.lit(1)).alias("games"), F.sum((h | a).cast("int")).alias("eligible"), F.sum((h & a).cast("int")).alias("both_top"))


@query("p13_p17_p18_p21_open_cards", f"""WITH {_CARDS}, c AS (SELECT *, (completed OR margin IS NOT NULL OR start <= TIMESTAMP '{AS_OF}') AS passed, game_id % 7 = 0 AS locked FROM cards)
 SELECT game_id, home, away, start, passed, NOT locked AND (spread IS NULL OR start BETWEEN TIMESTAMP '{AS_OF}' AND TIMESTAMP '{AS_OF}' + INTERVAL 3 DAY) AS refresh FROM c WHERE NOT completed""")
def open_cards(spark, d):
    now = F.lit(AS_OF).cast("timestamp")
    c = cards_of(spark, d).withColumn("locked", F.col("game_id") % 7 == 0)
    return c.where(~F.col("completed")).select("game_id", "home", "away", F.col("start").cast("timestamp_ntz").alias("start"), C.kickoff_passed(now).alias("passed"), C.needs_refresh(now).alias("refresh"))


@query("t11_days_to_fetch", f"WITH {_CARDS} SELECT DISTINCT day FROM (SELECT start::DATE AS day FROM cards WHERE NOT completed UNION ALL SELECT DATE '2001-03-02') ORDER BY day LIMIT 16")
def days_to_fetch(spark, d):
    return C.days_to_fetch(cards_of(spark, d), F.lit("2001-03-02").cast("date"))


@query("t12_live_season", f"WITH {_CARDS} SELECT max(season) AS season FROM cards WHERE NOT completed")
def live_season(spark, d):
    return C.live_season(cards_of(spark, d))


@query("p14_weekend_games", f"""WITH {_CARDS}, e AS (SELECT game_id, (start AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE AS day FROM cards)
 SELECT game_id, (day + ((6 - dayofweek(day) + 7) % 7)::INT - CASE WHEN dayofweek(day) = 0 THEN 7 ELSE 0 END)::DATE AS saturday FROM e WHERE dayofweek(day) IN (5, 6, 0)""")
def weekend_games(spark, d):
    """Contests from Friday to Sunday by Eastern days, with that weekend's Saturday."""
    c = cards_of(spark, d).select("game_id", X.eastern_day(F.col("start")).alias("day"))
    w = F.dayofweek("day")
    return c.where(w.isin(1, 6, 7)).select("game_id", F.date_add("day", F.when(w == 1, -1).otherwise(7 - w)).alias("saturday"))


@query("s10_j18_matrix", f"WITH {SIDES}, {_BEFORE} SELECT g.game_id, {r('h.rating / 100.0::DOUBLE - a.rating / 100.0::DOUBLE')} AS pom_diff, (home_points > away_points)::INT AS y FROM games g JOIN before h ON h.season = g.season AND h.slate = g.slate AND h.team = home JOIN before a ON a.season = g.season AND a.slate = g.slate AND a.team = away")
def matrix(spark, d):
    """A stored feature matrix with its contests, aligned by key and not by position."""
    from fieldbook.plans.form_queries import QUERIES as FORM

    m = stored(spark, d, "matrix_locked", lambda: FORM["f1_locked_menu"](spark, d)).select("game_id", "pom_diff")
    y = S.listed_games(sides_of(spark, d)).select("game_id", (F.col("margin") > 0).cast("int").alias("y"))
    return m.join(y.hint("merge"), "game_id")


@query("s11_book_load", f"WITH {SIDES}, {book()} SELECT season, team, {r('pom', 2)} AS pom FROM book WHERE cutoff = 99")
def book_load(spark, d):
    """Books dumped in two versions, one with the rating under its old name, read back as one."""
    b = book_of(spark, d).where("cutoff = 99").select("season", "team", "pom")
    old, new = b.where("season % 2 = 0").withColumnRenamed("pom", "palm"), b.where("season % 2 = 1")
    both = stored(spark, d, "books_old", lambda: old).unionByName(stored(spark, d, "books_new", lambda: new), allowMissingColumns=True)
    return both.select("season", "team", X.portable_round(F.coalesce("pom", "palm"), 2).alias("pom"))


@query("s15_slate_template", f"WITH {_CARDS} SELECT season || ',' || slate || ',' || away || ',' || home || ',' || coalesce(printf('%.1f', spread), '') AS line FROM cards WHERE NOT completed")
def slate_template(spark, d):
    c = cards_of(spark, d).where(~F.col("completed"))
    return c.select(F.concat_ws(",", "season", "slate", "away", "home", F.when(F.col("spread").isNotNull(), F.format_string("%.1f", "spread")).otherwise("")).alias("line"))


# ---------------------------------------------------------------- markets as JSON inside JSON


def market_events(spark: SparkSession, d: str) -> DataFrame:
    """Cards as a venue's events: a title, a slug (some twice), and markets whose outcomes and prices are JSON texts."""
    c = cards_of(spark, d)
    p = F.round((F.col("game_id") % 97 + 2) / 100.0, 2)
    text = lambda a, b: F.concat(F.lit('["'), a.cast("string"), F.lit('", "'), b.cast("string"), F.lit('"]'))
    market = lambda kind, prices, line: F.struct(F.lit(kind).alias("kind"), text(F.col("away"), F.col("home")).alias("outcomes"), prices.alias("prices"), line.cast("double").alias("line")).cast("struct<kind:string,outcomes:string,prices:string,line:double>")
    payload = F.to_json(F.struct(
        F.concat("away", F.lit(" vs. "), "home", F.when(F.col("game_id") % 2 == 0, ": Spread").otherwise("")).alias("title"), F.concat(F.lit("g"), F.col("game_id")).alias("slug"),
        F.array(market("moneyline", text(F.format_number(1 - p, 2), F.format_number(p, 2)), F.lit(None)), market("spreads", text(F.lit("0.5"), F.lit("0.5")), F.col("spread"))).alias("markets"),
    ).cast("struct<title:string,slug:string,markets:array<struct<kind:string,outcomes:string,prices:string,line:double>>>"))
    copies = F.explode(F.when(F.col("game_id") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return c.select(payload.alias("payload"), copies.alias("copy")).select("payload")


_QUOTE = "(game_id % 97 + 2) / 100.0::DOUBLE"


@query("s16_u6_p16_market_events", f"""WITH {_CARDS} SELECT 'g' || game_id AS slug, away AS side_a, home AS side_b, {r(f'1 - {_QUOTE}', 2)} AS ml_a, {r(_QUOTE, 2)} AS ml_b, spread AS line, {_QUOTE} > 0.02 AND {_QUOTE} < 0.98 AS live FROM cards""")
def parsed_events(spark, d):
    schema = "title string, slug string, markets array<struct<kind:string,outcomes:string,prices:string,line:double>>"
    e = market_events(spark, d).select(F.from_json("payload", schema).alias("e")).select("e.*")
    out = MK.parse_events(e)
    return out.select("slug", "side_a", "side_b", X.portable_round("ml_a", 2).alias("ml_a"), X.portable_round("ml_b", 2).alias("ml_b"), "line", L.live(F.col("ml_b")).alias("live"))


@query("s17_x13_exchange_spreads", f"""WITH {_CARDS}, m AS (SELECT game_id AS event, k * 3.5::DOUBLE AS points, (game_id * k % 80 + 5) / 100.0::DOUBLE AS bid, CASE WHEN (game_id + k) % 4 = 0 THEN 0.0 ELSE (game_id * k % 80 + 5 + k) / 100.0::DOUBLE END AS ask, (game_id * k % 80 + 6) / 100.0::DOUBLE AS l FROM cards, (SELECT unnest([1, 2, 3, 4]) AS k)),
 q AS (SELECT *, CASE WHEN ask > 0 THEN (bid + ask) / 2 ELSE l END AS p FROM m) SELECT event, points, {r('p')} AS p FROM q QUALIFY row_number() OVER (PARTITION BY event ORDER BY abs(p - 0.5), ask - bid, points) = 1""")
def exchange(spark, d):
    k = F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)]))
    c = cards_of(spark, d).select(F.col("game_id").alias("event"), "home", k.alias("k"))
    base = F.col("event") * F.col("k") % 80 + 5
    m = c.select("event", F.concat("home", F.lit(" wins by over "), (F.col("k") * 3.5).cast("string"), F.lit(" points")).alias("title"), (base / 100.0).alias("bid"),
                 F.when((F.col("event") + F.col("k")) % 4 == 0, 0.0).otherwise((base + F.col("k")) / 100.0).alias("ask"), ((base + 1) / 100.0).alias("last"))
    return MK.exchange_spreads(m).withColumn("p", X.portable_round("p"))


@query("j17_merged_quotes", f"""WITH {_CARDS}, m AS (SELECT home, away, start::DATE AS day, game_id % 89 AS ml FROM cards WHERE game_id % 3 <> 0), s AS (SELECT home, away, start::DATE AS day, spread FROM cards WHERE game_id % 4 <> 0)
 SELECT home, away, day, ml, spread FROM m FULL JOIN s USING (home, away, day)""")
def merged_quotes(spark, d):
    c = cards_of(spark, d).withColumn("day", F.to_date("start"))
    return C.merge_quotes(c.where("game_id % 3 <> 0").select("home", "away", "day", (F.col("game_id") % 89).alias("ml")), c.where("game_id % 4 <> 0").select("home", "away", "day", "spread"))


@query("j6_st3_st7_stamped_log", f"WITH {_CARDS}, {_LINE} SELECT game_id, line, price, locked FROM cards LEFT JOIN log ON log.key = game_id % 400")
def stamped_log(spark, d):
    """Each card with its log's line and price, which are taken in the log's own rules (what comes after the lock moves the line only)."""
    log = L.line_log(as_log(read(spark, d, "events"))).select("key", "line", "price", "locked")
    return C.stamp_log(cards_of(spark, d).withColumn("key", F.col("game_id") % 400), log).select("game_id", "line", "price", "locked")


# ---------------------------------------------------------------- facts, prices and picks


@query("j21_game_facts", f"""WITH {_PRED}, b AS (SELECT season, team, pom / 100.0::DOUBLE AS pom, tempo / 2 AS tempo FROM book WHERE cutoff = 99)
 SELECT p.game_id, {r('h.pom - a.pom', 2)} AS gap, {r('(h.tempo + a.tempo) / 2', 2)} AS mean_tempo, CASE WHEN p >= 0.5 THEN p.home ELSE p.away END AS favourite, {r('abs(pred_margin - p.margin)', 2)} AS margin_error,
 {r('50.0::DOUBLE / 2 + (hr + 2.5::DOUBLE) / 2 + (50.0::DOUBLE / 2 - (hr - ar - 2.5::DOUBLE) / 2) - (g.home_points + g.away_points)', 1)} AS total_error FROM pred p JOIN games g USING (game_id) LEFT JOIN b h ON h.season = p.season AND h.team = p.home LEFT JOIN b a ON a.season = p.season AND a.team = p.away""")
def game_facts(spark, d):
    total = S.listed_games(sides_of(spark, d)).select("game_id", (F.col("points") + F.col("opp_points")).alias("total"))
    teams = book_of(spark, d).where("cutoff = 99").select("season", "team", (F.col("pom") / 100.0).alias("pom"), (F.col("tempo") / 2).alias("tempo"))
    return C.facts(predictions_of(spark, d).join(total.hint("merge"), "game_id"), teams)


@query("x20_x12_moneyline", f"""WITH {_PRED}, q AS (SELECT game_id, p, {_QUOTE} AS m FROM pred), s AS (SELECT *, p - m >= 0 AS h, CASE WHEN p - m >= 0 THEN p ELSE 1 - p END AS own, CASE WHEN p - m >= 0 THEN m ELSE 1 - m END AS theirs FROM q)
 SELECT game_id, CASE WHEN h THEN 'home' ELSE 'away' END AS side, {r('abs(p - m)')} AS edge, (CASE WHEN own >= 0.5 THEN -round(100 * own / (1 - own)) ELSE round(100 * (1 - own) / own) END)::INT AS fair_odds,
 (CASE WHEN theirs >= 0.5 THEN -round(100 * theirs / (1 - theirs)) ELSE round(100 * (1 - theirs) / theirs) END)::INT AS market_odds FROM s""")
def moneyline(spark, d):
    m = (F.col("game_id") % 97 + 2) / 100.0
    return predictions_of(spark, d).select("game_id", *[c.alias(k) for k, c in C.moneyline(F.col("p"), m).items()])


_MODELS = "1.0 / (1.0 + exp(-(pred_margin + spread) / {s}::DOUBLE))"


@query("x18_x19_consensus", f"""WITH {_PRED}, l AS (SELECT game_id, pred_margin, coalesce(CASE WHEN game_id % 4 <> 0 THEN spread + 0.5 END, CASE WHEN game_id % 3 <> 0 THEN spread - 0.5 END, spread) AS spread FROM pred), c AS (SELECT game_id, spread, CASE WHEN game_id % 2 = 0 THEN {_MODELS.format(s=14.5)} END AS a, {_MODELS.format(s=9.5)} AS b, {_MODELS.format(s=18.0)} AS c FROM l WHERE spread IS NOT NULL)
 SELECT game_id, spread AS line, {r('CASE WHEN a IS NULL THEN (b + c) / 2 ELSE (a + b + c) / 3 END')} AS cover FROM c""")
def consensus(spark, d):
    """The first source's line that has one, else the listed one; and the mean cover chance of the models that have one."""
    p = predictions_of(spark, d)
    line = F.coalesce(F.when(F.col("game_id") % 4 != 0, F.col("spread") + 0.5), F.when(F.col("game_id") % 3 != 0, F.col("spread") - 0.5), "spread")
    p = p.withColumn("line", line).where("line is not null")
    cover = lambda s: X.cover_probability(F.col("pred_margin"), F.col("line"), F.lit(s))
    models = F.create_map(F.lit("base"), F.when(F.col("game_id") % 2 == 0, cover(14.5)), F.lit("sharp"), cover(9.5), F.lit("wide"), cover(18.0))
    return p.select("game_id", "line", X.portable_round(C.consensus(models)).alias("cover"))


def picks_of(spark: SparkSession, d: str) -> DataFrame:
    """Three owners' picks of each card, of all kinds."""
    c = cards_of(spark, d)
    o = F.explode(F.array(*[F.lit(i) for i in (0, 1, 2)]))
    c = c.select("*", o.alias("o"))
    k = (F.col("game_id") + F.col("o")) % 3
    side = F.when((F.col("game_id") + F.col("o")) % 2 == 0, "home").otherwise("away")
    line = C.pick_line(F.when(F.col("game_id") % 6 == 0, F.lit(3.5)), side, F.col("spread"))
    return c.select(F.concat(F.lit("owner"), F.col("o")).alias("owner"), "game_id", "season", "home", "away", "margin", "completed", F.when(k == 0, "score").when(k == 1, "ats").otherwise("ml").alias("kind"), side.alias("side"), line.alias("line"),
                    ((F.col("game_id") * (F.col("o") + 3)) % 41 - 20).cast("double").alias("pick_margin"))


_PICKS = f"""{_CARDS}, ow AS (SELECT *, o FROM cards, (SELECT unnest([0, 1, 2]) AS o)), pk AS MATERIALIZED (SELECT 'owner' || o AS owner, game_id, season, home, away, margin, completed, CASE (game_id + o) % 3 WHEN 0 THEN 'score' WHEN 1 THEN 'ats' ELSE 'ml' END AS kind,
  CASE WHEN (game_id + o) % 2 = 0 THEN 'home' ELSE 'away' END AS side, CASE WHEN game_id % 6 = 0 THEN 3.5::DOUBLE WHEN (game_id + o) % 2 = 0 THEN spread ELSE -spread END AS line, ((game_id * (o + 3)) % 41 - 20)::DOUBLE AS pick_margin FROM ow)"""
_PICK_RESULT = """CASE WHEN NOT completed THEN 'pending' WHEN kind = 'ats' THEN CASE WHEN line IS NULL THEN 'pending' WHEN abs(margin + CASE WHEN side = 'home' THEN line ELSE -line END) < 1e-9 THEN 'push' WHEN (margin + CASE WHEN side = 'home' THEN line ELSE -line END > 0) = (side = 'home') THEN 'hit' ELSE 'miss' END
  WHEN margin = 0 THEN 'push' WHEN kind = 'ml' THEN CASE WHEN (margin > 0) = (side = 'home') THEN 'hit' ELSE 'miss' END ELSE CASE WHEN (pick_margin > 0) = (margin > 0) THEN 'hit' ELSE 'miss' END END"""


@query("a26_a27_pick_grades", f"""WITH {_PICKS}, g AS (SELECT *, {_PICK_RESULT} AS result FROM pk)
 SELECT owner, kind, count(*) FILTER (result = 'hit') AS hits, count(*) FILTER (result = 'miss') AS misses, count(*) FILTER (result = 'push') AS pushes, count(*) FILTER (result = 'pending') AS pending,
 {r("avg(abs(pick_margin - margin)) FILTER (kind = 'score' AND completed)", 3)} AS mae, {r("avg(margin - pick_margin) FILTER (kind = 'score' AND completed)", 3)} AS residual FROM g GROUP BY ALL""")
def pick_grades(spark, d):
    return C.grade(picks_of(spark, d))


@query("x28_x29_pick_labels", f"""WITH {_PICKS} SELECT owner, game_id, (CASE WHEN side = 'home' THEN home ELSE away END) || ' ' || CASE WHEN kind = 'ml' THEN 'ML' WHEN line = 0 THEN 'PK' ELSE (CASE WHEN line > 0 THEN '+' ELSE '-' END) || printf('%.1f', abs(line)) END AS label FROM pk WHERE kind <> 'score'""")
def pick_labels(spark, d):
    p = picks_of(spark, d).where("kind <> 'score'")
    return p.select("owner", "game_id", C.pick_label(F.when(F.col("side") == "home", F.col("home")).otherwise(F.col("away")), F.col("kind"), F.col("line")).alias("label"))


@query("j20_q14_pick_book", f"""WITH {_PICKS}, n AS (SELECT owner, game_id, 'home' AS side, 1.5::DOUBLE AS line, 'ats' AS kind FROM pk WHERE game_id % 5 = 0)
 SELECT owner, game_id, coalesce(n.kind, pk.kind) AS kind, coalesce(n.side, pk.side) AS side, CASE WHEN n.kind IS NULL THEN pk.line ELSE n.line END AS line FROM pk LEFT JOIN n USING (owner, game_id)""")
def pick_book(spark, d):
    p = picks_of(spark, d).select("owner", "game_id", "kind", "side", "line")
    new = p.where("game_id % 5 = 0").select("owner", "game_id", F.lit("ats").alias("kind"), F.lit("home").alias("side"), F.lit(1.5).alias("line"))
    return C.merge_picks(p, new)


@query("a28_slate_summary", f"""WITH {_PRED} SELECT season, slate, count(*) AS n, count(*) FILTER ((p >= 0.5) = (won = 1)) AS hits, {r('sum(margin - pred_margin) / count(*)', 3)} AS residual, {r('sum(abs(margin - pred_margin)) / count(*)', 3)} AS mae,
 count(*) FILTER (spread IS NOT NULL AND abs(margin + spread) < 1e-9) AS pushes FROM pred GROUP BY ALL""")
def slate_summary(spark, d):
    p = predictions_of(spark, d)
    e = F.col("margin") - F.col("pred_margin")
    n = F.count(F.lit(1))
    return p.groupBy("season", "slate").agg(n.alias("n"), F.sum(((F.col("p") >= 0.5) == (F.col("won") == 1)).cast("int")).alias("hits"), X.portable_round(F.sum(e) / n, 3).alias("residual"), X.portable_round(F.sum(F.abs(e)) / n, 3).alias("mae"),
                                            F.sum(F.coalesce((F.abs(F.col("margin") + F.col("spread")) < 1e-9).cast("int"), F.lit(0))).alias("pushes"))


@query("q5_t2_p15_game_list", f"""WITH {_PRED}, e AS (SELECT game_id, season, slate, home, away, p, 1.0 / (1.0 + exp(-(pred_margin + spread) / 14.5::DOUBLE)) AS c FROM pred WHERE season = 2000 AND (contains(lower(home), 'nation_1') OR contains(lower(away), 'nation_1')))
 SELECT game_id, slate, home, away, {r('p')} AS p, {r('greatest(c, 1 - c) * 100 - (1 - greatest(c, 1 - c)) * 110', 3)} AS value FROM e ORDER BY greatest(c, 1 - c) DESC NULLS LAST, game_id LIMIT 24""")
def game_list(spark, d):
    """Contests of a season in which a name holds the text, best expected value first; without a line they come last."""
    p = predictions_of(spark, d).where("season = 2000").where(F.contains(F.lower("home"), F.lit("nation_1")) | F.contains(F.lower("away"), F.lit("nation_1")))
    c = X.cover_probability(F.col("pred_margin"), F.col("spread"), F.lit(14.5))
    best = F.when(F.col("spread").isNotNull(), F.greatest(c, 1 - c))
    return p.withColumn("best", best).orderBy(F.desc_nulls_last("best"), "game_id").limit(24).select("game_id", "slate", "home", "away", X.portable_round("p").alias("p"), X.portable_round(X.value_at_juice(F.col("best")), 3).alias("value"))


@query("m28_t6_model_catalog", f"""WITH {_PRED}, m AS (SELECT unnest(['base', 'coin', 'sharp']) AS model, unnest([p, 0.5::DOUBLE, 1.0 / (1.0 + exp(-pred_margin / 9.5::DOUBLE))]) AS q, won FROM pred UNION ALL SELECT 'user' AS model, CASE WHEN game_id % 3 = 0 THEN 0.6::DOUBLE ELSE 0.45::DOUBLE END AS q, won FROM pred WHERE game_id % 2 = 0),
 s AS (SELECT model, count(*) AS n, {r('sum((q - won) * (q - won)) / count(*)', 5)} AS brier, {r('count(*) FILTER ((q >= 0.5) = (won = 1))::DOUBLE / count(*)')} AS rate FROM m GROUP BY model) SELECT *, row_number() OVER (ORDER BY brier, rate DESC, model) AS place FROM s""")
def model_catalog(spark, d):
    """House engines in a map and a user's model, scored together and put in order."""
    p = predictions_of(spark, d)
    house = p.select("won", F.explode(F.create_map(F.lit("base"), F.col("p"), F.lit("coin"), F.lit(0.5), F.lit("sharp"), X.win_probability(F.col("pred_margin"), 9.5))).alias("model", "q"))
    user = p.where("game_id % 2 = 0").select("won", F.lit("user").alias("model"), F.when(F.col("game_id") % 3 == 0, 0.6).otherwise(0.45).alias("q"))
    n = F.count(F.lit(1))
    s = house.unionByName(user).groupBy("model").agg(n.alias("n"), X.portable_round(F.sum((F.col("q") - F.col("won")) * (F.col("q") - F.col("won"))) / n, 5).alias("brier"), X.portable_round(F.sum(((F.col("q") >= 0.5) == (F.col("won") == 1)).cast("int")) / n).alias("rate"))
    return s.withColumn("place", F.row_number().over(Window.orderBy("brier", F.desc("rate"), "model")))  # a row for each model


# ---------------------------------------------------------------- context


@query("s18_context_events", f"""WITH {_CARDS} SELECT game_id, CASE WHEN game_id % 3 <> 0 THEN (game_id % 60)::DOUBLE END AS temperature, CASE WHEN game_id % 3 <> 0 THEN 'sky ' || game_id % 4 END AS sky, {r('CASE game_id % 2 WHEN 0 THEN (game_id % 99 + 1) / 100.0::DOUBLE ELSE (game_id % 99 + 1) / 100.0::DOUBLE END')} AS home_chance,
 spread AS line, home || '|' || away AS passers FROM cards""")
def context_events(spark, d):
    """Nested JSON of each card, some parts missing, a percentage or a fraction, one name twice, flattened."""
    from fieldbook.sources.context import SHAPE, parse_context

    c = cards_of(spark, d)
    percent = F.col("game_id") % 99 + 1
    leader = lambda x, p: F.struct(F.col(x), F.lit(p)).cast("struct<name:string,position:string>")
    weather = F.when(F.col("game_id") % 3 != 0, F.struct((F.col("game_id") % 60).cast("double"), F.concat(F.lit("sky "), F.col("game_id") % 4)))
    chance = F.when(F.col("game_id") % 2 == 0, F.when(percent > 1, percent.cast("string")).otherwise("0.01")).otherwise((percent / 100.0).cast("string"))
    payload = F.struct(weather, F.struct(F.struct(chance)), F.array(*[F.struct(F.lit(n), x).cast("struct<provider:string,spread:double>") for n, x in (("a", F.lit(None)), ("b", F.col("spread")))]),
                       F.array(leader("home", "QB"), leader("away", "QB"), leader("home", "QB"), leader("away", "RB"))).cast(SHAPE)
    out = parse_context(c.select("game_id", F.to_json(payload).alias("payload")))
    return out.withColumn("passers", F.array_join("passers", "|")).withColumn("home_chance", X.portable_round("home_chance"))


@query("st2_context_log", """WITH ev AS (SELECT user_id AS key, {'t': ts, 'i': event_id} AS a, CASE event_type WHEN 'view' THEN 'odds' WHEN 'click' THEN 'predictor' WHEN 'signup' THEN 'weather' WHEN 'error' THEN 'passers' ELSE 'lock' END AS kind, value FROM events WHERE NOT (user_id % 10 = 0 AND event_type <> 'purchase' AND event_id < 5000)),
 lk AS (SELECT key, min(a) AS l FROM ev WHERE kind = 'lock' GROUP BY key), m AS (SELECT ev.*, l, l IS NULL OR a < l AS early FROM ev LEFT JOIN lk USING (key)),
 g AS (SELECT key, max_by(value, a) FILTER (kind = 'weather' AND early) AS weather, max_by(value, a) FILTER (kind = 'predictor' AND early) AS predictor, max_by(value, a) FILTER (kind = 'odds' AND early) AS odds, max_by(value, a) FILTER (kind = 'passers' AND early) AS passers,
  coalesce(bool_or(kind <> 'lock' AND early), false) AS had, min_by(kind, a) FILTER (kind <> 'lock' AND NOT early) AS lk, min_by(value, a) FILTER (kind <> 'lock' AND NOT early) AS lv, bool_or(l IS NOT NULL) AS locked FROM m GROUP BY key)
 SELECT key, coalesce(weather, CASE WHEN NOT had AND lk = 'weather' THEN lv END) AS weather, coalesce(predictor, CASE WHEN NOT had AND lk = 'predictor' THEN lv END) AS predictor, coalesce(odds, CASE WHEN NOT had AND lk = 'odds' THEN lv END) AS odds, coalesce(passers, CASE WHEN NOT had AND lk = 'passers' THEN lv END) AS passers, locked FROM g""")
def context_log_query(spark, d):
    """Fields frozen at the lock; every tenth key has no record before it and takes its first one after."""
    from fieldbook.sources.context import context_log

    e = read(spark, d, "events").where("not (user_id % 10 = 0 and event_type <> 'purchase' and event_id < 5000)")
    kind = F.when(F.col("event_type") == "view", "odds").when(F.col("event_type") == "click", "predictor").when(F.col("event_type") == "signup", "weather").when(F.col("event_type") == "error", "passers").otherwise("lock")
    return context_log(e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), kind.alias("kind"), "value"))


_KINDS = {"view": "odds", "click": "predictor", "signup": "weather", "error": "passers"}


@query("st2_st7_context_stream", f"""WITH ev AS (SELECT user_id AS key, {{'t': ts, 'i': event_id}} AS a, ts, event_id, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())} ELSE 'lock' END AS kind, value FROM events WHERE ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)),
 lk AS (SELECT key, min(a) AS l FROM ev WHERE kind = 'lock' GROUP BY key), m AS (SELECT ev.*, l, l IS NULL OR a < l AS early FROM ev LEFT JOIN lk USING (key)),
 o AS (SELECT key, value IS DISTINCT FROM lag(value) OVER w OR lag(a) OVER w IS NULL AS moved FROM m WHERE kind = 'odds' AND early WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)), sn AS (SELECT key, least(24, count(*) FILTER (moved))::INT AS snapshots FROM o GROUP BY key),
 g AS (SELECT key, {", ".join(f"max_by(value, a) FILTER (kind = '{k}' AND early) AS {k}" for k in ("weather", "predictor", "odds", "passers"))}, bool_or(kind <> 'lock' AND early) AS had, min_by(kind, a) FILTER (kind <> 'lock' AND NOT early) AS lk, min_by(value, a) FILTER (kind <> 'lock' AND NOT early) AS lv, bool_or(l IS NOT NULL) AS locked, count(*) AS version FROM m GROUP BY key)
 SELECT key, {", ".join(f"coalesce({k}, CASE WHEN NOT had AND lk = '{k}' THEN lv END) AS {k}" for k in ("weather", "predictor", "odds", "passers"))}, locked, coalesce(snapshots, 0) AS snapshots, version FROM g LEFT JOIN sn USING (key)""")
def context_stream_query(spark, d):
    """All events as a stream of context records, as far as the watermark has come: fields frozen at the lock, changes of the odds counted."""
    from fieldbook.plans.live_queries import event_stream
    from fieldbook.streaming import context

    e = event_stream(spark, d)
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _KINDS.items()], F.lit("lock"))
    out = context.run(e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), kind.alias("kind"), "value"), spark, scratch(spark))
    return out.withColumn("snapshots", F.size("snapshots"))


@query("st3_st4_score_stream", f"""WITH {SIDES}, g AS (SELECT game_id, margin FROM sides WHERE is_home)
 SELECT game_id, 0.5::DOUBLE AS p, coalesce(CASE WHEN game_id % 3 <> 0 THEN (game_id % 21 - 10)::DOUBLE END, CASE WHEN game_id % 2 = 0 THEN (game_id % 15 - 7)::DOUBLE END) AS spread, CASE WHEN game_id % 2 = 0 THEN margin::DOUBLE END AS actual, game_id % 3 = 0 AND game_id % 2 = 0 AS filled FROM g""")
def score_stream(spark, d):
    """Two reports of every second contest in micro-batches of their own, a line and then the score with another line, stamped onto frozen projections."""
    from fieldbook.streaming import stamps

    g = S.listed_games(sides_of(spark, d)).select("game_id", "margin")
    proj = g.select("game_id", F.lit(0.5).alias("p"), F.when(F.col("game_id") % 3 != 0, (F.col("game_id") % 21 - 10).cast("double")).alias("spread"))
    path = scratch(spark)
    for k in (1, 2):
        line = F.col("game_id") % 15 - 7 if k == 1 else F.col("game_id") % 9
        score = F.when(F.lit(k == 2), F.col("margin").cast("double"))
        g.where("game_id % 2 = 0").select("game_id", F.timestamp_seconds(F.lit(k)).alias("ts"), F.lit(k).cast("long").alias("id"), score.alias("margin"), line.cast("double").alias("spread")).coalesce(1).write.parquet(f"{path}/in/{k}")
    schema = spark.read.parquet(f"{path}/in/1").schema
    stamps.stamp_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*"), proj, path)
    return stamps.stamped(proj, stamps.stamps_of(spark, path))


@query("j15_pick_cascade", f"""WITH {_CARDS}, g AS (SELECT game_id, season * 100 + slate AS week, home, away, NOT completed AS open FROM cards WHERE season = 2001 AND slate >= 5), p AS (SELECT game_id AS pick, CASE WHEN game_id % 5 = 0 THEN game_id END AS gid, CASE WHEN game_id % 5 = 1 THEN week END AS week, CASE WHEN game_id % 5 < 3 THEN home END AS home, CASE WHEN game_id % 5 < 3 THEN away END AS away, CASE WHEN game_id % 5 >= 3 THEN lower(replace(home, '_', ' ')) END AS name FROM g),
 s AS (SELECT pick, g.game_id AS gid, p.week AS pw, g.week AS gw, count(*) OVER (PARTITION BY pick) AS n FROM p JOIN g ON g.home = p.home AND g.away = p.away),
 nm AS (SELECT pick, game_id AS gid, open FROM p JOIN (SELECT game_id, open, unnest([home, away]) AS side FROM g) ON lower(replace(side, '_', ' ')) = name), n1 AS (SELECT *, count(*) OVER (PARTITION BY pick) AS n FROM nm), n2 AS (SELECT *, count(*) OVER (PARTITION BY pick) AS n FROM nm WHERE open),
 t AS (SELECT pick, gid, 0 AS tier FROM p WHERE gid IS NOT NULL UNION ALL SELECT pick, gid, 1 FROM s WHERE pw = gw UNION ALL SELECT pick, gid, 2 FROM s WHERE n = 1 UNION ALL SELECT pick, gid, 3 FROM n1 WHERE n = 1 UNION ALL SELECT pick, gid, 4 FROM n2 WHERE n = 1)
 SELECT pick, gid, tier FROM t QUALIFY row_number() OVER (PARTITION BY pick ORDER BY tier, gid) = 1""")
def pick_cascade(spark, d):
    from fieldbook.operators import match as M

    g = cards_of(spark, d).where("season = 2001 and slate >= 5").select("game_id", (F.col("season") * 100 + F.col("slate")).alias("week"), "home", "away", (~F.col("completed")).alias("open"))
    k = F.col("game_id") % 5
    p = g.select(F.col("game_id").alias("pick"), F.when(k == 0, F.col("game_id")).alias("game_id"), F.when(k == 1, F.col("week")).alias("week"), F.when(k < 3, F.col("home")).alias("home"), F.when(k < 3, F.col("away")).alias("away"), F.when(k >= 3, F.lower(F.replace("home", F.lit("_"), F.lit(" ")))).alias("name"))
    return M.picks_cascade(p, g)
