"""Queries of logs, names, pages and documents of people, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.functions import scalars as X
from fieldbook.operators import match as M
from fieldbook.plans.contest_queries import sides_of
from fieldbook.plans.contest_sql import ELO_BY_SEASON, PLAYS, SIDES, r
from fieldbook.operators import sides as S
from fieldbook.sources import pages as P
from fieldbook.sources import tables as T
from fieldbook.sources.contests import contest_plays
from fieldbook.sources.store import scratch
from fieldbook.streaming import logs as L

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(spark, d, t) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def as_log(events: DataFrame) -> DataFrame:
    """Events as a log: views move the line, clicks give a price, the first purchase starts the contest."""
    kind = F.when(F.col("event_type") == "view", "line").when(F.col("event_type") == "click", "price").when(F.col("event_type") == "purchase", "start").otherwise("other")
    value = F.when(F.col("event_type") == "click", F.col("value") / 100.0).otherwise(F.col("value"))
    return events.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), kind.alias("kind"), value.alias("value"))


_LOG = """ev AS (SELECT user_id AS key, ts, event_id AS id, CASE event_type WHEN 'view' THEN 'line' WHEN 'click' THEN 'price' WHEN 'purchase' THEN 'start' ELSE 'other' END AS kind,
  CASE WHEN event_type = 'click' THEN value / 100.0::DOUBLE ELSE value END AS value FROM events)"""
_LINE = f"""{_LOG}, st AS (SELECT key, min({{'t': ts, 'i': id}}) AS s FROM ev WHERE kind = 'start' GROUP BY key),
 m AS (SELECT e.*, s IS NULL OR {{'t': ts, 'i': id}} < s AS early, value > 0.02 AND value < 0.98 AS lv, {{'t': ts, 'i': id}} AS a FROM ev e LEFT JOIN st USING (key)),
 log AS (SELECT key, max_by(value, a) FILTER (kind = 'line') AS line, coalesce(max_by(value, a) FILTER (kind = 'price' AND lv AND early), min_by(value, a) FILTER (kind = 'price' AND lv AND NOT early), max_by(value, a) FILTER (kind = 'price')) AS price,
  bool_or(kind = 'start') AS locked, count(*) AS version FROM m GROUP BY key)"""


@query("st1_line_log", f"WITH {_LINE} SELECT * FROM log")
def line_log(spark, d):
    return L.line_log(as_log(read(spark, d, "events")))


def event_stream(spark, d) -> DataFrame:
    """The event files as a stream; a glob takes a table of one file as well as of many."""
    schema = read(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")


@query("st1_line_log_stream", f"WITH {_LINE} SELECT * FROM log")
def line_log_stream(spark, d):
    """The last version of each key that the stream gave out."""
    out = L.run_to_end(L.line_log_stream(as_log(event_stream(spark, d))), spark, scratch(spark))
    return out.groupBy("key").agg(*[F.max_by(c, "version").alias(c) for c in ("line", "price", "locked")], F.max("version").alias("version"))


@query("st2_wn36_snapshots", f"""WITH {_LOG}, st AS (SELECT key, min(ts) AS s FROM ev WHERE kind = 'start' GROUP BY key),
 o AS (SELECT e.* FROM ev e LEFT JOIN st USING (key) WHERE kind = 'line' AND (s IS NULL OR ts < s)), c AS (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY ts, id) AS was FROM o)
 SELECT key, ts, id, value, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS age FROM c WHERE was IS NULL OR was <> value QUALIFY age <= 24""")
def snapshots(spark, d):
    return L.snapshots(as_log(read(spark, d, "events")))


_CARD = f"WITH {_LOG} SELECT date_trunc('day', ts)::TIMESTAMP AS day, kind, count(*) AS n, sum(trunc(value * 100)::BIGINT)::BIGINT AS cents FROM ev GROUP BY ALL"


@query("st6_daily_card", _CARD)
def daily_card(spark, d):
    return L.daily_card(as_log(read(spark, d, "events"))).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("st6_daily_card_stream", f"SELECT * FROM ({_CARD}) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def daily_card_stream(spark, d):
    """Days that the watermark has closed."""
    out = L.run_to_end(L.daily_card(as_log(event_stream(spark, d))), spark, scratch(spark))
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("st5_live_ratings_stream", f"WITH RECURSIVE {SIDES}, {ELO_BY_SEASON} SELECT game_id, false AS late, {r('hb', 3)} AS home_before, {r('ab', 3)} AS away_before FROM walk")
def live_ratings(spark, d):
    """Contests of the year's months as a stream into each season's pool."""
    games = S.listed_games(sides_of(spark, d)).select(F.col("season").alias("pool"), F.col("slate").alias("slate_no"), "game_id", "home", "away", "margin")
    path = scratch(spark)
    games.write.parquet(f"{path}/games")
    stream = spark.readStream.schema(games.schema).parquet(f"{path}/games")
    out = L.run_to_end(L.rating_stream(stream), spark, f"{path}/run")
    return out.select("game_id", "late", X.portable_round("home_before", 3).alias("home_before"), X.portable_round("away_before", 3).alias("away_before"))


@query("j5_st4_score_stamp", f"""WITH {SIDES}, g AS (SELECT game_id, margin FROM sides WHERE is_home), p AS (SELECT game_id, 0.5::DOUBLE AS p, CASE WHEN game_id % 3 = 0 THEN NULL ELSE (game_id % 21 - 10)::DOUBLE END AS spread FROM g),
 s AS (SELECT game_id, margin, (game_id % 15 - 7)::DOUBLE AS spread FROM g WHERE game_id % 2 = 0)
 SELECT p.game_id, p, coalesce(p.spread, s.spread) AS spread, s.margin::DOUBLE AS actual, p.spread IS NULL AND s.spread IS NOT NULL AS filled FROM p LEFT JOIN s USING (game_id)""")
def score_stamp(spark, d):
    g = S.listed_games(sides_of(spark, d)).select("game_id", "margin")
    proj = g.select("game_id", F.lit(0.5).alias("p"), F.when(F.col("game_id") % 3 != 0, (F.col("game_id") % 21 - 10).cast("double")).alias("spread"))
    return L.stamp(proj, g.withColumn("margin", F.col("margin").cast("double")).where(F.col("game_id") % 2 == 0).withColumn("spread", (F.col("game_id") % 15 - 7).cast("double")))


@query("s13_page_rows", r"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<(?:table|ul)\b[^>]*>(.*?)</(?:table|ul)>', 1)) AS body, generate_subscripts(regexp_extract_all(html, '(?s)<(?:table|ul)\b[^>]*>(.*?)</(?:table|ul)>', 1), 1) - 1 AS block FROM pages WHERE html IS NOT NULL),
 o AS (SELECT page_id, block, unnest(CASE WHEN regexp_matches(body, '<tr\b') THEN regexp_extract_all(body, '(?s)<tr\b[^>]*>(.*?)</tr>', 1) ELSE [body] END) AS one, generate_subscripts(CASE WHEN regexp_matches(body, '<tr\b') THEN regexp_extract_all(body, '(?s)<tr\b[^>]*>(.*?)</tr>', 1) ELSE [body] END, 1) - 1 AS row FROM b)
 SELECT page_id, block::INT AS block, row::INT AS row, array_to_string(list_transform(regexp_extract_all(one, '(?s)<(?:td|th|li)\b[^>]*>(.*?)</(?:td|th|li)>', 1), lambda c: trim(regexp_replace(c, '<[^>]*>', '', 'g'))), '|') AS cells FROM o
 WHERE len(regexp_extract_all(one, '(?s)<(?:td|th|li)\b[^>]*>(.*?)</(?:td|th|li)>', 1)) > 0""")
def page_rows(spark, d):
    return P.page_rows(read(spark, d, "pages")).withColumn("cells", F.array_join("cells", "|"))


#: Suppliers on one made page of costs.
_ON_PAGE = 50


@query("s13_published_costs", f"""SELECT CASE WHEN (s_suppkey // {_ON_PAGE}) % 2 = 0 THEN 'roster' ELSE 'spend' END AS route, s_name || ' & Co' AS team, 'Conf ' || (s_suppkey // {_ON_PAGE}) AS conference, (floor(s_acctbal) * 1000)::BIGINT AS amount,
 (s_suppkey // {_ON_PAGE})::BIGINT AS page_id FROM supplier WHERE (s_suppkey // {_ON_PAGE}) % 2 = 0 OR s_suppkey % 4 <> 0""")
def published_costs(spark, d):
    """Suppliers stand for teams: Spark writes them as pages (entities, a cell that spans its table, unclosed tags, two kinds of headers), which are read back."""
    s = read(spark, d, "supplier").select("s_suppkey", (F.expr(f"s_suppkey div {_ON_PAGE}")).alias("page_id"), F.concat("s_name", F.lit(" &amp; Co")).alias("team"), (F.floor("s_acctbal") * 1000).cast("bigint").alias("n"))
    sign = F.when(F.col("n") < 0, F.when(F.col("s_suppkey") % 2 == 0, "-").otherwise("&minus;")).otherwise("")
    amount = F.concat(sign, F.lit("$"), F.format_number(F.abs("n"), 0))
    roster = F.struct("s_suppkey", F.concat(F.lit("<tr><td>"), "team").alias("head"), F.concat(F.lit("<td>"), amount, F.lit("</td></tr>")).alias("tail"))
    spend = F.struct("s_suppkey", F.concat(F.lit("<tr><td><b>"), "team", F.lit("</b></td><td>"), "s_suppkey", F.lit("<td>"), F.when(F.col("s_suppkey") % 4 == 0, "FCS").otherwise("FBS")).alias("head"), F.concat(F.lit("<td>1</td><td> "), amount, F.lit("\n</td>")).alias("tail"))
    is_roster = F.col("page_id") % 2 == 0
    rows = s.groupBy("page_id").agg(F.array_sort(F.collect_list(F.when(is_roster, roster).otherwise(spend))).alias("rows"))
    shared = F.concat(F.lit("<td rowspan="), F.size("rows"), F.lit(">Conf "), "page_id", F.lit("</td>"))
    body = F.array_join(F.transform("rows", lambda x, i: F.concat(x["head"], F.when(i == 0, shared).otherwise(""), x["tail"])), "")
    header = F.when(is_roster, "<tr><th>Team<th>Conference<th>2026 Roster Cost estimate").otherwise("<tr><th>School<th>Spending rank</th><th>Subdivision<th>Conference<th>Teams<th>FY 2025</tr>")
    return T.cost_records(T.page_tables(rows.select("page_id", F.concat(F.lit("<html><p>x<table><tbody>"), header, body, F.lit("</table>")).alias("html"))))


@query("x31_event_props", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def event_props(spark, d):
    return P.event_props(read(spark, d, "events"))


@query("x14_p14_days", """SELECT event_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE::VARCHAR AS eastern, ts::DATE::VARCHAR AS utc,
 ((ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE + ((6 - dayofweek((ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE) + 7) % 7)::INT)::DATE::VARCHAR AS saturday FROM events""")
def days(spark, d):
    e = read(spark, d, "events").select("event_id", X.eastern_day(F.col("ts")).alias("eastern"), F.to_date("ts").alias("utc"))
    return e.withColumn("saturday", X.next_saturday(F.col("eastern"))).select("event_id", *[F.col(c).cast("string").alias(c) for c in ("eastern", "utc", "saturday")])


_KEY = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


@query("x1_x6_name_keys", f"SELECT p_partkey, {_KEY('p_name')} AS key, trim(regexp_replace({_KEY('p_name')}, '\\b(jr|sr|ii|iii|iv)\\b', '', 'g')) AS person FROM part")
def name_keys(spark, d):
    return read(spark, d, "part").select("p_partkey", X.name_key(F.col("p_name")).alias("key"), X.person_key(F.col("p_name")).alias("person"))


@query("x3_x4_resolve", "SELECT n_name AS raw, 0 AS tier, n_name AS name FROM nation UNION ALL SELECT lower(replace(n_name, '_', ' ')), 2, n_name FROM nation UNION ALL SELECT 'the ' || n_name, 1, n_name FROM nation")
def resolve(spark, d):
    n = read(spark, d, "nation").select(F.col("n_name").alias("name"))
    raw = n.select(F.col("name").alias("raw")).union(n.select(F.lower(F.replace("name", F.lit("_"), F.lit(" "))))).union(n.select(F.concat(F.lit("the "), F.col("name"))))
    aliases = n.select(F.concat(F.lit("the "), F.col("name")).alias("alias"), "name")
    return M.resolve_names(raw, n, aliases).select("raw", "tier", "name")


@query("x4_longest_prefix", f"SELECT s_name || ' of ' || n_name AS raw, s_name AS name, 0 AS tier FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def longest_prefix(spark, d):
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return M.longest_prefix(s.select(F.concat("s_name", F.lit(" of "), "n_name").alias("raw")), s.select(F.col("s_name").alias("name")))


_TIER = """pe AS (SELECT c_custkey AS pid, c_name AS name, c_mktsegment AS college FROM customer),
rc AS (SELECT o_orderkey AS rid, year(o_orderdate) AS year, c_name AS rname, CASE WHEN o_orderkey % 3 = 0 THEN c_mktsegment ELSE o_orderpriority END AS rcollege FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("j8_tiered_match", f"""WITH {_TIER}, a AS (SELECT pid, {_KEY('name')} AS pk, {_KEY('college')} AS pc FROM pe), b AS (SELECT rid, year, {_KEY('rname')} AS rk, {_KEY('rcollege')} AS rcol FROM rc),
 s AS (SELECT pid, rid, year, CASE WHEN pc = rcol THEN 0 ELSE 1 END AS tier FROM a JOIN b ON pk = rk
  UNION ALL SELECT pid, rid, year, 2 FROM a JOIN b ON split_part(pk, ' ', -1) = split_part(rk, ' ', -1) AND pc = rcol)
 SELECT pid, rid, year, tier FROM s QUALIFY row_number() OVER (PARTITION BY pid ORDER BY tier, year DESC, rid) = 1""")
def tiered_match(spark, d):
    c = read(spark, d, "customer")
    people = c.select(F.col("c_custkey").alias("pid"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("college"))
    rec = read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("rid"), F.year("o_orderdate").alias("year"), F.col("c_name").alias("rname"), F.when(F.col("o_orderkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("o_orderpriority")).alias("rcollege"))
    return M.tiered(people, rec)


@query("j9_bind_books", f"""WITH {SIDES}, g AS (SELECT game_id, home, away, make_date(season, slate, 1) AS day FROM games), b AS (SELECT game_id AS bid, away AS a, home AS b, CASE WHEN game_id % 4 = 0 THEN NULL ELSE day END AS day FROM g)
 SELECT bid, game_id FROM b JOIN g ON least(a, b.b) = least(home, away) AND greatest(a, b.b) = greatest(home, away) AND coalesce(b.day = g.day, true) QUALIFY row_number() OVER (PARTITION BY bid ORDER BY g.day NULLS LAST, game_id) = 1""")
def bind_books(spark, d):
    g = S.listed_games(sides_of(spark, d)).select("game_id", "home", "away", F.make_date("season", "slate", F.lit(1)).alias("day"))
    books = g.select(F.col("game_id").alias("bid"), F.col("away").alias("a"), F.col("home").alias("b"), F.when(F.col("game_id") % 4 != 0, F.col("day")).alias("day"))
    return M.bind(books, g)


@query("j15_picks_to_games", f"""WITH {SIDES}, g AS (SELECT game_id, season * 100 + slate AS week, home, away FROM games), p AS (SELECT game_id AS pick, CASE WHEN game_id % 3 = 0 THEN game_id END AS gid, CASE WHEN game_id % 3 = 1 THEN week END AS week, home, away FROM g),
 s AS (SELECT pick, g.game_id AS gid, p.week AS pw, g.week AS gw, count(*) OVER (PARTITION BY pick) AS n FROM p JOIN g ON g.home = p.home AND g.away = p.away),
 t AS (SELECT pick, gid, 0 AS tier FROM p WHERE gid IS NOT NULL UNION ALL SELECT pick, gid, 1 FROM s WHERE pw = gw UNION ALL SELECT pick, gid, 2 FROM s WHERE n = 1)
 SELECT pick, gid, tier FROM t QUALIFY row_number() OVER (PARTITION BY pick ORDER BY tier, gid) = 1""")
def picks_to_games(spark, d):
    g = S.listed_games(sides_of(spark, d)).select("game_id", (F.col("season") * 100 + F.col("slate")).alias("week"), "home", "away")
    k = F.col("game_id") % 3
    return M.picks_to_games(g.select(F.col("game_id").alias("pick"), F.when(k == 0, F.col("game_id")).alias("game_id"), F.when(k == 1, F.col("week")).alias("week"), "home", "away"), g)


@query("q11_search", f"""WITH e AS (SELECT 'nation' AS kind, n_name AS name FROM nation UNION ALL SELECT 'supplier', s_name FROM supplier UNION ALL SELECT 'customer', c_name FROM customer), s AS (SELECT kind, name, CASE WHEN {_KEY('name')} = 'nation 3' THEN 0 WHEN contains({_KEY('name')}, 'nation 3') THEN 1 WHEN split_part({_KEY('name')}, ' ', -1) = '3' THEN 2 END AS score FROM e)
 SELECT * FROM s WHERE score IS NOT NULL ORDER BY score, kind, name LIMIT 20""")
def search(spark, d):
    kinds = (("nation", "n_name"), ("supplier", "s_name"), ("customer", "c_name"))
    e = None
    for t, c in kinds:
        one = read(spark, d, t).select(F.lit(t).alias("kind"), F.col(c).alias("name"))
        e = one if e is None else e.unionByName(one)
    return M.search(e, "NATION_3")


@query("a33_nested_stats", """WITH l AS (SELECT user_id, event_type, 'n' AS f, count(*)::DOUBLE AS v FROM events GROUP BY ALL UNION ALL SELECT user_id, event_type, 'top', max(value) FROM events GROUP BY ALL)
 SELECT user_id::VARCHAR AS player, count(DISTINCT event_type)::INT AS buckets, max(v) FILTER (event_type = 'view' AND f = 'top') AS top_view FROM l GROUP BY user_id""")
def nested_stats(spark, d):
    e = read(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("player"), F.lit("all").alias("team"), F.col("event_type").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    long = e.select("player", "team", "bucket", F.explode(F.array(F.struct(F.lit("n").alias("field"), F.col("n").cast("string").alias("value")), F.struct(F.lit("top").alias("field"), F.col("top").cast("string").alias("value")))).alias("x")).select("player", "team", "bucket", "x.*")
    return M.nested_stats(long).select("player", F.size("stats").alias("buckets"), F.try_element_at(F.try_element_at("stats", F.lit("view")), F.lit("top")).alias("top_view"))


@query("q3_a34_dossier", f"""WITH {SIDES} SELECT team, count(*) AS games, array_to_string(list(season || ':' || slate || ':' || opponent || ':' || margin ORDER BY season DESC, slate DESC, game_id DESC)[1:24], ' ') AS recent FROM sides GROUP BY team""")
def dossier(spark, d):
    two = sides_of(spark, d)
    item = F.struct("season", "slate", "game_id", F.concat_ws(":", "season", "slate", "opponent", "margin").alias("x"))
    return two.groupBy("team").agg(F.count(F.lit(1)).alias("games"), F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(item), asc=False), 1, 24), lambda s: s["x"]), " ").alias("recent"))


@query("q8_leader_lookup", f"WITH {PLAYS} SELECT player, count(*) AS n, sum(yards)::BIGINT AS yards FROM plays GROUP BY player HAVING count(*) >= 10 ORDER BY yards DESC, player LIMIT 25")
def leader_lookup(spark, d):
    return contest_plays(spark, d).groupBy("player").agg(F.count(F.lit(1)).alias("n"), F.sum("yards").alias("yards")).where("n >= 10").orderBy(F.desc("yards"), "player").limit(25)


@query("s8_catalog", f"WITH {SIDES} SELECT season, count(DISTINCT game_id) AS games, count(DISTINCT team) AS teams, min(slate) AS first_slate, max(slate) AS last_slate FROM sides GROUP BY season")
def catalog(spark, d):
    return sides_of(spark, d).groupBy("season").agg(F.countDistinct("game_id").alias("games"), F.countDistinct("team").alias("teams"), F.min("slate").alias("first_slate"), F.max("slate").alias("last_slate"))


@query("a18_label_metrics", f"""WITH p AS (SELECT l.doc_id, quality, toxic, n_chars, 1.0 / (1.0 + exp(-(n_chars - 500.0) / 900.0)) AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
 SELECT toxic, count(*) AS n, {r('sum((p - quality) * (p - quality)) / count(*)')} AS brier, {r('avg(((p >= 0.5) = (quality = 1))::INT)')} AS accuracy FROM p GROUP BY toxic""")
def label_scores(spark, d):
    l, docs = read(spark, d, "labels"), read(spark, d, "documents").select(F.col("doc_id").alias("i"), "n_chars")
    p = l.join(docs, F.col("doc_id") == F.col("i")).withColumn("p", 1.0 / (1.0 + F.exp(-(F.col("n_chars") - 500.0) / 900.0)))
    return p.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), X.portable_round(F.sum((F.col("p") - F.col("quality")) * (F.col("p") - F.col("quality"))) / F.count(F.lit(1))).alias("brier"),
                                  X.portable_round(F.avg(((F.col("p") >= 0.5) == (F.col("quality") == 1)).cast("int"))).alias("accuracy"))
