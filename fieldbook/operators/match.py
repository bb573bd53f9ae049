"""Binding names to known ones, and records to contests, in tiers: the strictest tier that has a match wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.scalars import college_key, name_key, name_score, person_key


def resolve_names(raw: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """``raw`` names with ``name``: exact, by alias, by key, by the alias' key, else the alias itself. Aliases (``alias``, ``name``) and known names are joined, each once for a tier."""
    r = raw.select("raw").distinct().withColumn("key", name_key(F.col("raw")))
    k = known.select(F.col("name").alias("kn")).withColumn("kk", name_key(F.col("kn")))
    a = aliases.select(name_key(F.col("alias")).alias("ak"), F.col("name").alias("an")).withColumn("ank", name_key(F.col("an")))
    met = r.join(a, F.col("key") == F.col("ak"), "left")
    tiers = [
        met.join(k, F.col("raw") == F.col("kn")).select("raw", F.lit(0).alias("tier"), F.col("kn").alias("name")),
        met.join(k, F.col("an") == F.col("kn")).select("raw", F.lit(1).alias("tier"), F.col("kn").alias("name")),
        met.join(k, F.col("key") == F.col("kk")).select("raw", F.lit(2).alias("tier"), F.col("kn").alias("name")),
        met.join(k, F.col("ank") == F.col("kk")).select("raw", F.lit(3).alias("tier"), F.col("kn").alias("name")),
        met.where(F.col("an").isNotNull()).select("raw", F.lit(4).alias("tier"), F.col("an").alias("name")),
    ]
    out = tiers[0]
    for t in tiers[1:]:
        out = out.unionByName(t)
    w = Window.partitionBy("raw").orderBy("tier", "name")
    return out.withColumn("i", F.row_number().over(w)).where("i = 1").drop("i")


def longest_prefix(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Known name of the most leading words, so that what follows a name does no harm; else the only one that starts alike."""
    words = F.split(name_key(F.col("raw")), " ")
    heads = raw.select("raw", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))).alias("n", "head"))
    k = known.select("name", name_key(F.col("name")).alias("kk"))
    hit = heads.join(k.hint("merge"), F.col("head") == F.col("kk")).groupBy("raw").agg(F.max_by("name", F.struct("n", "name")).alias("name"), F.lit(0).alias("tier"))
    rest = raw.join(hit.select("raw").hint("merge"), "raw", "left_anti").select("raw", name_key(F.col("raw")).alias("rk"), F.get(F.split(name_key(F.col("raw")), " "), F.lit(0)).alias("first"))
    near = rest.join(k.withColumn("first", F.get(F.split("kk", " "), F.lit(0))).hint("merge"), "first").where(F.startswith(F.col("kk"), F.col("rk")) | F.startswith(F.col("rk"), F.col("kk")))
    only = near.groupBy("raw").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n"), F.lit(1).alias("tier")).where("n = 1").drop("n")
    return hit.unionByName(only.select(*hit.columns))


def tiered(people: DataFrame, records: DataFrame) -> DataFrame:
    """The newest record of each person (``pid``, ``name``, ``college``) among records (``rname``, ``rcollege``, ``year``).

    Records with the person's key at the college are preferred; then any with the key; then, if there is none, those of
    the same last name at the college.
    """
    last = lambda c: F.element_at(F.split(c, " "), -1)
    p = people.select("pid", person_key(F.col("name")).alias("pk"), college_key(F.col("college")).alias("pc")).withColumn("pl", last(F.col("pk")))
    q = records.select("rid", "year", person_key(F.col("rname")).alias("rk"), college_key(F.col("rcollege")).alias("rc")).withColumn("rl", last(F.col("rk")))
    same = p.join(q, F.col("pk") == F.col("rk")).select("pid", "rid", "year", F.when(F.col("pc") == F.col("rc"), 0).otherwise(1).alias("tier"))
    loose = p.join(q, (F.col("pl") == F.col("rl")) & (F.col("pc") == F.col("rc"))).select("pid", "rid", "year", F.lit(2).alias("tier"))
    w = Window.partitionBy("pid").orderBy("tier", F.desc("year"), "rid")
    return same.unionByName(loose).withColumn("i", F.row_number().over(w)).where("i = 1").drop("i")


def bind(books: DataFrame, games: DataFrame) -> DataFrame:
    """Books (``bid``, ``a``, ``b``, ``day``) to games of the same unordered pair, on the same day unless a day is unknown."""
    x = books.select("bid", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("day").alias("bd"))
    y = games.select("game_id", F.least("home", "away").alias("glo"), F.greatest("home", "away").alias("ghi"), F.col("day").alias("gd"))
    met = x.join(y.hint("merge"), (F.col("lo") == F.col("glo")) & (F.col("hi") == F.col("ghi")) & F.coalesce(F.col("bd") == F.col("gd"), F.lit(True)))
    w = Window.partitionBy("bid").orderBy(F.col("gd").asc_nulls_last(), "game_id")
    return met.withColumn("i", F.row_number().over(w)).where("i = 1").select("bid", "game_id")


def picks_to_games(picks: DataFrame, games: DataFrame) -> DataFrame:
    """Picks (``pick``, ``game_id``, ``week``, ``away``, ``home``) to games: by id; by week and sides; by sides if only one game has them."""
    g = games.select(F.col("game_id").alias("gid"), F.col("week").alias("gw"), F.col("home").alias("gh"), F.col("away").alias("ga"))
    by_id = picks.join(g, F.col("game_id") == F.col("gid")).select("pick", "gid", F.lit(0).alias("tier"))
    sides = picks.join(g, (F.col("home") == F.col("gh")) & (F.col("away") == F.col("ga")))
    by_week = sides.where(F.col("week") == F.col("gw")).select("pick", "gid", F.lit(1).alias("tier"))
    alone = sides.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("pick"))).where("n = 1").select("pick", "gid", F.lit(2).alias("tier"))
    w = Window.partitionBy("pick").orderBy("tier", "gid")
    return by_id.unionByName(by_week).unionByName(alone).withColumn("i", F.row_number().over(w)).where("i = 1").drop("i")


def search(entities: DataFrame, query: str, n: int = 20) -> DataFrame:
    """Entities (``kind``, ``name``) by how well the name fits."""
    return entities.withColumn("score", name_score(F.col("name"), F.lit(query))).where(F.col("score").isNotNull()).orderBy("score", "kind", "name").limit(n)


def nested_stats(long: DataFrame) -> DataFrame:
    """Rows (``player``, ``team``, ``bucket``, ``field``, ``value``) as map of maps; what isn't a number goes."""
    inner = long.withColumn("v", F.col("value").try_cast("double")).where(F.col("v").isNotNull()).groupBy("player", "team", "bucket").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "v")))).alias("m"))
    return inner.groupBy("player", "team").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "m"))).alias("stats"))


def canonical(rows: DataFrame, aliases: DataFrame, by_conference: list[tuple[str, str, str]]) -> DataFrame:
    """``name`` of each ``raw``: by the rules that also ask for the conference (raw, conf, name), else by the alias table, else as it is."""
    ruled = F.lit(None).cast("string")
    for raw, conf, name in by_conference:
        ruled = F.coalesce(ruled, F.when((F.col("raw") == raw) & (F.col("conf") == conf), name))
    a = aliases.groupBy(F.col("alias").alias("_a")).agg(F.min("name").alias("_n"))
    return rows.join(a.hint("merge"), F.col("raw") == F.col("_a"), "left").withColumn("name", F.coalesce(ruled, "_n", "raw")).drop("_a", "_n")


def modal_token(texts: DataFrame, pattern: str, out: str) -> DataFrame:
    """For each team the token that a pattern finds most often in its texts; of equally frequent ones the first."""
    found = texts.select("team", F.regexp_extract("text", pattern, 1).alias(out)).where(F.col(out) != "")
    n = found.groupBy("team", out).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("team").agg(F.min_by(out, F.struct(-F.col("n"), out)).alias(out))


def picks_cascade(picks: DataFrame, games: DataFrame) -> DataFrame:
    """Picks (``pick``, ``game_id``, ``week``, ``away``, ``home``, ``name``) to games (with ``open``), by the first of five ways that gives one game.

    0 by id; 1 by week and sides; 2 by sides, 3 by a side's name, 4 by a side's name among open games, these if only one game has it.
    """
    g = games.select(F.col("game_id").alias("gid"), F.col("week").alias("gw"), F.col("home").alias("gh"), F.col("away").alias("ga"), "open").hint("merge")
    tier = lambda df, k: df.select("pick", "gid", F.lit(k).alias("tier"))
    alone = lambda df: df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("pick"))).where("n = 1")
    by_id = picks.join(g, F.col("game_id") == F.col("gid"))
    sides = picks.join(g, (F.col("home") == F.col("gh")) & (F.col("away") == F.col("ga")))
    one = games.select(F.col("game_id").alias("gid"), "open", F.explode(F.array("home", "away")).alias("side")).withColumn("side", name_key(F.col("side"))).hint("merge")
    named = picks.withColumn("nk", name_key(F.col("name"))).join(one, F.col("nk") == F.col("side"))
    out = tier(by_id, 0).unionByName(tier(sides.where("week = gw"), 1)).unionByName(tier(alone(sides), 2)).unionByName(tier(alone(named), 3)).unionByName(tier(alone(named.where("open")), 4))
    w = Window.partitionBy("pick").orderBy("tier", "gid")
    return out.withColumn("i", F.row_number().over(w)).where("i = 1").drop("i")
