"""Person dossiers from a roster and the documents that follow a player through the years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.scalars import college_key, name_key, person_key


def with_keys(df: DataFrame, name: str, team: str | None = None) -> DataFrame:
    out = df.withColumn("pk", person_key(F.col(name)))
    return out.withColumn("tk", college_key(F.col(team))) if team else out


def history(df: DataFrame, key: str, order: str, fields: list[str], out: str) -> DataFrame:
    """A sorted list of a person's entries."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias(out))


def dossiers(roster: DataFrame, usage: DataFrame, stats: DataFrame, recruits: DataFrame, moves: DataFrame) -> DataFrame:
    """Roster rows with usage and statistics of the person at the team, and recruiting entries and moves of the person.

    Each side holds one row for a key, so the roster keeps its rows.
    """
    r = with_keys(roster, "name", "team")
    u = with_keys(usage, "name", "team").groupBy("pk", "tk").agg(F.max("usage").alias("usage"))
    s = with_keys(stats, "player", "team").groupBy("pk", "tk").agg(F.max_by("stats", F.size("stats")).alias("stats"))
    rec = history(with_keys(recruits, "name"), "pk", "year", ["stars"], "recruits")
    mov = history(with_keys(moves, "name"), "pk", "season", ["origin", "destination"], "moves")
    return r.join(u.hint("merge"), ["pk", "tk"], "left").join(s.hint("merge"), ["pk", "tk"], "left").join(rec.hint("merge"), "pk", "left").join(mov.hint("merge"), "pk", "left").drop("pk", "tk")


def payroll_estimate(points: DataFrame, floors: dict[str, int]) -> DataFrame:
    """Median of a team's point estimates, not under its tier's floor, rounded to ten thousand, with a label."""
    names = F.create_map(*[F.lit(x) for kv in floors.items() for x in kv])
    agg = points.groupBy("team", "tier").agg(F.percentile("amount", F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n"))
    best = F.greatest(F.col("median"), F.coalesce(names[F.col("tier")], F.lit(0)))
    return agg.select("team", (F.round(best / 10_000) * 10_000).cast("long").alias("amount"), F.when(F.col("n") >= 3, "good").when(F.col("n") == 2, "fair").otherwise("thin").alias("quality"))


#: Short names of positions. Fixed values.
POSITIONS = {"QB": "Quarterback", "RB": "Running Back", "WR": "Wide Receiver", "TE": "Tight End", "DL": "Defensive Lineman", "LB": "Linebacker", "DB": "Defensive Back", "K": "Kicker"}


def draft_index(years: list[DataFrame]) -> DataFrame:
    """Yearly draft files as one table, whichever of two ways they write the college's field."""
    out = years[0]
    for y in years[1:]:
        out = out.unionByName(y, allowMissingColumns=True)
    names = [c for c in ("college", "collegeTeam", "college_team") if c in out.columns]
    return out.withColumn("_college", F.coalesce(*names)).drop(*names).withColumnRenamed("_college", "college")


def draft_list(index: DataFrame, year: int | None = None, round_: int | None = None, position: str | None = None, college: str | None = None, n: int | None = None) -> DataFrame:
    """Picks in order, filtered by what is given: a position by its short name or part of it, a college by its key. With a round 40 at most, else 32, never over 64."""
    out = index
    if year is not None:
        out = out.where(F.col("year") == year)
    if round_ is not None:
        out = out.where(F.col("round") == round_)
    if position:
        wanted = POSITIONS.get(position.upper(), position).lower()
        out = out.where(F.contains(F.lower("position"), F.lit(wanted)))
    if college:
        out = out.where(college_key(F.col("college")) == college_key(F.lit(college)))
    return out.orderBy("year", "overall").limit(min(64, n or (40 if round_ is not None else 32))).select("year", "round", "overall", "position", "college")


def drafted(asked: DataFrame, picks: DataFrame) -> DataFrame:
    """The first entry of each asked name in the wanted year or the next."""
    p = picks.select(name_key(F.col("name")).alias("pk"), "year", "overall")
    met = asked.withColumn("ak", name_key(F.col("asked"))).join(p.hint("merge"), F.expr("ak = pk and year between wanted and wanted + 1"))
    w = Window.partitionBy("asked").orderBy("year", "overall")
    return met.withColumn("i", F.row_number().over(w)).where("i = 1").select("asked", "year", "overall")
