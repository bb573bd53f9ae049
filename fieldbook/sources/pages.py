"""Lists and tables of web pages, and picks in free text, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_rows(pages: DataFrame) -> DataFrame:
    """Rows of tables, and of lists, which are tables of one row: ``page_id``, ``block``, ``row``, ``cells``."""
    blocks = F.expr(r"regexp_extract_all(html, '(?s)<(?:table|ul)\\b[^>]*>(.*?)</(?:table|ul)>', 1)")
    df = pages.where(F.col("html").isNotNull()).select("page_id", F.posexplode(blocks).alias("block", "body"))
    rows = F.expr(r"if(body rlike '<tr\\b', regexp_extract_all(body, '(?s)<tr\\b[^>]*>(.*?)</tr>', 1), array(body))")
    df = df.select("page_id", "block", F.posexplode(rows).alias("row", "one"))
    cells = F.expr(r"transform(regexp_extract_all(one, '(?s)<(?:td|th|li)\\b[^>]*>(.*?)</(?:td|th|li)>', 1), c -> trim(regexp_replace(c, '<[^>]*>', '')))")
    return df.select("page_id", "block", "row", cells.alias("cells")).where(F.size("cells") > 0)


def event_props(events: DataFrame) -> DataFrame:
    """The number in the JSON text of each event."""
    return events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def slate_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines ``week,away,home,line`` with quotes and ``#`` comments as rows, and the lines that don't fit."""
    parts = F.from_csv("value", F.lit("week string, away string, home string, line string"))
    df = lines.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select("value", parts.alias("x"))
    ok = F.col("x.week").try_cast("int").isNotNull() & F.col("x.home").isNotNull()
    good = df.where(ok).select(F.col("x.week").try_cast("int").alias("week"), F.trim("x.away").alias("away"), F.trim("x.home").alias("home"), F.col("x.line").try_cast("double").alias("line"))
    return good, df.where(~F.coalesce(ok, F.lit(False))).select("value")


def user_rows(lines: DataFrame) -> DataFrame:
    """A user's rows (``value``, more) as ``week``, ``away``, ``home``, ``line`` and ``form``: CSV with quotes, JSON under several field names, or prose.

    What is none of these has a null ``form`` and stays, so that it can be handed back.
    """
    v = F.col("value")
    csv = F.from_csv("value", F.lit("week string, away string, home string, line string"))
    js = F.from_json("value", "week int, wk int, away string, visitor string, home string, home_team string, line double, spread double")
    prose = r"(?i)^week (\d+): (.+?) at (.+?)(?: ([+-]?\d+(?:\.\d+)?))?\s*$"
    part = lambda i: F.regexp_extract(v, prose, i)
    form = F.when(F.startswith(F.trim(v), F.lit("{")), "json").when(v.rlike(prose), "prose").when(csv["week"].try_cast("int").isNotNull() & csv["home"].isNotNull(), "csv")
    pick = lambda a, b, c: F.when(form == "json", a).when(form == "prose", b).when(form == "csv", c)
    return lines.select(
        *[c for c in lines.columns if c != "value"], pick(F.coalesce(js["week"], js["wk"]), part(1).try_cast("int"), csv["week"].try_cast("int")).alias("week"),
        pick(F.coalesce(js["away"], js["visitor"]), F.trim(part(2)), F.trim(csv["away"])).alias("away"), pick(F.coalesce(js["home"], js["home_team"]), F.trim(part(3)), F.trim(csv["home"])).alias("home"),
        pick(F.coalesce(js["line"], js["spread"]), part(4).try_cast("double"), csv["line"].try_cast("double")).alias("line"), form.alias("form"),
    )


def routed(pages: DataFrame) -> DataFrame:
    """Cells of pages' links counted by route: ``spend`` if the header cell speaks of money, else ``roster``."""
    cells = F.expr(r"""regexp_extract_all(html, '(?s)<a href="[^"]*">([^<]*)</a>', 1)""")
    df = pages.where(F.col("html").isNotNull()).select("page_id", cells.alias("cells")).where(F.size("cells") > 0)
    route = F.when(F.get("cells", F.lit(0)).rlike(r"(?i)\b(spend|budget|payroll)\b"), "spend").otherwise("roster")
    return df.select("page_id", route.alias("route"), F.size("cells").cast("long").alias("cells"))
