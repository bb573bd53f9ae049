"""Names found by an inverted index of pieces of their keys, where a scan would ask every name.

An index has a row for each piece of a name: ``piece``, the name's columns ``kind`` and ``name``, and ``copies``, how many entities share
both. The first character of a piece tells what it is: ``~`` three letters that stand anywhere in the key, which ends in two bars for this, so that shorter
runs are beginnings of pieces (and ``~`` alone, which all have), ``!`` its first three, ``^`` its first four, ``$`` its last word. Names are dealt to
tasks in equal numbers and each task sorts the pieces of its own, so only names shuffle, and pieces that are frequent gather nowhere. It is best stored: a
reader that is told pieces skips what lies beside them in each file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.scalars import name_key, name_score


def _runs(key: Column, size: int) -> Column:
    """Distinct runs of ``size`` letters of a key; none if it is shorter."""
    places = F.when(F.length(key) >= size, F.sequence(F.lit(1), F.length(key) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(key, i, F.lit(size))))


def _marked(mark: str, pieces: Column) -> Column:
    return F.transform(pieces, lambda x: F.concat(F.lit(mark), x))


def _last_word(key: Column) -> Column:
    return F.element_at(F.split(key, " "), -1)


#: Names a task; few enough for a file to hold each name once, as an entry of its dictionary.
NAMES = 40_000


def index_names(entities: DataFrame, names: int = NAMES) -> DataFrame:
    """The index of ``entities`` (``kind``, ``name``), of ``names`` names a task. Null names are in none of its rows; a null kind stays null."""
    key = F.col("key")
    barred, places = F.concat(key, F.lit("||")), F.when(F.length(key) > 0, F.sequence(F.lit(1), F.length(key))).otherwise(F.array().cast("array<int>"))
    pieces = F.array_union(
        F.transform(places, lambda i: F.concat(F.lit("~"), F.substring(barred, i, F.lit(3)))),
        F.array(F.lit("~"), F.concat(F.lit("!"), F.left(key, F.lit(3))), F.concat(F.lit("^"), F.left(key, F.lit(4))), F.concat(F.lit("$"), _last_word(key))),
    )
    known = entities.where("name is not null")
    one = known.groupBy("kind", "name").agg(F.count(F.lit(1)).cast("int").alias("copies")).repartition(known.count() // names + 1, "kind", "name")
    return one.withColumn("key", name_key(F.col("name"))).select(F.explode(pieces).alias("piece"), "kind", "name", "copies").sortWithinPartitions("piece")


#: Pieces up to which a scan of the index is told them, so that a sorted table's other row groups aren't read.
MOST_TOLD = 1000


def _told(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The index, of few wanted pieces only their rows; with each of its runs of three letters, the shorter ones that it begins with."""
    piece = F.col("piece")
    few = [r["piece"] for r in wanted.select("piece").distinct().take(MOST_TOLD + 1)]
    short = [p for p in few if p.startswith("~") and 1 < len(p) < 4]
    if len(few) <= MOST_TOLD:
        use = piece.isin(few)
        for p in short:
            use |= piece.startswith(p)
        index = index.where(use)
        if not short:
            return index
    runs = F.when(piece.startswith("~") & (F.length(piece) == 4), F.array(piece, F.left(piece, F.lit(3)), F.left(piece, F.lit(2)))).otherwise(F.array(piece))
    return index.withColumn("piece", F.explode(runs))


def _rarest(index: DataFrame, asked: DataFrame) -> DataFrame:
    """For each ``query`` that one of its runs which fewest names have: whatever contains the query has it, too."""
    key = F.col("qk")
    runs = F.when(F.length(key) == 0, F.array(F.lit(""))).when(F.length(key) < 3, F.array(key)).otherwise(_runs(key, 3))
    wanted = asked.select("query", "qk", F.explode(_marked("~", runs)).alias("piece"))
    found = _told(index, wanted).join(wanted.select("piece").distinct().hint("merge"), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(found.hint("merge"), "piece", "left").groupBy("query", "qk").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))


def _candidates(index: DataFrame, wanted: DataFrame) -> DataFrame:
    return _told(index, wanted).join(wanted.hint("merge"), "piece").select("query", "qk", "kind", "name", "copies").distinct()


def _asked(asked: DataFrame) -> DataFrame:
    return asked.where("query is not null").select("query").distinct().withColumn("qk", name_key(F.col("query")))


def find(index: DataFrame, asked: DataFrame, most: int = 20) -> DataFrame:
    """For each ``query`` the ``most`` best entities by ``score`` (0 equal key, 1 contains it, 2 equal last word), ``kind`` and ``name``, with their ``place``.

    The same rows as a scan gives. Equal entities count each; null queries find nothing, an empty key is contained in all.
    """
    q = _asked(asked)
    wanted = _rarest(index, q).unionByName(q.select("query", "qk", F.concat(F.lit("$"), _last_word(F.col("qk"))).alias("piece")))
    hit = _candidates(index, wanted).withColumn("score", name_score(F.col("name"), F.col("query"))).where("score is not null")
    w = Window.partitionBy("query").orderBy("score", "kind", "name")
    best = hit.withColumn("before", F.row_number().over(w)).where(F.col("before") <= most)  # a name is one row here, however often it stands
    each = best.select("query", "kind", "name", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(most)))).alias("copy"))
    return each.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("copy")


def resolve(index: DataFrame, asked: DataFrame, most: int = 8) -> DataFrame:
    """For each ``query`` the names it may mean: equal keys (``tier`` 0); else one contains the other (1); else the first four letters agree (2). The first ``most`` names."""
    q = _asked(asked)
    key = F.col("qk")
    inside = F.concat(_marked("!", F.concat(*[_runs(key, n) for n in (1, 2, 3)])), F.array(F.lit("!"), F.concat(F.lit("^"), F.left(key, F.lit(4)))))
    wanted = _rarest(index, q).unionByName(q.select("query", "qk", F.explode(F.array_distinct(inside)).alias("piece")))
    k = name_key(F.col("name"))
    tier = F.when(key == k, 0).when(F.contains(k, key) | F.contains(key, k), 1).when(F.left(k, F.lit(4)) == F.left(key, F.lit(4)), 2)
    hit = _candidates(index, wanted).withColumn("tier", tier).where("tier is not null").groupBy("query", "name").agg(F.min("tier").alias("tier"))
    w = Window.partitionBy("query").orderBy("tier", "name")
    first = hit.withColumn("best", F.min("tier").over(Window.partitionBy("query"))).where("tier = best")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query", "name", "tier", "place")
