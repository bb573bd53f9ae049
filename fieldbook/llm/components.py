"""Connected components of an edge table by alternating large and small stars, each round written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, its component's smallest node, for every node of ``edges`` (``u``, ``v``).

    Rounds grow with the logarithm of the longest chain. Minima are taken before the shuffle, and the join that brings
    them back may split a node with many neighbours, so no component is gathered in one place.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        now = materialize(_small(_large(now)), "edges")
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _star(sides: DataFrame) -> DataFrame:
    least = sides.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
    return sides.join(least.hint("merge"), F.col("u") == F.col("w"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    met = _star(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
