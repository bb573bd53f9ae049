"""Audit of how filters interact: what each would remove at each place of every order of them.

A document is a mask of the filters that it fails, so a part is at most 32 counts. In the lexicographic order of the 120
permutations, those that begin alike stand together: with ``k`` filters placed, (5 - k)! ranks from the rank of the first. A mask
is removed at step ``k`` in just those permutations whose first ``k - 1`` filters it passes and whose ``k``-th it fails. Its count is added
where such an interval begins and taken off behind its end; a running sum over the ranks then gives every order's
removals at once.

Null texts count as empty: they fail A, pass B, C and D. A null part is the empty string. A null ``doc_id`` compares with
nothing: it fails no E and makes no other fail, and has no labels. Of rows with one id and one text none fails E for the other. Labels of one id are joined by "any of
them". An empty table gives an empty result.
"""

from __future__ import annotations

import string
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import materialize, words_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    plain = F.coalesce(text, F.lit(""))
    words = words_of(text)
    n = F.size(words)
    capitals = F.length(plain) - F.length(F.translate(plain, string.ascii_uppercase, ""))
    bits = [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 2 * F.length(plain), plain.rlike(r"[#$%&*|]")]
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))


def failures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """``id``, ``part`` and ``mask`` of every row.

    Texts are read once and meet by their SHA-256. The smallest id of each text is found by partial
    sums; it meets the rows by text and id together, so copies of one text don't gather anywhere.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(digest).alias("digest"), text_failures(F.col(text)).alias("own"))
    rows = materialize(rows, "failures")
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("first")).withColumnRenamed("digest", "g")
    met = rows.join(first.hint("merge"), (F.col("digest") == F.col("g")) & (F.col("id") == F.col("first")), "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return met.select("id", "part", (F.col("own") + F.when(copy, 16).otherwise(0)).alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of each part and mask: rows, and those labelled good and toxic."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("k")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    met = failed.join(known.hint("merge"), F.col("id") == F.col("k"), "left")
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(c)
    return met.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), one("good"), one("toxic"))


def intervals() -> list[tuple[int, int, int, int]]:
    """(mask, step from 0, first rank, rank behind the last) of every removal."""
    out = []
    for step in range(len(FILTERS)):
        wide = factorial(len(FILTERS) - step - 1)
        for lo in range(0, len(ORDERS), wide):
            at = [1 << FILTERS.index(x) for x in ORDERS[lo][: step + 1]]
            out += [(mask, step, lo, lo + wide) for mask in range(1, 32) if mask & at[-1] and not any(mask & b for b in at[:-1])]
    return out


def removals(counts: np.ndarray) -> np.ndarray:
    """Removed of each row of mask counts, by step and rank of the order."""
    mask, step, lo, hi = np.array(intervals()).T
    ends = np.zeros((len(counts), len(FILTERS), len(ORDERS) + 1), dtype=np.int64)
    for at, sign in ((lo, 1), (hi, -1)):
        np.add.at(ends, (slice(None), step, at), sign * counts[:, mask])
    return ends.cumsum(axis=2)[:, :, :-1]


_ROWS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step from ``mask_counts``. A part is one row of at most 32 counts while it is worked on."""
    entry = F.struct("mask", *COUNTS)
    parts = counts.groupBy("part").agg(F.collect_list(entry).alias("masks"))
    letter = np.array([[FILTERS.index(x) for x in o] for o in ORDERS]).T  # step, rank

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 64):  # 600 rows leave for each part
                yield table(b["part"].iloc[at : at + 64].to_numpy(), b["masks"].iloc[at : at + 64])

    def table(names: np.ndarray, masks: pd.Series) -> pd.DataFrame:
        c = np.zeros((3, len(names), 32), dtype=np.int64)
        for k, found in enumerate(masks):
            for m in found:
                c[:, k, m["mask"]] += [m[x] for x in COUNTS]
        gone, good, toxic = (removals(x) for x in c)
        fails = np.stack([c[0][:, [m for m in range(32) if m >> i & 1]].sum(axis=1) for i in range(len(FILTERS))], axis=1)
        alone = c[0][:, [1 << i for i in range(len(FILTERS))]]
        shapley = np.stack([gone[:, letter == i].sum(axis=1) for i in range(len(FILTERS))], axis=1)
        shape = gone.shape
        column = {
            "part": np.broadcast_to(names[:, None, None], shape), "filter_order": np.broadcast_to(np.array(ORDERS, dtype=object), shape), "step": np.broadcast_to(np.arange(1, 6)[:, None], shape),
            "kept": c[0].sum(axis=1)[:, None, None] - gone.cumsum(axis=1), "removed": gone, "redundant": fails[:, letter] - gone, "unique_fails": alone[:, letter],
            "good_lost": good, "toxic_lost": toxic, "shapley": shapley[:, letter],
        }
        return pd.DataFrame({k: v.reshape(-1) for k, v in column.items()})

    return parts.mapInPandas(run, _ROWS)
