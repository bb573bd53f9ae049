"""Spelling variants: words one edit apart, found by dense tiles of common prefix and suffix lengths.

Two words are one insertion, deletion or replacement apart exactly if their common prefix and common suffix together
reach the longer length minus one. The edit stands right after the common prefix, so the places it may have are parted
into a few segments, and for each segment words are dealt by the code points before and after it: two near words
meet in one bucket, that of the segment in which their common prefix ends. What meets is compared in tiles: blocks of words
as padded matrices of code points, left-aligned for prefixes and right-aligned for suffixes. A bucket of more than
``CROWDED`` words is dealt again by single places, where at most one code point is free, so work stays linear in the
vocabulary whatever its words have in common. Tasks send counts and the best partner of each word, never pairs.

Null texts have no words. A null ``doc_id`` counts as the empty string in the checksum. Repeated rows count as often as they
stand. Ties of frequency go to the smallest word in code-point order. Empty texts and tables give no words and an empty
result. Words may be of any length; a matrix holds at most ``CELLS`` code points, but for a single word.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import materialize

MIN_LENGTH, MIN_COUNT, SLIP, RATIO = 5, 3, 97, 2
#: Segments of the places of an edit, at most.
SEGMENTS = 4
CROWDED = 8192
#: Rows of a task's group, of a block, and code points of a matrix.
PACK, BLOCK, CELLS = 20_000, 256, 1 << 21


def runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word`` for every run of letters of the whole texts, with the letter that a checksum picks left out of one run in ``SLIP``."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    run = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(F.split(low, "[^a-zÀ-ÿ]+")).alias("run"))
    run = run.where(F.length("run") >= MIN_LENGTH)  # shorter ones stay short
    h = F.crc32(F.concat_ws(":", "d", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return run.select(F.when(h % SLIP == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    counted = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def _ends(hi: Column, a: Column, b: Column) -> Column:
    """What a word has before place ``a`` and after the places up to ``b``, counted in a longer word of ``hi`` code points."""
    after = hi - b
    return F.xxhash64(hi, a, F.substring(F.col("word"), F.lit(1), a), F.substring(F.col("word"), F.length("word") - after + 1, after))


def buckets(words: DataFrame) -> DataFrame:
    """A row for each word, length of the longer word (its own or one more) and segment."""
    df = words.withColumn("hi", F.explode(F.array(F.length("word"), F.length("word") + 1)))
    parts = F.least(F.lit(SEGMENTS), F.ceil(F.col("hi") / 2).cast("int"))
    df = df.withColumn("parts", parts).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    df = df.withColumns({"a": F.expr("int(s * hi div parts)"), "b": F.expr("int((s + 1) * hi div parts)")})
    return df.select("word", "n", "hi", "a", "b", _ends(F.col("hi"), F.col("a"), F.col("b")).alias("bucket"))


def uncrowded(rows: DataFrame) -> DataFrame:
    """Rows of crowded buckets are dealt again, for each single place of their segment."""
    crowds = materialize(rows.groupBy(F.col("bucket").alias("crowd")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CROWDED), "crowds")
    if crowds.isEmpty():
        return rows
    met = rows.join(crowds.hint("merge"), F.col("bucket") == F.col("crowd"), "left")
    few, many = met.where("crowd is null").select(*rows.columns), met.where("crowd is not null")
    many = many.select("word", "n", "hi", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("a")).withColumn("b", F.col("a") + 1)
    return few.unionByName(many.withColumn("bucket", _ends(F.col("hi"), F.col("a"), F.col("b"))))


def _matrices(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points left-aligned and, reversed, right-aligned, padded with zeros, and lengths."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    inside = np.arange(width) < lengths[:, None]
    left = np.zeros((len(words), width), dtype=np.uint32)
    left[inside] = codes
    right = np.zeros_like(left)
    ends = np.cumsum(lengths)
    within = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
    right[np.repeat(np.arange(len(words)), lengths), np.repeat(lengths, lengths) - 1 - within] = codes
    return left, right, lengths


def _common(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Leading columns in which rows agree, ``most`` at most."""
    differ = x != y
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
    return np.minimum(first, most)


def near_in_tile(mine: tuple, others: tuple, i: np.ndarray, j: np.ndarray, hi: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (row ``i`` of one block, row ``j`` of the other) are one edit apart, that edit being in their segment."""
    out = np.zeros(len(i), dtype=bool)
    step = max(1, CELLS // hi)
    for k in range(0, len(i), step):
        p, q = i[k : k + step], j[k : k + step]
        la, lb = mine[2][p], others[2][q]
        short = np.minimum(la, lb)
        before = _common(mine[0][p], others[0][q], short)
        after = _common(mine[1][p], others[1][q], short)
        lo, up = a[k : k + step], b[k : k + step]
        out[k : k + step] = (np.maximum(la, lb) == hi) & (before + after >= hi - 1) & (before >= lo) & (before < up)
    return out


def _pairs(g: pd.DataFrame):
    """Index pairs of near words of rows that are sorted by length, segment and bucket, tile by tile."""
    every_hi, every_bucket, every_a, every_b, every_word = (g[c].to_numpy() for c in ("hi", "bucket", "a", "b", "word"))
    edges = np.flatnonzero(np.r_[True, every_hi[1:] != every_hi[:-1], True])
    for start, end in zip(edges, edges[1:]):
        hi = int(every_hi[start])
        size = max(1, min(BLOCK, CELLS // hi))
        blocks = list(range(start, end, size))
        for n, x in enumerate(blocks):
            x1 = min(x + size, end)
            mine = None
            for y in blocks[n:]:
                y1 = min(y + size, end)
                if y > x and every_bucket[y] != every_bucket[x1 - 1]:
                    break
                same = (every_bucket[x:x1, None] == every_bucket[None, y:y1]) & (every_a[x:x1, None] == every_a[None, y:y1])
                i, j = np.nonzero(np.triu(same, 1) if x == y else same)
                if not len(i):
                    continue
                mine = mine or _matrices(every_word[x:x1], hi)
                others = mine if x == y else _matrices(every_word[y:y1], hi)
                near = near_in_tile(mine, others, i, j, hi, every_a[x + i], every_b[x + i])
                yield x + i[near], y + j[near]


def near_words(words: DataFrame) -> DataFrame:
    """For each word of a vocabulary (``word``, ``n``) that has near words: their number ``n_near`` and the most frequent one, ``best`` with ``best_n``."""
    rows = uncrowded(buckets(words))
    packs = max(1, -(-words.count() * 2 * SEGMENTS // PACK))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        g = g[g.duplicated("bucket", keep=False)].sort_values(["hi", "a", "bucket"], ignore_index=True)
        rank = g.sort_values("word").sort_values("n", ascending=False, kind="stable").index.to_numpy()
        place = np.empty(len(g), dtype=np.int64)
        place[rank] = np.arange(len(g))
        found, best = np.zeros(len(g), dtype=np.int64), np.full(len(g), len(g), dtype=np.int64)
        for i, j in _pairs(g):
            for mine, other in ((i, j), (j, i)):
                np.add.at(found, mine, 1)
                np.minimum.at(best, mine, place[other])
        has = np.flatnonzero(found)
        partner = rank[best[has]]
        return pd.DataFrame({"word": g["word"].to_numpy()[has], "found": found[has], "best": g["word"].to_numpy()[partner], "best_n": g["n"].to_numpy()[partner]})

    dealt = rows.withColumn("pack", F.pmod("bucket", F.lit(packs)))
    part = dealt.groupBy("pack").applyInPandas(compare, "word string, found long, best string, best_n long")
    top = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return part.groupBy("word").agg(F.sum("found").alias("n_near"), top.alias("t")).select("word", "n_near", F.col("t.best").alias("best"), (-F.col("t.m")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """Where each word of ``word``, ``form`` ends up: what it leads to is replaced by what that leads to, which doubles the steps each time.

    A form is at least ``RATIO`` times as frequent, so chains are a few dozen steps at most.
    """
    now = materialize(links.select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = now.select(F.col("word").alias("w"), F.col("root").alias("further"))
        step = now.join(ahead.hint("merge"), F.col("root") == F.col("w"), "left")
        step = materialize(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "links")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ratio: int = RATIO) -> DataFrame:
    """Every word of the vocabulary with its ``n``, ``n_near``, ``form``, ``form_n`` and ``root``."""
    words = materialize(vocabulary(runs(docs, text, doc_id)), "words")
    near = near_words(words).withColumnRenamed("word", "w")
    takes = F.col("best_n") >= ratio * F.col("n")
    met = words.join(near.hint("merge"), F.col("word") == F.col("w"), "left")
    met = materialize(met.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n"),
    ), "forms")
    ends = roots(met.where("form is not null")).withColumnRenamed("word", "w")
    out = met.join(ends.hint("merge"), F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
