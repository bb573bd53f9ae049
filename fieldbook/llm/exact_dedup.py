"""Exact deduplication with two passes over a Bloom filter.

Pass one turns each text's hash into a few bit positions. Every task packs its positions by chunk of the filter, of each position two at most
however many rows of the task have it, so a text that a third of all rows share weighs no more than one that two share. Each chunk is
merged from what all tasks sent, and the bits that two rows or more set are kept. Pass
two tests every row against these bits: a row with one bit that nobody else set is the only one with its text and
goes straight through; only the others shuffle, and their full SHA-256 decides.

The filter has ``BITS_PER_ROW`` bits a row up to ``max_filter_bits``; in a filter that is full, fewer positions are set for each
row, down to one. Past about twice ``max_filter_bits`` rows most rows are taken for repeated and shuffle; the result stays exact.

Nulls count as empty texts. Of equal texts the row with the largest ``doc_id`` stays; a null ``doc_id`` is smaller
than any other, and of rows with equal ids one, any, stays. An empty table gives an empty result. Other columns are
carried along; the operator's own columns have the prefix ``dedup_``, and columns of that name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fieldbook.llm.common import materialize

HASHES = 4
BITS_PER_ROW = 16
MAX_FILTER_BITS = 1 << 30
CHUNK_BITS = 1 << 20
#: Hashes that a task holds before it sends them.
HELD = 1 << 20


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def positions(h: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """Bit positions (hashes, rows) of text hashes; ``bits`` is a power of two."""
    h = h.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        found = [(h + np.uint64(i) * step) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (bits.bit_length() - 1)) for i in range(hashes)]
    return np.stack(found).astype(np.int64)


def at_most_two(p: np.ndarray) -> np.ndarray:
    """Sorted positions without the third and further ones of a kind, which say nothing new."""
    return p[np.r_[True, True, p[2:] != p[:-2]][: len(p)]]


def repeated_bits(texts: DataFrame, text: str, bits: int, hashes: int) -> np.ndarray:
    """Bits that two rows or more set, as bytes. What reaches the driver is the filter, ``bits / 8`` bytes at most."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def flush() -> pd.DataFrame:
            p = at_most_two(np.sort(positions(np.concatenate(held), bits, hashes).reshape(-1)))
            held.clear()
            chunk, at = np.unique(p // CHUNK_BITS, return_index=True)
            return pd.DataFrame({"chunk": chunk, "bits": [x.astype("<u4").tobytes() for x in np.split((p % CHUNK_BITS), at[1:])]})

        for b in batches:
            held.append(b["h"].to_numpy(dtype=np.int64))
            if sum(map(len, held)) >= HELD:
                yield flush()
        if held:
            yield flush()

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(CHUNK_BITS, dtype=bool), np.zeros(CHUNK_BITS, dtype=bool)
        for raw in rows["bits"]:
            p = np.frombuffer(raw, dtype="<u4")
            twice[p[once[p]]] = True
            twice[p[1:][p[1:] == p[:-1]]] = True
            once[p] = True
        return pd.DataFrame({"chunk": [key[0]], "bits": [np.packbits(twice, bitorder="little").tobytes()]})

    form = "chunk long, bits binary"
    found = texts.select(_text_hash(text).alias("h")).mapInPandas(send, form).groupBy("chunk").applyInPandas(merge, form)
    table = np.zeros(max(bits, CHUNK_BITS) // 8, dtype=np.uint8)
    for r in found.toLocalIterator():
        table[r["chunk"] * CHUNK_BITS // 8 :][: CHUNK_BITS // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return table


def with_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """All rows with ``dedup_sha256``, ``dedup_keep_id``, ``dedup_size`` and ``dedup_kept``."""
    n = docs.count()
    bits = min(max_filter_bits, 1 << max(16, (n * BITS_PER_ROW - 1).bit_length()))
    hashes = max(1, min(HASHES, round(0.7 * bits / max(1, n))))
    table = docs.sparkSession.sparkContext.broadcast(repeated_bits(docs, text, bits, hashes))

    @pandas_udf("boolean")
    def perhaps_repeated(h: pd.Series) -> pd.Series:
        ok = np.ones(len(h), dtype=bool)
        for p in positions(h.to_numpy(dtype=np.int64), bits, hashes):
            ok &= (table.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(ok)

    rows = docs.drop(*[c for c in docs.columns if c.startswith("dedup_")])
    rows = rows.withColumn("dedup_may", perhaps_repeated(_text_hash(text)))
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    alone = rows.where(~F.col("dedup_may")).select(
        *[c for c in rows.columns if c != "dedup_may"], sha.alias("dedup_sha256"),
        F.col(doc_id).alias("dedup_keep_id"), F.lit(1).cast("long").alias("dedup_size"), F.lit(True).alias("dedup_kept"),
    )
    # The rows that shuffle are written with a number each, so that one of several rows with one id can be named for good.
    shuffled = rows.where("dedup_may").drop("dedup_may").withColumn("dedup_row", F.monotonically_increasing_id()).withColumn("dedup_sha256", sha)
    shuffled = materialize(shuffled, "perhaps")
    groups = shuffled.groupBy(F.col("dedup_sha256").alias("dedup_g")).agg(
        F.max(doc_id).alias("dedup_keep_id"), F.count(F.lit(1)).alias("dedup_size"),
        F.coalesce(F.max_by("dedup_row", doc_id), F.max("dedup_row")).alias("dedup_keep_row"),
    )
    met = shuffled.join(groups.hint("merge"), F.col("dedup_sha256") == F.col("dedup_g"))
    met = met.withColumn("dedup_kept", F.col("dedup_row") == F.col("dedup_keep_row")).drop("dedup_g", "dedup_row", "dedup_keep_row")
    return alone.unionByName(met)


def survivors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    return with_groups(docs, text, doc_id).where("dedup_kept").select(*docs.columns)
