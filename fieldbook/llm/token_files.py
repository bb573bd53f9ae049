"""Token ids as range asymmetric numeral system (rANS) blocks, written and read by Spark.

All documents in ascending ``doc_id`` order are one sequence of ids. A block holds whole documents, about
``BLOCK_IDS`` ids, and is one row of a Parquet table, so Spark's committer makes writing safe when tasks are run
again. The blocks share one static table of frequencies, counted over all ids. A block's ids are dealt to segments
of ``SEGMENT`` ids; each is coded by ``LANES`` interleaved coders and can be decoded alone from its checkpoint (the
lanes' states and where its words start). CRC-32 sums of the stored bytes and of the ids are checked on reading.

Null texts count as empty and hold the end id only. A null ``doc_id`` stands before all others; rows of equal ids
are ordered by their ids' bytes, so repeated rows are interchangeable. A text of any length is one document of one block. An empty table
gives no blocks and an empty result. Other columns are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.llm.common import bounded_batches, ids_and_texts, materialize, with_null_ids
from fieldbook.llm.tokens import ChunkEncoder

SCALE = 20
LANES = 8
SEGMENT = 2048
BLOCK_IDS = 1 << 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MASK32 = np.uint64(0xFFFFFFFF)

TOKENS = "doc_id long, wide boolean, ids binary"
BLOCKS = "part int, first long, doc_ids array<long>, lens array<long>, n long, words binary, word_at binary, states binary, stored_crc long, ids_crc long"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to ``2**SCALE``, at least 1 for each id that occurs."""
    total, room = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), dtype=np.int64)
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * (room / total)).astype(np.int64)), 0)
    over = int(freq.sum()) - room
    for i in np.argsort(-freq, kind="stable"):  # too many go first from the most frequent ids
        if over <= 0:
            break
        cut = min(over, int(freq[i]) - max(1, int(freq[i]) // 2))
        freq[i] -= cut
        over -= cut
    freq[int(np.argmax(freq))] -= min(over, 0)
    return freq


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.id_at = np.repeat(np.arange(len(freq), dtype=np.int32), freq)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of all segments one after another, where each segment's words start, and the lanes' states."""
        segments = -(-len(ids) // SEGMENT)
        padded = np.full(segments * SEGMENT, int(np.argmax(self.freq)), dtype=np.int32)
        padded[: len(ids)] = ids
        rows = padded.reshape(segments, SEGMENT // LANES, LANES).transpose(1, 0, 2)
        state = np.full((segments, LANES), LOW, dtype=np.uint64)
        words: list[np.ndarray] = []
        whose: list[np.ndarray] = []
        scale, limit = np.uint64(SCALE), np.uint64(63 - SCALE)
        for row in rows[::-1]:
            f = self.freq[row]
            full = state >= f << limit
            words.append((state[full] & MASK32).astype(np.uint32))
            whose.append(np.nonzero(full)[0].astype(np.int32))
            state = np.where(full, state >> WORD, state)
            q = state // f
            state = (q << scale) + (state - q * f) + self.start[row]
        segment = np.concatenate(whose[::-1])
        order = np.argsort(segment, kind="stable")
        at = np.searchsorted(segment[order], np.arange(segments))
        return np.concatenate(words[::-1])[order], at.astype(np.int64), state

    def decode(self, words: np.ndarray, word_at: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Ids of the segments whose checkpoints are given, all side by side."""
        at, state = word_at.copy(), state.copy()
        words = np.append(words, np.zeros(1, dtype=np.uint32)).astype(np.uint64)
        out = np.empty((SEGMENT // LANES, len(at), LANES), dtype=np.int32)
        scale, low = np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
        for row in out:
            slot = state & low
            ids = self.id_at[slot]
            row[:] = ids
            state = self.freq[ids] * (state >> scale) + slot - self.start[ids]
            empty = state < LOW
            upto = np.cumsum(empty, axis=1)
            take = words[np.where(empty, at[:, None] + upto - 1, len(words) - 1)]
            state = np.where(empty, (state << WORD) | take, state)
            at += upto[:, -1]
        return out.transpose(1, 0, 2).reshape(-1)


def tokenize(docs: DataFrame, encoder: Callable[[], ChunkEncoder], end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the ids of every row, the end id included: 16-bit numbers where they fit, else (``wide``) 32-bit ones."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for b in batches:
            keys = b["doc_id"]
            for start, ids, at in encode.encode(b["text"].tolist()):
                wide = bool(max(int(ids.max(initial=0)), end_id) >= 1 << 16)
                size = 4 if wide else 2
                raw = np.insert(ids, at[1:], end_id).astype(f"<u{size}").tobytes()
                cuts = (size * (at + np.arange(len(at)))).tolist()
                rows = [raw[x:y] for x, y in zip(cuts, cuts[1:])]
                yield pd.DataFrame({"doc_id": keys.iloc[start : start + len(rows)].to_numpy(), "wide": wide, "ids": rows})

    return ids_and_texts(docs, doc_id, text).mapInPandas(run, TOKENS)


def _numbers(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4" if wide else "<u2")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """Occurrences of each id over all documents; the vocabulary bounds what reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            for wide, rows in b.groupby("wide")["ids"]:
                n = np.bincount(_numbers(b"".join(rows), bool(wide)), minlength=len(total))
                n[: len(total)] += total
                total = n
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    found = tokens.select("wide", "ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, dtype=np.int64)
    counts[found["id"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return counts


def encode_blocks(tokens: DataFrame, freq: np.ndarray) -> DataFrame:
    """Blocks of the id sequence: parts in ascending order, and where each block starts in its part."""
    shared = tokens.sparkSession.sparkContext.broadcast(freq)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, part, first = Table(shared.value), TaskContext.get().partitionId(), 0
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal first, held, size
            ids = np.concatenate([x for _, x in held]).astype(np.int32)
            words, at, state = table.encode(ids)
            stored = words.astype("<u4").tobytes()
            row = pd.DataFrame({
                "part": [part], "first": [first], "doc_ids": [[k for k, _ in held]], "lens": [[len(x) for _, x in held]], "n": [len(ids)],
                "words": [stored], "word_at": [at.astype("<i8").tobytes()], "states": [state.astype("<u8").tobytes()],
                "stored_crc": [zlib.crc32(stored)], "ids_crc": [zlib.crc32(ids.astype("<u4"))],
            })
            first, held, size = first + len(ids), [], 0
            return row

        for b in batches:
            for key, wide, raw in zip(b["doc_id"], b["wide"], b["ids"]):
                ids = _numbers(raw, wide)
                held.append((key, ids))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tokens.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids").mapInPandas(run, BLOCKS)


def decode_row(row, table: Table) -> np.ndarray:
    """All ids of one block; its checksums must hold."""
    if zlib.crc32(row.words) != row.stored_crc:
        raise ValueError(f"block at {row.part}:{row.first}: stored bytes changed")
    states = np.frombuffer(row.states, dtype="<u8").reshape(-1, LANES)
    ids = table.decode(np.frombuffer(row.words, dtype="<u4"), np.frombuffer(row.word_at, dtype="<i8"), states)[: row.n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != row.ids_crc:
        raise ValueError(f"block at {row.part}:{row.first}: ids changed")
    return ids


def write(docs: DataFrame, encoder: Callable[[], ChunkEncoder], end_id: int, path: str) -> None:
    """Write ``path/table`` (frequencies) and ``path/blocks``.

    Texts become ids where they are read; only ids move, to the blocks' order.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, encoder, end_id), "tokens")
    freq = frequencies(count_ids(tokens))
    spark.createDataFrame(pd.DataFrame({"id": np.arange(len(freq)), "freq": freq}), "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    encode_blocks(tokens, freq).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark, path: str) -> DataFrame:
    """Digest rows of all documents of a file: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    table = spark.read.schema("id long, freq long").parquet(f"{path}/table").toPandas().sort_values("id")
    shared = spark.sparkContext.broadcast(table["freq"].to_numpy(dtype=np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = None
        for b in batches:
            for r in b.itertuples(index=False):
                decoder = decoder or Table(shared.value)
                ids = decode_row(r, decoder).astype("<u4")
                ends = np.cumsum(r.lens)
                sums = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, r.lens)]
                yield pd.DataFrame({"part": r.part, "doc_id": r.doc_ids, "rel": r.first + ends - r.lens, "n_tokens": r.lens, "ids_crc32": sums})

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    rows = blocks.mapInPandas(run, "part int, doc_id long, rel long, n_tokens long, ids_crc32 long")
    # One row for each part, as many as the writing job had partitions: small enough to send to all tasks.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return with_null_ids(rows.join(F.broadcast(starts), "part")).select("doc_id", (F.col("before") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32")
