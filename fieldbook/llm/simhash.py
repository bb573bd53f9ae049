"""SimHash fingerprints, and near duplicates among them by tables of distances to pivots.

Pivots are reference fingerprints. Each comes with a partner that agrees with it on one block of bits and is its
complement elsewhere, so the sum of the two distances in the table gives the distance within that block: its
coordinates. Fingerprints within ``radius`` bits differ in at most ``radius`` blocks, so for some choice of that many
blocks all coordinates of the others are equal; the pairs that meet so are candidates. A candidate is discarded if any of its
pivot distances differ by more than ``radius`` (no two distances can, by the triangle inequality, for a true pair),
and the survivors' bits are compared.

Where more than ``most`` distinct fingerprints share such coordinates, no pairs are formed. There each fingerprint
is entered in the tables of the references one bit away from it or equal to it; two fingerprints within two bits
always have such a reference in common, and no reference has more than 65 of them, so this is exact and linear.

Equal fingerprints are one class throughout. Null texts count as empty (fingerprint 0, linked like any other). A null
``doc_id`` gets its component's smallest id like any row; it is null only if the whole component's are. Repeated rows fall in one class. An
empty table gives an empty result. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fieldbook.llm.common import bounded_batches, ids_and_texts, materialize, with_null_ids
from fieldbook.llm.components import connected_components

SEED = 42
SLICE_BYTES = 1_000_000
RADIUS = 2
BLOCKS = 5
PIVOTS_PER_BLOCK = 8
MOST_PER_KEY = 24
#: The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * P2, 31) * P1


def xxh64_spans(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many spans of ``data``, all spans of one length at a time."""
    buf = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    eight = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    four = np.ndarray((len(buf) - 3,), dtype="<u4", buffer=buf, strides=(1,))
    out = np.empty(len(starts), dtype=np.uint64)
    order = np.argsort(lens, kind="stable")
    kinds, at = np.unique(lens[order], return_index=True)
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        for n, a, b in zip(kinds.tolist(), at.tolist(), [*at[1:].tolist(), len(order)]):
            pos, rest = starts[order[a:b]].copy(), n
            if n >= 32:
                acc = [np.full(b - a, x, dtype=np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
                while rest >= 32:
                    for k in range(4):
                        acc[k] = _round(acc[k], eight[pos + 8 * k])
                    pos, rest = pos + 32, rest - 32
                h = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
                for k in range(4):
                    h = (h ^ _round(np.zeros(1, dtype=np.uint64), acc[k])) * P1 + P4
            else:
                h = np.full(b - a, s + P5, dtype=np.uint64)
            h = h + np.uint64(n)
            while rest >= 8:
                h = _rot(h ^ _round(np.zeros(1, dtype=np.uint64), eight[pos]), 27) * P1 + P4
                pos, rest = pos + 8, rest - 8
            if rest >= 4:
                h = _rot(h ^ (four[pos].astype(np.uint64) * P1), 23) * P2 + P3
                pos, rest = pos + 4, rest - 4
            for _ in range(rest):
                h = _rot(h ^ (buf[pos].astype(np.uint64) * P5), 11) * P1
                pos = pos + 1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[order[a:b]] = h ^ (h >> np.uint64(32))
    return out


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts in order, and where each text's start, and the end."""
    raw = pa.array([t + "\n" for t in texts], pa.large_utf8())
    _, where, buf = raw.buffers()
    upto = np.frombuffer(where, dtype=np.int64)[: len(texts) + 1]
    data = _LOWER[np.frombuffer(buf, dtype=np.uint8)[: upto[-1]]]
    space = _SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first white space after a word, written as a space
    data[space] = 32
    new = np.concatenate([[0], np.cumsum(keep)])
    data = data[keep]
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    first = np.searchsorted(starts, new[upto[:-1]])  # word numbers at which texts start
    n_words = np.diff(np.append(first, len(starts)))
    n = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    own = np.repeat(first - at[:-1], n) + np.arange(at[-1])
    span = np.repeat(np.minimum(n_words, words), n)
    begin = starts[own]
    return xxh64_spans(data, begin, ends[own + span - 1] - begin), at


def fingerprints_of(texts: list[str], words: int = 3, lanes: int = 1) -> np.ndarray:
    """Fingerprints (texts, lanes): a bit is 1 if more than half of the shingle hashes, mixed anew for each lane, have it."""
    h, at = shingle_hashes(texts, words)
    out = np.zeros((len(texts), lanes), dtype=np.uint64)
    some = np.flatnonzero(np.diff(at))
    for k in range(lanes if len(some) else 0):
        if k:
            h = (h ^ (h >> np.uint64(31))) * P3 + P1
            h ^= h >> np.uint64(29)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[some], axis=0, dtype=np.int32)
        most = 2 * ones > np.diff(at)[some][:, None]
        out[some, k] = np.packbits(most, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text", lanes: int = 1) -> DataFrame:
    """``doc_id`` and ``fp`` of every row: a long, or for more lanes their bytes."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, at = [t or "" for t in b["text"]], 0
            found = []
            while at < len(texts):
                upto, held = at, 0
                while upto < len(texts) and (held == 0 or held + len(texts[upto]) < SLICE_BYTES):
                    held, upto = held + len(texts[upto]) + 1, upto + 1
                found.append(fingerprints_of(texts[at:upto], words, lanes))
                at = upto
            fp = np.concatenate(found) if found else np.zeros((0, lanes), dtype=np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp[:, 0].view(np.int64) if lanes == 1 else [x.astype("<u8").tobytes() for x in fp]})

    return with_null_ids(ids_and_texts(docs, doc_id, text).mapInPandas(run, f"doc_id long, fp {'long' if lanes == 1 else 'binary'}"))


class Pivots:
    """Reference fingerprints with their partners, for blocks of bits; fingerprints have ``lanes`` numbers of 64 bits."""

    def __init__(self, blocks: int, each: int, lanes: int = 1):
        rng = np.random.default_rng(SEED)
        bits = 64 * lanes
        edges = np.linspace(0, bits, blocks + 1).astype(int)
        whole = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges, edges[1:])]
        self.masks = np.array([[m >> (64 * k) & (1 << 64) - 1 for k in range(lanes)] for m in whole], dtype=np.uint64)
        self.sizes, self.bits = np.diff(edges), bits
        first = rng.integers(0, 1 << 63, size=(blocks, each, lanes), dtype=np.uint64) << np.uint64(1)
        first ^= rng.integers(0, 2, size=(blocks, each, lanes), dtype=np.uint64)
        self.both = np.stack([first, first ^ ~self.masks[:, None]], axis=2)

    def table(self, fp: np.ndarray) -> np.ndarray:
        """Distances (rows, blocks, pivots, 2) of fingerprints (rows, lanes) to all pivots and their partners."""
        out = np.zeros((len(fp), *self.both.shape[:3]), dtype=np.int16)
        for k in range(fp.shape[1]):
            out += np.bitwise_count(fp[:, None, None, None, k] ^ self.both[None, ..., k])
        return out

    def survivors(self, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
        """Whether pairs are within ``radius``: first by the largest difference of pivot distances, then by their bits."""
        ok = np.zeros(len(a), dtype=bool)
        step = max(1, 1_000_000 // self.both[..., 0].size)
        for s in range(0, len(a), step):
            far = np.abs(self.table(a[s : s + step]) - self.table(b[s : s + step])).reshape(len(a[s : s + step]), -1).max(axis=1)
            i = np.flatnonzero(far <= radius) + s
            ok[i] = np.bitwise_count(a[i] ^ b[i]).sum(axis=1, dtype=np.int64) <= radius
        return ok

    def coordinates(self, fp: np.ndarray) -> np.ndarray:
        """Distances within each block, as one number for each block."""
        step = max(1, 1_000_000 // self.both[..., 0].size)
        return np.concatenate([self._coordinates(self.table(fp[s : s + step])) for s in range(0, max(1, len(fp)), step)])

    def _coordinates(self, table: np.ndarray) -> np.ndarray:
        own = (table.sum(axis=-1) - (self.bits - self.sizes)[None, :, None]) // 2
        code = np.zeros(own.shape[:2], dtype=np.int64)
        for j in range(own.shape[2]):
            code = code * 33 + own[:, :, j]
        return code


@lru_cache(maxsize=4)
def pivots(blocks: int = BLOCKS, each: int = PIVOTS_PER_BLOCK, lanes: int = 1) -> Pivots:
    return Pivots(blocks, each, lanes)


def keys(nodes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``fp``, ``choice`` (the blocks left out) and ``key``, a row for each choice of ``radius`` blocks."""
    choices = list(combinations(range(blocks), radius))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pivots(blocks)
        rng = np.random.default_rng(SEED)
        odd = rng.integers(0, 1 << 62, size=(len(choices), blocks), dtype=np.int64) * 2 + 1
        for b in batches:
            fp = b["fp"].to_numpy(dtype=np.int64)
            code = p.coordinates(fp.view(np.uint64)[:, None])
            for c, left_out in enumerate(choices):
                h = np.full(len(fp), c, dtype=np.int64)
                for k in range(blocks):
                    if k not in left_out:
                        h = (h ^ (code[:, k] * odd[c, k])) * odd[c, k]
                        h ^= h >> 29
                yield pd.DataFrame({"fp": fp, "choice": c, "key": h})

    return nodes.select("fp").mapInPandas(run, "fp long, choice int, key long")


def close_pairs(pairs: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Of candidate pairs (``u``, ``v``), those within ``radius`` bits."""

    @pandas_udf("boolean")
    def close(u: pd.Series, v: pd.Series) -> pd.Series:
        a, b = (x.to_numpy(dtype=np.int64).view(np.uint64)[:, None] for x in (u, v))
        return pd.Series(pivots(blocks).survivors(a, b, radius))

    return pairs.where(close("u", "v"))


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, most: int = MOST_PER_KEY) -> DataFrame:
    """Edges (``u``, ``v``) whose components are those of all pairs of ``nodes`` within ``radius`` bits."""
    if radius > 2:
        raise ValueError("shared references are exact up to two bits")
    keyed = materialize(keys(nodes, radius, blocks), "keys")
    sizes = keyed.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(keyed.join(sizes.hint("merge"), F.col("key") == F.col("k")).drop("k"), "met")
    few = met.where(F.col("n") <= most).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("f"))
    pairs = few.select(F.explode(F.expr("""
        flatten(transform(f, (x, i) -> transform(slice(f, i + 2, size(f)), y -> struct(x as u, y as v))))""")).alias("p")).select("p.u", "p.v")
    near = close_pairs(pairs, radius, blocks)
    masks = [int(m) for m in pivots(blocks).masks[:, 0]]
    left_out = F.array(*[F.lit(_signed(masks[a] | masks[b] if radius == 2 else masks[a])) for a, *rest in combinations(range(blocks), radius) for b in (rest or [a])])
    many = met.where(F.col("n") > most).withColumn("mask", F.get(left_out, F.col("choice")))
    refs = F.expr("""concat(array(fp), transform(filter(sequence(0, 63), b -> (shiftright(mask, b) & 1L) = 1L), b -> fp ^ shiftleft(1L, b)))""")
    near_refs = many.select("fp", F.explode(refs).alias("z")).distinct()
    stars = near_refs.groupBy("z").agg(F.sort_array(F.collect_list("fp")).alias("f")).where("size(f) > 1")
    by_ref = stars.select(F.get("f", F.lit(0)).alias("u"), F.explode(F.expr("slice(f, 2, size(f))")).alias("v"))
    return near.unionByName(by_ref)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id that links reach."""
    prints = materialize(fingerprints(docs, words, doc_id, text), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(links(classes, radius))
    met = classes.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    met = materialize(met, "roots")
    least = met.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    named = met.join(least.hint("merge"), F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return prints.join(named.hint("merge"), F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")
