"""Byte-level BPE by tree reduction.

Token lists form a monoid: the product of two is the encoding of their joined bytes. A long piece is halved until
its parts are short, the parts are encoded, and neighbours are joined up the tree. A join re-encodes a window around
the seam and grows it until the pairs at its two edges stay as they are when encoded by themselves; a token list is
an encoding exactly if all its adjacent pairs are, so then the tokens outside can't change. Decoding concatenates
the tokens' bytes up the same tree.

Null texts count as empty and give no ids; repeated rows are encoded alike; texts of any length are taken whole. An
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fieldbook.llm.common import bounded_batches, ids_and_texts, with_null_ids
from fieldbook.llm.tokens import ChunkEncoder

LEAF_BYTES, LEAF_IDS = 24, 4096
KEPT_PIECES = 400_000


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.pairs: dict[tuple[int, int], bool] = {}

    def leaf(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, the first of equals, until none is left."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        cost = [ranks.get(piece[i : i + 2], 1 << 30) for i in range(len(piece) - 1)]
        while cost:
            low = min(cost)
            if low == 1 << 30:
                break
            i = cost.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del cost[i]
            if i < len(cost):
                cost[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                cost[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[p] for p in parts]

    def stays(self, a: int, b: int) -> bool:
        """Whether two adjacent tokens are the encoding of their bytes."""
        got = self.pairs.get((a, b))
        if got is None:
            got = self.leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self.pairs) < KEPT_PIECES:
                self.pairs[a, b] = got
        return got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of ``left`` followed by those of ``right``."""
        if not left or not right:
            return left or right
        i, j = len(left) - 1, 1
        while True:
            window = self.leaf(b"".join(self.bytes_of[t] for t in (*left[i:], *right[:j])))
            grow_left = i > 0 and not self.stays(left[i - 1], window[0])
            grow_right = j < len(right) and not self.stays(window[-1], right[j])
            if not grow_left and not grow_right:
                return [*left[:i], *window, *right[j:]]
            i, j = i - grow_left, j + grow_right

    def encode(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.leaf(piece)
        half = len(piece) // 2
        return self.join(self.encode(piece[:half]), self.encode(piece[half:]))

    def encode_match(self, piece: bytes) -> list[int]:
        """A match of the splitting pattern that is a token of its own is never taken apart."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.encode(piece)

    def decode(self, ids: list[int]) -> bytes:
        """Halves are decoded and put together, down to leaves of ``LEAF_IDS`` ids."""
        if len(ids) <= LEAF_IDS:
            return b"".join([self.bytes_of[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def tree_encoder(path: str, pattern: str) -> tuple[TreeBPE, ChunkEncoder]:
    import regex

    with open(path, "rb") as f:
        bpe = TreeBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    find = regex.compile(pattern).findall
    known: dict[str, list[int]] = {}

    def many(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat: list[int] = []
        n = np.zeros(len(chunks), dtype=np.int64)
        for k, chunk in enumerate(chunks):
            before = len(flat)
            for piece in find(chunk.decode()):
                ids = known.get(piece)
                if ids is None:
                    ids = bpe.encode_match(piece.encode())
                    if len(known) < KEPT_PIECES:
                        known[piece] = ids
                flat += ids
            n[k] = len(flat) - before
        return np.array(flat, dtype=np.int32), n

    return bpe, ChunkEncoder(many, most=300_000)


def encoded(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, encoder = tree_encoder(path, pattern)
        for b in batches:
            keys, texts = b["doc_id"], b["text"].tolist()
            for first, ids, starts in encoder.encode(texts):
                yield pd.DataFrame({"doc_id": keys.iloc[first : first + len(starts) - 1], "ids": np.split(ids, starts[1:-1])})

    return with_null_ids(ids_and_texts(docs, doc_id, text).mapInPandas(run, "doc_id long, ids array<int>"))


def round_trip_digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every row: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, encoder = tree_encoder(path, pattern)
        for b in batches:
            for first, ids, starts in encoder.encode(b["text"].tolist()):
                rows = []
                for i in range(len(starts) - 1):
                    own = ids[starts[i] : starts[i + 1]]
                    rows.append((len(own), hashlib.sha256(own.astype("<u4")).hexdigest(), hashlib.sha256(bpe.decode(own.tolist())).hexdigest()))
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
                out.insert(0, "doc_id", b["doc_id"].iloc[first : first + len(rows)].to_numpy())
                yield out

    return with_null_ids(ids_and_texts(docs, doc_id, text).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
