"""Packing documents into sequences: dominance reduction, then best fit, on the histogram of lengths.

How many sequences are needed depends on the lengths alone, and there are no more distinct lengths than a sequence
is long. So the plan is made from the counts of each length, a table whose size doesn't grow with the input. Martello
and Toth's criterion comes first: a piece and a set of partners are fixed together for good if they dominate any other
set with that piece (nothing else fits; one partner fills the rest; no two others fit beside it, or no two sum to
more). Best fit in descending order deals with what is left. The plan says for each length which ranks
go where; Spark ranks the pieces within their length and looks each one up.

Documents longer than a sequence are cut into full pieces; only the first may be shorter. Null texts count as empty:
one end id. A null ``doc_id`` is packed like any other, ties and repeated rows take any of their places. An
empty table gives an empty result. Other columns are not used.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fieldbook.llm.common import bounded_batches, cut_points, ids_and_texts, materialize, rank_within, with_null_ids
from fieldbook.llm.tokens import ChunkEncoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, encoder: Callable[[], ChunkEncoder], end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document, with its ids on request."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for b in batches:
            keys = b["doc_id"].to_numpy()
            for first, ids, at in encode.encode(b["text"].tolist()):
                rows = []
                for i in range(len(at) - 1):
                    own = np.append(ids[at[i] : at[i + 1]], end_id).astype("<u4")
                    cuts = [0, *range(len(own) % capacity or capacity, len(own), capacity), len(own)]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((keys[first + i], k, s, e - s, zlib.crc32(own[s:e]), *([own[s:e].astype(np.int32)] if with_ids else [])))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return with_null_ids(ids_and_texts(docs, doc_id, text).mapInPandas(run, PIECES + ", ids array<int>" * with_ids))


#: Pieces of a length beyond which more of them change nothing in the dominance criterion.
ENOUGH = 4

#: A kind of sequence: how many there are, and the lengths in it in order.
Kind = tuple[int, list[int]]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[Kind]:
    """Take fixed sets out of ``counts`` and return them."""
    fixed: list[Kind] = []
    changed = True
    while changed:
        changed = False
        for a in sorted(counts, reverse=True):
            while counts.get(a):
                room = capacity - a
                left = counts | {a: counts[a] - 1}
                fit = sorted(x for x, n in left.items() if n and x <= room)
                if not fit:
                    fixed.append((counts.pop(a), [a]))
                    changed = True
                    break
                b = fit[-1]
                smallest = 2 * fit[0] if left[fit[0]] > 1 else fit[0] + (fit[1] if len(fit) > 1 else capacity)
                if b != room and smallest <= room and not _one_beats_two(b, fit, left, room):
                    break
                m = counts[a] // 2 if a == b else min(counts[a], counts[b])
                if smallest <= room and b != room:
                    m = max(1, m - ENOUGH)  # the criterion reads counts only up to three, so it holds until then
                fixed.append((m, [a, b]))
                changed = True
                for x in (a, b):
                    counts[x] -= m
                    if not counts[x]:
                        del counts[x]
    return fixed


def _one_beats_two(b: int, fit: list[int], left: dict[int, int], room: int) -> bool:
    """Whether only two others fit at a time and the best two are together no longer than ``b``."""
    three, need = 0, 3
    for x in fit:
        k = min(need, left[x])
        three, need = three + k * x, need - k
        if not need:
            break
    if not need and three <= room:
        return False
    best, j = 0, len(fit) - 1
    for i, x in enumerate(fit):
        while j >= 0 and fit[j] + x > room:
            j -= 1
        if j < i:
            break
        y = fit[j] if j > i or left[x] > 1 else (fit[j - 1] if j > 0 else 0)
        best = max(best, x + y)
    return best <= b


def best_fit(counts: dict[int, int], capacity: int) -> list[Kind]:
    """Best fit in descending order of what is left; like sequences are filled alike in one step."""
    done: list[Kind] = []
    rooms: list[int] = []
    open_: dict[int, list[Kind]] = {}

    def put(room: int, kind: Kind) -> None:
        if not room:
            done.append(kind)
            return
        if room not in open_:
            insort(rooms, room)
        open_.setdefault(room, []).append(kind)

    for a in sorted(counts, reverse=True):
        n = counts[a]
        while n:
            i = bisect_left(rooms, a)
            if i < len(rooms):
                room = rooms[i]
                bins, inside = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, bins, inside = capacity, n, []
            k = room // a
            full = min(bins, n // k)
            if full:
                put(room - k * a, (full, inside + [a] * k))
                n, bins = n - full * k, bins - full
            if n and bins and n < k:
                put(room - n * a, (1, inside + [a] * n))
                n, bins = 0, bins - 1
            if bins and inside:
                put(room, (bins, inside))
    return done + [kind for kinds in open_.values() for kind in kinds]


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Where the ranks of each length go: ranks from ``rank`` on, ``each`` to a sequence from ``base``, at ``offset``."""
    counts = {a: n for a, n in counts.items() if n}
    alike: dict[tuple[int, ...], int] = {}
    for m, inside in reduce_by_dominance(counts, capacity) + best_fit(counts, capacity):
        alike[tuple(inside)] = alike.get(tuple(inside), 0) + m
    kinds = [(m, inside) for inside, m in alike.items()]
    used: dict[int, int] = {}
    base, rows = 0, []
    for m, inside in kinds:
        at = 0
        for a in sorted(set(inside), reverse=True):
            k = inside.count(a)
            rows.append((a, used.get(a, 0), base, k, at))
            used[a] = used.get(a, 0) + m * k
            at += k * a
        base += m
    return pd.DataFrame(rows, columns=["length", "rank", "base", "each", "offset"]).sort_values(["length", "rank"])


def pack(items: DataFrame, capacity: int, rows_per_block: int = 50_000) -> DataFrame:
    """``items`` (``doc_id``, ``piece``, ``length``, more) with ``sequence_id`` and ``offset``."""
    counts = dict(items.groupBy("length").count().collect())  # at most ``capacity`` rows
    found = plan(counts, capacity)
    shared = items.sparkSession.sparkContext.broadcast({c: found[c].to_numpy(dtype=np.int64) for c in found})

    @pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p, n, r = shared.value, length.to_numpy(dtype=np.int64), rank.to_numpy(dtype=np.int64)
        i = np.searchsorted(p["length"] * (1 << 48) + p["rank"], n * (1 << 48) + r, side="right") - 1
        k = r - p["rank"][i]
        return pd.DataFrame({"sequence_id": p["base"][i] + k // p["each"][i], "offset": p["offset"][i] + k % p["each"][i] * n})

    cuts = cut_points(items, "doc_id", rows_per_block)
    ranked = rank_within(items, ["length"], ["doc_id", "piece"], "_rank", cuts).withColumn("_place", place("length", "_rank"))
    return ranked.select(*items.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, encoder: Callable[[], ChunkEncoder], end_id: int, capacity: int) -> DataFrame:
    """Pieces of all documents with their places."""
    return pack(materialize(pieces(docs, encoder, end_id, capacity), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``ids`` and the pieces' offsets. ``placed`` must have ``ids``."""
    one = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(one.alias("_p")).select("sequence_id", F.flatten("_p.ids").alias("ids"), F.col("_p.offset").alias("offsets"))
