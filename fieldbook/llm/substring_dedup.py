"""Substring deduplication by recompression.

Rounds name things alike everywhere: a run of one token gets a name made from the token and the run's length; then,
round after round, each name falls on a side by a bit of its hash, and every left name followed by a right one
becomes a pair with a name made from both. Names are hashes, so all tasks agree on them without asking. With each
symbol goes the interval of words that decided how it was formed. Wherever these words stand again, the same symbol
stands again; a symbol with an interval inside a window that occurs nowhere else shows that the window is unique.

The job in Spark:

1. Documents become slices, rows of about ``SLICE_BYTES`` of text, sorted by ``doc_id``, in a bucketed table.
2. Each slice sends its distinct symbols of ``LEAST`` to ``MOST`` words, cut into groups by name; each group tells
   every slice which of its symbols occur anywhere else. (Within a slice, repeated names are sent once: a passage that
   a third of all documents share is one name for each slice.)
3. A window all of whose symbols are shared is a candidate. Its own 96-bit hash, sent in the same way, verifies it: the
   group finds the first place of each hash, in order of ``doc_id``.
4. Every candidate but the first place of its hash is a repeat; the words that repeats cover are removed.

Slices meet their answers by a join on the slice number for which the bucketed table doesn't shuffle, so
the texts are moved once, into that table. Names of symbols have 48 bits; two that collide only make a candidate more.

Nulls count as empty texts. Rows with equal or null ``doc_id`` are documents of their own, in a fixed order (null
first). A document of fewer words than a window is left alone. An empty table gives an empty result. Columns other
than the text are carried along; ``n_words``, ``n_removed`` and ``kept_sha256`` replace columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fieldbook.llm.common import materialize
from fieldbook.llm.simhash import xxh64_spans
from fieldbook.llm.slices import SENT, Route, U, answers_of, ask, column, entries, listed, messages, mix, numbers, put_back, route_for, slices, unpacked

WINDOW = 20
LEAST, MOST = 4, 7
ROUNDS = 10
#: Bytes of a slice that give one entry, about: a third of the words do.
BYTES_PER_ENTRY = 17
FAR = 1 << 29

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


# ---------------------------------------------------------------- one slice


def joined_text(texts: pa.Array) -> bytes:
    """Words parted by one space; each text ends with a line feed, perhaps after a space."""
    texts = texts.cast(pa.large_utf8()).fill_null("")
    _, where, raw = texts.buffers()
    upto = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(raw or b"", dtype=np.uint8)[upto[0] : upto[-1]]
    data = np.insert(body, upto[1:] - upto[0], 10)
    ends = upto[1:] - upto[0] + np.arange(len(texts))
    space = _SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[ends] = True
    data[space] = 32
    data[ends] = 10
    return data[keep].tobytes()


def without_words(texts: pa.Array, gone: np.ndarray) -> pa.Array:
    """The texts as they were, but for the flagged words (counted over all texts) and the white space after each of them."""
    null, texts = texts.is_null(), texts.cast(pa.large_utf8()).fill_null("")
    _, where, raw = texts.buffers()
    upto = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw or b"", dtype=np.uint8)[upto[0] : upto[-1]]
    upto = upto - upto[0]
    before = np.ones(len(data), dtype=bool)
    before[1:] = _SPACE[data[:-1]]
    before[upto[:-1][upto[:-1] < len(data)]] = True
    starts = np.flatnonzero(~_SPACE[data] & before)
    ends = np.append(starts[1:], len(data))
    ends = np.minimum(ends, upto[np.searchsorted(upto, starts, side="right")])  # a text's last word ends with the text
    d = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(d, starts[gone], 1)
    np.add.at(d, ends[gone], -1)
    keep = np.cumsum(d)[: len(data)] == 0
    kept = np.concatenate([[0], np.cumsum(keep)])[upto]
    out = pa.py_buffer(data[keep].tobytes())
    left = pa.Array.from_buffers(pa.large_utf8(), len(texts), [None, pa.py_buffer(kept.astype(np.int64)), out]).cast(pa.utf8())
    return pc.if_else(null, pa.scalar(None, pa.utf8()), left)


class Slice:
    """Words of a slice: ``starts`` and ``ends`` in ``data``, ``doc`` of each, and ``hashes``."""

    def __init__(self, text: bytes):
        self.data = np.frombuffer(text, dtype=np.uint8)
        space = _SPACE[self.data]
        before = np.concatenate([[True], space[:-1]])
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(space & ~before)
        self.lines = np.flatnonzero(self.data == 10)
        self.doc = np.searchsorted(self.lines, self.starts)
        self.n_words = np.bincount(self.doc, minlength=len(self.lines))
        self.hashes = xxh64_spans(self.data, self.starts, self.ends - self.starts)

    def windows(self) -> np.ndarray:
        """Whether a window starts at each word."""
        ok = np.zeros(len(self.starts), dtype=bool)
        if len(ok) >= WINDOW:
            ok[: len(ok) - WINDOW + 1] = self.doc[WINDOW - 1 :] == self.doc[: len(ok) - WINDOW + 1]
        return ok

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of the pairs of ``LEAST`` to ``MOST`` words that a window may decide, and their intervals of words."""
        n = len(self.hashes)
        breaks = np.flatnonzero(np.diff(self.doc, prepend=-1))
        at = np.arange(n) + np.searchsorted(breaks, np.arange(n), side="right")
        m = n + len(breaks) + 1
        name, wall = np.zeros(m, dtype=np.uint64), np.ones(m, dtype=bool)
        s, e = np.zeros(m, dtype=np.int32), np.zeros(m, dtype=np.int32)
        name[at], wall[at], s[at], e[at] = self.hashes, False, np.arange(n), np.arange(1, n + 1)
        # Runs. The words on either side decide where a run ends, and that a single word is none.
        same = np.zeros(m, dtype=bool)
        same[1:] = (name[1:] == name[:-1]) & ~wall[1:] & ~wall[:-1]
        head = np.flatnonzero(~same)
        run = np.diff(np.append(head, m)).astype(np.uint64)
        name = np.where(run > 1, mix(name[head] ^ (run * U(0x9E3779B97F4A7C15))), name[head])
        s, e, wall = s[head], e[np.append(head[1:], m) - 1], wall[head]
        by_wall = wall.copy()
        by_wall[1:] |= wall[:-1]
        by_wall[:-1] |= wall[1:]
        lo = np.where(by_wall, -FAR, s - 1).astype(np.int32)
        hi = np.where(by_wall, FAR, e + 1).astype(np.int32)
        found = []
        for r in range(ROUNDS):
            left = (mix(name + U(2 * r + 1)) & U(1)).astype(bool) & ~wall
            right = ~left & ~wall
            first = np.zeros(len(name), dtype=bool)
            first[:-1] = left[:-1] & right[1:]
            second = np.zeros(len(name), dtype=bool)
            second[1:] = first[:-1]
            lo2, hi2 = lo.copy(), hi.copy()
            # A pair is decided by its own two symbols; one left over also by the neighbour that it might have joined.
            for one, other in ((first, 1), (left & ~first, 1), (right & ~second, -1)):
                i = np.flatnonzero(one)
                lo2[i], hi2[i] = np.minimum(lo[i], lo[i + other]), np.maximum(hi[i], hi[i + other])
            i = np.flatnonzero(first)
            name = name.copy()
            name[i] = mix(mix(name[i]) + name[i + 1])
            e = e.copy()
            e[i] = e[i + 1]
            size = e[i] - s[i]
            use = i[(hi2[i] - lo2[i] <= WINDOW) & (size >= LEAST) & (size <= MOST)]
            found.append((name[use], lo2[use], hi2[use]))
            name, s, e, lo, hi, wall = (x[~second] for x in (name, s, e, lo2, hi2, wall))
            if not (hi - lo <= WINDOW).any():
                break
        return tuple(np.concatenate(x) for x in zip(*found))

    def window_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of the hashes of the windows that start at the words ``at``."""
        out = []
        for salt, base in ((U(0x243F6A8885A308D3), U(0xD1342543DE82EF95)), (U(0x13198A2E03707344), U(0xAF251AF3B0F025B5))):
            value = mix(self.hashes ^ salt)
            h = np.zeros(len(at), dtype=np.uint64)
            for k in range(WINDOW):
                h = h * base + value[at + k]
            out.append(mix(h))
        return out[0], (out[1] >> U(32)).astype(np.uint32)


def spread(covered_from: np.ndarray, n: int, width: int = WINDOW) -> np.ndarray:
    """Words that windows starting at the flagged words cover."""
    d = np.zeros(n + width + 1, dtype=np.int32)
    d[:n] += covered_from
    d[width : n + width] -= covered_from
    return np.cumsum(d)[:n] > 0


# ---------------------------------------------------------------- names of a slice, cut into groups and sent


#: Entries: a symbol's name; a window's hash in two parts and the id of its document.
SYMBOL_BYTES, WINDOW_BYTES = 6, 8 + 4 + 8


def symbol_names(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 48-bit names in order, how often each stands here, the name of each symbol, and the intervals."""
    name, lo, hi = s.symbols()
    distinct, own, n = np.unique(name >> U(16), return_inverse=True, return_counts=True)
    return distinct, n, own, np.stack([lo, hi])


def candidates(s: Slice, shared_bits: np.ndarray) -> np.ndarray:
    """Words at which candidate windows start: no symbol inside is alone in all documents."""
    _, n, own, (lo, hi) = symbol_names(s)
    alone = ~(shared_bits | (n > 1))[own]
    words = len(s.starts)
    d = np.bincount(np.maximum(hi[alone] - WINDOW, 0), minlength=words + 2) - np.bincount(lo[alone] + 1, minlength=words + 2)
    return np.flatnonzero(s.windows() & (np.cumsum(d)[:words] == 0))


def distinct_windows(s: Slice, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of distinct window hashes, the first candidate with each, and which one each candidate has."""
    a, b = s.window_hashes(at)
    order = np.lexsort((b, a))
    a2, b2 = a[order], b[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a2[1:] != a2[:-1]) | (b2[1:] != b2[:-1])
    own = np.empty(len(order), dtype=np.int64)
    own[order] = np.cumsum(new) - 1
    first = order[new]  # lexsort is stable: the earliest candidate comes first
    return np.stack([a[first], b[first].astype(np.uint64)]), first, own


def shared_names(rec: np.ndarray, batch: np.ndarray) -> np.ndarray:
    """Whether names also stand in another slice; a slice sends each of its names once."""
    _, own, n = np.unique(numbers(rec, 0, SYMBOL_BYTES), return_inverse=True, return_counts=True)
    return n[own] > 1


def first_places(rec: np.ndarray, batch: np.ndarray) -> np.ndarray:
    """Whether hashes stand nowhere before, in order of document and slice."""
    a, b, doc = numbers(rec, 0, 8), numbers(rec, 8, 4), numbers(rec, 12, 8).view("<i8")
    order = np.lexsort((batch, doc, b, a))
    a, b = a[order], b[order]
    first = np.ones(len(a), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(a), dtype=bool)
    out[order] = first
    return out


# ---------------------------------------------------------------- the job


def mark_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, Route]:
    """Slices with the answers ``shared`` and ``first``, and the way that they came."""
    table = slices(docs, text, doc_id)
    route = route_for(table, BYTES_PER_ENTRY)

    def send_symbols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, data in zip(b["batch"], b["data"]):
                names = symbol_names(Slice(joined_text(column(unpacked(data), text))))[0]
                yield messages(number, names, entries((names, SYMBOL_BYTES)), route)

    sent = table.mapInPandas(send_symbols, SENT)
    shared = materialize(ask(sent, SYMBOL_BYTES, SYMBOL_BYTES, shared_names, route), "shared")

    def send_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, data, answers in zip(b["batch"], b["data"], b["shared"]):
                t = unpacked(data)
                s = Slice(joined_text(column(t, text)))
                ids = column(t, doc_id).cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                at = candidates(s, put_back(symbol_names(s)[0], route, listed(answers)))
                (names, more), first, _ = distinct_windows(s, at)
                yield messages(number, names, entries((names, 8), (more, 4), (ids[s.doc[at[first]]], 8)), route)

    met = table.join(answers_of(shared, "shared").hint("merge"), "batch", "left")
    first = materialize(ask(met.mapInPandas(send_windows, SENT), WINDOW_BYTES, 8, first_places, route), "first")
    both = table.join(answers_of(shared, "shared").hint("merge"), "batch", "left").join(answers_of(first, "first").hint("merge"), "batch", "left")
    return both, route


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Every document with ``n_words``, ``n_removed`` and ``kept_sha256``, and on request the kept text."""
    own = ("n_words", "n_removed", "kept_sha256")
    rest = [f for f in docs.schema.fields if f.name not in (text, *own)]
    docs = docs.select(*[f.name for f in rest], text)
    marked, route = mark_repeats(docs, text, doc_id)
    fields = [*rest, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if with_text:
        fields.append(T.StructField(text, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # one slice at a time
                r = b.slice(k, 1).to_pylist()[0]
                t = unpacked(r["data"])
                s = Slice(joined_text(column(t, text)))
                at = candidates(s, put_back(symbol_names(s)[0], route, listed(r["shared"])))
                names, first, which = distinct_windows(s, at)
                here = put_back(names[0], route, listed(r["first"]))
                stays = np.zeros(len(at), dtype=bool)
                stays[first[here]] = True
                repeat = np.zeros(len(s.starts), dtype=bool)
                repeat[at[~stays]] = True
                gone = spread(repeat, len(s.starts))
                n_gone = np.bincount(s.doc[gone], minlength=len(s.lines))
                d = np.zeros(len(s.data) + 2, dtype=np.int32)
                np.add.at(d, s.starts[gone], 1)
                np.add.at(d, s.ends[gone] + 1, -1)
                keep = np.cumsum(d)[: len(s.data)] == 0
                lows = np.concatenate([[0], s.lines[:-1] + 1])
                kept = [s.data[x:y][keep[x:y]].tobytes().rstrip(b" ") for x, y in zip(lows, s.lines)]
                arrays = [column(t, f.name) for f in rest]
                arrays += [pa.array(s.n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                if with_text:
                    arrays.append(without_words(column(t, text), gone))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return marked.mapInArrow(run, T.StructType(fields))
