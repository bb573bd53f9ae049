"""Token ids of whole texts, a batch of texts at a time, by a tokenizer that is asked once for each distinct chunk.

A chunk starts where ASCII white space follows anything but white space, and where a mark follows a letter. The
pre-tokenizers used here always cut there, so a text's ids are its chunks' ids in order, whatever stands around a chunk. Chunks are told apart by Arrow's
dictionary encoding; a cache of bounded size keeps the ids of the first ``most`` distinct ones.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text bytes that are worked on at a time, except that a text is never cut.
SLICE_BYTES = 2_500_000
CACHED_CHUNKS = 600_000

_ASCII_SPACE = np.zeros(256, dtype=bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in ",.;:!?|)"]] = True
#: The UTF-8 bytes of Unicode's white space beyond ASCII, the last three bytes as a number.
_WIDE_SPACE2 = np.array([0xC285, 0xC2A0])
_WIDE_SPACE3 = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])

_ENDS2 = {int(x).to_bytes(2, "big") for x in _WIDE_SPACE2}
_ENDS3 = {int(x).to_bytes(3, "big") for x in _WIDE_SPACE3}

#: Takes chunks and returns all their ids in a row and the number of each chunk's ids.
EncodeMany = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending starts of all chunks in ``data``; each text that isn't empty starts one."""
    space = _ASCII_SPACE[data]
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    before = data[at - 1].astype(np.int64)
    wide = np.flatnonzero(before >= 0x80)
    if len(wide):
        p = at[wide]
        two = (data[p - 2].astype(np.int64) << 8) | before[wide]
        three = (data[np.maximum(p - 3, 0)].astype(np.int64) << 16) | two
        at = np.delete(at, wide[np.isin(two, _WIDE_SPACE2) | np.isin(three, _WIDE_SPACE3)])
    first = np.zeros(len(data), dtype=bool)
    first[at] = True
    point = np.flatnonzero(_MARK[data[1:]]) + 1
    last = data[point - 1]
    accented = (last >= 0x80) & (data[np.maximum(point - 2, 0)] == 0xC3) & (last != 0x97) & (last != 0xB7) & (point > 1)
    first[point[_LETTER[last] | accented]] = True
    first[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(first)


class ChunkEncoder:
    def __init__(self, encode_many: EncodeMany, most: int = CACHED_CHUNKS, alike: np.ndarray | None = None):
        """``alike`` maps bytes that the tokenizer doesn't tell apart to one of them."""
        self.encode_many, self.most, self.alike = encode_many, most, alike
        self.slots: dict[bytes, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.lens = np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For slices of the texts: the index of the first, all ids, and where each text's ids start, and the end."""
        sizes = [len(t) if t else 0 for t in texts]
        first, held = 0, 0
        for i, n in enumerate(sizes):
            held += n
            if held >= SLICE_BYTES or i == len(texts) - 1:
                yield first, *self._slice([t or "" for t in texts[first : i + 1]])
                pa.default_memory_pool().release_unused()
                first, held = i + 1, 0

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        column = pa.array(texts, pa.large_utf8())
        _, where, raw = column.buffers()
        offsets = np.frombuffer(where, dtype=np.int64)[: len(texts) + 1]
        if offsets[-1] == 0:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        data = np.frombuffer(raw, dtype=np.uint8)[: offsets[-1]]
        if self.alike is not None:
            data = self.alike[data]
            raw = pa.py_buffer(data)
        starts = chunk_starts(data, offsets)
        ends = np.append(starts, offsets[-1]).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), raw]).dictionary_encode()
        codes = chunks.indices.to_numpy()
        distinct: list[bytes] = chunks.dictionary.to_pylist()
        slots = np.fromiter((self.slots.get(c, -1) for c in distinct), dtype=np.int64, count=len(distinct))
        missing = np.flatnonzero(slots < 0)
        flat, lens = self.flat, self.lens
        if len(missing):
            new = [distinct[i] for i in missing]
            ids, n = self.encode_many(new)
            slots[missing] = len(lens) + np.arange(len(new))
            flat, lens = np.concatenate([flat, ids.astype(np.int32)]), np.concatenate([lens, n])
            room = max(0, self.most - len(self.slots))
            if room:
                keep = new[:room]
                self.slots.update(zip(keep, range(len(self.lens), len(self.lens) + len(keep))))
                self.flat = flat if len(keep) == len(new) else flat[: len(self.flat) + int(n[: len(keep)].sum())]
                self.lens = lens[: len(self.lens) + len(keep)]
        first = np.cumsum(lens) - lens
        n = lens[slots][codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(first[slots][codes] - upto[:-1], n) + np.arange(upto[-1])
        return flat[take], upto[np.searchsorted(ends, offsets)]


def _whole(chunk: bytes) -> bool:
    """Whether the chunk may stand between others: it starts with ASCII white space and doesn't end with any."""
    return bool(_ASCII_SPACE[chunk[0]] and not _ASCII_SPACE[chunk[-1]]) and chunk[-2:] not in _ENDS2 and chunk[-3:] not in _ENDS3


def _cut(ids: list[int], ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Number of ids in each chunk, from the bytes of each id and where the chunks end."""
    got = np.cumsum(sizes[ids])
    upto = np.searchsorted(got, ends, side="left") + 1
    if not np.array_equal(got[upto - 1], ends):
        raise ValueError("ids cross chunks")
    return np.diff(upto, prepend=0)


def _load(path: str):
    """A tokenizer of the tokenizers library without threads of its own: Spark runs a task for each core already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


@lru_cache(maxsize=2)
def byte_level(path: str) -> ChunkEncoder:
    """A byte-level tokenizer of the tokenizers library, whose ids' bytes add up to the text's."""
    tok = _load(path)
    vocab = tok.get_vocab(with_added_tokens=False)
    sizes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
    for piece, i in vocab.items():
        sizes[i] = len(piece)  # a byte is written as one character

    def many(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.zeros(len(chunks), dtype=np.int64)
        whole = [i for i, c in enumerate(chunks) if _whole(c)]
        rest = sorted(set(range(len(chunks))).difference(whole))
        parts: list[np.ndarray] = []
        groups = [whole[i : i + 2000] for i in range(0, len(whole), 2000)] + [[i] for i in rest]
        texts = [b"".join(chunks[i] for i in g).decode() for g in groups]
        for k in range(0, len(texts), 64):
            for g, e in zip(groups[k : k + 64], tok.encode_batch_fast(texts[k : k + 64], add_special_tokens=False)):
                ids = e.ids
                got = _cut(ids, np.cumsum([len(chunks[i]) for i in g]), sizes) if len(g) > 1 else [len(ids)]
                flat = np.array(ids, dtype=np.int32)
                parts.append(flat)
                n[g] = got
        order = np.array([i for g in groups for i in g])
        flat, sizes_ = np.concatenate(parts), n[order]
        begin = np.zeros(len(chunks), dtype=np.int64)
        begin[order] = np.cumsum(sizes_) - sizes_
        upto = np.cumsum(n)
        return flat[np.repeat(begin - (upto - n), n) + np.arange(upto[-1])], n

    return ChunkEncoder(many)


@lru_cache(maxsize=2)
def word_level(path: str) -> ChunkEncoder:
    """A tokenizer of the tokenizers library that drops white space and lower-cases; a control character parts chunks."""
    tok = _load(path)
    (mark,) = tok.encode(" \x01 ", add_special_tokens=False).ids

    def many(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        plain = [i for i, c in enumerate(chunks) if b"\x01" not in c]
        rest = [i for i, c in enumerate(chunks) if b"\x01" in c]
        out, n = [], np.zeros(len(chunks), dtype=np.int64)
        groups = [plain[i : i + 2000] for i in range(0, len(plain), 2000)]
        texts = [" \x01 ".join(chunks[i].decode() for i in g) for g in groups]
        for k in range(0, len(texts), 64):
            for g, e in zip(groups[k : k + 64], tok.encode_batch_fast(texts[k : k + 64], add_special_tokens=False)):
                ids = np.array(e.ids, dtype=np.int32)
                marks = np.flatnonzero(ids == mark)
                if len(marks) != len(g) - 1:
                    raise ValueError("a chunk holds the mark")
                n[g] = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
                out.append(ids[ids != mark])
        flat = np.concatenate(out) if out else np.zeros(0, dtype=np.int32)
        if not rest:
            return flat, n
        alone = [np.array(tok.encode(chunks[i].decode(), add_special_tokens=False).ids, dtype=np.int32) for i in rest]
        parts = dict(zip(plain, np.split(flat, np.cumsum(n[plain])[:-1]))) if plain else {}
        parts |= dict(zip(rest, alone))
        n[rest] = [len(a) for a in alone]
        return np.concatenate([parts[i] for i in range(len(chunks))]), n

    alike = np.arange(256, dtype=np.uint8)
    alike[65:91] += 32
    alike[_ASCII_SPACE] = 32
    return ChunkEncoder(many, alike=alike)
