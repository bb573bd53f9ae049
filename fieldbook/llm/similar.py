"""Groups of documents whose sets of shingles are similar, by all their shingles: no pair at the threshold is missed.

1. Slices send their distinct shingles (see ``slices``); each group answers in how many documents they stand, as a byte
   on a logarithmic scale, with 0 for those that stand in one document only.
2. All shingles are put in one order, rare ones first. Two similar sets share one of the first ``n - s * n`` of each, and
   one of the first ``n - 2s / (1 + s) * n`` of the smaller. A set of which so many stand nowhere else is
   similar to no other, and goes no further; most do. The rest give their shared prefix shingles as keys.
3. Fingerprints of the rest within two bits, by tables of distances to pivots (see ``simhash``), are the first
   candidates; every candidate is compared by all its shingles. In a crowd of copies this joins most.
4. At each key all members are compared with one of them, drawn by a hash of the key, in ``STAR_ROUNDS`` rounds.
5. What is in one component by then needs no test. At each key, members outside its largest component are compared with all
   others of other components. A pair is only formed if their places in the order leave room for what
   they must share, and if the parities of 1,024 parts of their shingles differ in no more places than similar sets do in shingles;
   both are bounds, so no pair is lost. The comparison stands in the join's condition, so only survivors become rows.

Shingles are hashed to 64 bits; only equal hashes of different shingles could link a pair by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fieldbook.llm.common import bounded_batches, materialize
from fieldbook.llm.components import connected_components
from fieldbook.llm.simhash import SLICE_BYTES, links, shingle_hashes
from fieldbook.llm.slices import PLACE_BITS, SENT, U, answers_of, ask, column, entries, listed, messages, numbers, put_back, route_for, slices, unpacked

PARITIES = 1024
STAR_ROUNDS = 2
#: Bytes of a slice that give one distinct shingle, about.
BYTES_PER_SHINGLE = 7.5
#: Entries: a shingle's name, and how many documents of a slice have it.
NAME_BYTES, ENTRY_BYTES = 6, 6 + 1
OPEN = "row long, doc_id long, class binary, n int, fp long, keys array<long>, pos array<int>, odd array<long>, h binary"


def sets_of(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text without words has the one shingle 0."""
    texts, at, out = [t or "" for t in texts], 0, []
    while at < len(texts):
        upto, held = at, 0
        while upto < len(texts) and (held == 0 or held + len(texts[upto]) < SLICE_BYTES):
            held, upto = held + len(texts[upto]) + 1, upto + 1
        h, ends = shingle_hashes(texts[at:upto], words)
        out += [np.unique(h[i:j]) if i < j else np.zeros(1, dtype=np.uint64) for i, j in zip(ends, ends[1:])]
        at = upto
    return out


def parities(h: np.ndarray) -> np.ndarray:
    """For each of ``PARITIES`` parts of the hashes, whether the set has an odd number there, as longs."""
    odd = np.bincount((h >> U(40)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def majority(h: np.ndarray) -> int:
    """The fingerprint of a set: a bit is 1 if more than half of its shingles have it."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(h), bitorder="little").view("<i8")[0])


def rarity(rec: np.ndarray, batch: np.ndarray) -> np.ndarray:
    """How many documents have the names: 0 for one, else a step of a logarithmic scale."""
    _, own = np.unique(numbers(rec, 0, NAME_BYTES), return_inverse=True)
    total = np.bincount(own, weights=numbers(rec, NAME_BYTES, 1))
    return np.where(total > 1, np.minimum(255, 1 + 8 * np.log2(total)), 0).astype(np.uint8)[own]


def open_sets(table: DataFrame, words: int, similarity: float, doc_id: str, text: str) -> DataFrame:
    """Rows whose sets may be similar to another's, with their keys: shingles that decide it and stand elsewhere too."""
    route = route_for(table, BYTES_PER_SHINGLE)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, data in zip(b["batch"], b["data"]):
                sets = sets_of(column(unpacked(data), text).to_pylist(), words)
                names, n = np.unique(np.concatenate(sets) >> U(16), return_counts=True)
                yield messages(number, names, entries((names, NAME_BYTES), (np.minimum(n, 255), 1)), route)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, data, answers in zip(b["batch"], b["data"], b["rarity"]):
                t = unpacked(data)
                ids = column(t, doc_id).to_pylist()
                sets = sets_of(column(t, text).to_pylist(), words)
                flat = np.concatenate(sets)
                names, own = np.unique(flat >> U(16), return_inverse=True)
                often = put_back(names, route, listed(answers), bits=False)[own]
                n = np.array([len(x) for x in sets])
                at = np.concatenate([[0], np.cumsum(n)])
                longest = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
                alone = np.add.reduceat(often == 0, at[:-1], dtype=np.int64)
                rows = []
                for i in np.flatnonzero(alone < longest):
                    h, c = sets[i], often[at[i] : at[i + 1]]
                    first = np.lexsort((h, c))[: longest[i]]
                    pos = np.flatnonzero(c[first])
                    raw = h.astype("<u8").tobytes()
                    rows.append(((number << PLACE_BITS) + i, ids[i], blake2b(raw, digest_size=16).digest(), n[i], majority(h), h[first[pos]].view(np.int64), pos.astype(np.int32), parities(h), raw))
                yield pd.DataFrame(rows, columns=["row", "doc_id", "class", "n", "fp", "keys", "pos", "odd", "h"]).astype({"doc_id": "Int64", "n": np.int32})

    sent = table.mapInPandas(send, SENT)
    steps = materialize(ask(sent, ENTRY_BYTES, NAME_BYTES, rarity, route, bits=False), "rarity")
    met = table.join(answers_of(steps, "rarity").hint("merge"), "batch", "left")
    return materialize(met.mapInPandas(prefixes, OPEN), "open")


def _may_be_similar(a: str, b: str, similarity: float) -> str:
    """SQL: whether two sets that share the shingle of these rows can be similar, should it be the first they share."""
    ratio = similarity / (1 + similarity)
    short = lambda x: f"({x}.pos <= {x}.n - ceil({2 * ratio!r}D * {x}.n - 1e-6D))"
    differ = " + ".join(f"bit_count({a}.o{k} ^ {b}.o{k})" for k in range(PARITIES // 64))
    return f"""least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {ratio!r}D * ({a}.n + {b}.n) - 1e-6D and least({a}.n, {b}.n) >= {similarity!r}D * greatest({a}.n, {b}.n) - 1e-6D
        and if({a}.n = {b}.n, {short(a)} and {short(b)}, if({a}.n < {b}.n, {short(a)}, {short(b)}))
        and {differ} <= {(1 - similarity) / (1 + similarity)!r}D * ({a}.n + {b}.n) + 1e-6D"""


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (``u``, ``v``), those whose sets have a Jaccard similarity of ``similarity`` or more, by all their shingles."""
    bounded_batches(pairs.sparkSession)

    @pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x), dtype=bool)
        for i, (p, q) in enumerate(zip(x, y)):
            a, b = np.frombuffer(p, dtype="<u8"), np.frombuffer(q, dtype="<u8")
            both = len(a) + len(b) - len(np.union1d(a, b))
            out[i] = both >= similarity * (len(a) + len(b) - both) - 1e-9
        return pd.Series(out)

    pairs = materialize(pairs.distinct(), "pairs")
    x, y = sets.select(F.col("node").alias("u"), F.col("h").alias("x")), sets.select(F.col("node").alias("v"), F.col("h").alias("y"))
    return pairs.join(x.hint("merge"), "u").join(y.hint("merge"), "v").where(similar("x", "y")).select("u", "v")


def _stars(met: DataFrame, similarity: float, turn: int) -> DataFrame:
    """At each key, one of the members with all of other roots."""
    drawn = met.groupBy("key").agg(F.min_by("node", F.xxhash64("node", "key", F.lit(turn))).alias("node"))
    lead = met.join(drawn.hint("merge"), ["key", "node"]).alias("l")
    return met.alias("m").join(lead.hint("merge"), F.expr(f"m.key = l.key and m.root <> l.root and {_may_be_similar('m', 'l', similarity)}")).selectExpr("least(m.node, l.node) as u", "greatest(m.node, l.node) as v")


def _across(met: DataFrame, similarity: float) -> DataFrame:
    """At each key, members outside the largest root with all members of other roots."""
    roots = met.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    largest = roots.groupBy(F.col("key").alias("k")).agg(F.max_by("root", F.struct("m", "root")).alias("big"))
    rest = met.join(largest.hint("merge"), F.expr("key = k and root <> big")).drop("k").alias("a")
    both = rest.join(met.alias("b").hint("merge"), F.expr(f"a.key = b.key and a.root <> b.root and (b.root = a.big or a.node < b.node) and {_may_be_similar('a', 'b', similarity)}"))
    return both.selectExpr("least(a.node, b.node) as u", "greatest(a.node, b.node) as v")


def _joined(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """Components after new edges."""
    edges = found if roots is None else roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found)
    return materialize(connected_components(edges), "roots")


def _still_open(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows at keys where several components meet."""
    named = met.drop("root").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named, "named")
    several = named.groupBy(F.col("key").alias("k")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("k")
    return materialize(named.join(several.hint("merge"), F.col("key") == F.col("k")).drop("k"), "met")


def similar_roots(sets: DataFrame, similarity: float) -> DataFrame:
    """``node`` and ``root``: components of all pairs of ``sets`` with a Jaccard similarity of ``similarity`` or more."""
    prints = materialize(sets.select("node", "fp"), "prints")
    least = materialize(prints.groupBy("fp").agg(F.min("node").alias("first")), "classes")
    near = links(least.select("fp"))
    u, v = least.select(F.col("fp").alias("u"), F.col("first").alias("fu")), least.select(F.col("fp").alias("v"), F.col("first").alias("fv"))
    of_classes = near.join(u.hint("merge"), "u").join(v.hint("merge"), "v").select(F.least("fu", "fv").alias("u"), F.greatest("fu", "fv").alias("v"))
    inside = prints.join(least.hint("merge"), "fp").where("node > first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    roots = _joined(None, verified(of_classes.unionByName(inside), sets, similarity))
    odd = [F.col("odd")[k].alias(f"o{k}") for k in range(PARITIES // 64)]
    met = sets.select("node", "n", *odd, F.explode(F.arrays_zip("keys", "pos")).alias("k")).select("*", F.col("k.keys").alias("key"), F.col("k.pos").alias("pos")).drop("k")
    met = _still_open(met, roots)
    for turn in range(STAR_ROUNDS):
        roots = _joined(roots, verified(_stars(met, similarity, turn), sets, similarity))
        met = _still_open(met, roots)
    return _joined(roots, verified(_across(met, similarity), sets, similarity))


def survivors(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of similar ones, that with the smallest id, with the columns of ``docs``.

    Two documents are similar if the Jaccard similarity of their sets of shingles is ``similarity`` or more, and groups are the
    components of all such pairs. Texts of fewer words than a shingle are similar only to equal ones (but for case and white
    space), empty and null ones to empty and null ones. Of rows with the same smallest id one stays; null ids come
    last. Rows are told apart by their place, never by their id. An empty table gives an empty result.
    """
    table = slices(docs, text, doc_id)
    rows = open_sets(table, words, similarity, doc_id, text)
    classes = materialize(rows.groupBy("class").agg(F.min("row").alias("node")), "classes")
    sets = materialize(rows.join(classes.select("node").hint("merge"), F.col("row") == F.col("node")).drop("row", "doc_id", "class"), "sets")
    roots = similar_roots(sets, similarity)
    named = rows.select("row", "doc_id", "class").join(classes.hint("merge"), "class").join(roots.hint("merge"), "node", "left")
    named = materialize(named.select("row", "doc_id", F.coalesce("root", "node").alias("root")), "members")
    first = named.groupBy(F.col("root").alias("r")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("stays"))
    gone = named.join(first.hint("merge"), F.expr("root = r and row <> stays"))
    gone = gone.groupBy(F.expr(f"shiftright(row, {PLACE_BITS})").alias("batch")).agg(F.collect_list(F.expr(f"cast(row & {(1 << PLACE_BITS) - 1}L as int)")).alias("gone"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, out in zip(b["data"], b["gone"]):
                t = unpacked(data.as_py())
                stays = np.ones(t.num_rows, dtype=bool)
                stays[out.as_py() or []] = False
                yield from t.filter(pa.array(stays)).to_batches()

    return table.join(materialize(gone, "gone").hint("merge"), "batch", "left").select("data", "gone").mapInArrow(keep, docs.schema)
