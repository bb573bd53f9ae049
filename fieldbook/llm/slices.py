"""Slices of a table of documents, and names that slices ask about.

A slice is a row that holds some MB of documents, all their columns, in Arrow's stream format. Slices stand in a
bucketed table, so what is found out about a slice meets it by a join for which the documents don't move again.

To learn something about all occurrences of a name (a hash), each slice sends its distinct names once, cut into groups by
name, as a few bytes each; a group answers every slice with a few bits or a byte for each name that it sent, in the order
sent. What moves is a small part of rows of (name, document), and a name that a third of all
documents share is one entry for each slice. Large inputs, where slices times groups would be too many rows, go by way of bunches of slices.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import bounded_batches, save_table

SLICE_BYTES = 2_500_000
#: Entries of a group, about; and the fewest groups.
GROUP_ENTRIES = 500_000
FEWEST_GROUPS = 64
#: Up to so many groups slices write to each of them, beyond to bunches (see ``route_for``).
DIRECT_GROUPS = 4096
SENT = "p int, batch long, rec binary"
ANSWER = "batch long, p int, bits binary"
#: A row's number is its slice's number and its place there.
PLACE_BITS = 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The bucketed table of slices: ``batch``, ``data``. Inside a slice rows are sorted by ``doc_id``, null first.

    Slices are numbered by task and place, so ``docs`` must give a task that runs again the same rows in the same order, as
    files do. Write what comes from a shuffle first.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << PLACE_BITS
        for b in batches:
            t = pa.Table.from_batches([b]).sort_by([(doc_id, "ascending")])
            t = pa.concat_tables([t.filter(pc.is_null(t[doc_id])), t.filter(pc.is_valid(t[doc_id]))])
            size = pc.fill_null(pc.binary_length(t[text]), 0).to_numpy()
            part = np.cumsum(size) // SLICE_BYTES
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), t.num_rows]
            for x, y in zip(edges, edges[1:]):
                if x < y:
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packed(t.slice(x, y - x))], pa.binary())], names=["batch", "data"])
                    number += 1

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = docs.mapInArrow(run, "batch long, data binary").repartition(buckets, "batch")  # so that a bucket is one file
    return save_table(cut.write.bucketBy(buckets, "batch").option("compression", "zstd"), spark, "slices")


def packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def column(t: pa.Table, name: str) -> pa.Array:
    c = t[name]
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


class Route(NamedTuple):
    """How entries travel: ``groups`` of names; a slice writes a row for each ``fine`` of them; ``bunches`` of slices."""

    groups: int
    fine: int
    bunches: int


def route_for(table: DataFrame, bytes_per_entry: float) -> Route:
    """The way for the entries of all slices, of which so many bytes of data give one, about.

    Slices times groups grows with the square of the input. So beyond ``DIRECT_GROUPS`` a slice writes to the square root of the
    groups, and what a bunch of slices wrote there is dealt on from one task: all rows hold a good part of a square
    root of a slice's entries, and their number grows with the input times its root.
    """
    n, size = table.agg(F.count(F.lit(1)), F.sum(F.octet_length("data"))).first()
    groups = max(FEWEST_GROUPS, int((size or 0) / bytes_per_entry / GROUP_ENTRIES))
    fine = 1 if groups <= DIRECT_GROUPS else math.isqrt(groups - 1) + 1
    return Route(groups, fine, max(1, n // fine))


def entries(*columns: tuple[np.ndarray, int]) -> np.ndarray:
    """Entries as rows of bytes: columns of whole numbers, each with how many of its low bytes are kept. Names come first."""
    return np.concatenate([np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width] for x, width in columns], axis=1)


def numbers(rec: np.ndarray, at: int, width: int) -> np.ndarray:
    """The column of entries that takes ``width`` bytes from byte ``at``."""
    out = np.zeros((len(rec), 8), dtype=np.uint8)
    out[:, :width] = rec[:, at : at + width]
    return out.view("<u8")[:, 0]


def in_groups(names: np.ndarray, route: Route) -> tuple[np.ndarray, np.ndarray]:
    """Order of the names by group, and the groups in that order; stable, so that answers can be put back."""
    p = (mix(names) % U(route.groups)).astype(np.int64)
    order = np.argsort(p, kind="stable")
    return order, p[order]


def runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """From and to of each run of equal numbers."""
    start = np.flatnonzero(np.diff(x, prepend=x[:1] - 1))
    return zip(start, np.append(start[1:], len(x)))


def messages(number: int, names: np.ndarray, rec: np.ndarray, route: Route) -> pd.DataFrame:
    """The rows that a slice writes: its entries, cut by groups; nothing is written to groups that get none."""
    order, p = in_groups(names, route)
    rec, row = rec[order], p // route.fine
    return pd.DataFrame([(row[x], number, rec[x:y].tobytes()) for x, y in runs(row)], columns=["p", "batch", "rec"])


def put_back(names: np.ndarray, route: Route, answers: list[tuple[int, bytes]], bits: bool = True) -> np.ndarray:
    """The answers, bits or bytes, in the order of ``names``."""
    order, p = in_groups(names, route)
    row, which = p // route.fine, np.array([k for k, _ in answers], dtype=np.int64)
    out = np.zeros(len(names), dtype=bool if bits else np.uint8)
    for x, y, (_, raw) in zip(np.searchsorted(row, which), np.searchsorted(row, which, side="right"), answers):
        out[order[x:y]] = _open_answer(raw, y - x, bits)
    return out


def _answer(found: np.ndarray, bits: bool) -> bytes:
    return (np.packbits(found) if bits else found.astype(np.uint8)).tobytes()


def _open_answer(raw: bytes, n: int, bits: bool) -> np.ndarray:
    x = np.frombuffer(raw, dtype=np.uint8)
    return np.unpackbits(x, count=n).astype(bool) if bits else x


def ask(sent: DataFrame, width: int, name: int, answer: Callable[[np.ndarray, np.ndarray], np.ndarray], route: Route, bits: bool = True) -> DataFrame:
    """Answers to what slices sent: ``batch``, ``p``, ``bits``, a bit or a byte for each entry of a row of ``messages``.

    ``answer`` gets all entries of a group (``width`` bytes each, the first ``name`` of which are the name) and the slice of each.
    """

    def opened(column: pd.Series) -> list[np.ndarray]:
        return [np.frombuffer(x, dtype=np.uint8).reshape(-1, width) for x in column]

    def direct(group: pd.DataFrame) -> pd.DataFrame:
        rec = opened(group["rec"])
        n = [len(x) for x in rec]
        found = np.split(answer(np.concatenate(rec), np.repeat(group["batch"].to_numpy(), n)), np.cumsum(n)[:-1])
        return pd.DataFrame({"batch": group["batch"], "p": group["p"], "bits": [_answer(x, bits) for x in found]})

    if route.fine == 1:
        return sent.groupBy("p").applyInPandas(direct, ANSWER)

    def deal(group: pd.DataFrame) -> pd.DataFrame:  # a row of groups and a bunch of slices: on to each group
        group = group.sort_values("batch")
        rec = opened(group["rec"])
        batch = np.repeat(group["batch"].to_numpy(), [len(x) for x in rec])
        rec = np.concatenate(rec)
        order, p = in_groups(numbers(rec, 0, name), route)
        rec, batch = rec[order], batch[order].astype("<i8")
        rows = [(group["p"].iloc[0], group["bunch"].iloc[0], p[x], rec[x:y].tobytes(), batch[x:y].tobytes()) for x, y in runs(p)]
        return pd.DataFrame(rows, columns=["row", "bunch", "p", "rec", "of"])

    def by_group(group: pd.DataFrame) -> pd.DataFrame:
        rec = opened(group["rec"])
        batch = np.concatenate([np.frombuffer(x, dtype="<i8") for x in group["of"]])
        found = np.split(answer(np.concatenate(rec), batch), np.cumsum([len(x) for x in rec])[:-1])
        return group[["row", "bunch", "p", "of"]].assign(bits=[_answer(x, bits) for x in found])

    def to_slices(group: pd.DataFrame) -> pd.DataFrame:  # ``deal`` turned round: by slice, and there by group
        group = group.sort_values("p")
        of = [np.frombuffer(x, dtype="<i8") for x in group["of"]]
        found = np.concatenate([_open_answer(raw, len(x), bits) for raw, x in zip(group["bits"], of)])
        batch = np.concatenate(of)
        order = np.argsort(batch, kind="stable")
        batch, found = batch[order], found[order]
        return pd.DataFrame([(batch[x], group["row"].iloc[0], _answer(found[x:y], bits)) for x, y in runs(batch)], columns=["batch", "p", "bits"])

    bunched = sent.withColumn("bunch", F.pmod(F.xxhash64("batch"), F.lit(route.bunches)))
    dealt = bunched.groupBy("p", "bunch").applyInPandas(deal, "row int, bunch long, p int, rec binary, of binary")
    found = dealt.groupBy("p").applyInPandas(by_group, "row int, bunch long, p int, of binary, bits binary")
    return found.groupBy("row", "bunch").applyInPandas(to_slices, ANSWER)


def answers_of(answers: DataFrame, name: str) -> DataFrame:
    """One row for each slice; a slice has at most one answer to each of its rows."""
    return answers.groupBy("batch").agg(F.collect_list(F.struct("p", "bits")).alias(name))


def listed(x) -> list[tuple[int, bytes]]:
    return [(r["p"], r["bits"]) for r in x] if x is not None else []
