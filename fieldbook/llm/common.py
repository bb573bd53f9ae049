"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

#: What has been written to the shared folder and not been removed.
_FOLDERS: list[str] = []
_TABLES: list[str] = []

#: Characters that part words: tab to carriage return, and space.
SPACE = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder, by name only, under the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a temporary folder is taken in local mode
    (tests); on a cluster that would be a folder of one machine, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fieldbook-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/fieldbook-{uuid.uuid4().hex}"
    _FOLDERS.append(path)
    return path


def save_table(writer: DataFrameWriter, spark: SparkSession, label: str) -> DataFrame:
    """A table in the shared folder, for what only tables keep: their buckets."""
    name = f"fieldbook_{uuid.uuid4().hex}"
    writer.option("path", f"{shared_dir(spark)}/{label}").saveAsTable(name)
    _TABLES.append(name)
    return spark.table(name)


def written() -> set[str]:
    """What this process has written to the shared folder and not removed."""
    return {*_FOLDERS, *_TABLES}


def clear(spark: SparkSession, names: Iterable[str], keep: Iterable[str] = ()) -> None:
    """Remove of what ``written`` names these folders and tables, but for the folders of the files in ``keep``.

    For jobs that have used up what they wrote; nothing calls it on its own but the stages of the pipeline.
    """
    names, kept = set(names), {part for f in keep for part in f.split("/")}
    for name in [t for t in _TABLES if t in names]:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _TABLES.remove(name)
    for path in [f for f in _FOLDERS if f in names and f.rsplit("/", 1)[1] not in kept]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        _FOLDERS.remove(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage and keeps the work done once."""
    path = f"{shared_dir(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Hold rows and bytes that Spark hands to Python at a time, so that whole texts of a batch fit a small executor.

    Both are settings of the session, and stay: Spark reads them when it plans, which is later. A lower
    number of rows that the session has already is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: Stands for a null id while rows are in Python, where a column of longs with nulls would become floating.
NO_ID = -(1 << 63)


def ids_and_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``NO_ID`` where it is null (and so first in order), and ``text``."""
    return docs.select(F.coalesce(F.col(doc_id), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"))


def with_null_ids(df: DataFrame) -> DataFrame:
    """Undo ``ids_and_texts``."""
    return df.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def cut_points(df: DataFrame, order: str, rows_per_block: int, most: int = 2000) -> list[int]:
    """Approximate quantiles of ``order`` that part the rows into blocks; ``most`` bounds their number.

    Only how evenly the blocks are filled depends on them, never a result.
    """
    n = df.count()
    blocks = min(most, max(1, -(-n // rows_per_block)))
    if blocks == 1:
        return []
    found = df.agg(F.percentile_approx(order, [i / blocks for i in range(1, blocks)], 10_000)).first()[0]
    return sorted({int(x) for x in found or []})


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, cuts: list[int]) -> DataFrame:
    """Add ``out``: 0, 1, 2... within ``keys`` by ``order``, with no task that sorts all rows of a key.

    Rows are ranked inside blocks of the first order column, which ``cuts`` part; the rows of the earlier
    blocks, a few counts for each key, give each block its first number.
    """
    row = F.struct(*[c for c in df.columns if c != out])  # whole, so that no name of a column can clash
    df = df.select(row.alias("_doc"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    own, by = [f"_k{i}" for i in range(len(keys))], [f"_o{i}" for i in range(len(order))]
    first = F.col("_o0")
    block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < first)) if cuts else F.lit(0)
    df = df.withColumn("_block", F.when(first.isNull(), F.lit(-1)).otherwise(block))
    counts = df.groupBy(*own, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*own).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_s{k}") for k in own], F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = df.withColumn("_row", F.row_number().over(Window.partitionBy(*own, "_block").orderBy(*by)) - 1)
    on = F.col("_block") == F.col("_b")
    for k in own:
        on = on & (F.col(k) == F.col(f"_s{k}"))
    joined = ranked.join(starts.hint("shuffle_hash"), on)
    return joined.select("_doc.*", (F.col("_start") + F.col("_row")).cast("long").alias(out))
