"""From raw documents to packed sequences: quality rules, exact dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next
stage's documents. All but the last return the columns of ``documents``. Null texts count as empty, so the first stage
rejects them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.llm import exact_dedup, packing, quality, similar, substring_dedup, tokens
from fieldbook.llm.common import clear, materialize, read_table, written

CAPACITY = 2048
END_ID = 0


#: Under this key a column of a stage's result says what the stage wrote to the shared folder for itself.
SCRATCH = "fieldbook_scratch"


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage's result names what the stage wrote for itself, and Parquet keeps that with the columns. The stage that reads the
    written result back removes just this: not what another run or stage wrote, and nothing before the result is written.

    Folders that ``docs`` still reads from stay, and everything stays if ``docs`` isn't read from files (it may be a cached
    result that would have to be made again).
    """

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        used = docs.schema[0].metadata.get(SCRATCH, [])
        if used and (files := docs.inputFiles()):
            clear(spark, used, keep=files)
        before = written()
        out = work(spark, docs, sf_dir)
        return out.withMetadata(out.columns[0], {SCRATCH: sorted(written() - before)})

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, of hosts that pass them; null sources are one host. An empty table stays empty."""
    return quality.passing(docs)


@stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null being empty, the row with the largest ``doc_id``; a null id is smaller than any."""
    return exact_dedup.survivors(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (five-word shingles, a Jaccard similarity of 0.8 or more) the row with the smallest ``doc_id``.

    Null ids come last, and rows are told apart by place, so of rows with one id each stays or goes for its own text.
    """
    return similar.survivors(docs)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand earlier (by ``doc_id``, null first); what is left keeps its spacing.

    A document of which nothing is left goes; texts without a repeat, null ones too, stay as they are.
    """
    rows = docs.select("doc_id", F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"), "text")  # no name can clash
    cut = substring_dedup.without_repeats(rows, with_text=True)
    kept = cut.where("n_removed = 0 or n_removed < n_words")
    n_chars = F.when(F.col("n_removed") == 0, F.col("rest.n_chars")).otherwise(F.length("text").cast("long")).alias("n_chars")
    return kept.select(*[n_chars if c == "n_chars" else F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``CAPACITY`` tokens."""
    import public_tokenizers

    source = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, lambda: tokens.byte_level(source), END_ID, CAPACITY)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]

#: The near-dedup stage and the tokenizer can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's result goes when the next one's is written."""
    docs, last = read_table(spark, sf_dir, "documents"), set()
    for k, (name, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before = written()
            docs = materialize(docs, name)
            clear(spark, last)
            last = written() - before
    return docs
