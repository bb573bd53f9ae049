"""Quality rules with verdicts on hosts, in Spark expressions only.

Each document is measured by itself. The failures of each host (a document's ``source``) are then added up, its
failure rate is drawn towards the rate of all hosts by a beta prior fitted to the hosts by moments, and a host
whose shrunk rate passes ``host_limit`` takes all its documents with it. Where hosts hardly differ no host passes it:
a limit near the common rate would take clean documents for nothing.

Null texts have no words, so they fail. A null source is a host of its own, ``''``. Lines are equal if their bytes
are. Repeated rows count as often as they stand. Empty tables give empty results and no prior. Own columns replace
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import SPACE, materialize, words_of

MIN_WORDS = 50
#: Percent of the words that repeated three-word windows may cover.
MAX_REPEAT = 50
HOST_LIMIT = 0.8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five measures as longs."""
    # The row is carried whole, so that no name of a column can clash.
    row = F.struct(*[c for c in docs.columns if c not in MEASURES])
    df = docs.select(row.alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    plain = F.col("_text")
    lines = F.filter(F.split(plain, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_words", words_of(plain)).withColumn("_lines", lines)
    df = df.withColumn("_n", F.size("_words"))
    # A hash for each three-word window; only texts in which one repeats go on to sort them.
    df = df.withColumn(
        "_w3",
        F.when(
            F.col("_n") >= 3,
            F.expr("transform(sequence(2, _n - 1), i -> xxhash64(get(_words, i - 2), get(_words, i - 1), get(_words, i)))"),
        ).otherwise(F.expr("cast(array() as array<bigint>)")),
    )
    df = df.withColumn(
        "_s",
        F.expr("""if(size(array_distinct(_w3)) < size(_w3), array_sort(transform(_w3, (x, i) -> struct(x as h, i as p))),
                     cast(array() as array<struct<h: bigint, p: int>>))"""),
    )
    df = df.withColumn(
        "_p",
        F.expr("array_sort(transform(filter(_s, (x, i) -> coalesce(x.h = get(_s, i - 1).h, false) or coalesce(x.h = get(_s, i + 1).h, false)), x -> x.p))"),
    )
    return df.select(
        "_doc.*",
        F.col("_n").cast("long").alias("n_words"),
        (F.length(plain) - F.regexp_count(plain, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(plain, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(_p, struct(0 as total, -3 as last), (a, p) -> struct(a.total + least(3, p - a.last), p)).total").cast("long").alias("n_repeat_words"),
    )


def with_base(measured: DataFrame) -> DataFrame:
    return measured.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def host_rates(judged: DataFrame, host: str) -> DataFrame:
    """A row for each host: documents, failures and the shrunk failure rate.

    The prior has the mean of the hosts' rates and, by moments, their variance; its weight is held between 1 and
    1000 documents. One row with two sums reaches the driver.
    """
    hosts = judged.groupBy(F.coalesce(F.col(host), F.lit("")).alias("host")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed")
    )
    rate = F.col("failed") / F.col("docs")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    m = m or 0.0
    weight = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v else 1000.0
    return hosts.withColumn("rate", (F.col("failed") + m * weight) / (F.col("docs") + weight))


#: A table of hosts is sent to all tasks up to so many rows and bytes of names; a larger one meets salted rows.
SENT_HOSTS, SENT_BYTES, SALTS = 50_000, 4 << 20, 16


def with_hosts(rows: DataFrame, hosts: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` (with ``_host``) joined to ``hosts`` (``_h`` and more), which is written out, whatever share of the rows one host has."""
    n, size = hosts.agg(F.count(F.lit(1)), F.sum(F.octet_length("_h"))).first()
    if n <= SENT_HOSTS and (size or 0) <= SENT_BYTES:
        return rows.join(F.broadcast(hosts), F.col("_host") == F.col("_h"), how)
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    copies = hosts.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies.hint("merge"), F.expr("_host = _h and _salt = _s"), how).drop("_salt", "_s")


def judge(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """Every row without its text: the measures, ``base_failed``, ``host_rate`` and ``kept``."""
    own = (text, *MEASURES, "base_failed", "host_rate", "kept")
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in own]).alias("_row"), F.coalesce(F.col(host), F.lit("")).alias("_host"), F.col(text).alias("_whole"))
    narrow = materialize(with_base(measure(rows, "_whole")).drop("_whole"), "quality")
    rates = materialize(host_rates(narrow, "_host").select(F.col("host").alias("_h"), F.col("rate").alias("host_rate")), "hosts")
    met = with_hosts(narrow, rates)
    return met.select("_row.*", *MEASURES, "base_failed", "host_rate", (~F.col("base_failed") & (F.col("host_rate") <= host_limit)).alias("kept"))


def passing(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows that pass, with the columns of ``docs``.

    Texts are measured once: all rows are written with their verdict, hosts are counted and rows filtered from there.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.coalesce(F.col(host), F.lit("")).alias("_host"), F.col(text).alias("_text"))
    judged = with_base(measure(rows, "_text")).select("_doc", "_host", "base_failed")
    judged = materialize(judged, "judged")
    rates = host_rates(judged.select("_host", "base_failed"), "_host")
    bad = materialize(rates.where(F.col("rate") > host_limit).select(F.col("host").alias("_h")), "hosts")
    own = judged.where(~F.col("base_failed"))
    return with_hosts(own, bad, "left_anti").select("_doc.*")
