"""Runs of the pipeline that don't touch each other, clashing names, and messages that a hot text can't swell."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from fieldbook.llm import exact_dedup, quality, sharding


def test_results_of_two_runs_stay_readable(spark, table):
    texts = [f"{w} " + " ".join(f"{w}{k}" for k in range(80)) for w in ("alpha", "beta", "gamma")] * 2
    d = table(texts)
    first = P.run(spark, d)
    before = sorted(map(tuple, first.select("doc_id", "piece", "length").collect()))
    second = P.run(spark, d)
    assert sorted(map(tuple, second.select("doc_id", "piece", "length").collect())) == before
    assert sorted(map(tuple, first.select("doc_id", "piece", "length").collect())) == before and len(before) == 3


def test_a_stage_removes_only_what_made_its_own_input(spark, table, tmp_path):
    docs = spark.read.parquet(f"{table([f'{w} ' + ' '.join(f'{w}{k}' for k in range(80)) for w in 'abcab'])}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    one, other = P.quality_rules(spark, docs, ""), P.quality_rules(spark, docs, "")
    one.write.parquet(f"{tmp_path}/one")
    P.drop_exact_copies(spark, spark.read.parquet(f"{tmp_path}/one"), "").count()
    assert other.count() == 5


CLASH = ["_n", "_words", "_w3", "_s", "_p", "_host", "_doc", "_text", "_block", "_row", "_start", "_b", "_k0", "_o0", "_n_chars", "rest", "_whole", "n_removed"]


def clashing(spark):
    rows = [(i, f"text {i} " + " ".join(f"w{k}" for k in range(60)), "en", "s", 9 + i) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.col("doc_id") * 100 + k for k, c in enumerate(CLASH)})


def kept_as_they_were(df):
    return all(r[c] == r["doc_id"] * 100 + k for r in df.collect() for k, c in enumerate(CLASH) if c in df.columns)


def test_no_column_clashes(spark):
    df = clashing(spark)
    for out in (quality.judge(df), quality.passing(df), quality.measure(df), sharding.assign(df, "doc_id", 4, 5, 2), exact_dedup.survivors(df), P.cut_repeats(spark, df, "")):
        assert out.count() == 4 and set(CLASH) <= set(out.columns) and kept_as_they_were(out)


def test_a_hot_text_swells_no_message(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HELD", 4000)
    hot = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("text"), F.col("id").alias("doc_id")).repartition(4)
    form = hot.select(exact_dedup._text_hash("text").alias("h")).toPandas()["h"].to_numpy()
    p = np.sort(exact_dedup.positions(form, 1 << 20, 4).reshape(-1))
    q = exact_dedup.at_most_two(p)
    assert np.unique(q, return_counts=True)[1].max() == 2 and set(q) == set(p) and len(q) <= 2 * 4 * 4001
    out = exact_dedup.with_groups(hot)
    assert out.where("dedup_kept").count() == 4001 and out.where("dedup_size = 36000").count() == 36_000
