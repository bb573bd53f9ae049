import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


@pytest.fixture
def table(spark, tmp_path):
    """A folder with ``documents`` made of texts and ids, with extra columns whose names clash with the operators' own."""

    def make(texts, ids=None, name="documents"):
        rows = [(i if ids is None else ids[i], t, None if i % 5 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", len(t or ""), i, "x", False) for i, t in enumerate(texts)]
        schema = "doc_id long, text string, lang string, source string, n_chars long, shard int, dedup_kept string, kept boolean"
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
