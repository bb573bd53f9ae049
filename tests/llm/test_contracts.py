"""Every query against a brute-force version, on the small tables and on odd texts."""

import base64

import brute
import pytest
from brute import ODD

from fieldbook.llm import queries as Q


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def ordered(x):
    return sorted(x, key=repr)


@pytest.fixture(params=["given", "odd", "empty"])
def docs(request, spark, sf, table):
    if request.param == "given":
        found = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
        return sf, [(r[0], r[1]) for r in found]
    texts = [] if request.param == "empty" else ODD
    return table(texts), list(enumerate(texts))


@pytest.fixture(scope="session")
def tok():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    def load(name):
        t = Tokenizer.from_file(P.path(name))
        t.encode_special_tokens = True
        return t

    return load


def test_op1(spark, docs):
    assert rows(Q.op1_substring_dedup(spark, docs[0]), "doc_id", "n_words", "n_removed", "kept_sha256") == ordered(brute.op1(docs[1]))


def test_op2(spark, docs, tok):
    got = rows(Q.op2_token_files(spark, docs[0]), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == ordered(brute.op2([(i, t or "") for i, t in docs[1]], tok("word_bpe_49k.json")))


def test_op3(spark, sf, tmp_path):
    got = rows(Q.op3_warc(spark, sf), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    assert got == ordered(brute.op3(pages))
    for name, own in (("odd", [(k, t) for k, t in enumerate(ODD + ODD[:3])]), ("none", [])):
        df = spark.createDataFrame([(i, None if i % 2 else f"http://a/{i} b", t, "x") for i, t in own], "page_id long, url string, html string, refers_to string")
        df.write.parquet(f"{tmp_path}/{name}/pages.parquet")
        got = rows(Q.op3_warc(spark, f"{tmp_path}/{name}"), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert got == ordered(brute.op3(own))


def test_op5(spark, docs):
    assert rows(Q.op5_simhash_near_dedup(spark, docs[0]), "doc_id", "fingerprint", "component_id") == ordered(brute.op5(docs[1]))


def test_op6(spark, docs, tok):
    got = Q.op6_best_fit_packing(spark, docs[0]).collect()
    assert ordered((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == ordered(brute.op6_pieces(docs[1], tok("byte_bpe_50k.json")))
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in places.values():
        at = 0
        for offset, n in sorted(inside):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(places) <= 1.05 * sum(r.length for r in got) / 2048 + 1


def test_op7(spark, docs):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert rows(Q.op7_byte_bpe(spark, docs[0]), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ordered(brute.op7(docs[1], enc))


def test_op8(spark, docs):
    assert rows(Q.op8_exact_dedup(spark, docs[0]), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == ordered(brute.op8(docs[1]))


def test_op9(spark, docs):
    got = Q.op9_quality_rules(spark, docs[0])
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == ordered(brute.op9(docs[1]))
    assert not got.where("kept and base_failed").count()


def test_op10(spark, docs):
    got = Q.op10_sharding(spark, docs[0])
    assert rows(got, "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard") == ordered(brute.op10(docs[1]))


def test_op4(spark, sf, tmp_path):
    import duckdb

    odd = [(k // 4, k % 4 if k % 7 else None, [None, "user", "user", "assistant", "sys<>\\tem"][k % 5], t, "x") for k, t in enumerate(ODD + ODD)]
    spark.createDataFrame(odd, "conv_id long, turn long, role string, text string, turns string").write.parquet(f"{tmp_path}/odd/conversations.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    for d in (sf, f"{tmp_path}/odd", f"{tmp_path}/none"):
        got = Q.op4_chat_formatting(spark, d)
        con = duckdb.connect()
        path = f"{d}/conversations.parquet" if d == sf else f"{d}/conversations.parquet/*.parquet"
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
        want = con.execute(Q.OP4_SQL)
        cols = [c[0] for c in want.description]
        assert rows(got, *cols) == ordered(want.fetchall())
