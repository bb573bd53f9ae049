"""Nulls, repeated ids, long texts, ties, damage and sizes that the contracts' tests don't reach."""

import random
import time
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pipeline import DOCS, kept_of, near_survivors, prose, texts_of

import corpus_pipeline as P
from fieldbook.llm import bpe, chat, exact_dedup, packing, quality, sharding, similar, simhash, substring_dedup, token_files, tokens, warc
from fieldbook.llm.common import cut_points, rank_within, shared_dir

TWO = "doc_id long, text string"
BIG = (1 << 53) + 1


@pytest.fixture(scope="module")
def odd_ids(spark):
    """Null ids, one id twice, an id that no double holds, a text of two million letters."""
    long = " ".join(prose(1, 250_000))
    return spark.createDataFrame([(None, "one two three"), (None, None), (7, "x y"), (7, "x y"), (7, "a b c"), (BIG, long)], TWO)


def ids_of(df):
    return Counter(r.doc_id for r in df.collect())


WANT = {None: 2, 7: 3, BIG: 1}


def word(name="word_bpe_49k.json"):
    import public_tokenizers

    path = public_tokenizers.path(name)
    return lambda: tokens.word_level(path)


def byte(name="byte_bpe_50k.json"):
    import public_tokenizers

    path = public_tokenizers.path(name)
    return lambda: tokens.byte_level(path)


def test_token_files_keep_every_row(spark, odd_ids, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 5000)
    path = f"{shared_dir(spark)}/t"
    token_files.write(odd_ids, word(), 1, path)
    got = token_files.read(spark, path).orderBy("start").collect()
    assert Counter(r.doc_id for r in got) == WANT and got[0].doc_id is None and got[-1].doc_id == BIG
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]]))
    assert got[-1].n_tokens > 250_000  # one document is one block


@pytest.mark.parametrize("field", ["words", "ids_crc", "stored_crc"])
def test_token_files_tell_damage(spark, field):
    path = f"{shared_dir(spark)}/t"
    token_files.write(spark.createDataFrame([(1, "some words to keep"), (2, "and more of them")], TWO), word(), 1, path)
    row = spark.read.schema(token_files.BLOCKS).parquet(f"{path}/blocks").first()
    table = token_files.Table(spark.read.parquet(f"{path}/table").orderBy("id").toPandas()["freq"].to_numpy(dtype=np.int64))
    good = row.asDict()
    from types import SimpleNamespace

    token_files.decode_row(SimpleNamespace(**good), table)
    bad = dict(good, **{field: bytes([good["words"][0] ^ 1]) + bytes(good["words"][1:]) if field == "words" else good[field] ^ 1})
    with pytest.raises(ValueError, match="changed"):
        token_files.decode_row(SimpleNamespace(**bad), table)


def test_warc_null_ids_and_damage(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    pages = spark.createDataFrame([(None, "http://a", "same"), (3, None, "same"), (9, "http://b", "same"), (9, "http://c", "other"), (None, None, None)], "page_id long, url string, html string")
    warc.write(pages, path)
    got = warc.read(spark, path).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == {(None, "response", None): 2, (3, "revisit", 9): 1, (9, "response", None): 2}
    import glob
    import gzip

    name = max(glob.glob(f"{tmp_path}/w/files/*.gz"), key=lambda f: len(open(f, "rb").read()))
    raw = gzip.open(name).read()
    with open(name, "wb") as f:
        f.write(gzip.compress(raw.replace(b"\r\n\r\nsame\r\n", b"\r\n\r\nsAme\r\n").replace(b"\r\n\r\nother\r\n", b"\r\n\r\noTher\r\n")))
    with pytest.raises(Exception, match="digest|frame|record"):
        warc.read(spark, path).collect()


def test_chat_with_many_turns(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"text <{i}> \\") for i in range(500)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = chat.parse(out).first()
    assert [t.text for t in r.turns] == [x[3] for x in rows] and list(r.learned) == [x[3] for x in rows if x[2] == "assistant"]
    spans = [(s.start, s.len) for s in out.first().loss_spans]
    assert [out.first().formatted[s : s + n] for s, n in spans] == [x[3].replace("\\", "\\b").replace("<", "\\l") for x in rows if x[2] == "assistant"]


def test_simhash_odd_ids(spark, odd_ids):
    got = simhash.near_duplicates(odd_ids).collect()
    assert Counter(r.doc_id for r in got) == WANT
    assert {r.component_id for r in got if r.doc_id == 7} == {7}


def test_links_past_the_crowd(spark):
    """Hundreds of fingerprints that agree in most blocks: components are those of all pairs within two bits."""
    rng = random.Random(4)
    prints = set()
    for base in (rng.getrandbits(63) for _ in range(3)):
        prints |= {base} | {base ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(30)) for _ in range(120)}
    nodes = sorted(prints)
    found = simhash.connected_components(simhash.links(spark.createDataFrame([(x,) for x in nodes], "fp long"))).collect()
    root = {x: x for x in nodes}
    for _ in nodes:
        changed = False
        for i, a in enumerate(nodes):
            for b in nodes[i + 1 :]:
                if (a ^ b).bit_count() <= 2 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
        if not changed:
            break
    got = {r.node: r.root for r in found}
    assert {x: got.get(x, x) for x in nodes} == root


def test_packing_plan_is_bounded():
    """At ten million pieces of each length the plan is a few thousand rows, made in a moment, and holds every piece."""
    rng = np.random.default_rng(1)
    counts = {i + 1: int(x) for i, x in enumerate(rng.integers(1, 2 * 10**7, 2048))}
    began = time.time()
    found = packing.plan(dict(counts), 2048)
    assert len(found) < 20_000 and time.time() - began < 10
    sequences = found["base"].max() + 1
    held = {}
    for length, g in found.groupby("length"):
        nxt = [*g["rank"].tolist()[1:], counts[length]]
        held[length] = sum((n - r) for r, n in zip(g["rank"], nxt))
    assert held == counts and sequences >= sum(a * n for a, n in counts.items()) / 2048


@pytest.mark.parametrize("seed", range(4))
def test_packing_fills_like_small_steps(seed):
    """Whole counts at a time need no more sequences than one step at a time."""
    rng = random.Random(seed)
    counts = {rng.randrange(1, 101): rng.randrange(1, 30) for _ in range(25)}

    def sequences():
        left = dict(counts)
        kinds = packing.reduce_by_dominance(left, 100)
        kinds += packing.best_fit(left, 100)
        assert all(sum(inside) <= 100 for _, inside in kinds)
        held = Counter()
        for m, inside in kinds:
            for x in inside:
                held[x] += m
        assert held == counts
        return sum(m for m, _ in kinds)

    whole, before = sequences(), packing.ENOUGH
    packing.ENOUGH = 10**9
    try:
        assert whole <= sequences()
    finally:
        packing.ENOUGH = before


def test_packing_and_bpe_odd_ids(spark, odd_ids):
    import public_tokenizers as T

    placed = packing.pack_documents(odd_ids, byte(), 0, 2048).collect()
    assert {r.doc_id for r in placed} == set(WANT) and sum(r.piece == 0 for r in placed) == 6
    got = bpe.round_trip_digests(odd_ids, T.path("byte_bpe_multi_50k.tiktoken"), T.PATTERN).collect()
    assert Counter(r.doc_id for r in got) == WANT and sum(r.n_tokens == 0 for r in got) == 1


def test_exact_dedup_in_a_full_filter(spark):
    """A filter far too small, equal ids, null ids: the result is the same, and of equal rows one stays."""
    rows = [(i % 50 if i % 7 else None, None if i % 11 == 0 else f"text {i % 40}", i) for i in range(300)]
    df = spark.createDataFrame(rows, TWO + ", more int").repartition(5)
    for bits in (64, 1 << 20):
        got = exact_dedup.with_groups(df, max_filter_bits=bits).collect()
        assert len(got) == 300 and sorted(r.more for r in got) == list(range(300))
        groups = {}
        for r in got:
            groups.setdefault(r.text or "", []).append(r)
        for inside in groups.values():
            kept = [r for r in inside if r.dedup_kept]
            best = max((r.doc_id for r in inside if r.doc_id is not None), default=None)
            assert len(kept) == 1 and kept[0].doc_id == best and {r.dedup_size for r in inside} == {len(inside)}
    assert exact_dedup.survivors(df).columns == df.columns


def test_host_verdicts_against_plain(spark):
    """``kept`` of every row, with a host that passes the limit, few hosts sent to all tasks and many salted."""
    good = " ".join(prose(1))
    rows = [(i, good + f" w{i}" if i % 30 == 0 or i >= 300 else "bad", "junk" if i < 300 else f"s{i % 4}" if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    failed = {r[0]: r[-1] for r in brute.op9([(i, t) for i, t, _ in rows])}
    hosts = {}
    for i, _, h in rows:
        hosts.setdefault(h or "", []).append(failed[i])
    rates = {h: sum(x) / len(x) for h, x in hosts.items()}
    m = sum(rates.values()) / len(rates)
    v = sum((x - m) ** 2 for x in rates.values()) / len(rates)
    k = min(1000, max(1, m * (1 - m) / v - 1))
    shrunk = {h: (sum(x) + m * k) / (len(x) + k) for h, x in hosts.items()}
    want = {i: not failed[i] and shrunk[h or ""] <= quality.HOST_LIMIT for i, _, h in rows}
    assert any(shrunk[h] > quality.HOST_LIMIT for h in shrunk) and not want[30]
    for most in (quality.SENT_HOSTS, 0):
        before, quality.SENT_HOSTS = quality.SENT_HOSTS, most
        try:
            assert {r.doc_id: r.kept for r in quality.judge(df).collect()} == want
            assert set(texts_of(quality.passing(df))) == {i for i, x in want.items() if x}
        finally:
            quality.SENT_HOSTS = before


def test_slots_in_many_blocks(spark):
    rows = [(i * 7 % 400 if i % 9 else None, f"t{i % 3}") for i in range(400)]
    df = spark.createDataFrame(rows, TWO)
    placed = sharding.assign(df, "doc_id", 5, 6, rows_per_block=30, then=("text",)).collect()
    assert len(placed) == 400
    for s in range(5):
        inside = sorted((r for r in placed if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in inside] == list(range(len(inside)))
        assert [r.doc_id for r in inside] == sorted((r.doc_id for r in inside), key=lambda x: (x is not None, x or 0))
        assert all(r.grown_shard in (r.shard, 5) for r in inside)
    cuts = cut_points(df, "doc_id", 30)
    assert len(cuts) > 5 and rank_within(df.where("doc_id is not null"), ["text"], ["doc_id"], "n", cuts).agg(F.max("n")).first()[0] < 400


# ---------------------------------------------------------------- near duplicates and cut passages


def test_near_dedup_drops_rows_not_ids(spark):
    a, b = " ".join(prose(1)), " ".join(prose(2))
    df = spark.createDataFrame([(1, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (None, a, "en", "s", 1), (None, "", "en", "s", 1), (9, None, "en", "s", 1)], DOCS)
    assert sorted((r.doc_id, r.text) for r in similar.survivors(df).collect()) == [(1, a), (5, b), (9, None)]


def test_near_dedup_finds_all_pairs_of_the_given_table(spark, sf):
    """Recall and precision on real rows: what stays is what brute force over all pairs of whole texts keeps."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("text is not null").collect()
    texts = {r.doc_id: r.text for r in rows if len(r.text.split()) >= 5}
    plain = {i: " ".join(brute.WORD.findall(t)) for i, t in texts.items()}
    assert near_survivors(spark, texts) == kept_of(plain)


def test_cut_passages_leave_the_spacing(spark):
    passage = "\n".join(prose(50, 30))
    first, second = f"start here\n{passage}\nend of it", f"other\tstart,\n\n{passage}\n  and\n\nanother end  "
    df = spark.createDataFrame([(1, first, "en", "s", 1), (2, second, "en", "s", 1), (3, passage, "en", "s", 1), (4, None, "en", "s", 1)], DOCS)
    got = {r.doc_id: r for r in P.cut_repeats(spark, df, "").collect()}
    assert got[1].text == first and got[2].text == "other\tstart,\n\nand\n\nanother end  " and got[2].n_chars == len(got[2].text)
    assert 3 not in got and got[4].text is None


def test_long_text_in_slices(spark):
    """Texts over a slice's size, beside short ones, are judged as any others."""
    w = prose(8, 400_000)
    docs = [(1, " ".join(w)), (2, "x " * 30 + " ".join(w[1000:1100])), (3, "short")]
    got = {r.doc_id: r for r in substring_dedup.without_repeats(spark.createDataFrame(docs, TWO)).collect()}
    want = {r[0]: r for r in brute.op1(docs)}
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == {i: r[1:] for i, r in want.items()}
