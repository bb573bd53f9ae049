"""Each stage of the pipeline against a plain version on its own input, and whole runs on odd and empty tables."""

import random

import brute
import pytest
from brute import ODD

import corpus_pipeline as P
from fieldbook.llm import exact_dedup, quality, similar, simhash, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=120):
    rng = random.Random(seed)
    return [rng.choice("ba ke lo mi nu ra sei tor un ve".split()) + rng.choice("lan mor pek sin tur".split()) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Clean documents, exact copies, near copies, a shared passage, and rows that fail."""
    texts = [" ".join(prose(i)) for i in range(12)]
    near = prose(3)
    near[50] = "changed"
    passage = " ".join(prose(99, 60))
    texts += [texts[0], texts[0], " ".join(near), texts[5] + " " + passage, passage + " " + " ".join(prose(77)), "too short", None, " ".join(["la"] * 200), *ODD]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).cache()


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, corpus):
    first = P.quality_rules(spark, corpus, "").cache()
    want = {r[0] for r in brute.op9([(r.doc_id, r.text) for r in corpus.collect()]) if not r[-1]}
    assert set(texts_of(first)) == want and first.columns == corpus.columns
    second = P.drop_exact_copies(spark, first, "").cache()
    kept = {r[0] for r in brute.op8(list(texts_of(first).items())) if r[3]}
    assert set(texts_of(second)) == kept and 13 in kept and 0 not in kept and 12 not in kept
    third = P.drop_near_copies(spark, second, "").cache()
    assert set(texts_of(second)) - set(texts_of(third)) == {14, 32}  # 32 is 31 with a word more
    fourth = P.cut_repeats(spark, third, "").cache()
    removed = {r[0]: r for r in brute.op1(list(texts_of(third).items()))}
    after = texts_of(fourth)
    for i, t in texts_of(third).items():
        if not removed[i][2]:
            assert after[i] == t
        elif removed[i][2] < removed[i][1]:
            assert brute.sha(" ".join(brute.WORD.findall(after[i]))) == removed[i][3]
        else:
            assert i not in after
    assert removed[16][2] == 60 and fourth.columns == corpus.columns
    placed = P.pack(spark, fourth, "").collect()
    assert {r.doc_id for r in placed} == set(after)


def test_hosts(spark):
    """A host of which nearly all documents fail takes its few others with it."""
    good = " ".join(prose(1))
    rows = [(i, good + f" w{i}" if i % 30 == 0 or i >= 300 else "bad", "en", "junk" if i < 300 else f"s{i % 4}", 3) for i in range(600)]
    kept = set(texts_of(quality.passing(spark.createDataFrame(rows, DOCS))))
    assert kept == set(range(300, 600))


def test_odd_and_empty(spark, tmp_path):
    for name, rows in (("odd", [(i, t, None, None, None) for i, t in enumerate(ODD + ODD)]), ("empty", [])):
        spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert P.run(spark, f"{tmp_path}/{name}").count() >= 0
    null_ids = spark.createDataFrame([(None, " ".join(prose(1)), None, "a", 1), (None, " ".join(prose(1)), None, "a", 1), (4, " ".join(prose(2)), None, "a", 1), (4, " ".join(prose(2)), None, "a", 1)], DOCS)
    assert exact_dedup.survivors(null_ids).count() == 2
    assert similar.survivors(null_ids).count() == 2
    assert substring_dedup.without_repeats(null_ids).where("n_removed > 0").count() == 2


def test_near_copies_in_a_large_group(spark):
    """More copies than meet as pairs: all end in one group, and other documents stay."""
    base = prose(5, 300)
    rows = []
    for i in range(80):
        w = list(base)
        w[(i * 7) % 300] = f"x{i}"
        rows.append((i, " ".join(w), "en", "a", 1))
    rows += [(100 + i, " ".join(prose(200 + i, 150)), "en", "a", 1) for i in range(20)]
    assert set(texts_of(similar.survivors(spark.createDataFrame(rows, DOCS)))) == {0, *range(100, 120)}
    found = simhash.near_duplicates(spark.createDataFrame(rows, DOCS))
    want = {r[0]: r for r in brute.op5([(r[0], r[1]) for r in rows])}
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: r[2] for i, r in want.items()}


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar_pairs(texts):
    """Pairs of documents of which four fifths of all five-word shingles are shared, by comparing each with each."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    return [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def kept_of(texts):
    """The smallest of each component of the similar pairs."""
    root, pairs = {i: i for i in texts}, similar_pairs(texts)
    for _ in texts:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return {i for i in texts if root[i] == i}


def near_survivors(spark, texts):
    return set(texts_of(similar.survivors(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts.items()], DOCS))))


def test_near_copies_in_a_mixed_crowd(spark):
    """Of 150 documents that share most of a template, just below the similarity, a few are similar in pairs."""
    form = prose(7, 200)
    texts = {i: form + prose(1000 + i, 30) for i in range(150)}
    for i in range(0, 60, 2):
        texts[200 + i] = texts[i][:-2] + prose(5000 + i, 2)
    texts = {i: " ".join(w) for i, w in texts.items()}
    assert near_survivors(spark, texts) == kept_of(texts) == set(range(150))


def test_repeated_lines_and_shared_passages_are_not_similarity(spark):
    """One line ten times, or a passage in common, beside a text of one's own: shingles count once and pairs are verified."""
    line, passage = prose(1, 20), prose(2, 150)
    texts = {i: " ".join(prose(100 + i, 220) + line * 10) for i in range(12)} | {100 + i: " ".join(passage + prose(300 + i, 55)) for i in range(60)}
    assert near_survivors(spark, texts) == kept_of(texts) == set(texts)


def test_all_pairs_about_the_similarity(spark):
    """Pairs of similarity 0.77 to 0.99: every one of 0.8 or more is found, no other."""
    texts = {}
    for i in range(75):
        w = prose(2000 + i, 200)
        texts[i], texts[100 + i] = " ".join(w), " ".join(w[: 199 - i // 3] + prose(4000 + i, 1 + i // 3))
    kept = kept_of(texts)
    assert len(kept) == 87 and near_survivors(spark, texts) == kept
