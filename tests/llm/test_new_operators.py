"""Spelling variants, license scans and the audit of filters against plain versions, and their edges."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from brute import ODD, WORD

from fieldbook.llm import interaction, licenses, new_queries as Q, spelling


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# ---------------------------------------------------------------- spelling variants


def near(x, y):
    """By trying all edits of the shorter or equal one, not by prefixes."""
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def spelled(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[a-zÀ-ÿ]+", lower(t)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    return table(n)


def table(n):
    form, many, by = {}, {}, defaultdict(list)
    for w in n:
        by[len(w)].append(w)
    for w in n:
        found = [x for k in (-1, 0, 1) for x in by[len(w) + k] if near(w, x)]
        best = min(found, key=lambda x: (-n[x], x), default=None)
        many[w], form[w] = len(found), best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], many[w], n.get(form[w])))
    return sorted(out, key=repr)


OP11 = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("which", ["given", "odd", "empty"])
def test_op11(spark, sf, table_of, which):
    d, docs = table_of(which)
    if which == "given":
        docs = docs[:60]
        d = table_of(docs)[0]
    assert rows(Q.op11_spelling_variants(spark, d), *OP11) == spelled(docs)


@pytest.fixture
def table_of(spark, sf, tmp_path, table):
    def of(which):
        if which == "given":
            return sf, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        if isinstance(which, list):
            return table([t for _, t in which], [i for i, _ in which]), which
        texts = [] if which == "empty" else ODD + ["Café cafés café cafés × straße strasse straße ÷÷÷÷÷ " * 3, "colour color colours colours " * 4]
        return table(texts), list(enumerate(texts))

    return of


def random_words(seed, alphabet, longest=9, count=400):
    rng = random.Random(seed)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(5, longest))) for _ in range(count)}
    return {w: rng.choice([3, 4, 6, 8, 12, 24, 100]) for w in words}


@pytest.mark.parametrize("crowded, block, segments", [(8192, 256, 4), (3, 2, 1), (2, 7, 4), (8192, 3, 2)])
def test_near_words_of_crowded_buckets(spark, monkeypatch, crowded, block, segments):
    """Words of two letters are near by the dozen; buckets dealt again and tiles of any size give the same."""
    monkeypatch.setattr(spelling, "CROWDED", crowded)
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "SEGMENTS", segments)
    monkeypatch.setattr(spelling, "PACK", 300)
    n = random_words(block, "ab", 7) | random_words(1, "aéß", 6, 100) | {"a" * 900: 5, "a" * 901: 3, "a" * 450 + "b" + "a" * 450: 20}
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    got = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in spelling.near_words(words).collect()}
    expected = {}
    for w in n:
        found = [x for x in n if near(w, x)]
        if found:
            best = min(found, key=lambda x: (-n[x], x))
            expected[w] = len(found), best, n[best]
    assert got == expected


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(40)] + [("x", "w005"), ("y", "z")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "z" if w == "y" else "w040" for w, _ in chain}


def test_op11_null_ids_and_repeated_rows(spark, table):
    docs = [(None, "Letters letters lettersx"), (None, None), (7, "letters letterz letters"), (7, "letters letterz letters"), (-(1 << 63), "letterz " * 3)]
    assert rows(Q.op11_spelling_variants(spark, table([t for _, t in docs], [i for i, _ in docs])), *OP11) == spelled(docs)


# ---------------------------------------------------------------- license scans


def accepts(parts, words, at):
    """Ends of all readings of a wording that begin at a place, by trying them all."""
    ends = {at}
    for p in parts:
        if isinstance(p, str):
            ends = {e + 1 for e in ends if e < len(words) and words[e] == p}
        elif isinstance(p, tuple):
            ends = {e + k for e in ends for k in range(p[0], p[1] + 1) if e + k <= len(words)}
        else:
            ends |= {f for e in ends for f in accepts(p, words, e)}
        if not ends:
            break
    return ends


def licensed(i, t):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if x]
    places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    labels, most = {x for _, x in places}, 4 if places and any(x != "cc-by-nc" for _, x in places) else 3 if places else 0
    for label, template in licenses.TEMPLATES:
        parts = licenses.parse(template)
        if any(accepts(parts, w, k) for k in range(len(w))):
            labels, most = labels | {label}, max(most, licenses.mandatory(parts))
    at = [k for k, _ in places]
    return i, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), most / (most + 4.0)


OP12 = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def filled(template, rng):
    """A text that a template accepts: optional regions in or out, replaceable ones filled."""

    def say(parts):
        out = []
        for p in parts:
            out += [p] if isinstance(p, str) else [rng.choice(["Jane", "Doe", "2024", "the", "software"]) for _ in range(rng.randint(*p))] if isinstance(p, tuple) else say(p) if rng.random() < 0.5 else []
        return out

    return say(licenses.parse(template))


def test_op12(spark, table_of):
    d, docs = table_of("given")
    found = {r[0]: tuple(r) for r in Q.op12_license_scan(spark, d).select(*OP12).collect()}
    assert len(found) == len(docs) and all(found[i] == licensed(i, t) for i, t in docs[:60])


def test_op12_templates(spark, table):
    rng, texts = random.Random(3), []
    for _, template in licenses.TEMPLATES:
        for k in range(4):
            words = filled(template, rng)
            texts.append(rng.choice(["", "Some words. ", "Under the "]) + rng.choice([" ", ", ", "\n * "]).join(words).upper() + rng.choice(["", " and more"]))
            if k == 0:
                gone = rng.randrange(1, len(words))
                texts += [" ".join(words[:gone] + words[gone + 1 :]), " ".join(words[:gone] + ["odd"] + words[gone:])]
    texts += [None, "", "Under the MIT-License; under the mit license under the MIT license, under\nthe MIT", "under the mit licenseé", "(CC BY-NC 4.0) cc-by-nc", "Apache License, Version 2", "x " * 30_000 + "under the MIT License"]
    ids = [None if i == 2 else -(1 << 63) if i == 3 else i for i in range(len(texts))]
    got = rows(Q.op12_license_scan(spark, table(texts, ids)), *OP12)
    assert got == sorted((licensed(i, t) for i, t in zip(ids, texts)), key=repr)


def test_op12_odd_and_empty(spark, tmp_path):
    for name, texts in (("odd", ODD), ("none", [])):
        spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert rows(Q.op12_license_scan(spark, f"{tmp_path}/{name}"), *OP12) == sorted((licensed(i, t) for i, t in enumerate(texts)), key=repr)


def test_machine_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(licenses, "MAX_STATES", 3)
    machine = licenses.Machine([["a", (0, 2), "b"], ["a", ["c"], ["a", ["d"]], "b"]])
    rng = random.Random(0)
    for _ in range(200):
        words = [rng.choice("abcde") for _ in range(30)]
        got = {(at, k) for at, found in machine.scan(words) for k in found}
        parts = [["a", (0, 2), "b"], ["a", ["c"], ["a", ["d"]], "b"]]
        assert got == {(e - 1, k) for k in (0, 1) for s in range(30) for e in accepts(parts[k], words, s)}


@pytest.mark.parametrize("template", ["<<beginOptional>>a", "a <<endOptional>>", "<<beginOptional>>a<<endOptional>>"])
def test_faulty_templates_are_refused(template):
    with pytest.raises(ValueError):
        licenses.Machine([licenses.parse(template)])


# ---------------------------------------------------------------- audit of filters


def audited(docs, labels):
    """docs: (id, text, part); labels: (id, quality, toxic). Every order is applied by itself."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    by = defaultdict(list)
    for i, t, part in docs:
        text = t or ""
        w = WORD.findall(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > first[text]}
        by[part or ""].append(({x for x in fails if fails[x]}, i in good, i in toxic))
    out = []
    for part, members in by.items():
        lines, sums = [], Counter()
        for order in permutations("ABCDE"):
            left = members
            for step, x in enumerate(order, 1):
                gone = [m for m in left if x in m[0]]
                left = [m for m in left if x not in m[0]]
                failing = sum(x in m[0] for m in members)
                lines.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(m[0] == {x} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone), x])
                sums[x] += len(gone)
        out += [(*line[:-1], sums[line[-1]]) for line in lines]
    return sorted(out, key=repr)


OP13 = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_op13(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert rows(Q.op13_filter_interaction(spark, sf), *OP13) == audited(docs, labels)


def test_op13_edges(spark, table, tmp_path):
    texts = ODD + ["Ab # " * 150, "w " * 199, " ".join(map(str, range(200))), " ".join(map(str, range(200))), None, "", "X" + "a" * 49, "X" + "a" * 48]
    ids = [None if i in (1, 5) else 7 if i in (8, 9) else -(1 << 63) if i == 11 else i for i in range(len(texts))]
    d = table(texts, ids)
    labels = [(3, 1, 0), (3, 0, 1), (7, 1, None), (None, 1, 1), (25, None, 1), (400, 1, 1), (26, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").collect()]
    assert rows(Q.op13_filter_interaction(spark, d), *OP13) == audited(docs, labels)
    assert rows(interaction.audit(interaction.mask_counts(interaction.failures(spark.read.parquet(f"{d}/documents.parquet").limit(0)), spark.read.parquet(f"{d}/labels.parquet"))), *OP13) == []


def test_removal_intervals_cover_every_order_once():
    covered = Counter((mask, rank) for mask, _, lo, hi in interaction.intervals() for rank in range(lo, hi))
    assert covered == {(mask, rank): 1 for mask in range(1, 32) for rank in range(120)}
