"""What slices send and get back, directly and by way of bunches."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldbook.llm import similar, slices, substring_dedup

DETOUR = slices.Route(30, 6, 3)


def test_small_inputs_go_directly_and_large_ones_by_roots(spark):
    one = spark.createDataFrame([(k, b"x" * 1000) for k in range(50)], "batch long, data binary")
    assert slices.route_for(one, 5) == slices.Route(slices.FEWEST_GROUPS, 1, 50)
    many = slices.route_for(one, 5e-6 / slices.GROUP_ENTRIES * 1e6)  # as if 10,000 groups were needed
    assert many.groups == 10_000 and many.fine == 100 and many.bunches == 1
    assert slices.route_for(one.limit(0), 5) == slices.Route(slices.FEWEST_GROUPS, 1, 1)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**48 - 1), max_size=200), st.sampled_from([slices.Route(64, 1, 1), DETOUR]))
def test_messages_hold_every_entry_once_and_answers_come_back_in_order(names, route):
    names = np.array(names, dtype=np.uint64)
    sent = slices.messages(7, names, slices.entries((names, 6), (names % slices.U(200), 1)), route)
    assert len(sent) <= min(len(names), -(-route.groups // route.fine)) and sum(map(len, sent["rec"])) == 7 * len(names)
    rec = [np.frombuffer(r, dtype=np.uint8).reshape(-1, 7) for r in sent["rec"]]
    assert sorted(np.concatenate([slices.numbers(r, 0, 6) for r in rec] or [names])) == sorted(names)
    told = [(p, slices.numbers(r, 6, 1).astype(np.uint8).tobytes()) for p, r in zip(sent["p"], rec)]
    assert (slices.put_back(names, route, told[::-1], bits=False) == names % slices.U(200)).all()
    odd = [(p, np.packbits(slices.numbers(r, 0, 6) & slices.U(1)).tobytes()) for p, r in zip(sent["p"], rec)]
    assert (slices.put_back(names, route, odd) == (names & slices.U(1)).astype(bool)).all()


def test_whole_numbers_below_zero_keep_their_bytes():
    ids = np.array([-(2**63), -1, 0, 5, 2**63 - 1], dtype=np.int64)
    rec = slices.entries((np.arange(5, dtype=np.uint64), 8), (ids, 8))
    assert (slices.numbers(rec, 8, 8).view("<i8") == ids).all()


@pytest.mark.parametrize("bits", [True, False])
def test_a_detour_answers_as_the_direct_way_does(spark, bits):
    rng = np.random.default_rng(5)
    held = {k: np.unique(rng.integers(0, 400, 150).astype(np.uint64)) for k in (0, 1, 5, 1 << 20, (1 << 20) + 1, 9 << 20)}
    often = np.bincount(np.concatenate([*held.values()]).astype(np.int64))

    def answer(rec, batch):
        _, own, n = np.unique(slices.numbers(rec, 0, 6), return_inverse=True, return_counts=True)
        return n[own] > 4 if bits else n[own] + 10 * (batch == 5)

    for route in (slices.Route(30, 1, 6), DETOUR, slices.Route(7, 3, 1), slices.Route(5, 5, 4)):
        sent = pd.concat([slices.messages(k, v, slices.entries((v, 6)), route) for k, v in held.items()])
        got = slices.ask(spark.createDataFrame(sent, slices.SENT), 6, 6, answer, route, bits).collect()
        for k, v in held.items():
            told = slices.put_back(v, route, [(r.p, bytes(r.bits)) for r in got if r.batch == k], bits)
            want = often[v.astype(np.int64)]
            assert (told == (want > 4 if bits else want + 10 * (k == 5))).all()


def test_operators_give_the_same_results_either_way(spark, sf, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(12, "doc_id")
    docs.write.parquet(path := f"{tmp_path}/many")
    docs = spark.read.parquet(path)

    def results():
        cut = substring_dedup.without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
        return sorted(map(tuple, cut.collect())), sorted(r[0] for r in similar.survivors(docs).select("doc_id").collect())

    direct = results()
    monkeypatch.setattr(slices, "DIRECT_GROUPS", 0)
    monkeypatch.setattr(slices, "FEWEST_GROUPS", 30)
    assert slices.route_for(spark.createDataFrame([(k, b"x") for k in range(12)], "batch long, data binary"), 5) == slices.Route(30, 6, 2)
    assert results() == direct and any(r[2] for r in direct[0]) and len(direct[1]) < len(direct[0])
