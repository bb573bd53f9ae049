"""Bridges, rooted forests and spectra against plain versions."""

import numpy as np
import pytest

from fieldbook.operators import graph as G


def _edges(spark, rows):
    return spark.createDataFrame([(g, min(a, b), max(a, b), 1) for g, a, b in rows], "g int, a string, b string, w int")


def _reach(pairs, start):
    seen, front = {start}, [start]
    while front:
        u = front.pop()
        for a, b in pairs:
            for x, y in ((a, b), (b, a)):
                if x == u and y not in seen:
                    seen.add(y)
                    front.append(y)
    return seen


def _random(rng, g, n, m):
    got = set()
    while len(got) < m:
        a, b = sorted(rng.choice(n, 2, replace=False))
        got.add((g, f"n{a:03d}", f"n{b:03d}"))
    return sorted(got)


def test_bridges_and_roots(spark):
    rng = np.random.default_rng(5)
    rows = _random(rng, 1, 40, 42) + _random(rng, 2, 25, 20) + _random(rng, 3, 12, 40)
    rows += [(4, f"p{i:02d}", f"p{i + 1:02d}") for i in range(20)]  # a path: all are
    rows += [(5, "a", "b"), (5, "b", "c"), (5, "a", "c"), (5, "c", "d"), (5, "d", "e"), (5, "e", "f"), (5, "d", "f"), (5, "c", "d")]  # two triangles; an edge given twice
    e = _edges(spark, rows)
    want = set()
    for g in {r[0] for r in rows}:
        mine = {r[1:] for r in rows if r[0] == g}
        want |= {(g, *x) for x in mine if x[1] not in _reach(mine - {x}, x[0])}
    assert {tuple(r) for r in G.bridges(e).collect()} == want
    assert {(4, f"p{i:02d}", f"p{i + 1:02d}") for i in range(20)} | {(5, "c", "d")} <= want and len(want) < len(rows)
    forest = {(r.g, r.u): r for r in G.rooted(e).collect()}
    for (g, u), r in forest.items():
        mine = [x[1:] for x in rows if x[0] == g]
        assert r.root == min(_reach(mine, u))
        assert (r.parent is None) == (r.depth == 0) == (u == r.root)
        assert r.parent is None or forest[g, r.parent].depth == r.depth - 1


def test_no_edges(spark):
    e = _edges(spark, [(1, "a", "b")]).where("g = 0")
    assert G.bridges(e).count() == 0
    assert G.spectrum(e).count() == 0


@pytest.mark.parametrize("dense", [0, 1000])
def test_spectrum(spark, dense):
    rng = np.random.default_rng(7)
    rows = _random(rng, 1, 60, 110) + _random(rng, 2, 30, 200) + [(3, "a", "b"), (3, "b", "c")] + [(4, "x", "y")]
    rows += [(5, f"p{i:02d}", f"p{i + 1:02d}") for i in range(13)]  # a path: the eigenvalues lie close together
    got = G.spectrum(_edges(spark, rows), dense=dense).toPandas()
    assert set(got["g"]) == {1, 2, 3, 5}  # two nodes alone have no spectrum
    for g, mine in got.groupby("g"):
        pairs = [r[1:] for r in rows if r[0] == g]
        names = sorted(max((_reach(pairs, u) for u in {x for p in pairs for x in p}), key=len))
        at = {t: k for k, t in enumerate(names)}
        lap = np.zeros((len(names), len(names)))
        for a, b in pairs:
            if a in at:
                i, j = at[a], at[b]
                lap[i, i] += 1
                lap[j, j] += 1
                lap[i, j] -= 1
                lap[j, i] -= 1
        values, vectors = np.linalg.eigh(lap)
        mine = mine.sort_values("u")
        assert mine["u"].tolist() == names
        assert np.allclose(mine["connectivity"], values[1], atol=1e-6)
        for k, c in ((1, "fiedler"), (2, "second")):
            v = mine[c].to_numpy()
            assert abs(abs(v @ vectors[:, k]) - 1) < 1e-6 and np.allclose(lap @ v, values[k] * v, atol=1e-6)
            assert v[np.argmax(np.round(np.abs(v), 9))] > 0
