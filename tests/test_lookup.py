"""The index finds what a scan of all names does."""

import re

import numpy as np

from fieldbook.operators import lookup as L

KINDS = ("team", "player")


def _key(x):
    return re.sub("[^a-z0-9]+", " ", x.lower()).strip()


def test_against_a_scan(spark):
    rng = np.random.default_rng(4)
    names = ["".join(rng.choice(list("ab c-"), rng.integers(1, 9))) for _ in range(300)] + ["Ohio State", "Miami (OH)", "Miami (FL)", "Ohio", "ohio", "St. Ohio", "", "é", "ab"] * 2
    rows = [(KINDS[i % 2], n) for i, n in enumerate(names)]
    asked = ["Ohio", "ohio state buckeyes", "a", "ab", "ba c", "c", "", "zz", "MIAMI", "miamx", "abab", "b-a", "ab ba ca"]
    index = L.index_names(spark.createDataFrame([*rows, ("team", None)], "kind string, name string")).cache()
    q = spark.createDataFrame([(x,) for x in [*asked, None, "Ohio"]], "query string")

    def score(n, x):
        a, b = _key(n), _key(x)
        return 0 if a == b else 1 if b in a else 2 if a.split(" ")[-1] == b.split(" ")[-1] else None

    def tier(n, x):
        a, b = _key(n), _key(x)
        return 0 if a == b else 1 if a in b or b in a else 2 if a[:4] == b[:4] else None

    found, means = {}, {}
    for r in L.find(index, q, 15).collect():
        found.setdefault(r.query, {})[r.place] = (r.score, r.kind, r.name)
    for r in L.resolve(index, q, 8).collect():
        means.setdefault(r["query"], {})[r.place] = (r.tier, r.name)
    for x in asked:
        want = sorted((score(n, x), k, n) for k, n in rows if score(n, x) is not None)[:15]
        assert [found.get(x, {})[i + 1] for i in range(len(want))] == want and len(found.get(x, {})) == len(want)
        all_ = sorted({(tier(n, x), n) for _, n in rows if tier(n, x) is not None})
        want = [t for t in all_ if t[0] == all_[0][0]][:8]
        assert [means.get(x, {})[i + 1] for i in range(len(want))] == want and len(means.get(x, {})) == len(want)
    assert set(found) <= set(asked)
    assert L.find(index.where("false"), q).count() == 0


def test_only_names_shuffle(spark):
    names = spark.range(5000).selectExpr("'draft' AS kind", "concat('Order ', id) AS name")
    index = L.index_names(names, 1000)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.index("Generate") < plan.index("Exchange")  # pieces are made after the last shuffle
    rows = index.collect()
    assert len(rows) == sum(len({f"{k}||"[i : i + 3] for i in range(len(k))}) + 4 for k in (f"order {n}" for n in range(5000)))
    found = L.find(index, spark.createDataFrame([("der 49",), ("r 4999",), ("9",), ("99",)], "query string"), 3).collect()
    best = {}
    for r in found:
        best.setdefault(r["query"], {})[r.place] = (r.score, r.name)
    for q in ("der 49", "r 4999", "9", "99"):
        want = sorted((1, f"Order {n}") for n in range(5000) if q in f"order {n}")[:3]
        assert [best[q][i + 1] for i in range(len(want))] == want and len(best[q]) == len(want)
