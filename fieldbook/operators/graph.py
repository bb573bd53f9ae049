"""Graphs of contests, many at a time: every operator takes edges with a graph key ``g`` and returns rows by graph.

Undirected edges are (``g``, ``a`` < ``b``, ``w``); directed ones (``g``, ``src``, ``dst``, ``w``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.scalars import portable_round
from fieldbook.sources.store import shared_folder, written


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def win_edges(games: DataFrame) -> DataFrame:
    """Winner to loser; ties give no edge."""
    won = F.col("margin") > 0
    return games.where("margin <> 0").select("g", F.when(won, F.col("home")).otherwise(F.col("away")).alias("src"), F.when(won, F.col("away")).otherwise(F.col("home")).alias("dst"), F.abs("margin").alias("w"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.groupBy("g", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("w").alias("w"))


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("g", F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x"), "w").select("g", "x.u", "x.v", "w")


def degrees(e: DataFrame) -> DataFrame:
    d = both_ways(e).groupBy("g", "u").agg(F.count(F.lit(1)).alias("d"))
    return d.groupBy("g").agg(F.count(F.lit(1)).alias("nodes"), (F.sum("d") / 2).cast("long").alias("edges"), F.min("d").alias("min_degree"), F.max("d").alias("max_degree"), portable_round(F.sum("d") / F.count(F.lit(1))).alias("mean_degree"))


def pagerank(edges: DataFrame, tolerance: float = 1e-6, most: int = 100, damping: float = 0.85) -> DataFrame:
    """Credit flows from loser to winner by summed margin; what nodes without losses hold is dealt to all.

    Passes go on until no node of any graph moves by more than ``tolerance``; every fourth is written out and asked.
    """
    flow = edges.groupBy("g", F.col("dst").alias("src"), F.col("src").alias("dst")).agg(F.sum("w").alias("w"))
    flow = _cut(flow.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("g", "src"))))
    senders = flow.select("g", F.col("src").alias("u")).distinct().withColumn("sends", F.lit(True))
    nodes = flow.select("g", F.col("src").alias("u")).union(flow.select("g", "dst")).distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g")))
    nodes = _cut(nodes.join(senders.hint("merge"), ["g", "u"], "left").withColumn("sends", F.coalesce("sends", F.lit(False))))
    rank = nodes.withColumns({"r": 1.0 / F.col("n"), "was": F.lit(0.0)})
    for k in range(most):
        got = rank.select("g", F.col("u").alias("src"), "r").join(flow.hint("merge"), ["g", "src"]).groupBy("g", F.col("dst").alias("u")).agg(F.sum(F.col("r") * F.col("share")).alias("got"))
        loose = F.sum(F.when(~F.col("sends"), F.col("r")).otherwise(0.0)).over(Window.partitionBy("g"))
        rank = rank.withColumn("loose", loose).join(got.hint("merge"), ["g", "u"], "left").select(
            "g", "u", "n", "sends", ((1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / F.col("n"))).alias("x"), F.col("r").alias("was")
        ).withColumnRenamed("x", "r")
        if k % 4 == 3:
            rank = _cut(rank)
            if (rank.agg(F.max(F.abs(F.col("r") - F.col("was")))).first()[0] or 0.0) < tolerance:
                break
    return rank.select("g", "u", "r")


def components(e: DataFrame) -> DataFrame:
    """``g``, ``u`` and the component's smallest node: labels spread until none changes."""
    pairs = _cut(both_ways(e).select("g", "u", "v"))
    now = _cut(pairs.select("g", "u").distinct().withColumn("label", F.col("u")))
    while True:
        near = pairs.join(now.select("g", F.col("u").alias("v"), F.col("label").alias("l")), ["g", "v"]).groupBy("g", "u").agg(F.min("l").alias("l"))
        new = _cut(now.join(near.hint("merge"), ["g", "u"]).select("g", "u", F.least("label", "l").alias("label"), (F.col("l") < F.col("label")).alias("moved")))
        if not new.where("moved").take(1):
            return new.select("g", "u", "label")
        now = new.drop("moved")


def distances(e: DataFrame) -> DataFrame:
    """Shortest path lengths of all pairs that have one, level by level: ``g``, ``s``, ``u``, ``d``."""
    pairs = _cut(both_ways(e).select("g", "u", "v"))
    seen = _cut(pairs.select("g", F.col("u").alias("s"), F.col("u")).distinct().withColumn("d", F.lit(0)))
    front, level = seen, 0
    while True:
        level += 1
        step = front.select("g", "s", "u").join(pairs, ["g", "u"]).select("g", "s", F.col("v").alias("u")).distinct()
        front = _cut(step.join(seen.hint("merge"), ["g", "s", "u"], "left_anti").withColumn("d", F.lit(level)))
        if not front.take(1):
            return seen
        seen = _cut(seen.unionByName(front))


def distance_summary(e: DataFrame) -> DataFrame:
    """Diameter, radius and mean path of each graph, over pairs that are connected."""
    d = distances(e).where("d > 0")
    far = d.groupBy("g", "s").agg(F.max("d").alias("ecc"), F.sum("d").alias("t"), F.count(F.lit(1)).alias("n"))
    return far.groupBy("g").agg(F.max("ecc").alias("diameter"), F.min("ecc").alias("radius"), portable_round(F.sum("t") / F.sum("n")).alias("mean_path"))


def triangles(e: DataFrame) -> DataFrame:
    x, y, z = (e.select(F.col("g").alias(f"g{i}"), F.col("a").alias(f"a{i}"), F.col("b").alias(f"b{i}")) for i in (1, 2, 3))
    met = x.join(y, (F.col("g1") == F.col("g2")) & (F.col("b1") == F.col("a2"))).join(z, (F.col("g1") == F.col("g3")) & (F.col("a1") == F.col("a3")) & (F.col("b2") == F.col("b3")))
    return met.groupBy(F.col("g1").alias("g")).agg(F.count(F.lit(1)).alias("triangles"))


def cycles(edges: DataFrame, ratings: DataFrame, limit: int = 12) -> DataFrame:
    """Directed three-cycles, each set of teams once, by tension: how far losers were rated above winners."""
    one = edges.groupBy("g", "src", "dst").agg(F.max("w").alias("w"))
    e = one.join(ratings.select("g", F.col("u").alias("src"), F.col("rating").alias("rs")).hint("merge"), ["g", "src"]).join(ratings.select("g", F.col("u").alias("dst"), F.col("rating").alias("rd")).hint("merge"), ["g", "dst"])
    e = e.select("g", "src", "dst", F.greatest(F.lit(0), F.col("rd") - F.col("rs")).alias("t"))
    x, y, z = (e.select(F.col("g").alias(f"g{i}"), F.col("src").alias(f"s{i}"), F.col("dst").alias(f"d{i}"), F.col("t").alias(f"t{i}")) for i in (1, 2, 3))
    met = x.join(y, (F.col("g1") == F.col("g2")) & (F.col("d1") == F.col("s2"))).join(z, (F.col("g1") == F.col("g3")) & (F.col("d2") == F.col("s3")) & (F.col("d3") == F.col("s1")))
    met = met.where((F.col("s1") < F.col("s2")) & (F.col("s1") < F.col("s3")))
    names = F.array_join(F.array_sort(F.array("s1", "s2", "s3")), ",")
    found = met.groupBy(F.col("g1").alias("g"), names.alias("teams")).agg(F.max(F.col("t1") + F.col("t2") + F.col("t3")).alias("tension"))
    w = Window.partitionBy("g").orderBy(F.desc("tension"), "teams")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def neighbours(edges: DataFrame, ratings: DataFrame) -> DataFrame:
    """Mean rating of distinct opponents beside one's own."""
    e = both_ways(undirected(edges)).select("g", "u", "v")
    met = e.join(ratings.select("g", F.col("u").alias("v"), F.col("rating").alias("rv")).hint("merge"), ["g", "v"])
    near = met.groupBy("g", "u").agg(F.count(F.lit(1)).alias("opponents"), F.sum("rv").alias("t"))
    return near.join(ratings.hint("merge"), ["g", "u"]).select("g", "u", "opponents", portable_round(F.col("t") / F.col("opponents")).alias("near"), portable_round(F.col("rating") - F.col("t") / F.col("opponents")).alias("above"))


def spanning_tree(e: DataFrame) -> DataFrame:
    """Maximum spanning forest by Borůvka: each component takes its best edge, components merge, until none has one."""
    edges = _cut(e.select("g", "a", "b", "w"))
    label = _cut(both_ways(edges).select("g", "u").distinct().withColumn("c", F.col("u")))
    taken = None
    while True:
        la, lb = label.select("g", F.col("u").alias("a"), F.col("c").alias("ca")), label.select("g", F.col("u").alias("b"), F.col("c").alias("cb"))
        cross = edges.join(la.hint("merge"), ["g", "a"]).join(lb.hint("merge"), ["g", "b"]).where("ca <> cb")
        order = F.struct("w", F.struct("a", "b"))
        best = cross.select("g", F.explode(F.array("ca", "cb")).alias("c"), "a", "b", "w", "ca", "cb").groupBy("g", "c").agg(F.max_by(F.struct("a", "b", "w", "ca", "cb"), order).alias("x"))
        new = _cut(best.select("g", "x.*").distinct())
        if not new.take(1):
            return taken if taken is not None else new.select("g", "a", "b", "w")
        taken = _cut((taken.unionByName(new.select("g", "a", "b", "w")) if taken is not None else new.select("g", "a", "b", "w")).distinct())
        merged = components(new.select("g", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "w").distinct())
        m = merged.select("g", F.col("u").alias("c"), F.col("label"))
        label = _cut(label.join(m.hint("merge"), ["g", "c"], "left").select("g", "u", F.coalesce("label", "c").alias("c")))


def betweenness(e: DataFrame) -> DataFrame:
    """Share of shortest paths through each node, normalised: paths are counted outwards level by level, shares added up on the way back, all starts and graphs at once."""
    near = _cut(both_ways(e).select("g", "u", "v"))
    far = distances(e)
    top = far.agg(F.max("d")).first()[0] or 0
    level = lambda k: far.where(F.col("d") == k).select("g", "s", "u")
    paths = [_cut(level(0).withColumn("n", F.lit(1.0)))]
    for k in range(1, top + 1):
        step = paths[-1].join(near.hint("merge"), ["g", "u"]).groupBy("g", "s", F.col("v").alias("u")).agg(F.sum("n").alias("n"))
        paths.append(_cut(step.join(level(k).hint("merge"), ["g", "s", "u"])))
    total, share = None, paths[top].withColumn("x", F.lit(0.0))
    for k in range(top, 0, -1):
        back = share.select("g", "s", F.col("u").alias("w"), ((1 + F.col("x")) / F.col("n")).alias("y")).join(near.select("g", F.col("v").alias("w"), "u").hint("merge"), ["g", "w"]).groupBy("g", "s", "u").agg(F.sum("y").alias("y"))
        if k < top:
            total = share if total is None else total.unionByName(share)
        share = _cut(paths[k - 1].join(back.hint("merge"), ["g", "s", "u"], "left").select("g", "s", "u", "n", (F.col("n") * F.coalesce("y", F.lit(0.0))).alias("x")))
    nodes = near.select("g", "u").distinct().withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("g")))
    got = total.groupBy("g", "u").agg(F.sum("x").alias("x")) if total is not None else nodes.select("g", "u", F.lit(0.0).alias("x"))
    out = nodes.join(got.hint("merge"), ["g", "u"], "left")
    return out.select("g", "u", (F.coalesce("x", F.lit(0.0)) / F.greatest((F.col("size") - 1) * (F.col("size") - 2), F.lit(1))).alias("betweenness"))


def rooted(e: DataFrame) -> DataFrame:
    """``g``, ``u``, ``root``, ``depth`` and ``parent``: the forest of shortest paths from the smallest node of each component, whose own parent is null.

    Each node takes the least of what its neighbours offer (root, depth, parent) until none changes, some two passes a level.
    """
    pairs = _cut(both_ways(e.where("a <> b")).select("g", "u", "v").distinct())
    now = _cut(pairs.select("g", "u").distinct().withColumn("at", F.struct(F.col("u").alias("root"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))))
    while True:
        offer = F.struct(F.col("at.root").alias("root"), (F.col("at.depth") + 1).alias("depth"), F.col("v").alias("parent"))
        near = pairs.join(now.select("g", F.col("u").alias("v"), "at").hint("merge"), ["g", "v"]).groupBy("g", "u").agg(F.min(offer).alias("to"))
        new = _cut(now.join(near.hint("merge"), ["g", "u"]).select("g", "u", F.least("at", "to").alias("at"), (F.col("to") < F.col("at")).alias("moved")))
        if not new.where("moved").take(1):
            return new.select("g", "u", "at.*")
        now = new.drop("moved")


def below(tree: DataFrame, columns: list[str]) -> DataFrame:
    """``tree`` (``g``, ``u``, ``parent``, ``columns``) with each column's exclusive or over the node and all below it.

    By doubling: a node knows what lies less than 2^k steps under it and who stands 2^k steps above it, and those exactly 2^k steps
    under it tell theirs, so a tree of depth d takes log2(d) passes.
    """
    now = tree.select("g", "u", F.col("parent").alias("up"), *columns)
    while True:
        now = _cut(now)
        if not now.where("up is not null").take(1):
            return tree.drop(*columns).join(now.select("g", "u", *columns).hint("merge"), ["g", "u"])
        told = now.where("up is not null").groupBy("g", F.col("up").alias("u")).agg(*[F.bit_xor(c).alias(f"{c}_told") for c in columns])
        above = now.select("g", F.col("u").alias("up"), F.col("up").alias("next"))
        more = now.join(told.hint("merge"), ["g", "u"], "left").join(above.hint("merge"), ["g", "up"], "left")
        now = more.select("g", "u", F.col("next").alias("up"), *[F.col(c).bitwiseXOR(F.coalesce(f"{c}_told", F.lit(0).cast("long"))).alias(c) for c in columns])


def bridges(e: DataFrame) -> DataFrame:
    """Edges without which their ends are apart: ``g``, ``a`` < ``b``.

    Only edges of a spanning forest can be. Each other edge has a label of 128 bits, which both its ends hold; over the nodes under a
    tree's edge the labels of edges that stay inside cancel out, so nothing is left if and only if no other edge leads out. That
    two labels or more cancel by chance has odds of 2^-128 an edge. Edges given twice count once.
    """
    edges = e.where("a <> b").select("g", "a", "b").distinct()
    forest = rooted(e)
    tree = forest.where("parent is not null").select("g", F.least("u", "parent").alias("a"), F.greatest("u", "parent").alias("b"))
    label = [F.xxhash64(F.lit(k), "g", "a", "b").alias(f"l{k}") for k in (0, 1)]
    other = edges.join(tree.hint("merge"), ["g", "a", "b"], "left_anti").select("g", F.explode(F.array("a", "b")).alias("u"), *label)
    held = other.groupBy("g", "u").agg(F.bit_xor("l0").alias("l0"), F.bit_xor("l1").alias("l1"))
    nodes = forest.join(held.hint("merge"), ["g", "u"], "left").na.fill(0, ["l0", "l1"])
    out = below(nodes.select("g", "u", "parent", "l0", "l1"), ["l0", "l1"]).where("parent is not null and l0 = 0 and l1 = 0")
    return out.select("g", F.least("u", "parent").alias("a"), F.greatest("u", "parent").alias("b"))


#: Components up to this many nodes are solved as one group (a matrix of 8 MB); larger ones are iterated.
DENSE = 1000
#: Vectors that are iterated together, and the filter's degree in a round.
BLOCK, DEGREE, SALTS = 6, 12, 32


def spectrum(e: DataFrame, dense: int = DENSE) -> DataFrame:
    """Algebraic connectivity, Fiedler coordinate and a second one of the nodes of each graph's largest component of three nodes or more.

    Of equally large components that with the smallest node counts. Coordinates have length 1 over the component; the entry that is farthest from 0 (of
    equals, to nine digits, the first node's) is positive. Components of more than ``dense`` nodes never meet in a task: see ``_iterated``.
    """
    label = components(e)
    size = label.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"))
    giant = size.where("n >= 3").groupBy("g").agg(F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), "label")).alias("x")).select("g", "x.*")
    inside = label.join(giant.hint("merge"), ["g", "label"]).select("g", F.col("u").alias("a"), "n")
    edges = _cut(e.where("a <> b").select("g", "a", "b").distinct().join(inside.hint("merge"), ["g", "a"]))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(g["a"]) | set(g["b"]))
        i, j = (g[c].map({t: k for k, t in enumerate(names)}).to_numpy() for c in ("a", "b"))
        lap = np.zeros((len(names), len(names)))
        np.add.at(lap, (i, j), -1.0)
        lap = lap + lap.T
        lap -= np.diag(lap.sum(axis=1))
        values, vectors = np.linalg.eigh(lap)
        way = lambda v: v * (1 if v[np.argmax(np.round(np.abs(v), 9))] > 0 else -1)
        return pd.DataFrame({"g": key[0], "u": names, "connectivity": values[1], "fiedler": way(vectors[:, 1]), "second": way(vectors[:, 2])})

    small = edges.where(F.col("n") <= dense).groupBy("g").applyInPandas(run, "g int, u string, connectivity double, fiedler double, second double")
    large = edges.where(F.col("n") > dense)
    return small.unionByName(_iterated(large)) if large.take(1) else small


def _beside(nodes: DataFrame, graphs: DataFrame) -> DataFrame:
    """Nodes with their graph's row. A graph may hold most nodes, so its row is copied and its nodes are dealt."""
    salt = graphs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return nodes.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salt.hint("merge"), ["g", "salt"]).drop("salt")


def _iterated(edges: DataFrame, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """The same by subspace iteration, a row for each node with ``BLOCK`` numbers, all graphs at once.

    The matrix stands as rows, its diagonal too, so a product is a join and a sum. In a round a Chebyshev polynomial lifts what belongs to small
    eigenvalues, the constant vector is taken out, and each graph's small matrices of inner products (sums of Spark, a row for
    each graph) give the rotation to the best vectors. A graph is done when both its residuals are below ``tolerance`` of its largest
    possible eigenvalue, or after ``rounds`` with what has been reached; the others go on.
    """
    some = range(BLOCK)
    keep = lambda df: written(df, "state")  # noqa: E731  (what a checkpoint knows of its columns' constraints would double each round)
    ways = edges.select("g", F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("g", "x.*")
    degree = keep(ways.groupBy("g", "u").agg(F.count(F.lit(1)).cast("double").alias("w")))
    matrix = keep(ways.withColumn("w", F.lit(-1.0)).unionByName(degree.select("g", "u", F.col("u").alias("v"), "w")))
    top = keep(degree.groupBy("g").agg(F.least(F.count(F.lit(1)).cast("double"), 2 * F.max("w")).alias("top")))
    own = F.col("u") == F.col("v")
    mine = lambda x: F.sum(F.when(own, x).otherwise(0.0))

    def product(state: DataFrame) -> DataFrame:
        met = matrix.join(state.hint("merge"), ["g", "v"]).groupBy("g", F.col("u").alias("v"))
        return met.agg(*[mine(F.col(f"x{k}")).alias(f"x{k}") for k in some], *[F.sum(F.col("w") * F.col(f"x{k}")).alias(f"y{k}") for k in some])

    def filtered(state: DataFrame) -> DataFrame:
        """``DEGREE`` steps of the recurrence; ``mid`` and ``half`` are the middle and half the width of what is damped."""
        now = state.select("g", "v", "mid", "half", *[f"x{k}" for k in some], *[F.lit(0.0).alias(f"p{k}") for k in some])
        for step in range(DEGREE):
            scale = (1.0 if step == 0 else 2.0) / F.col("half")
            new = lambda k, s=scale: F.sum(s * (F.col("w") - F.when(own, F.col("mid")).otherwise(0.0)) * F.col(f"x{k}") - F.when(own, F.col(f"p{k}")).otherwise(0.0))
            met = matrix.join(now.hint("merge"), ["g", "v"]).groupBy("g", F.col("u").alias("v"))
            now = met.agg(F.max("mid").alias("mid"), F.max("half").alias("half"), *[new(k).alias(f"x{k}") for k in some], *[mine(F.col(f"x{k}")).alias(f"p{k}") for k in some])
            if step % 4 == 3:
                now = keep(now)
        return now.select("g", "v", *[f"x{k}" for k in some])

    def rotations(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                s, h = (np.array(x, dtype=float).reshape(BLOCK, BLOCK) for x in (r.s, r.h))
                scale = np.sqrt(np.maximum(np.diag(s), 1e-300))
                val, vec = np.linalg.eigh(s / np.outer(scale, scale))
                real = val > 1e-10 * max(val.max(), 1e-300)
                base = (vec[:, real] / np.sqrt(val[real])) / scale[:, None]
                theta, turn = np.linalg.eigh(base.T @ ((h + h.T) / 2) @ base)
                rot, full = np.zeros((BLOCK, BLOCK)), np.zeros(BLOCK)
                rot[:, : len(theta)], full[: len(theta)] = base @ turn, theta
                damped = min(theta[-1], (r.top + 2 * theta[0]) / 3)  # so that no direction grows by more than 10^7 against another
                out.append((r.g, r.top, rot.ravel().tolist(), full.tolist(), (damped + r.top) / 2, (r.top - damped) / 2))
            yield pd.DataFrame(out, columns=["g", "top", "rot", "theta", "mid", "half"])

    state = degree.select("g", F.col("u").alias("v"), *[(F.xxhash64("u", F.lit(k)) / float(2**63)).alias(f"x{k}") for k in some])
    done = None
    for k in range(rounds):
        mean = state.groupBy("g").agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in some])
        state = keep(product(_beside(state, mean).select("g", "v", *[(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"x{i}") for i in some])))
        dots = lambda c: F.array(*[F.sum(F.col(f"x{i}") * F.col(f"{c}{j}")) for i in some for j in some])
        turned = state.groupBy("g").agg(dots("x").alias("s"), dots("y").alias("h")).join(top.hint("merge"), "g")
        turned = keep(turned.mapInPandas(rotations, "g int, top double, rot array<double>, theta array<double>, mid double, half double"))
        new = lambda c, j: sum(F.col(f"{c}{i}") * F.col("rot")[i * BLOCK + j] for i in some).alias(f"{c}{j}")
        state = keep(_beside(state, turned).select("g", "v", "top", "theta", "mid", "half", *[new("x", j) for j in some], *[new("y", j) for j in some]))
        miss = [F.sum((F.col(f"y{j}") - F.col("theta")[j] * F.col(f"x{j}")) ** 2) for j in (0, 1)]
        apart = keep(state.groupBy("g").agg((F.sqrt(F.greatest(*miss)) / F.max("top")).alias("miss")))
        state = keep(_beside(state, apart))
        is_open = (F.col("miss") >= tolerance) & F.lit(k < rounds - 1)
        done = state.where(~is_open) if done is None else done.unionByName(state.where(~is_open))
        state = state.where(is_open)
        if not state.take(1):
            break
        state = filtered(state)
    far = lambda c: F.min_by(F.signum(c), F.struct(-F.round(F.abs(F.col(c)), 9), "v"))
    sign = done.groupBy("g").agg(far("x0").alias("s0"), far("x1").alias("s1"))
    return _beside(done, sign).select("g", F.col("v").alias("u"), F.col("theta")[0].alias("connectivity"), (F.col("x0") * F.col("s0")).alias("fiedler"), (F.col("x1") * F.col("s1")).alias("second"))


def distance_histogram(e: DataFrame) -> DataFrame:
    """Ordered pairs of nodes by their distance, with the lower bound on the mean path that the mean degree gives."""
    d = distances(e).where("d > 0").groupBy("g", "d").agg(F.count(F.lit(1)).alias("pairs"))
    n = both_ways(e).groupBy("g").agg(F.countDistinct("u").alias("n"), F.count(F.lit(1)).cast("double").alias("ends"))
    return d.join(n.hint("merge"), "g").select("g", "d", "pairs", portable_round(2 - (F.col("ends") / F.col("n")) / (F.col("n") - 1)).alias("bound"))


def attach(games: DataFrame) -> DataFrame:
    """Measures of each node side by side: mean signed margin over all its contests, degree among its opponents, share of wins."""
    one = F.explode(F.array(F.struct(F.col("home").alias("u"), F.col("margin").alias("m")), F.struct(F.col("away").alias("u"), (-F.col("margin")).alias("m"))))
    n = F.count(F.lit(1))
    base = games.select("g", one.alias("x")).groupBy("g", F.col("x.u").alias("u")).agg(F.sum("x.m").alias("total"), n.alias("n"), F.sum((F.col("x.m") > 0).cast("int")).alias("wins"))
    degree = both_ways(undirected(win_edges(games))).groupBy("g", "u").agg(n.alias("degree"))
    out = base.join(degree.hint("merge"), ["g", "u"], "left")
    return out.select("g", "u", portable_round(F.col("total") / F.col("n")).alias("signed"), F.coalesce("degree", F.lit(0)).alias("degree"), portable_round(F.col("wins") / F.col("n")).alias("win_rate"))


def ego(edges: DataFrame, ratings: DataFrame, node: str) -> DataFrame:
    """One node's edges, and whether the loser was rated more than three above the winner."""
    mine = edges.where((F.col("src") == node) | (F.col("dst") == node))
    rated = lambda c: ratings.select("g", F.col("u").alias(c), F.col("rating").alias(f"{c}_rating")).hint("merge")
    met = mine.join(rated("src"), ["g", "src"]).join(rated("dst"), ["g", "dst"])
    return met.select("g", "src", "dst", "w", (F.col("dst_rating") - F.col("src_rating") > 3).alias("surprise"))
