"""Streams over several micro-batches against plain versions."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fieldbook.sources.context import FIELDS, context_log
from fieldbook.streaming import context, logs, stamps

DAY0 = datetime(2024, 9, 1)


def batches(spark, rows, schema, path, sizes):
    """Files that a stream takes one at a time, in this order."""
    at = 0
    for k, n in enumerate(sizes):
        spark.createDataFrame(rows[at : at + n], schema).coalesce(1).write.parquet(f"{path}/{k:03}")
        at += n
    assert at == len(rows)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def plain_context(rows, upto):
    out = {}
    for key, ts, i, kind, value in sorted(rows, key=lambda r: r[1:3]):
        if ts > upto:
            continue
        s = out.setdefault(key, dict.fromkeys(FIELDS) | {"locked": False, "had": False, "snaps": []})
        if kind == "lock":
            s["locked"] = True
        elif kind in FIELDS:
            if not s["locked"] or not s["had"]:
                s[kind] = value
            if not s["locked"] and kind == "odds" and (not s["snaps"] or s["snaps"][-1] != value):
                s["snaps"] = [*s["snaps"], value][-24:]
            s["had"] = True
    return out


def test_context_stream_equals_batch_over_micro_batches(spark, tmp_path):
    rng, rows = random.Random(4), []
    for i in range(260):
        key = rng.randrange(6)
        kind = rng.choice([*FIELDS, "odds", "odds", "odds", "other"]) if key else "odds"
        rows.append((key, DAY0 + timedelta(hours=i), i, kind, None if i % 17 == 0 else float(rng.randrange(40))))
    rows += [(k, DAY0 + timedelta(hours=120 + k), 1000 + k, "lock", 0.0) for k in (1, 2, 3)]
    rows += [(77, DAY0 + timedelta(hours=100), 2000, "lock", 0.0), (77, DAY0 + timedelta(hours=110), 2001, "weather", 5.0), (77, DAY0 + timedelta(hours=111), 2002, "weather", 6.0), (77, DAY0 + timedelta(hours=112), 2003, "odds", 6.0)]
    # Records come up to twenty hours out of their order, which the watermark allows.
    rows = sorted(rows, key=lambda r: r[1] + timedelta(hours=rng.uniform(0, 20)))
    schema = "key long, ts timestamp, id long, kind string, value double"
    stream = batches(spark, rows, schema, f"{tmp_path}/in", [60, 60, 60, len(rows) - 180])
    got = {r["key"]: r for r in context.run(stream, spark, f"{tmp_path}/run").collect()}
    upto = max(r[1] for r in rows) - timedelta(days=1)
    want = plain_context(rows, upto)
    assert got.keys() == want.keys() and want[77]["weather"] == 5.0 and max(len(s["snaps"]) for s in want.values()) == 24
    for key, s in want.items():
        assert [got[key][f] for f in FIELDS] == [s[f] for f in FIELDS] and got[key]["locked"] == s["locked"]
        assert [x["value"] for x in got[key]["snapshots"]] == s["snaps"]
    twin = {r["key"]: r for r in context_log(spark.createDataFrame(rows, schema).where(F.col("ts") <= upto)).collect()}
    assert {k: [r[f] for f in FIELDS] for k, r in twin.items()} == {k: [r[f] for f in FIELDS] for k, r in got.items()}


def test_stamps_are_idempotent_and_never_move_a_probability(spark, tmp_path):
    projections = spark.createDataFrame([(1, 0.7, None), (2, 0.4, 3.5), (3, 0.5, None)], "game_id long, p double, spread double")
    at = lambda h: DAY0 + timedelta(hours=h)
    rows = [(1, at(5), 1, 7.0, None), (2, at(1), 2, -3.0, 9.0), (9, at(1), 3, 1.0, 1.0), (1, at(2), 4, 3.0, -2.5), (1, at(4), 5, None, -4.0), (2, at(3), 6, 10.0, None), (1, at(1), 7, 0.0, -1.5)]
    schema = "game_id long, ts timestamp, id long, margin double, spread double"
    stream = batches(spark, rows, schema, f"{tmp_path}/in", [3, 2, 2])
    stamps.stamp_stream(stream, projections, f"{tmp_path}/run")
    read = lambda: sorted(map(tuple, stamps.stamped(projections, stamps.stamps_of(spark, f"{tmp_path}/run")).collect()))
    want = [(1, 0.7, -1.5, 7.0, True), (2, 0.4, 3.5, 10.0, False), (3, 0.5, None, None, False)]
    assert read() == want
    for number, part in enumerate((rows[:3], rows[3:5], rows[5:])):
        stamps.write_batch(spark.createDataFrame(part, schema), number, projections, f"{tmp_path}/run/stamps")  # a batch that runs again
        assert read() == want
    assert stamps.stamps_of(spark, f"{tmp_path}/run").where("game_id = 9").count() == 0
