"""Sources and bindings on literal inputs."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.operators import match as M
from fieldbook.operators import people as P
from fieldbook.sources import contests as C
from fieldbook.sources import markets as K
from fieldbook.sources import pages as G
from fieldbook.sources import store as T1


def test_scan_adds_missing_columns(spark, tmp_path):
    spark.createDataFrame([(1, "x", "fbs", None), (None, "y", "other", True)], "game_id long, pos_team string, home_div string, neutral_site boolean").write.parquet(f"{tmp_path}/p")
    df = C.scan(spark, f"{tmp_path}/p", ["game_id", "pos_team", "def_pos_team", "home_div", "away_div", "neutral_site", "epa"])
    assert df.dtypes[-1] == ("epa", "double") and df.where("epa is null").count() == 2
    assert C.top_division_plays(df.withColumn("def_pos_team", F.lit("z"))).select("game_id", "neutral_site").collect() == [(1, False)]


def test_build_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for rebuild, n in ((False, 1), (False, 1), (True, 2)):
        assert T1.build_once(spark, f"{tmp_path}/t", make, rebuild=rebuild).count() == 3 and len(made) == n


def test_changed_sources_change_the_answer(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.range(3).write.parquet(f"{source}/a.parquet")
    make = lambda: spark.read.parquet(f"{source}/a.parquet")
    read = lambda: (T1.stored(spark, source, "t", make).count(), T1.build_once(spark, f"{tmp_path}/out", make, source).count())
    assert read() == (3, 3)
    first = T1.fingerprint(spark, source)
    assert read() == (3, 3) and T1.fingerprint(spark, source) == first and T1.manifest(spark, f"{tmp_path}/out")["fingerprint"] == first
    spark.range(5).write.mode("overwrite").parquet(f"{source}/a.parquet")
    assert read() == (5, 5) and T1.fingerprint(spark, source) != first
    spark.range(1).write.parquet(f"{source}/b.parquet/part=1")  # a file more, three levels down
    assert T1.manifest(spark, f"{tmp_path}/out")["fingerprint"] != T1.fingerprint(spark, source)
    (tmp_path / "out" / "_manifest.json").write_text("{")
    assert T1.manifest(spark, f"{tmp_path}/out") == {} and read() == (5, 5)
    (tmp_path / "out" / "_SUCCESS").unlink()  # a run that died
    assert read() == (5, 5) and (tmp_path / "out" / "_SUCCESS").exists()


def test_documents_and_publish(spark, tmp_path):
    for season, text in ((2020, '[{"name": "a", "stars": 3}]'), (2021, '{"empty": true}')):
        d = tmp_path / "in" / f"season={season}"
        d.mkdir(parents=True)
        (d / "x.json").write_text(text)
    df = C.documents(spark, f"{tmp_path}/in", T.StructType([T.StructField("name", T.StringType()), T.StructField("stars", T.IntegerType())]))
    assert [tuple(r) for r in df.collect()] == [("a", 3, 2020)]
    C.publish(df.withColumn("_x", F.lit(1)), f"{tmp_path}/out")
    assert set(spark.read.json(f"{tmp_path}/out").columns) == {"name", "stars", "season"}


def test_page_rows(spark):
    html = "<ul class='a'><li>one</li><li> <b>two</b></li></ul><table><tr><th>h</th></tr><tr><td>1</td><td>2</td></tr></table><ul></ul>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert [tuple(r) for r in G.page_rows(df).orderBy("block", "row").collect()] == [(1, 0, 0, ["one", "two"]), (1, 1, 0, ["h"]), (1, 1, 1, ["1", "2"])]


def test_slate_rows(spark):
    good, bad = G.slate_rows(spark.createDataFrame([("# c",), ('1,"Miami, OH",Ohio,-3.5',), ("nonsense",), ("2,a,b,",)], "value string"))
    assert sorted(map(tuple, good.collect())) == [(1, "Miami, OH", "Ohio", -3.5), (2, "a", "b", None)] and [r.value for r in bad.collect()] == ["nonsense"]


def test_markets(spark):
    ms = "array<struct<kind:string,outcomes:string,prices:string,line:double>>"
    row = ("Texas vs. Ohio State: Spread", "s1", [("moneyline", '["a","b"]', '["0.6","0.4"]', None), ("spreads", "[]", "[]", -3.5)])
    r = K.parse_events(spark.createDataFrame([row, row], f"title string, slug string, markets {ms}")).collect()
    assert [tuple(x) for x in r] == [("s1", "Texas", "Ohio State", 0.6, 0.4, -3.5)]
    m = spark.createDataFrame([("e", "A wins by over 3.5 points", 0.4, 0.5, None), ("e", "A wins by over 7.5 points", 0.1, 0.2, None), ("e", "other", 0.5, 0.5, None)], "event string, title string, bid double, ask double, last double")
    assert tuple(K.exchange_spreads(m).first())[:2] == ("e", 3.5)
    lines = spark.createDataFrame([(1, "x", 3.0), (1, "b", 4.0), (2, "x", 1.0), (2, "b", None)], "game_id long, provider string, spread double")
    assert sorted(map(tuple, K.preferred_line(lines, ["b", "c"]).collect())) == [(1, 4.0), (2, 1.0)]


def test_tiered_match(spark):
    people = spark.createDataFrame([(1, "Joe Smith Jr.", "Ohio State"), (2, "Al Jones", "Rice"), (3, "No One", "Rice")], "pid long, name string, college string")
    rec = spark.createDataFrame([(10, 2019, "Joe Smith", "Texas"), (11, 2018, "Joe Smith", "Ohio"), (12, 2020, "Albert Jones", "Rice University")], "rid long, year int, rname string, rcollege string")
    assert {(r.pid, r.rid, r.tier) for r in M.tiered(people, rec).collect()} == {(1, 11, 0), (2, 12, 2)}


def test_dossiers(spark):
    f = lambda rows, s: spark.createDataFrame(rows, s)
    stats = M.nested_stats(f([("Joe Smith", "Ohio", "rush", "yds", "10"), ("Joe Smith", "Ohio", "rush", "avg", "x")], "player string, team string, bucket string, field string, value string"))
    out = P.dossiers(f([("Joe Smith", "Ohio State", 7), ("B", "Rice", 1)], "name string, team string, jersey int"), f([("Joe Smith Jr.", "Ohio", 0.5)], "name string, team string, usage double"), stats,
                     f([("Joe Smith", 2019, 3), ("Joe Smith", 2018, 4)], "name string, year int, stars int"), f([("Joe Smith", 2021, "a", "b")], "name string, season int, origin string, destination string"))
    r = {x.name: x for x in out.collect()}
    assert r["Joe Smith"].usage == 0.5 and r["Joe Smith"].stats == {"rush": {"yds": 10.0}} and [x.year for x in r["Joe Smith"].recruits] == [2018, 2019] and r["B"].moves is None


def test_payroll(spark):
    p = spark.createDataFrame([("a", "top", 5.0e6), ("a", "top", 9.0e6), ("b", "low", 1000.0)], "team string, tier string, amount double")
    assert {(r.team, r.amount, r.quality) for r in P.payroll_estimate(p, {"top": 8_000_000, "low": 0}).collect()} == {("a", 8_000_000, "fair"), ("b", 0, "thin")}


def test_resolve(spark):
    raw, known = spark.createDataFrame([("UMass",), ("Rice",), ("rice!",), ("Nowhere",)], "raw string"), spark.createDataFrame([("Massachusetts",), ("Rice",)], "name string")
    got = {r.raw: (r.name, r.tier) for r in M.resolve_names(raw, known, spark.createDataFrame([("umass", "Massachusetts")], "alias string, name string")).collect()}
    assert got == {"UMass": ("Massachusetts", 1), "Rice": ("Rice", 0), "rice!": ("Rice", 2)}
