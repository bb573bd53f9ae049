"""Sources: play logs, pruned to what a caller names, and the binding of the order tables to the contest model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a play log and their types; a file may lack any of them.
PLAY_TYPES = {
    "season": "int", "week": "int", "game_id": "bigint", "game_play_number": "int", "home": "string", "away": "string",
    "pos_team": "string", "def_pos_team": "string", "home_div": "string", "away_div": "string", "neutral_site": "boolean",
    "season_type": "string", "play_type": "string", "pos_unit": "string", "epa": "double", "period": "int", "rush": "int",
    "pass": "int", "turnover": "int", "penalty_no_play": "int", "pos_score": "double", "def_score": "double",
}


#: Rows up to which the table of nations, and the nations of suppliers, are sent to all tasks.
SMALL, SUPPLIERS = 10_000, 1_000_000


def scan(spark: SparkSession, path: str, columns: Sequence[str], types: dict[str, str] = PLAY_TYPES) -> DataFrame:
    """The named columns of a Parquet log; those that the files lack are nulls of their type."""
    df = spark.read.parquet(path)
    have = set(df.columns)
    return df.select(*[(F.col(c).try_cast(types[c]) if c in have else F.lit(None).cast(types[c])).alias(c) for c in columns])


def top_division_plays(plays: DataFrame) -> DataFrame:
    """Plays with both sides known of which at least one is in a rated division."""
    rated = F.col("home_div").isin("fbs", "fcs") | F.col("away_div").isin("fbs", "fcs")
    out = plays.where(rated & F.col("pos_team").isNotNull() & F.col("def_pos_team").isNotNull())
    if "neutral_site" in plays.columns:
        out = out.withColumn("neutral_site", F.coalesce("neutral_site", F.lit(False)))
    return out


def seasons(root_frames: Sequence[DataFrame]) -> DataFrame:
    """Seasons in one table; a column that some lack is null there."""
    out = root_frames[0]
    for df in root_frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def documents(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """JSON arrays kept as ``dataset=/season=`` folders; placeholder objects have nulls everywhere and go."""
    df = spark.read.schema(schema).option("multiLine", True).json(root)
    return df.dropna(how="all", subset=schema.fieldNames())


def publish(df: DataFrame, path: str, by: Sequence[str] = ("season",)) -> None:
    """Write as JSON by season, without columns that start with an underscore."""
    df.select(*[c for c in df.columns if not c.startswith("_")]).write.mode("overwrite").partitionBy(*by).json(path)


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("r_name").alias("conf"),
        F.when(F.col("n_regionkey") < 4, "fbs").otherwise("fcs").alias("div"),
    )


def numbered_plays(spark: SparkSession, sf_dir: str, by_season: bool = False) -> DataFrame:
    """Line items as plays between the supplier's and the customer's nation, which go by their numbers.

    A contest is a month's dealings of two nations. Line items shuffle twice, to their orders and to their contests, by the
    same joins at any size, so what moves grows with the input. Only columns that can't be derived again move.
    ``by_season``: rows come in the order in which they are written in folders by season.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    supplier = read("supplier").select("s_suppkey", F.col("s_nationkey").alias("pos_k"))
    supplier = F.broadcast(supplier) if supplier.count() <= SUPPLIERS else supplier.hint("merge")
    customer = read("customer").select("c_custkey", F.col("c_nationkey").alias("def_k"), F.col("c_name").alias("player"))
    orders = read("orders").select("o_orderkey", "o_custkey", (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("month"))
    orders = orders.join(customer.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    items = read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.round(F.col("l_discount") * 100).cast("int") * 10 - 50).alias("epa"), (F.col("l_returnflag") == "R").alias("special"),
        (F.col("l_linestatus") == "O").alias("rush"), (F.col("l_linestatus") == "F").alias("pass"), (F.col("l_tax") >= 0.08).alias("turnover"),
        F.col("l_quantity").cast("int").alias("yards"), F.unix_timestamp("l_shipdate").alias("wall"), (F.round(F.col("l_tax") * 100).cast("int") * 10).alias("fg_chance"),
    )
    df = (
        items.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .where(F.col("pos_k") != F.col("def_k"))
    )
    lo, hi = F.least("pos_k", "def_k"), F.greatest("pos_k", "def_k")
    df = df.withColumn("game_id", F.col("month").cast("bigint") * 10_000 + lo * 100 + hi).drop("month", "o_orderkey", "s_suppkey")
    df = df.repartition("game_id")  # what follows is derived after this shuffle, what a window adds up too
    # Spark sorts by one number without comparing rows, and rows nearly in order fast by all keys. So the window's own sort, which counts, hardly compares more rows a play in longer contests.
    df = df.sortWithinPartitions(F.shiftleft("game_id", 32).bitwiseOR(F.least("l_orderkey", F.lit((1 << 32) - 1))))
    month = ((F.col("game_id") - lo * 100 - hi) / 10_000).cast("int")
    df = df.withColumns({"season": (month / 100).cast("int"), "slate": month % 100, "points": F.when(F.col("yards") >= 40, 7).when(F.col("yards") >= 30, 3).otherwise(0)})
    home = F.when((F.col("pos_k") + F.col("def_k") + F.col("slate")) % 2 == 0, lo).otherwise(hi)
    # A contest's number tells its season. As the first key it saves the writer a sort, but plays that none writes are sorted faster without it: few seasons tell few rows apart.
    order = Window.partitionBy(*(["season"] if by_season else []), "game_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    score = lambda mine: F.sum(F.when(mine, F.col("points")).otherwise(0)).over(upto)
    df = df.withColumns({
        "game_play_number": F.row_number().over(order), "period": F.ntile(4).over(order),
        "home_score": score(F.col("pos_k") == home), "away_score": score(F.col("pos_k") != home),
    })
    margin = F.when(F.col("pos_k") == home, F.col("home_score") - F.col("away_score")).otherwise(F.col("away_score") - F.col("home_score"))
    return df.withColumns({
        "home_k": home, "away_k": lo + hi - home, "pos_unit": F.when(F.col("special"), "Special").otherwise("Offense"), "clock": (F.col("l_partkey") % 900).cast("int"), "pos_margin": margin,
    }).drop("special", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def named(df: DataFrame, sf_dir: str) -> DataFrame:
    """Names, conferences and divisions for the numbers of nations."""
    nation = _nations(df.sparkSession, sf_dir)
    small = nation.count() <= SMALL  # 25 nations; a larger table meets by shuffles
    for side in ("pos", "def", "home", "away"):
        names = nation.select(F.col("k").alias(f"{side}_nk"), F.col("name").alias(side), F.col("conf").alias(f"{side}_conf"), F.col("div").alias(f"{side}_div"))
        df = df.join(F.broadcast(names) if small else names.hint("merge"), F.col(f"{side}_k") == F.col(f"{side}_nk"))
    return df.drop("pos_nk", "def_nk", "home_nk", "away_nk")


def contest_plays(spark: SparkSession, sf_dir: str, by_season: bool = False) -> DataFrame:
    """Numbered plays with the names of their nations."""
    return named(numbered_plays(spark, sf_dir, by_season), sf_dir)
