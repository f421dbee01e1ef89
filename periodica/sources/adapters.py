"""The driver tables seen as performance logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import keep_one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def on_grid(units: Column) -> Column:
    """Money in 1/10000 to thousands on a 1/64 grid, so that sums are exact in any order."""
    return F.floor(units / F.lit(10000000.0) * 64 + 0.5) / F.lit(64.0)


def units(amount: Column) -> Column:
    return F.floor(amount * 10000 + 0.5).cast("bigint")


def supplier_log(spark: SparkSession, sf_dir: str, opponent: bool = False) -> DataFrame:
    """One row per supplier and month: value, counters, peer group (region), team (nation)."""
    key = ["l_suppkey", "season", "period"]
    dated = (
        table(spark, sf_dir, "lineitem")
        .selectExpr("*", "year(l_shipdate) AS season", "month(l_shipdate) AS period",
                    "l_extendedprice * (1 - l_discount) AS _net",
                    "l_returnflag = 'A' AS _a", "l_returnflag = 'N' AS _c",
                    "l_returnflag = 'R' AS _r", "l_linestatus = 'F' AS _full",
                    "l_discount < 0.02D AS _low", "floor(l_extendedprice / 100) AS _hundreds")
    )

    def total(cond: str, what: str) -> str:
        return f"sum(CASE WHEN {cond} THEN CAST({what} AS BIGINT) ELSE 0 END)"

    counters = {
        "attempts": total("_a", "l_quantity"),
        "completions": total("_a AND _full", "l_quantity"),
        "passing_yards": total("_a", "_hundreds"),
        "passing_tds": "count_if(_a AND l_quantity >= 45)",
        "interceptions": "count_if(_a AND l_quantity <= 2)",
        "sacks_taken": "count_if(_a AND l_linenumber = 7)",
        "sack_fumbles_lost": "count_if(_a AND _low)",
        "passing_air_yards": total("_a", "l_linenumber"),
        "passing_first_downs": "count_if(_a AND l_quantity >= 25)",
        "passing_2pt": "count_if(_a AND l_quantity = 50)",
        "carries": total("_c", "l_quantity"),
        "rushing_yards": total("_c", "_hundreds"),
        "rushing_tds": "count_if(_c AND l_quantity >= 45)",
        "rushing_fumbles_lost": "count_if(_c AND _low)",
        "rushing_first_downs": "count_if(_c AND l_quantity >= 25)",
        "rushing_2pt": "count_if(_c AND l_quantity = 50)",
        "targets": total("_r", "l_quantity"),
        "receptions": "count_if(_r AND _full)",
        "receiving_yards": total("_r", "_hundreds"),
        "receiving_tds": "count_if(_r AND l_quantity >= 45)",
        "receiving_fumbles_lost": "count_if(_r AND _low)",
        "receiving_air_yards": total("_r", "l_linenumber"),
        "receiving_yac": total("_r AND _full", "l_linenumber"),
        "receiving_first_downs": "count_if(_r AND l_quantity >= 25)",
        "receiving_2pt": "count_if(_r AND l_quantity = 50)",
        "special_teams_tds": "count_if(l_linenumber = 1 AND l_quantity = 50)",
    }
    log = dated.groupBy(*key).agg(
        on_grid(F.sum(units(F.col("_net")))).alias("value"),
        on_grid(F.sum(units(F.col("_net") * (1 - F.col("l_tax"))))).alias("value_base"),
        *[F.expr(text).alias(name) for name, text in counters.items()],
    )
    if opponent:
        buyers = (
            table(spark, sf_dir, "orders").join(
                table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("o_orderkey", F.col("n_name").alias("opponent"))
        )
        met = (
            dated.select("l_orderkey", *key).join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(*key, "opponent").agg(F.count("*").alias("_lines"))
        )
        log = log.join(keep_one(met, key, [F.col("_lines"), F.col("opponent")]).drop("_lines"),
                       key, "left")
    used = F.col("attempts") + F.col("carries") + F.col("targets")
    who = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("entity_name"),
                F.col("r_name").alias("grp"), F.col("n_name").alias("team"))
    )
    log = log.withColumn("target_share", F.try_divide(F.col("targets").cast("double"), used))
    return who.join(log.withColumnRenamed("l_suppkey", "entity"), "entity")


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and order month."""
    log = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("season"),
                 F.month("o_orderdate").alias("period"))
        .agg(on_grid(F.sum(units(F.col("o_totalprice")))).alias("value"),
             F.count("*").alias("orders"))
    )
    return customers(spark, sf_dir).join(log, "entity")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("entity_name"),
                F.col("c_mktsegment").alias("grp"), F.col("n_name").alias("team"),
                F.col("c_acctbal").alias("acctbal"))
    )


def customer_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and year; sparse, so lags are often missing."""
    folded = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("season"),
                 F.month("o_orderdate").alias("_month"))
        .agg(F.sum(units(F.col("o_totalprice"))).alias("_units"))
        .groupBy("entity", "season")
        .agg(on_grid(F.sum("_units")).alias("value"), F.count("*").alias("games"))
    )
    who = customers(spark, sf_dir).drop("acctbal")
    return who.join(folded.withColumn("value_base", F.col("value")), "entity")


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user, ISO week and weekday (Monday is 1)."""
    kinds = ("click", "error", "purchase", "signup", "view")
    ts = F.col("ts")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("entity"), F.weekofyear(ts).alias("season"),
                 (F.weekday(ts) + 1).cast("int").alias("period"))
        .agg(on_grid(F.sum(units(F.col("value"))) * 1000).alias("value"),
             *[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])
        .withColumn("grp", F.pmod("entity", F.lit(4)).cast("int"))
    )


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated records of a customer: priority digit, amount, date."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("record"),
        F.to_date("o_orderdate").alias("as_of_date"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"),
    )


def play_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as plays: receiver (returned lines), rusher (others), team, depth, distance."""
    who = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_name").alias("team"))
    )
    thrown = F.col("l_returnflag") == "R"
    return (
        table(spark, sf_dir, "lineitem").join(who, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.when(thrown, F.col("l_suppkey")).alias("receiver_id"),
            F.when(~thrown, F.col("l_suppkey")).alias("rusher_id"),
            F.year("l_shipdate").alias("season"), "team",
            F.col("l_quantity").alias("air_yards"),
            F.floor(F.col("l_discount") * 1000 + 0.5).alias("yardline_100"),
            F.floor(F.col("l_tax") * 64).alias("pass_oe"),
        )
    )
