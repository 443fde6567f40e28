"""Three event logs derived from the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed import spread_join
from ..schema import LogSchema

ORDERS = LogSchema(
    "orders", "case_id", "activity", "ts", "resource", "label",
    dynamic_cat=("activity", "resource"), dynamic_num=("totalprice",),
    static_cat=("segment", "nation"), static_num=("acctbal",), tiebreak=("event_id",),
)
SESSIONS = LogSchema(
    "sessions", "case_id", "activity", "ts", "resource", "label",
    dynamic_cat=("activity", "resource"), dynamic_num=("value",),
    static_cat=("segment",), static_num=("acctbal",), tiebreak=("event_id",), prefix_cap=20,
)
LINES = LogSchema(
    "lines", "case_id", "activity", "ts", "activity", "label",
    dynamic_cat=("activity",), dynamic_num=("quantity", "extendedprice", "discount"),
    static_cat=("priority",), static_num=("totalprice",),
    tiebreak=("linenumber", "partkey", "suppkey", "extendedprice"), prefix_fixed=10,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders_log(spark: SparkSession, folder: str, gaps: bool = False) -> DataFrame:
    """Customer order histories; with ``gaps`` every seventh price is null."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")) if gaps else F.col("o_totalprice")
    last = orders.groupBy("o_custkey").agg(
        F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("_last")
    )
    facts = (
        last.join(customer, last.o_custkey == customer.c_custkey, "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            "o_custkey",
            F.when(F.col("_last") == "F", "deviant").otherwise("regular").alias("label"),
            F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"),
            F.col("c_acctbal").alias("acctbal"),
        )
    )
    rows = orders.where(F.col("o_custkey").isNotNull()).select(
        "o_custkey", F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("activity"),
        F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("resource"), price.alias("totalprice"),
    )
    joined = spread_join(rows, facts, "o_custkey")
    return joined.select(
        F.col("o_custkey").cast("string").alias("case_id"), "event_id", "activity", "ts", "resource",
        "totalprice", "segment", "nation", "acctbal", "label",
    )


def sessions_log(spark: SparkSession, folder: str, gaps: bool = False) -> DataFrame:
    """Weekly user sessions; with ``gaps`` some values and resources are null."""
    events = table(spark, folder, "events")
    customer = table(spark, folder, "customer")
    week = F.floor(F.expr("timestampdiff(SECOND, timestamp'2024-01-01', ts)") / (7 * 86400))
    resource = F.concat(F.lit("r"), (F.get_json_object("props", "$.k").cast("int") % 10).cast("string"))
    value = F.col("value")
    if gaps:
        resource = F.when(F.col("event_id") % 11 != 0, resource)
        value = F.when(F.col("event_id") % 7 != 0, value)
    rows = events.select(
        F.concat_ws("_", F.col("user_id").cast("string"), week.cast("string")).alias("case_id"), "user_id",
        "event_id", F.col("event_type").alias("activity"), "ts", resource.alias("resource"), value.alias("value"),
    )
    facts = (
        rows.groupBy("case_id").agg(
            F.first("user_id").alias("user_id"),
            F.when(F.count_if(F.col("activity") == "purchase") > F.count_if(F.col("activity") == "error"), "deviant")
            .otherwise("regular").alias("label"),
        )
        .join(customer, F.col("user_id") == F.col("c_custkey"), "left")
        .select("case_id", "label", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal"))
    )
    return spread_join(rows.drop("user_id"), facts, "case_id")


def lines_log(spark: SparkSession, folder: str) -> DataFrame:
    """Order line histories, the largest log."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    facts = orders.select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("totalprice"),
        F.when(F.col("o_orderstatus") == "F", "deviant").otherwise("regular").alias("label"),
    )
    rows = lines.where(F.col("l_orderkey").isNotNull()).select(
        "l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("activity"), F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"), F.col("l_linenumber").alias("linenumber"),
        F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"),
    )
    joined = spread_join(rows, facts, "l_orderkey")
    return joined.withColumn("case_id", F.col("l_orderkey").cast("string")).drop("l_orderkey")
