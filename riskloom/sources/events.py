"""The event tables seen as payment transactions with their context.

``events`` is the transaction stream; suppliers are merchants, customers are account holders and
their nations are home countries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.history import home_country, known_cards
from riskloom.sources.tables import read_table

BLACKLIST_BALANCE = 1000
KNOWN_CARDS_UNTIL = "2024-01-16 00:00:00"

# Event type -> merchant category.
CATEGORY_OF_TYPE = {
    "purchase": "retail",
    "click": "electronics",
    "view": "travel",
    "signup": "gambling",
    "error": "cryptocurrency",
}
FRAUD_TYPE = "error"

SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "labels": "doc_id long, quality int, toxic int",
}


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name, SCHEMAS[name])


def from_events(events: DataFrame) -> DataFrame:
    """The columns that an event row alone determines; works on streams as well."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    category = F.create_map(*[F.lit(x) for pair in CATEGORY_OF_TYPE.items() for x in pair])
    return events.select(
        F.col("event_id").alias("transaction_id"),
        "user_id",
        F.round(F.col("value") * 250, 2).cast("decimal(12,2)").alias("amount"),
        F.lit("USD").alias("currency"),
        category[F.col("event_type")].alias("merchant_category"),
        F.lpad((k % 30).cast("string"), 4, "0").alias("card_last4"),
        "ts",
        k.alias("k"),
        F.when(F.col("event_type") == FRAUD_TYPE, 1).otherwise(0).alias("is_fraud"),
    )


def merchants(spark: SparkSession, folder: str) -> DataFrame:
    """All suppliers by key."""
    return scan(spark, folder, "supplier").select(F.col("s_suppkey").alias("merchant_id"), F.col("s_name").alias("merchant_name"))


def nations(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "nation").select(
        F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("home_country")
    )


def home_countries(spark: SparkSession, folder: str) -> DataFrame:
    users = scan(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("nation_id")
    )
    return home_country(users, nations(spark, folder))


def blacklist(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = scan(spark, folder, "supplier").filter(F.col("s_acctbal") < BLACKLIST_BALANCE)
    return suppliers.select(F.col("s_name").alias("merchant_name"))


def add_merchant_and_country(rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Merchant name and transaction country; Spark broadcasts the lookup tables by their size."""
    abroad = nations(spark, folder).withColumnsRenamed({"nation_id": "__nation", "home_country": "__abroad"})
    keys = scan(spark, folder, "supplier").agg(F.max("s_suppkey") + 1).scalar()
    return (
        rows.withColumn("merchant_id", F.pmod("transaction_id", keys))
        .join(merchants(spark, folder), "merchant_id", "left")
        .join(home_countries(spark, folder), "user_id", "left")
        .join(abroad, F.col("k") % 25 == F.col("__nation"), "left")
        .withColumn("country", F.when(F.col("k") < 80, F.col("home_country")).otherwise(F.col("__abroad")))
        .drop("merchant_id", "home_country", "__nation", "__abroad")
    )


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """All events as transactions, with a proxy label ``is_fraud``."""
    rows = from_events(scan(spark, folder, "events"))
    return add_merchant_and_country(rows, spark, folder).withColumn("created_at", F.col("ts"))


def cards_before(rows: DataFrame, until: str = KNOWN_CARDS_UNTIL) -> DataFrame:
    return known_cards(rows.filter(F.col("ts") < F.lit(until).cast("timestamp_ntz")))
