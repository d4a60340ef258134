"""Adapters from the driver tables to the shapes the operators expect.

sessions  (session_id, item_id, date)
purchases (session_id, item_id, date)
features  (item_id, feature_category_id, feature_value_id)

Each adapter is a projection over one scan (or one join), so Catalyst pushes
the filters and prunes the columns down to the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlens.sources.tables import table

EMBEDDING_CATEGORIES = list(range(1, 65))
PART_CATEGORIES = list(range(1, 74))

# Fixed values of the part adapter: part type -> category id.
PART_TYPE_CATEGORY = {"ECONOMY": 26, "LARGE": 27, "MEDIUM": 28, "PROMO": 29, "SMALL": 30}
PART_TYPE_OTHER = 31
PART_SIZE_BASE, PART_SIZE_MOD = 32, 42


def _item_of_event() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks, one session per user."""
    ev = table(spark, sf_dir, "events")
    return (ev.where(F.col("event_type").isin("view", "click"))
              .select(F.col("user_id").alias("session_id"),
                      _item_of_event().alias("item_id"),
                      F.col("ts").alias("date")))


def event_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase event, keyed like ``event_sessions``."""
    ev = table(spark, sf_dir, "events")
    return (ev.where(F.col("event_type") == "purchase")
              .select(F.col("user_id").alias("session_id"),
                      _item_of_event().alias("item_id"),
                      F.col("ts").alias("date"),
                      "event_id"))


def last_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target per session: the latest purchase (ties by event id).

    ``row_number() <= 1`` is planned as a WindowGroupLimit, so each map task
    keeps one row per session before the shuffle."""
    w = Window.partitionBy("session_id").orderBy(F.col("date").desc(), F.col("event_id").desc())
    return (event_purchases(spark, sf_dir)
            .withColumn("_r", F.row_number().over(w))
            .where("_r = 1").select("session_id", "item_id"))


def order_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per order; ties in date are broken by line and supplier."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("session_id"),
                     F.col("l_partkey").alias("item_id"),
                     F.col("l_shipdate").alias("date"),
                     "l_linenumber", "l_suppkey")


def customer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per customer: the lines of all their orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_shipdate", "l_linenumber", "l_suppkey")
    return (o.join(li, o.o_orderkey == li.l_orderkey)
             .select(F.col("o_custkey").alias("session_id"),
                     F.col("l_partkey").alias("item_id"),
                     F.col("l_shipdate").alias("date"),
                     "l_orderkey", "l_linenumber", "l_suppkey"))


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 categories from the sign of each embedding coordinate; a coordinate
    above 0.1 adds a second row for the same category, so (item, category)
    repeats on purpose (the raw table that cleaning deduplicates)."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    values = F.array_compact(F.array(
        F.when(F.col("x") > 0, F.lit(1)),
        F.when(F.col("x") > F.lit(0.1).cast("float"), F.lit(2))))
    return (emb.where(F.col("x") > 0)
               .select(F.col("vec_id").alias("item_id"),
                       (F.col("pos") + 1).alias("feature_category_id"),
                       F.explode(values).alias("feature_value_id")))


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly 73 categories, three per part: brand, type, size band."""
    part = table(spark, sf_dir, "part")
    type_cat = F.lit(PART_TYPE_OTHER)
    for name, cat in reversed(list(PART_TYPE_CATEGORY.items())):
        type_cat = F.when(F.col("p_type") == name, F.lit(cat)).otherwise(type_cat)
    cats = F.array(F.substring("p_brand", 7, 1 << 20).cast("int"), type_cat,
                   F.lit(PART_SIZE_BASE) + F.col("p_size") % PART_SIZE_MOD)
    return part.select(F.col("p_partkey").alias("item_id"),
                       F.explode(cats).alias("feature_category_id"),
                       F.lit(1).alias("feature_value_id"))
