"""Views and requests made from the sample tables, in Spark and in the same words for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of parts and nations; ts is the time before it is cut to the second, for filters that reach the scan."""
    events = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    is_part = F.col("event_id") % 2 == 0
    return events.select(
        F.col("event_id").alias("id"), F.when(is_part, "part").otherwise("nation").alias("viewable_type"),
        F.when(is_part, k).otherwise(k % 30).alias("viewable_id"), F.col("user_id").cast("string").alias("visitor"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("collection"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("viewed_at"), "ts",
    )


EVENT_VIEWS = """
    SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'part' ELSE 'nation' END AS viewable_type,
           CASE WHEN event_id % 2 = 0 THEN k ELSE k % 30 END AS viewable_id, CAST(user_id AS VARCHAR) AS visitor,
           NULLIF(event_type, 'view') AS collection, date_trunc('second', ts) AS viewed_at
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""


def line_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as views of parts by orders."""
    return load(spark, sf_dir, "lineitem").select(
        F.lit("part").alias("viewable_type"), F.col("l_partkey").alias("viewable_id"), F.col("l_orderkey").cast("string").alias("visitor"),
        F.col("l_returnflag").alias("collection"), F.col("l_shipdate").cast("timestamp_ntz").alias("viewed_at"),
    )


LINE_VIEWS = """
    SELECT 'part' AS viewable_type, l_partkey AS viewable_id, CAST(l_orderkey AS VARCHAR) AS visitor,
           l_returnflag AS collection, l_shipdate AS viewed_at
    FROM lineitem"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by session (the user), some by crawlers, some not to be tracked, each with a cooldown of three days."""
    views, user = event_views(spark, sf_dir), F.col("visitor").cast("long")
    return views.select(
        F.col("id").alias("event_id"), "ts", F.col("visitor").alias("session_id"), "visitor", F.concat(F.lit("10.0.0."), (user % 20).cast("string")).alias("ip"),
        (user % 7 == 0).alias("dnt"), F.when(F.col("id") % 11 == 0, "ExampleBot/1.0").otherwise("Mozilla/5.0").alias("user_agent"), "viewable_type",
        F.when(F.col("id") % 97 != 0, F.col("viewable_id")).alias("viewable_id"), "collection", F.lit(4320).alias("cooldown_minutes"),
    )


REQUESTS = f"""
    SELECT v.id AS event_id, e.ts, visitor AS session_id, visitor, '10.0.0.' || (CAST(visitor AS BIGINT) % 20) AS ip,
           CAST(visitor AS BIGINT) % 7 = 0 AS dnt, CASE WHEN v.id % 11 = 0 THEN 'ExampleBot/1.0' ELSE 'Mozilla/5.0' END AS user_agent,
           viewable_type, CASE WHEN v.id % 97 <> 0 THEN viewable_id END AS viewable_id, collection, 4320 AS cooldown_minutes
    FROM ({EVENT_VIEWS}) v JOIN events e ON e.event_id = v.id"""
