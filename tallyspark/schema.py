"""The fact table of views, and the raw requests that it is fed from."""

from pyspark.sql import types as T

VIEWS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("viewable_type", T.StringType(), False),
        T.StructField("viewable_id", T.LongType(), False),
        T.StructField("visitor", T.StringType()),
        T.StructField("collection", T.StringType()),
        T.StructField("viewed_at", T.TimestampNTZType(), False),
    ]
)

REQUESTS = T.StructType(
    [
        T.StructField("event_id", T.LongType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("session_id", T.StringType()),
        T.StructField("visitor", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("dnt", T.BooleanType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("viewable_type", T.StringType(), False),
        T.StructField("viewable_id", T.LongType()),
        T.StructField("collection", T.StringType()),
        T.StructField("cooldown_minutes", T.IntegerType()),
    ]
)


def ddl(table: str) -> str:
    """CREATE TABLE for the views, partitioned by type."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" + " NOT NULL" * (not f.nullable) for f in VIEWS.fields)
    return f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY (viewable_type)"
