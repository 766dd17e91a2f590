"""Which requests become views. Gates without state come first, as one filter; the cooldown sees only what they let by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.config import EngineConfig
from tallyspark.errors import ViewRecordError
from tallyspark.functions.visitor import CrawlerTest, do_not_track, is_crawler, visitor_id
from tallyspark.operators import cooldown

#: More denied addresses than this are looked up by a join instead of a list in the filter.
LISTED_ADDRESSES = 1000


def reject_types(requests: DataFrame) -> DataFrame:
    """Requests that name an entity; those for a whole type can't be recorded."""
    return requests.where(F.col("viewable_id").isNotNull())


def require_entity(viewable_id: object) -> None:
    if viewable_id is None:
        raise ViewRecordError("a view belongs to one entity: name its id, not its type alone")


def without_crawlers(requests: DataFrame, crawler: CrawlerTest = is_crawler) -> DataFrame:
    return requests.where(~crawler(F.col("user_agent")))


def honoring_dnt(requests: DataFrame) -> DataFrame:
    """Requests that don't ask not to be tracked; column dnt is a boolean or the header as it was sent."""
    asks = F.coalesce("dnt", F.lit(False)) if isinstance(requests.schema["dnt"].dataType, T.BooleanType) else do_not_track(F.col("dnt").cast("string"))
    return requests.where(~asks)


def without_addresses(requests: DataFrame, denied: Sequence[str] | DataFrame) -> DataFrame:
    """Requests from other addresses than these, compared as whole texts; a null address passes."""
    if isinstance(denied, DataFrame):
        return requests.join(denied.select(F.col(denied.columns[0]).alias("ip")), "ip", "left_anti").select(*requests.columns)
    if not denied:
        return requests
    if len(denied) > LISTED_ADDRESSES:
        return without_addresses(requests, requests.sparkSession.createDataFrame([(x,) for x in denied], "ip string"))
    return requests.where(F.col("ip").isNull() | ~F.col("ip").isin(list(denied)))


def stateless(requests: DataFrame, config: EngineConfig = EngineConfig(), *, crawler: CrawlerTest = is_crawler) -> DataFrame:
    """Requests that name an entity and pass the crawler, do-not-track and address gates, in this order."""
    found = reject_types(requests)
    if config.ignore_bots:
        found = without_crawlers(found, crawler)
    if config.honor_dnt:
        found = honoring_dnt(found)
    return without_addresses(found, config.ignored_ip_addresses)


def accepted(requests: DataFrame, config: EngineConfig = EngineConfig(), *, crawler: CrawlerTest = is_crawler, mode: str = "per_item") -> DataFrame:
    """Requests that become views: those that pass stateless() and then the cooldown."""
    return cooldown.throttle(stateless(requests, config, crawler=crawler), mode=mode)


def visitor_of(requests: DataFrame):
    """A visitor id for every request: its own, else one for its session, else one for the request alone."""
    session = F.col("session_id").isNotNull()
    return visitor_id(F.col("visitor"), F.when(session, F.col("session_id")), F.when(~session, F.col("event_id")))


def to_views(requests: DataFrame) -> DataFrame:
    """Rows of the views table for accepted requests; times are cut to the second, and every view has a visitor."""
    second = F.date_trunc("second", F.coalesce("ts", F.localtimestamp())).cast("timestamp_ntz")
    return requests.select(F.col("event_id").alias("id"), "viewable_type", "viewable_id", visitor_of(requests).alias("visitor"), "collection", second.alias("viewed_at"))
