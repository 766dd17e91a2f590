"""Counts of views: in total, per entity, ranked, and kept in a summary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.period import Period
from tallyspark.operators import scopes


@dataclass(frozen=True)
class CountSpec:
    """One count column of an entity."""

    name: str
    period: Period | None = None
    collection: str | None = None
    unique: bool = False

    def aggregate(self, time_col: str) -> Column:
        given = scopes.matching(self.period, self.collection, time_col)
        what = F.col("visitor") if self.unique else F.lit(1)
        counted = what if given is None else F.when(given, what)
        return (F.count_distinct(counted) if self.unique else F.count(counted)).alias(self.name)


def count_views(
    views: DataFrame, viewable_type: str, viewable_id: int | None = None, *, period: Period | None = None, collection: str | None = None,
    unique: bool = False, name: str = "views_count", time_col: str = "viewed_at",
) -> DataFrame:
    """One row with the count, of an entity or (without an id) of its whole type. Null visitors aren't unique visitors."""
    own = scopes.of_type(views, viewable_type) if viewable_id is None else scopes.of_entity(views, viewable_type, viewable_id)
    own = scopes.maybe_in_collection(scopes.within_period(own, period, time_col), collection)
    return own.agg((F.count_distinct("visitor") if unique else F.count(F.lit(1))).alias(name))


def with_counts(entities: DataFrame, key: str, viewable_type: str, views: DataFrame, specs: Sequence[CountSpec], time_col: str = "viewed_at") -> DataFrame:
    """entities with a column per spec, 0 where there are no such views; all columns come from one pass over the views.

    A condition that all specs share is filtered on ahead of the aggregation.
    """
    own = scopes.of_type(views, viewable_type)
    if len({(s.period, s.collection) for s in specs}) == 1:
        own = scopes.maybe_in_collection(scopes.within_period(own, specs[0].period, time_col), specs[0].collection)
        specs = [CountSpec(s.name, unique=s.unique) for s in specs]
    counted = own.groupBy(F.col("viewable_id").alias("__key")).agg(*[s.aggregate(time_col) for s in specs])
    joined = entities.drop(*[s.name for s in specs]).join(counted, F.col(key) == F.col("__key"), "left").drop("__key")
    return joined.withColumns({s.name: F.coalesce(s.name, F.lit(0)).cast("long") for s in specs})


def with_views_count(
    entities: DataFrame, key: str, viewable_type: str, views: DataFrame, *, period: Period | None = None, collection: str | None = None,
    unique: bool = False, name: str | None = None, time_col: str = "viewed_at",
) -> DataFrame:
    name = name or ("unique_views_count" if unique else "views_count")
    return with_counts(entities, key, viewable_type, views, [CountSpec(name, period, collection, unique)], time_col)


def order_by_views(entities: DataFrame, key: str, viewable_type: str, views: DataFrame, direction: str = "desc", *, unique: bool = False, name: str | None = None, limit: int | None = None, **count) -> DataFrame:
    """entities with their count, in its order, ties by ascending key; with a limit only the first so many."""
    if direction.lower() not in ("asc", "desc"):
        raise ValueError(f"direction must be asc or desc, not {direction}")
    name = name or ("unique_views_count" if unique else "views_count")
    counted = with_views_count(entities, key, viewable_type, views, unique=unique, name=name, **count)
    ordered = counted.orderBy(F.col(name).asc() if direction.lower() == "asc" else F.col(name).desc(), F.col(key).asc())
    return ordered if limit is None else ordered.limit(limit)


def order_by_unique_views(entities: DataFrame, key: str, viewable_type: str, views: DataFrame, direction: str = "desc", **count) -> DataFrame:
    return order_by_views(entities, key, viewable_type, views, direction, unique=True, **count)


def summarise(views: DataFrame) -> DataFrame:
    """Views and unique visitors of every entity: a table to be kept and refreshed beside the views."""
    return views.groupBy("viewable_type", "viewable_id").agg(F.count(F.lit(1)).alias("views_count"), F.count_distinct("visitor").alias("unique_views_count"))


def count_from_summary(summary: DataFrame, viewable_type: str, viewable_id: int, unique: bool = False) -> DataFrame:
    """The same row as count_views without filters, read from the summary."""
    column = "unique_views_count" if unique else "views_count"
    own = scopes.of_entity(summary, viewable_type, viewable_id)
    return own.agg(F.coalesce(F.sum(column), F.lit(0)).cast("long").alias("views_count"))
