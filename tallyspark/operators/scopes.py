"""Filters over views; all keep to columns of the scan, so they are pushed down to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.period import Period


def of_type(views: DataFrame, viewable_type: str) -> DataFrame:
    return views.where(F.col("viewable_type") == viewable_type)


def of_entity(views: DataFrame, viewable_type: str, viewable_id: int) -> DataFrame:
    return views.where((F.col("viewable_type") == viewable_type) & (F.col("viewable_id") == viewable_id))


def within_period(views: DataFrame, period: Period | None, time_col: str = "viewed_at") -> DataFrame:
    """Views in the period; all of them without one. time_col may be finer than seconds: it counts as cut to them."""
    inside = period.contains(F.col(time_col)) if period is not None else None
    return views if inside is None else views.where(inside)


def in_collection(views: DataFrame, collection: str | None) -> DataFrame:
    """Views of exactly this collection; None means those without one."""
    return views.where(F.col("collection").eqNullSafe(F.lit(collection)))


def counts_as_given(collection: str | None) -> bool:
    """An absent, empty or "0" collection doesn't restrict counts."""
    return collection not in (None, "", "0")


def maybe_in_collection(views: DataFrame, collection: str | None) -> DataFrame:
    return in_collection(views, collection) if counts_as_given(collection) else views


def matching(period: Period | None = None, collection: str | None = None, time_col: str = "viewed_at") -> Column | None:
    """The condition of a count, for conditional aggregates; None if there is none."""
    found = period.contains(F.col(time_col)) if period is not None else None
    if counts_as_given(collection):
        own = F.col("collection") == collection
        found = own if found is None else found & own
    return found
