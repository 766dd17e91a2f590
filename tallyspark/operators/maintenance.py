"""What is left of the views when an entity's, or a type's, are removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_entity(views: DataFrame, viewable_type: str, viewable_id: int) -> DataFrame:
    """All views but the entity's, whatever their time, visitor and collection."""
    gone = F.col("viewable_type").eqNullSafe(viewable_type) & F.col("viewable_id").eqNullSafe(viewable_id)
    return views.where(~gone)


def without_type(views: DataFrame, viewable_type: str) -> DataFrame:
    return views.where(~F.col("viewable_type").eqNullSafe(viewable_type))


def cascade(views: DataFrame, viewable_type: str, deleted: DataFrame, key: str, remove_views_on_delete: bool = True) -> DataFrame:
    """The views that stay when the entities in deleted are deleted; all if their type keeps its views."""
    if not remove_views_on_delete:
        return views
    gone = deleted.select(F.lit(viewable_type).alias("viewable_type"), F.col(key).cast("long").alias("viewable_id"))
    return views.join(gone, ["viewable_type", "viewable_id"], "left_anti")
