"""Views and the entities that they belong to, over any number of entity tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import scopes

Entities = Mapping[str, tuple[DataFrame, str, str]]  # type: (table, key column, column that names the owner)


def entity_views(entities: DataFrame, key: str, viewable_type: str, views: DataFrame) -> DataFrame:
    """Each entity's views, beside the entity's columns."""
    own = scopes.of_type(views, viewable_type)
    return entities.join(own, F.col(key) == F.col("viewable_id"))


def owners(registered: Entities) -> DataFrame:
    """owner_type, owner_id, owner_name of all entities of all types."""
    parts = [
        table.select(F.lit(kind).alias("owner_type"), F.col(key).cast("long").alias("owner_id"), F.col(name).cast("string").alias("owner_name"))
        for kind, (table, key, name) in registered.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def view_owner(views: DataFrame, registered: Entities) -> DataFrame:
    """views with owner_name; null where the entity is missing or its type isn't registered."""
    met = (F.col("viewable_type") == F.col("owner_type")) & (F.col("viewable_id") == F.col("owner_id"))
    return views.join(owners(registered), met, "left").drop("owner_type", "owner_id")


def orphan_views(views: DataFrame, registered: Entities) -> DataFrame:
    """Views whose entity is missing or whose type isn't registered."""
    met = (F.col("viewable_type") == F.col("owner_type")) & (F.col("viewable_id") == F.col("owner_id"))
    return views.join(owners(registered), met, "left_anti")
