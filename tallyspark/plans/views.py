"""The fluent way to count, record and remove views. Builders never change: every call gives a new one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import schema
from tallyspark.config import EngineConfig
from tallyspark.functions import period as periods
from tallyspark.functions.period import Period
from tallyspark.functions.visitor import CrawlerTest, asks_not_to_track, is_crawler, names_crawler, new_visitor_id
from tallyspark.operators import cooldown, counts, gates, maintenance, relations
from tallyspark.plans.cache import CountCache, cache_key, until
from tallyspark.sources.store import ViewStore
from tallyspark.streaming import throttle


@dataclass(frozen=True)
class ViewableType:
    """A registered kind of entity."""

    name: str
    entities: DataFrame
    key: str
    label: str | None = None
    table: str | None = None
    remove_views_on_delete: bool = True


@dataclass(frozen=True)
class Visitor:
    """Who makes a request. Without an id, the cookie of the engine's name in cookies is asked for one; if it has none, a new
    id is made and put there. do_not_track is a boolean or the header as it was sent; any class with these methods can stand in."""

    id: str | None = None
    ip: str | None = None
    do_not_track: bool | str | None = False
    user_agent: str | None = None
    cookies: dict[str, str] | None = None

    def identity(self, config: EngineConfig) -> str:
        if self.id is not None:
            return self.id
        cookies = {} if self.cookies is None else self.cookies
        return cookies.setdefault(config.visitor_cookie_key, new_visitor_id())

    def cookie_expires(self, config: EngineConfig) -> datetime:
        """When a cookie that is set now ends."""
        return periods.now() + timedelta(minutes=config.visitor_cookie_minutes)

    def asks_not_to_track(self) -> bool:
        return asks_not_to_track(self.do_not_track)

    def is_crawler(self) -> bool:
        return names_crawler(self.user_agent)


@dataclass
class Engine:
    """A store of views with its settings, registered types, cooldowns per session, cache and listeners."""

    store: ViewStore
    config: EngineConfig = field(default_factory=EngineConfig)
    cache: CountCache = field(default_factory=CountCache)
    crawler: CrawlerTest = is_crawler
    mode: str = "per_item"
    types: dict[str, ViewableType] = field(default_factory=dict)
    listeners: list[Callable[[dict], None]] = field(default_factory=list)
    sessions: dict[tuple[str | None, str], cooldown.Cooldowns] = field(default_factory=dict)
    builder: type[Views] | None = None  # a class to use instead of Views

    @classmethod
    def at(cls, spark: SparkSession, path: str, config: EngineConfig | None = None, **options) -> Engine:
        """An engine whose views are in the table that the settings name, under a path."""
        config = config or EngineConfig()
        return cls(ViewStore(spark, path, config.table_name), config, **options)

    def register(self, kind: ViewableType) -> ViewableType:
        self.types[kind.name] = kind
        return kind

    def views(self, viewable_type: str, viewable_id: object = None) -> Views:
        """A builder for an entity, or (without an id) for its whole type."""
        return (self.builder or Views)(self, viewable_type, viewable_id)

    def heard(self, rows: DataFrame | None) -> None:
        """Tells the listeners of views that came in bulk, one by one; rows are fetched a part at a time, and only if anyone listens."""
        if rows is None or not self.listeners:
            return
        for row in rows.toLocalIterator(prefetchPartitions=False):
            for listener in self.listeners:
                listener(row.asDict())

    def entities_with_counts(self, viewable_type: str, specs: list[counts.CountSpec]) -> DataFrame:
        kind = self.types[viewable_type]
        return counts.with_counts(kind.entities, kind.key, kind.name, self.store.read(), specs)

    def order_by_views(self, viewable_type: str, direction: str = "desc", **options) -> DataFrame:
        kind = self.types[viewable_type]
        return counts.order_by_views(kind.entities, kind.key, kind.name, self.store.read(), direction, **options)

    def _registered(self) -> relations.Entities:
        return {k: (t.entities, t.key, t.label or t.key) for k, t in self.types.items()}

    def owners(self) -> DataFrame:
        return relations.view_owner(self.store.read(), self._registered())

    def orphans(self) -> DataFrame:
        return relations.orphan_views(self.store.read(), self._registered())

    def delete(self, viewable_type: str, deleted: DataFrame) -> None:
        """What follows when entities (a table with the type's key column) are deleted: their views go, if the type says so."""
        kind = self.types[viewable_type]
        if kind.remove_views_on_delete:
            self.store.rewrite(kind.name, lambda views: maintenance.cascade(views, kind.name, deleted, kind.key))

    def ingest(self, requests: DataFrame) -> DataFrame:
        """Records a table of requests; returns the rows that were appended. Listeners hear of each."""
        rows = gates.to_views(gates.accepted(requests, self.config, crawler=self.crawler, mode=self.mode))
        found = self.store.append(rows)
        self.heard(found)
        return found

    def ingest_stream(self, requests: DataFrame, checkpoint: str, name: str = "requests", delay: str = "10 minutes", **trigger):
        """Records a stream of requests through all gates; a batch that is run again after a failure is appended once."""
        def append(rows: DataFrame, batch: int) -> None:
            self.heard(self.store.append(rows, batch=(name, batch)))

        passed = gates.stateless(requests, self.config, crawler=self.crawler)
        return throttle.record_stream(passed, append, checkpoint, delay, self.mode, **trigger)


@dataclass(frozen=True)
class Views:
    engine: Engine
    viewable_type: str
    viewable_id: object = None
    in_period: Period | None = None
    in_collection: str | None = None
    is_unique: bool = False
    lasts: object = None
    lifetime: object = None
    visitor: Visitor = Visitor()
    session: str | None = None

    _macros = {}

    @classmethod
    def register_macro(cls, name: str, call: Callable) -> None:
        """Adds a method to all builders; it gets the builder and the arguments."""
        cls._macros[name] = call

    def __getattr__(self, name: str):
        macro = type(self)._macros.get(name)
        if macro is None:
            raise AttributeError(name)
        return lambda *args, **options: macro(self, *args, **options)

    def for_viewable(self, viewable_type: str, viewable_id: object = None) -> Views:
        return replace(self, viewable_type=viewable_type, viewable_id=viewable_id)

    def period(self, period: Period | None) -> Views:
        return replace(self, in_period=period)

    def collection(self, collection: str | None) -> Views:
        return replace(self, in_collection=collection)

    def unique(self, unique: bool = True) -> Views:
        return replace(self, is_unique=unique)

    def cooldown(self, lasts: int | timedelta | datetime | None) -> Views:
        """Minutes, a duration or an end; None for none."""
        return replace(self, lasts=lasts)

    def remember(self, lifetime: object = None) -> Views:
        """How long counts are kept: minutes, a duration or an end; None for not at all."""
        if lifetime is not None:
            until(lifetime, periods.now())
        return replace(self, lifetime=lifetime)

    def use_visitor(self, visitor: Visitor, session: str | None = None) -> Views:
        return replace(self, visitor=visitor, session=session)

    def cache_key(self) -> str:
        kind = self.engine.types.get(self.viewable_type)
        table = kind.table if kind and kind.table else self.viewable_type
        return cache_key(self.engine.config, table, self.viewable_type, self.viewable_id, period=self.in_period, unique=self.is_unique, collection=self.in_collection)

    def count_df(self) -> DataFrame:
        return counts.count_views(self.engine.store.read(self.viewable_type), self.viewable_type, self.viewable_id, period=self.in_period, collection=self.in_collection, unique=self.is_unique)

    def count(self) -> int:
        cache, key = self.engine.cache, self.cache_key()
        if self.lifetime is not None and (found := cache.get(key)) is not None:
            return int(found)
        found = int(self.count_df().first()[0])
        if self.lifetime is not None:
            cache.put(key, found, until(self.lifetime, periods.now()))
        return found

    def destroy(self) -> None:
        """Removes all views of the entity or type, whatever else the builder says."""
        kind, own = self.viewable_type, self.viewable_id
        if own is None:
            self.engine.store.remove_type(kind)
        else:
            self.engine.store.rewrite(kind, lambda views: maintenance.without_entity(views, kind, own))

    def is_crawler(self) -> bool:
        """By the engine's test; the usual one needs no Spark job for one request."""
        if self.engine.crawler is is_crawler:
            return self.visitor.is_crawler()
        agent = F.lit(self.visitor.user_agent).cast("string")
        return bool(self.engine.store.spark.range(1).select(self.engine.crawler(agent)).first()[0])

    def should_record(self) -> bool:
        config, who = self.engine.config, self.visitor
        if config.ignore_bots and self.is_crawler():
            return False
        if config.honor_dnt and who.asks_not_to_track():
            return False
        if who.ip in config.ignored_ip_addresses:
            return False
        if self.lasts is None:
            return True
        now = periods.now()
        space = cooldown.namespace_key(config.cooldown_key, self.viewable_type, self.in_collection)
        state = self.engine.sessions.setdefault((self.session, space), cooldown.Cooldowns(self.engine.mode))
        at = int((now - datetime(1970, 1, 1)) / timedelta(microseconds=1))
        return state.push(self.viewable_id, at, int((until(self.lasts, now) - now) / timedelta(microseconds=1)))

    def record(self) -> bool:
        """Appends one view now if the gates let it by; listeners then hear of it."""
        gates.require_entity(self.viewable_id)
        if not self.should_record():
            return False
        row = {"viewable_type": self.viewable_type, "viewable_id": self.viewable_id, "visitor": self.visitor.identity(self.engine.config), "collection": self.in_collection, "viewed_at": periods.now().replace(microsecond=0)}
        store = self.engine.store
        store.create()
        row = {"id": store.reserve(1)} | row
        store.append(store.spark.createDataFrame([tuple(row[f.name] for f in schema.VIEWS.fields)], schema.VIEWS))
        for listener in self.engine.listeners:
            listener(row)
        return True


