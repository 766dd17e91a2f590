"""One query per operator over the sample tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.config import EngineConfig
from tallyspark.functions import period as periods
from tallyspark.functions.period import Period
from tallyspark.operators import cooldown, counts, gates, maintenance, relations, scopes
from tallyspark.plans.cache import cache_key
from tallyspark.plans.views import Engine, ViewableType, Visitor
from tallyspark.sources import samples
from tallyspark.sources.store import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

#: The samples' clocks: inside the events, and near the end of the order lines on a day that months run over from.
EVENT_NOW, LINE_NOW = datetime(2024, 1, 16, 12), datetime(2001, 10, 31, 12)
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _queries[name] = query
    if sql is not None:
        _sql[name] = sql


def _at(now: datetime, make: Callable[[], Period]) -> Period:
    periods.set_clock(lambda: now)
    try:
        return make()
    finally:
        periods.set_clock(None)


def _views(body: str, source: str = samples.EVENT_VIEWS) -> str:
    return f"WITH views AS ({source}) {body}"


def _ago(now: datetime, kind: str, n: int, unit: str) -> str:
    """The beginning of a relative period as DuckDB reckons it; a day that the month lacks runs over into the next one."""
    at = f"TIMESTAMP '{now}'" if kind == "sub" else f"date_trunc('day', TIMESTAMP '{now}')"
    if unit not in ("months", "years"):
        return f"{at} - INTERVAL {n} {unit}"
    first = f"date_trunc('month', {at}) - INTERVAL {n} {unit}"
    return f"{first} + ({at} - date_trunc('month', {at}))"


def _condition(period: Period | str | None, collection: str | None) -> str:
    """period: one with bounds that are written here, or the SQL of its beginning."""
    if isinstance(period, str):
        return f" AND viewed_at >= {period}" + _condition(None, collection)
    parts = [f"viewed_at >= TIMESTAMP '{period.start_text()}'"] if period and period.start else []
    parts += [f"viewed_at <= TIMESTAMP '{period.end_text()}'"] if period and period.end else []
    parts += [f"collection = '{collection}'"] if scopes.counts_as_given(collection) else []
    return "".join(f" AND {p}" for p in parts)


def _count(name: str, viewable_type: str, viewable_id: int | None = None, *, period: Period | None = None, collection: str | None = None, unique: bool = False, lines: bool = False, begins: str | None = None) -> None:
    make, source = (samples.line_views, samples.LINE_VIEWS) if lines else (samples.event_views, samples.EVENT_VIEWS)
    time_col = "viewed_at" if lines else "ts"

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return counts.count_views(make(spark, sf_dir), viewable_type, viewable_id, period=period, collection=collection, unique=unique, time_col=time_col)

    what = "count(DISTINCT visitor)" if unique else "count(*)"
    own = "" if viewable_id is None else f" AND viewable_id = {viewable_id}"
    _add(name, query, _views(f"SELECT {what} AS views_count FROM views WHERE viewable_type = '{viewable_type}'{own}{_condition(begins or period, collection)}", source))


# ---------------------------------------------------------------- scans, filters, counts

_VIEW_COLUMNS = ("id", "viewable_type", "viewable_id", "visitor", "collection")
_SELECT_VIEWS = "SELECT " + ", ".join(_VIEW_COLUMNS) + ", epoch(viewed_at)::BIGINT AS viewed_second FROM views"


def _shown(views: DataFrame) -> DataFrame:
    return views.select(*_VIEW_COLUMNS, F.unix_seconds(F.col("viewed_at").cast("timestamp")).alias("viewed_second"))


_add("views_scan", lambda spark, d: _shown(samples.event_views(spark, d)), _views(_SELECT_VIEWS))
_JAN = Period.create("2024-01-08 06:00:00", "2024-01-20 18:30:00")
_count("count_instance", "part", 42)
_count("count_type", "part")
_count("count_since", "part", period=Period.since("2024-01-10"))
_count("count_upto", "part", period=Period.upto("2024-01-20 12:00:00"))
_count("count_between", "nation", period=_JAN)
_count("count_unbounded", "nation", period=Period())
_count("count_period_null", "nation", 7, period=None)
_count("count_collection", "part", collection="click")
_count("count_all_collections", "part", collection="0")
for _name, _value in (("scope_collection", "error"), ("scope_collection_null", None)):
    _add(_name, lambda spark, d, c=_value: _shown(scopes.in_collection(samples.event_views(spark, d), c)), _views(f"{_SELECT_VIEWS} WHERE collection IS NOT DISTINCT FROM {'NULL' if _value is None else repr(_value)}"))
for _unit, _n, _lines in (("days", 3, False), ("weeks", 1, False), ("months", 1, True), ("years", 2, True)):
    _count(f"count_past_{_unit}", "part", period=_at(LINE_NOW if _lines else EVENT_NOW, lambda: Period.past(_n, _unit)), lines=_lines, begins=_ago(LINE_NOW if _lines else EVENT_NOW, "past", _n, _unit))
for _unit, _n, _lines in (("seconds", 5000, False), ("minutes", 300, False), ("hours", 30, False), ("days", 3, False), ("weeks", 1, False), ("months", 1, True), ("years", 1, True)):
    _count(f"count_sub_{_unit}", "part", period=_at(LINE_NOW if _lines else EVENT_NOW, lambda: Period.sub(_n, _unit)), lines=_lines, begins=_ago(LINE_NOW if _lines else EVENT_NOW, "sub", _n, _unit))
_count("count_unique", "part", 42, unique=True)
_count("count_unique_type", "part", unique=True)
_count("count_combined", "nation", 7, period=_JAN, collection="click", unique=True)
_count("count_unique_lines", "part", unique=True, lines=True)

# ---------------------------------------------------------------- per entity, ranked


def _per_entity(specs: list[counts.CountSpec]) -> tuple[Query, str]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = samples.load(spark, sf_dir, "part").select("p_partkey")
        return counts.with_counts(parts, "p_partkey", "part", samples.event_views(spark, sf_dir), specs, time_col="ts")

    columns = "".join(
        f", (SELECT count({'DISTINCT visitor' if s.unique else '*'}) FROM views v WHERE v.viewable_type = 'part' AND v.viewable_id = p.p_partkey{_condition(s.period, s.collection)}) AS {s.name}"
        for s in specs
    )
    return query, _views(f"SELECT p_partkey{columns} FROM part p")


_add("with_views_count", *_per_entity([counts.CountSpec("views_count")]))
_add("with_unique_views_count", *_per_entity([counts.CountSpec("unique_views_count", unique=True)]))
_add("with_multi_counts", *_per_entity([counts.CountSpec("views_count"), counts.CountSpec("clicks", collection="click"), counts.CountSpec("visitors", period=_JAN, unique=True)]))
_add(
    "summary_counts", lambda spark, d: counts.summarise(samples.event_views(spark, d)),
    _views("SELECT viewable_type, viewable_id, count(*) AS views_count, count(DISTINCT visitor) AS unique_views_count FROM views GROUP BY ALL"),
)
_add(
    "count_from_summary", lambda spark, d: counts.count_from_summary(counts.summarise(samples.event_views(spark, d)), "part", 42),
    _views("SELECT count(*) AS views_count FROM views WHERE viewable_type = 'part' AND viewable_id = 42"),
)


def _ranking(name: str, direction: str, *, unique: bool = False, period: Period | None = None, collection: str | None = None, limit: int | None = None, lines: bool = False) -> None:
    column = "unique_views_count" if unique else "views_count"
    make, source = (samples.line_views, samples.LINE_VIEWS) if lines else (samples.event_views, samples.EVENT_VIEWS)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = samples.load(spark, sf_dir, "part").select("p_partkey")
        return counts.order_by_views(parts, "p_partkey", "part", make(spark, sf_dir), direction, unique=unique, period=period, collection=collection, limit=limit, time_col="viewed_at" if lines else "ts")

    what = "DISTINCT visitor" if unique else "*"
    sql = f"SELECT p_partkey, coalesce(n, 0) AS {column} FROM part LEFT JOIN (SELECT viewable_id, count({what}) AS n FROM views WHERE viewable_type = 'part'{_condition(period, collection)} GROUP BY 1) ON viewable_id = p_partkey ORDER BY {column} {direction}, p_partkey"
    _add(name, query, _views(sql + (f" LIMIT {limit}" if limit else ""), source))


for _direction in ("desc", "asc"):
    _ranking(f"order_by_views_{_direction}", _direction)
    _ranking(f"order_by_unique_views_{_direction}", _direction, unique=True)
_ranking("order_by_views_period", "desc", period=_JAN)
_ranking("order_by_views_collection", "asc", collection="purchase")
_ranking("order_by_unique_views_period", "desc", unique=True, period=_at(EVENT_NOW, lambda: Period.past(10, "days")))
_ranking("top_k_views", "desc", limit=20)
_ranking("rank_unique_lines", "desc", unique=True, lines=True)
_ranking("top_k_unique_lines", "desc", unique=True, limit=20, lines=True)

# ---------------------------------------------------------------- relations, removal


def _registered(spark: SparkSession, sf_dir: str) -> relations.Entities:
    return {"part": (samples.load(spark, sf_dir, "part"), "p_partkey", "p_name"), "nation": (samples.load(spark, sf_dir, "nation"), "n_nationkey", "n_name")}


_OWNERS = "SELECT 'part' AS t, p_partkey AS k, p_name AS owner_name FROM part UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation"
_add(
    "entity_views",
    lambda spark, d: relations.entity_views(samples.load(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "part", samples.event_views(spark, d)).select("p_partkey", "p_name", "id", "visitor", "collection"),
    _views("SELECT p_partkey, p_name, id, visitor, collection FROM part JOIN views ON viewable_type = 'part' AND viewable_id = p_partkey"),
)
_add(
    "view_owner", lambda spark, d: relations.view_owner(samples.event_views(spark, d), _registered(spark, d)).select(*_VIEW_COLUMNS, "owner_name"),
    _views(f"SELECT id, viewable_type, viewable_id, visitor, collection, owner_name FROM views LEFT JOIN ({_OWNERS}) ON t = viewable_type AND k = viewable_id"),
)
_add(
    "orphan_views", lambda spark, d: _shown(relations.orphan_views(samples.event_views(spark, d), _registered(spark, d))),
    _views(f"{_SELECT_VIEWS} WHERE NOT EXISTS (SELECT 1 FROM ({_OWNERS}) WHERE t = viewable_type AND k = viewable_id)"),
)
_add("destroy_instance", lambda spark, d: _shown(maintenance.without_entity(samples.event_views(spark, d), "part", 42)), _views(f"{_SELECT_VIEWS} WHERE NOT (viewable_type = 'part' AND viewable_id = 42)"))
_add("destroy_type", lambda spark, d: _shown(maintenance.without_type(samples.event_views(spark, d), "nation")), _views(f"{_SELECT_VIEWS} WHERE viewable_type <> 'nation'"))


def _cascade(spark: SparkSession, sf_dir: str, remove: bool) -> DataFrame:
    gone = samples.load(spark, sf_dir, "part").where("p_size % 5 = 0")
    return _shown(maintenance.cascade(samples.event_views(spark, sf_dir), "part", gone, "p_partkey", remove))


_add("cascade_delete", lambda spark, d: _cascade(spark, d, True), _views(f"{_SELECT_VIEWS} WHERE NOT (viewable_type = 'part' AND viewable_id IN (SELECT p_partkey FROM part WHERE p_size % 5 = 0))"))
_add("cascade_delete_optout", lambda spark, d: _cascade(spark, d, False), _views(_SELECT_VIEWS))

# ---------------------------------------------------------------- ingest

_DENIED = ("10.0.0.3", "10.0.0.11")
_BOT = "user_agent = 'ExampleBot/1.0'"


def _requests(body: str, source: str = samples.REQUESTS) -> str:
    return f"WITH RECURSIVE requests AS MATERIALIZED ({source}) {body}"


def _gate(name: str, gate: Callable[[DataFrame], DataFrame], condition: str) -> None:
    _add(name, lambda spark, d: gate(samples.requests(spark, d)).select("event_id"), _requests(f"SELECT event_id FROM requests WHERE {condition}"))


_gate("reject_type_records", gates.reject_types, "viewable_id IS NOT NULL")
_gate("gate_bots", gates.without_crawlers, f"NOT ({_BOT})")
_gate("gate_dnt", gates.honoring_dnt, "NOT dnt")
_gate("gate_ip", lambda rows: gates.without_addresses(rows, _DENIED), f"ip NOT IN {_DENIED}")


def _throttled(condition: str, out: str) -> str:
    """The intended cooldown as a recursive walk over each item's requests, from accepted to next accepted."""
    item = "session_id, viewable_type, coalesce('+' || collection, '-'), viewable_id"
    return _requests(f"""
        , let_by AS MATERIALIZED (SELECT *, md5(concat_ws('|', {item})) AS item FROM requests WHERE {condition}),
        numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ts, event_id) AS pos FROM let_by),
        walk AS (
            SELECT item, pos, true AS accepted, ts + INTERVAL 3 DAY AS until FROM numbered WHERE pos = 1
            UNION ALL
            SELECT n.item, n.pos, n.ts >= w.until, CASE WHEN n.ts >= w.until THEN n.ts + INTERVAL 3 DAY ELSE w.until END
            FROM walk w JOIN numbered n ON n.item = w.item AND n.pos = w.pos + 1)
        SELECT {out} FROM walk JOIN numbered USING (item, pos) WHERE accepted""")


def _flushed(out: str) -> str:
    """The cooldown that forgets a whole namespace as soon as one has ended, as a walk over each namespace's requests."""
    return _requests(f"""
        , numbered AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY space ORDER BY ts, event_id) AS pos
            FROM (SELECT *, md5(concat_ws('|', session_id, viewable_type, coalesce('+' || collection, '-'))) AS space FROM requests WHERE viewable_id IS NOT NULL)),
        walk AS (
            SELECT space, pos, true AS accepted, [viewable_id] AS items, ts + INTERVAL 3 DAY AS until FROM numbered WHERE pos = 1
            UNION ALL
            SELECT n.space, n.pos, n.ts >= w.until OR NOT list_contains(w.items, n.viewable_id),
                   CASE WHEN n.ts >= w.until THEN [n.viewable_id] WHEN list_contains(w.items, n.viewable_id) THEN w.items ELSE list_append(w.items, n.viewable_id) END,
                   CASE WHEN n.ts >= w.until THEN n.ts + INTERVAL 3 DAY ELSE w.until END
            FROM walk w JOIN numbered n ON n.space = w.space AND n.pos = w.pos + 1)
        SELECT {out} FROM walk JOIN numbered USING (space, pos) WHERE accepted""")


_CONFIG = EngineConfig(honor_dnt=True, ignored_ip_addresses=_DENIED)
_LET_BY = f"viewable_id IS NOT NULL AND NOT ({_BOT}) AND NOT dnt AND ip NOT IN {_DENIED}"
_add("gate_cooldown", lambda spark, d: cooldown.throttle(gates.reject_types(samples.requests(spark, d))).select("event_id"), _throttled("viewable_id IS NOT NULL", "event_id"))
_add("gate_cooldown_namespace_flush", lambda spark, d: cooldown.throttle(gates.reject_types(samples.requests(spark, d)), mode="namespace_flush").select("event_id"), _flushed("event_id"))
_add("gate_all", lambda spark, d: gates.accepted(samples.requests(spark, d), _CONFIG).select("event_id"), _throttled(_LET_BY, "event_id"))
_add(
    "record_rows", lambda spark, d: _shown(gates.to_views(gates.accepted(samples.requests(spark, d), _CONFIG))),
    _throttled(_LET_BY, "event_id AS id, viewable_type, viewable_id, visitor, collection, epoch(date_trunc('second', ts))::BIGINT AS viewed_second"),
)

# ---------------------------------------------------------------- cache


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over a store of its own, in the shared folder, that holds all views of the sample."""
    engine = Engine.at(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    engine.register(ViewableType("part", samples.load(spark, sf_dir, "part"), "p_partkey", "p_name"))
    engine.store.append(samples.event_views(spark, sf_dir).drop("ts"))
    return engine


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count that is remembered, asked for again after another view has come, and without its memory."""
    engine = _engine(spark, sf_dir)
    part = engine.views("part", 42)
    first = part.remember(60).count()
    part.use_visitor(Visitor("someone")).record()
    return spark.createDataFrame([(first, part.remember(60).count(), part.count())], "first_count long, second_count long, new_count long")


_add("cached_count", _cached, _views("SELECT count(*) AS first_count, count(*) AS second_count, count(*) + 1 AS new_count FROM views WHERE viewable_type = 'part' AND viewable_id = 42"))


def _stored(change: Callable[[Engine, DataFrame], None]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _engine(spark, sf_dir)
        change(engine, samples.load(spark, sf_dir, "part"))
        return _shown(engine.store.read())

    return query


_add("store_destroy_instance", _stored(lambda e, _: e.views("part", 42).destroy()), _views(f"{_SELECT_VIEWS} WHERE NOT (viewable_type = 'part' AND viewable_id = 42)"))
_add("store_destroy_type", _stored(lambda e, _: e.views("nation").destroy()), _views(f"{_SELECT_VIEWS} WHERE viewable_type <> 'nation'"))
_add("store_cascade", _stored(lambda e, parts: e.delete("part", parts.where("p_size % 5 = 0"))), _views(f"{_SELECT_VIEWS} WHERE NOT (viewable_type = 'part' AND viewable_id IN (SELECT p_partkey FROM part WHERE p_size % 5 = 0))"))


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views recorded one by one and in bulk, counted through the builder with each of its options."""
    engine = _engine(spark, sf_dir)
    for who in ("a", "a", "b"):
        engine.views("part", 42).collection("mine").cooldown(None).use_visitor(Visitor(who)).record()
    engine.views("part", 42).collection("mine").cooldown(10).use_visitor(Visitor("a"), session="s").record()
    engine.views("part", 42).collection("mine").cooldown(10).use_visitor(Visitor("a"), session="s").record()  # held back
    part = engine.views("nation").for_viewable("part", 42)
    found = (part.count(), part.unique().count(), part.collection("mine").count(), part.period(_JAN).count(), engine.views("part").count())
    return spark.createDataFrame([found], "views_count long, unique_views_count long, mine long, january long, of_type long")


_add("store_record_and_count", _recorded, _views(f"""
    SELECT count(*) FILTER (viewable_id = 42) + 4 AS views_count, count(DISTINCT visitor) FILTER (viewable_id = 42) + 2 AS unique_views_count, 4 AS mine,
           count(*) FILTER (viewable_id = 42{_condition(_JAN, None)}) AS january, count(*) + 4 AS of_type
    FROM views WHERE viewable_type = 'part'"""))


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine.at(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", _CONFIG)
    engine.ingest(samples.requests(spark, sf_dir))
    return _shown(engine.store.read())


_add("store_ingest", _ingested, _throttled(_LET_BY, "event_id AS id, viewable_type, viewable_id, visitor, collection, epoch(date_trunc('second', ts))::BIGINT AS viewed_second"))
_KEYED = (
    ("plain", dict(viewable_id=1)), ("type", dict()), ("since", dict(viewable_id=1, period=Period.since("2019-03-21"))),
    ("upto", dict(viewable_id=1, period=Period.upto("2020-07-03"))), ("past", dict(viewable_id=1, period=_at(EVENT_NOW, lambda: Period.past_days(2)))),
    ("sub", dict(viewable_id=2, period=_at(EVENT_NOW, lambda: Period.sub_weeks(3)))), ("unique", dict(viewable_id=1, unique=True)),
    ("collection", dict(viewable_id=1, collection="some-collection")),
)
_KEYS = {
    "plain": "posts:post.1.|.normal", "type": "type.posts:post.|.normal", "since": "posts:post.1.1553126400|.normal", "upto": "posts:post.1.|1593734400.normal",
    "past": "posts:post.1.past2days|.normal", "sub": "posts:post.2.sub3weeks|.normal", "unique": "posts:post.1.|.unique", "collection": "posts:post.1.|.normal.some-collection",
}
_add(
    "cache_keys", lambda spark, d: spark.createDataFrame([(n, cache_key(EngineConfig(), "posts", "Post", **o)) for n, o in _KEYED], "name string, cache_key string"),
    " UNION ALL ".join(f"SELECT '{n}' AS name, 'tallyspark.cache:spark:default:{k}' AS cache_key" for n, k in _KEYS.items()),
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by unique views between two dates, the most viewed first; parts without views stay."""
    return _queries["order_by_unique_views_period"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
