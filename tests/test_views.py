from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark import schema
from tallyspark.config import EngineConfig
from tallyspark.errors import ViewRecordError
from tallyspark.functions.period import Period
from tallyspark.functions.visitor import do_not_track, is_crawler, visitor_id
from tallyspark.operators import counts, scopes
from tallyspark.plans.cache import cache_key, period_slug, slug, until
from tallyspark.plans.views import Engine, ViewableType, Views, Visitor
from tallyspark.sources.store import ViewStore


def made(spark, rows):
    """rows: (type, id, visitor, collection, viewed_at as text)."""
    return spark.createDataFrame([(k, *r[:4], datetime.fromisoformat(r[4])) for k, r in enumerate(rows)], schema.VIEWS)


def posts(spark, n=4):
    return spark.createDataFrame([(k, f"post {k}") for k in range(1, n + 1)], "id int, title string")


@pytest.fixture
def engine(spark, tmp_path, clock):
    clock(2018, 3, 20, 12)
    engine = Engine(ViewStore(spark, str(tmp_path / "views")))
    engine.store.create()
    engine.register(ViewableType("post", posts(spark), "id", "title"))
    return engine


T = "2018-01-01"


def test_counts(spark):
    views = made(spark, [("post", 1, "one", "custom", T), ("post", 1, "one", None, T), ("post", 1, None, "custom", T), ("post", 2, "two", "", T), ("apartment", 1, "one", "0", T)])
    count = lambda *a, **o: counts.count_views(views, *a, **o).first()[0]
    assert count("post", 1) == 3
    assert count("post", 1, unique=True) == 1  # a null visitor isn't one
    assert count("post") == 4 and count("post", unique=True) == 2
    assert count("post", 1, collection="custom") == 2
    assert count("post", collection="") == count("post", collection="0") == 4
    assert count("apartment", collection="0") == 1
    assert count("post", 9) == 0
    assert scopes.in_collection(views, None).count() == 1 and scopes.in_collection(views, "").count() == 1


@pytest.mark.parametrize("period, n", [(Period.since("2018-01-10"), 6), (Period.upto("2018-02-15"), 4), (Period.create("2018-01-15", "2018-03-10"), 4), (None, 6), (Period(), 6)])
def test_periods_include_their_bounds(spark, period, n):
    days = ["2018-01-10", "2018-01-15", "2018-02-10", "2018-02-15", "2018-03-10", "2018-03-15"]
    assert counts.count_views(made(spark, [("post", 1, "v", None, d) for d in days]), "post", 1, period=period).first()[0] == n


@pytest.mark.parametrize("direction, order", [("desc", [1, 4, 3, 2]), ("asc", [2, 3, 4, 1])])
def test_ranking(spark, direction, order):
    views = made(spark, [("post", p, "v", None, T) for p, n in zip((1, 2, 3, 4), (4, 1, 2, 3)) for _ in range(n)])
    assert [r.id for r in counts.order_by_views(posts(spark), "id", "post", views, direction).collect()] == order


def test_unique_ranking_keeps_entities_without_views(spark):
    views = made(spark, [("post", p, f"v{k}", None, T) for p, n in ((2, 2), (3, 3), (4, 1)) for k in range(n)] + [("post", 4, "v0", None, T)] * 5)
    found = counts.order_by_unique_views(posts(spark), "id", "post", views).collect()
    assert [(r.id, r.unique_views_count) for r in found] == [(3, 3), (2, 2), (4, 1), (1, 0)]
    assert [r.id for r in counts.order_by_views(posts(spark), "id", "post", views.limit(0), limit=2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        counts.order_by_views(posts(spark), "id", "post", views, "sideways")


def test_several_counts_in_one_pass(spark):
    views = made(spark, [("post", 1, "a", "x", "2018-01-01"), ("post", 1, "a", None, "2018-02-01"), ("post", 1, "b", None, "2018-02-02")])
    specs = [counts.CountSpec("all"), counts.CountSpec("x", collection="x"), counts.CountSpec("late", Period.since("2018-02-01"), unique=True)]
    assert counts.with_counts(posts(spark, 2), "id", "post", views, specs).orderBy("id").collect()[0][2:] == (3, 1, 2)


def test_record_count_and_destroy(engine):
    one, two = engine.views("post", 1), engine.views("post", 2)
    for visitor in ("one", "one", "two"):
        assert one.use_visitor(Visitor(visitor)).record()
    two.collection("custom").use_visitor(Visitor("three")).record()
    assert one.count() == 3 and one.unique().count() == 2 and engine.views("post").count() == 4
    assert two.collection("custom").count() == 1
    assert sorted(r.id for r in engine.store.read().collect()) == [0, 1, 2, 3]
    one.period(Period.since("2030-01-01")).destroy()  # removes all the same
    assert one.count() == 0 and two.count() == 1
    engine.views("post").destroy()
    assert engine.views("post").count() == 0


def test_gates_of_record(engine):
    post, heard = engine.views("post", 1), []
    engine.listeners.append(heard.append)
    with pytest.raises(ViewRecordError, match="belongs to one entity"):
        engine.views("post").record()
    assert not post.use_visitor(Visitor("v", user_agent="Googlebot/2.1")).record()
    engine.config = EngineConfig(honor_dnt=True, ignored_ip_addresses=("127.20.22.6",))
    assert not post.use_visitor(Visitor("v", do_not_track=True)).record()
    assert not post.use_visitor(Visitor("v", ip="127.20.22.6")).record()
    assert post.use_visitor(Visitor("v", ip="127.20.22.7", user_agent="Mozilla/5.0")).record()
    assert post.count() == 1 and len(heard) == 1


def test_cooldown_of_record(engine, clock):
    post = engine.views("post", 1)
    assert post.cooldown(10).record() and not post.cooldown(10).record()
    assert post.collection("custom").cooldown(10).record()  # apart from the others
    assert not post.cooldown(datetime(2018, 3, 20, 13)).record() and post.cooldown(None).record()
    clock(2018, 3, 20, 12, 9)
    assert not post.cooldown(10).record()  # which doesn't prolong it
    clock(2018, 3, 20, 12, 10)
    assert post.cooldown(timedelta(minutes=10)).record()  # exactly at its end


def test_remembered_counts(engine, clock):
    post = engine.views("post", 1)
    for _ in range(3):
        post.record()
    assert post.remember(60).count() == 3
    post.record()
    assert post.remember(60).count() == 3 and post.remember(60).remember(None).count() == 4
    clock(2018, 3, 20, 13)
    assert post.remember(60).count() == 4
    with pytest.raises(ValueError):
        post.remember("not good")


def test_cascade_and_orphans(engine, spark):
    for k in (1, 2, 9):
        engine.views("post", k).record()
    assert {r.viewable_id: r.owner_name for r in engine.owners().collect()} == {1: "post 1", 2: "post 2", 9: None}
    assert [r.viewable_id for r in engine.orphans().collect()] == [9]
    engine.delete("post", posts(spark, 1))
    assert sorted(r.viewable_id for r in engine.store.read().collect()) == [2, 9]
    engine.register(ViewableType("post", posts(spark), "id", remove_views_on_delete=False))
    engine.delete("post", posts(spark))
    assert engine.store.read().count() == 2


def test_macros(engine):
    Views.register_macro("twice", lambda views, more: views.count() * 2 + more)
    assert engine.views("post", 1).twice(1) == 1
    with pytest.raises(AttributeError):
        engine.views("post", 1).thrice()


def test_cache_keys(clock):
    clock(2020, 1, 1)
    config = EngineConfig(cache_key="ns", connection="c", database=":memory:")
    key = lambda k=1, **o: cache_key(config, "posts", "App\\Post", k, **o)
    assert key().startswith("ns:c::memory::posts:apppost~") and key().endswith(".1.|.normal")
    assert len({cache_key(config, "posts", kind, 1) for kind in ("App\\Post", "AppPost", "Ap\\pPost", "App Post")}) == 4
    assert cache_key(config, "posts", "POST", 1) == "ns:c::memory::posts:post.1.|.normal"
    assert key(period=Period.since("2019-03-21")).endswith("1.1553126400|.normal")
    assert key(period=Period.upto("2020-07-03")).endswith("1.|1593734400.normal")
    assert key(period=Period.past_days(2)).endswith("1.past2days|.normal") and key(period=Period.sub_seconds(34)).endswith("1.sub34seconds|.normal")
    assert key(unique=True).endswith("1.|.unique") and key(collection="some-collection").endswith("1.|.normal.some-collection")
    assert cache_key(config, "posts", "post") == "ns:c::memory::type.posts:post.|.normal"
    assert key(collection="0") == key() and slug("Äb C_d!") == "ab-c-d" and period_slug(None) == "|"
    assert until(5, datetime(2020, 1, 1)) == datetime(2020, 1, 1, 0, 5)


def test_visitor_columns(spark):
    rows = spark.createDataFrame([("Googlebot", "1", None, 1), ("Mozilla/5.0", "0", "me", 2), (None, None, None, 3)], "agent string, dnt string, visitor string, n int")
    found = rows.select(is_crawler(F.col("agent")), do_not_track(F.col("dnt")), F.length(visitor_id(F.col("visitor"), F.col("n")))).collect()
    assert [tuple(r) for r in found] == [(True, True, 80), (False, False, 2), (False, False, 80)]


def test_append_of_a_table_numbers_on(engine, spark):
    rows = made(spark, [("post", k, "v", None, T) for k in range(50)])
    engine.store.append(rows)
    engine.store.append(rows.drop("id").repartition(5))
    assert sorted(r.id for r in engine.store.read().collect()) == list(range(100))
    engine.store.drop()
    with pytest.raises(FileNotFoundError):
        engine.store.read()
    assert "PARTITIONED BY (viewable_type)" in schema.ddl("views")


def test_visitor_ids_are_made(engine, spark):
    post, cookies = engine.views("post", 1), {}
    post.record()
    for _ in range(2):
        post.use_visitor(Visitor(cookies=cookies)).record()
    assert [len(r.visitor) for r in engine.store.read().collect()] == [80] * 3
    assert post.unique().count() == 2 and list(cookies) == [engine.config.visitor_cookie_key]
    assert Visitor().cookie_expires(engine.config) == datetime(2018, 3, 20, 12) + timedelta(minutes=2_628_000)
    engine.config = EngineConfig(honor_dnt=True)
    assert not post.use_visitor(Visitor("v", do_not_track="1")).record() and post.use_visitor(Visitor("v", do_not_track="0")).record()


def test_other_classes_stand_in(engine, spark):
    class Loud(Views):
        def count(self):
            return -super().count()

    engine.builder, engine.crawler = Loud, lambda agent: F.coalesce(agent == "mine", F.lit(False))
    post = engine.views("post", 1)
    assert post.use_visitor(Visitor("v", user_agent="Googlebot")).record() and not post.use_visitor(Visitor("v", user_agent="mine")).record()
    assert post.count() == -1 and engine.views("x").for_viewable("post", 1).count() == -1

    class Store(dict):
        def put(self, key, count, end):
            self[key] = count

    engine.cache = Store()
    post.remember(5).count()
    assert list(engine.cache.values()) == [1]


def test_the_settings_name_the_table(spark, tmp_path):
    engine = Engine.at(spark, str(tmp_path), EngineConfig(table_name="page_views"))
    engine.views("post", 1).record()
    assert (tmp_path / "page_views").is_dir() and Engine.at(spark, str(tmp_path), engine.config).views("post").count() == 1


def test_removal_leaves_other_types_and_readers_alone(engine, spark):
    store = engine.store
    store.append(made(spark, [(kind, k, "v", None, T) for kind in ("post", "page") for k in range(20)]))
    folders = lambda kind: {f for t, f in store._current()[1]["folders"] if t == kind}
    pages, before = folders("page"), store.read()
    engine.views("post", 3).destroy()
    assert folders("page") == pages and before.count() == 40 and store.read().count() == 39
    engine.views("post").destroy()
    assert folders("page") == pages and not folders("post") and store.read("page").count() == 20
    assert store.vacuum(keep=1) == 2 and store.read().count() == 20


def test_two_writers_get_different_ids_and_lose_nothing(engine, spark):
    first, second = engine.store, ViewStore(spark, engine.store.path.rsplit("/", 1)[0])
    rows = made(spark, [("post", k, "v", None, T) for k in range(5)]).drop("id")
    assert second.reserve(3) + 3 == first.reserve(2)
    plain = first._current
    stale = plain()
    second.append(rows)  # a writer in between: the first one's next snapshot is taken
    first._current = lambda: setattr(first, "_current", plain) or stale
    first.append(rows)
    ids = [r.id for r in first.read().collect()]
    assert len(ids) == len(set(ids)) == 10


def test_batches_are_appended_once(engine, spark):
    rows = made(spark, [("post", 1, "v", None, T)])
    heard = []
    engine.listeners.append(heard.append)
    for number in (0, 0, 1, 1, 0):
        engine.heard(engine.store.append(rows, batch=("s", number)))
    assert engine.store.read().count() == 2 == len(heard) and heard[0]["viewable_id"] == 1


def test_counts_that_nobody_asks_for_again_go(clock):
    from tallyspark.plans.cache import CountCache

    clock(2020, 1, 1)
    cache = CountCache()
    for k in range(5000):
        clock(2020, 1, 1, k // 60 % 24, k % 60, 0)
        cache.put(str(k), k, until(1, datetime(2020, 1, 1)))
    assert len(cache.held) < 2048
