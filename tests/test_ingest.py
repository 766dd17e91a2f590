import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark import schema
from tallyspark.config import EngineConfig
from tallyspark.operators import cooldown, gates

START = datetime(2024, 1, 1)


def request(n, minute, item=1, session="s", collection=None, lasts=60, **more):
    row = dict(event_id=n, ts=START + timedelta(minutes=minute), session_id=session, visitor="v", ip=None, dnt=False, user_agent=None, viewable_type="post", viewable_id=item, collection=collection, cooldown_minutes=lasts)
    return tuple((row | more)[f.name] for f in schema.REQUESTS.fields)


def kept(spark, rows, mode="per_item"):
    return sorted(r.event_id for r in cooldown.throttle(spark.createDataFrame(rows, schema.REQUESTS), mode=mode).collect())


def test_trace_of_both_modes(spark):
    rows = [request(1, 0, 1), request(2, 30, 2), request(3, 60, 1), request(4, 70, 2)]
    assert kept(spark, rows) == [1, 2, 3]
    assert kept(spark, rows, "namespace_flush") == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        kept(spark, rows, "other")


def test_null_and_empty_collections_are_apart_and_no_cooldown_passes(spark):
    rows = [request(1, 0), request(2, 1, collection=""), request(3, 2, lasts=None), request(4, 3), request(5, 4, collection="")]
    assert kept(spark, rows) == [1, 2, 3]
    assert kept(spark, []) == []


@pytest.mark.parametrize("mode", cooldown.MODES)
def test_against_a_plain_loop(spark, mode):
    rng = random.Random(5)
    rows = [request(n, rng.randint(0, 2000), rng.randint(1, 3), rng.choice("ab"), rng.choice([None, "", "c"]), rng.choice([5, 60, None])) for n in range(1500)]
    names = [f.name for f in schema.REQUESTS.fields]
    ends, out = {}, []
    for r in sorted((dict(zip(names, r)) for r in rows), key=lambda r: (r["ts"], r["event_id"])):
        if r["cooldown_minutes"] is None:
            out.append(r["event_id"])
            continue
        space = ends.setdefault((r["session_id"], r["collection"]), {})
        live = {k: v for k, v in space.items() if v > r["ts"]}
        if mode == "namespace_flush":
            ends[r["session_id"], r["collection"]] = space = space if len(live) == len(space) else {}
        else:
            ends[r["session_id"], r["collection"]] = space = live
        if r["viewable_id"] not in space:
            space[r["viewable_id"]] = r["ts"] + timedelta(minutes=r["cooldown_minutes"])
            out.append(r["event_id"])
    assert kept(spark, rows, mode) == sorted(out)


def test_gates_run_before_the_cooldown(spark):
    rows = [
        request(1, 0, user_agent="SomeBot/1"), request(2, 1, dnt=True), request(3, 2, ip="10.0.0.1"), request(4, 3, None), request(5, 4, ip="10.0.0.2"), request(6, 5),
    ]
    table = spark.createDataFrame(rows, schema.REQUESTS)
    found = gates.accepted(table, EngineConfig(honor_dnt=True, ignored_ip_addresses=("10.0.0.1",)))
    assert [r.event_id for r in found.collect()] == [5]
    assert sorted(r.event_id for r in gates.without_addresses(table, spark.createDataFrame([("10.0.0.1",)], "a string")).collect()) == [1, 2, 4, 5, 6]
    assert gates.to_views(found).schema.names == schema.VIEWS.names


@pytest.mark.parametrize("mode", cooldown.MODES)
def test_stream_equals_batch_whatever_the_order(spark, tmp_path, mode):
    from tallyspark.plans.views import Engine

    rng = random.Random(3)
    agent = lambda n: "SomeBot/1" if n % 17 == 0 else None
    rows = [request(n, n // 2 + rng.randint(0, 5), rng.randint(1, 2) if n % 13 else None, rng.choice("ab"), rng.choice([None, "c"]), 20, viewable_type=rng.choice(["Post", "post"]), user_agent=agent(n)) for n in range(200)]
    engine, heard = Engine.at(spark, str(tmp_path), mode=mode), []
    engine.listeners.append(heard.append)
    batch = sorted(r.event_id for r in gates.accepted(spark.createDataFrame(rows, schema.REQUESTS), engine.config, mode=mode).collect())
    end = [request(10_000 + k, 100_000 + k, lasts=None, session="end") for k in range(2)]
    source = tmp_path / "in"
    for part in (rows[:70], rows[70:140], rows[140:], end[:1], end[1:]):
        rng.shuffle(part)
        spark.createDataFrame(part, schema.REQUESTS).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema.REQUESTS).parquet(str(source))
        query = engine.ingest_stream(stream, str(tmp_path / "checkpoint"), availableNow=True)
        assert query.awaitTermination(120)  # each part is a restart from the checkpoint
    found = [r for r in engine.store.read().collect() if r.id < 10_000]
    assert sorted(r.id for r in found) == batch and all(r.visitor for r in found)
    assert sorted(r["id"] for r in heard if r["id"] < 10_000) == batch


@pytest.mark.parametrize("mode", cooldown.MODES)
def test_long_histories_are_cut_into_runs(spark, monkeypatch, mode):
    rng = random.Random(8)
    rows = [request(n, day * 1440 + rng.randint(0, 300), rng.randint(1, 3), "hot" if n % 3 else "cold", None, rng.choice([5, 60, 400])) for n, day in enumerate(sorted(rng.randint(0, 20) for _ in range(600)))]
    whole = kept(spark, rows, mode)
    monkeypatch.setattr(cooldown, "LONG_KEY", 30)
    assert kept(spark, rows, mode) == whole
    keyed = spark.createDataFrame([("k", 0, 0, 10), ("k", 0, 4 * cooldown.SLOT, 10), ("k", 0, 4 * cooldown.SLOT + 5, 10)] * 20, "__key string, __item long, __at long, __lasts long")
    assert cooldown._in_runs(keyed).select("__key").distinct().count() == 2


def test_small_batches_give_the_same(spark):
    rng = random.Random(9)
    rows = [request(n, rng.randint(0, 900), rng.randint(1, 2), rng.choice("ab"), None, rng.choice([5, 60])) for n in range(400)]
    whole = kept(spark, rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert kept(spark, rows) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_gates_of_odd_requests(spark):
    rows = spark.createDataFrame([request(1, 0, session=None), request(2, 1, session=None, item=2), request(3, 2, item=3)], schema.REQUESTS).drop("visitor").selectExpr("*", "CAST(NULL AS STRING) AS visitor")
    late = rows.withColumn("ts", F.expr("if(event_id = 3, null, ts)")).withColumn("dnt", F.expr("if(event_id = 2, '1', '0')"))
    views = gates.to_views(gates.accepted(late.select(*[f.name for f in schema.REQUESTS.fields]), EngineConfig(honor_dnt=True))).collect()
    assert sorted(v.id for v in views) == [1, 3] and all(len(v.visitor) == 80 and v.viewed_at for v in views) and len({v.visitor for v in views}) == 2
