import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from samples import BASE, rows
from tidewater import contracts as C
from tidewater.operators import aggregates as A
from tidewater.operators import refine
from tidewater.plans import backfill
from tidewater.sources import lake as L
from tidewater.streaming import runner, sinks

DAY = date(2026, 7, 1)


def record(n, event_type=C.ORDER_CREATED, at=BASE, **data):
    body = {"order_id": f"o{n}", "customer_id": "u", "node_id": "n1",
            "items": [{"sku": "S1", "qty": 2, "unit_price": 5.0}], **data}
    return json.dumps({"event_id": f"{event_type}-{n}", "event_type": event_type, "schema_version": "1.0.0",
                       "occurred_at": at.strftime("%Y-%m-%dT%H:%M:%SZ"), "data": body})


def put(spark, path, *values):
    df = spark.createDataFrame([(v, "t", 0, i, BASE) for i, v in enumerate(values)], C.RAW_RECORD)
    df.coalesce(1).write.mode("append").parquet(path)


def bronze_rows(spark, lake, event_type=C.ORDER_CREATED):
    return L.bronze_batch(spark, lake, event_type)


@pytest.fixture
def lake(tmp_path):
    return L.Lake(str(tmp_path / "lake"))


def test_three_layers_restart_and_backfill(spark, lake, tmp_path):
    raw = str(tmp_path / "raw")
    put(spark, raw, record(1), record(1), record(2), "{bad", record(3, order_id=None),
        record(1, C.ORDER_SHIPPED, BASE + timedelta(hours=1)))
    runner.finish([runner.start_bronze(L.file_records(spark, raw), lake, once=True)])
    assert bronze_rows(spark, lake).count() == 4
    assert spark.read.parquet(lake.bronze_rejects).count() == 1
    # the same checkpoint reads only what is new
    put(spark, raw, record(9))
    runner.finish([runner.start_bronze(L.file_records(spark, raw), lake, once=True)])
    assert bronze_rows(spark, lake).count() == 5
    runner.finish([runner.start_silver(spark, lake, C.ORDER_CREATED, once=True),
                   runner.start_silver(spark, lake, C.ORDER_SHIPPED, once=True)])
    # events of 2026 arrive "now": everything valid is late or, before that date, prompt
    silver, late = (L._batch(spark, p(C.ORDER_CREATED), C.silver_type(C.ORDER_CREATED), None, None, None)
                    for p in (lake.silver, lake.late))
    assert silver.count() + late.count() == 3
    assert spark.read.parquet(lake.rejects(C.ORDER_CREATED)).count() == 1
    counts = backfill.reprocess_silver(spark, lake, C.ORDER_CREATED, DAY, DAY, apply=True)
    assert counts["bronze_distinct"] == 4 and counts[refine.REJECTED] == 1
    first = rows(spark.read.parquet(lake.rejects(C.ORDER_CREATED)), "event_id")
    assert backfill.reprocess_silver(spark, lake, C.ORDER_CREATED, DAY, DAY, apply=True) == counts
    assert rows(spark.read.parquet(lake.rejects(C.ORDER_CREATED)), "event_id") == first
    passed, report = backfill.quality_report(spark, lake, DAY)
    assert report.count() == 5
    assert {r["name"]: r["value"] for r in report.collect()}["bronze_silver_reconciliation"] == 0.0
    noted = sinks.metrics_frame(spark, lake.metrics)
    assert noted.where("layer = 'bronze' and outcome = 'valid'").agg(F.sum("rows")).first()[0] == 6
    assert noted.where("layer = 'silver'").count() > 0


def silver_frame(spark, ids, at=BASE):
    return spark.createDataFrame([(i, f"o{i}", at + timedelta(minutes=i)) for i in ids],
                                 "event_id int, order_id string, occurred_at timestamp").select(
        F.col("event_id").cast("string").alias("event_id"), "order_id", "occurred_at",
        F.to_date("occurred_at").alias("date"))


def test_gold_backfill_and_unknown_name(spark, lake):
    sinks.write_day_partitions(silver_frame(spark, range(5)), lake.silver(C.ORDER_CREATED), "seed")
    assert backfill.reprocess_gold(spark, lake, "orders_per_minute", DAY, DAY) == 5
    assert L.read_or_empty(spark, lake.gold("orders_per_minute"), spark.range(0).schema).count() == 0
    for _ in range(2):
        backfill.reprocess_gold(spark, lake, "orders_per_minute", DAY, DAY, apply=True)
        assert spark.read.parquet(lake.gold("orders_per_minute")).count() == 5
    with pytest.raises(ValueError):
        backfill.reprocess_gold(spark, lake, "nope", DAY, DAY)
    with pytest.raises(ValueError):
        backfill.check_range(DAY, DAY - timedelta(days=1))


def test_swap_leaves_other_days_and_empties_days_without_rows(spark, tmp_path):
    live, other = str(tmp_path / "live"), DAY + timedelta(days=1)
    df = spark.createDataFrame([(1, DAY), (2, other)], "v int, date date")
    sinks.write_day_partitions(df, live, "old")
    old = backfill.day_entries(spark, live, [DAY])
    sinks.write_day_partitions(spark.createDataFrame([(9, DAY)], "v int, date date"), live, "meanwhile")
    backfill.swap_days(spark, df.where("v = 2").withColumn("v", F.lit(5)), live, [DAY], old)
    assert rows(spark.read.parquet(live), "v") == [(2,), (9,)]


def test_a_rebuilt_day_forgets_what_an_earlier_run_staged(spark, lake):
    silver, gold = lake.silver(C.ORDER_CREATED), lake.gold("orders_per_minute")
    sinks.write_day_partitions(silver_frame(spark, range(5)), silver, "seed")
    assert backfill.reprocess_gold(spark, lake, "orders_per_minute", DAY, DAY, apply=True) == 5
    empty = silver_frame(spark, range(1)).where("false")
    backfill.swap_days(spark, empty, silver, [DAY], backfill.day_entries(spark, silver, [DAY]))
    assert backfill.reprocess_gold(spark, lake, "orders_per_minute", DAY, DAY, apply=True) == 0
    assert L.read_or_empty(spark, gold, spark.range(0).schema).count() == 0


def test_a_joined_day_finds_partners_before_the_range(spark, lake):
    order, shipped = silver_frame(spark, [0]), silver_frame(spark, [0], BASE + timedelta(days=1))
    sinks.write_day_partitions(order, lake.silver(C.ORDER_CREATED), "seed")
    sinks.write_day_partitions(shipped, lake.silver(C.ORDER_SHIPPED), "seed")
    after = DAY + timedelta(days=1)
    assert backfill.reprocess_gold(spark, lake, "fulfillment_latency", after, after) == 1
    assert backfill.reprocess_gold(spark, lake, "fulfillment_latency", DAY, DAY) == 0


def test_backfilled_files_are_not_streamed_to_gold_again(spark, lake):
    silver = lake.silver(C.ORDER_CREATED)
    sinks.write_day_partitions(silver_frame(spark, range(60)), silver, "seed")
    backfill.swap_days(spark, silver_frame(spark, range(60)), silver, [DAY], [])
    runner.finish([runner.start_gold(spark, lake, "orders_per_minute", once=True)])
    got = spark.read.parquet(lake.gold("orders_per_minute"))
    assert got.count() == 49 and got.agg(F.max("order_count")).first()[0] == 1


def test_the_latest_run_is_the_last_in_time_whatever_its_offset(spark, tmp_path):
    from tidewater.operators import forecasting

    stamps = [("old", "2026-10-25T02:50:00+02:00"), ("new", "2026-10-25T02:10:00+01:00")]
    spark.createDataFrame(stamps, "run_id string, trained_at string").write.json(str(tmp_path / "runs"))
    assert forecasting.latest_run(spark, str(tmp_path))["run_id"] == "new"
    assert forecasting.run_stamp().endswith("+00:00")


def test_scratch_needs_a_shared_folder_beyond_local_mode(monkeypatch):
    from types import SimpleNamespace

    from tidewater import session

    for master, fails in (("local[4]", False), ("local-cluster[2,1,512]", True), ("spark://host:7077", True), ("yarn", True)):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
        if fails:
            with pytest.raises(RuntimeError):
                session.scratch_path(fake, "x")
        else:
            assert session.scratch_path(fake, "x")


def test_a_repeated_batch_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        sinks.write_day_partitions(silver_frame(spark, range(3)), path, "q-0")
    sinks.write_day_partitions(silver_frame(spark, range(3, 5)), path, "q-1")
    assert spark.read.parquet(path).count() == 5


def test_gold_stream_equals_batch_for_closed_windows(spark, lake):
    df = silver_frame(spark, range(60))
    sinks.write_day_partitions(df, lake.silver(C.ORDER_CREATED), "seed")
    runner.finish([runner.start_gold(spark, lake, "orders_per_minute", once=True)])
    got = rows(spark.read.parquet(lake.gold("orders_per_minute")), "window_start", "order_count")
    closed = A.orders_per_minute(df).where(F.col("window_end") <= F.lit(BASE + timedelta(minutes=49)))
    assert got == rows(closed, "window_start", "order_count") and len(got) == 49


def test_joined_gold_stream_closes_after_the_join_bound(spark, lake):
    days = [BASE + timedelta(days=i) for i in range(12)]
    created = spark.createDataFrame([(f"o{i}", d) for i, d in enumerate(days)], "order_id string, occurred_at timestamp")
    shipped = created.withColumn("occurred_at", F.expr("occurred_at + interval 1 hour"))
    for df, kind in ((created, C.ORDER_CREATED), (shipped, C.ORDER_SHIPPED)):
        sinks.write_day_partitions(df.withColumn("date", F.to_date("occurred_at")), lake.silver(kind), "seed")
    runner.finish([runner.start_gold(spark, lake, "fulfillment_latency", once=True)])
    batch = rows(A.fulfillment_latency(created, shipped), "window_start", "avg_latency_seconds", "sample_count")
    got = rows(spark.read.parquet(lake.gold("fulfillment_latency")), "window_start", "avg_latency_seconds", "sample_count")
    assert got and set(got) <= set(batch) and len(got) < len(batch)


def test_an_event_far_ahead_does_not_hide_later_ones(spark, lake, tmp_path):
    """One file per trigger: business time jumps ahead, then an ordinary event follows."""
    path = lake.bronze(C.ORDER_VALIDATED)
    for i, ahead in enumerate((60, 0)):
        at = (BASE + timedelta(minutes=ahead)).strftime("%Y-%m-%dT%H:%M:%SZ")
        row = spark.createDataFrame([(f"e{i}", "1.0.0", at, '{"order_id":"o"}', BASE + timedelta(seconds=i), DAY)],
                                    "event_id string, schema_version string, occurred_at string, data_json string, "
                                    "ingested_at timestamp, date date")
        sinks.write_day_partitions(row, path, f"b{i}")
    runner.finish([runner.start_silver(spark, lake, C.ORDER_VALIDATED, once=True, files_per_trigger=1)])
    assert rows(L.silver_batch(spark, lake, C.ORDER_VALIDATED), "event_id") == [("e0",), ("e1",)]


def test_publish_and_inventory(spark, tmp_path):
    df = spark.createDataFrame([("t1", "k", "v"), ("t2", "k", "v")], "topic string, key string, value string")
    L.publish(df, path=str(tmp_path / "bus"))
    assert rows(L.partition_inventory(spark, str(tmp_path / "bus")), "segment") == [("topic=t1",), ("topic=t2",)]
    with pytest.raises(ValueError):
        L.publish(df)


def collect_stream(df, tmp_path, name):
    out, point = str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", point).trigger(
        availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def test_keyed_state_equals_batch(spark, tmp_path):
    import random

    from tidewater.operators import allocation, requests
    from tidewater.streaming import stateful

    rng = random.Random(1)
    hits = [(i, f"c{i % 2}", BASE + timedelta(seconds=rng.choice([7, 1, 0.3]) * i)) for i in range(60)]
    hits += [(100 + i, "idle", BASE) for i in range(5)]
    asks = [(i, f"s{i % 3}", "n", None if i == 17 else -3 if i % 7 == 3 else 1 + i % 4, BASE + timedelta(seconds=i // 3))
            for i in range(40)]
    hit_type = "request_id bigint, client string, ts timestamp"
    ask_type = "request_id bigint, sku string, node_id string, qty bigint, requested_at timestamp"
    far = BASE + timedelta(hours=2)
    rng.shuffle(hits), rng.shuffle(asks)  # rows come in any order within the watermark's delay
    for part in range(2):  # two files, one per trigger: state carries over
        spark.createDataFrame(hits[part * 30:part * 30 + 35], hit_type).coalesce(1).write.mode("append").parquet(str(tmp_path / "h"))
        spark.createDataFrame(asks[part * 20:part * 20 + 20], ask_type).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    hits = hits[:30] + hits[30:35] * 2 + hits[35:65]
    spark.createDataFrame([(-1, "last", far)], hit_type).coalesce(1).write.mode("append").parquet(str(tmp_path / "h"))
    spark.createDataFrame([(-1, "last", "n", 1, far)], ask_type).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    read = spark.readStream.option("maxFilesPerTrigger", 1)
    got = collect_stream(stateful.admit_stream(read.schema(hit_type).parquet(str(tmp_path / "h")), 3, 60), tmp_path, "hits")
    want = requests.rate_limit(spark.createDataFrame(hits, hit_type), 3, 60)
    assert rows(got, "request_id", "client", "admitted") == rows(want, "request_id", "client", "admitted")
    stock = spark.createDataFrame([("s0", "n", 9, 0), ("s1", "n", 30, 0)],
                                  "sku string, node_id string, available_qty int, reorder_threshold int")
    got = collect_stream(stateful.reserve_stream(read.schema(ask_type).parquet(str(tmp_path / "a")), stock), tmp_path, "asks")
    want = allocation.reserve(spark.createDataFrame(asks, ask_type), stock, ["requested_at", "request_id"])
    assert rows(got, "request_id", "outcome") == rows(want, "request_id", "outcome")


class Held:
    """State, timers and the handle of one key, in memory; counts the calls."""

    def __init__(self):
        self.calls, self.timers, self.maps, self.values = 0, set(), {}, {}

    def getMapState(self, name, key, value):
        held, of = self.maps.setdefault(name, {}), self

        class Map:
            def containsKey(self, k):
                of.calls += 1
                return k in held

            def getValue(self, k):
                of.calls += 1
                return held.get(k)

            def updateValue(self, k, v):
                of.calls += 1
                held[k] = v

            def removeKey(self, k):
                of.calls += 1
                held.pop(k, None)

        return Map()

    def getValueState(self, name, schema):
        held, of = self.values, self

        class Value:
            def exists(self):
                of.calls += 1
                return name in held

            def get(self):
                of.calls += 1
                return held.get(name)

            def update(self, v):
                of.calls += 1
                held[name] = v

            def clear(self):
                of.calls += 1
                held.pop(name, None)

        return Value()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


@pytest.mark.parametrize("dense", [1000, 4])
def test_state_is_called_by_bucket_and_not_by_row(monkeypatch, dense):
    """Verdicts and the moment of each row are those of a walk in order, in any triggers, split buckets or not."""
    import random
    from types import SimpleNamespace

    import pandas as pd

    from tidewater.streaming import stateful

    monkeypatch.setattr(stateful, "DENSE", dense, raising=False)
    rng = random.Random(3)
    span = rng.sample(range(400), 60) + [70_000 + i // 9 for i in range(300)] + [20_000_000, 20_000_000, 33_000_000]
    data = sorted(((s * stateful.SECOND + rng.randrange(1000), n) for n, s in enumerate(span)), key=lambda r: (r[0], r[1]))
    walk = lambda state, row: ((((state[0] if state else 0) * 31 + row[1]) % 997,), (state[0] if state else 0))
    held, processor, got, mark = Held(), None, [], 0
    processor = stateful._processor(("at", "request_id"), "x bigint", lambda frame: None, walk, lambda state: None)
    processor.init(held)
    shuffled = sorted(data, key=lambda r: r[0] // (150 * stateful.SECOND) * 1000 + rng.randrange(1000))
    for part in range(0, len(shuffled) + 100, 100):
        rows_in = shuffled[part:part + 100]
        if rows_in:
            list(processor.handleInputRows(("k",), iter([pd.DataFrame(rows_in, columns=["at", "request_id"])]), None))
        rest = shuffled[part + 100:]
        mark = max(mark, min(r[0] for r in rest) // 1000 if rest else 21_000_000_000)
        while due := sorted(t for t in held.timers if t <= mark):
            held.timers.discard(due[0])
            for out in processor.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark),
                                                    SimpleNamespace(getExpiryTimeInMs=lambda: due[0])):
                got += list(zip(out["request_id"], out["verdict"], out["key_0"]))
        passed = [r for r in data if (r[0] // stateful.SECOND + 1) * 1000 <= mark]
        assert [g[0] for g in got] == [r[1] for r in passed]
    state = None
    for (at, n), (_, verdict, key) in zip(data, got):
        state, want = walk(state, (at, n))
        assert (verdict, key) == (want, "k")
    assert len(got) == len(data) - 1 and len(held.timers) > 0
    if dense == 1000:
        assert held.calls < len(data) / 2


def test_idle_clients_leave_the_state(spark, tmp_path):
    from tidewater.streaming import stateful

    hit_type = "request_id bigint, client string, ts timestamp"
    for n, (client, minutes) in enumerate([("a", 0), ("b", 1), ("c", 200), ("c", 400), ("c", 600)]):
        spark.createDataFrame([(n, client, BASE + timedelta(minutes=minutes))], hit_type).coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "h"))
    stream = stateful.admit_stream(spark.readStream.schema(hit_type).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "h")), 3, 60)
    collect_stream(stream, tmp_path, "idle")
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "state").load(str(tmp_path / "idle-checkpoint"))
    assert {r["key"]["client"] for r in state.collect()} <= {"c"}


def test_batches_are_counted_while_they_are_written(spark, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    frame = spark.createDataFrame([(1, DAY, "a"), (2, DAY, "a"), (3, DAY, "b"), (4, DAY, None)], "n int, date date, way string").repartition(3)
    path, noted = str(tmp_path / "out"), str(tmp_path / "noted")

    def emit(name):
        return lambda tagged, label: sinks.write_day_partitions(tagged.where(F.col("way") == name).drop("way"), f"{path}-{name}", label)

    write = sinks.routed_sink("l", "d", lambda b: b, "way", {"c": emit("c"), "a": emit("a"), "b": emit("b")}, noted)
    for _ in range(2):  # a repeated batch leaves one copy, of rows and of counts
        write(frame, 7)
    assert rows(spark.read.parquet(f"{path}-a"), "n") == [(1,), (2,)] and rows(spark.read.parquet(f"{path}-b"), "n") == [(3,)]
    assert rows(sinks.metrics_frame(spark, noted), "batch_id", "outcome", "rows") == [(7, "a", 2), (7, "b", 1)]
    spark.sparkContext.setJobGroup("plain", "plain")
    sinks.plain_sink("l", "e", f"{path}-e")(frame.drop("way"), 1)
    jobs = len(tracker.getJobIdsForGroup("plain"))
    spark.sparkContext.setJobGroup("before", "before")
    counted = frame.drop("way").persist()
    counted.count()
    sinks.write_day_partitions(counted, f"{path}-f", "x")
    assert jobs < len(tracker.getJobIdsForGroup("before"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    sinks.plain_sink("l", "e", f"{path}-g", noted)(frame.drop("way").where("n > 9"), 1)
    assert sinks.metrics_frame(spark, noted).where("dataset = 'e'").count() == 0


def test_a_session_made_elsewhere_gets_a_state_store_for_keyed_state(spark):
    from tidewater.session import STATE_STORE, adopt

    other, key = spark.newSession(), "spark.sql.streaming.stateStore.providerClass"
    other.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    assert adopt(other).conf.get(key) == STATE_STORE and spark.conf.get(key) == STATE_STORE
