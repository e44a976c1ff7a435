import json
import random
from datetime import timedelta

from pyspark.sql import functions as F

from samples import BASE, rows
from tidewater import contracts as C
from tidewater.operators import assurance, conformity, intake, refine

ISO = "2026-07-01T12:00:00Z"


def envelope(**changes):
    doc = {"event_id": "e1", "event_type": C.ORDER_CREATED, "schema_version": "1.0.0", "occurred_at": ISO,
           "producer": "order-service", "correlation_id": "c1", "causation_id": None,
           "trace_context": {"traceparent": "00-a"},
           "data": {"order_id": "o1", "customer_id": "u1", "order_total": 19.98,
                    "items": [{"sku": "SKU-1", "qty": 2, "unit_price": 9.99}]}}
    doc.update(changes)
    return json.dumps(doc)


def raw(spark, *values):
    return spark.createDataFrame([(v, "t", 0, i, BASE) for i, v in enumerate(values)], C.RAW_RECORD)


def bronze(spark, *values, at=BASE):
    return intake.bronze_rows(intake.inspect_records(raw(spark, *values)), F.lit(at))


def test_every_record_is_either_usable_or_rejected(spark):
    values = [envelope(), envelope(), "{not-json", '{"x": 1}', None, envelope(event_id=None),
              envelope(event_type=None), envelope(event_id=None, event_type=None), "[1]", ""]
    seen = intake.inspect_records(raw(spark, *values))
    good, bad = intake.bronze_rows(seen), intake.bronze_rejects(seen)
    assert rows(good, "kafka_offset") == [(0,), (1,), (5,), (6,)]
    assert rows(bad, "kafka_offset", "reason") == sorted(
        [(2, intake.NO_ENVELOPE), (3, intake.NO_ENVELOPE), (4, intake.EMPTY_VALUE), (7, intake.NO_ENVELOPE),
         (8, intake.NO_ENVELOPE), (9, intake.NO_ENVELOPE)], key=repr)


def test_bronze_keeps_payload_text_and_survives_a_bad_time(spark):
    row = bronze(spark, envelope()).first()
    assert json.loads(row["data_json"])["order_total"] == 19.98
    assert row["traceparent"] == "00-a" and str(row["date"]) == "2026-07-01"
    odd = bronze(spark, envelope(occurred_at="nope", trace_context=None)).first()
    assert odd["date"] is None and odd["traceparent"] is None


def judged(spark, *values, at=BASE, event_type=C.ORDER_CREATED):
    return refine.candidates(bronze(spark, *values, at=at), event_type)


def test_payload_becomes_typed_columns(spark):
    row = judged(spark, envelope()).first()
    assert row["order_total"] == 19.98 and row["items"][0]["sku"] == "SKU-1" and row["route"] == refine.ON_TIME
    assert judged(spark, envelope(data={"order_id": "o", "customer_id": "u", "order_total": "x"})).first()["order_total"] is None


def test_dead_letter_keeps_the_original_as_json_text(spark):
    doc = envelope(event_type=C.DEAD_LETTER, data={"original_event": {"event_type": "a"}, "failed_consumer": "c"})
    row = judged(spark, doc, event_type=C.DEAD_LETTER).first()
    assert json.loads(row["original_event"]) == {"event_type": "a"}


def test_first_reason_wins_and_nothing_vanishes(spark):
    bad = {
        "unknown_schema_version": [envelope(schema_version="9.9.9"), envelope(schema_version=None)],
        "missing_event_id": [envelope(event_id=None, occurred_at="x")],
        "invalid_timestamp": [envelope(occurred_at="x", data={})],
        "missing_required_field:order_id": [envelope(data={})],
        "missing_required_field:customer_id": [envelope(data={"order_id": "o"})],
    }
    values = [v for group in bad.values() for v in group] + [envelope()]
    got = judged(spark, *values)
    assert got.count() == len(values)
    want = [(reason, refine.REJECTED) for reason, group in bad.items() for _ in group] + [(None, refine.ON_TIME)]
    assert rows(got, "defect", "route") == sorted(want, key=repr)
    same = refine.judged_any(bronze(spark, *values))
    assert rows(same, "defect", "route") == rows(got, "defect", "route")


def test_lateness_is_strict_and_unknown_arrival_is_prompt(spark):
    assert judged(spark, envelope(), at=BASE + timedelta(seconds=600)).first()["route"] == refine.ON_TIME
    assert judged(spark, envelope(), at=BASE + timedelta(seconds=601)).first()["route"] == refine.LATE
    assert judged(spark, envelope(), at=None).first()["route"] == refine.ON_TIME


def test_destinations_partition_the_events(spark):
    got = judged(spark, envelope(), envelope(schema_version=None), at=BASE)
    parts = [refine.destination(got, r) for r in (refine.ON_TIME, refine.LATE, refine.REJECTED)]
    assert [p.count() for p in parts] == [1, 0, 1]
    assert "occurred_at" in parts[0].columns and "event_time" not in parts[0].columns
    assert {"_late", "dropped_reason"} <= set(parts[1].columns)
    assert parts[2].first()["_rejection_reason"] == "unknown_schema_version"


def test_deduplication_keeps_the_lowest_position_and_is_idempotent(spark):
    df = judged(spark, envelope(), envelope(event_id="e2"), envelope(), envelope(event_id=None), envelope(event_id=None))
    once = refine.distinct_events(df)
    assert rows(once, "event_id", "kafka_offset") == sorted([("e1", 0), ("e2", 1), (None, 3)], key=repr)
    assert rows(refine.distinct_events(once), "event_id", "kafka_offset") == rows(once, "event_id", "kafka_offset")


def test_contract_report_tells_absent_from_wrong(spark):
    df = bronze(spark, envelope(), envelope(data={"order_id": "o", "order_total": "x"}))
    found = {r["field"]: (r["absent"], r["wrong_type"]) for r in conformity.contract_report(df, C.ORDER_CREATED).collect()}
    assert found["order_id"] == (0, 0) and found["customer_id"] == (1, 0) and found["order_total"] == (0, 1)


def test_causation_classes(spark):
    df = spark.createDataFrame(
        [("a", C.ORDER_CREATED, "c", None), ("b", C.ORDER_VALIDATED, "c", "a"), ("d", C.ORDER_VALIDATED, "other", "a"),
         ("e", C.ORDER_FAILED, "c", None)],
        "event_id string, event_type string, correlation_id string, causation_id string")
    assert rows(conformity.causation_classes(df), "event_id", "causation") == [
        ("a", "root"), ("b", "ok"), ("d", "orphan"), ("e", "non_root_without_parent")]


def test_contract_findings_at_any_depth(spark):
    from tidewater.operators import conformity

    created = C.ORDER_CREATED
    payloads = [
        (created, "1.0.0", '{"order_id":"o","customer_id":"c","items":[{"sku":"s","qty":1,"unit_price":2}],"order_total":2.5,'
                           '"currency":"EUR","idempotency_key":"i"}'),
        (created, "1.0.0", '{"order_id":7,"customer_id":null,"items":[{"sku":"s","qty":"x"},{"sku":"t","qty":1.5,"unit_price":1e3,"odd, name":1}],'
                           '"order_total":1,"currency":"EUR","idempotency_key":"i","extra":{"deep":[1,"a"]}}'),
        (created, "1.0.0", "[1]"), (created, "1.0.0", "{bad"), (created, "1.0.0", None), (created, "1.0.0", '{"items":{"sku":"s"}}'),
        (C.ORDER_FAILED, "1.0.0", '{"order_id":"o","failed_step":"s","reason":"r","compensations_applied":["a",1]}'),
        (C.ORDER_FAILED, "1.0.0", '{"order_id":"o","failed_step":"s","reason":"r","compensations_applied":[]}'),
        (C.FULFILLMENT_ASSIGNED, "1.0.0", '{"score_breakdown":{"stock":1,"more":2}}'), (created, "2.0.0", "{}"), ("x", None, "{}"),
    ]
    bronze = spark.createDataFrame(payloads, "event_type string, schema_version string, data_json string").repartition(3)
    got = {(r["event_type"], r["schema_version"], r["field"], r["status"]): (r["containers"], r["missing"], r["drifted"], r["extra"])
           for r in conformity.contract_findings(bronze).collect()}
    assert got[created, "1.0.0", "order_id", "declared"] == (6, 4, 1, 0)
    assert got[created, "1.0.0", "customer_id", "declared"] == (6, 5, 0, 0)
    assert got[created, "1.0.0", "items", "declared"] == (6, 3, 1, 0)
    assert got[created, "1.0.0", "items[].qty", "declared"] == (3, 0, 2, 0)
    assert got[created, "1.0.0", "items[].unit_price", "declared"] == (3, 1, 0, 0)
    assert got[created, "1.0.0", "items[].odd, name", "extra"] == (1, 0, 0, 1)
    assert got[created, "1.0.0", "extra", "extra"][3] == got[created, "1.0.0", "extra.deep", "extra"][3] == 1
    assert got[C.ORDER_FAILED, "1.0.0", "compensations_applied", "declared"] == (2, 0, 1, 0)
    assert got[C.FULFILLMENT_ASSIGNED, "1.0.0", "score_breakdown.more", "extra"][3] == 1
    assert got[C.FULFILLMENT_ASSIGNED, "1.0.0", "score_breakdown.distance", "declared"] == (1, 1, 0, 0)
    assert got[C.FULFILLMENT_ASSIGNED, "1.0.0", "order_id", "declared"] == (1, 1, 0, 0)
    assert got[created, "2.0.0", "*", "unknown_contract"][0] == got["x", None, "*", "unknown_contract"][0] == 1


def test_decisions_equal_those_of_the_kept_rows(spark):
    """Copies of an id with other verdicts, missing positions, and no sort of whole rows before the aggregate."""
    rng = random.Random(8)
    places = [(p, o) for p in (None, 0, 1, 5) for o in (None, 0, 7, (1 << 62) + 1, (1 << 62) + 2)]
    data = []
    for kind in (C.ORDER_CREATED, C.ORDER_SHIPPED, "order.returned"):
        for i in range(40):
            for place, offset in rng.sample(places, 4):
                data.append((f"e{i}" if i else None, kind, rng.choice(["1.0.0", "1.0.0", "9", None]),
                             rng.choice(["2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", "never"]),
                             rng.choice(['{"order_id":"O1","items":[],"node_id":"N"}', "{}"]), place, offset, rng.randrange(1200)))
    bronze = spark.createDataFrame(data, "event_id string, event_type string, schema_version string, occurred_at string,"
                                         " data_json string, kafka_partition int, kafka_offset bigint, s int") \
        .withColumn("ingested_at", F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, 0, s)")).drop("s").distinct()
    # One copy a position and id: of equal positions either may be kept.
    bronze = bronze.dropDuplicates(["event_id", "event_type", "kafka_partition", "kafka_offset"]).localCheckpoint()
    judged = refine.judged_any(bronze)
    columns = ("event_id", "event_type", "kafka_partition", "kafka_offset", "ingested_at", "defect", "route")
    kept = refine.distinct_events(judged.select(*columns), "event_type", "event_id")
    names = ("event_type", "event_id", "defect", "route")
    found = refine.decisions(judged)
    assert sorted(map(str, found.select(*names).collect())) == sorted(map(str, kept.select(*names).collect()))
    assert found.select("route").distinct().count() == 3
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    known = kept.where(F.col("event_type").isin(*C.EVENT_TYPES))
    layer = "case route when 'on_time' then 'silver' when 'late' then 'late' else 'rejects' end as layer"
    stacked = assurance.layer_rows(bronze, "bronze").unionByName(known.selectExpr(layer, "event_type", "event_id", "ingested_at"))
    assert sorted(map(str, assurance.reconciliation_of_bronze(bronze, C.EVENT_TYPES).collect())) \
        == sorted(map(str, assurance.reconciliation(stacked).collect()))


def test_payloads_of_equal_names_and_types_are_read_once(spark):
    texts = ['{"a":"x","b":[1,2.5,-30],"c:1,":{"d":"y z","é":0.25}}', '{"a":"","b":[7,30.5,0],"c:1,":{"d":":1,","é":1.0}}',
             '{"a":":\\"k","b":[]}', '{"a":"x\\\\","b":[1],"c":"d"}', '{"a":[],"b":["x"]}', '{"a":[1],"b":{}}', '{"a":[1.0e3,1E5]}',
             '{"a":01}', '{"a":1abc}', '{"a":--5}', '{"a":1.}', '{"a":1234567890123456789012}', '{"a":1234567890123456789}',
             '{ "a" : 1 , "1" : true, "b":null }', '"text"', "17", "", "{bad", '{"a":1,"a":2}', '{"a":"\x01"}', '{"a":"x" 1}', None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    cut = conformity.blanked(rows.withColumn("was", F.col("text")), "text")
    shape = "regexp_replace(schema_of_variant(try_parse_json({})), '[(][0-9,]+[)]', '')"
    got = cut.withColumn("now", conformity.readable("text", "is_blanked")).selectExpr(
        "i", "text", f"{shape.format('was')} as before", f"{shape.format('now')} as after").orderBy("i").collect()
    assert [r.before for r in got] == [r.after for r in got]
    assert got[0].text == got[1].text != texts[0] and got[3].text == texts[3]
    assert [r.before is None for r in got].count(True) >= 9
