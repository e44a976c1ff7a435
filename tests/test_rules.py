import random
import re
from collections import deque
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samples import BASE, rows
from tidewater import contracts as C
from tidewater import session
from tidewater.operators import allocation, conformity, lifecycle, requests, scoring, skew


def nodes(spark, *data):
    return spark.createDataFrame(list(data), "node_id string, latitude double, longitude double, capacity_per_day int, "
                                             "current_backlog int, active boolean")


def score(spark, *sites):
    candidates = spark.createDataFrame([("o", s[0]) for s in sites], "order_id string, node_id string")
    who = spark.createDataFrame([("o", "customer-1")], "order_id string, customer_id string")
    return {r["node_id"]: r for r in scoring.ranked(scoring.node_scores(candidates, who, nodes(spark, *sites))).collect()}


def test_single_candidate_gets_full_marks(spark):
    only = score(spark, ("n1", 10.0, 10.0, 100, 0, True))["n1"]
    assert only["score"] == 1.0 and only["rank"] == 1 and only["score_breakdown"]["backlog"] == 1.0


def test_lower_backlog_and_nearer_win_and_zero_capacity_is_safe(spark):
    got = score(spark, ("n1", 10.0, 10.0, 100, 90, True), ("n2", 10.0, 10.0, 100, 10, True))
    assert got["n2"]["rank"] == 1
    got = score(spark, ("n1", 10.0, 10.0, 0, 5, True), ("n2", 10.0, 10.0, 100, 5, True))
    assert got["n1"]["score_breakdown"]["backlog"] == 0.0 and got["n1"]["score_breakdown"]["capacity"] == 0.0


def test_serving_nodes_need_every_line_and_an_active_node(spark):
    lines = spark.createDataFrame([("o", "a", 2), ("o", "a", 5), ("o", "b", 1), ("p", "z", 1)],
                                  "order_id string, sku string, qty bigint")
    stock = spark.createDataFrame([("a", "n1", 5), ("b", "n1", 1), ("a", "n2", 4), ("b", "n2", 9), ("a", "n3", 9), ("b", "n3", 9)],
                                  "sku string, node_id string, available_qty int")
    sites = nodes(spark, ("n1", 0.0, 0.0, 1, 0, True), ("n2", 0.0, 0.0, 1, 0, True), ("n3", 0.0, 0.0, 1, 0, False))
    assert rows(scoring.serving_nodes(lines, stock, sites)) == [("o", "n1")]


def test_sufficiency_singly_and_summed(spark):
    wanted = spark.createDataFrame([("o", "n", "a", 3), ("o", "n", "a", 3)], "order_id string, node_id string, sku string, qty bigint")
    stock = spark.createDataFrame([("a", "n", 5)], "sku string, node_id string, available_qty int")
    assert scoring.stock_sufficiency(wanted, stock).first()["sufficient"]
    assert not scoring.stock_sufficiency(wanted, stock, sum_by_sku=True).first()["sufficient"]


def brute_reserve(requests_, stock):
    left, out = dict(stock), []
    for seq, sku, node, qty in sorted(requests_):
        key = (sku, node)
        if key not in left:
            out.append((seq, "unknown_stock", None))
        else:
            granted = qty <= left[key]
            out.append((seq, "reserved" if granted else "rejected", left[key]))
            left[key] -= qty if granted else 0
    return sorted(out)


@pytest.mark.parametrize("bound", [1000, 3])
def test_reservation_equals_serial_processing(spark, bound):
    rng = random.Random(11)
    stock = {(f"s{i}", "n"): rng.choice([0, 1, 7, 40, 90]) for i in range(5)}
    asks = [(i, f"s{rng.randrange(6)}", "n", rng.choice([1, 2, 3, 8, 30, 60, 90])) for i in range(160)]
    df = spark.createDataFrame(asks, "seq bigint, sku string, node_id string, qty bigint").withColumn("order_id", F.lit("o"))
    held = spark.createDataFrame([(s, n, q, 10) for (s, n), q in stock.items()],
                                 "sku string, node_id string, available_qty int, reorder_threshold int")
    got = allocation.reserve(df, held, ["seq"], bound=bound)
    assert sorted(tuple(r) for r in got.select("seq", "outcome", "available_before").collect()) == brute_reserve(asks, stock)
    assert got.where("outcome = 'reserved' and available_after < 0").count() == 0
    assert allocation.low_stock(got).where("available_qty > threshold").count() == 0


def test_smaller_request_after_a_refused_one(spark):
    df = spark.createDataFrame([(1, "s", "n", 5), (2, "s", "n", 2)], "seq bigint, sku string, node_id string, qty bigint")
    held = spark.createDataFrame([("s", "n", 3, 0)], "sku string, node_id string, available_qty int, reorder_threshold int")
    assert rows(allocation.reserve(df, held, ["seq"]), "seq", "outcome") == [(1, "rejected"), (2, "reserved")]


def brute_replay(asks):
    state, out = {}, []
    for order, seq, to, expected, node in sorted(asks, key=lambda a: (a[0], a[1])):
        status, version = state.get(order, ("CREATED", 1))
        if to not in C.NEXT_STATES[status]:
            verdict = "invalid"
        elif to == "FULFILLMENT_ASSIGNED" and node is None:
            verdict = "missing_node"
        elif expected != version:
            verdict = "conflict"
        else:
            verdict = "applied"
        out.append((order, seq, status, version, verdict))
        state[order] = (to, version + 1) if verdict == "applied" else (status, version)
    return sorted(out)


@pytest.mark.parametrize("bound", [1000, 2])
def test_replay_equals_serial_processing(spark, bound):
    rng = random.Random(5)
    states = list(C.NEXT_STATES)
    asks = [(f"o{rng.randrange(4)}", i, states[min(9, max(1, rng.randrange(1, 10)))], rng.randrange(1, 6),
             rng.choice([None, "n", "n"])) for i in range(200)]
    df = spark.createDataFrame(asks, "order_id string, seq bigint, to_status string, expected_version bigint, node_id string")
    got = lifecycle.replay_states(df, bound=bound)
    assert sorted(tuple(r) for r in got.select("order_id", "seq", "status_before", "version_before", "verdict").collect()) \
        == brute_replay(asks)


@pytest.mark.parametrize("bound", [1000, 2])
def test_previous_value_and_audit(spark, bound):
    steps = ["CREATED", "VALIDATED", "INVENTORY_PENDING", "SHIPPED"]
    data = [("o", steps[i - 1] if i else None, s, BASE + timedelta(minutes=i)) for i, s in enumerate(steps)]
    data += [("p", "VALIDATED", "INVENTORY_PENDING", BASE), ("p", "VALIDATED", "FAILED", BASE + timedelta(minutes=1))]
    df = spark.createDataFrame(data, "order_id string, from_status string, to_status string, changed_at timestamp")
    got = rows(lifecycle.transition_audit(df, bound), "order_id", "to_status", "finding")
    assert got == [("o", "CREATED", "ok"), ("o", "INVENTORY_PENDING", "ok"), ("o", "SHIPPED", "illegal_transition"),
                   ("o", "VALIDATED", "ok"), ("p", "FAILED", "discontinuous"), ("p", "INVENTORY_PENDING", "bad_start")]


def test_running_sum_in_segments(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < .8 else "k", i, rng.randrange(10)) for i in range(300)]
    df = spark.createDataFrame(data, "k string, i bigint, v bigint")
    got = skew.running_sum(skew.in_segments(df, ["k"], ["i"], 5), ["k"], ["i"], F.col("v"), "total")
    total, want = {}, []
    for k, i, v in data:
        total[k] = total.get(k, 0) + v
        want.append((k, i, total[k]))
    assert rows(got, "k", "i", "total") == sorted(want, key=repr)


def test_exact_quantiles(spark):
    rng = random.Random(2)
    data = [("a", rng.expovariate(1)) for _ in range(500)] + [("b", 7.0)] * 9 + [("c", float(i)) for i in range(2)]
    data += [("d", v) for v in (*(rng.random() for _ in range(300)), 1e15)]
    df = spark.createDataFrame(data, "g string, v double")
    probs = {"p50": .5, "p95": .95}
    for segments in (8, 3):
        for r in skew.exact_quantiles(df, ["g"], "v", probs, segments).collect():
            values = [v for g, v in data if g == r["g"]]
            assert [r["p50"], r["p95"]] == pytest.approx(list(np.quantile(values, [.5, .95])))
    overall = skew.exact_quantiles(df, [], "v", probs)
    assert list(overall.first()) == pytest.approx(list(np.quantile([v for _, v in data], [.5, .95])))
    assert "NestedLoop" not in overall._jdf.queryExecution().toString()


@pytest.mark.parametrize("bound", [0, 2, 1000])
def test_replay_of_tied_requests_does_not_depend_on_size(spark, bound):
    asks = [("o", 1, "VALIDATED", 1, None), ("o", 2, "INVENTORY_PENDING", 2, None), ("o", 2, "INVENTORY_RESERVED", 3, None),
            ("o", 2, "INVENTORY_PENDING", 2, None), ("o", None, "VALIDATED", 1, None), ("p", 1, "VALIDATED", None, None),
            ("p", 1, "VALIDATED", 1, None), ("p", 1, "VALIDATED", 1, None)]
    df = spark.createDataFrame(asks, "order_id string, seq bigint, to_status string, expected_version bigint, node_id string")
    got = lifecycle.replay_states(df, bound)
    want = lifecycle.replay_states(df, 10_000)
    assert rows(got, *sorted(got.columns)) == rows(want, *sorted(got.columns))
    assert got.where("verdict = 'applied'").count() == 4


def brute_limit(hits, limit, seconds):
    state, out = {}, []
    for rid, client, at in sorted(hits, key=lambda h: (h[1], h[2], h[0])):
        window = state.setdefault(client, deque())
        while window and (at - window[0]).total_seconds() > seconds:
            window.popleft()
        ok = len(window) < limit
        if ok:
            window.append(at)
        out.append((rid, ok))
    return sorted(out)


def test_rate_limit_equals_serial_processing(spark):
    rng, hits, at = random.Random(9), [], BASE
    for i in range(400):
        at += timedelta(seconds=rng.choice([0, 1, 5, 20, 60, 61, 200]) if rng.random() < .4 else 2)
        hits.append((i, f"c{rng.randrange(2)}", at))
    df = spark.createDataFrame(hits, "request_id bigint, client string, ts timestamp")
    got = sorted(tuple(r) for r in requests.rate_limit(df, limit=4, seconds=60).select("request_id", "admitted").collect())
    assert got == brute_limit(hits, 4, 60)
    counted = {r["request_id"]: r["hits"] for r in requests.window_hits(df, 60).collect()}
    for rid, client, when in hits:
        assert counted[rid] == sum(1 for _, c, t in hits if c == client and 0 <= (when - t).total_seconds() <= 60)


def test_idempotency(spark):
    df = spark.createDataFrame(
        [("k", "r1", "a", BASE), ("k", "r2", "a", BASE + timedelta(days=3)), ("k", "r3", "b", BASE + timedelta(seconds=1))],
        "idempotency_key string, request_id string, body string, received_at timestamp")
    assert rows(lifecycle.resolve_idempotency(df, ["body"]), "request_id", "resolution") == [
        ("r1", "created"), ("r2", "replayed"), ("r3", "conflict")]


def test_replay_set_and_mark(spark):
    doc = '{"event_id":"e","event_type":"order.created"}'
    dead = spark.createDataFrame([("d1", doc, None), ("d2", doc, BASE)],
                                 "dead_letter_id string, original_event string, replayed_at timestamp")
    sent = lifecycle.replay_set(dead)
    assert rows(sent, "dead_letter_id", "topic", "key", "replay") == [("d1", "order.created", "e", "send")]
    assert lifecycle.replay_set(dead, "d2").first()["replay"] == "already_replayed"
    assert lifecycle.mark_replayed(dead, sent, F.lit(BASE)).where("replayed_at is null").count() == 0


def test_stock_upsert_and_expiry(spark):
    stock = spark.createDataFrame([("a", "n", 5, 2, 10, 1)], "sku string, node_id string, available_qty int, reserved_qty int, "
                                                             "reorder_threshold int, version int")
    changes = spark.createDataFrame([("a", "n", 9, 3, 2), ("a", "n", 7, 3, 1), ("b", "n", 1, 0, 1)],
                                    "sku string, node_id string, available_qty int, reorder_threshold int, seq bigint")
    assert rows(allocation.upsert_stock(stock, changes)) == [("a", "n", 9, 3, 3), ("b", "n", 1, 0, 1)]
    held = spark.createDataFrame([("a", "n", 2, "ACTIVE", BASE), ("a", "n", 1, "RELEASED", BASE)],
                                 "sku string, node_id string, qty int, status string, expires_at timestamp")
    assert allocation.expired(held, F.lit(BASE)).count() == 0
    ended = allocation.expired(held, F.lit(BASE + timedelta(seconds=1)))
    got = allocation.give_back(stock, ended).first()
    assert (got["available_qty"], got["reserved_qty"], got["version"]) == (7, 0, 2)


def serial_rounds(orders, lines, choices, stock, rounds):
    """The stated rounds of the fallback allocation, one order and one line at a time."""
    left, need, out = dict(stock), {}, {}
    for order, sku, qty in lines:
        need.setdefault(order, {}).setdefault(sku, 0)
        need[order][sku] += qty
    for turn in range(1, rounds + 1):
        asked, won = {}, []
        for order in [o for o, _ in sorted(orders, key=lambda x: (x[1], x[0])) if o not in out and len(choices.get(o, [])) >= turn]:
            node, granted = choices[order][turn - 1], True
            for sku, qty in need.get(order, {}).items():
                asked[sku, node] = asked.get((sku, node), 0) + qty
                granted &= asked[sku, node] <= left.get((sku, node), 0)
            if granted:
                won.append((order, node))
        for order, node in won:
            out[order] = (node, turn)
            for sku, qty in need.get(order, {}).items():
                left[sku, node] = left.get((sku, node), 0) - qty
    assert all(v >= 0 for v in left.values())
    return out


@pytest.mark.parametrize("seed, rounds", [(1, 3), (2, 6), (3, 1)])
def test_fallback_allocation_equals_its_rounds_walked_serially(spark, seed, rounds):
    rng = random.Random(seed)
    orders = [(f"o{i}", rng.randrange(40)) for i in range(300)]
    lines = [(o, f"s{min(rng.randrange(12), rng.randrange(12))}", rng.randint(1, 6)) for o, _ in orders[5:] for _ in range(rng.randint(1, 4))]
    nodes = [f"n{i}" for i in range(6)]
    choices = {o: rng.sample(nodes, rng.randint(0, 6)) for o, _ in orders}
    stock = {(f"s{s}", n): rng.randint(0, 120) for s in range(12) for n in nodes if rng.random() < 0.9}
    got = allocation.allocate_with_fallback(
        spark.createDataFrame(orders, "order_id string, at int"), spark.createDataFrame(lines, "order_id string, sku string, qty bigint"),
        spark.createDataFrame([(o, n, r) for o, c in choices.items() for r, n in enumerate(c, 1)], "order_id string, node_id string, rank int"),
        spark.createDataFrame([(*k, v) for k, v in stock.items()], "sku string, node_id string, available_qty int"),
        ["at"], None if rounds == 6 else rounds)
    want = serial_rounds(orders, lines, choices, stock, rounds)
    failed = {o: "no inventory" if not c else "all nodes refused" for o, c in choices.items()}
    assert rows(got) == sorted(((o, *want.get(o, (None, None)), None if o in want else failed[o]) for o, _ in orders), key=repr)
    assert {r for _, r in want.values()} == set(range(1, max(r for _, r in want.values()) + 1))


def test_fallback_allocation_frees_each_round(spark, monkeypatch):
    """Only the result's two tables stay on disk, and no step is written as a checkpoint, whose rows are neither packed nor deleted."""
    made, gone, path, drop = [], [], session.scratch_path, session.delete
    monkeypatch.setattr(session, "scratch_path", lambda spark, label: made.append(path(spark, label)) or made[-1])
    monkeypatch.setattr(session, "delete", lambda spark, at: gone.append(at) or drop(spark, at))
    monkeypatch.setattr(DataFrame, "checkpoint", None)
    got = allocation.allocate_with_fallback(
        spark.createDataFrame([(f"o{i}", i) for i in range(4)], "order_id string, at int"),
        spark.createDataFrame([(f"o{i}", "s", 2) for i in range(4)], "order_id string, sku string, qty bigint"),
        spark.createDataFrame([(f"o{i}", n, r) for i in range(4) for r, n in enumerate("ab", 1)], "order_id string, node_id string, rank int"),
        spark.createDataFrame([("s", "a", 4), ("s", "b", 2)], "sku string, node_id string, available_qty int"), ["at"])
    assert rows(got) == [("o0", "a", 1, None), ("o1", "a", 1, None), ("o2", "b", 2, None), ("o3", None, None, "all nodes refused")]
    assert {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(made) - set(gone)} == {"fallback-nodes", "fallback-known"}
    assert spark.conf.get(session.CLEANUP, "false") == "false"


def test_steps_count_in_order_only_however_many_events_a_correlation_has(spark):
    steps = lifecycle.FUNNEL
    rng = random.Random(4)
    data = [("c%d" % rng.randrange(30), rng.choice([*steps, C.ORDER_CANCELLED]), BASE + timedelta(seconds=rng.randrange(40))) for _ in range(500)]
    data += [("same", s, BASE) for s in steps] + [("back", s, BASE - timedelta(seconds=i)) for i, s in enumerate(steps)]
    data += [(None, steps[0], BASE), ("none", C.ORDER_CANCELLED, BASE), ("timeless", steps[0], None)]
    events = spark.createDataFrame(data, "correlation_id string, event_type string, occurred_at timestamp")
    want = {}
    for c in {c for c, e, at in data if c is not None and at is not None and e in steps}:
        reached, front = 0, None
        for i, step in enumerate(steps):
            times = [at for cc, e, at in data if cc == c and e == step and at is not None and (front is None or at >= front)]
            if not times:
                break
            reached, front = i + 1, min(times)
        want[c] = (reached, front)
    for bound in (1000, 3):
        got = {r[0]: (r[1], r[2]) for r in lifecycle.steps_reached(events, bound=bound).collect()}
        assert got == want
    assert want["same"][0] == 6 and want["back"][0] == 1


def test_failure_is_read_from_the_payload(spark):
    events = spark.createDataFrame([
        ("a", C.ORDER_CREATED, BASE, "{}"), ("a", C.ORDER_FAILED, BASE + timedelta(seconds=9), '{"failed_step":"later"}'),
        ("a", C.ORDER_FAILED, BASE, '{"failed_step":"pay","compensations_applied":["x","y"]}'),
        ("b", C.ORDER_FAILED, BASE, "{bad"), ("c", C.ORDER_CANCELLED, BASE, None), ("d", C.ORDER_CREATED, BASE, None),
    ], "correlation_id string, event_type string, occurred_at timestamp, data_json string")
    paths = lifecycle.workflow_paths(events)
    assert rows(paths, "correlation_id", "reached", "outcome", "failed_step", "compensations") == [
        ("a", 1, "failed", "pay", ["x", "y"]), ("b", 0, "failed", None, []), ("c", 0, "cancelled", None, None), ("d", 1, "open", None, None)]
    assert rows(lifecycle.funnel(paths)) == [(1, C.ORDER_CREATED, 2, 1, 0, 1, 1)]


@pytest.mark.parametrize("active", [150, 0])
def test_serving_nodes_equal_testing_each_node(spark, active):
    rng = random.Random(9)
    sites = [(f"n{i:03}", 0.0, 0.0, 1, 0, i < active) for i in range(160)]
    stock = {(f"s{s}", n[0]): rng.randrange(10) for s in range(6) for n in sites if rng.random() < 0.9}
    lines = [(f"o{o}", f"s{rng.randrange(7)}", rng.randrange(1, 8)) for o in range(60) for _ in range(rng.randint(1, 3))]
    got = scoring.serving_nodes(spark.createDataFrame(lines, "order_id string, sku string, qty bigint"),
                                spark.createDataFrame([(*k, v) for k, v in stock.items()], "sku string, node_id string, available_qty int"),
                                nodes(spark, *sites))
    want = [(o, n[0]) for o in {x[0] for x in lines} for n in sites if n[5]
            and all(stock.get((sku, n[0]), -1) >= qty for order, sku, qty in lines if order == o)]
    assert rows(got, "order_id", "node_id") == sorted(want, key=repr)


def test_any_range_of_slices_gives_quantiles_within_the_stated_error(spark, tmp_path):
    rng = random.Random(2)
    log = [(BASE + timedelta(minutes=rng.randrange(60 * 48)), rng.choice("ab"), rng.lognormvariate(3, 1)) for _ in range(20_000)]
    log += [(BASE + timedelta(hours=5), "tied", 7.0)] * 500 + [(None, "a", 1.0), (BASE, "a", None)]
    frame = spark.createDataFrame(log, "ts timestamp, scenario string, latency_ms double").repartition(5)
    requests.latency_slices(frame).write.parquet(f"{tmp_path}/slices")
    slices = spark.read.parquet(f"{tmp_path}/slices")
    for first, last in ((0, 48), (3, 9), (47, 48)):
        low, high = BASE + timedelta(hours=first), BASE + timedelta(hours=last)
        for row in requests.latency_of_range(slices, F.lit(low), F.lit(high), {"p50": 0.5, "p99": 0.99}).collect():
            held = np.array([v for at, s, v in log if at is not None and v is not None and low <= at < high and s == row["scenario"]])
            assert row["n"] == len(held)
            for name, p in (("p50", 0.5), ("p99", 0.99)):
                assert np.mean(held < row[name]) <= p + requests.SKETCH_ERROR and np.mean(held <= row[name]) >= p - requests.SKETCH_ERROR
    assert requests.latency_of_range(slices, F.lit(BASE), F.lit(BASE), {"p50": 0.5}).count() == 0


def test_tables_as_long_as_the_orders_or_made_by_an_explode_are_never_broadcast(spark, capsys):
    """Spark takes each of these for a few kilobytes; at sixty times sf0.1 they were tens of millions of rows in the driver."""
    stock = spark.range(40).selectExpr("concat('P', id) as sku", "explode(sequence(0, 4)) as n").selectExpr(
        "sku", "concat('N', n) as node_id", "int(n * 3) as available_qty", "10 as reorder_threshold")
    asked = spark.range(40).selectExpr("concat('O', id) as order_id", "concat('C', id) as customer_id", "'N1' as node_id",
                                       "concat('P', id) as sku", "id as qty", "id as seq")
    places = nodes(spark, *((f"N{i}", 0.0, float(i), 10, 0, True) for i in range(5)))
    served = scoring.serving_nodes(asked, stock, places)
    events = asked.selectExpr("inline(array(struct(concat('a', order_id) as event_id, order_id as correlation_id,"
                              " cast(null as string) as causation_id, 'order.created' as event_type),"
                              " struct(concat('b', order_id) as event_id, order_id as correlation_id,"
                              " concat('a', order_id) as causation_id, 'order.validated' as event_type)))")
    small = {"node_id", "number", "word", "bit"}  # nodes are a dimension
    for frame in (scoring.stock_sufficiency(asked, stock), scoring.shortfalls(asked, stock), served,
                  scoring.node_scores(served, asked, places), allocation.reserve(asked, stock, ["seq"]),
                  conformity.causation_classes(events)):
        frame.explain()
        keys = [line.split("[")[1].split("]")[0] for line in capsys.readouterr().out.splitlines() if "BroadcastHashJoin" in line]
        assert all(re.sub(r"#\d+L?", "", key) in small for joined in keys for key in joined.split(", ")), keys


def test_stock_settings_are_folded_without_sorting_and_beat_the_stock_without_a_seq(spark, capsys):
    stock = spark.createDataFrame([("a", "n", 5, 1, 1)], "sku string, node_id string, available_qty int, reorder_threshold int, version int")
    changes = spark.createDataFrame([("a", "n", None, 7, None), ("b", "n", 1, 0, 4), ("b", "n", None, 2, 9)],
                                    "sku string, node_id string, available_qty int, reorder_threshold int, seq bigint")
    out = allocation.upsert_stock(stock, changes)
    assert rows(out) == [("a", "n", None, 7, 2), ("b", "n", None, 2, 2)]
    out.explain()
    assert "SortAggregate" not in capsys.readouterr().out


def test_pieces_of_millions_of_rows_are_dealt_out(spark, monkeypatch):
    from tidewater.sources import retail

    monkeypatch.setattr(retail, "ROWS_PER_PIECE", 10, raising=False)
    assert retail.spread(spark.range(95)).rdd.getNumPartitions() == 10


def test_workflow_events_are_read_once(spark):
    """Each read of them makes and parses every payload; there were four."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    plain = spark.createDataFrame([(f"c{i % 7}", kind, BASE + timedelta(seconds=i), None)
                                   for i, kind in enumerate(lifecycle.FUNNEL * 7)],
                                  "correlation_id string, event_type string, occurred_at timestamp, data_json string")
    paths = lifecycle.workflow_paths(plain.mapInPandas(counted, plain.schema))
    assert sum(r["workflows"] for r in lifecycle.workflow_measures(paths).collect()) == 7
    assert seen.value == len(lifecycle.FUNNEL) * 7


@pytest.mark.parametrize("bound", [1000, 3])
def test_paths_of_steps_before_and_after_the_one_before(spark, bound):
    rng = random.Random(4)
    data = [(f"c{rng.randrange(60)}", rng.choice(lifecycle.FUNNEL), BASE + timedelta(seconds=rng.randrange(12)), None) for _ in range(900)]
    events = spark.createDataFrame(data, "correlation_id string, event_type string, occurred_at timestamp, data_json string")
    got = rows(lifecycle.workflow_paths(events, bound=bound), "correlation_id", "reached", "reached_at")
    assert got == rows(lifecycle.steps_reached(events, bound=bound), "correlation_id", "reached", "reached_at")
