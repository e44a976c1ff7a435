"""Order states, idempotency, workflow views, dead letters and retries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater import contracts as C
from tidewater.functions import rules
from tidewater.operators import skew
from tidewater.session import by_shuffle, cut_lineage, scratch_path


def transition_audit(history: DataFrame, bound: int = skew.GROUP_BOUND) -> DataFrame:
    """Each recorded change as ok, illegal_transition, discontinuous, or bad_start (first of its order)."""
    order = ["changed_at", "to_status", "from_status"]
    chained = skew.previous_value(history, ["order_id"], order, "to_status", "before", bound)
    finding = (
        f"case when from_status is null and before is null and to_status = 'CREATED' then 'ok'"
        f" when from_status is null or before is null then 'bad_start'"
        f" when not {rules.allowed_sql('from_status', 'to_status')} then 'illegal_transition'"
        f" when from_status <> before then 'discontinuous' else 'ok' end"
    )
    return chained.withColumn("finding", F.expr(finding)).drop("before")


def replay_states(requests: DataFrame, bound: int = skew.GROUP_BOUND) -> DataFrame:
    """Fate of every status request of an order, replayed in `seq` order from CREATED, version 1.

    A request applies when the pair is allowed, a node is named where one is needed, and the version it
    expects is the current one; applying raises the version. Adds status_before, version_before, verdict.
    Requests of one `seq` follow each other by (to_status, expected_version, node_id), nulls first; of equal
    requests the first is judged first, whatever the number of rows.
    """
    cold, hot = skew.split_by_size(requests, ["order_id"], bound)
    result = _replay_cold(cold)
    return result if hot is None else result.unionByName(_replay_hot(hot))


def _replay_cold(requests: DataFrame) -> DataFrame:
    verdict = rules.verdict_sql("a.status", "a.version", "r")
    grouped = requests.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "to_status", "expected_version", "node_id"))).alias("rows")
    )
    seen = F.expr(f"""aggregate(rows,
        named_struct('status', 'CREATED', 'version', 1L,
            'seen', cast(array() as array<struct<status_before: string, version_before: bigint, verdict: string>>)),
        (a, r) -> named_struct(
            'status', if({verdict} = 'applied', r.to_status, a.status),
            'version', if({verdict} = 'applied', a.version + 1, a.version),
            'seen', array_append(a.seen, named_struct('status_before', a.status, 'version_before', a.version,
                                                     'verdict', {verdict}))),
        a -> a.seen)""")
    return grouped.withColumn("seen", seen).select("order_id", F.explode(F.arrays_zip("rows", "seen")).alias("z")).select(
        "order_id", "z.rows.*", "z.seen.*"
    )


def _replay_hot(requests: DataFrame) -> DataFrame:
    """The same for orders with very many requests, without gathering them.

    The state graph has no cycle, so an order changes state fewer times than there are states. Each round
    finds the next request that applies with one aggregate; the states passed, a handful per order, then
    tell the fate of every request. Equal requests are one row with a count: at most the first applies.
    """
    row = F.struct("seq", "to_status", "expected_version", "node_id")
    counted = requests.groupBy("order_id", row.alias("r")).agg(F.count("*").alias("copies"))
    kind = requests.select(row.alias("r")).schema["r"].dataType.simpleString()
    state = requests.select("order_id").distinct().selectExpr(
        "order_id", "'CREATED' as status", "1L as version", f"cast(null as {kind}) as since"
    )
    passed = [cut_lineage(state)]
    applies = F.expr(rules.verdict_sql("status", "version", "r")) == "applied"
    for _ in C.NEXT_STATES:
        step = (
            counted.join(passed[-1], "order_id")
            .where((F.col("since").isNull() | (F.col("r") > F.col("since"))) & applies)
            .groupBy("order_id", "version")
            .agg(F.min("r").alias("since"))
            .select("order_id", F.col("since.to_status").alias("status"), (F.col("version") + 1).alias("version"), "since")
        )
        step = cut_lineage(step)
        if step.isEmpty():
            break
        passed.append(step)
    timeline = reduce(DataFrame.unionByName, passed).groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct("version", "status", "since"))).alias("timeline")
    )
    judged = (
        counted.join(timeline, "order_id")
        .withColumn("t", F.expr("element_at(filter(timeline, t -> t.since is null or t.since < r), -1)"))
        .withColumn("verdict", F.expr(rules.verdict_sql("t.status", "t.version", "r")))
        .withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    )
    moved = (F.col("copy") > 1) & (F.col("verdict") == "applied")
    seen = judged.select(
        "order_id", "r.*", F.when(moved, F.col("r.to_status")).otherwise(F.col("t.status")).alias("status_before"),
        (F.col("t.version") + moved.cast("bigint")).alias("version_before"), "r",
    )
    return seen.withColumn("verdict", F.expr(rules.verdict_sql("status_before", "version_before", "r"))).drop("r")


def request_hash(columns: list[str]) -> Column:
    """SHA-256 of the request as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def resolve_idempotency(requests: DataFrame, content: list[str]) -> DataFrame:
    """Per request: created (first use of its key), replayed (same content) or conflict (other content).

    The first use comes from an aggregate, so keys used very often are combined before the shuffle.
    Expiry of a key plays no part.
    """
    hashed = requests.withColumn("request_hash", request_hash(content))
    first = hashed.groupBy("idempotency_key").agg(
        F.min_by(F.struct("request_id", "request_hash"), F.struct("received_at", "request_id")).alias("first")
    )
    resolution = (
        F.when(F.col("request_id") == F.col("first.request_id"), "created")
        .when(F.col("request_hash") == F.col("first.request_hash"), "replayed")
        .otherwise("conflict")
    )
    return hashed.join(first, "idempotency_key").select(
        "idempotency_key", "request_id", "request_hash", resolution.alias("resolution"),
        F.col("first.request_id").alias("answered_by"),
    )


def order_totals(lines: DataFrame) -> DataFrame:
    """Exact sum of quantity times unit price, as money."""
    amount = F.col("qty").cast("decimal(12,0)") * F.col("unit_price").cast("decimal(12,2)")
    return lines.groupBy("order_id").agg(F.sum(amount).cast("decimal(18,2)").alias("order_total"))


STEP_COLUMNS = {
    "created_at": C.ORDER_CREATED,
    "validated_at": C.ORDER_VALIDATED,
    "reserved_at": C.INVENTORY_RESERVED,
    "rejected_at": C.INVENTORY_REJECTED,
    "assigned_at": C.FULFILLMENT_ASSIGNED,
    "shipped_at": C.ORDER_SHIPPED,
    "failed_at": C.ORDER_FAILED,
    "cancelled_at": C.ORDER_CANCELLED,
}


def order_lifecycle(events: DataFrame) -> DataFrame:
    """Step times and outcome of every correlation, from its events in any order."""
    times = events.groupBy("correlation_id").agg(
        *[F.min(F.when(F.col("event_type") == kind, F.col("occurred_at"))).alias(name)
          for name, kind in STEP_COLUMNS.items()]
    )
    outcome = (
        F.when(F.col("shipped_at").isNotNull(), "shipped")
        .when(F.col("failed_at").isNotNull(), "failed")
        .when(F.col("cancelled_at").isNotNull(), "cancelled")
        .otherwise("open")
    )
    failed = F.col("failed_at").isNotNull() & F.col("shipped_at").isNull()
    step = F.when(failed & F.col("reserved_at").isNull(), "SELECT_AND_RESERVE").when(failed, "AUTHORIZE_PAYMENT")
    return times.withColumn("outcome", outcome).withColumn("failed_step", step).withColumn(
        "compensated", F.coalesce(F.col("failed_step") == "AUTHORIZE_PAYMENT", F.lit(False))
    )


FUNNEL = (C.ORDER_CREATED, C.ORDER_VALIDATED, C.RESERVATION_REQUESTED, C.INVENTORY_RESERVED, C.FULFILLMENT_ASSIGNED,
          C.ORDER_SHIPPED)


def steps_reached(events: DataFrame, steps: tuple[str, ...] = FUNNEL, bound: int = skew.GROUP_BOUND) -> DataFrame:
    """(correlation_id, reached, reached_at): how many of the steps each correlation took in order, and when the last.

    A step counts from its first event at or after the step before it; earlier ones, repeats and other events do not
    disturb. Events are (correlation_id, event_type, occurred_at); those without a correlation or a time are left
    out. Repeats are folded before the shuffle; a correlation of few events is walked once, in order, and one of
    more than `bound` by an aggregate per step.
    """
    known = events.where(F.col("correlation_id").isNotNull() & F.col("occurred_at").isNotNull()) \
        .select("correlation_id", "occurred_at", F.array_position(F.lit(list(steps)), F.col("event_type")).alias("step")) \
        .where("step > 0").distinct()
    cold, hot = skew.split_by_size(known, ["correlation_id"], bound)
    # At most `bound` events; at one time, later steps follow earlier ones.
    walked = cold.groupBy("correlation_id").agg(F.sort_array(F.collect_list(F.struct("occurred_at", "step"))).alias("path"))
    state = F.aggregate(
        "path", F.struct(F.lit(0).cast("bigint").alias("reached"), F.lit(None).cast("timestamp").alias("reached_at")),
        lambda s, e: F.when(e["step"] == s["reached"] + 1, F.struct(e["step"].alias("reached"), e["occurred_at"].alias("reached_at")))
        .otherwise(s))
    out = walked.select("correlation_id", state.alias("s")).select("correlation_id", "s.*")
    if hot is not None:
        front = hot.where("step = 1").groupBy("correlation_id").agg(F.min("occurred_at").alias("reached_at"))
        done = hot.select("correlation_id").distinct().select("correlation_id", F.lit(0).cast("bigint").alias("reached"),
                                                              F.lit(None).cast("timestamp").alias("reached_at"))
        for step in range(1, len(steps) + 1):
            front = cut_lineage(front)
            done = done.unionByName(front.select("correlation_id", F.lit(step).cast("bigint").alias("reached"), "reached_at"))
            front = hot.where(F.col("step") == step + 1).join(front, "correlation_id").where("occurred_at >= reached_at") \
                .groupBy("correlation_id").agg(F.min("occurred_at").alias("reached_at"))
        last = done.groupBy("correlation_id").agg(F.max("reached").alias("reached"), F.max_by("reached_at", "reached").alias("reached_at"))
        out = out.unionByName(last)
    return out


def workflow_paths(events: DataFrame, steps: tuple[str, ...] = FUNNEL, bound: int = skew.GROUP_BOUND) -> DataFrame:
    """(correlation_id, reached, reached_at, outcome, failed_step, compensations, first_at, last_at) of every correlation,
    where the step that failed and what was undone are read from the payload (data_json) of its first failure.

    The events are read once and folded to a stored row per correlation. First and last time of each step tell the path,
    but for a correlation with a step both before and well after the one that should precede it: only then are the
    events read again, for those correlations, and walked by `steps_reached`.
    """
    kind, at = F.col("event_type"), F.col("occurred_at")
    failure = F.when(kind == C.ORDER_FAILED, F.struct(
        at, F.get_json_object("data_json", "$.failed_step").alias("failed_step"),
        F.from_json(F.get_json_object("data_json", "$.compensations_applied"), "array<string>").alias("compensations")))
    known = events.where("correlation_id is not null")
    # Before the aggregate, whose sort so holds no payloads.
    narrow = known.select("correlation_id", at, kind, failure.alias("failure"))
    ends = narrow.groupBy("correlation_id").agg(
        F.min("failure").alias("failure"), F.bool_or(kind == C.ORDER_CANCELLED).alias("cancelled"),
        F.min(at).alias("first_at"), F.max(at).alias("last_at"),
        F.array(*(F.struct(F.min(F.when(kind == s, at)).alias("low"), F.max(F.when(kind == s, at)).alias("top"))
                  for s in steps)).alias("seen"))
    path = scratch_path(events.sparkSession, "workflow-ends")
    ends.write.parquet(path)
    ends = events.sparkSession.read.schema(ends.schema).parquet(path)

    def after(s: Column, step: Column) -> Column:
        taken = (s["reached"] == 0) | (step["low"] >= s["reached_at"])
        when = F.when(taken, step["low"]).when(step["top"] == s["reached_at"], step["top"])
        unsure = ~taken & (step["low"] < s["reached_at"]) & (step["top"] > s["reached_at"])
        went = s["going"] & when.isNotNull()
        return F.struct((s["reached"] + F.when(went, 1).otherwise(0)).cast("bigint").alias("reached"),
                        F.when(went, when).otherwise(s["reached_at"]).alias("reached_at"), went.alias("going"),
                        (s["unsure"] | (s["going"] & F.coalesce(unsure, F.lit(False)))).alias("unsure"))

    start = F.struct(F.lit(0).cast("bigint").alias("reached"), F.lit(None).cast("timestamp").alias("reached_at"),
                     F.lit(True).alias("going"), F.lit(False).alias("unsure"))
    walked = ends.withColumn("s", F.aggregate("seen", start, after)).select(
        "correlation_id", "failure", "cancelled", "first_at", "last_at", "s.reached", "s.reached_at", "s.unsure")
    doubtful = walked.where("unsure").select("correlation_id")
    if not doubtful.isEmpty():
        whole = steps_reached(known.join(by_shuffle(doubtful), "correlation_id", "left_semi"), steps, bound)
        exact = whole.select("correlation_id", F.struct("reached", "reached_at").alias("exact"))
        walked = walked.join(by_shuffle(exact), "correlation_id", "left").withColumns({
            c: F.when(F.col("unsure"), F.col(f"exact.{c}")).otherwise(F.col(c)) for c in ("reached", "reached_at")})
    reached = F.col("reached")
    outcome = (F.when(reached == len(steps), "shipped").when(F.col("failure").isNotNull(), "failed")
               .when(F.col("cancelled"), "cancelled").otherwise("open"))
    return walked.select(
        "correlation_id", "reached", "reached_at", outcome.alias("outcome"),
        F.when(outcome == "failed", F.col("failure.failed_step")).alias("failed_step"),
        F.when(outcome == "failed", F.coalesce("failure.compensations", F.array())).alias("compensations"), "first_at", "last_at")


def funnel(paths: DataFrame, steps: tuple[str, ...] = FUNNEL) -> DataFrame:
    """(step, event_type, reached, failed, cancelled, open, compensated): correlations that reached each step, and of
    those that went no further how they ended and how many of them had something undone."""
    here = F.col("step") == F.col("reached")
    each = paths.where("reached > 0").withColumn("step", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("reached"))))
    return each.groupBy("step").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(here & (F.col("outcome") == name)).alias(name) for name in ("failed", "cancelled", "open")),
        F.count_if(here & (F.coalesce(F.size("compensations"), F.lit(0)) > 0)).alias("compensated"),
    ).select("step", F.element_at(F.lit(list(steps)), F.col("step").cast("int")).alias("event_type"),
             F.col("n").alias("reached"), "failed", "cancelled", "open", "compensated")


def workflow_measures(paths: DataFrame) -> DataFrame:
    """(outcome, workflows, share, avg_seconds, max_seconds) by outcome: how many correlations ended so, their share
    of all, and the seconds from a correlation's first event to its last."""
    seconds = F.col("last_at").cast("double") - F.col("first_at").cast("double")
    grouped = paths.withColumn("seconds", seconds).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("workflows"), F.avg("seconds").alias("avg_seconds"), F.max("seconds").alias("max_seconds"))
    # One row per outcome.
    whole = Window.partitionBy(F.lit(1))
    return grouped.select("outcome", "workflows", (F.col("workflows") / F.sum("workflows").over(whole)).alias("share"),
                          "avg_seconds", "max_seconds")


def incident_counters(outcomes: DataFrame, letters: DataFrame) -> DataFrame:
    """(counter, label, n): refused reservations by sku, dead letters by event type, and retries by consumer."""
    refused = outcomes.where("outcome = 'rejected'").groupBy(F.col("sku").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    dead = letters.groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    retries = letters.groupBy(F.col("failed_consumer").alias("label")).agg(F.sum(F.col("attempt_count") - 1).alias("n"))
    named = [df.select(F.lit(name).alias("counter"), "label", F.col("n").cast("bigint").alias("n"))
             for name, df in (("conflict", refused), ("dead_letter", dead), ("retry", retries))]
    return reduce(DataFrame.unionByName, named)


def saga_duration(sagas: DataFrame) -> DataFrame:
    """Median and 95th percentile of seconds from start to end, by result."""
    ended = sagas.where("status <> 'RUNNING'").select(
        F.when(F.col("status") == "COMPLETED", "completed").otherwise("failed").alias("result"),
        (F.col("updated_at").cast("double") - F.col("created_at").cast("double")).alias("seconds"),
    )
    return skew.exact_quantiles(ended, ["result"], "seconds", {"p50_seconds": 0.5, "p95_seconds": 0.95})


def unreleased(failed: DataFrame, reservations: DataFrame, releases: DataFrame) -> DataFrame:
    """Reservations of failed orders that nobody released."""
    return (
        reservations.join(failed.select("order_id"), "order_id", "left_semi")
        .join(releases.select("reservation_id"), "reservation_id", "left_anti")
        .select("reservation_id", "order_id", "sku", "node_id", "qty")
    )


def stalled_sagas(sagas: DataFrame, now: Column, older_than: str) -> DataFrame:
    """Running workflows without progress for longer than `older_than`."""
    return sagas.where((F.col("status") == "RUNNING") & (F.col("updated_at") < now - F.expr(f"interval {older_than}")))


def cancelled_while_running(sagas: DataFrame, cancels: DataFrame, reservations: DataFrame) -> DataFrame:
    """Running workflows with a cancel event: they fail, and their active reservations are released."""
    held = reservations.where("status = 'ACTIVE'").groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        sagas.where("status = 'RUNNING'")
        .join(cancels.select("order_id"), "order_id", "left_semi")
        .join(held, "order_id", "left")
        .select(
            "saga_id", "order_id", F.lit("FAILED").alias("status"), F.lit("DONE").alias("current_step"),
            F.lit("cancelled by the customer before the workflow ended").alias("last_error"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("released"),
        )
    )


def capture_dead_letters(failures: DataFrame, envelope: list[str], consumer: str) -> DataFrame:
    """Dead-letter rows for failed events: the envelope as JSON, who failed, why, how often and when."""
    return failures.select(
        F.col("event_id").alias("original_event_id"),
        "event_type",
        F.to_json(F.struct(*envelope)).alias("original_event"),
        F.lit(consumer).alias("failed_consumer"),
        "error_type", "error_message", "attempt_count", "first_failed_at", "last_failed_at",
    )


def replay_set(dead: DataFrame, dead_letter_id: str | None = None) -> DataFrame:
    """Records to send again: the original envelope to its own topic under the same event id.

    Without an id every letter not yet replayed; with one, that letter, and `replay` tells when it has
    been replayed before.
    """
    chosen = dead.where(F.col("dead_letter_id") == dead_letter_id) if dead_letter_id else dead.where("replayed_at is null")
    return chosen.select(
        "dead_letter_id",
        F.get_json_object("original_event", "$.event_type").alias("topic"),
        F.get_json_object("original_event", "$.event_id").alias("key"),
        F.col("original_event").alias("value"),
        F.when(F.col("replayed_at").isNull(), "send").otherwise("already_replayed").alias("replay"),
    )


def mark_replayed(dead: DataFrame, sent: DataFrame, now: Column) -> DataFrame:
    done = sent.where("replay = 'send'").select("dead_letter_id", F.lit(True).alias("_sent"))
    return dead.join(done, "dead_letter_id", "left").withColumn(
        "replayed_at", F.when(F.col("_sent"), now).otherwise(F.col("replayed_at"))
    ).drop("_sent")


def retry_schedule(tasks: DataFrame, at: str, max_attempts: int = C.RETRY_ATTEMPTS) -> DataFrame:
    """When each attempt of a task starts, from the time of the first: one row per attempt."""
    waits = F.expr(f"sequence(1, {max_attempts})")
    return tasks.select("*", F.explode(waits).alias("attempt")).select(
        *tasks.columns, "attempt",
        F.when(F.col("attempt") < max_attempts, rules.retry_delay(F.col("attempt"))).alias("delay_seconds"),
        (F.col(at) + F.make_dt_interval(secs=F.expr(
            "aggregate(sequence(1, attempt), cast(0 as double), (a, i) -> a + if(i = 1, 0D,"
            f" least(pow(2D, i - 2) * {C.RETRY_BASE_SECONDS}D, {C.RETRY_MAX_SECONDS}D)))"
        ).cast("decimal(18,6)"))).alias("attempt_at"),
    )


def due_outbox(outbox: DataFrame, now: Column, limit: int = C.OUTBOX_BATCH) -> DataFrame:
    """The next batch to publish, oldest first. The limit is the batch size of the relay."""
    due = outbox.where("published_at is null").where(
        F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)
    )
    return due.orderBy("created_at", "outbox_id").limit(limit)


def ordered_history(history: DataFrame) -> DataFrame:
    """By order, then time: a range sort, so one long order spreads over many tasks."""
    return history.orderBy("order_id", "changed_at")


def newest_first(df: DataFrame, at: str, tie: str, condition: str | None = None) -> DataFrame:
    chosen = df.where(condition) if condition else df
    return chosen.orderBy(F.desc(at), tie)


def status_counters(sagas: DataFrame, dead: DataFrame) -> DataFrame:
    """Running, completed and failed workflows, and open dead letters."""
    counts = sagas.groupBy(F.concat(F.lit("sagas_"), F.lower("status")).alias("counter")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.unionByName(
        dead.agg(F.lit("open_dead_letters").alias("counter"), F.count_if(F.col("replayed_at").isNull()).alias("n"))
    )
