"""First-come reservation of stock, and what follows from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater import contracts as C
from tidewater.operators import skew
from tidewater.session import Scratch, brief_shuffles, by_shuffle, cut_lineage, keep

KEYS = ["sku", "node_id"]
RESERVED, REJECTED, UNKNOWN, INVALID = "reserved", "rejected", "unknown_stock", "invalid_qty"


def reserve(requests: DataFrame, stock: DataFrame, order: list[str], bound: int = skew.GROUP_BOUND) -> DataFrame:
    """Outcome of every request, first come first served per (sku, node) in the given order.

    A request is granted when enough is left; a refused one takes nothing, so a later smaller one may
    still succeed. Adds `outcome`, `available_before`, `available_after` and `reorder_threshold`.
    Keys with few requests are folded in one group, keys with many go through `_reserve_hot`.
    """
    held = stock.select(*KEYS, F.col("available_qty").cast("bigint").alias("_stock"), "reorder_threshold")
    matched = requests.join(by_shuffle(held), KEYS, "left")
    unusable = F.when(F.col("_stock").isNull(), UNKNOWN).when(F.col("qty") <= 0, INVALID)
    marked = matched.withColumn("_bad", unusable)
    refused = marked.where(F.col("_bad").isNotNull()).select(
        *requests.columns, F.col("_bad").alias("outcome"), F.col("_stock").alias("available_before"),
        F.col("_stock").alias("available_after"), "reorder_threshold",
    )
    usable = marked.where(F.col("_bad").isNull()).drop("_bad")
    cold, hot = skew.split_by_size(usable, KEYS, bound)
    decided = _reserve_cold(cold, order)
    if hot is not None:
        decided = decided.unionByName(_reserve_hot(hot, order))
    granted = F.col("qty") <= F.col("available_before")
    taken = F.when(granted, F.col("qty")).otherwise(0)
    outcomes = decided.select(
        *requests.columns,
        F.when(granted, RESERVED).otherwise(REJECTED).alias("outcome"),
        "available_before",
        (F.col("available_before") - taken).alias("available_after"),
        "reorder_threshold",
    )
    return outcomes.unionByName(refused)


def _reserve_cold(rows: DataFrame, order: list[str]) -> DataFrame:
    """One ordered fold per key: what is left before each request."""
    carried = [c for c in rows.columns if c not in {*KEYS, "_stock", "reorder_threshold"}]
    sequence = [*order, *[c for c in carried if c not in order]]
    grouped = rows.groupBy(*KEYS).agg(
        F.first("_stock").alias("_stock"), F.first("reorder_threshold").alias("reorder_threshold"),
        F.array_sort(F.collect_list(F.struct(*sequence))).alias("_rows"),
    )
    before = F.expr("""aggregate(_rows, named_struct('left', _stock, 'seen', cast(array() as array<bigint>)),
        (a, r) -> named_struct('left', if(r.qty <= a.left, a.left - r.qty, a.left), 'seen', array_append(a.seen, a.left)),
        a -> a.seen)""")
    return (
        grouped.withColumn("_before", before)
        .select(*KEYS, "reorder_threshold", F.explode(F.arrays_zip("_rows", "_before")).alias("z"))
        .select(*KEYS, "reorder_threshold", "z._rows.*", F.col("z._before").alias("available_before"))
    )


def _reserve_hot(rows: DataFrame, order: list[str]) -> DataFrame:
    """The same outcome for keys too large for one group, in at most log2(stock) + 1 rounds.

    While 2^n is left or more, every request below 2^n is granted, and the first of the others that
    fits leaves less than 2^n. So the end of a round is found from a running sum of the small requests,
    and each round starts with less than half the unit of the one before.
    """
    carried = [c for c in rows.columns if c not in {*KEYS, "_stock"}]
    sequence = [*order, *[c for c in carried if c not in order and c not in {"reorder_threshold"}]]
    segmented = skew.in_segments(rows, KEYS, sequence)
    numbered = cut_lineage(skew.running_sum(segmented, KEYS, sequence, F.lit(1), "_n"))
    state = cut_lineage(
        numbered.groupBy(*KEYS).agg(F.first("_stock").alias("_left")).withColumn("_from", F.lit(0).cast("bigint"))
    )
    rest = numbered.drop("_stock")
    finished = []
    while not state.isEmpty():
        unit = F.when(F.col("_left") > 0, F.pow(F.lit(2.0), F.floor(F.log2(F.col("_left").cast("double"))))).otherwise(1)
        open_rows = rest.join(state, KEYS).where(F.col("_n") > F.col("_from")).withColumn("_unit", unit.cast("bigint"))
        small = (F.col("_left") > 0) & (F.col("qty") < F.col("_unit"))
        summed = cut_lineage(
            skew.running_sum(open_rows.withColumn("_small", small), KEYS, sequence,
                             F.when(F.col("_small"), F.col("qty")).otherwise(0), "_taken")
        )
        left_now = F.col("_left") - F.col("_taken")
        ends = F.when(F.col("_small"), left_now < F.col("_unit")).otherwise(F.col("qty") <= left_now)
        after = F.when(F.col("_small"), left_now).otherwise(left_now - F.col("qty"))
        turning = cut_lineage(
            summed.where(ends).groupBy(*KEYS).agg(
                F.min_by(F.struct(F.col("_n").alias("at"), after.alias("left")), F.col("_n")).alias("_turn")
            )
        )
        before = left_now + F.when(F.col("_small"), F.col("qty")).otherwise(0)
        finished.append(
            summed.join(turning, KEYS, "left")
            .where(F.col("_turn").isNull() | (F.col("_n") <= F.col("_turn.at")))
            .select(*KEYS, *carried, before.alias("available_before"))
        )
        state = turning.select(*KEYS, F.col("_turn.left").alias("_left"), F.col("_turn.at").alias("_from"))
    return reduce(DataFrame.unionByName, finished)


def allocate_with_fallback(orders: DataFrame, lines: DataFrame, choices: DataFrame, stock: DataFrame, order: list[str],
                           rounds: int | None = None) -> DataFrame:
    """One node for all lines of an order, or the next best one: (order_id, node_id, round, failure) of every order.

    `choices` ranks each order's candidate nodes from 1. In round r every order without a node asks its r-th one for
    all it needs. Per (sku, node) the asking orders come in the given order (its columns are those of `orders`, its
    last resort the order_id), and a line is granted while the running sum of what is asked stays within what is
    left. An order with all lines granted has its node; one refused in part gives everything back and asks its next
    node in the next round. It ends when no order has an untried node, or after `rounds` rounds. An order without
    candidates fails with `no inventory`, one refused everywhere with `all nodes refused`. An order without lines
    takes its first node.

    This is not the result of serving orders one after the other, whose rounds would be as many as orders; no stock
    is ever sold twice, and a round is one ordered pass whose keys may be of any size. Of the stored steps only those of
    the present round, and the asking lines and ranks, lie on disk.
    """
    position = [c for c in order if c != "order_id"]
    need = lines.groupBy("order_id", "sku").agg(F.sum("qty").alias("qty"))
    ranked = choices.select("order_id", "node_id", "rank")
    held = stock.select(*KEYS, F.col("available_qty").cast("bigint").alias("_stock"))
    sequence = [*position, "order_id"]
    schema = "order_id string, node_id string, round int"
    spark = orders.sparkSession
    placed, taken, turn, state = spark.createDataFrame([], schema), None, 0, Scratch(spark)
    with Scratch(spark) as within, brief_shuffles(spark):
        # Orders without lines ask for nothing of no sku, which every node grants.
        asking = within.keep(orders.select("order_id", *position).join(by_shuffle(need), "order_id", "left"), "fallback-asking")
        ranked = within.keep(ranked if rounds is None else ranked.where(F.col("rank") <= rounds), "fallback-ranked")
        while rounds is None or turn < rounds:
            turn += 1
            with Scratch(spark) as step:
                asks = asking.join(by_shuffle(ranked.where(F.col("rank") == turn).select("order_id", "node_id")), "order_id") \
                    .join(by_shuffle(placed.select("order_id")), "order_id", "left_anti").join(by_shuffle(held), KEYS, "left")
                left = F.coalesce("_stock", F.lit(0))
                if taken is not None:
                    asks = asks.join(by_shuffle(taken), KEYS, "left")
                    left = left - F.coalesce("_taken", F.lit(0))
                asks = skew.in_segments(asks.select(*sequence, *KEYS, "qty", left.alias("_left")), KEYS, sequence,
                                        store=lambda df, step=step: step.keep(df, "fallback-asks"))
                if asks.isEmpty():
                    break
                summed = skew.running_sum(asks.where(F.col("sku").isNotNull()), KEYS, sequence, F.col("qty"), "_upto")
                refused = step.keep(summed.where(F.col("qty").isNull() | (F.col("_upto") > F.col("_left")))
                                    .select("order_id").distinct(), "fallback-refused")
                won = step.keep(asks.select("order_id", *KEYS, "qty").join(by_shuffle(refused), "order_id", "left_anti"),
                                "fallback-won")
                now = won.where(F.col("sku").isNotNull()).groupBy(*KEYS).agg(F.sum("qty").alias("_taken"))
                both = now if taken is None else taken.unionByName(now)
                with state:
                    state = Scratch(spark)
                    taken = state.keep(both.groupBy(*KEYS).agg(F.sum("_taken").alias("_taken")), "fallback-taken")
                    placed = state.keep(placed.unionByName(
                        won.select("order_id", "node_id", F.lit(turn).alias("round")).distinct()), "fallback-placed")
        with state:
            placed = keep(placed, "fallback-nodes")
        known = keep(ranked.groupBy("order_id").agg(F.count(F.lit(1)).alias("_nodes")), "fallback-known")
    failure = F.when(F.col("_nodes").isNull(), "no inventory").when(F.col("node_id").isNull(), "all nodes refused")
    return orders.select("order_id").join(by_shuffle(placed), "order_id", "left").join(by_shuffle(known), "order_id", "left").select(
        "order_id", "node_id", "round", failure.alias("failure"))


def result_events(outcomes: DataFrame, at: str, ttl_minutes: int = C.RESERVATION_TTL_MINUTES) -> DataFrame:
    """Rows for inventory.reserved (with expiry) and inventory.rejected (with what was available)."""
    return outcomes.where(F.col("outcome").isin(RESERVED, REJECTED)).select(
        F.when(F.col("outcome") == RESERVED, C.INVENTORY_RESERVED).otherwise(C.INVENTORY_REJECTED).alias("event_type"),
        "order_id", *KEYS, "qty",
        F.when(F.col("outcome") == RESERVED, F.col(at) + F.expr(f"interval {ttl_minutes} minutes")).alias("expires_at"),
        F.when(F.col("outcome") == REJECTED, F.col("available_before")).alias("available_qty"),
    )


def low_stock(outcomes: DataFrame) -> DataFrame:
    """An alert for each grant that leaves no more than the reorder threshold."""
    return outcomes.where(
        (F.col("outcome") == RESERVED) & (F.col("available_after") <= F.col("reorder_threshold"))
    ).select(*KEYS, "order_id", F.col("available_after").alias("available_qty"),
             F.col("reorder_threshold").alias("threshold"))


def expired(reservations: DataFrame, now: Column) -> DataFrame:
    """Active reservations whose time has run out (strictly)."""
    return reservations.where((F.col("status") == "ACTIVE") & (F.col("expires_at") < now))


def give_back(stock: DataFrame, ended: DataFrame) -> DataFrame:
    """Stock after returning the ended reservations: available up, reserved down, a version per return."""
    back = ended.groupBy(*KEYS).agg(F.sum("qty").alias("_qty"), F.count(F.lit(1)).alias("_times"))
    qty, times = F.coalesce("_qty", F.lit(0)), F.coalesce("_times", F.lit(0))
    kept = [c for c in stock.columns if c not in {*KEYS, "available_qty", "reserved_qty", "version"}]
    return stock.join(by_shuffle(back), KEYS, "left").select(
        *KEYS,
        (F.col("available_qty") + qty).cast("bigint").alias("available_qty"),
        (F.col("reserved_qty") - qty).cast("bigint").alias("reserved_qty"),
        (F.col("version") + times).cast("bigint").alias("version"),
        *kept,
    )


def upsert_stock(stock: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply stock settings in `seq` order: the last one wins, each one after the first row counts a version.

    Settings are folded to one row per key before they meet the stock, and both are dealt out by key before the second
    grouping: a task groups one share of the keys and never all that its piece of the input was expanded to. Both
    values follow the same `seq`, so they come from one row; kept apart they have a fixed width and need no sort.
    """
    def folded(rows: DataFrame) -> DataFrame:
        place = F.coalesce("seq", F.lit(-(2**62)))
        return rows.groupBy(*KEYS).agg(
            *(F.max_by(c, place).alias(c) for c in ("available_qty", "reorder_threshold")), F.sum("v").alias("v"),
            F.max("seq").alias("seq"))

    now = stock.select(*KEYS, "available_qty", "reorder_threshold", F.col("version").cast("bigint").alias("v"),
                       F.lit(None).cast("bigint").alias("seq"))
    new = changes.select(*KEYS, "available_qty", "reorder_threshold", F.lit(1).cast("bigint").alias("v"),
                         F.col("seq").cast("bigint").alias("seq"))
    # A change without a seq still comes after the opening stock.
    changed = folded(new).withColumn("seq", F.coalesce("seq", F.lit(-(2**62) + 1)))
    return folded(now.unionByName(changed).repartition(*KEYS)).select(
        *KEYS, "available_qty", "reorder_threshold", F.col("v").alias("version"))
