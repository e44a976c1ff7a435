"""Which node can serve an order, and which one serves it best."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater import contracts as C
from tidewater.functions import rules
from tidewater.session import by_shuffle


def shortfalls(wanted: DataFrame, stock: DataFrame) -> DataFrame:
    """Lines (order_id, node_id, sku, qty) a node cannot serve; no stock row means nothing available.

    Every line is tested on its own: two lines of one sku are not added up.
    """
    held = stock.select("sku", "node_id", "available_qty")
    return (
        wanted.join(by_shuffle(held), ["sku", "node_id"], "left")
        .select("order_id", "node_id", "sku", F.col("qty").alias("requested_qty"),
                F.coalesce("available_qty", F.lit(0)).alias("available_qty"))
        .where(F.col("available_qty") < F.col("requested_qty"))
    )


def stock_sufficiency(wanted: DataFrame, stock: DataFrame, *, sum_by_sku: bool = False) -> DataFrame:
    """Verdict per (order, node); `sum_by_sku` adds up repeated skus before testing."""
    keys = ["order_id", "node_id", "sku"]
    if sum_by_sku:
        wanted = wanted.groupBy(*keys).agg(F.sum("qty").alias("qty"))
    held = stock.select("sku", "node_id", "available_qty")
    tested = wanted.join(by_shuffle(held), ["sku", "node_id"], "left").withColumn(
        "short", F.coalesce("available_qty", F.lit(0)) < F.col("qty")
    )
    return tested.groupBy("order_id", "node_id").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.count_if("short").alias("short_lines"),
        (~F.bool_or("short")).alias("sufficient"),
    )


WORD_BITS = 63


def serving_nodes(lines: DataFrame, stock: DataFrame, nodes: DataFrame) -> DataFrame:
    """(order_id, node_id) of active nodes that hold enough for every line of the order.

    Only the largest line per (order, sku) matters. Active nodes are numbered, and stock is folded to one row per sku
    with the numbers and quantities of its nodes, at most one entry per node; so a popular sku meets one row instead of
    one per node. A line then is a bitmap of the nodes able to serve it, one row per WORD_BITS nodes, and an order
    the intersection of its lines' bitmaps, which combines before the shuffle. Only nodes that survive become rows.
    """
    need = lines.groupBy("order_id", "sku").agg(F.max("qty").alias("qty"))
    # Nodes are a dimension: numbering them is one small sort.
    numbered = nodes.where("active").select("node_id").distinct().select(
        "node_id", (F.row_number().over(Window.orderBy("node_id")) - 1).alias("number")).selectExpr(
        "node_id", f"number div {WORD_BITS} as word", f"cast(number % {WORD_BITS} as int) as bit")
    words = numbered.agg(F.max("word")).first()[0]
    if words is None:
        return need.join(numbered.select("node_id"), F.lit(False)).select("order_id", "node_id")
    held = F.collect_list(F.struct("word", "bit", "available_qty"))
    per_sku = stock.join(numbered, "node_id").groupBy("sku").agg(held.alias("held"))
    # A line of a sku that no active node holds has empty bitmaps: its order cannot be served.
    able = need.join(by_shuffle(per_sku), "sku", "left").selectExpr("order_id", f"""posexplode(transform(sequence(0L, {words}L), w ->
        aggregate(filter(coalesce(held, array()), h -> h.word = w and h.available_qty >= qty), 0L,
                  (bits, h) -> bits | shiftleft(1L, h.bit)))) as (word, bits)""")
    common = able.groupBy("order_id", "word").agg(F.bit_and("bits").alias("bits")).where("bits <> 0")
    served = common.selectExpr("order_id", "bigint(word) as word",
                               f"explode(filter(sequence(0, {WORD_BITS - 1}), b -> getbit(bits, b) = 1)) as bit")
    return served.join(numbered, ["word", "bit"]).select("order_id", "node_id")


def node_scores(candidates: DataFrame, customers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weighted score per candidate, scaled within each order's own candidate set (at most every node)."""
    lat, lon = rules.pseudo_location("customer_id")
    placed = customers.select("order_id", lat.alias("lat"), lon.alias("lon"))
    sites = nodes.select("node_id", "latitude", "longitude", "capacity_per_day", "current_backlog")
    weights = C.SCORE_WEIGHTS

    def nearest_is_one(name: str) -> str:
        low, high = f"min({name}) over peers", f"max({name}) over peers"
        return f"if({low} = {high}, 1D, 1 - try_divide({name} - {low}, {high} - {low}))".replace(
            "over peers", "over (partition by order_id)"
        )

    return (
        candidates.join(by_shuffle(placed), "order_id")
        .join(sites, "node_id")
        .selectExpr("order_id", "node_id", "capacity_per_day", "current_backlog",
                    f"{rules.great_circle_sql('lat', 'lon', 'latitude', 'longitude')} as km")
        .selectExpr("*", f"{rules.delivery_days_sql('km')} as days")
        .selectExpr(
            "order_id", "node_id", "days",
            f"{nearest_is_one('km')} as distance",
            f"{nearest_is_one('days')} as delivery",
            "coalesce(greatest(0D, 1 - try_divide(current_backlog, capacity_per_day)), 0D) as backlog",
            "coalesce(try_divide(capacity_per_day, max(capacity_per_day) over (partition by order_id)), 0D) as capacity",
        )
        .selectExpr(
            "order_id", "node_id",
            f"round({weights['distance']}D * distance + {weights['delivery']}D * delivery"
            f" + {weights['backlog']}D * backlog + {weights['capacity']}D * capacity, 4) as score",
            """struct(1D as stock, round(distance, 4) as distance, round(capacity, 4) as capacity,
                round(delivery, 4) as delivery_estimate, round(backlog, 4) as backlog) as score_breakdown""",
            "round(days, 2) as estimated_ship_date_days",
        )
    )


def ranked(scores: DataFrame) -> DataFrame:
    """Best first within each order; equal scores go to the smaller node id."""
    return scores.withColumn(
        "rank", F.row_number().over(Window.partitionBy("order_id").orderBy(F.desc("score"), "node_id"))
    )


def select_nodes(orders: DataFrame, scores: DataFrame) -> DataFrame:
    """The best node of every order, or the reason there is none. An aggregate: no ranking needed."""
    choice = F.struct("node_id", "score", "estimated_ship_date_days")
    best = scores.groupBy("order_id").agg(
        F.min_by(choice, F.struct((-F.col("score")).alias("worse"), F.col("node_id"))).alias("b")
    )
    return orders.select("order_id").join(by_shuffle(best), "order_id", "left").select(
        "order_id", "b.node_id", "b.score", "b.estimated_ship_date_days",
        F.when(F.col("b").isNull(), "no inventory").alias("failure"),
    )
