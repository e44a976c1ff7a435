"""Column expressions for the order, retry and scoring rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater import contracts as C


def transition_pairs() -> list[str]:
    return [f"{a}>{b}" for a, following in C.NEXT_STATES.items() for b in following]


def allowed_sql(current: str, wanted: str) -> str:
    """SQL predicate: may `wanted` follow `current`? Unknown states never may."""
    pairs = ", ".join(f"'{p}'" for p in transition_pairs())
    return f"coalesce(concat({current}, '>', {wanted}) in ({pairs}), false)"


def verdict_sql(status: str, version: str, request: str) -> str:
    """Fate of a status request: checks in this order, pair, node, version."""
    return f"""case when not {allowed_sql(status, request + '.to_status')} then 'invalid'
        when {request}.to_status = 'FULFILLMENT_ASSIGNED' and {request}.node_id is null then 'missing_node'
        when coalesce({request}.expected_version, -1) <> {version} then 'conflict' else 'applied' end"""


def pseudo_location(customer_id: str) -> tuple[Column, Column]:
    """Stable latitude and longitude from the SHA-256 of the id: eight hex digits each, scaled to the globe."""
    digest = F.sha2(F.col(customer_id), 256)

    def fraction(start: int) -> Column:
        return F.conv(F.substring(digest, start, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))

    return fraction(1) * 180 - 90, fraction(9) * 360 - 180


def great_circle_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Haversine distance in km."""
    return f"""{2 * C.EARTH_RADIUS_KM}D * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2D)
        + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2D)))"""


def delivery_days_sql(km: str) -> str:
    return f"({C.HANDLING_DAYS}D + {km} / {C.KM_PER_DAY}D)"


def retry_delay(attempt: Column, base: float = C.RETRY_BASE_SECONDS, longest: float = C.RETRY_MAX_SECONDS) -> Column:
    """Seconds to wait after the given failed attempt; the random tenth on top is left out."""
    return F.least(F.pow(F.lit(2.0), attempt - 1) * base, F.lit(float(longest)))


def outbox_delay(attempts: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), attempts), F.lit(float(C.OUTBOX_MAX_BACKOFF_SECONDS)))
