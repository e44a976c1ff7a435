"""Daily demand per product and location: history, input checks, features, splits, accuracy."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["sku", "location_id"]
TARGET = "units_demanded"
REQUIRED = ["date", *SERIES, TARGET, "price"]

# Known only once the day is over: never features.
AFTER_THE_FACT = frozenset({TARGET, "units_fulfilled", "lost_sales", "stock_available", "is_stockout"})
OUTLIER_Z = 6.0


@dataclass(frozen=True)
class ForecastSettings:
    horizon_days: int = 14
    min_history_days: int = 56
    lags: tuple[int, ...] = (1, 7, 14, 28)
    windows: tuple[int, ...] = (7, 14, 28)
    training_cutoff: date | None = None
    champion_metric: str = "wape"
    seed: int = 42
    folds: int = 3
    trees: int = 20
    depth: int = 5
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.champion_metric not in ("mae", "rmse", "wape"):
            raise ValueError(f"champion_metric must be mae, rmse or wape, not {self.champion_metric!r}")
        if self.horizon_days < 1 or self.min_history_days < 1:
            raise ValueError("horizon_days and min_history_days must be at least 1")
        if any(lag < 1 for lag in self.lags):
            raise ValueError(f"lags {self.lags} would look at the current day or the future")


def series_window() -> Window:
    """Days of one series; at most one row per day, so a group is bounded by the calendar."""
    return Window.partitionBy(*SERIES).orderBy("date")


def holiday_sql(day: str) -> str:
    """New Year, the fourth of July, Christmas, and the fourth Thursday of November."""
    return f"""((month({day}) = 1 and day({day}) = 1) or (month({day}) = 7 and day({day}) = 4)
        or (month({day}) = 12 and day({day}) = 25)
        or (month({day}) = 11 and weekday({day}) = 3 and day({day}) between 22 and 28))"""


def demand_history(lines: DataFrame) -> DataFrame:
    """Daily units per (sku, location_id) from order lines, without gaps between first and last sale.

    Days without a sale get zero units and the last price asked. The calendar is expanded per series,
    after the lines have been reduced to days.
    """
    daily = lines.groupBy(F.to_date("occurred_at").alias("date"), *SERIES).agg(
        F.sum("qty").alias("units"), F.count(F.lit(1)).alias("lines"), F.min("unit_price").alias("asked")
    )
    days = daily.groupBy(*SERIES).agg(F.min("date").alias("first"), F.max("date").alias("last")).select(
        *SERIES, F.explode(F.sequence("first", "last")).alias("date")
    )
    return days.join(daily, [*SERIES, "date"], "left").select(
        "date", *SERIES,
        F.coalesce("units", F.lit(0)).alias(TARGET),
        F.coalesce("lines", F.lit(0)).alias("order_count"),
        F.last("asked", ignorenulls=True).over(series_window()).alias("price"),
        F.lit(0).alias("promo_flag"),
        F.expr(f"int({holiday_sql('date')})").alias("is_holiday"),
    )


# --- input checks ---------------------------------------------------------------------------

def missing_columns(history: DataFrame) -> list[str]:
    return [c for c in REQUIRED if c not in history.columns]


def quality_checks(history: DataFrame, min_history_days: int) -> DataFrame:
    """Twelve results (name, passed, found) from one chain of aggregates: rows, days, series, all.

    The gap check counts distinct days, so a repeated day cannot hide a missing one. Outliers inform
    and never fail. An empty history fails `not_empty`, and nothing else is reported about it.
    """
    lacking = missing_columns(history)
    if lacking:
        return history.sparkSession.createDataFrame(
            [("required_columns", False, len(lacking))], "name string, passed boolean, found bigint"
        )
    day = F.col("date").cast("string").try_cast("date")
    rows = history.select(
        F.coalesce(day, F.lit(None)).alias("day"), F.col("date").isNotNull().alias("dated"), *SERIES,
        F.col(TARGET).cast("double").alias("y"), "price",
    )
    blank = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in SERIES]
    per_day = rows.groupBy(*SERIES, "day").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("day").isNull()).alias("undated"),
        F.count_if(F.col("y").isNull() | F.isnan("y")).alias("untold"),
        F.count_if(F.col("y") < 0).alias("negative"),
        F.count_if(F.col("price") <= 0).alias("unpriced"),
        F.count_if(blank[0]).alias("no_sku"),
        F.count_if(blank[1]).alias("no_location"),
        F.count_if(~F.coalesce(F.col("y") == 0, F.lit(False))).alias("moving"),
    )
    counted = ("n", "undated", "untold", "negative", "unpriced", "no_sku", "no_location", "moving")
    per_series = per_day.groupBy(*SERIES).agg(
        *[F.sum(c).alias(c) for c in counted],
        F.sum(F.col("n") - 1).alias("repeated"),
        F.count("day").alias("days"),
        F.datediff(F.max("day"), F.min("day")).alias("span"),
    )
    moments = rows.groupBy(*SERIES).agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"))
    far = F.abs(F.col("y") - F.col("mean")) > F.col("sd") * OUTLIER_Z
    outliers = rows.join(moments, SERIES).agg(F.count_if((F.col("sd") > 0) & far).alias("outliers"))
    total = per_series.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*counted, "repeated")],
        F.count_if(F.col("days") < min_history_days).alias("short"),
        F.count_if((F.col("days") > 1) & (F.col("span") + 1 != F.col("days"))).alias("gapped"),
        F.count_if(F.col("moving") == 0).alias("flat"),
    )

    def gate(name: str, found: str) -> Column:
        return F.expr(f"struct('{name}' as name, {found} = 0 as passed, bigint({found}) as found)")

    results = F.array(
        gate("required_columns", "0"),
        F.expr("struct('not_empty' as name, n > 0 as passed, bigint(n) as found)"),
        gate("parseable_dates", "undated"),
        gate("no_duplicate_grain", "repeated"),
        gate("no_missing_target", "untold"),
        gate("no_negative_demand", "negative"),
        gate("valid_prices", "unpriced"),
        gate("consistent_identifiers", "no_sku + no_location"),
        gate("sufficient_history", "short"),
        gate("no_unexpected_gaps", "gapped"),
        F.expr("struct('extreme_outliers' as name, true as passed, bigint(outliers) as found)"),
        gate("all_zero_series", "flat"),
    )
    # Two single rows of figures, put side by side by an aggregate over both.
    figures = [c for c in total.columns]
    stacked = total.withColumn("outliers", F.lit(None).cast("bigint")).unionByName(
        outliers.select(*[F.lit(None).cast(total.schema[c].dataType).alias(c) for c in figures], "outliers"))
    together = stacked.agg(*[F.max(c).alias(c) for c in (*figures, "outliers")])
    return together.select("n", F.inline(results)).where((F.col("n") > 0) | (F.col("name") == "not_empty")).drop("n")


def check_split_order(train_end: date, valid_start: date, valid_end: date) -> bool:
    return train_end < valid_start <= valid_end


def assert_no_leakage(columns: list[str]) -> None:
    leaked = sorted(set(columns) & AFTER_THE_FACT)
    if leaked:
        raise ValueError(f"columns known only after the day cannot be features: {leaked}")


# --- features -------------------------------------------------------------------------------

BASE_FEATURES = ["day_of_week", "week_of_year", "month", "is_weekend", "price", "promo_flag", "is_holiday"]
CALENDAR_SQL = ["weekday(date) as day_of_week", "weekofyear(date) as week_of_year", "month(date) as month",
             "int(weekday(date) >= 5) as is_weekend"]


def feature_columns(settings: ForecastSettings) -> list[str]:
    columns = BASE_FEATURES + [f"lag_{k}" for k in settings.lags]
    for w in settings.windows:
        columns += [f"rolling_mean_{w}", f"rolling_std_{w}"]
    assert_no_leakage(columns)
    return columns


def calendar_features(history: DataFrame) -> DataFrame:
    return history.selectExpr("*", *CALENDAR_SQL)


def history_features(history: DataFrame, settings: ForecastSettings) -> DataFrame:
    """Row lags, and mean and sample deviation of the rows before; the day itself is never looked at.

    A window needs half its rows. All columns share one sort of each series.
    """
    by_day, y = series_window(), F.col(TARGET).cast("double")
    added = {f"lag_{k}": F.lag(y, k).over(by_day) for k in settings.lags}
    for w in settings.windows:
        before = by_day.rowsBetween(-w, -1)
        enough = F.count(y).over(before) >= max(1, w // 2)
        added[f"rolling_mean_{w}"] = F.when(enough, F.avg(y).over(before))
        added[f"rolling_std_{w}"] = F.when(enough, F.stddev_samp(y).over(before))
    return history.select("*", *[expression.alias(name) for name, expression in added.items()])


def features(history: DataFrame, settings: ForecastSettings) -> DataFrame:
    return history_features(calendar_features(history), settings)


# --- splits ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class Split:
    train_end: date
    valid_start: date
    valid_end: date


def date_range(history: DataFrame) -> tuple[date, date]:
    """First and last day: the one row a split needs on the driver."""
    row = history.agg(F.min(F.to_date("date")), F.max(F.to_date("date"))).first()
    if row[0] is None:
        raise ValueError("the history holds no dates")
    return row[0], row[1]


def training_cutoff(last: date, settings: ForecastSettings) -> date:
    return settings.training_cutoff or last - timedelta(days=2 * settings.horizon_days)


def split_at(cutoff: date, settings: ForecastSettings) -> Split:
    return Split(cutoff, cutoff + timedelta(days=1), cutoff + timedelta(days=settings.horizon_days))


def chronological_split(history: DataFrame, settings: ForecastSettings, span: tuple[date, date] | None = None) -> Split:
    """One cutoff for all series; `span` spares looking up the first and last day again."""
    first, last = span or date_range(history)
    cutoff = training_cutoff(last, settings)
    if (cutoff - first).days < settings.min_history_days:
        raise ValueError(f"{(cutoff - first).days} days before {cutoff} are fewer than {settings.min_history_days}")
    if cutoff >= last:
        raise ValueError(f"nothing to validate on after {cutoff}")
    return split_at(cutoff, settings)


def walk_forward_folds(history: DataFrame, settings: ForecastSettings) -> list[Split]:
    """Cutoffs one horizon apart, oldest first; folds without enough before or after are left out."""
    first, last = date_range(history)
    newest = training_cutoff(last, settings)
    step = timedelta(days=settings.horizon_days)
    folds = [split_at(newest - step * back, settings) for back in reversed(range(settings.folds))]
    return [f for f in folds if (f.train_end - first).days >= settings.min_history_days and f.valid_end <= last]


def training_rows(df: DataFrame, split: Split) -> DataFrame:
    return df.where(F.col("date") <= F.lit(split.train_end))


def validation_rows(df: DataFrame, split: Split) -> DataFrame:
    return df.where((F.col("date") > F.lit(split.train_end)) & (F.col("date") <= F.lit(split.valid_end)))


# --- baseline and accuracy ------------------------------------------------------------------

BASELINE = "seasonal_naive"


def seasonal_naive(featured: DataFrame) -> DataFrame:
    """Same weekday a week ago, else the mean of the week before, else zero; never negative."""
    if "lag_7" not in featured.columns:
        raise ValueError("the seasonal-naive baseline needs lag_7")
    fallback = [F.col(c) for c in ("lag_7", "rolling_mean_7") if c in featured.columns]
    return featured.withColumn(
        "predicted_units", F.greatest(F.coalesce(*fallback, F.lit(0.0)), F.lit(0.0))
    ).withColumn("model_name", F.lit(BASELINE))


def accuracy() -> list[Column]:
    """MAE, RMSE and WAPE of `predicted_units`; WAPE of all-zero demand is 0 or infinite, never undefined."""
    y, p = F.col(TARGET).cast("double"), F.col("predicted_units")
    demand = F.sum(F.abs(y))
    none = F.when(F.sum(F.abs(p)) == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    return [
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.avg(F.pow(y - p, 2))).alias("rmse"),
        F.when(demand == 0, none).otherwise(F.sum(F.abs(y - p)) / F.nullif(demand, F.lit(0.0))).alias("wape"),
        F.count(F.lit(1)).alias("n"),
    ]


def evaluation(scored: DataFrame, valid_start: date) -> DataFrame:
    """Accuracy per model overall, by sku, by location and by day of the horizon, in one pass."""
    day = (F.datediff("date", F.lit(valid_start)) + 1).cast("string")
    rows = scored.select("model_name", "sku", "location_id", day.alias("horizon"), TARGET, "predicted_units")
    model, levels = F.col("model_name"), [F.col(c) for c in ("sku", "location_id", "horizon")]
    sets = [[model], *[[model, level] for level in levels]]
    grouped = rows.groupingSets(sets, model, *levels).agg(
        F.when(F.grouping("sku") == 0, "sku").when(F.grouping("location_id") == 0, "location_id")
        .when(F.grouping("horizon") == 0, "horizon").otherwise("overall").alias("level"),
        *accuracy(),
    )
    return grouped.select(
        "model_name", "level", F.coalesce(*levels, F.lit("all")).alias("member"), "mae", "rmse", "wape", "n"
    )


def select_champion(evaluated: DataFrame, challenger: str, metric: str = "wape") -> DataFrame:
    """The challenger wins only when strictly better on the overall metric; a tie keeps the baseline."""
    overall = evaluated.where("level = 'overall'").agg(
        F.max(F.when(F.col("model_name") == BASELINE, F.col(metric))).alias("baseline_value"),
        F.max(F.when(F.col("model_name") == challenger, F.col(metric))).alias("challenger_value"),
    )
    better = F.col("challenger_value") < F.col("baseline_value")
    values = [F.format_string("%.4f", c) for c in ("challenger_value", "baseline_value")]
    reason = F.when(better, F.concat(F.lit(f"{challenger} {metric}="), values[0], F.lit(f" < {BASELINE} {metric}="),
                                     values[1])).otherwise(
        F.concat(F.lit(f"{challenger} {metric}="), values[0], F.lit(f" >= {BASELINE} {metric}="), values[1]))
    return overall.select(
        F.when(better, challenger).otherwise(BASELINE).alias("champion"), F.lit(metric).alias("metric"),
        "baseline_value", "challenger_value", reason.alias("reason"),
    )
