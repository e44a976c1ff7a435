"""Demand history, its checks, features, splits, baseline, accuracy and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import demand as D
from tidewater.operators import forecasting as M
from tidewater.plans.registry import query, statement
from tidewater.session import cut_lineage
from tidewater.sources import retail as R

SETTINGS = D.ForecastSettings()
_SERIES = "PARTITION BY sku, location_id ORDER BY date"

_HISTORY = {
    "daily": """SELECT occurred_at::DATE AS date, brand AS sku, r_name AS location_id, sum(qty) AS units,
        count(*) AS lines, min(unit_price) AS asked
        FROM lines JOIN nation ON k % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "days": """SELECT sku, location_id, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date
        FROM daily GROUP BY sku, location_id""",
    "history": f"""SELECT date, sku, location_id, coalesce(units, 0)::BIGINT AS units_demanded,
        coalesce(lines, 0)::BIGINT AS order_count,
        last_value(asked IGNORE NULLS) OVER ({_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price,
        0 AS promo_flag,
        ((month(date) = 1 AND day(date) = 1) OR (month(date) = 7 AND day(date) = 4)
          OR (month(date) = 12 AND day(date) = 25)
          OR (month(date) = 11 AND isodow(date) = 4 AND day(date) BETWEEN 22 AND 28))::INTEGER AS is_holiday
        FROM days LEFT JOIN daily USING (sku, location_id, date)""",
}
_FEATURES = {
    "lagged": "SELECT *, row_number() OVER w AS at, "
    + ", ".join(f"lag(units_demanded, {k}) OVER w AS lag_{k}" for k in SETTINGS.lags) + ", "
    + ", ".join(
        f"CASE WHEN count(*) OVER w{n} >= {max(1, n // 2)} THEN avg(units_demanded) OVER w{n} END AS rolling_mean_{n}, "
        f"CASE WHEN count(*) OVER w{n} >= {max(1, n // 2)} THEN stddev_samp(units_demanded) OVER w{n} END AS rolling_std_{n}"
        for n in SETTINGS.windows)
    + f" FROM history WINDOW w AS ({_SERIES}), "
    + ", ".join(f"w{n} AS ({_SERIES} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in SETTINGS.windows),
    "bounds": "SELECT min(date) AS first, max(date) AS last, (max(date) - 28)::DATE AS cutoff FROM history",
    "valid": """SELECT * FROM lagged, bounds WHERE date > cutoff AND date <= cutoff + 14""",
    "scored": """SELECT 'seasonal_naive' AS model_name, date, cutoff, sku, location_id, units_demanded,
          greatest(coalesce(lag_7, rolling_mean_7, 0), 0)::DOUBLE AS predicted_units FROM valid
        UNION ALL SELECT 'trailing_mean', date, cutoff, sku, location_id, units_demanded,
          greatest(coalesce(rolling_mean_28, 0), 0)::DOUBLE FROM valid""",
    "measured": """SELECT model_name, CASE WHEN grouping(sku) = 0 THEN 'sku' WHEN grouping(location_id) = 0
            THEN 'location_id' WHEN grouping(horizon) = 0 THEN 'horizon' ELSE 'overall' END AS level,
          coalesce(sku, location_id, horizon, 'all') AS member,
          avg(abs(units_demanded - predicted_units)) AS mae,
          sqrt(avg(pow(units_demanded - predicted_units, 2))) AS rmse,
          sum(abs(units_demanded - predicted_units)) / sum(abs(units_demanded)) AS wape, count(*) AS n
        FROM (SELECT *, (date - cutoff)::VARCHAR AS horizon FROM scored)
        GROUP BY GROUPING SETS ((model_name), (model_name, sku), (model_name, location_id), (model_name, horizon))""",
}


def _sql(body: str, upto: str = "history") -> str:
    names = {**_HISTORY, **_FEATURES}
    needed = list(names)[: list(names).index(upto) + 1]
    return statement(body, "lines", **{n: names[n] for n in needed})


def history(spark, root):
    return D.demand_history(R.demand_lines(spark, root))


@query("demand_history", _sql("SELECT * FROM history"))
def demand_history(spark, root):
    return history(spark, root)


_FAULTY = """SELECT date, sku, location_id, CASE dayofyear(date) WHEN 200 THEN NULL WHEN 150 THEN -1
      ELSE units_demanded END AS y, CASE dayofyear(date) WHEN 50 THEN 0 ELSE price END AS price
    FROM history, range(2) c(copy) WHERE dayofyear(date) <> 300 AND (copy = 0 OR dayofyear(date) = 100)"""


@query("demand_quality", statement(
    """SELECT 'required_columns' AS name, true AS passed, 0::BIGINT AS found
    UNION ALL SELECT 'not_empty', count(*) > 0, count(*) FROM faulty
    UNION ALL SELECT 'parseable_dates', true, 0
    UNION ALL SELECT 'no_duplicate_grain', count(*) = count(DISTINCT (date, sku, location_id)),
      count(*) - count(DISTINCT (date, sku, location_id)) FROM faulty
    UNION ALL SELECT 'no_missing_target', count(*) = count(y), count(*) - count(y) FROM faulty
    UNION ALL SELECT 'no_negative_demand', NOT coalesce(bool_or(y < 0), false), count(*) FILTER (WHERE y < 0) FROM faulty
    UNION ALL SELECT 'valid_prices', NOT bool_or(price <= 0), count(*) FILTER (WHERE price <= 0) FROM faulty
    UNION ALL SELECT 'consistent_identifiers', true, 0
    UNION ALL SELECT 'sufficient_history', count(*) FILTER (WHERE d < 56) = 0, count(*) FILTER (WHERE d < 56) FROM series
    UNION ALL SELECT 'no_unexpected_gaps', count(*) FILTER (WHERE d <> span) = 0, count(*) FILTER (WHERE d <> span)
      FROM series
    UNION ALL SELECT 'extreme_outliers', true, count(*) FILTER (WHERE abs(y - m) > 6 * s) FROM
      (SELECT y, avg(y) OVER p AS m, stddev_pop(y) OVER p AS s FROM faulty WINDOW p AS (PARTITION BY sku, location_id))
    UNION ALL SELECT 'all_zero_series', count(*) FILTER (WHERE top = 0 AND low = 0) = 0,
      count(*) FILTER (WHERE top = 0 AND low = 0) FROM series""", "lines", **_HISTORY, faulty=_FAULTY,
    series="""SELECT sku, location_id, count(DISTINCT date) AS d, max(date) - min(date) + 1 AS span, max(y) AS top,
      min(y) AS low FROM faulty GROUP BY ALL"""))
def demand_quality(spark, root):
    """Checks over the history with faults put in: gaps, repeats, missing, negative and free days."""
    faulty = history(spark, root).where("dayofyear(date) <> 300").selectExpr(
        "date", "sku", "location_id", "explode(sequence(1, if(dayofyear(date) = 100, 2, 1))) as copy",
        "case dayofyear(date) when 200 then null when 150 then -1 else units_demanded end as units_demanded",
        "if(dayofyear(date) = 50, 0, price) as price",
    )
    return D.quality_checks(faulty, SETTINGS.min_history_days)


@query("calendar_features", _sql(
    """SELECT DISTINCT date, is_holiday, (isodow(date) - 1)::INTEGER AS day_of_week, week(date)::INTEGER AS week_of_year,
      month(date)::INTEGER AS month, (isodow(date) >= 6)::INTEGER AS is_weekend FROM history"""))
def calendar_features(spark, root):
    return D.calendar_features(history(spark, root).select("date", "is_holiday").distinct())


@query("lag_rolling_features", _sql(
    "SELECT sku, location_id, year(date)::INTEGER AS year, month(date)::INTEGER AS month, count(*) AS days, "
    + ", ".join(f"sum(lag_{k})::DOUBLE AS lag_{k}" for k in SETTINGS.lags) + ", "
    + ", ".join(f"round(avg(rolling_mean_{n}), 4) AS rolling_mean_{n}, round(avg(rolling_std_{n}), 4) AS rolling_std_{n}"
                for n in SETTINGS.windows)
    + " FROM lagged GROUP BY ALL", "lagged"))
def lag_rolling_features(spark, root):
    """Every row's features, summed up per series and month to keep the comparison small."""
    featured = D.history_features(history(spark, root), SETTINGS)
    return featured.groupBy("sku", "location_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.count(F.lit(1)).alias("days"),
        *[F.sum(f"lag_{k}").alias(f"lag_{k}") for k in SETTINGS.lags],
        *[F.round(F.avg(f"rolling_{s}_{n}"), 4).alias(f"rolling_{s}_{n}") for n in SETTINGS.windows
          for s in ("mean", "std")],
    )


@query("chronological_split", _sql(
    """SELECT CASE WHEN date <= cutoff THEN 'train' ELSE 'valid' END AS part, min(date) AS first_day,
      max(date) AS last_day, count(*) AS rows FROM history, bounds WHERE date <= cutoff + 14 GROUP BY 1""", "bounds"))
def chronological_split(spark, root):
    rows = history(spark, root)
    split = D.chronological_split(rows, SETTINGS)
    part = F.when(F.col("date") <= F.lit(split.train_end), "train").otherwise("valid")
    return rows.where(F.col("date") <= F.lit(split.valid_end)).groupBy(part.alias("part")).agg(
        F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("rows")
    )


@query("walk_forward_folds", _sql(
    """SELECT (cutoff - 14 * b)::DATE AS train_end, (cutoff - 14 * b + 1)::DATE AS valid_start,
      (cutoff - 14 * b + 14)::DATE AS valid_end, count(*) FILTER (WHERE date <= cutoff - 14 * b) AS train_rows,
      count(*) FILTER (WHERE date > cutoff - 14 * b AND date <= cutoff - 14 * b + 14) AS valid_rows
    FROM history, bounds, (VALUES (0), (1), (2)) r(b) WHERE cutoff - 14 * b - first >= 56 GROUP BY b, cutoff""", "bounds"))
def walk_forward_folds(spark, root):
    rows = history(spark, root)
    folds = D.walk_forward_folds(rows, SETTINGS)
    counted, entries = [], []
    for i, fold in enumerate(folds):
        inside = (F.col("date") > F.lit(fold.train_end)) & (F.col("date") <= F.lit(fold.valid_end))
        counted += [F.count_if(F.col("date") <= F.lit(fold.train_end)).alias(f"t{i}"), F.count_if(inside).alias(f"v{i}")]
        entries.append(F.struct(
            F.lit(fold.train_end).alias("train_end"), F.lit(fold.valid_start).alias("valid_start"),
            F.lit(fold.valid_end).alias("valid_end"), F.col(f"t{i}").alias("train_rows"), F.col(f"v{i}").alias("valid_rows"),
        ))
    return rows.agg(*counted).select(F.inline(F.array(*entries)))


def validation(spark, root):
    rows = history(spark, root)
    split = D.chronological_split(rows, SETTINGS)
    return D.validation_rows(D.history_features(rows, SETTINGS), split), split


def scored(spark, root):
    """The baseline and, as a challenger that plain SQL can state, the mean of the last four weeks."""
    valid, split = validation(spark, root)
    columns = ["model_name", "date", "sku", "location_id", "units_demanded", "predicted_units"]
    trailing = valid.withColumn("model_name", F.lit("trailing_mean")).withColumn(
        "predicted_units", F.greatest(F.coalesce("rolling_mean_28", F.lit(0.0)), F.lit(0.0))
    )
    return D.seasonal_naive(valid).select(*columns).unionByName(trailing.select(*columns)), split


@query("seasonal_naive", _sql(
    """SELECT date, sku, location_id, units_demanded, predicted_units FROM scored
    WHERE model_name = 'seasonal_naive'""", "scored"))
def seasonal_naive(spark, root):
    valid, _ = validation(spark, root)
    return D.seasonal_naive(valid).select("date", "sku", "location_id", "units_demanded", "predicted_units")


@query("forecast_metrics", _sql(
    """SELECT model_name, level, member, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(wape, 4) AS wape, n
    FROM measured""", "measured"))
def forecast_metrics(spark, root):
    rows, split = scored(spark, root)
    return D.evaluation(rows, split.valid_start).withColumns({m: F.round(m, 4) for m in ("mae", "rmse", "wape")})


@query("champion", _sql(
    """SELECT CASE WHEN c < b THEN 'trailing_mean' ELSE 'seasonal_naive' END AS champion, 'wape' AS metric,
      round(b, 4) AS baseline_value, round(c, 4) AS challenger_value
    FROM (SELECT max(wape) FILTER (WHERE model_name = 'seasonal_naive') AS b,
        max(wape) FILTER (WHERE model_name = 'trailing_mean') AS c FROM measured WHERE level = 'overall')""", "measured"))
def champion(spark, root):
    rows, split = scored(spark, root)
    return D.select_champion(D.evaluation(rows, split.valid_start), "trailing_mean").select(
        "champion", "metric", F.round("baseline_value", 4).alias("baseline_value"),
        F.round("challenger_value", 4).alias("challenger_value"),
    )


def _project(rows, predict, name: str, split: D.Split, last):
    return M.forecast(rows, predict, SETTINGS, model_name=name, model_version="1", run_id="adhoc",
                      generated_at="1970-01-01T00:00:00+00:00", cutoff=split.train_end, last=last)


@query("baseline_forecast", _sql(
    """SELECT ((SELECT last FROM bounds) + h)::DATE::VARCHAR AS forecast_date, h::INTEGER AS horizon, sku, location_id,
      units_demanded::DOUBLE AS predicted_units, 'seasonal_naive' AS model_name,
      (SELECT cutoff FROM bounds)::VARCHAR AS training_cutoff
    FROM (SELECT *, row_number() OVER (PARTITION BY sku, location_id ORDER BY date DESC) AS back FROM history) t
    JOIN (SELECT unnest(range(1, 15))::INTEGER AS h) ON back = 7 - (h - 1) % 7""", "bounds"))
def baseline_forecast(spark, root):
    rows = history(spark, root)
    span = D.date_range(rows)
    split = D.chronological_split(rows, SETTINGS, span)
    return _project(rows, D.seasonal_naive, D.BASELINE, split, span[1]).select(
        "forecast_date", "horizon", "sku", "location_id", "predicted_units", "model_name", "training_cutoff"
    )


def _trees(spark, root):
    # Read many times by the fitting, and a row per series and day however many lines there are.
    rows = cut_lineage(history(spark, root))
    span = D.date_range(rows)
    split = D.chronological_split(rows, SETTINGS, span)
    featured = D.features(rows, SETTINGS)
    return rows, split, span[1], featured, M.fit_trees(D.training_rows(featured, split), SETTINGS)


@query("gbt_forecast", _sql(
    """SELECT sku, location_id, 14 AS forecast_days, 14 AS sound_days, (last + 1)::DATE::VARCHAR AS first_day,
      (last + 14)::DATE::VARCHAR AS last_day, 'gradient_boosted_trees' AS model_name, cutoff::VARCHAR AS training_cutoff
    FROM (SELECT DISTINCT sku, location_id FROM history), bounds""", "bounds"))
def gbt_forecast(spark, root):
    """Boosted trees on the training period, then the recursive forecast: per series how many days were forecast, and
    how many of them with a finite figure not below zero."""
    rows, split, last, _, model = _trees(spark, root)
    projected = _project(rows, lambda df: M.predict_trees(model, df, SETTINGS), M.CHALLENGER, split, last)
    sound = F.col("predicted_units").between(0, 1e300)
    return projected.groupBy("sku", "location_id", "model_name", "training_cutoff").agg(
        F.count_distinct("forecast_date").alias("forecast_days"), F.count_if(sound).alias("sound_days"),
        F.min("forecast_date").alias("first_day"), F.max("forecast_date").alias("last_day"),
    )


@query("model_evaluation", _sql(
    """SELECT model_name, level, member, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse,
      CASE WHEN isnan(wape) THEN 0.0 ELSE round(wape, 4) END AS wape, true AS sound FROM measured WHERE model_name = 'seasonal_naive'
    UNION ALL SELECT 'gradient_boosted_trees', level, member, n, NULL, NULL, NULL, true
    FROM measured WHERE model_name = 'seasonal_naive'""", "measured"))
def model_evaluation(spark, root):
    """Baseline and boosted trees on the same validation days; of the trees, whose figures depend on the library, only
    whether errors are finite and no mean exceeds its root mean square."""
    _, split, _, featured, model = _trees(spark, root)
    valid = D.validation_rows(featured, split)
    columns = ["model_name", "date", "sku", "location_id", "units_demanded", "predicted_units"]
    both = D.seasonal_naive(valid).select(*columns).unionByName(
        M.predict_trees(model, valid, SETTINGS).select(*columns)
    )
    found = D.evaluation(both, split.valid_start)
    exact = F.col("model_name") == D.BASELINE
    sound = F.col("mae").between(0, 1e300) & (F.col("mae") <= F.col("rmse") + 1e-9)
    return found.select("model_name", "level", "member", "n", *[
        F.when(exact, F.round(m, 4)).alias(m) for m in ("mae", "rmse", "wape")], sound.alias("sound"))
