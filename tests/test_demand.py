from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from samples import rows
from tidewater.operators import demand as D
from tidewater.operators import forecasting as M
from tidewater.plans import forecast_run

START = date(2025, 1, 1)
SMALL = D.ForecastSettings(horizon_days=7, min_history_days=30, trees=3, depth=3)


def history(spark, days=80, series=(("a", "x"), ("b", "x")), value=lambda s, i: 10 + i % 7 + (s == "b")):
    data = [(START + timedelta(days=i), s, loc, value(s, i), 9.5, 0, 0) for s, loc in series for i in range(days)]
    return spark.createDataFrame(data, "date date, sku string, location_id string, units_demanded bigint, price double, "
                                       "promo_flag int, is_holiday int")


def test_lags_are_rows_of_the_same_series(spark):
    df = history(spark, 5, value=lambda s, i: (i + 1) * (10 if s == "a" else 1000))
    got = D.history_features(df, D.ForecastSettings(lags=(1,), windows=(3,)))
    a = [r["lag_1"] for r in got.where("sku = 'a'").orderBy("date").collect()]
    b = [r["lag_1"] for r in got.where("sku = 'b'").orderBy("date").collect()]
    assert a == [None, 10, 20, 30, 40] and b == [None, 1000, 2000, 3000, 4000]


def test_rolling_excludes_the_day_itself(spark):
    values = [10, 10, 10, 1000, 10]
    df = history(spark, 5, series=(("a", "x"),), value=lambda s, i: values[i])
    got = D.history_features(df, D.ForecastSettings(lags=(1,), windows=(3,))).orderBy("date").collect()
    assert got[3]["rolling_mean_3"] == 10 and got[4]["rolling_mean_3"] > 100
    assert got[0]["rolling_mean_3"] is None and got[1]["rolling_std_3"] is None


def test_settings_and_leakage_guard():
    with pytest.raises(ValueError):
        D.ForecastSettings(lags=(0,))
    with pytest.raises(ValueError):
        D.ForecastSettings(champion_metric="mape")
    with pytest.raises(ValueError):
        D.assert_no_leakage(["price", "lost_sales"])
    assert len(D.feature_columns(D.ForecastSettings())) == 17
    assert D.check_split_order(START, START + timedelta(days=1), START + timedelta(days=1))
    assert not D.check_split_order(START, START, START)


def scored(spark, actual, predicted, name=D.BASELINE):
    data = [(name, START + timedelta(days=i), "a", "x", a, p) for i, (a, p) in enumerate(zip(actual, predicted))]
    return spark.createDataFrame(data, "model_name string, date date, sku string, location_id string, "
                                       "units_demanded double, predicted_units double")


def overall(df):
    return D.evaluation(df, START).where("level = 'overall'").first()


def test_accuracy(spark):
    assert overall(scored(spark, [10., 20., 30.], [12., 18., 33.]))["mae"] == pytest.approx(7 / 3)
    assert overall(scored(spark, [0., 0.], [3., 4.]))["rmse"] == pytest.approx(12.5 ** .5)
    assert overall(scored(spark, [10., 20., 30.], [10., 20., 25.]))["wape"] == pytest.approx(5 / 60)
    assert overall(scored(spark, [0., 0.], [0., 0.]))["wape"] == 0
    assert overall(scored(spark, [0., 0.], [1., 0.]))["wape"] == float("inf")
    levels = D.evaluation(scored(spark, [1., 2.], [1., 2.]), START)
    assert rows(levels, "level", "member") == [("horizon", "1"), ("horizon", "2"), ("location_id", "x"), ("overall", "all"),
                                               ("sku", "a")]


def test_a_tie_keeps_the_baseline(spark):
    base = scored(spark, [10.], [9.])
    same = D.evaluation(base.unionByName(scored(spark, [10.], [9.], "m")), START)
    better = D.evaluation(base.unionByName(scored(spark, [10.], [10.], "m")), START)
    assert D.select_champion(same, "m").first()["champion"] == D.BASELINE
    assert D.select_champion(better, "m", "mae").first()["champion"] == "m"


def gates(df, days=30):
    return {r["name"]: (r["passed"], r["found"]) for r in D.quality_checks(df, days).collect()}


def test_quality_gates(spark):
    good = gates(history(spark, 40))
    assert len(good) == 12 and all(passed for passed, _ in good.values())
    df = history(spark, 40)
    assert gates(df.where("day(date) <> 15"))["no_unexpected_gaps"] == (False, 2)
    assert gates(df.unionByName(df.where("sku = 'a' and day(date) = 3")))["no_duplicate_grain"][0] is False
    assert gates(df.withColumn("sku", F.lit(" ")))["consistent_identifiers"] == (False, 80)
    assert gates(df.withColumn("units_demanded", F.lit(0)))["all_zero_series"] == (False, 2)
    assert gates(df, 41)["sufficient_history"] == (False, 2)
    assert gates(df.withColumn("date", F.lit("soon")))["parseable_dates"] == (False, 80)
    assert gates(df.limit(0)) == {"not_empty": (False, 0)}
    assert gates(df.drop("price")) == {"required_columns": (False, 1)}
    spike = history(spark, 60, value=lambda s, i: 500 if i == 30 else 10)
    assert gates(spike)["extreme_outliers"] == (True, 2)


def test_splits(spark):
    df = history(spark, 80)
    split = D.chronological_split(df, SMALL)
    assert split.train_end == START + timedelta(days=79 - 14) and split.valid_end == split.train_end + timedelta(days=7)
    folds = D.walk_forward_folds(df, SMALL)
    assert [f.train_end for f in folds] == sorted(f.train_end for f in folds) and len(folds) == 3
    assert all(a.valid_end < b.valid_start for a, b in zip(folds, folds[1:]))
    with pytest.raises(ValueError):
        D.chronological_split(history(spark, 40), SMALL)


def test_holidays(spark):
    df = spark.sql("select explode(sequence(date'2024-01-01', date'2024-12-31')) as date")
    assert [str(r[0]) for r in df.where(D.holiday_sql("date")).orderBy("date").collect()] == [
        "2024-01-01", "2024-07-04", "2024-11-28", "2024-12-25"]


def test_baseline_needs_lag_7_and_predict_needs_a_fit(spark):
    with pytest.raises(ValueError):
        D.seasonal_naive(history(spark, 3))
    with pytest.raises(ValueError):
        M.predict_trees(None, history(spark, 3), SMALL)


def test_run_feeds_predictions_back_and_is_stored(spark, tmp_path):
    df = history(spark, 80)
    run = forecast_run.run_forecast(df, SMALL, str(tmp_path))
    out = run.forecast.collect()
    assert len(out) == 14 and min(r["predicted_units"] for r in out) >= 0
    assert {r["horizon"] for r in out} == set(range(1, 8)) and set(run.forecast.columns) == {
        "forecast_generated_at", "forecast_date", "horizon", "sku", "location_id", "predicted_units", "model_name",
        "model_version", "run_id", "training_cutoff"}
    assert run.champion == D.BASELINE  # a pure weekly pattern cannot be beaten
    assert M.latest_run(spark, str(tmp_path))["run_id"] == run.run_id
    assert forecast_run.latest_forecast(spark, str(tmp_path)).count() == 14
    model = M.load_model(str(tmp_path), run.run_id)
    trees = M.forecast(df, lambda f: M.predict_trees(model, f, SMALL), SMALL, model_name=M.CHALLENGER, model_version="1",
                       run_id="r", generated_at="t", cutoff=run.split.train_end)
    assert trees.count() == 14 and trees.where("predicted_units < 0").count() == 0


def test_short_series_fall_back_and_feed_back(spark):
    df = history(spark, 4, series=(("a", "x"),), value=lambda s, i: 4)
    out = M.forecast(df, D.seasonal_naive, SMALL, model_name="m", model_version="1", run_id="r", generated_at="t",
                     cutoff=START).orderBy("horizon").collect()
    assert [r["predicted_units"] for r in out] == [4.0] * 7
