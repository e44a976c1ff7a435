"""The forecast from start to end: check, split, fit, evaluate, choose, project, store."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import demand as D
from tidewater.operators import forecasting as M


@dataclass(frozen=True)
class ForecastRun:
    run_id: str
    split: D.Split
    evaluation: DataFrame
    champion: str
    reason: str
    forecast: DataFrame


def prepare(history: DataFrame, settings: D.ForecastSettings) -> DataFrame:
    """Featured history, or an error naming every failed check."""
    failed = [r["name"] for r in D.quality_checks(history, settings.min_history_days).where("not passed").collect()]
    if failed:
        raise ValueError(f"history failed: {', '.join(failed)}")
    return D.features(history, settings)


def run_forecast(history: DataFrame, settings: D.ForecastSettings, output: str | None = None) -> ForecastRun:
    """With `output`, writes model, metadata, evaluation and forecast below it, keyed by run."""
    featured = prepare(history, settings)
    span = D.date_range(history)
    split = D.chronological_split(history, settings, span)
    model = M.fit_trees(D.training_rows(featured, split), settings)
    valid = D.validation_rows(featured, split)
    challenger = M.predict_trees(model, valid, settings)
    columns = ["model_name", "date", *D.SERIES, D.TARGET, "predicted_units"]
    scored = D.seasonal_naive(valid).select(*columns).unionByName(challenger.select(*columns))
    evaluated = D.evaluation(scored, split.valid_start)
    choice = D.select_champion(evaluated, M.CHALLENGER, settings.champion_metric).first()
    if choice["champion"] == M.CHALLENGER:
        def predict(df: DataFrame) -> DataFrame:
            return M.predict_trees(model, df, settings)
    else:
        predict = D.seasonal_naive
    run_id, stamp = uuid.uuid4().hex[:12], M.run_stamp()
    projected = M.forecast(
        history, predict, settings, model_name=choice["champion"], model_version=run_id, run_id=run_id,
        generated_at=stamp, cutoff=split.train_end, last=span[1],
    )
    if output:
        spark = history.sparkSession
        M.save_run(spark, output, model, {
            "run_id": run_id, "trained_at": stamp, "train_end": split.train_end, "valid_end": split.valid_end,
            "features": ",".join(D.feature_columns(settings)), "seed": settings.seed, "champion": choice["champion"],
        })
        evaluated.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(
            f"{output}/evaluation"
        )
        projected.write.mode("append").partitionBy("run_id").parquet(f"{output}/forecast")
    return ForecastRun(run_id, split, evaluated, choice["champion"], choice["reason"], projected)


def latest_forecast(spark, output: str) -> DataFrame:
    """The forecast of the run generated last."""
    runs = spark.read.parquet(f"{output}/forecast")
    newest = runs.agg(F.max_by("run_id", F.to_timestamp("forecast_generated_at")).alias("run_id"))
    return runs.join(newest, "run_id", "left_semi")
