"""Boosted trees as the challenger, the recursive forecast, and stored runs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import demand as D
from tidewater.session import cut_lineage

CHALLENGER = "gradient_boosted_trees"
STEPS_PER_PLAN = 14  # longer horizons are planned in parts, as planning grows faster than the steps
ABSENT = -1.0

Predictor = Callable[[DataFrame], DataFrame]


def _vector_inputs(settings: D.ForecastSettings) -> tuple[list[str], list[str]]:
    columns = D.feature_columns(settings)
    optional = [c for c in columns if c not in D.BASE_FEATURES]
    return columns, optional


def with_inputs(featured: DataFrame, settings: D.ForecastSettings) -> DataFrame:
    """Trees accept no nulls: an absent value becomes a constant plus a flag telling that it is absent."""
    columns, optional = _vector_inputs(settings)
    return featured.selectExpr(
        "*",
        *[f"coalesce(double({c}), {ABSENT}D) as in_{c}" for c in columns],
        *[f"double({c} is null) as no_{c}" for c in optional],
    )


def fit_trees(training: DataFrame, settings: D.ForecastSettings) -> PipelineModel:
    columns, optional = _vector_inputs(settings)
    assembler = VectorAssembler(
        inputCols=[f"in_{c}" for c in columns] + [f"no_{c}" for c in optional], outputCol="inputs"
    )
    trees = GBTRegressor(featuresCol="inputs", labelCol="label", predictionCol="raw_prediction",
                         maxIter=settings.trees, maxDepth=settings.depth, seed=settings.seed)
    labelled = with_inputs(training, settings).withColumn("label", F.col(D.TARGET).cast("double"))
    return Pipeline(stages=[assembler, trees]).fit(labelled)


def predict_trees(model: PipelineModel | None, featured: DataFrame, settings: D.ForecastSettings) -> DataFrame:
    if model is None:
        raise ValueError("the model must be fitted before it can predict")
    scored = model.transform(with_inputs(featured, settings))
    return scored.select(
        *featured.columns, F.greatest("raw_prediction", F.lit(0.0)).alias("predicted_units"),
        F.lit(CHALLENGER).alias("model_name"),
    )


def series_tails(history: DataFrame, settings: D.ForecastSettings) -> DataFrame:
    """Per series the last rows its features can look back on, oldest first, and its last price."""
    depth = max(*settings.lags, *settings.windows)
    newest = Window.partitionBy(*D.SERIES).orderBy(F.desc("date"))
    recent = history.select(*D.SERIES, "date", F.col(D.TARGET).cast("double").alias("y"), F.col("price").cast("double"))
    kept = recent.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= depth)
    return kept.groupBy(*D.SERIES).agg(
        F.expr("transform(array_sort(collect_list(struct(date, y))), p -> p.y)").alias("tail"),
        F.max_by("price", "date").alias("price"),
    )


def _tail_features(settings: D.ForecastSettings) -> list[str]:
    columns = [f"if(size(tail) >= {k}, element_at(tail, -{k}), null) as lag_{k}" for k in settings.lags]
    for w in settings.windows:
        last = f"slice(tail, -least(size(tail), {w}), {w})"
        mean = f"(aggregate({last}, 0D, (a, x) -> a + x) / size({last}))"
        spread = f"aggregate({last}, 0D, (a, x) -> a + pow(x - {mean}, 2), a -> sqrt(try_divide(a, size({last}) - 1)))"
        enough = f"size(tail) >= {max(1, w // 2)}"
        columns += [f"if({enough}, {mean}, null) as rolling_mean_{w}", f"if({enough}, {spread}, null) as rolling_std_{w}"]
    return columns


def forecast(history: DataFrame, predict: Predictor, settings: D.ForecastSettings, *, model_name: str,
             model_version: str, run_id: str, generated_at: str, cutoff: date, last: date | None = None) -> DataFrame:
    """`horizon_days` beyond the last day for every series, each prediction feeding the next day's features.

    The working set is one row per series holding its tail as an array, so a step is a projection: no
    step sorts or shuffles, and the history is read once. Price is carried on, no promotion is planned.
    """
    last = last or D.date_range(history)[1]
    depth = max(*settings.lags, *settings.windows)
    state, made = series_tails(history, settings), []
    for step in range(1, settings.horizon_days + 1):
        day = last + timedelta(days=step)
        holiday = D.holiday_sql(f"date'{day}'")
        featured = state.selectExpr(
            "sku", "location_id", "tail", "price", *made, f"date'{day}' as date", "0 as promo_flag",
            f"int({holiday}) as is_holiday",
        ).selectExpr("*", *D.CALENDAR_SQL, *_tail_features(settings))
        state = predict(featured).selectExpr(
            "sku", "location_id", "price",
            f"slice(array_append(tail, predicted_units), -least(size(tail) + 1, {depth}), {depth}) as tail",
            *made, f"predicted_units as made_{step}",
        )
        made.append(f"made_{step}")
        if step % STEPS_PER_PLAN == 0 and step < settings.horizon_days:
            state = cut_lineage(state)
    rows = ", ".join(
        f"struct('{last + timedelta(days=i)}' as forecast_date, {i} as horizon, made_{i} as predicted_units)"
        for i in range(1, settings.horizon_days + 1)
    )
    return state.selectExpr("sku", "location_id", f"inline(array({rows}))").selectExpr(
        f"'{generated_at}' as forecast_generated_at", "forecast_date", "horizon", "sku", "location_id",
        "predicted_units", f"'{model_name}' as model_name", f"'{model_version}' as model_version",
        f"'{run_id}' as run_id", f"'{cutoff}' as training_cutoff",
    )


def save_run(spark: SparkSession, root: str, model: PipelineModel, metadata: dict[str, str]) -> None:
    """The fitted pipeline under its run, and one metadata row per run."""
    model.write().overwrite().save(f"{root}/models/run_id={metadata['run_id']}")
    row = spark.createDataFrame([{k: str(v) for k, v in metadata.items()}])
    row.coalesce(1).write.mode("append").json(f"{root}/runs")


def latest_run(spark: SparkSession, root: str) -> dict[str, str]:
    """Metadata of the run trained last, by its time and not by its id."""
    runs = spark.read.json(f"{root}/runs")
    newest = runs.agg(F.max_by(F.struct(*runs.columns), F.to_timestamp("trained_at")).alias("r")).first()["r"]
    return newest.asDict()


def load_model(root: str, run_id: str) -> PipelineModel:
    return PipelineModel.load(f"{root}/models/run_id={run_id}")


def run_stamp() -> str:
    return datetime.now(timezone.utc).isoformat()
