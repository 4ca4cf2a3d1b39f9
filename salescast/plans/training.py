"""Tuning, fitting and evaluating boosted-tree models over all series."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from hashlib import sha256
from threading import Event
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salescast.functions.metrics import compare, forecast_errors
from salescast.operators.baselines import forecast_name
from salescast.operators.features import add_baseline_feature
from salescast.operators.selection import best_configuration
from salescast.operators.split import (
    cutoff_of_days,
    dated_split,
    dated_stage,
    stage,
    temporal_split,
    validation_split,
    validation_start_of_days,
    with_position,
)
from salescast.plans.configurations import CONFIGURATIONS, Configuration, penalty_share, regressor
from salescast.schema import (
    ALL_TARGETS,
    BASELINE_FEATURE,
    DATE,
    FEATURES,
    KEYS,
    RATIO_FEATURES,
)
from salescast.session import shared_dir, storage_memory
from salescast.sources.ledger import FINAL, TUNING, FitLedger, parameters_of

MODEL_FEATURES = [*FEATURES, BASELINE_FEATURE]
TUNING_SCHEMA = "target string, config_order int, configuration string, rows long, MAE double, RMSE double, R2 double"


def vector_names(features: Sequence[str] = MODEL_FEATURES) -> list[str]:
    """What each slot of the feature vector holds: the features, then a flag for each that may be missing."""
    return [*features, *[f"is_missing_{name}" for name in RATIO_FEATURES if name in features]]


def with_vector(rows: DataFrame, features: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """Add the feature vector, in the order of ``features``.

    Spark's trees have no branch for missing values: a missing ratio becomes 0
    and its flag 1. Rows that carry their vector already keep it.
    """
    if "features" in rows.columns:
        return rows
    rows = add_baseline_feature(rows, features)
    slots = {f"_slot_{name}": F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in features}
    flags = {f"_flag_{name}": F.col(name).isNull().cast("double") for name in RATIO_FEATURES if name in features}
    inputs = [*slots, *flags]
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    return assembler.transform(rows.withColumns({**slots, **flags})).drop(*inputs)


def store_training_rows(
    panel: DataFrame,
    path: str,
    keys: Sequence[str] = KEYS,
    cutoff: str | None = None,
    validation_start: str | None = None,
    features: Sequence[str] = MODEL_FEATURES,
) -> None:
    """Write the split panel once with its feature vectors, one folder per part.

    All fits read it from there: a lost executor re-reads its files instead of
    recomputing the panel from the facts, and each fit scans only its parts, the
    vector and one target.
    """
    parts = validation_split(temporal_split(panel, keys, cutoff), validation_start, keys)
    rows = with_vector(parts.withColumn("stage", stage(F.col("split"), F.col("tuning_part"))), features)
    rows.write.mode("overwrite").partitionBy("stage").parquet(path)


def store_dated_rows(
    panel: DataFrame,
    path: str,
    keys: Sequence[str] = KEYS,
    cutoff: str | None = None,
    features: Sequence[str] = MODEL_FEATURES,
) -> tuple[str | None, str | None]:
    """Write the panel split at common dates, one folder per part; returns cutoff and validation start.

    The panel is computed once. Its vectors are written beside ``path`` while its first and
    last day are observed; the parts follow from those dates and each series' first day,
    without a window or a shuffle. (None, None) for an empty panel.
    """
    first = F.min(DATE).over(Window.partitionBy(*keys))
    span = Observation("span")
    rows = with_vector(with_position(panel, keys).withColumn("_first", first), features)
    rows = rows.observe(span, F.min(DATE).alias("first"), F.max(DATE).alias("last"))
    rows.write.mode("overwrite").parquet(f"{path}_panel")
    days = span.get
    if days["first"] is None:
        return None, None
    cutoff = cutoff or cutoff_of_days(days["first"], days["last"])
    start = validation_start_of_days(days["first"], cutoff)
    stored = panel.sparkSession.read.parquet(f"{path}_panel")
    stages = {"split": dated_split(cutoff), "stage": dated_stage(F.col("_first"), cutoff, start)}
    parts = stored.withColumns(stages).drop("_first")
    parts.write.mode("overwrite").partitionBy("stage").parquet(path)
    return cutoff, start


def stage_rows(spark: SparkSession, path: str, stages: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).where(F.col("stage").isin(*stages))


FIT = ("train_fit",)
VALIDATION = ("train_validation",)
TRAIN = ("train_fit", "train_gap", "train_validation", "train_short")
TEST = ("test",)


def training_vectors(rows: DataFrame, target: str, features: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """The feature vector and one target."""
    return with_vector(rows, features).select("features", F.col(target).cast("double").alias(target))


def variances(rows: DataFrame, targets: Sequence[str]) -> dict[str, float | None]:
    """Variance of every target over the rows, in one pass."""
    return rows.agg(*[F.var_pop(F.col(t).cast("double")).alias(t) for t in targets]).first().asDict()


def fit(
    rows: DataFrame,
    target: str,
    configuration: Configuration,
    features: Sequence[str] = MODEL_FEATURES,
    variance: float | None = None,
) -> GBTRegressionModel:
    """Fit one target's trees. Penalties ask for the target's variance, which is computed if it isn't given."""
    if variance is None and penalty_share(configuration):
        variance = variances(rows, [target])[target]
    return regressor(configuration, target, variance).fit(training_vectors(rows, target, features))


def add_forecast(rows: DataFrame, model: GBTRegressionModel, target: str) -> DataFrame:
    """Add the model's forecast to rows that carry the feature vector."""
    return model.setPredictionCol(forecast_name(target)).transform(rows)


@dataclass
class TrainedRun:
    models: dict[str, GBTRegressionModel]
    best: dict[str, str]
    tuning: DataFrame
    rows_path: str
    status: str
    cutoff: str | None
    validation_start: str | None
    ledger: FitLedger
    variances: dict[str, float | None]

    def test_forecasts(self, spark: SparkSession) -> DataFrame:
        return forecast_all(stage_rows(spark, self.rows_path, TEST), self.models)


def forecast_all(
    rows: DataFrame, models: dict[str, GBTRegressionModel], features: Sequence[str] = MODEL_FEATURES
) -> DataFrame:
    """Forecasts of every model, side by side, in one pass over the rows."""
    scored = with_vector(rows, features)
    for target, model in models.items():
        scored = add_forecast(scored, model, target)
    return scored.drop("features")


def in_parallel(spark: SparkSession, work: Callable, tasks: Sequence, parallelism: int) -> list:
    """Results of ``work`` on every task. After a failure no further task is begun."""
    broken = Event()

    def guarded(task):
        if broken.is_set():
            return None
        try:
            return work(task)
        except BaseException:
            broken.set()
            raise

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(inheritable_thread_target(spark)(guarded), tasks))


# Storage memory for a row of a running fit: its bins, target, weight and running error, twice over.
BYTES_A_ROW = 500


def fits_at_once(rows: DataFrame, parallelism: int) -> int:
    """How many fits may run at a time: ``parallelism``, or as many as can keep ``rows`` in memory, one at least.

    Each fit keeps its own binned rows until its last tree. What finds no room goes to the
    executors' disks and is read from there for every level of every tree.
    """
    fit_bytes = max(1, rows.count()) * BYTES_A_ROW
    return max(1, min(parallelism, storage_memory(rows.sparkSession) // fit_bytes))


def tune(
    spark: SparkSession,
    rows_path: str,
    targets: Sequence[str] = ALL_TARGETS,
    configurations: Sequence[Configuration] = CONFIGURATIONS,
    parallelism: int = 4,
    ledger: FitLedger | None = None,
) -> DataFrame:
    """Validation errors of every configuration for every target, one row each.

    Each fit is recorded in the ledger as soon as it is judged, and one that the ledger
    has is not made again. Without fit or validation rows no error is known, and ``rows``
    is 0.
    """
    ledger = ledger or FitLedger(spark, f"{rows_path}_ledger")
    fit_rows = stage_rows(spark, rows_path, FIT)
    validation = stage_rows(spark, rows_path, VALIDATION)
    if fit_rows.isEmpty() or validation.isEmpty():
        return untuned(spark, targets, configurations)
    known = ledger.known()
    variance = variances(fit_rows, targets)

    def score(task: tuple[str, int, Configuration]) -> tuple:
        target, order, configuration = task
        name = (TUNING, target, configuration.name)
        parameters, *errors = known.get(name, (None,))
        if parameters != parameters_of(configuration):
            model = fit(fit_rows, target, configuration, variance=variance[target])
            scored = add_forecast(with_vector(validation), model, target)
            error = forecast_errors(scored, [compare(target, forecast_name(target), target=target)]).first()
            errors = [error["rows"], error["MAE"], error["RMSE"], error["R2"]]
            ledger.record(name, configuration, model, tuple(errors))
        return target, order, configuration.name, *errors

    tasks = [(t, order, c) for t in targets for order, c in enumerate(configurations)]
    scores = in_parallel(spark, score, tasks, fits_at_once(fit_rows, parallelism))
    return spark.createDataFrame(scores, TUNING_SCHEMA)


def untuned(spark: SparkSession, targets: Sequence[str], configurations: Sequence[Configuration]) -> DataFrame:
    """The tuning table of a run whose series can't be validated."""
    rows = [(t, order, c.name, 0, None, None, None) for t in targets for order, c in enumerate(configurations)]
    return spark.createDataFrame(rows, TUNING_SCHEMA)


def final_fits(
    spark: SparkSession,
    rows_path: str,
    wanted: Sequence[tuple[str, Configuration]],
    variance: dict[str, float | None],
    ledger: FitLedger,
    parallelism: int = 4,
) -> dict[tuple[str, str], GBTRegressionModel]:
    """Models of the whole train part by target and configuration, from the ledger where it has them."""
    train_rows = stage_rows(spark, rows_path, TRAIN)
    if train_rows.isEmpty():
        return {}
    known = ledger.known()

    def fit_final(task: tuple[str, Configuration]) -> GBTRegressionModel:
        target, configuration = task
        name = (FINAL, target, configuration.name)
        if known.get(name, (None,))[0] == parameters_of(configuration):
            return ledger.model(name)
        model = fit(train_rows, target, configuration, variance=variance[target])
        ledger.record(name, configuration, model)
        return model

    names = [(target, configuration.name) for target, configuration in wanted]
    fitted = in_parallel(spark, fit_final, wanted, fits_at_once(train_rows, parallelism))
    return dict(zip(names, fitted))


def train(
    panel: DataFrame,
    targets: Sequence[str] = ALL_TARGETS,
    configurations: Sequence[Configuration] = CONFIGURATIONS,
    keys: Sequence[str] = KEYS,
    rows_path: str | None = None,
    parallelism: int = 4,
    cutoff: str | None = None,
    identity: str | None = None,
) -> TrainedRun:
    """Tune every target, then fit its best configuration on the whole train part.

    The models are pooled: each learns from all series. Passing a panel of one
    series gives that series its own models. All train parts end on one date,
    ``cutoff`` or else 80 % of the way through the panel's days, and all validation
    parts begin on one date, so that no model learns from days later than those it
    is judged on. A run whose series can't be validated takes the first
    configuration (``status`` insufficient_history); one without train rows has no model.

    A run with an ``identity`` that was broken off goes on where it stopped if it is
    called again with the same ``rows_path``: from the rows stored then, with the fits in
    its ledger.
    """
    spark = panel.sparkSession
    # Asked for in any case: without a checkpoint folder the fits' lineage would grow with every tree.
    folder = shared_dir(spark)
    rows_path = rows_path or f"{folder}/training-rows-{uuid4().hex}"
    identity = identity or uuid4().hex
    ledger = FitLedger(spark, f"{rows_path}_ledger/{sha256(identity.encode()).hexdigest()[:16]}")
    state = ledger.state(identity)
    if state is None:
        state = dict(zip(("cutoff", "validation_start"), store_dated_rows(panel, rows_path, keys, cutoff)))
        ledger.begin(identity, state)
    start = state["validation_start"]
    if start is None:  # no row at all
        nothing = untuned(spark, targets, configurations)
        return TrainedRun({}, {}, nothing, rows_path, "insufficient_history", cutoff, None, ledger, {})
    tuning = tune(spark, rows_path, targets, configurations, parallelism, ledger)
    # One row per target.
    best = {row["target"]: row["configuration"] for row in best_configuration(tuning).collect()}
    status = "ok" if best else "insufficient_history"
    by_name = {c.name: c for c in configurations}
    chosen = {target: by_name[best.get(target, configurations[0].name)] for target in targets}
    variance = variances(stage_rows(spark, rows_path, TRAIN), targets)
    fitted = final_fits(spark, rows_path, list(chosen.items()), variance, ledger, parallelism)
    models = {target: model for (target, _), model in fitted.items()}
    best = {target: chosen[target].name for target in models}
    return TrainedRun(models, best, tuning, rows_path, status, state["cutoff"], start, ledger, variance)
