"""Trained runs on shared storage: one folder per model, and tables about them."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescast.plans.configurations import CONFIGURATIONS, PARAMETERS, Configuration
from salescast.plans.training import MODEL_FEATURES, TrainedRun, vector_names
from salescast.sources.ledger import read_if_there
from salescast.schema import (
    AMOUNT,
    BASELINE_FEATURE,
    DATE,
    DIRECT_TARGET,
    GAP_DAYS,
    HISTORY_START,
    KEYS,
    TIME_ZONE,
)

_KINDS = {"int": "int", "float": "double"}
# What a configuration names, and what its fitted model holds.
EFFECTIVE = ["trees", "step_size", "tree_depth", "bins", "nodes", "min_info_gain", "target_variance"]
CHOICE_SCHEMA = (
    "target string, target_order int, is_direct boolean, configuration string, "
    + ", ".join(f"{name} {_KINDS[Configuration.__annotations__[name]]}" for name in PARAMETERS)
    + ", trees int, step_size double, tree_depth int, bins int, nodes int, min_info_gain double, target_variance double"
)
INFO_SCHEMA = "gap_days int, direct_target string, direct_baseline_feature string, settings string"
STARTED_SCHEMA = "settings string, started timestamp"


@dataclass(frozen=True)
class Settings:
    """How a run's panel was made: scoring makes its rows in the same way."""

    keys: tuple[str, ...] = tuple(KEYS)
    key_types: tuple[str, ...] = ("bigint", "bigint")
    date: str = DATE
    amount: str = AMOUNT
    time_zone: str = TIME_ZONE
    start: str = HISTORY_START
    own_holidays: bool = False
    cutoff: str | None = None
    validation_start: str | None = None
    status: str = "ok"
    # Whether each series has its own choice of models.
    by_series: bool = False


# Models read or written at a time.
PARALLELISM = 8


def _model(root: str, target: str, run_id: str) -> str:
    return f"{root}/models/{run_id}/{target}"


def _routed_model(root: str, target: str, configuration: str, run_id: str) -> str:
    return f"{root}/routed_models/{run_id}/{target}/{configuration}"


def _table(root: str, name: str, run_id: str) -> str:
    return f"{root}/{name}/run_id={run_id}"


def is_complete(spark: SparkSession, root: str, run_id: str) -> bool:
    """Whether the run's ``info``, which is written last, is there."""
    return not read_if_there(spark, _table(root, "info", run_id), INFO_SCHEMA).isEmpty()


def refuse_existing(spark: SparkSession, root: str, run_id: str) -> None:
    if is_complete(spark, root, run_id):
        raise ValueError(f"run {run_id} is stored already")


def start_run(spark: SparkSession, root: str, run_id: str, settings: Settings) -> None:
    """Note that a run has begun. Only one that also has its ``info`` is complete."""
    refuse_existing(spark, root, run_id)
    started = spark.sql("SELECT current_timestamp()").first()[0]
    rows = spark.createDataFrame([(json.dumps(asdict(settings)), started)], STARTED_SCHEMA)
    rows.coalesce(1).write.mode("overwrite").parquet(_table(root, "started", run_id))


def save_run(
    run: TrainedRun,
    reports: Mapping[str, DataFrame],
    root: str,
    run_id: str,
    settings: Settings,
    features: Sequence[str] = MODEL_FEATURES,
    configurations: Sequence[Configuration] = CONFIGURATIONS,
    holidays: DataFrame | None = None,
    routes: DataFrame | None = None,
    routed: Mapping[tuple[str, str], GBTRegressionModel] | None = None,
) -> None:
    """Write the models, what was chosen, how the panel was made, and the reports.

    A complete run is never written over. ``info`` is written last, so a run that
    has it is complete; what an unfinished one left is replaced.
    """
    spark = run.tuning.sparkSession
    refuse_existing(spark, root, run_id)

    folders = {_model(root, target, run_id): model for target, model in run.models.items()}
    folders |= {_routed_model(root, *name, run_id): model for name, model in (routed or {}).items()}

    def save(folder: str) -> None:
        folders[folder].write().overwrite().save(folder)

    with ThreadPoolExecutor(PARALLELISM) as pool:
        list(pool.map(inheritable_thread_target(spark)(save), folders))
    by_name = {c.name: asdict(c) for c in configurations}
    choices = []
    for order, (target, model) in enumerate(run.models.items()):
        chosen = by_name[run.best[target]]
        held = (
            *(model.getNumTrees, model.getStepSize(), model.getMaxDepth(), model.getMaxBins(), model.totalNumNodes),
            *(model.getMinInfoGain(), run.variances[target]),
        )
        nominal = [chosen[name] for name in PARAMETERS]
        choices.append((target, order, target == DIRECT_TARGET, chosen["name"], *nominal, *held))
    small = {
        "choices": spark.createDataFrame(choices, CHOICE_SCHEMA),
        "features": spark.createDataFrame(list(enumerate(features)), "feature_order int, feature string"),
        "tuning": run.tuning,
    }
    if DIRECT_TARGET in run.models:
        small["importance"] = feature_importance(spark, run.models[DIRECT_TARGET], features)
    if holidays is not None:
        small["holidays"] = holidays.select("holiday_date")
    if routes is not None:
        small["routes"] = routes
    info = (GAP_DAYS, DIRECT_TARGET, BASELINE_FEATURE, json.dumps(asdict(settings)))
    for name, table in {**small, **reports, "info": spark.createDataFrame([info], INFO_SCHEMA)}.items():
        table.write.mode("overwrite").parquet(_table(root, name, run_id))


def read_table(spark: SparkSession, root: str, name: str, run_id: str) -> DataFrame:
    return spark.read.parquet(_table(root, name, run_id)).withColumn("run_id", F.lit(run_id))


def run_settings(spark: SparkSession, root: str, run_id: str) -> Settings:
    rows = read_if_there(spark, _table(root, "info", run_id), INFO_SCHEMA).collect()
    if not rows:
        raise ValueError(f"run {run_id} is not complete")
    stored = json.loads(rows[0]["settings"])
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in stored.items()})


def run_holidays(spark: SparkSession, root: str, run_id: str, settings: Settings | None = None) -> DataFrame | None:
    """The caller's holiday table the run was trained with, if it had one."""
    if not (settings or run_settings(spark, root, run_id)).own_holidays:
        return None
    return read_table(spark, root, "holidays", run_id).select("holiday_date")


def model_features(spark: SparkSession, root: str, run_id: str) -> list[str]:
    """The run's feature list, in model order. It is as short as the model is wide."""
    return [row["feature"] for row in read_table(spark, root, "features", run_id).orderBy("feature_order").collect()]


def _load(spark: SparkSession, folders: Sequence[str]) -> list[GBTRegressionModel]:
    with ThreadPoolExecutor(PARALLELISM) as pool:
        return list(pool.map(inheritable_thread_target(spark)(GBTRegressionModel.load), folders))


def load_models(
    spark: SparkSession, root: str, run_id: str, settings: Settings | None = None
) -> dict[str, GBTRegressionModel]:
    """The models of a complete run, by target."""
    if settings is None:
        run_settings(spark, root, run_id)
    choices = read_table(spark, root, "choices", run_id).orderBy("target_order").collect()
    targets = [row["target"] for row in choices]
    return dict(zip(targets, _load(spark, [_model(root, target, run_id) for target in targets])))


def load_routed(
    spark: SparkSession, root: str, run_id: str
) -> tuple[DataFrame, dict[tuple[str, str], GBTRegressionModel], dict[str, str]]:
    """Routes, models by target and configuration, and the default configurations of a run by series."""
    routes = read_table(spark, root, "routes", run_id).drop("run_id")
    default = {r["target"]: r["configuration"] for r in read_table(spark, root, "choices", run_id).collect()}
    # At most a row for each target and configuration.
    used = {(r["target"], r["configuration"]) for r in routes.select("target", "configuration").distinct().collect()}
    names = sorted(used | set(default.items()))
    return routes, dict(zip(names, _load(spark, [_routed_model(root, *name, run_id) for name in names]))), default


def run_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """One row per run under ``root``: run_id, started, status, chosen configurations and errors.

    A run that has begun and has no ``info`` is ``incomplete``, and nothing else of it is
    shown. The tables are found by their partitions, and a filter on ``run_id`` reads only
    the run's own.
    """

    def every(name: str, schema: str) -> DataFrame:
        return read_if_there(spark, f"{root}/{name}", f"{schema}, run_id string")

    started, info = every("started", STARTED_SCHEMA), every("info", INFO_SCHEMA)
    choices = every("choices", CHOICE_SCHEMA).groupBy("run_id")
    choices = choices.agg(F.map_from_entries(F.collect_list(F.struct("target", "configuration"))).alias("configurations"))
    metrics = every("metrics", "model string, rows long, MAE double, RMSE double, R2 double").groupBy("run_id")
    errors = F.struct("model", F.struct("rows", "MAE", "RMSE", "R2"))
    metrics = metrics.agg(F.map_from_entries(F.collect_list(errors)).alias("errors"))
    status = F.coalesce(F.get_json_object("settings", "$.status"), F.lit("incomplete")).alias("status")
    complete = info.select("run_id", "settings").join(choices, "run_id", "left").join(metrics, "run_id", "left")
    runs = started.select("run_id", "started").join(complete, "run_id", "left")
    shown = [F.when(F.col("settings").isNotNull(), F.col(name)).alias(name) for name in ("configurations", "errors")]
    return runs.select("run_id", "started", status, *shown)


def model_info(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """One row describing a run: targets, features, chosen configurations, metrics."""
    choices = read_table(spark, root, "choices", run_id)
    chosen = F.struct("configuration", *PARAMETERS, *EFFECTIVE)
    ordered = F.sort_array(F.collect_list(F.when(~F.col("is_direct"), F.struct("target_order", "target"))))
    configured = choices.groupBy("run_id").agg(
        F.transform(ordered, lambda entry: entry["target"]).alias("targets"),
        F.map_from_entries(F.collect_list(F.when(~F.col("is_direct"), F.struct("target", chosen)))).alias(
            "best_configs"
        ),
        F.max(F.when(F.col("is_direct"), chosen)).alias("direct_best_config"),
    )
    listed = F.sort_array(F.collect_list(F.struct("feature_order", "feature")))
    features = read_table(spark, root, "features", run_id).groupBy("run_id")
    features = features.agg(F.transform(listed, lambda entry: entry["feature"]).alias("features"))
    metrics = read_table(spark, root, "metrics", run_id).groupBy("run_id")
    metrics = metrics.agg(
        F.map_from_entries(F.collect_list(F.struct("model", F.struct("MAE", "RMSE", "R2")))).alias("metrics")
    )
    info = read_table(spark, root, "info", run_id)
    return info.join(configured, "run_id").join(features, "run_id").join(metrics, "run_id")


def feature_importance(
    spark: SparkSession, model: GBTRegressionModel, features: Sequence[str] = MODEL_FEATURES
) -> DataFrame:
    """Splits on each feature over all trees, most first, and the share of the squared error they removed.

    A split on a feature's missing-flag counts for the feature. The trees' nodes pass
    the driver, as many as the model has.
    """
    slots = vector_names(features)
    owner = [name.removeprefix("is_missing_") for name in slots]
    splits, gain = dict.fromkeys(features, 0), dict.fromkeys(features, 0.0)
    for name, share in zip(owner, model.featureImportances.toArray()):
        gain[name] += float(share)
    for slot in split_slots(model):
        splits[owner[slot]] += 1
    rows = [(name, splits[name], gain[name]) for name in features]
    table = spark.createDataFrame(rows, "feature string, importance long, error_share double")
    return table.orderBy(F.desc("importance"), "feature")


def split_slots(model: GBTRegressionModel) -> list[int]:
    """The vector slot of every inner node of every tree."""
    found = []
    for tree in model.trees:
        nodes = [tree._call_java("rootNode")]
        while nodes:
            node = nodes.pop()
            if node.getClass().getSimpleName() == "InternalNode":
                found.append(node.split().featureIndex())
                nodes += [node.leftChild(), node.rightChild()]
    return found
