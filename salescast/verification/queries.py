"""One query per operator, each over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace
from functools import reduce
from operator import and_
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salescast.functions.calendar import calendar_columns, holidays_of_years, with_holiday_flag
from salescast.functions.metrics import compare, forecast_errors
from salescast.functions.numeric import to_numbers
from salescast.operators import baselines, daily, features, quality, regression, split
from salescast.operators.selection import best_configuration
from salescast.plans import configurations, evaluation, jobs, panel, routing, scoring, training
from salescast.schema import (
    ALL_TARGETS,
    BASELINE_FEATURE,
    DATE,
    DIRECT_TARGET,
    KEYS,
    RATIO_FEATURES,
    TARGETS,
)
from salescast.session import shared_dir
from salescast.sources import registry, tables
from salescast.sources.retail import FIRST_DAY, retail_sales

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the queries whose feature is a filter.
SCAN_START = "2000-01-01"
VALIDATION_START = "1999-07-01"
ONE_SERIES = {KEYS[0]: 8, KEYS[1]: "PROMO"}

MEANS = ["quantity_mean_7d", "quantity_mean_14d", "quantity_mean_28d"]
SUMS = ["quantity_sum_7d", "quantity_sum_14d", "quantity_sum_28d", "quantity_sum_56d"]
OFFSET_SUMS = ["quantity_sum_previous_7d", "quantity_sum_previous_14d", "quantity_sum_previous_28d"]
LAGS = [f"quantity_lag_{k}" for k in features.LAGS]
CALENDAR = ["day_of_week", "month", "day_of_year", "sin_day_of_year", "cos_day_of_year", "is_weekend"]

# Decimals at which floating-point columns are compared. Quotients of whole
# sums often end in a 5 at the seventh decimal, where engines round differently.
DIGITS = {
    **{name: 6 for name in [*MEANS, "quantity_std_28d", BASELINE_FEATURE]},
    **{name: 9 for name in [*RATIO_FEATURES, "sin_day_of_year", "cos_day_of_year"]},
}
ERRORS = {"MAE": 6, "RMSE": 6, "R2": 6}


def rounded(df: DataFrame, digits: Mapping[str, int] = DIGITS) -> DataFrame:
    return df.withColumns({name: F.round(name, d) for name, d in digits.items() if name in df.columns})


def rounded_all(df: DataFrame, names: list[str]) -> DataFrame:
    return rounded(df, {name: 6 for name in names})


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.sales_scan(retail_sales(spark, sf_dir), start=FIRST_DAY)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.daily_sales(_scan(spark, sf_dir))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.dense_daily(_daily(spark, sf_dir))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.training_panel(retail_sales(spark, sf_dir), start=FIRST_DAY)


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.temporal_split(_panel(spark, sf_dir))


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.with_chosen_baselines(_panel(spark, sf_dir))


# Scans and sources


def sales_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.sales_scan(retail_sales(spark, sf_dir), start=SCAN_START)


def sales_scan_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.only_series(_scan(spark, sf_dir), ONE_SERIES)


def holiday_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = _scan(spark, sf_dir).select(F.year(DATE).alias("year")).distinct()
    return holidays_of_years(years)


def sample_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three features and a target, written as CSV with a header and read back by schema."""
    path = f"{shared_dir(spark)}/sample-{uuid4().hex}"
    sample = _panel(spark, sf_dir).select(
        F.col("quantity_mean_7d").alias("feature_1"),
        F.col("quantity_mean_28d").alias("feature_2"),
        F.col("quantity_lag_7").alias("feature_3"),
        F.col("target_1d").alias("target"),
    )
    sample.write.csv(path, header=True)
    return rounded_all(tables.read_csv(spark, path), ["feature_1", "feature_2"])


def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as text, some with a suffix and some not numbers at all."""
    quantity = F.col("l_quantity").cast("string")
    text = (
        F.when(F.col("l_returnflag") == "R", F.col("l_returnflag"))
        .when(F.col("l_returnflag") == "N", F.concat(quantity, F.lit("d")))
        .otherwise(F.concat(F.lit(" "), quantity))
    )
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    texts = lines.select("l_orderkey", "l_linenumber", text.alias("amount"), F.col("l_tax").alias("tax"))
    return to_numbers(texts, ["amount", "tax"])


# Daily series


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir)


def series_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.series_bounds(_daily(spark, sf_dir))


def calendar_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.calendar_spine(_daily(spark, sf_dir))


def dense_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir)


# Features and targets


def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_lags(_dense(spark, sf_dir))


def _rolling(names: list[str]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(features.add_rolling(_dense(spark, sf_dir)).select(*KEYS, DATE, *names))

    return query


def lead_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_targets(_dense(spark, sf_dir)).select(*KEYS, DATE, *TARGETS)


def target_sum_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_targets(_dense(spark, sf_dir)).select(*KEYS, DATE, DIRECT_TARGET)


def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _dense(spark, sf_dir).withColumns(calendar_columns(F.col(DATE)))
    return rounded(days.select(*KEYS, DATE, *CALENDAR))


def holiday_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_holiday_flag(_dense(spark, sf_dir), DATE).select(*KEYS, DATE, "is_holiday")


def ratio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolling = features.add_ratios(features.add_rolling(_dense(spark, sf_dir)))
    return rounded(rolling.select(*KEYS, DATE, *RATIO_FEATURES))


def training_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_panel(spark, sf_dir))


def series_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.series_panel(retail_sales(spark, sf_dir), ONE_SERIES, start=FIRST_DAY))


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.feature_matrix(_panel(spark, sf_dir)))


def target_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.target_matrix(_panel(spark, sf_dir))


def baseline_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.add_baseline_feature(_panel(spark, sf_dir), training.MODEL_FEATURES)
    return rounded(rows.select(*KEYS, DATE, BASELINE_FEATURE))


STORED_BUCKETS = 16


def stored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel from a daily table that is bucketed by series and sorted by day."""
    name = f"daily_{uuid4().hex}"
    tables.store_daily(_daily(spark, sf_dir), name, STORED_BUCKETS, path=f"{shared_dir(spark)}/{name}")
    return rounded(tables.stored_panel(spark, name))


# Splits and data quality


def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select(*KEYS, DATE, "position", "train_rows", "split")


def cutoff_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.temporal_split(_panel(spark, sf_dir), cutoff=SCAN_START)
    return rows.select(*KEYS, DATE, "position", "train_rows", "split")


def cutoff_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.temporal_split(_panel(spark, sf_dir), cutoff=SCAN_START)
    parts = split.validation_split(rows, VALIDATION_START)
    return parts.select(*KEYS, DATE, "position", "tuning_part", "tuning_status")


def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split.validation_split(_split(spark, sf_dir))
    return parts.select(*KEYS, DATE, "position", "tuning_part", "tuning_status")


def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_summary(_split(spark, sf_dir))


def target_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(quality.describe_columns(_panel(spark, sf_dir)), ["mean", "std"])


def target_describe_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(quality.describe_pooled(_panel(spark, sf_dir)), ["mean", "std"])


def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.null_counts(_panel(spark, sf_dir))


def panel_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(split.head_and_tail(_panel(spark, sf_dir)))


# Baselines, selection and evaluation


def baseline_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["baseline_horizon", "baseline_7d", "baseline_28d"]
    return rounded_all(baselines.baseline_forecasts(_panel(spark, sf_dir)).select(*KEYS, DATE, *names), names)


def baseline_horizon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = _split(spark, sf_dir).where(F.col("split") == "test")
    pairs = [compare(target, "quantity_mean_28d", horizon=target) for target in TARGETS]
    return rounded(forecast_errors(test, pairs), ERRORS)


def tuning_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.baseline_tuning(_split(spark, sf_dir)), ERRORS)


def config_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuning = evaluation.baseline_tuning(_split(spark, sf_dir))
    return rounded(best_configuration(tuning, [*KEYS, "target"]), ERRORS)


def config_selection_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuning = evaluation.baseline_tuning(_split(spark, sf_dir), by=[])
    return rounded(best_configuration(tuning), ERRORS)


def series_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of every series and target, learned from its train part."""
    lines = regression.series_regressions(_split(spark, sf_dir), F.col("split") == "train")
    return rounded_all(lines, ["slope", "intercept"])


def chosen_horizon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = evaluation.horizon_metrics(_chosen(spark, sf_dir))
    return rounded_all(table, [name for name in table.columns if name != "horizon"])


def multi_horizon_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chosen(spark, sf_dir).withColumn("forecast_multi", baselines.multi_horizon_sum())
    return rounded_all(rows.select(*KEYS, DATE, "forecast_multi"), ["forecast_multi"])


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.model_comparison(_chosen(spark, sf_dir)), ERRORS)


def model_comparison_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.model_comparison(_chosen(spark, sf_dir), KEYS), ERRORS)


def improvement_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    comparison = evaluation.model_comparison(_chosen(spark, sf_dir), KEYS)
    table = evaluation.improvement_over_baseline(comparison, KEYS)
    return rounded_all(table, ["direct_mae", "baseline_mae", "improvement_percent"])


def prediction_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(evaluation.prediction_examples(_chosen(spark, sf_dir)), ["direct", "multi", "baseline_28d"])


def config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tuning jobs: every target with every configuration, and the rows each fits and validates on."""
    parts = split.validation_split(_split(spark, sf_dir)).agg(
        F.count_if(F.col("tuning_part") == "fit").alias("fit_rows"),
        F.count_if(F.col("tuning_part") == "validation").alias("validation_rows"),
    )
    jobs = parts.select(F.explode(F.array(*map(F.lit, ALL_TARGETS))).alias("target"), "*")
    return configurations.with_configurations(jobs)


# Scoring with the 28-day mean


def latest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.latest_features(_daily(spark, sf_dir)))


def latest_features_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.latest_features(_daily(spark, sf_dir), as_of="labelled"))


def predict_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(scoring.baseline_batch(_daily(spark, sf_dir)))


def _flat(responses: DataFrame) -> DataFrame:
    """The forecasts as columns, at six decimals."""
    horizons = [F.round(F.col("predictions")[target], 6).alias(target) for target in TARGETS]
    totals = [F.round(name, 6).alias(name) for name in ("total_quantity_7d", "direct_quantity_7d")]
    ids = [name for name in responses.columns if name in (*KEYS, *tables.REQUEST_KEYS)]
    return responses.select(*ids, "last_date", *horizons, *totals, "status")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for every series of the next unit, and one without item; the last unit has no sales."""
    unit, item = tables.REQUEST_KEYS
    asked = _scan(spark, sf_dir).select((F.col(KEYS[0]) + 1).alias(unit), F.col(KEYS[1]).alias(item))
    return asked.union(asked.withColumn(item, F.lit(None).cast("string"))).distinct()


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _requests(spark, sf_dir)
    wanted = requests.withColumnsRenamed(dict(zip(tables.REQUEST_KEYS, KEYS)))
    sold = scoring.requested_daily(_scan(spark, sf_dir), wanted)
    return scoring.answer_requests(requests, scoring.baseline_batch(sold, spread=False))


def predict_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_answers(spark, sf_dir))


def predict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer as a JSON object."""
    answers = _answers(spark, sf_dir)
    values = F.transform_values("predictions", lambda _, value: F.round(value, 6))
    shown = answers.select(
        *tables.REQUEST_KEYS,
        "last_date",
        values.alias("predictions"),
        F.round("total_quantity_7d", 6).alias("total_quantity_7d"),
        "status",
    )
    return scoring.to_json_rows(shown)


def published_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days' answers in one folder: the first day's written, the second's, and the first's again.

    The first run of the first day has only the series of one unit; the rerun replaces it.
    """
    path = f"{shared_dir(spark)}/published-{uuid4().hex}"
    sold = _daily(spark, sf_dir)
    last = _flat(scoring.baseline_batch(sold))
    labelled = _flat(scoring.baseline_batch(sold, as_of="labelled"))
    tables.write_forecasts(last.where(F.col(KEYS[0]) == ONE_SERIES[KEYS[0]]), path, "parquet", as_of="first")
    tables.write_forecasts(labelled, path, "parquet", as_of="second")
    tables.write_forecasts(last, path, "parquet", as_of="first")
    return spark.read.parquet(path)


# Boosted trees

Grid = tuple[configurations.Configuration, ...]
# The six configurations with two trees each, as the SQL of ``model_info`` has them; depth, step,
# bins and the rest are the built-in ones.
CHECK_TREES = 2
CHECK_CONFIGURATIONS = tuple(replace(c, n_estimators=CHECK_TREES) for c in configurations.CONFIGURATIONS)
RUN_ID = "check"
_runs: dict[tuple[str, str, Grid], tuple[training.TrainedRun, str]] = {}
_errors: set[str] = set()


def _run(
    spark: SparkSession, sf_dir: str, grid: Grid = configurations.CONFIGURATIONS
) -> tuple[training.TrainedRun, str]:
    """The run of these tables and this grid, trained and stored once per application; the first query pays for it."""
    key = (spark.sparkContext.applicationId, sf_dir, grid)
    if key not in _runs:
        root = f"{shared_dir(spark)}/runs-{uuid4().hex}"
        sales = retail_sales(spark, sf_dir)
        run = jobs.run_training(sales, root, RUN_ID, start=FIRST_DAY, configurations=grid)
        _runs[key] = run, root
    return _runs[key]


def _finite(*names: str) -> Column:
    """Whether every column holds a number."""
    return reduce(and_, [F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")) for n in names])


STUMP = configurations.Configuration("stump", 1, 1.0, 2, -1, 1, 1.0, 1.0, 0.0, 0.0)
TWO_STUMPS = configurations.Configuration("two_stumps", 2, 0.5, 2, -1, 1, 1.0, 1.0, 0.0, 0.0)
STUMP_FEATURES = ["day_of_week", "month", "is_weekend", "is_holiday"]


def gbt_stump_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree of depth one on four calendar features, learned from the whole train part: every value is checked."""
    rows = _panel(spark, sf_dir)
    parts = split.temporal_split(rows, cutoff=split.common_cutoff(rows))
    model = training.fit(parts.where(F.col("split") == "train"), TARGETS[0], STUMP, STUMP_FEATURES)
    scored = training.forecast_all(parts.where(F.col("split") == "test"), {TARGETS[0]: model}, STUMP_FEATURES)
    name = baselines.forecast_name(TARGETS[0])
    return rounded_all(scored.select(*KEYS, DATE, TARGETS[0], name), [name])


def tuning_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target and configuration, the rows it was validated on, and whether its errors are numbers."""
    tuning = _run(spark, sf_dir)[0].tuning
    return tuning.select("target", "config_order", "configuration", "rows", _finite(*ERRORS).alias("has_errors"))


def gbt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each final model: whether it has all trees of its configuration, and whether that had the lowest error (ties: the first)."""
    run, _ = _run(spark, sf_dir)
    best = {r["target"]: r["configuration"] for r in best_configuration(run.tuning).collect()}
    by_name = {c.name: c for c in configurations.CONFIGURATIONS}
    rows = []
    for target, model in run.models.items():
        configuration = by_name[run.best[target]]
        wanted = configurations.least_gain(configuration, run.variances[target])
        follows = abs(model.getMinInfoGain() - wanted) <= 1e-12 * wanted
        all_trees = model.getNumTrees == configuration.n_estimators
        held = all_trees, model.getMaxBins(), run.best[target] == best[target]
        rows.append((target, *held, follows, run.variances[target]))
    schema = "target string, has_all_trees boolean, bins int, is_best boolean, gain_follows boolean, target_variance double"
    return rounded_all(spark.createDataFrame(rows, schema), ["target_variance"])


def gbt_two_stumps_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of trees of depth one, the second with step 0.5, on four calendar features: every value is checked."""
    rows = _panel(spark, sf_dir)
    parts = split.temporal_split(rows, cutoff=split.common_cutoff(rows))
    model = training.fit(parts.where(F.col("split") == "train"), TARGETS[0], TWO_STUMPS, STUMP_FEATURES)
    scored = training.forecast_all(parts.where(F.col("split") == "test"), {TARGETS[0]: model}, STUMP_FEATURES)
    name = baselines.forecast_name(TARGETS[0])
    return rounded_all(scored.select(*KEYS, DATE, TARGETS[0], name), [name])


def gbt_selection_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series' and target's choice: the rows it was judged on, and whether no configuration is better or as good and earlier."""
    run, errors = _series_errors(spark, sf_dir)
    chosen = routing.series_routes(errors)
    others = errors.groupBy(*KEYS, "target").agg(
        F.min("MAE").alias("least"), F.collect_list(F.struct("config_order", "MAE")).alias("all")
    )
    tied = F.filter("all", lambda row: row["MAE"] <= F.col("least") + F.abs("least") * 1e-9)
    first = F.array_min(F.transform(tied, lambda row: row["config_order"]))
    judged = chosen.join(others, [*KEYS, "target"]).withColumn("is_first_of_least", F.col("config_order") == first)
    return judged.select(*KEYS, "target", "rows", "is_first_of_least")


def gbt_routed_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows answered by their series' own tuned models, and whether each forecast is that of the model alone."""
    run, errors = _series_errors(spark, sf_dir)
    routes = routing.series_routes(errors)
    tuned = _tuned(spark, sf_dir)
    test = training.stage_rows(spark, run.rows_path, training.TEST)
    name = baselines.forecast_name(DIRECT_TARGET)
    routed = routing.forecast_routed(test, routes, tuned, run.best)
    own = routes.where(F.col("target") == DIRECT_TARGET).select(*KEYS, F.col("configuration").alias("own"))
    alone = routed.withColumn("routed", F.col(name)).join(own, list(KEYS), "left")
    alone = routing.with_all_forecasts(alone, {n: m for n, m in tuned.items() if n[0] == DIRECT_TARGET})
    wanted = F.lit(None).cast("double")
    for target, configuration in tuned:
        if target == DIRECT_TARGET:
            own_name = F.coalesce("own", F.lit(run.best[DIRECT_TARGET]))
            wanted = F.when(own_name == configuration, F.col(f"_{target}_{configuration}")).otherwise(wanted)
    forecasts = _finite(*[baselines.forecast_name(t) for t in ALL_TARGETS])
    return alone.select(*KEYS, DATE, (F.col("routed") == wanted).alias("is_its_own"), forecasts.alias("has_forecasts"))


def run_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check's run and one that was only begun, with the error of the 28-day baseline."""
    _, root = _run(spark, sf_dir)
    if not registry.run_catalogue(spark, root).where("run_id = 'begun'").count():
        registry.start_run(spark, root, "begun", registry.Settings())
    runs = registry.run_catalogue(spark, root)
    return runs.select(
        "run_id",
        "status",
        F.size(F.map_keys("configurations")).alias("targets"),
        F.round(F.col("errors")["baseline_28d"]["MAE"], 6).alias("baseline_mae"),
    )


def _tuned(spark: SparkSession, sf_dir: str) -> routing.Models:
    run, _ = _run(spark, sf_dir)
    return routing.tuned_models(run.ledger, ALL_TARGETS)


def _series_errors(spark: SparkSession, sf_dir: str) -> tuple[training.TrainedRun, DataFrame]:
    """Validation errors of the check's run by series, computed and stored once per run."""
    run, _ = _run(spark, sf_dir)
    path = f"{run.rows_path}_errors"
    if path not in _errors:
        errors = routing.tuning_by_series(spark, run.rows_path, _tuned(spark, sf_dir))
        errors.write.parquet(path)
        _errors.add(path)
    return run, spark.read.parquet(path)


def gbt_test_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows with their targets, and whether all eight forecasts are numbers."""
    rows = _run(spark, sf_dir)[0].test_forecasts(spark)
    forecasts = _finite(*[baselines.forecast_name(t) for t in ALL_TARGETS])
    return rows.select(*KEYS, DATE, *ALL_TARGETS, forecasts.alias("has_forecasts"))


def model_horizon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per horizon the baseline's errors; whether the model's are numbers and the improvement follows from them."""
    table = evaluation.horizon_metrics(_run(spark, sf_dir)[0].test_forecasts(spark))
    improvement = (1 - F.col("model_mae") / F.col("baseline_mae")) * 100
    follows = _finite("model_mae", "model_rmse", "model_r2") & (
        F.abs(F.col("improvement_percent") - improvement) < 1e-9
    )
    shown = table.select("horizon", "baseline_mae", "baseline_rmse", follows.alias("model_follows"))
    return rounded_all(shown, ["baseline_mae", "baseline_rmse"])


def gbt_model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baselines' errors, and of the models that they are numbers over the same rows."""
    table = evaluation.model_comparison(_run(spark, sf_dir)[0].test_forecasts(spark))
    is_baseline = F.col("model").startswith("baseline")
    shown = [F.when(is_baseline, F.round(name, 6)).alias(name) for name in ERRORS]
    return table.select("model", "rows", *shown, _finite(*ERRORS).alias("has_errors"))


def gbt_prediction_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, root = _run(spark, sf_dir)
    stored = registry.read_table(spark, root, "examples", RUN_ID)
    shown = stored.select(*KEYS, DATE, "actual", "baseline_28d", _finite("direct", "multi").alias("has_forecasts"))
    return rounded_all(shown, ["baseline_28d"])


def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature; whether the splits add up to the direct model's inner nodes, and their error shares to one (no split: to none)."""
    run, root = _run(spark, sf_dir)
    model = run.models[DIRECT_TARGET]
    inner = sum(tree.numNodes // 2 for tree in model.trees)
    table = registry.read_table(spark, root, "importance", RUN_ID)
    everything = Window.partitionBy("run_id")
    adds_up = F.sum("importance").over(everything) == inner
    shares = F.abs(F.sum("error_share").over(everything) - (1 if inner else 0)) < 1e-9
    return table.select("feature", adds_up.alias("splits_add_up"), shares.alias("shares_add_up"))


def model_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored run's lists, and the trees and bins that its models really hold."""
    _, root = _run(spark, sf_dir, CHECK_CONFIGURATIONS)
    info = registry.model_info(spark, root, RUN_ID)
    held = F.concat(F.map_values("best_configs"), F.array("direct_best_config"))
    return info.select(
        "run_id",
        "gap_days",
        "direct_target",
        "direct_baseline_feature",
        F.array_join("targets", ",").alias("targets"),
        F.array_join("features", ",").alias("features"),
        F.array_join(F.array_distinct(F.transform(held, lambda c: c["trees"].cast("string"))), ",").alias("trees"),
        F.array_join(F.array_distinct(F.transform(held, lambda c: c["bins"].cast("string"))), ",").alias("bins"),
        F.array_join(F.array_sort(F.map_keys("metrics")), ",").alias("compared"),
    )


def model_registry_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows, and those forecast differently by the models read back from storage, per target."""
    run, root = _run(spark, sf_dir)
    stored = registry.load_models(spark, root, RUN_ID)
    names = {baselines.forecast_name(t): t for t in ALL_TARGETS}
    memory = run.test_forecasts(spark).withColumnsRenamed({n: f"memory_{n}" for n in names})
    rows = training.forecast_all(memory, stored)
    compared = [
        F.struct(F.lit(t).alias("target"), (F.col(n) != F.col(f"memory_{n}")).alias("differs")) for n, t in names.items()
    ]
    each = rows.select(F.inline(F.array(*compared)))
    return each.groupBy("target").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("differs")).alias("differing"))


def predict_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request's day and status, and whether its total is the sum of its horizons."""
    _, root = _run(spark, sf_dir)
    answers = jobs.forecasts_of_run(retail_sales(spark, sf_dir), _requests(spark, sf_dir), root, RUN_ID)
    total = F.aggregate(F.map_values("predictions"), F.lit(0.0), lambda sum_, value: sum_ + value)
    adds_up = (F.abs(total - F.col("total_quantity_7d")) < 1e-6) & _finite("direct_quantity_7d")
    checked = F.when(F.col("status") == "ok", adds_up).alias("adds_up")
    return answers.select(*tables.REQUEST_KEYS, "last_date", "status", checked)


def queries() -> dict[str, Query]:
    return {
        "sales_scan": sales_scan,
        "sales_scan_params": sales_scan_params,
        "holiday_calendar": holiday_calendar,
        "sample_regression": sample_regression,
        "numeric_coerce": numeric_coerce,
        "daily_sales": daily_sales,
        "series_bounds": series_bounds,
        "calendar_spine": calendar_spine,
        "dense_daily": dense_daily,
        "lag_features": lag_features,
        "rolling_means": _rolling(MEANS),
        "rolling_std": _rolling(["quantity_std_28d"]),
        "rolling_sums": _rolling(SUMS),
        "offset_sums": _rolling(OFFSET_SUMS),
        "lead_targets": lead_targets,
        "target_sum_7d": target_sum_7d,
        "calendar_features": calendar_features,
        "holiday_flag": holiday_flag,
        "ratio_features": ratio_features,
        "training_panel": training_panel,
        "stored_panel": stored_panel,
        "series_panel": series_panel,
        "feature_matrix": feature_matrix,
        "target_matrix": target_matrix,
        "baseline_feature": baseline_feature,
        "temporal_split": temporal_split,
        "cutoff_split": cutoff_split,
        "cutoff_validation": cutoff_validation,
        "validation_split": validation_split,
        "split_summary": split_summary,
        "target_describe": target_describe,
        "target_describe_pooled": target_describe_pooled,
        "null_counts": null_counts,
        "panel_head_tail": panel_head_tail,
        "baseline_forecasts": baseline_forecasts,
        "baseline_horizon_metrics": baseline_horizon_metrics,
        "tuning_by_series": tuning_by_series,
        "config_selection": config_selection,
        "config_selection_pooled": config_selection_pooled,
        "series_regression": series_regression,
        "chosen_horizon_metrics": chosen_horizon_metrics,
        "multi_horizon_sum": multi_horizon_sum,
        "model_comparison": model_comparison,
        "model_comparison_by_series": model_comparison_by_series,
        "improvement_pct": improvement_pct,
        "prediction_examples": prediction_examples,
        "config_grid": config_grid,
        "latest_features": latest_features,
        "latest_features_labelled": latest_features_labelled,
        "predict_baseline": predict_baseline,
        "published_forecasts": published_forecasts,
        "predict_requests": predict_requests,
        "predict_json": predict_json,
        "gbt_stump_forecast": gbt_stump_forecast,
        "gbt_two_stumps_forecast": gbt_two_stumps_forecast,
        "tuning_results": tuning_results,
        "gbt_fit": gbt_fit,
        "gbt_test_forecast": gbt_test_forecast,
        "model_horizon_metrics": model_horizon_metrics,
        "gbt_model_comparison": gbt_model_comparison,
        "gbt_prediction_examples": gbt_prediction_examples,
        "feature_importance": feature_importance,
        "model_info": model_info,
        "model_registry_roundtrip": model_registry_roundtrip,
        "gbt_selection_by_series": gbt_selection_by_series,
        "gbt_routed_forecast": gbt_routed_forecast,
        "run_catalogue": run_catalogue,
        "predict_batch": predict_batch,
    }
