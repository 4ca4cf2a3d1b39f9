"""The hyper-parameter grid and its translation to Spark's boosted trees."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42


@dataclass(frozen=True)
class Configuration:
    name: str
    n_estimators: int
    learning_rate: float
    num_leaves: int
    max_depth: int
    min_child_samples: int
    subsample: float
    colsample_bytree: float
    reg_alpha: float
    reg_lambda: float
    # Values a feature is cut into when splits are searched.
    max_bins: int = 255


# The six configurations, in order of preference on equal error.
CONFIGURATIONS = (
    Configuration("A_small", 500, 0.05, 15, -1, 20, 0.9, 0.9, 0.0, 0.0),
    Configuration("B_standard", 700, 0.03, 31, -1, 20, 0.9, 0.9, 0.0, 0.0),
    Configuration("C_regularized", 700, 0.03, 31, -1, 40, 0.9, 0.9, 0.1, 1.0),
    Configuration("D_complex", 700, 0.03, 63, -1, 30, 0.9, 0.9, 0.1, 1.0),
    Configuration("E_deep", 1000, 0.02, 63, 8, 30, 0.9, 0.9, 0.1, 1.0),
    Configuration("F_high_regularization", 700, 0.03, 15, -1, 40, 0.9, 0.9, 0.5, 2.0),
)


def tree_depth(configuration: Configuration) -> int:
    """Depth of a balanced tree with as many leaves, within the depth limit if there is one.

    Spark grows trees level by level, so leaves become levels.
    """
    depth = math.ceil(math.log2(configuration.num_leaves))
    return min(depth, configuration.max_depth) if configuration.max_depth > 0 else depth


# Share of the target's variance that a split must remove for each unit of penalty.
PENALTY_SHARE = 0.001


def penalty_share(configuration: Configuration) -> float:
    return round(PENALTY_SHARE * (configuration.reg_alpha + configuration.reg_lambda), 12)


def least_gain(configuration: Configuration, variance: float | None) -> float:
    """The gain below which a split is refused, in place of the L1 and L2 penalties.

    Spark's trees have no penalty on leaf values. What the penalties are for, no leaf of its own
    for a difference that hardly matters, a threshold on the gain does too: the penalties'
    sum times ``PENALTY_SHARE`` of the variance of the target on the rows of the fit.
    """
    return penalty_share(configuration) * (variance or 0.0)


def regressor(configuration: Configuration, label: str, variance: float | None = None) -> GBTRegressor:
    """Gradient-boosted trees on squared loss, exactly as configured.

    L1 and L2 penalties become a threshold on the gain (``least_gain``), given the
    target's variance. Row subsampling is off: the grid names a fraction but no resampling interval.
    The running predictions are checkpointed every ten trees, which keeps the
    lineage short and lets a fit survive lost executors. The memory for split
    statistics is set so that a level of a tree is one pass over the rows.
    """
    return GBTRegressor(
        featuresCol="features",
        labelCol=label,
        predictionCol="prediction",
        lossType="squared",
        maxIter=configuration.n_estimators,
        stepSize=configuration.learning_rate,
        maxDepth=tree_depth(configuration),
        maxBins=configuration.max_bins,
        minInstancesPerNode=configuration.min_child_samples,
        minInfoGain=least_gain(configuration, variance),
        featureSubsetStrategy=str(configuration.colsample_bytree),
        subsamplingRate=1.0,
        checkpointInterval=10,
        maxMemoryInMB=1024,
        seed=SEED,
    )


def with_configurations(df: DataFrame, configurations: Sequence[Configuration] = CONFIGURATIONS) -> DataFrame:
    """Every row of ``df`` once per configuration, with the tree depth and the gain threshold it leads to."""
    rows = [
        F.struct(
            F.lit(order).alias("config_order"),
            F.lit(c.name).alias("configuration"),
            *[F.lit(value).alias(field) for field, value in asdict(c).items() if field != "name"],
            F.lit(tree_depth(c)).alias("tree_depth"),
            F.lit(penalty_share(c)).alias("penalty_share"),
        )
        for order, c in enumerate(configurations)
    ]
    return df.select("*", F.inline(F.array(*rows)))


PARAMETERS = [field.name for field in fields(Configuration) if field.name != "name"]
