"""Ledger of the finished fits of a run, so that a run that was broken off goes on.

Each finished fit is a model folder, then one row in a folder of its own; both are
written at once, and a row without its model can't be. A fit counts only for the
configuration, with all its values, that it was made with.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession

from salescast.plans.configurations import Configuration

TUNING, FINAL = "tuning", "final"
# Part, target and configuration of a fit.
Fit = tuple[str, str, str]

_ROW = "part string, target string, configuration string, parameters string, rows long, MAE double, RMSE double, R2 double"
_STATE = "identity string, state string"


def read_if_there(spark: SparkSession, path: str, schema: str, recursive: bool = False) -> DataFrame:
    """A Parquet folder, or no row if nothing is stored there."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", recursive).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass
class FitLedger:
    """The ledger under ``path``. One fit has one row, so all rows may pass the driver."""

    spark: SparkSession
    path: str

    def state(self, identity: str) -> dict | None:
        """What the run settled before its fits, if it is the same run."""
        rows = read_if_there(self.spark, f"{self.path}/state", _STATE).collect()
        return json.loads(rows[0]["state"]) if rows and rows[0]["identity"] == identity else None

    def begin(self, identity: str, state: Mapping) -> None:
        row = (identity, json.dumps(dict(state)))
        self.spark.createDataFrame([row], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state")

    def finished(self) -> DataFrame:
        return read_if_there(self.spark, f"{self.path}/fits", _ROW, recursive=True)

    def known(self) -> dict[Fit, tuple]:
        """Parameters and errors of every finished fit."""
        return {(r["part"], r["target"], r["configuration"]): (r["parameters"], r["rows"], r["MAE"], r["RMSE"], r["R2"]) for r in self.finished().collect()}

    def _folder(self, kind: str, fit: Fit) -> str:
        return f"{self.path}/{kind}/{'/'.join(fit)}"

    def record(self, fit: Fit, configuration: Configuration, model: GBTRegressionModel, errors: tuple = (None, None, None, None)) -> None:
        model.write().overwrite().save(self._folder("models", fit))
        row = (*fit, parameters_of(configuration), *errors)
        self.spark.createDataFrame([row], _ROW).coalesce(1).write.mode("overwrite").parquet(self._folder("fits", fit))

    def model(self, fit: Fit) -> GBTRegressionModel:
        return GBTRegressionModel.load(self._folder("models", fit))


def parameters_of(configuration: Configuration) -> str:
    return json.dumps(asdict(configuration), sort_keys=True)
