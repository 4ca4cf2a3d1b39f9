"""Command line: ``spark-submit`` or ``python -m salescast train|forecast|info|runs``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from salescast.plans.configurations import CONFIGURATIONS, Configuration
from salescast.plans.jobs import run_forecast, run_training
from salescast.schema import AMOUNT, DATE, HISTORY_START, KEYS, TIME_ZONE
from salescast.sources.registry import model_info, run_catalogue, run_settings
from salescast.sources.tables import REQUEST_KEYS, read_requests, read_sales


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="salescast")
    commands = parser.add_subparsers(dest="command", required=True)
    train = commands.add_parser("train", help="tune, fit, evaluate and store the models")
    forecast = commands.add_parser("forecast", help="answer requests with a stored run")
    info = commands.add_parser("info", help="describe a stored run")
    runs = commands.add_parser("runs", help="list the runs, complete or not")
    for command in (train, forecast, info, runs):
        command.add_argument("--root", required=True, help="folder of the stored runs")
    for command in (train, forecast, info):
        command.add_argument("--run-id", required=True)
    for command in (train, forecast):
        command.add_argument("--sales", required=True, help="path of the transaction table")
        command.add_argument("--format", default="parquet")
    train.add_argument("--keys", nargs="+", default=list(KEYS), help="columns that name a series")
    train.add_argument("--date", default=DATE)
    train.add_argument("--amount", default=AMOUNT)
    train.add_argument("--start", default=HISTORY_START)
    train.add_argument("--time-zone", default=TIME_ZONE, help="zone in which a moment becomes a day")
    train.add_argument("--holidays", help="path of a table with holiday_date, instead of the built-in rule")
    train.add_argument("--configurations", help="JSON file with a list of configurations, instead of the built-in six")
    train.add_argument("--parallelism", type=int, default=4, help="fits running at a time")
    train.add_argument("--partitions", type=int, help="tasks that fill and window the series")
    train.add_argument("--cutoff", help="last train date of every series, instead of 80 %% of the days")
    train.add_argument("--by-series", action="store_true", help="let each series take its own best configuration")
    forecast.add_argument("--requests", required=True, help="JSON lines with the request keys")
    forecast.add_argument("--request-keys", nargs="+", default=list(REQUEST_KEYS), help="in the order of the run's keys")
    forecast.add_argument("--out", required=True)
    forecast.add_argument("--as-of", choices=["last", "labelled"], default="last")
    forecast.add_argument("--publish-day", help="write the answers as this day's partition of --out, beside other days")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    options = arguments(argv)
    spark = SparkSession.builder.appName("salescast").getOrCreate()
    if options.command == "runs":
        for line in run_catalogue(spark, options.root).orderBy("started").toJSON().collect():
            print(line)
        return
    if options.command == "info":
        for line in model_info(spark, options.root, options.run_id).toJSON().collect():
            print(line)
        return
    sales = read_sales(spark, options.sales, source=options.format)
    if options.command == "train":
        configurations = CONFIGURATIONS
        if options.configurations:
            configurations = [Configuration(**c) for c in json.loads(Path(options.configurations).read_text())]
        run_training(
            sales,
            options.root,
            options.run_id,
            options.keys,
            options.date,
            options.amount,
            options.start,
            options.time_zone,
            spark.read.parquet(options.holidays) if options.holidays else None,
            configurations,
            options.parallelism,
            options.cutoff,
            options.partitions,
            options.by_series,
        )
    else:
        types = run_settings(spark, options.root, options.run_id).key_types
        schema = T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in zip(options.request_keys, types)))
        requests = read_requests(spark, options.requests, schema=schema)
        run_forecast(
            sales, requests, options.root, options.run_id, options.out, options.request_keys, options.as_of, options.publish_day
        )


if __name__ == "__main__":
    main()
