"""A configured chain: null policy, labels, sliding windows, sequences."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sensorloom.functions.scalar import time_parts, time_parts_full, wind_vector
from sensorloom.operators.filters import drop_any_null, fill_null_const, filter_sites, mask_null_rows
from sensorloom.operators.rowwindows import ORDER, label_threshold_or, sequence_build, slide_window
from sensorloom.plans.ordered import number_rows
from sensorloom.schema import READING_SCHEMA, SITE, YEAR
from sensorloom.sources.readings import read_readings


def load_config(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def _null_policy(df: DataFrame, policy: dict[str, Any] | None, order: Sequence[str]) -> DataFrame:
    method = (policy or {}).get("method")
    if method == "fill":
        return fill_null_const(df, policy["value"])
    if method == "mask":
        return mask_null_rows(df, policy.get("value", 1000.0), keep=[SITE, YEAR, *order])
    if method == "drop":
        return drop_any_null(df)
    if method:
        raise ValueError(f"unknown null policy {method!r}")
    return df


def chain_from_config(df: DataFrame, config: dict[str, Any], order: Sequence[str] = ORDER) -> dict[str, DataFrame]:
    """One sequence frame per configured windower: (site, window_no, seq).

    Labels are computed on raw rows and travel through the windows as discrete
    features, so each step of a sequence carries the label of its middle row. Frames
    are lazy; a site's rows are numbered once and the number serves labels and windows.
    """
    if config.get("sites"):
        df = filter_sites(df, config["sites"])
    if config.get("years"):
        df = df.filter(df[YEAR].isin(list(config["years"])))
    df = _null_policy(df, config.get("nanhandling"), order)
    df = number_rows(df, [SITE], order)
    labels = []
    for rule in config.get("dependent_generation", []):
        if rule["function"] != "threshold_or":
            raise ValueError(f"unknown label function {rule['function']!r}")
        limits = dict(zip(rule["keys"], rule["thresholds"]))
        df = label_threshold_or(
            df, limits, rule["future_samples"], rule.get("invert", False), row="_rn", out=rule["name"]
        )
        if rule.get("type", "boolean") != "boolean":
            df = df.withColumn(rule["name"], df[rule["name"]].cast(rule["type"]))
        labels.append(rule["name"])
    frames = {}
    for windower in config["windowers"]:
        kinds = {k["name"]: k["type"] for k in windower["keys"]}
        continuous = [k for k, kind in kinds.items() if kind == "continuous"]
        discrete = [k for k, kind in kinds.items() if kind == "discrete"] + labels
        windows = slide_window(df, continuous, discrete, windower["samples"], row="_rn")
        length = windower.get("sequencer", {}).get("samples")
        if length:
            windows = sequence_build(windows, [*continuous, *discrete], length, prediction=0)
        frames[windower["name"]] = windows
    return frames


def pipeline_from_config(
    spark: SparkSession, config: dict[str, Any], schema: T.StructType = READING_SCHEMA, order: Sequence[str] = ORDER
) -> dict[str, DataFrame]:
    """Read the configured years below ``input_path``, run the chain and write one table per windower below ``output_path``.

    Files are ``{input_prefix}{year}.csv``; absent years are skipped. Wind components
    and calendar columns are derived if a windower names them. Returns the written tables.
    """
    years = config["years"]
    rows = read_readings(
        spark, config["input_path"], min(years), max(years) + 1, config.get("input_prefix", "Data_"), schema=schema, skip_absent=True
    )
    wanted = {key["name"] for windower in config["windowers"] for key in windower["keys"]}
    if wanted & {"wind_x_dir", "wind_y_dir"}:
        rows = wind_vector(rows)
    if wanted & {"hour", "day_of_year"}:
        rows = time_parts(rows)
    if wanted & {"day", "month", "year"}:
        rows = time_parts_full(rows)
    written = {}
    for name, frame in chain_from_config(rows, config, order).items():
        path = f"{config['output_path']}/{name}"
        frame.write.mode("overwrite").parquet(path)
        written[name] = spark.read.parquet(path)
    return written
