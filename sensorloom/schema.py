"""Declared schema of the raw readings and the column groups the operators use."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and order of a yearly reading file.
MEASURES = ["co", "humid", "no", "no2", "nox", "o3", "pm25", "so2", "solar", "temp", "winddir", "windspd", "dew"]

SITE = "aqs_code"
EPOCH = "epoch"
YEAR = "data_year"
ROW_ID = "event_id"

READING_SCHEMA = T.StructType(
    [
        T.StructField(SITE, T.StringType()),
        T.StructField("redraw", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField(EPOCH, T.LongType()),
    ]
    + [
        field
        for measure in MEASURES
        for field in (T.StructField(measure, T.DoubleType()), T.StructField(f"{measure}_flag", T.StringType()))
    ]
)

# Sampling constants (5-minute readings, hourly blocks, weekly sequences).
READING_SECONDS = 300
BLOCK_ROWS = 12
SEQUENCE_ROWS = 168
PREDICTION_ROWS = 24
MAX_NULL_SHARE = 0.25

# Codes of a valid reading before and from 2014.
FLAG_BEFORE_2014 = "VAL"
FLAG_FROM_2014 = "K"
FLAG_CHANGE_YEAR = 2014
