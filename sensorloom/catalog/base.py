"""Registry of queries and the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sensorloom.session import tune_session
from sensorloom.sources.derived import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


# Means of few decimals often end exactly between two roundings, where the last bit
# decides. The factor moves such values off the middle, in both engines alike.
NUDGE = "(1 + 1e-12)"


def presented(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 places, without a negative zero."""
    return df.selectExpr(
        *[
            f"round(CAST(`{c}` AS DOUBLE) * {NUDGE}, 6) + 0.0D AS `{c}`" if t in ("double", "float") else f"`{c}`"
            for c, t in df.dtypes
        ]
    )


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            tune_session(spark)
            return presented(fn(Tables(spark, folder)))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# --- SQL of the derived frames ----------------------------------------------

def _readings(name: str, site: str) -> str:
    return f"""
{name}_e AS (
  SELECT event_id, event_type, value, CAST({site} AS VARCHAR) AS site, CAST(floor(epoch(ts)) AS BIGINT) AS raw_epoch
  FROM events),
{name} AS (
  SELECT event_id, concat('48_201_', lpad(site, 4, '0')) AS aqs_code, raw_epoch - raw_epoch % 300 AS epoch,
    CASE WHEN event_id % 2 = 0 THEN 2013 ELSE 2015 END AS data_year,
    CASE WHEN event_type = 'error' THEN NULL ELSE value * 0.5 END AS "no",
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE value * 0.25 END AS no2,
    CASE WHEN event_type = 'error' OR event_id % 7 = 0 THEN NULL ELSE value * 0.75 END AS nox,
    CASE WHEN event_id % 10 < 2 THEN NULL ELSE value END AS o3,
    CAST(60 + event_id % 30 AS DOUBLE) AS temp,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST((event_id * 37) % 360 AS DOUBLE) END AS winddir,
    CAST((event_id * 11) % 25 AS DOUBLE) AS windspd,
    CASE WHEN event_id % 5 = 0 THEN 'AQI' WHEN event_id % 2 = 0 THEN 'VAL' ELSE 'K' END AS o3_flag,
    CASE WHEN event_id % 2 = 0 THEN 'VAL' ELSE 'K' END AS no_flag,
    CASE WHEN event_id % 2 = 0 THEN 'VAL' ELSE 'K' END AS no2_flag,
    CASE WHEN event_id % 11 = 0 THEN 'LST' WHEN event_id % 2 = 0 THEN 'VAL' ELSE 'K' END AS nox_flag,
    CASE WHEN event_id % 2 = 0 THEN 'VAL' ELSE 'K' END AS temp_flag
  FROM {name}_e)"""


def _sites(name: str, of: str) -> str:
    return f"""
{name}_n AS (SELECT DISTINCT aqs_code, CAST(substr(aqs_code, 8, 4) AS INT) AS i FROM {of}),
{name} AS (
  SELECT aqs_code, CAST(29.5 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (i % 40) AS latitude,
    CAST(-95.5 AS DOUBLE) + CAST(0.03 AS DOUBLE) * ((i * 5) % 37) AS longitude,
    CASE WHEN i % 4 = 0 THEN 'NA' ELSE CAST(10 + i % 5 AS VARCHAR) END AS region
  FROM {name}_n)"""


def _timed(name: str, of: str) -> str:
    return f"""
{name}_at AS (SELECT *, make_timestamp(epoch * 1000000) AS stamp FROM {of}),
{name} AS (
  SELECT * EXCLUDE (stamp), strftime(stamp, '%H:%M:%S') AS "time", CAST(stamp AS DATE) AS "date", CAST(day(stamp) AS INTEGER) AS "day",
    CAST(month(stamp) AS INTEGER) AS "month", CAST(year(stamp) AS INTEGER) AS "year",
    CAST(hour(stamp) AS INTEGER) AS "hour", CAST(dayofyear(stamp) AS INTEGER) AS day_of_year
  FROM {name}_at)"""


READINGS = _readings("readings", "user_id % 12")
TIMED = READINGS + "," + _timed("timed", "readings")
SITES = READINGS + "," + _sites("sites", "readings")
STATION_READINGS = _readings("station_readings", "user_id")
STATIONS = STATION_READINGS + "," + _sites("stations", "station_readings")
HISTORY = """
history_raw AS (
  SELECT concat('48_201_', lpad(CAST(l_suppkey % 20 AS VARCHAR), 4, '0')) AS aqs_code,
    CAST(floor(epoch(l_shipdate)) AS BIGINT) + ((l_orderkey * 8 + l_linenumber) % 288) * 300 AS epoch,
    CAST(year(l_shipdate) AS INTEGER) AS data_year,
    CASE WHEN l_linenumber <> 7 THEN l_quantity * 1.5 END AS o3,
    CASE WHEN l_returnflag <> 'R' THEN l_discount * 100 END AS "no",
    CASE WHEN l_suppkey % 20 <> 3 AND l_linestatus <> 'F' THEN l_tax * 1000 END AS nox,
    l_extendedprice * 0.001 AS temp, CAST(NULL AS DOUBLE) AS co, l_returnflag
  FROM lineitem),""" + _timed("history", "history_raw")


def sql(*ctes_and_body: str) -> str:
    """``WITH`` the given common table expressions, the last argument is the query."""
    *ctes, body = ctes_and_body
    return "WITH " + ", ".join(c.strip() for c in ctes) + "\n" + body if ctes else body


def r(expression: str, name: str) -> str:
    """The expression rounded as in ``presented``."""
    return f'round(CAST({expression} AS DOUBLE) * {NUDGE}, 6) + 0.0 AS "{name}"'


def rs(*columns: str) -> str:
    return ", ".join(r(f'"{c}"', c) for c in columns)
