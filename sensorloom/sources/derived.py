"""Sensor frames derived by arithmetic from general tables (events, lineitem).

They stand in for reading files wherever only such tables are at hand: the
registered queries, the benchmark and the tests use them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions.scalar import time_parts, time_parts_full
from sensorloom.plans.staging import new_path, staged

_EPOCH = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})"
_SITE = "concat('48_201_', lpad(string({}), 4, '0')) AS aqs_code"


def readings_from_events(events: DataFrame, site_number: str) -> DataFrame:
    """Readings of 16 columns; ``site_number`` is the expression that numbers the sites."""
    epoch = _EPOCH.format("ts")
    era_code = "CASE WHEN event_id % 2 = 0 THEN 'VAL' ELSE 'K' END"
    return events.selectExpr(
        "event_id",
        _SITE.format(site_number),
        f"{epoch} - {epoch} % 300 AS epoch",
        "CASE WHEN event_id % 2 = 0 THEN 2013 ELSE 2015 END AS data_year",
        "CASE WHEN event_type <> 'error' THEN value * 0.5D END AS no",
        "CASE WHEN event_id % 7 <> 0 THEN value * 0.25D END AS no2",
        "CASE WHEN event_type <> 'error' AND event_id % 7 <> 0 THEN value * 0.75D END AS nox",
        "CASE WHEN event_id % 10 >= 2 THEN value END AS o3",
        "double(60 + event_id % 30) AS temp",
        "CASE WHEN event_id % 13 <> 0 THEN double((event_id * 37) % 360) END AS winddir",
        "double((event_id * 11) % 25) AS windspd",
        f"CASE WHEN event_id % 5 = 0 THEN 'AQI' ELSE {era_code} END AS o3_flag",
        f"{era_code} AS no_flag",
        f"{era_code} AS no2_flag",
        f"CASE WHEN event_id % 11 = 0 THEN 'LST' ELSE {era_code} END AS nox_flag",
        f"{era_code} AS temp_flag",
    )


def sites_of(readings: DataFrame) -> DataFrame:
    """Site dimension of the sites that occur in ``readings``."""
    numbered = readings.select("aqs_code").distinct().selectExpr("aqs_code", "int(substr(aqs_code, 8)) AS i")
    return numbered.selectExpr(
        "aqs_code",
        "29.5D + 0.05D * (i % 40) AS latitude",
        "-95.5D + 0.03D * ((i * 5) % 37) AS longitude",
        "CASE WHEN i % 4 = 0 THEN 'NA' ELSE string(10 + i % 5) END AS region",
    )


def history_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Readings of several years with an empty column and a site without nox."""
    return lineitem.selectExpr(
        _SITE.format("l_suppkey % 20"),
        f"{_EPOCH.format('l_shipdate')} + ((l_orderkey * 8 + l_linenumber) % 288) * 300 AS epoch",
        "year(l_shipdate) AS data_year",
        "CASE WHEN l_linenumber <> 7 THEN l_quantity * 1.5D END AS o3",
        "CASE WHEN l_returnflag <> 'R' THEN l_discount * 100 END AS no",
        "CASE WHEN l_suppkey % 20 <> 3 AND l_linestatus <> 'F' THEN l_tax * 1000 END AS nox",
        "l_extendedprice * 0.001D AS temp",
        "double(NULL) AS co",
        "l_returnflag",
    )


class Tables:
    """The derived frames over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream(self, name: str, by: str, pieces: int = 5) -> DataFrame:
        """The same table as a stream of files that arrive in the order of the expression ``by``, one for each batch."""
        ranged = self.read(name).repartitionByRange(pieces, F.expr(by)).withColumn("_piece", F.spark_partition_id())
        ranged, folder = staged(ranged, "pieces"), new_path(self.spark, "arriving")
        for piece in range(pieces):
            ranged.where(F.col("_piece") == piece).drop("_piece").coalesce(1).write.mode("append").parquet(folder)
        return self.spark.readStream.schema(self.read(name).schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def stream_readings(self) -> DataFrame:
        epoch = _EPOCH.format("ts")
        return readings_from_events(self.stream("events", f"{epoch} - {epoch} % 300"), "user_id % 12")

    @cached_property
    def readings(self) -> DataFrame:
        """Readings of 12 sites."""
        return readings_from_events(self.read("events"), "user_id % 12")

    @cached_property
    def timed(self) -> DataFrame:
        return time_parts(time_parts_full(self.readings))

    @cached_property
    def sites(self) -> DataFrame:
        # A dimension is written once: it is read several times, and its size is known to the optimizer.
        return staged(sites_of(self.readings), "sites")

    @cached_property
    def station_readings(self) -> DataFrame:
        """The same readings with one station per user: the network grows with the data."""
        return readings_from_events(self.read("events"), "user_id")

    @cached_property
    def stations(self) -> DataFrame:
        return staged(sites_of(self.station_readings), "stations")

    @cached_property
    def history(self) -> DataFrame:
        return time_parts(time_parts_full(history_from_lineitem(self.read("lineitem"))))
