"""Column expressions: wind, calendar, site codes, scaling."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- wind -------------------------------------------------------------------

def wind_x(speed: Column | str, direction: Column | str) -> Column:
    return _c(speed) * F.cos(F.radians(_c(direction)))


def wind_y(speed: Column | str, direction: Column | str) -> Column:
    return _c(speed) * F.sin(F.radians(_c(direction)))


def wind_vector(df: DataFrame, speed: str = "windspd", direction: str = "winddir") -> DataFrame:
    """Add ``wind_x_dir`` and ``wind_y_dir``."""
    return df.withColumns({"wind_x_dir": wind_x(speed, direction), "wind_y_dir": wind_y(speed, direction)})


# --- calendar ---------------------------------------------------------------

def epoch_time(epoch: Column | str = "epoch") -> Column:
    """Unix seconds as a timestamp (the session time zone is UTC)."""
    return F.timestamp_seconds(_c(epoch))


def time_parts(df: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Add ``hour`` and ``day_of_year``."""
    at = epoch_time(epoch)
    return df.withColumns({"hour": F.hour(at), "day_of_year": F.dayofyear(at)})


def time_parts_full(df: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Add ``time, date, day, month, year, hour``."""
    at = epoch_time(epoch)
    return df.withColumns(
        {
            "time": F.date_format(at, "HH:mm:ss"),
            "date": F.to_date(at),
            "day": F.dayofmonth(at),
            "month": F.month(at),
            "year": F.year(at),
            "hour": F.hour(at),
        }
    )


def clock_to_minutes(clock: Column | str) -> Column:
    """``HH:MM:SS`` to whole minutes of the day; the seconds do not count."""
    parts = F.split(_c(clock), ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")


def onehot_time(df: DataFrame, values: dict[str, Iterable[int]]) -> DataFrame:
    """Replace calendar columns by 0/1 columns ``{column}_{value}`` for a given value list."""
    flags = [
        F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for c, vs in values.items() for v in vs
    ]
    return df.select(*[c for c in df.columns if c not in values], *flags)


# --- site codes -------------------------------------------------------------

def site_code_to_number(code: Column | str) -> Column:
    """``48_201_0051`` to 482010051."""
    return F.regexp_replace(_c(code), "_", "").cast("long")


def site_number_to_code(number: Column | str) -> Column:
    """482010051 to ``48_201_0051``."""
    digits = F.lpad(_c(number).cast("string"), 9, "0")
    return F.concat_ws("_", F.substring(digits, 1, 2), F.substring(digits, 3, 3), F.substring(digits, 6, 4))


def site_in_region(code: Column | str, region_sites: Iterable[str]) -> Column:
    """True when the site is listed; false (never null) otherwise."""
    return F.coalesce(_c(code).isin(list(region_sites)), F.lit(False))


# --- text and numbers -------------------------------------------------------

def blank_to_null(text: Column | str) -> Column:
    """Whitespace-only text becomes null."""
    return F.when(F.regexp_like(_c(text), F.lit(r"\S")), _c(text))


def nan_to_null(value: Column | str) -> Column:
    return F.nanvl(_c(value), F.lit(None).cast("double"))


def scale_lat(lat: Column | str) -> Column:
    return (_c(lat) + 90.0) / 180.0


def scale_long(long: Column | str) -> Column:
    return (_c(long) + 180.0) / 360.0


def scaled(value: Column | str, low: Column, high: Column) -> Column:
    """(x - low) / |high - low|; null when the range is 0."""
    return F.try_divide(_c(value) - low, F.abs(high - low))


def euclid_distance(lat1: Column | str, long1: Column | str, lat2: Column | str, long2: Column | str) -> Column:
    """Distance in degrees."""
    return F.sqrt(F.pow(_c(lat1) - _c(lat2), F.lit(2.0)) + F.pow(_c(long1) - _c(long2), F.lit(2.0)))


def softmax_weights(df: DataFrame, keys: list[str], score: Column | str, out: str = "weight") -> DataFrame:
    """Softmax of ``score`` over a site's neighbours (k rows per key, by construction)."""
    group = Window.partitionBy(*keys)
    power = F.exp(F.col("_s") - F.max("_s").over(group))
    return (
        df.withColumn("_s", _c(score))
        .withColumn("_e", power)
        .withColumn(out, F.col("_e") / F.sum("_e").over(group))
        .drop("_s", "_e")
    )
