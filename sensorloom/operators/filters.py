"""Projections, filters and null policies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.schema import FLAG_BEFORE_2014, FLAG_CHANGE_YEAR, FLAG_FROM_2014, SITE, YEAR


def filter_sites(df: DataFrame, sites: Sequence[str], site: str = SITE) -> DataFrame:
    """Keep the rows of the listed sites."""
    return df.filter(F.col(site).isin(list(sites)))


# --- validity flags ---------------------------------------------------------

def all_flags(measures: Sequence[str], code: str) -> Column:
    """True when the flag of every measure equals ``code`` (null flags are invalid)."""
    return reduce(and_, [F.coalesce(F.col(f"{m}_flag") == code, F.lit(False)) for m in measures])


def valid_by_era(year: str = YEAR) -> Column:
    """Validity rule of a reading: flags of its era, wind direction and site present."""
    before = all_flags(["nox", "no", "no2", "o3", "temp"], FLAG_BEFORE_2014)
    after = all_flags(["nox", "no", "o3", "temp"], FLAG_FROM_2014)
    flags = F.when(F.col(year) < FLAG_CHANGE_YEAR, before).otherwise(after)
    return flags & F.col("winddir").isNotNull() & F.col(SITE).isNotNull()


def filter_valid_flags(df: DataFrame, year: str = YEAR) -> DataFrame:
    return df.filter(valid_by_era(year))


def filter_valid_o3_temp(df: DataFrame, code: str = FLAG_BEFORE_2014) -> DataFrame:
    """o3 and temp flags equal ``code``, wind direction present."""
    return df.filter(all_flags(["o3", "temp"], code) & F.col("winddir").isNotNull())


def filter_valid_2000_2013(df: DataFrame) -> DataFrame:
    """nox, no, o3 and temp valid, wind direction present (no2 is not checked)."""
    return df.filter(all_flags(["nox", "no", "o3", "temp"], FLAG_BEFORE_2014) & F.col("winddir").isNotNull())


def filter_stage_counts(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each filter of a chain, all counted in one pass."""
    held, counts = F.lit(True), [F.count(F.lit(1)).alias("all")]
    for name, test in stages:
        held = held & F.coalesce(test, F.lit(False))
        counts.append(F.count_if(held).alias(name))
    names = ["all", *[name for name, _ in stages]]
    return df.agg(*counts).unpivot([], names, "stage", "n_rows")


def mark_rule(year: str = YEAR) -> Column:
    """Marking rule: from 2014 nox and no still need the old code, o3 and temp the new one."""
    before = all_flags(["nox", "no", "o3", "temp"], FLAG_BEFORE_2014)
    after = all_flags(["nox", "no"], FLAG_BEFORE_2014) & all_flags(["o3", "temp"], FLAG_FROM_2014)
    flags = F.when(F.col(year) < FLAG_CHANGE_YEAR, before).otherwise(after)
    return flags & F.col("winddir").isNotNull()


def mark_valid(df: DataFrame, rule: Column | None = None) -> DataFrame:
    """Keep every row and add ``val`` = 'y' / 'n'."""
    test = mark_rule() if rule is None else rule
    return df.withColumn("val", F.when(test, F.lit("y")).otherwise(F.lit("n")))


def invalid_to_null(df: DataFrame, measures: Sequence[str], year: str = YEAR) -> DataFrame:
    """Blank a measure whose flag is not the valid code of its era."""
    code = F.when(F.col(year) < FLAG_CHANGE_YEAR, FLAG_BEFORE_2014).otherwise(FLAG_FROM_2014)
    return df.withColumns({m: F.when(F.col(f"{m}_flag") == code, F.col(m)) for m in measures})


# --- nulls ------------------------------------------------------------------

def any_null(columns: Sequence[str]) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in columns])


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def mask_null_rows(df: DataFrame, mask: float = 1000.0, keep: Sequence[str] = (SITE,)) -> DataFrame:
    """Where any column is null, set every column but ``keep`` to ``mask``."""
    types = dict(df.dtypes)
    hit = any_null(df.columns)
    return df.withColumns(
        {c: F.when(hit, F.lit(mask).cast(types[c])).otherwise(F.col(c)) for c in df.columns if c not in keep}
    )


def fill_null_const(df: DataFrame, value: float) -> DataFrame:
    """Replace every null of a numeric column by ``value``."""
    return df.na.fill(value)


def rows_with_any_null(df: DataFrame) -> DataFrame:
    """Rows with a null; whitespace-only text counts as null."""
    blank = [~F.regexp_like(F.col(c), F.lit(r"\S")) for c, t in df.dtypes if t == "string"]
    nulls = any_null(df.columns)
    return df.filter(reduce(or_, [F.coalesce(b, F.lit(False)) for b in blank], nulls))


# --- columns ----------------------------------------------------------------

def project_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Keep identifying columns and the feature list; flags and other measures go."""
    return df.select(*keep, *features)


def drop_all_null_columns(df: DataFrame, numeric_only: bool = True) -> DataFrame:
    """Drop columns without any value (one counting pass), optionally non-numeric ones too."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    names = [c for c, t in df.dtypes if not numeric_only or t in numeric or t.startswith("decimal")]
    counts = df.agg(*[F.count(c).alias(c) for c in names]).first()
    return df.select(*[c for c in names if counts[c] > 0])


def downcast_types(df: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Doubles to float, the epoch to int."""
    casts = {c: F.col(c).cast("float") for c, t in df.dtypes if t == "double"}
    return df.withColumns({**casts, epoch: F.col(epoch).cast("int")})


# --- subsets ----------------------------------------------------------------

def is_daytime(hour: str = "hour") -> Column:
    return (F.col(hour) > 6) & (F.col(hour) < 20)


def is_nighttime(hour: str = "hour") -> Column:
    """Hour 20 is in neither the day nor the night."""
    return (F.col(hour) < 7) | (F.col(hour) > 20)


def is_highpol_month(month: str = "month") -> Column:
    return (F.col(month) > 3) & (F.col(month) < 11)


def subset_daytime(df: DataFrame) -> DataFrame:
    return df.filter(is_daytime())


def subset_nighttime(df: DataFrame) -> DataFrame:
    return df.filter(is_nighttime())


def subset_highpol_months(df: DataFrame) -> DataFrame:
    return df.filter(is_highpol_month())


def subset_high_o3_rows(df: DataFrame, limit: float = 40.0) -> DataFrame:
    return df.filter(F.col("o3") > limit)
