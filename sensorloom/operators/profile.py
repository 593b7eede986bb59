"""Profiles: missing shares, value counts, exact quantiles, histograms, densities.

Moments and exact quantiles come from ``selection``: a few passes that count rows in narrowing
brackets, so continuous values are not shuffled one by one. ``value_table`` and ``quantiles``
are the plain way over all distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement
from math import pi, sqrt
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.scalar import epoch_time
from sensorloom.operators import selection
from sensorloom.operators.filters import is_daytime, is_highpol_month, is_nighttime
from sensorloom.operators.joins import high_o3_days
from sensorloom.operators.selection import Values, values_of
from sensorloom.plans.ordered import running_total
from sensorloom.plans.scalars import as_value
from sensorloom.plans.staging import staged
from sensorloom.schema import EPOCH, SITE, YEAR

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


# --- means ------------------------------------------------------------------

def hourly_mean_all_sites(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Mean per (year, month, day, hour) over all sites."""
    return df.groupBy("year", "month", "day", "hour").agg(*[F.avg(m).alias(m) for m in measures])


def hourly_mean_by_site(
    df: DataFrame,
    measures: Sequence[str],
    max_missing: int = 9,
    min_present: int | None = None,
    keys: Sequence[str] = (SITE, "year", "month", "day", "hour"),
) -> DataFrame:
    """Hourly mean per site.

    An hour goes when any measure has more than ``max_missing`` nulls, fewer than
    ``min_present`` values, or no value at all.
    """
    means = [F.avg(m).alias(m) for m in measures]
    missing = [F.count_if(F.col(m).isNull()).alias(f"_missing_{m}") for m in measures]
    present = [F.count(m).alias(f"_present_{m}") for m in measures]
    least = 1 if min_present is None else max(1, min_present)
    keep = reduce(
        and_, [(F.col(f"_missing_{m}") <= max_missing) & (F.col(f"_present_{m}") >= least) for m in measures]
    )
    return df.groupBy(*keys).agg(*means, *missing, *present).filter(keep).select(*keys, *measures)


def daily_coverage_filter(df: DataFrame, share: float = 0.75, slots: int = 24, slot_seconds: int = 3600) -> DataFrame:
    """Rows of site days on which at least ``share`` of the slots (hours) hold a reading."""
    day = F.floor(F.col(EPOCH) / 86400).alias("_day")
    slot = F.floor(F.col(EPOCH) / slot_seconds).alias("_slot")
    # Distinct slots first: a day then holds at most ``slots`` rows.
    full = (
        df.select(SITE, day, slot).distinct().groupBy(SITE, "_day").count()
        .filter(F.col("count") >= share * slots).select(SITE, "_day")
    )
    return df.withColumn("_day", day).join(full, [SITE, "_day"], "left_semi").drop("_day")


# --- missing values ---------------------------------------------------------

def _null_share(column: str) -> Column:
    return (F.round(F.avg(F.col(column).isNull().cast("double")), 4) * 100).alias(column)


def percent_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column 100 x share of nulls, the share rounded to 4 places."""
    names = list(columns or df.columns)
    return df.agg(*[_null_share(c) for c in names]).unpivot([], names, "column", "percent")


def percent_missing_by_month(df: DataFrame, columns: Sequence[str], month: str = "month") -> DataFrame:
    shares = df.groupBy(month).agg(*[_null_share(c) for c in columns])
    return shares.unpivot([month], list(columns), "column", "percent")


def percent_missing_year_matrix(
    df: DataFrame, site: str, columns: Sequence[str], years: Sequence[int], year: str = YEAR
) -> DataFrame:
    """column x year matrix for one site."""
    rows = df.filter(F.col(SITE) == site)
    shares = rows.groupBy(year).agg(*[_null_share(c) for c in columns])
    long = shares.unpivot([year], list(columns), "column", "percent")
    return long.groupBy("column").pivot(year, list(years)).agg(F.first("percent"))


def all_null_site_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(site, column) pairs without a single value."""
    counts = df.groupBy(SITE).agg(*[F.count(c).alias(c) for c in columns])
    return counts.unpivot([SITE], list(columns), "column", "n").filter(F.col("n") == 0).select(SITE, "column")


def null_rows_per_site(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of rows per site that hold a null; sites without one are left out."""
    none_null = reduce(and_, [F.col(c).isNotNull() for c in columns])
    return df.filter(~none_null).groupBy(SITE).agg(F.count(F.lit(1)).alias("n_rows"))


def null_hour_tally(df: DataFrame, pollutants: Sequence[str], skip_first_day: bool = False) -> DataFrame:
    """Per site and hour: days that have rows in the hour but no value of the pollutant.

    ``df`` carries month, day and hour. ``skip_first_day`` leaves out 1 January.
    """
    rows = df.filter(~((F.col("month") == 1) & (F.col("day") == 1))) if skip_first_day else df
    cells = rows.groupBy(SITE, "month", "day", "hour").agg(*[F.count(p).alias(p) for p in pollutants])
    return cells.groupBy(SITE, "hour").agg(*[F.count_if(F.col(p) == 0).alias(p) for p in pollutants])


def sites_with_monthly_data(df: DataFrame, required: Sequence[str], months: int = 12) -> DataFrame:
    """Sites with at least one value of every required column in every month."""
    monthly = df.groupBy(SITE, "month").agg(*[F.count(c).alias(c) for c in required])
    full = reduce(and_, [F.col(c) > 0 for c in required])
    return monthly.filter(full).groupBy(SITE).count().filter(F.col("count") >= months).select(SITE)


# --- counts -----------------------------------------------------------------

def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; null is a value of its own."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def hour_value_counts_where(df: DataFrame, test: Column, part: str = "hour") -> DataFrame:
    """Distribution of an hour (or day) among the rows that pass a test."""
    return df.filter(test).groupBy(part).agg(F.count(F.lit(1)).alias("n"))


# --- value tables and quantiles ---------------------------------------------

def value_table(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(groups, column, value, n) of the numeric columns, nulls left out; staged."""
    doubles = df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns])
    long = doubles.unpivot(list(groups), list(columns), "column", "value").filter(F.col("value").isNotNull())
    counts = long.groupBy(*groups, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    return staged(counts, "values")


def quantiles(values: DataFrame, groups: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per (groups, column) of a value table."""
    keys = [*groups, "column"]
    ranked = running_total(values, keys, ["value"], F.col("n"), "_upto", total="_all", width=None)
    holds = lambda rank: (F.col("_upto") - F.col("n") <= rank) & (F.col("_upto") > rank)
    picks, ends = [F.max("_all").alias("_all")], {}
    for name, share in shares.items():
        at = (F.col("_all") - 1) * F.lit(float(share))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when(holds(rank), F.col("value"))).alias(f"_{name}_{side}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        ends[name] = (lo + (hi - lo) * (at - F.floor(at))).alias(name)
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *ends.values())


def text_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, unique, top and freq of text columns; the smallest value wins a tie."""
    counts = (
        df.unpivot([], list(columns), "column", "value").filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    # min of (-n, value) = most frequent, then smallest.
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("value"))).alias("best")
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best
    ).select("column", "count", "unique", F.col("best.value").alias("top"), (-F.col("best.minus_n")).alias("freq"))


def describe_columns(df: DataFrame, numeric: Sequence[str], text: Sequence[str] = ()) -> DataFrame:
    """One row per column: count, unique, top, freq, mean, std, min, quartiles, max."""
    summary = selection.summary(values_of(df, [], numeric), QUARTILES)
    if text:
        summary = text_summary(df, text).unionByName(summary, allowMissingColumns=True)
    return summary


SUBSETS = ["overall", "daytime", "nighttime", "highpol_months", "higho3_days"]


def subset_flags(df: DataFrame, limit: float = 40.0) -> DataFrame:
    """Add ``in_{subset}``: whether a row belongs to a profile subset. ``df`` carries hour and month."""
    days = high_o3_days(df, limit).withColumn("_high", F.lit(True))
    dated = df.withColumn("date", F.to_date(epoch_time())).join(days, [SITE, "date"], "left")
    tests = [F.lit(True), is_daytime(), is_nighttime(), is_highpol_month(), F.col("_high").isNotNull()]
    return dated.withColumns({f"in_{s}": test for s, test in zip(SUBSETS, tests)}).drop("_high", "date")


def subset_tags(df: DataFrame, limit: float = 40.0) -> DataFrame:
    """Add ``tags``: the names of the profile subsets a row belongs to."""
    names = [F.when(F.col(f"in_{s}"), F.lit(s)) for s in SUBSETS]
    tags = F.array_compact(F.array(*names))
    return subset_flags(df, limit).withColumn("tags", tags).drop(*[f"in_{s}" for s in SUBSETS])


def describe_by_site_year(df: DataFrame, numeric: Sequence[str], year: str = YEAR, limit: float = 40.0) -> DataFrame:
    """The numeric summary for every (site, year, subset, column).

    Rows are counted once for each combination of subsets they are in, so no task
    holds the values of a group. A missing site or year is a group like any other.
    """
    values = values_of(subset_tags(df, limit), [SITE, year], numeric, tags="tags")
    return selection.summary(values, QUARTILES)


def subset_row_counts(df: DataFrame, year: str = YEAR, limit: float = 40.0) -> DataFrame:
    """Rows per subset and year, counted per tag combination first."""
    counted = subset_tags(df, limit).groupBy(year, "tags").count()
    return counted.withColumn("subset", F.explode("tags")).groupBy(year, "subset").agg(F.sum("count").alias("n_rows"))


# --- limits, histograms, densities ------------------------------------------

def iqr_limits(values: Values) -> DataFrame:
    """The summary with ``limit``, median + 1.5 x (p75 - p25), per (groups, column)."""
    limit = F.col("p50") + 1.5 * (F.col("p75") - F.col("p25"))
    return selection.summary(values, QUARTILES).withColumn("limit", limit)


def upper_limit_3std(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """median + 3 x std (n - 1) per column."""
    summary = selection.summary(values_of(df, [], columns), QUARTILES)
    return summary.select("column", (F.col("p50") + 3 * F.col("std")).alias("limit"))


def histogram_iqr(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """``bins`` equal bins on [0, limit]; outside values are dropped, the last bin is closed."""
    values = values_of(df, [], columns)
    limits = staged(iqr_limits(values).select("column", "limit").filter(F.col("limit") > 0), "limits")
    # One row per column of the call.
    inside = values.long().join(F.broadcast(limits), "column").filter((F.col("value") >= 0) & (F.col("value") <= F.col("limit")))
    number = F.least(F.floor(F.col("value") * bins / F.col("limit")), F.lit(bins - 1))
    counted = inside.groupBy("column", number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return (
        every.join(counted.select("column", "bin", "n"), ["column", "bin"], "left")
        .select(
            "column",
            F.col("bin").cast("long").alias("bin"),
            (F.col("limit") * F.col("bin") / bins).alias("bin_start"),
            (F.col("limit") * (F.col("bin") + 1) / bins).alias("bin_end"),
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        )
    )


def histogram_density(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """The same histogram normalised to area 1."""
    counts = histogram_iqr(df, columns, bins)
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    width = F.col("bin_end") - F.col("bin_start")
    return counts.join(totals, "column").select(
        "column", "bin", "bin_start", "bin_end", F.try_divide(F.col("n"), F.col("total") * width).alias("density")
    )


def kernel_density(df: DataFrame, columns: Sequence[str], points: int = 100, cells: int | None = 512) -> DataFrame:
    """Gaussian density (Scott bandwidth h) on ``points`` grid points over [0, limit].

    Values are first put on a grid of ``cells`` places for each bandwidth: a value's weight goes to the places on
    both sides, in proportion. The kernel is then summed for all points in one expression over the places,
    which are as many as the range has bandwidths, times ``cells``. Interpolating the kernel between places is off by
    at most 1 / (8 cells^2) of its peak 1 / (h sqrt(2 pi)), so by 5e-7 of it for 512. Places farther than
    40 bandwidths from [0, limit] are left out: their kernel is 0 in double precision.
    ``cells=None`` is exact: the places are then the distinct values.
    """
    values = values_of(df, [], columns)
    spread = iqr_limits(values).select(
        "column", F.col("count").alias("total"), (F.col("std") * F.pow(F.col("count").cast("double"), F.lit(-0.2))).alias("h"), "limit"
    ).filter((F.col("h") > 0) & (F.col("limit") > 0))
    spread = F.broadcast(staged(spread, "bandwidths"))  # one row per column of the call
    near = values.long().join(spread, "column").where(F.col("value").between(-40 * F.col("h"), F.col("limit") + 40 * F.col("h")))
    if cells:
        step = F.col("h") / cells
        place = F.floor(F.col("value") / step)
        over = F.col("value") / step - place
        # Each place's weight and what of it belongs to the next one.
        sums = near.groupBy("column", place.alias("_place")).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum(over).alias("_over"))
        both = sums.select("column", "_place", (F.col("_n") - F.col("_over")).alias("_w")).unionByName(sums.select("column", (F.col("_place") + 1).alias("_place"), F.col("_over").alias("_w")))
        masses = both.groupBy("column", "_place").agg(F.sum("_w").alias("_w")).join(spread, "column").withColumn("_at", F.col("_place") * step)
    else:
        masses = near.groupBy("column", F.col("value").alias("_at")).agg(F.count(F.lit(1)).cast("double").alias("_w")).join(spread, "column")
    # One sum for each point, all in one aggregate: places meet the grid inside their row.
    x = lambda p: F.col("limit") * p / (points - 1)
    kernel = lambda p: F.sum(F.col("_w") * F.exp(F.pow((x(p) - F.col("_at")) / F.col("h"), F.lit(2.0)) * -0.5))
    grid = masses.groupBy("column", "limit", "h", "total").agg(*[kernel(p).alias(str(p)) for p in range(points)])
    return grid.unpivot(["column", "limit", "h", "total"], [str(p) for p in range(points)], "point", "mass").select(
        "column", F.col("point").cast("int").alias("point"), x(F.col("point").cast("int")).alias("x"),
        (F.col("mass") / (F.col("total") * F.col("h") * sqrt(2 * pi))).alias("density"),
    )


def flag_outliers(df: DataFrame, columns: Sequence[str], drop: bool = False) -> DataFrame:
    """Add ``{column}_outlier``: the value lies below 0 or above the quartile limit; or drop such rows."""
    limits = iqr_limits(values_of(df, [], columns))
    bounds = as_value(
        limits.agg(*[F.max(F.when(F.col("column") == c, F.col("limit"))).alias(c) for c in columns])
    )
    outside = {
        c: F.coalesce((F.col(c) < 0) | (F.col(c) > bounds[c]), F.lit(False)) for c in columns
    }
    if drop:
        return df.filter(reduce(and_, [~test for test in outside.values()]))
    return df.withColumns({f"{c}_outlier": test for c, test in outside.items()})


# --- two columns, bounds ----------------------------------------------------

def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson matrix over pairwise complete rows; null for a pair with fewer than two rows or without spread.

    Rows are grouped by which features they have. Within such a group every pair of its features is complete,
    so one count, one sum for each feature and one product sum for each pair serve all pairs, and the groups that
    have both features of a pair add up. Values are shifted by the feature's mean, which keeps the sums exact.
    """
    features = list(features)
    means = df.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)]).first()
    shifted = df.select(*[(F.col(f).cast("double") - F.lit(means[i] or 0.0)).alias(f"x{i}") for i, f in enumerate(features)])
    pairs = list(combinations_with_replacement(range(len(features)), 2))
    has = F.concat(*[F.when(F.col(f"x{i}").isNull(), F.lit("0")).otherwise(F.lit("1")) for i in range(len(features))])
    sums = shifted.groupBy(has.alias("has")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(len(features))],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs],
    )
    part = lambda i, j: F.struct(
        F.lit(features[i]).alias("a"), F.lit(features[j]).alias("b"), "n", F.col(f"s{i}").alias("sa"), F.col(f"s{j}").alias("sb"),
        F.col(f"p{i}_{j}").alias("ab"), F.col(f"p{i}_{i}").alias("aa"), F.col(f"p{j}_{j}").alias("bb"),
    )
    given = lambda i: F.substring("has", i + 1, 1) == "1"
    both = [F.when(given(i) & given(j), part(i, j)) for i, j in pairs]
    every = sums.select(F.explode(F.array_compact(F.array(*both))).alias("q")).select("q.*")
    total = every.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "ab", "aa", "bb")])
    within = lambda xy, x, y: F.col(xy) - F.col(x) * F.col(y) / F.col("n")
    spread = lambda xx, x: F.when(within(xx, x, x) > 1e-14 * F.col(xx), within(xx, x, x))
    r = F.when(F.col("n") > 1, F.try_divide(within("ab", "sa", "sb"), F.sqrt(spread("aa", "sa")) * F.sqrt(spread("bb", "sb"))))
    found = total.select("a", "b", F.when(F.col("a") == F.col("b"), F.when(r.isNotNull(), F.lit(1.0))).otherwise(r).alias("r"))
    names = df.sparkSession.createDataFrame([(features[i], features[j]) for i, j in pairs], "a string, b string")
    half = names.join(F.broadcast(found), ["a", "b"], "left")
    mirror = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.select(F.explode(mirror).alias("_p"), "r").select("_p.a", "_p.b", "r")


def global_minmax(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row with ``{feature}_min`` and ``{feature}_max``; null (masked) values do not count."""
    return df.agg(
        *[F.min(f).alias(f"{f}_min") for f in features], *[F.max(f).alias(f"{f}_max") for f in features]
    )


def minmax_scale(df: DataFrame, features: Sequence[str], bounds: DataFrame, zero_range: float | None = 0.0) -> DataFrame:
    """(x - min) / |max - min| by the one-row ``bounds``; ``zero_range`` where the range is 0."""
    b = as_value(bounds)
    scaled = {}
    for f in features:
        low, high = b[f"{f}_min"], b[f"{f}_max"]
        value = F.try_divide(F.col(f) - low, F.abs(high - low))
        if zero_range is not None:
            value = F.when(low == high, F.lit(zero_range)).otherwise(value)
        scaled[f] = value
    return df.withColumns(scaled)


def minmax_scale_as(df: DataFrame, columns: dict[str, str], bounds: DataFrame) -> DataFrame:
    """Scale labels or sequence features by the bounds of the feature each is derived from.

    A range of 0 gives null.
    """
    b = as_value(bounds)
    return df.withColumns(
        {c: F.try_divide(F.col(c) - b[f"{f}_min"], F.abs(b[f"{f}_max"] - b[f"{f}_min"])) for c, f in columns.items()}
    )
