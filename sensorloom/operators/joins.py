"""Joins with the site dimension, with days, with neighbours and with the time grid.

No side is forced to broadcast: Spark broadcasts a side whose measured size is
below its threshold, and otherwise splits hot sites by adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.scalar import epoch_time, euclid_distance
from sensorloom.schema import EPOCH, READING_SECONDS, SITE


def join_site_coords(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Add ``latitude`` and ``longitude`` of the site; unknown sites get null."""
    return df.join(sites.select(SITE, "latitude", "longitude"), SITE, "left")


def fill_site_gps(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Overwrite the row's coordinates by the site table's where it has them."""
    dim = sites.select(SITE, F.col("latitude").alias("_lat"), F.col("longitude").alias("_long"))
    return (
        df.join(dim, SITE, "left")
        .withColumns({"latitude": F.coalesce("_lat", "latitude"), "longitude": F.coalesce("_long", "longitude")})
        .drop("_lat", "_long")
    )


def semi_join_valid_sites(df: DataFrame, valid: DataFrame, site: str = SITE) -> DataFrame:
    """Keep rows of the sites named in ``valid``."""
    return df.join(valid.select(F.col(valid.columns[0]).alias(site)), site, "left_semi")


def high_o3_days(df: DataFrame, limit: float = 40.0) -> DataFrame:
    """(site, date) pairs on which o3 exceeded the limit."""
    day = F.to_date(epoch_time())
    return df.filter(F.col("o3") > limit).select(SITE, day.alias("date")).distinct()


def semi_join_high_o3_days(df: DataFrame, limit: float = 40.0) -> DataFrame:
    """All rows of days on which o3 exceeded the limit at the site."""
    dated = df.withColumn("date", F.to_date(epoch_time()))
    return dated.join(high_o3_days(df, limit), [SITE, "date"], "left_semi").drop("date")


def left_join_time_grid(grid: DataFrame, df: DataFrame) -> DataFrame:
    """Every grid instant of a site, with its readings where there are any."""
    return grid.join(df, [SITE, EPOCH], "left")


def neighbor_lookup(df: DataFrame, neighbors: DataFrame, measures: Sequence[str], at: str = EPOCH) -> DataFrame:
    """Mean value of each neighbour site at the same ``at``, one row per (row, neighbour)."""
    values = df.groupBy(F.col(SITE).alias("neighbor"), at).agg(*[F.avg(m).alias(f"neighbor_{m}") for m in measures])
    wanted = df.select(SITE, at).distinct()
    return wanted.join(neighbors, SITE).join(values, ["neighbor", at], "left")


def ground_truth_rows(
    df: DataFrame, runs: DataFrame, by_site: bool = True, step: int = READING_SECONDS
) -> DataFrame:
    """Rows lying in complete runs, matched on site and epoch or on the epoch alone.

    Runs lie within a day, so a site's rows meet only its runs of the same day. For
    the epoch alone the instants of all runs are made distinct: one row per instant,
    however many sites share it.
    """
    if by_site:
        spans = runs.select(SITE, "day", "run_start", "run_end")
        rows = df.withColumn("day", F.floor(F.col(EPOCH) / 86400))
        same = [rows[SITE] == spans[SITE], rows["day"] == spans["day"]]
        inside = rows[EPOCH].between(spans["run_start"], spans["run_end"])
        return rows.join(spans, [*same, inside], "left_semi").select(*df.columns)
    instants = runs.select(F.explode(F.sequence("run_start", "run_end", F.lit(step))).alias(EPOCH))
    return df.join(instants.distinct(), EPOCH, "left_semi")


def pair_site_features(
    df: DataFrame, first: str, second: str, columns: Sequence[str], join: bool = False
) -> DataFrame:
    """Two sites' columns under ``a_`` / ``b_`` prefixes, stacked or joined on the epoch.

    The stacked form carries the site as 0 / 1. The joined form averages readings
    that share an epoch, so no pair is multiplied.
    """
    sides = []
    for prefix, code, number in (("a", first, 0), ("b", second, 1)):
        rows = df.filter(F.col(SITE) == code)
        if join:
            rows = rows.groupBy(EPOCH).agg(*[F.avg(c).alias(f"{prefix}_{c}") for c in columns])
        else:
            rows = rows.select(
                EPOCH, F.lit(number).alias("site_no"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns]
            )
        sides.append(rows)
    if join:
        return sides[0].join(sides[1], EPOCH)
    return sides[0].unionByName(sides[1], allowMissingColumns=True)


# --- neighbours -------------------------------------------------------------

def _cells(level: Column, smallest: float) -> tuple[Column, Column]:
    size = smallest * F.pow(F.lit(2.0), level)
    return F.floor(F.col("longitude") / size), F.floor(F.col("latitude") / size)


def _around(cell: str) -> Column:
    return F.explode(F.sequence(F.col(cell) - 1, F.col(cell) + 1))


def site_places(sites: DataFrame) -> DataFrame:
    """(site, latitude, longitude), each once: which place every site with coordinates stands at."""
    known = F.col(SITE).isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return sites.filter(known).select(SITE, "latitude", "longitude").distinct()


def neighbor_places(sites: DataFrame, max_distance: float) -> DataFrame:
    """Ordered pairs of places no farther apart than ``max_distance`` degrees, with the number of sites at each.

    Sites at one place are one class: more of them add members, not pairs. A place
    is paired with itself, at distance 0, if two sites stand there. Cells of the distance's size hold
    the candidates, so only places of adjacent cells meet. ``site_places`` has the members.
    """
    places = site_places(sites).groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("n_sites"))
    cx, cy = F.floor(F.col("longitude") / max_distance), F.floor(F.col("latitude") / max_distance)
    placed = places.withColumns({"cx": cx, "cy": cy})
    left = placed.withColumn("cx", _around("cx")).withColumn("cy", _around("cy"))
    right = placed.select(
        F.col("latitude").alias("lat2"), F.col("longitude").alias("long2"), F.col("n_sites").alias("n_neighbors"), "cx", "cy"
    )
    distance = F.round(euclid_distance("latitude", "longitude", "lat2", "long2"), 9)
    itself = (F.col("latitude") == F.col("lat2")) & (F.col("longitude") == F.col("long2"))
    return (
        left.join(right, ["cx", "cy"])
        .filter(~itself | (F.col("n_sites") > 1))
        .select("latitude", "longitude", "lat2", "long2", distance.alias("distance"), "n_sites", "n_neighbors")
        .filter(F.col("distance") <= max_distance)
    )


def neighbor_pairs(sites: DataFrame, max_distance: float) -> DataFrame:
    """``neighbor_places`` spelt out for sites: ordered pairs a != b with their distance.

    The output grows with the square of the sites at one place; where many share places, work
    with ``neighbor_places`` and ``site_places`` instead.
    """
    members = site_places(sites)
    others = members.select(F.col(SITE).alias("neighbor"), F.col("latitude").alias("lat2"), F.col("longitude").alias("long2"))
    near = neighbor_places(sites, max_distance).select("latitude", "longitude", "lat2", "long2", "distance")
    return (
        near.join(members, ["latitude", "longitude"]).join(others, ["lat2", "long2"])
        .filter(F.col(SITE) != F.col("neighbor")).select(SITE, "neighbor", "distance")
    )


def nearest_k_sites(sites: DataFrame, k: int = 4, smallest: float = 2.0**-17, levels: int = 27) -> DataFrame:
    """The exact ``k`` nearest sites of each site by (distance, code).

    Sites at one location share their neighbours, so locations search, and a location
    offers only its k + 1 smallest codes: no other can be among the nearest. Every
    location searches at the finest cell size at which its own cell offers more than
    ``k`` candidates. The nearest then lie within the cell's diagonal, hence inside the
    3 x 3 block of cells twice as large; no other site is compared. The coarsest level
    covers the globe and serves locations that never find ``k`` others.
    """
    placed = sites.select(SITE, "latitude", "longitude").filter(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    )
    # Rank limits are pushed below the shuffle: each task forwards the first few rows of a group.
    same_place = Window.partitionBy("latitude", "longitude").orderBy(SITE)
    offered = placed.withColumn("_r", F.row_number().over(same_place)).filter(F.col("_r") <= k + 1).drop("_r")
    leveled = offered.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    cx, cy = _cells(F.col("level"), smallest)
    leveled = leveled.withColumns({"cx": cx, "cy": cy})
    cell = ["level", "cx", "cy"]
    full = leveled.groupBy(*cell).count().filter(F.col("count") > k).select(*cell)
    place = ["latitude", "longitude"]
    finest = (
        leveled.join(full, cell).groupBy(*place)
        .agg(F.least(F.min("level") + 1, F.lit(levels)).alias("level"))
    )
    query = placed.select(*place).distinct().join(finest, place, "left").withColumn(
        "level", F.coalesce("level", F.lit(levels))
    )
    query = query.withColumns({"cx": cx, "cy": cy}).withColumn("cx", _around("cx")).withColumn("cy", _around("cy"))
    candidates = leveled.select(
        F.col(SITE).alias("neighbor"), F.col("latitude").alias("lat2"), F.col("longitude").alias("long2"), *cell
    )
    distance = F.round(euclid_distance("latitude", "longitude", "lat2", "long2"), 9).alias("distance")
    by_place = Window.partitionBy(*place).orderBy("distance", "neighbor")
    near = (
        query.join(candidates, cell).select(*place, "neighbor", distance)
        .withColumn("_r", F.row_number().over(by_place)).filter(F.col("_r") <= k + 1).drop("_r")
    )
    by_site = Window.partitionBy(SITE).orderBy("distance", "neighbor")
    return (
        placed.join(near, place).filter(F.col(SITE) != F.col("neighbor"))
        .select(SITE, "neighbor", "distance")
        .withColumn("rank", F.row_number().over(by_site)).filter(F.col("rank") <= k)
    )
