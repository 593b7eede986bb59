"""Tiny frames with results worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sensorloom.functions import scalar as fn
from sensorloom.operators import filters as flt
from sensorloom.operators import impute as im
from sensorloom.operators import joins as jn
from sensorloom.operators import ml
from sensorloom.operators import profile as pf
from sensorloom.operators import reshape as rsh
from sensorloom.operators import rowwindows as rw
from sensorloom.plans.chain import chain_from_config
from sensorloom.sources import readings as src
from sensorloom.sources import sinks

SERIES = "aqs_code string, epoch long, event_id long, o3 double"


def series(frame, values, site="a", start=0):
    return frame([(site, start + 300 * i, i, v) for i, v in enumerate(values)], SERIES)


def windows(frame, values, site="a"):
    return frame([(site, i, v) for i, v in enumerate(values)], "aqs_code string, window_no long, o3 double")


def column(df, name, *order):
    return [row[name] for row in df.orderBy(*order).collect()]


# --- blocks -----------------------------------------------------------------

@pytest.mark.parametrize("nulls,expected", [(0, 6.5), (3, 8.0), (4, 0.0), (12, 0.0)])
def test_null_share_of_a_block(frame, nulls, expected):
    df = series(frame, [None] * nulls + [float(i) for i in range(nulls + 1, 13)])
    assert column(rw.tumble_rows(df, ["o3"]), "o3", "window_no") == [expected]


@pytest.mark.parametrize("rows,blocks", [(11, 0), (12, 1), (13, 1), (24, 2)])
def test_incomplete_blocks_stay_out(frame, rows, blocks):
    assert rw.tumble_rows(series(frame, [1.0] * rows), ["o3"]).count() == blocks


@pytest.mark.parametrize("rows,blocks", [(12, 0), (13, 1), (24, 1), (25, 2)])
def test_plain_blocks_without_the_closing_one(frame, rows, blocks):
    df = series(frame, [1.0] * rows)
    assert rw.tumble_rows_plain(df, ["o3"], drop_last_full=True).count() == blocks
    assert rw.tumble_rows_plain(df, ["o3"]).count() == rows // 12


def test_masked_blocks_leave_the_bounds(frame):
    df = series(frame, [5.0] * 12 + [None] * 12 + [9.0] * 12)
    bounds = pf.global_minmax(rw.tumble_rows(df, ["o3"], mask=None), ["o3"]).first()
    assert (bounds.o3_min, bounds.o3_max) == (5.0, 9.0)


def test_two_readings_at_one_instant_follow_their_id(frame):
    df = frame([("a", 0, 2, 20.0), ("a", 0, 1, 10.0), ("a", 300, 3, 30.0)], SERIES)
    assert column(rw.lag_features(df, ["o3"]), "last_o3", "event_id") == [10.0, 20.0]


def test_mode_takes_the_smallest_of_a_tie(frame):
    rows = [("a", 300 * i, i, 1.0, "b" if i % 2 else "a") for i in range(4)]
    df = frame(rows, SERIES + ", flag string")
    assert column(rw.tumble_rows_mean_mode(df, ["o3"], ["flag"], rows=4), "flag", "window_no") == ["a"]


# --- sequences --------------------------------------------------------------

@pytest.mark.parametrize("n,expected", [(6, 0), (7, 1), (8, 2)])
def test_sequence_count(frame, n, expected):
    built = rw.sequence_build(windows(frame, map(float, range(n))), ["o3"], length=4, prediction=3)
    assert built.count() == expected


def test_sequence_holds_trailing_rows_and_next_label(frame):
    built = rw.sequence_build(windows(frame, map(float, range(6))), ["o3"], 3, 1, with_labels=["o3"], enrich=["o3"])
    first = built.orderBy("window_no").first()
    assert first.seq == [Row(o3=0.0), Row(o3=1.0), Row(o3=2.0)]
    assert first.label_o3 == 3.0 and first.o3_m == 1.0 and first.o3_b == 0.0
    assert first.o3_std == pytest.approx(math.sqrt(2 / 3))
    assert column(built, "window_no", "window_no") == [2, 3, 4]
    assert rw.sequence_build(windows(frame, map(float, range(6))), ["o3"], 3, 1, drop_tail=2).count() == 1


def test_nulls_stay_in_a_sequence(frame):
    built = rw.sequence_build(windows(frame, [1.0, None, 3.0]), ["o3"], 3, 0)
    assert built.first().seq == [Row(o3=1.0), Row(o3=None), Row(o3=3.0)]


def test_future_labels(frame):
    df = windows(frame, [1.0, 2.0, None, 4.0, 50.0])
    assert column(rw.label_future_mean(df, ["o3"], 2), "u_o3", "window_no") == [2.0, 4.0, 27.0]
    hot = rw.label_threshold_or(df, {"o3": 40.0}, 2)
    assert column(hot, "label", "window_no") == [False, False, True]
    assert column(rw.label_threshold_or(df, {"o3": 40.0}, 2, invert=True), "label", "window_no") == [True, True, False]


def test_lookback_leaves_the_last_row(frame):
    data = rw.lookback_dataset(windows(frame, map(float, range(5))).withColumn("t", F.col("o3") * 10), ["o3", "t"], "t", 2)
    got = [(r.window_no, [x.o3 for x in r.x], r.y) for r in data.orderBy("window_no").collect()]
    assert got == [(2, [0.0, 1.0], 20.0), (3, [1.0, 2.0], 30.0)]


def test_rolling_deviation_needs_full_frames(frame):
    df = series(frame, [1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0]).withColumnRenamed("o3", "winddir")
    got = column(rw.rolling_std(df, rows=3), "winddir_std", "event_id")
    assert got == [None, None, None, 1.0]


# --- runs, grid, spectrum ---------------------------------------------------

def test_complete_runs_keep_the_last_run(frame):
    epochs = [0, 300, 600, 1800, 2100, 86_400, 86_700, 87_000]
    df = frame([("a", e, i, 1.0) for i, e in enumerate(epochs)] + [("a", 300, 99, 1.0)], SERIES)
    runs = rw.complete_runs(df, min_rows=3).orderBy("run_start").collect()
    assert [(r.run_start, r.run_end, r.n_rows) for r in runs] == [(0, 600, 3), (86_400, 87_000, 3)]


@pytest.mark.parametrize("by_site,expected", [(True, [0, 1, 2]), (False, [0, 1, 2, 9])])
def test_rows_of_complete_runs(frame, by_site, expected):
    df = frame([("a", 300 * i, i, 1.0) for i in range(3)] + [("b", 300, 9, 1.0), ("b", 9000, 10, 1.0)], SERIES)
    runs = rw.complete_runs(df, min_rows=3)
    assert column(jn.ground_truth_rows(df, runs, by_site), "event_id", "event_id") == expected


@pytest.mark.parametrize("step", [300, 100_000])
def test_time_grid_includes_both_ends(frame, step):
    df = frame([("a", 50, 0, 1.0), ("a", 50 + 1000 * step, 1, 1.0), ("b", 7, 2, 1.0)], SERIES)
    got = rsh.time_grid(df, step).groupBy("aqs_code").agg(F.min("epoch"), F.max("epoch"), F.countDistinct("epoch"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 50, 50 + 1000 * step, 1001), ("b", 7, 7, 1)]


def test_spectrum_of_a_pure_wave(frame):
    n, k = 16, 3
    df = series(frame, [2.0 * math.cos(2 * math.pi * k * j / n) for j in range(n)])
    got = {r.k: r.amplitude for r in rw.dft_amplitude(df, ["o3"]).collect()}
    assert set(got) == set(range(n // 2)) and got[k] == pytest.approx(1.0)
    assert all(abs(a) < 1e-9 for i, a in got.items() if i != k)


def test_spectrum_uses_the_whole_day(frame):
    rows = [("a", 100 * i, i, float(i // 3 % 2)) for i in range(864)]
    df = frame(rows, "aqs_code string, epoch long, event_id long, o3 double")
    got = {r.k: (r.n, r.amplitude) for r in rw.dft_amplitude(df, ["o3"]).collect()}
    assert set(got) == set(range(144)) and got[0] == (288, pytest.approx(0.5))


# --- scaling ----------------------------------------------------------------

def test_scaling_without_a_range(frame):
    df = windows(frame, [4.0, 4.0])
    bounds = pf.global_minmax(df, ["o3"])
    assert column(pf.minmax_scale(df, ["o3"], bounds), "o3", "window_no") == [0.0, 0.0]
    labels = df.withColumn("label_o3", F.lit(5.0))
    assert column(pf.minmax_scale_as(labels, {"label_o3": "o3"}, bounds), "label_o3", "window_no") == [None, None]


# --- filters ----------------------------------------------------------------

def test_day_and_night_leave_hour_20(frame):
    df = frame([(h,) for h in (0, 6, 7, 19, 20, 21, 23)], "hour int")
    assert column(flt.subset_daytime(df), "hour", "hour") == [7, 19]
    assert column(flt.subset_nighttime(df), "hour", "hour") == [0, 6, 21, 23]


def test_high_season(frame):
    df = frame([(m,) for m in (3, 4, 10, 11)], "month int")
    assert column(flt.subset_highpol_months(df), "month", "month") == [4, 10]


FLAGGED = "id int, aqs_code string, data_year int, nox_flag string, no_flag string, no2_flag string, o3_flag string, temp_flag string, winddir double"


def test_flag_rule_by_era(frame):
    old, new = ["VAL"] * 5, ["K"] * 5
    rows = [
        (1, "a", 2013, *old, 1.0),
        (2, "a", 2013, *new, 1.0),
        (3, "a", 2014, *new, 1.0),
        (4, "a", 2014, *old, 1.0),
        (5, "a", 2014, "K", "K", "LST", "K", "K", 1.0),  # no2 is not checked from 2014
        (6, "a", 2013, "VAL", "VAL", "LST", "VAL", "VAL", 1.0),
        (7, "a", 2013, "VAL", "VAL", "VAL", None, "VAL", 1.0),
        (8, "a", 2013, *old, None),
        (9, None, 2013, *old, 1.0),
    ]
    df = frame(rows, FLAGGED)
    assert column(flt.filter_valid_flags(df), "id", "id") == [1, 3, 5]
    assert column(flt.filter_valid_2000_2013(df), "id", "id") == [1, 4, 6, 9]
    mixed = frame([(1, "a", 2014, "VAL", "VAL", "x", "K", "K", 1.0), (2, "a", 2014, *new, 1.0)], FLAGGED)
    assert column(flt.mark_valid(mixed), "val", "id") == ["y", "n"]


def test_invalid_measures_become_null(frame):
    df = frame([(1, 2013, 5.0, "VAL"), (2, 2013, 5.0, "K"), (3, 2014, 5.0, "K"), (4, 2014, 5.0, None)],
               "id int, data_year int, o3 double, o3_flag string")
    assert column(flt.invalid_to_null(df, ["o3"]), "o3", "id") == [5.0, None, 5.0, None]


def test_null_policies(frame):
    df = frame([("a", 1, None), ("b", 2, 3.0)], "aqs_code string, n int, v double")
    assert flt.drop_any_null(df).collect() == [Row(aqs_code="b", n=2, v=3.0)]
    assert sorted(flt.mask_null_rows(df, 1000.0).collect()) == [
        Row(aqs_code="a", n=1000, v=1000.0), Row(aqs_code="b", n=2, v=3.0)
    ]
    assert column(flt.fill_null_const(df, 7.0), "v", "n") == [7.0, 3.0]


def test_columns_without_a_value_go(frame):
    df = frame([("a", 1.0, None, None)], "s string, x double, y double, z string")
    assert flt.drop_all_null_columns(df).columns == ["x"]
    assert flt.drop_all_null_columns(df, numeric_only=False).columns == ["s", "x"]


# --- scalars ----------------------------------------------------------------

@pytest.mark.parametrize("direction,x,y", [(0.0, 2, 0), (90.0, 0, 2), (180.0, -2, 0), (270.0, 0, -2), (None, None, None)])
def test_wind(frame, direction, x, y):
    got = fn.wind_vector(frame([(2.0, direction)], "windspd double, winddir double")).first()
    if x is None:
        assert got.wind_x_dir is None and got.wind_y_dir is None
    else:
        assert (got.wind_x_dir, got.wind_y_dir) == pytest.approx((x, y), abs=1e-12)


def test_site_codes(frame):
    df = frame([("48_201_0051",), ("06_001_0007",), (None,)], "c string")
    row = df.select(fn.site_code_to_number("c").alias("n"), fn.site_in_region("c", ["48_201_0051"]).alias("i"))
    assert [tuple(r) for r in row.collect()] == [(482010051, True), (60010007, False), (None, False)]
    back = df.select(fn.site_number_to_code(fn.site_code_to_number("c")).alias("c"))
    assert [r.c for r in back.collect()][:2] == ["48_201_0051", "06_001_0007"]


def test_blank_text_and_nan(frame):
    df = frame([("  ", float("nan")), ("", 1.0), ("x", None)], "t string, v double")
    got = df.select(fn.blank_to_null("t").alias("t"), fn.nan_to_null("v").alias("v")).collect()
    assert [tuple(r) for r in got] == [(None, None), (None, 1.0), ("x", None)]
    assert flt.rows_with_any_null(df.select("t")).count() == 2


def test_clock(frame):
    assert frame([("06:15:59",)], "c string").select(fn.clock_to_minutes("c")).first()[0] == 375


# --- sources ----------------------------------------------------------------

def test_yearly_files(spark, tmp_path):
    header = ",".join(["AQS_Code", "redraw", "Latitude", "Longitude", "epoch"]
                      + [c for m in src.READING_SCHEMA.fieldNames()[5::2] for c in (m, f"{m}_flag")])
    empty = "," * 25
    for year in (2013, 2015):
        lines = [header, f"48_201_0001,,29.5,NaN,{year}{empty},", header, f"48_201_0002,,,-95.1,x{empty},"]
        (tmp_path / f"Data_{year}.csv").write_text("\n".join(lines) + "\n")
    rows = src.read_readings(spark, str(tmp_path), 2013, 2016, skip_absent=True).orderBy("data_year", "aqs_code").collect()
    assert [(r.aqs_code, r.data_year, r.epoch, r.latitude, r.longitude) for r in rows] == [
        ("48_201_0001", 2013, 2013, 29.5, None), ("48_201_0002", 2013, None, None, -95.1),
        ("48_201_0001", 2015, 2015, 29.5, None), ("48_201_0002", 2015, None, None, -95.1),
    ]


def test_site_table(frame):
    raw = frame([("a", "A", "-95.3414", "29.7176", "12", "31-Mar-10", ""), ("b", "B", "0", "0", "NA", " ", "1-Jan-18")],
                src.SITE_TABLE_SCHEMA)
    a, b = src.site_dimension(raw).orderBy("aqs_code").collect()
    assert (a.latitude, str(a.activation), a.deactivation, a.region) == (29.7176, "2010-03-31", None, "12")
    assert (b.latitude, b.longitude, b.activation, str(b.deactivation)) == (None, None, None, "2018-01-01")


def test_index_columns(frame):
    df = frame([(1, 2, 3)], "`Unnamed: 0` int, _c0 int, o3 int")
    assert src.drop_index_columns(df).columns == ["o3"]


# --- profiles ---------------------------------------------------------------

def test_hour_with_too_many_nulls(frame):
    rows = [("a", 2000, 1, 1, h, None if i < n else 4.0) for h, n in ((0, 9), (1, 10), (2, 0)) for i in range(12)]
    df = frame(rows, "aqs_code string, year int, month int, day int, hour int, o3 double")
    assert column(pf.hourly_mean_by_site(df, ["o3"]), "hour", "hour") == [0, 2]
    assert column(pf.hourly_mean_by_site(df, ["o3"], min_present=9), "hour", "hour") == [2]


def test_null_hours(frame):
    rows = [("a", m, d, 5, v) for m, d, v in ((1, 1, None), (1, 2, None), (1, 2, 3.0), (1, 3, None))]
    df = frame(rows, "aqs_code string, month int, day int, hour int, no double")
    assert pf.null_hour_tally(df, ["no"]).first().no == 2
    assert pf.null_hour_tally(df, ["no"], skip_first_day=True).first().no == 1


def test_quantiles_are_interpolated(frame):
    values = pf.value_table(frame([(float(v),) for v in (1, 2, 2, 10)], "x double"), [], ["x"])
    got = pf.quantiles(values, [], {"a": 0.25, "b": 0.5, "c": 0.9, "d": 1.0}).first()
    assert (got.a, got.b, got.c, got.d) == pytest.approx((1.75, 2.0, 7.6, 10.0))


def test_quantiles_of_many_values_use_ranges(spark, monkeypatch):
    from sensorloom.operators import profile
    from sensorloom.plans import ordered

    small = lambda *args, **kw: ordered.running_total(*args, **kw, max_rows=25)
    monkeypatch.setattr(profile, "running_total", small)
    df = spark.range(1001).select(((F.col("id") * 37) % 1001).cast("double").alias("x"))
    got = profile.quantiles(profile.value_table(df, [], ["x"]), [], profile.QUARTILES).first()
    assert (got.p25, got.p50, got.p75) == (250.0, 500.0, 750.0)


def test_profile_has_groups_without_site_or_year(frame):
    rows = [(("a", "b", None)[i % 3], (2000, 2001, 2002, None)[i % 4], 300 * i, i % 24, 1 + i % 12, None if i % 5 == 0 else float(i % 50)) for i in range(400)]
    df = frame(rows, "aqs_code string, data_year int, epoch long, hour int, month int, o3 double")
    got = {(r.aqs_code, r.data_year): r for r in pf.describe_by_site_year(df, ["o3"]).collect() if r.subset == "overall"}
    plain = df.toPandas().dropna(subset=["o3"]).groupby(["aqs_code", "data_year"], dropna=False)["o3"]
    assert len(got) == plain.ngroups == 12
    for (site, year), values in plain:
        r = got[None if site != site else site, None if year != year else int(year)]
        want = values.describe()
        assert [r["count"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]] == pytest.approx(list(want))


def test_bracket_mean_keeps_rows_without_site(frame):
    rows = [(None if i % 5 == 0 else "a", 300 * i, i, None if i % 4 == 1 else float(i)) for i in range(100)]
    df = frame(rows, "aqs_code string, epoch long, event_id long, o3 double")
    got = {r.event_id: r.o3 for r in im.impute_bracket_mean(df, ["o3"]).collect()}
    assert len(got) == 100
    assert got[5] is None and got[10] == 10.0  # without a site: nothing to fill from
    assert got[1] is None and got[9] == (8 + 11) / 2  # 10 has no site


def test_histogram_closes_the_last_bin(frame):
    df = frame([(float(v),) for v in (-1, 0, 5, 5, 10, 10, 10, 20)], "x double")
    limit = 7.5 + 1.5 * (10 - 3.75)
    got = {r.bin: r.n for r in pf.histogram_iqr(df, ["x"], bins=4).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 0} and limit < 20
    assert sum(r.density * (r.bin_end - r.bin_start) for r in pf.histogram_density(df, ["x"]).collect()) == pytest.approx(1)


def test_density_integrates_to_one(frame):
    df = frame([(float(v % 50),) for v in range(500)], "x double")
    rows = pf.kernel_density(df, ["x"], points=400).orderBy("point").collect()
    width = rows[1].x - rows[0].x
    assert 0.9 < sum(r.density for r in rows) * width < 1.0


def test_outliers_can_be_dropped(frame):
    df = frame([(float(v),) for v in range(100)] + [(1000.0,), (-5.0,), (None,)], "x double")
    assert pf.flag_outliers(df, ["x"]).filter("x_outlier").count() == 2
    assert pf.flag_outliers(df, ["x"], drop=True).count() == 101


# --- imputation -------------------------------------------------------------

def test_bracket_mean(frame):
    df = series(frame, [None, 1.0, None, None, 5.0, None])
    assert column(im.impute_bracket_mean(df, ["o3"]), "o3", "event_id") == [None, 1.0, 3.0, 3.0, 5.0, None]


@pytest.mark.parametrize(
    "missing,plain,rescaled",
    [(0, 2.5, 2.5), (1, None, 3.0), (2, None, 3.5), (3, None, None), (4, None, None)],
)
def test_neighbours(frame, missing, plain, rescaled):
    weights = frame([("t", f"n{i}", 0.25) for i in range(1, 5)], "aqs_code string, neighbor string, weight double")
    rows = [("t", 0, None)] + [(f"n{i}", 0, None if i <= missing else float(i)) for i in range(1, 5)]
    df = frame(rows, "aqs_code string, epoch long, no double")
    for flag, want in ((False, plain), (True, rescaled)):
        row = im.impute_neighbors(df, weights, ["no"], renormalize=flag).filter("aqs_code = 't'").first()
        assert row.no == want and row.no_status == ("insufficient" if want is None else "filled")


def test_weights_are_a_softmax(frame):
    near = frame([("t", "a", 1.0), ("t", "b", 3.0)], "aqs_code string, neighbor string, distance double")
    a, b = column(im.neighbor_weights(near), "weight", "neighbor")
    assert a + b == pytest.approx(1) and a / b == pytest.approx(math.exp(0.5))


def test_column_mean_drops_empty_columns(frame):
    df = im.impute_column_mean(frame([(1.0, None), (None, None)], "x double, y double"), ["x", "y"])
    assert df.columns == ["x"] and column(df, "x", "x") == [1.0, 1.0]


# --- neighbours in space ----------------------------------------------------

def test_nearest_sites_are_exact(spark):
    import random

    rng = random.Random(3)
    points = [(f"s{i:03d}", 29 + rng.random() * 0.01, -95 + rng.random() * 0.01) for i in range(60)]
    points += [(f"t{i:03d}", rng.uniform(-60, 60), rng.uniform(-170, 170)) for i in range(40)]
    points += [(f"u{i:03d}", 10.0, 10.0) for i in range(7)] + [("v000", 10.0, 10.001)]
    points += [(f"w{i:03d}", 29 + rng.random() * 1e-4, -95 + rng.random() * 1e-4) for i in range(30)]
    sites = spark.createDataFrame(points, "aqs_code string, latitude double, longitude double")
    got = {}
    for r in jn.nearest_k_sites(sites, 4).collect():
        got.setdefault(r.aqs_code, {})[r["rank"]] = r.neighbor
    for code, lat, long in points:
        ranked = sorted((round(math.hypot(lat - b, long - c), 9), a) for a, b, c in points if a != code)
        assert [got[code][i] for i in range(1, 5)] == [a for _, a in ranked[:4]]


def test_few_sites_have_few_neighbours(spark):
    sites = spark.createDataFrame([("a", 1.0, 1.0), ("b", -50.0, -120.0), ("c", 2.0, 1.0)], "aqs_code string, latitude double, longitude double")
    assert jn.nearest_k_sites(sites, 4).count() == 6
    assert sorted((r.aqs_code, r.neighbor) for r in jn.neighbor_pairs(sites, 1.5).collect()) == [("a", "c"), ("c", "a")]


def test_shared_places_add_members_not_pairs(frame):
    rows = [(f"s{i}", 29.0 + i % 10 * 0.5, -95.0) for i in range(1000)] + [("s3", 30.5, -95.0), (None, 29.0, -95.0), ("lost", None, -95.0)]
    sites = frame(rows, "aqs_code string, latitude double, longitude double")
    got = {(r.latitude, r.lat2): (r.distance, r.n_sites, r.n_neighbors) for r in jn.neighbor_places(sites, 0.6).collect()}
    assert len(got) == 10 + 2 * 9 and got[29.0, 29.5] == (0.5, 100, 100) and got[29.0, 29.0] == (0.0, 100, 100)
    assert jn.site_places(sites).count() == 1000
    few = sites.where("aqs_code IN ('s1', 's2', 's11')")
    want = {("s1", "s11"), ("s11", "s1"), ("s1", "s2"), ("s2", "s1"), ("s11", "s2"), ("s2", "s11")}
    assert {(r.aqs_code, r.neighbor) for r in jn.neighbor_pairs(few, 0.6).collect()} == want



# --- chain, metrics ---------------------------------------------------------

def test_configured_chain(frame):
    df = series(frame, [None, 1.0, 2.0, 3.0, 4.0, 50.0]).withColumn("data_year", F.lit(2013))
    config = {
        "years": [2013], "sites": ["a"], "nanhandling": {"method": "fill", "value": 0.0},
        "dependent_generation": [{"name": "hot", "function": "threshold_or", "future_samples": 2, "keys": ["o3"], "thresholds": [40.0]}],
        "windowers": [{"name": "w", "samples": 2, "sequencer": {"samples": 2}, "keys": [{"name": "o3", "type": "continuous"}]}],
    }
    rows = chain_from_config(df, config)["w"].orderBy("window_no").collect()
    assert [(r.window_no, [(s.o3, s.hot) for s in r.seq]) for r in rows] == [
        (1, [(0.5, False), (1.5, False)]), (2, [(1.5, False), (2.5, True)])
    ]


def test_metrics(frame):
    df = frame([(1.0, 1.0), (2.0, 4.0), (3.0, 3.0), (None, 9.0)], "y double, p double")
    assert ml.metric_r2(df, "y", "p", 0.0).first()[0] == pytest.approx(1 - 4 / 2)
    assert ml.metric_mae(df, "y", "p").first()[0] == pytest.approx(2 / 3)
    assert ml.metric_mse(df, "y", "p").first()[0] == pytest.approx(4 / 3)


def test_splits(frame):
    df = frame([("a", i, i) for i in range(50)], "aqs_code string, epoch long, event_id long")
    parts = ml.split_chronological(df, ["epoch", "event_id"]).filter("part = 'train'")
    assert sorted(r.epoch for r in parts.collect()) == list(range(33))
    assert ml.split_tail_validation(df, ["epoch", "event_id"], 0.5).filter("part = 'validate'").count() == 25
    train, test = ml.split_seeded(df, 0.75, seed=1)
    assert train.count() + test.count() == 50 and train.join(test, "epoch").isEmpty()


def test_hash_split_takes_large_keys(frame):
    df = frame([(2**62 + i,) for i in range(1000)], "id long")
    assert ml.split_random(df, "id", 0.75).filter("part = 'train'").count() == 750


def test_null_steps_can_be_masked_on_save(frame):
    built = rw.sequence_build(windows(frame, [1.0, None, 3.0, None]), ["o3"], 3, 0, with_labels=["o3"])
    masked = sinks.mask_sequences(built, ["o3"], -1.0).orderBy("window_no").collect()
    assert [[s.o3 for s in r.seq] for r in masked] == [[1.0, -1.0, 3.0]] and masked[0].label_o3 == -1.0


def test_sites_are_written_to_their_own_folders(frame, spark, tmp_path):
    df = frame([("48_201_0001", 2001, 1.0), ("48_201_0002", 2002, 2.0), ("48_201_0001", 2003, 3.0)],
               "aqs_code string, data_year int, o3 double")
    sinks.write_by_site(df, str(tmp_path / "out"))
    assert (tmp_path / "out" / "aqs_code=48_201_0001" / "data_year=2003").is_dir()
    rows = src.concat_site_years(spark, str(tmp_path / "out"), ["48_201_0001"], 2000, 2003)
    assert column(rows, "o3", "o3") == [1.0]


def test_cached_table_is_kept_until_reset(frame, spark, tmp_path):
    path = str(tmp_path / "cache")
    make = lambda v: (lambda: frame([(v,)], "v int"))
    assert src.cached_transform(spark, path, make(1)).first().v == 1
    assert src.cached_transform(spark, path, make(2)).first().v == 1
    assert src.cached_transform(spark, path, make(2), reset=True).first().v == 2
