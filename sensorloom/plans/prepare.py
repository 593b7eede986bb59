"""From readings to saved training data in one run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.scalar import scale_lat, scale_long, scaled, time_parts, wind_vector
from sensorloom.operators.filters import filter_valid_flags
from sensorloom.operators.profile import global_minmax
from sensorloom.operators.rowwindows import sequence_build, tumble_rows
from sensorloom.plans.staging import staged
from sensorloom.schema import BLOCK_ROWS, PREDICTION_ROWS, SEQUENCE_ROWS, SITE
from sensorloom.sources.sinks import mask_sequences, write_sequences


def prepare_sequences(
    readings: DataFrame,
    sites: DataFrame,
    path: str,
    features: Sequence[str],
    labels: Sequence[str],
    enrich: Sequence[str],
    rows: int = BLOCK_ROWS,
    length: int = SEQUENCE_ROWS,
    prediction: int = PREDICTION_ROWS,
    mask: float | None = 0.0,
) -> DataFrame:
    """Clean, window, sequence, enrich, scale, locate and save; returns what was saved in ``path``.

    One row for each sequence: site, window_no (its last), ``seq``, ``label_t``, ``f_m``, ``f_b``, ``f_std``,
    ``lat_scaled`` and ``long_scaled``. Steps are scaled by the bounds of their feature over all windows, to 0 where a
    feature has one value; labels and sequence features by the bounds of the feature they come from. What
    is then null (a window with too many nulls, a range of 0 of a label) becomes ``mask``, or stays null with None. A site that
    ``sites`` does not have gets null coordinates. Rows without a site belong to no sequence.
    """
    clean = time_parts(wind_vector(filter_valid_flags(readings)))
    # Written once: the bounds and the sequences both read it.
    windows = staged(tumble_rows(clean, features, rows, mask=None), "windows")
    built = sequence_build(windows, features, length, prediction, with_labels=labels, enrich=enrich)
    bounds = staged(global_minmax(windows, features), "bounds")
    # One row with two numbers for each feature.
    ready = built.crossJoin(F.broadcast(bounds))
    low, high = (lambda f: F.col(f"{f}_min")), (lambda f: F.col(f"{f}_max"))
    step = lambda s, f: F.when(low(f) == high(f), F.when(s[f].isNotNull(), F.lit(0.0))).otherwise(scaled(s[f], low(f), high(f)))
    out: dict[str, Column] = {"seq": F.transform("seq", lambda s: F.struct(*[step(s, f).alias(f) for f in features]))}
    out |= {f"label_{t}": scaled(f"label_{t}", low(t), high(t)) for t in labels}
    out |= {f"{f}_{part}": scaled(f"{f}_{part}", low(f), high(f)) for f in enrich for part in ("m", "b", "std")}
    ready = ready.withColumns(out).select(SITE, "window_no", *out)
    if mask is not None:
        ready = mask_sequences(ready, features, mask)
    places = sites.select(SITE, scale_lat("latitude").alias("lat_scaled"), scale_long("longitude").alias("long_scaled")).dropDuplicates([SITE])
    write_sequences(ready.join(places, SITE, "left"), path)
    return readings.sparkSession.read.parquet(path)
