"""Exact counts and extrema, 256-bin histograms, their percentiles, display windows."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins, and the percentiles that are reported.
BINS = 256
QUANTILES = (("p1", 0.01), ("p2", 0.02), ("p50", 0.50), ("p98", 0.98), ("p99", 0.99))
LEAST_GAMMA = np.float32(1e-4)
PRESETS = {"full": ("minimum", "maximum"), "p1_99": ("p1", "p99"), "p2_98": ("p2", "p98")}


def counts(df: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """finite_count, invalid_count, minimum, maximum: one partial and one final aggregate."""
    v = F.col(value)
    return df.groupBy(*(by or [])).agg(F.count(v).alias("finite_count"), F.count_if(v.isNull()).alias("invalid_count"), F.min(v).alias("minimum"), F.max(v).alias("maximum"))


def bin_of(value: Column, low: Column, high: Column) -> Column:
    """The bin of a value; a constant field is all in the middle bin."""
    wide = high.cast("double") - low.cast("double")
    at = (value.cast("double") - low.cast("double")) * F.lit(float(BINS)) / F.when(wide > 0, wide)
    return F.when(wide > 0, F.greatest(F.least(F.floor(at).cast("int"), F.lit(BINS - 1)), F.lit(0))).otherwise(F.lit(BINS // 2))


def histogram(df: DataFrame, value: str = "value") -> DataFrame:
    """(bin, count) of the bins that hold something; the extrema come by a one-row broadcast."""
    # the test is always true; it keeps the counts in this plan, so that its exchange is the one of ``counts``
    ends = counts(df, value).filter("finite_count >= 0 AND invalid_count >= 0").select("minimum", "maximum")
    got = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))
    return got.groupBy(bin_of(F.col(value), F.col("minimum"), F.col("maximum")).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def summary(df: DataFrame, value: str = "value", generation: int | None = None) -> DataFrame:
    """One row: the exact figures, the 256 bins as an array, and the percentiles.

    With a generation, that of the request it answers is in the row, so that a late
    result is told from the one asked for last.

    The bins are placed once the extrema are known; only bins (256 rows at most) meet in
    one task.
    """
    exact = counts(df, value)
    bins = histogram(df, value).agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long")))
    got = exact.crossJoin(F.broadcast(bins)).select("finite_count", "invalid_count", "minimum", "maximum", full.alias("bins"))
    got = got.select("*", *(quantile(F.col("bins"), F.col("minimum"), F.col("maximum"), q).alias(name) for name, q in QUANTILES))
    return got if generation is None else got.withColumn("generation", F.lit(generation).cast("long"))


def quantile(bins: Column, low: Column, high: Column, q: float) -> Column:
    """The value at rank q (N - 1), from the bin that holds it; a 256-bin estimate, clamped to the extrema."""
    total = F.aggregate(bins, F.lit(0).cast("long"), lambda a, x: a + x)
    target = F.lit(float(q)) * (total - 1).cast("double")
    start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(-1).alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("k"))

    def step(s, x):
        hit = (s["at"] < 0) & (x > 0) & (target < (s["before"] + x).cast("double"))
        done = s["at"] >= 0
        return F.struct(F.when(done | hit, s["before"]).otherwise(s["before"] + x).alias("before"), F.when(hit, s["k"]).otherwise(s["at"]).alias("at"), F.when(hit, x).otherwise(s["n"]).alias("n"), (s["k"] + 1).alias("k"))

    def close(s):
        within = F.greatest(F.least((target - s["before"].cast("double") + 0.5) / F.when(s["n"] > 0, s["n"].cast("double")), F.lit(1e0)), F.lit(0e0))
        share = (s["at"].cast("double") + F.coalesce(within, F.lit(0.5))) / F.lit(float(BINS))
        value = (low.cast("double") + share * (high.cast("double") - low.cast("double"))).cast("float")
        return F.greatest(F.least(value, high), low)

    found = F.aggregate(bins, start, step, close)
    return F.when(total > 0, F.when(low == high, low).otherwise(found))


def log_histogram(df: DataFrame, value: str = "value") -> DataFrame:
    """Bins for a plot: edges and log1p of the count."""
    ends = counts(df, value).select("minimum", "maximum")
    step = (F.col("maximum").cast("double") - F.col("minimum").cast("double")) / BINS
    got = histogram(df, value).crossJoin(F.broadcast(ends))
    low = F.col("minimum").cast("double") + F.col("bin") * step
    return got.select("bin", "count", F.log1p(F.col("count").cast("double")).alias("log_count"), low.alias("low"), (low + step).alias("high"))


class DisplayWindow(NamedTuple):
    low: np.float32
    high: np.float32


def display_window(first: float | None, second: float | None) -> DisplayWindow | None:
    """A window from two values, widened if they are one."""
    if first is None or second is None or not (math.isfinite(first) and math.isfinite(second)):
        return None
    low, high = sorted((np.float32(first), np.float32(second)))
    if low < high:
        return DisplayWindow(low, high)
    most, middle = float(np.finfo(np.float32).max), float(low)
    delta = max(abs(middle) * 1e-6, 1e-6)
    wide = DisplayWindow(np.float32(max(-most, middle - delta)), np.float32(min(most, middle + delta)))
    if wide.low < wide.high:
        return wide
    below, above = np.nextafter(low, np.float32(-np.inf)), np.nextafter(high, np.float32(np.inf))
    return DisplayWindow(below, high) if np.isfinite(below) else DisplayWindow(low, above) if np.isfinite(above) else None


def auto_window(row, preset: str = "p2_98") -> DisplayWindow | None:
    """From a row of ``summary``."""
    if preset not in PRESETS:
        raise ValueError(f"no preset {preset!r}")
    return display_window(*(row[k] for k in PRESETS[preset])) if row["finite_count"] else None


def auto_window_columns(df: DataFrame) -> DataFrame:
    """The three presets of a summary as columns (all expressions, one row)."""
    out = []
    for name, (a, b) in PRESETS.items():
        low, high = F.least(a, b), F.greatest(a, b)
        delta = F.greatest(F.abs(low.cast("double")) * 1e-6, F.lit(1e-6))
        same = low == high
        out += [F.when(same, (low.cast("double") - delta).cast("float")).otherwise(low).alias(f"{name}_low"), F.when(same, (high.cast("double") + delta).cast("float")).otherwise(high).alias(f"{name}_high")]
    return df.select(*out)


def set_low(w: DisplayWindow, value: float) -> DisplayWindow | None:
    """A manual low end; one that crosses the high end pushes it one step on. None: refused."""
    v = np.float32(value)
    if not (np.isfinite(v) and np.isfinite(w.high)):
        return None
    high = w.high if v < w.high else np.nextafter(v, np.float32(np.inf))
    return DisplayWindow(v, high) if np.isfinite(high) else None


def set_high(w: DisplayWindow, value: float) -> DisplayWindow | None:
    v = np.float32(value)
    if not (np.isfinite(v) and np.isfinite(w.low)):
        return None
    low = w.low if w.low < v else np.nextafter(v, np.float32(-np.inf))
    return DisplayWindow(low, v) if np.isfinite(low) else None


def set_gamma(value: float) -> np.float32 | None:
    v = np.float32(value)
    return v if np.isfinite(v) and v >= LEAST_GAMMA else None


def control_step(w: DisplayWindow) -> np.float32:
    """A power of ten near a hundredth of the range, never under one float32 step."""
    low, high, tiny, most = float(w.low), float(w.high), float(np.finfo(np.float32).tiny), float(np.finfo(np.float32).max)
    span = high - low
    if not math.isfinite(span) or span <= 0:
        span = max(abs(low), abs(high), 1.0)
    step = 10.0 ** math.floor(math.log10(span / 100))
    far = w.low if abs(low) >= abs(high) else w.high
    step = max(step, abs(float(np.nextafter(far, np.float32(np.inf if far < np.finfo(np.float32).max else -np.inf))) - float(far)))
    return np.float32(min(max(step, tiny), most))


def scope_label(whole: bool, native: bool, window: tuple[int, int, int, int], stride: tuple[int, int]) -> str:
    if whole:
        return f"whole scene, {'native' if native else 'sparse sample'}, stride {stride[0]} x {stride[1]}"
    r, c, h, w = window
    return f"regional {'native' if native else 'sampled'} page: {r},{c}  {h} x {w}  stride {stride[0]} x {stride[1]}"
