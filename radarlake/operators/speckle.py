"""Boxcar and Lee speckle filters.

Two plans. The default is a halo-tile kernel: pixels go to each tile whose halo they lie
in (one shuffle), and each tile is filtered at once in NumPy, in float32 and in the
neighbour order that makes results repeatable. The other is pure Catalyst: separable
window sums along rows, then columns; it needs a dense grid and is what the SQL oracles
compare with. Neither ever joins pixels by distance.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from radarlake.functions.transforms import EPS, checked_eps
from radarlake.session import workers_can_import

KINDS, SIZES = ("none", "boxcar", "lee"), (3, 5, 7)
DOMAINS = ("amplitude", "power", "power_db")
#: Domains that only pass through.
PLAIN_DOMAINS = ("signed_value", "phase")
#: Domains a filter applies to, by layer kind and mode; elsewhere it is dropped.
DOMAIN_OF = {
    ("gslc_polarization", "amplitude"): "amplitude", ("gslc_polarization", "power"): "power", ("gslc_polarization", "power_db"): "power_db",
    ("gcov_diagonal_covariance", "linear"): "power", ("gcov_diagonal_covariance", "power_db"): "power_db",
}
TILE = 256
LOG2_10 = math.log2(10)


def check(kind: str, size: int, enl: float, domain: str, eps: float) -> None:
    if kind not in KINDS:
        raise ValueError(f"no filter {kind!r}")
    if domain not in DOMAINS + PLAIN_DOMAINS:
        raise ValueError(f"no domain {domain!r}")
    checked_eps(eps)
    if kind == "none":
        return
    if domain in PLAIN_DOMAINS:
        raise ValueError(f"{domain} can't be filtered")
    if size not in SIZES:
        raise ValueError("the window must be 3, 5 or 7")
    if kind == "lee" and not (math.isfinite(enl) and enl > 0):
        raise ValueError("the number of looks must be finite and positive")


def effective(layer_kind: str, mode: str, kind: str, size: int = 5, enl: float = 1.0) -> tuple:
    """(kind, size, looks, domain) that a request comes to: its identity."""
    domain = DOMAIN_OF.get((layer_kind, mode))
    if kind == "none" or domain is None:
        return ("none", 0, 1.0, domain)
    return (kind, size, 1.0 if kind == "boxcar" else float(enl), domain)


def kernel(field: np.ndarray, kind: str, size: int, enl: float = 1.0, domain: str = "power", eps: float = EPS) -> np.ndarray:
    """Filter a float32 field in which NaN is invalid. The window is clipped at the edges."""
    f32 = np.float32
    v = np.asarray(field, dtype=f32)
    ok = np.isfinite(v)
    if kind == "none":
        return np.where(ok, v, f32(np.nan))
    if domain != "power_db":
        ok &= v >= 0
    r = size // 2
    wide = np.pad(np.where(ok, v, f32(np.nan)), r, constant_values=f32(np.nan))
    views = [wide[i : i + v.shape[0], j : j + v.shape[1]] for i in range(size) for j in range(size)]
    with np.errstate(all="ignore"):
        scale = views[0]
        for x in views[1:]:
            scale = np.fmax(scale, x)

        def normal(x):
            if domain == "power_db":
                return np.exp2((x - scale) * f32(LOG2_10) / f32(10)).astype(f32)
            q = np.where(scale > 0, x / np.where(scale > 0, scale, f32(1)), f32(0)).astype(f32)
            return q * q if domain == "amplitude" else q

        n, mean, m2 = np.zeros(v.shape, f32), np.zeros(v.shape, f32), np.zeros(v.shape, f32)
        for x in views:
            here = np.isfinite(x)
            y = normal(x)
            n1 = n + here.astype(f32)
            delta = y - mean
            step = np.where(here, delta / np.where(n1 > 0, n1, f32(1)), f32(0)).astype(f32)
            mean = mean + step
            # one rounding, as a fused multiply-add has
            m2 = np.where(here, (delta.astype(np.float64) * (y - mean).astype(np.float64) + m2).astype(f32), m2)
            n = n1
        got = mean
        if kind == "lee":
            var = m2 / np.where(n > 0, n, f32(1))
            noise = mean * mean / f32(enl)
            w = np.where((var > noise) & (var > 0), (var - noise) / np.where(var > 0, var, f32(1)), f32(0))
            w = np.clip(w, f32(0), f32(1))
            got = (w.astype(np.float64) * (normal(v) - mean).astype(np.float64) + mean).astype(f32)
        got = np.clip(got, f32(0), f32(1))
        if domain == "amplitude":
            out = scale * np.sqrt(got)
        elif domain == "power":
            out = scale * got
        else:
            floor = f32(10 * math.log10(eps))
            out = np.where(got > 0, np.maximum(scale + f32(10) * np.log10(np.where(got > 0, got, f32(1))), floor), floor)
        out = out.astype(f32)
    return np.where(ok & np.isfinite(out), out, f32(np.nan)).astype(f32)


def filtered(df: DataFrame, kind: str, size: int = 5, enl: float = 1.0, domain: str = "power", eps: float = EPS, value: str = "value", tile: int = TILE, keys: tuple[str, str] = ("row", "col")) -> DataFrame:
    """(row, col, value) after a filter: the halo-tile plan. Missing pixels count as invalid."""
    check(kind, size, enl, domain, eps)
    row, col = keys
    workers_can_import(df.sparkSession)
    src = df.select(F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col"), F.col(value).cast("float").alias("value"))
    if kind == "none":
        return src
    r = size // 2

    def tiles(c: str):
        spots = [F.floor((F.col(c) + d) / F.lit(tile)).cast("long") for d in (-r, r)]
        return F.array_distinct(F.array(*spots))

    dealt = src.withColumn("tr", F.explode(tiles("row"))).withColumn("tc", F.explode(tiles("col"))).filter("tr >= 0 AND tc >= 0")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[0]) * tile, int(key[1]) * tile
        field = np.full((tile + 2 * r, tile + 2 * r), np.nan, dtype=np.float32)
        i, j = pdf["row"].to_numpy() - r0 + r, pdf["col"].to_numpy() - c0 + r
        field[i, j] = pdf["value"].to_numpy(dtype=np.float32, na_value=np.nan)
        got = kernel(field, kind, size, enl, domain, eps)
        own = (i >= r) & (i < tile + r) & (j >= r) & (j < tile + r)
        i, j = i[own], j[own]
        out = pd.DataFrame({"row": i + r0 - r, "col": j + c0 - r, "value": got[i, j]})
        out["value"] = out["value"].astype("float32").where(np.isfinite(out["value"]), None)
        return out

    got = dealt.groupBy("tr", "tc").applyInPandas(run, "row long, col long, value float")
    return got.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def filtered_sql(df: DataFrame, kind: str, size: int = 5, enl: float = 1.0, domain: str = "power", eps: float = EPS, value: str = "value") -> DataFrame:
    """(row, col, value double) by separable window sums, in double precision; df must be a dense grid."""
    check(kind, size, enl, domain, eps)
    if kind == "none":
        return df.select("row", "col", F.col(value).cast("double").alias("value"))
    r, v = size // 2, F.col(value).cast("double")
    power = F.pow(F.lit(10e0), v / 10e0) if domain == "power_db" else v * v if domain == "amplitude" else v
    src = df.select("row", "col", (power if domain == "power_db" else F.when(v >= 0, power)).alias("p"))
    across = Window.partitionBy("row").orderBy("col").rangeBetween(-r, r)
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-r, r)
    one = src.select("row", "col", "p", F.count("p").over(across).alias("n"), F.sum("p").over(across).alias("s"), F.sum(F.col("p") * F.col("p")).over(across).alias("q"))
    two = one.select("row", "col", "p", F.sum("n").over(down).alias("n"), F.sum("s").over(down).alias("s"), F.sum("q").over(down).alias("q"))
    n = F.when(F.col("n") > 0, F.col("n").cast("double"))
    mean = F.col("s") / n
    out = mean
    if kind == "lee":
        var = F.greatest(F.col("q") / n - mean * mean, F.lit(0e0))
        noise = mean * mean / F.lit(float(enl))
        w = F.when((var > noise) & (var > 0), (var - noise) / F.when(var > 0, var)).otherwise(0e0)
        out = mean + w * (F.col("p") - mean)
    out = F.greatest(out, F.lit(0e0))
    back = F.sqrt(out) if domain == "amplitude" else F.lit(10e0) * F.log10(F.greatest(out, F.lit(eps))) if domain == "power_db" else out
    return two.select("row", "col", F.when(F.col("p").isNotNull(), back).alias("value"))
