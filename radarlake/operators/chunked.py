"""Whole-scene operators in chunk form: arrays stay arrays, pixels are never rows.

A scene of 10^9 samples is some thousands of chunk rows here. Transforms keep their
partitions; a filter shuffles each chunk once with strips as wide as its halo; a
distribution sends 256 counts a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radarlake.functions.transforms import EPS, checked_eps
from radarlake.operators import distribution
from radarlake.operators import speckle as sp
from radarlake.session import workers_can_import

KEYS = ["layer", "chunk_row", "chunk_col", "row0", "col0", "height", "width"]
SCHEMA = "layer string, chunk_row long, chunk_col long, row0 long, col0 long, height int, width int, values array<float>"
COMPLEX = ("amplitude", "power", "power_db", "phase", "real", "imaginary")
REAL = ("linear", "power_db")


def transform_array(values: np.ndarray, mode: str, complex_: bool, mask: np.ndarray | None = None, eps: float = EPS) -> np.ndarray:
    """A transform of float32 samples (complex ones interleaved); NaN where not valid."""
    if mode not in (COMPLEX if complex_ else REAL):
        raise ValueError(f"no mode {mode!r}")
    checked_eps(eps)
    with np.errstate(all="ignore"):
        if complex_:
            re, im = values[0::2].astype(np.float64), values[1::2].astype(np.float64)
            ok = np.isfinite(re) & np.isfinite(im)
            p = re * re + im * im
            out = {"amplitude": lambda: np.hypot(re, im), "power": lambda: p, "power_db": lambda: 10 * np.log10(np.maximum(p, eps)), "phase": lambda: np.arctan2(im, re), "real": lambda: re, "imaginary": lambda: im}[mode]()
        else:
            v = values.astype(np.float64)
            ok = np.isfinite(v) & (v >= 0)
            out = v if mode == "linear" else 10 * np.log10(np.maximum(v, eps))
        if mask is not None:
            ok &= np.isfinite(mask) & (mask != 0) & (mask != 255)
        out = out.astype(np.float32)
        return np.where(ok & np.isfinite(out), out, np.float32(np.nan))


def _array(col: pa.Array, k: int) -> np.ndarray:
    return col[k].values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)


def transform(chunks: DataFrame, mode: str, complex_: bool = False, mask: DataFrame | None = None, eps: float = EPS) -> DataFrame:
    """Chunks of a transformed layer; the mask's chunks are met by an equi-join on chunk numbers."""
    workers_can_import(chunks.sparkSession)
    src, masked = chunks.select(*KEYS, "values"), mask is not None
    if masked:
        src = src.join(mask.select("chunk_row", "chunk_col", F.col("values").alias("mask")), ["chunk_row", "chunk_col"], "left").select(*KEYS, "values", "mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                m = _array(b.column("mask"), k) if masked and b.column("mask")[k].is_valid else None
                got = transform_array(_array(b.column("values"), k), mode, complex_, m, eps)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(k, 1) for c in KEYS), pa.array([got], pa.list_(pa.float32()))], names=[*KEYS, "values"])

    return src.mapInArrow(run, SCHEMA)


def speckle(chunks: DataFrame, shape: tuple[int, int], chunk: tuple[int, int], kind: str, size: int = 5, enl: float = 1.0, domain: str = "power", eps: float = EPS) -> DataFrame:
    """Filtered chunks. Each chunk goes whole to itself and as strips to its eight neighbours."""
    sp.check(kind, size, enl, domain, eps)
    if kind == "none":
        return chunks.select(*KEYS, "values")
    workers_can_import(chunks.sparkSession)
    r, (ch, cw) = size // 2, chunk
    rows, cols = shape
    if min(chunk) < r:
        raise ValueError("chunks are smaller than the window")
    last = ((rows - 1) // ch, (cols - 1) // cw)
    piece = ["layer", "tr", "tc", "row0", "col0", "height", "width", "values"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float32())]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                layer, i, j, r0, c0, h, w = (b.column(c)[k].as_py() for c in KEYS)
                field = _array(b.column("values"), k).reshape(h, w)
                out = []
                for ti in range(max(i - 1, 0), min(i + 1, last[0]) + 1):
                    for tj in range(max(j - 1, 0), min(j + 1, last[1]) + 1):
                        top, left = max(ti * ch - r - r0, 0), max(tj * cw - r - c0, 0)
                        part = field[top : (ti + 1) * ch + r - r0, left : (tj + 1) * cw + r - c0]
                        if part.size:
                            out.append((layer, ti, tj, r0 + top, c0 + left, *part.shape, np.ascontiguousarray(part).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], t) for n, t in enumerate(kinds)], names=piece)

    def join(t: pa.Table) -> pa.Table:
        layer, ti, tj = (t.column(c)[0].as_py() for c in ("layer", "tr", "tc"))
        r0, c0 = ti * ch, tj * cw
        h, w = min(ch, rows - r0), min(cw, cols - c0)
        field = np.full((h + 2 * r, w + 2 * r), np.nan, dtype=np.float32)
        for k in range(t.num_rows):
            y, x, n, m = (t.column(c)[k].as_py() for c in ("row0", "col0", "height", "width"))
            field[y - r0 + r : y - r0 + r + n, x - c0 + r : x - c0 + r + m] = t.column("values")[k].values.to_numpy(zero_copy_only=False).reshape(n, m)
        got = sp.kernel(field, kind, size, enl, domain, eps)[r : r + h, r : r + w]
        own = (layer, ti, tj, r0, c0, h, w, np.ascontiguousarray(got).ravel())
        return pa.table([pa.array([v], k) for v, k in zip(own, kinds, strict=True)], names=[*KEYS, "values"])

    dealt = chunks.select(*KEYS, "values").mapInArrow(deal, "layer string, tr long, tc long, row0 long, col0 long, height int, width int, values array<float>")
    return dealt.groupBy("layer", "tr", "tc").applyInArrow(join, SCHEMA)


def summary(chunks: DataFrame) -> DataFrame:
    """The distribution of a layer's chunks: extrema first, then 256 counts a task, then one row."""
    workers_can_import(chunks.sparkSession)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = bad = 0
        low, high = np.float32(np.inf), np.float32(-np.inf)
        for b in batches:
            v = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
            ok = np.isfinite(v)
            n, bad = n + int(ok.sum()), bad + int((~ok).sum())
            if ok.any():
                low, high = min(low, v[ok].min()), max(high, v[ok].max())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([bad]), pa.array([low if n else None], pa.float32()), pa.array([high if n else None], pa.float32())], names=["n", "bad", "low", "high"])

    exact = chunks.select("values").mapInArrow(ends, "n long, bad long, low float, high float")
    exact = exact.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("finite_count"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid_count"), F.min("low").alias("minimum"), F.max("high").alias("maximum"))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(distribution.BINS, dtype=np.int64)
        for b in batches:
            if not b.num_rows or not b.column(1)[0].is_valid:
                continue
            low, high = float(b.column(1)[0].as_py()), float(b.column(2)[0].as_py())
            v = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            v = v[np.isfinite(v)]
            at = np.full(len(v), distribution.BINS // 2) if low == high else np.clip(np.floor((v - low) * distribution.BINS / (high - low)), 0, distribution.BINS - 1).astype(np.int64)
            total += np.bincount(at, minlength=distribution.BINS)
        yield pa.RecordBatch.from_arrays([pa.array(range(distribution.BINS), pa.int32()), pa.array(total)], names=["bin", "n"])

    counted = chunks.select("values").crossJoin(F.broadcast(exact.select("minimum", "maximum"))).mapInArrow(bins, "bin int, n long")  # one row
    full = counted.groupBy("bin").agg(F.sum("n").alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias("bins"))
    got = exact.crossJoin(F.broadcast(full))
    return got.select("finite_count", "invalid_count", "minimum", "maximum", "bins", *(distribution.quantile(F.col("bins"), F.col("minimum"), F.col("maximum"), q).alias(name) for name, q in distribution.QUANTILES))
