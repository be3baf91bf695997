"""Window, mosaic and level-of-detail scans, and the aligned join of layers.

Predicates are plain comparisons on stored columns, so they reach the Parquet scan; a
table that also has chunk numbers gets the chunk predicate that Catalyst can't derive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radarlake.functions.validity import mask_ok
from radarlake.plans.geometry import Mosaic, ReadPlan, Window, sampled_chunks


def in_window(w: Window, row: str = "row", col: str = "col") -> Column:
    r, c = F.col(row), F.col(col)
    return (r >= w.row) & (r < w.row + w.height) & (c >= w.col) & (c < w.col + w.width)


def in_chunks(w: Window, chunk: tuple[int, int]) -> Column:
    """Chunk numbers that a window meets."""
    rows, cols = (w.row // chunk[0], (w.row + w.height - 1) // chunk[0]), (w.col // chunk[1], (w.col + w.width - 1) // chunk[1])
    return F.col("chunk_row").between(*rows) & F.col("chunk_col").between(*cols)


def window(df: DataFrame, w: Window, chunk: tuple[int, int] | None = None) -> DataFrame:
    """The samples of an exact window."""
    if chunk and {"chunk_row", "chunk_col"} <= set(df.columns):
        df = df.filter(in_chunks(w, chunk))
    return df.filter(in_window(w))


def planned(df: DataFrame, plan: ReadPlan) -> DataFrame:
    """The chunk-aligned window of a read plan, with what of it was asked for."""
    return window(df, plan.aligned).withColumn("requested", in_window(plan.requested))


def mosaic(df: DataFrame, m: Mosaic, mask: DataFrame | None = None) -> DataFrame:
    """A mosaic of chunks; with a mask, its byte beside each sample (NULL: none)."""
    got = window(df, m.window)
    return got if mask is None else got.join(window(mask, m.window), ["row", "col"], "left")


def lattice(w: Window, stride: tuple[int, int]) -> Column:
    """Source samples at origin + stride * (r, c)."""
    at = in_window(w)
    for name, origin, step in (("row", w.row, stride[0]), ("col", w.col, stride[1])):
        if step > 1:
            at = at & ((F.col(name) - origin) % step == 0)
    return at


def sample(df: DataFrame, w: Window, stride: tuple[int, int], chunk: tuple[int, int] | None = None) -> DataFrame:
    """An exact sparse lattice, re-indexed to (r, c); nothing is interpolated or averaged.

    With chunk numbers in the table, chunks without a sample are never read.
    """
    if chunk and {"chunk_row", "chunk_col"} <= set(df.columns):
        rows, cols = sampled_chunks(w.row, w.height, stride[0], chunk[0]), sampled_chunks(w.col, w.width, stride[1], chunk[1])
        df = df.filter(in_chunks(w, chunk))
        if stride[0] > chunk[0]:
            df = df.filter(F.col("chunk_row").isin(rows))
        if stride[1] > chunk[1]:
            df = df.filter(F.col("chunk_col").isin(cols))
    r = F.expr(f"cast((row - {w.row}) div {stride[0]} as long)").alias("r")
    c = F.expr(f"cast((col - {w.col}) div {stride[1]} as long)").alias("c")
    return df.filter(lattice(w, stride)).select(r, c, *(x for x in df.columns if x not in ("row", "col", "chunk_row", "chunk_col")))


def aligned(layers: list[DataFrame], masks: dict[str, DataFrame] | None = None, where: Column | None = None) -> DataFrame:
    """One row a pixel over 1 to 4 layers on one grid, and each distinct mask once.

    layers: DataFrames (row, col, ...) with names of their own. ``where`` (a window or
    lattice) is applied to every member, below the join.
    """
    if not 1 <= len(layers) <= 4:
        raise ValueError("between one and four layers can be aligned")
    names = [c for df in layers for c in df.columns if c not in ("row", "col")]
    if len(set(names)) != len(names):
        raise ValueError("layers must be unique")
    cut = (lambda df: df) if where is None else (lambda df: df.filter(where))
    got = reduce(lambda a, b: a.join(b, ["row", "col"]), [cut(df) for df in layers])
    for name, mask in (masks or {}).items():
        got = got.join(cut(mask.select("row", "col", F.col("mask").alias(name))), ["row", "col"], "left")
    return got


def with_validity(df: DataFrame, mask: str = "mask") -> DataFrame:
    return df.withColumn("valid", mask_ok(F.col(mask)))
