"""The Parquet chunk store: a raster as rows of chunks, and ways in and out of it.

chunk: layer, chunk_row, chunk_col, row0, col0, height, width, values array<float>
(row-major; complex samples interleave re, im; NaN is an invalid sample). Whole-scene
work stays in this form; pixel form is for windows and what comes after sampling.
"""

from __future__ import annotations

import atexit
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radarlake.operators.scan import in_chunks, in_window
from radarlake.plans.geometry import Window, sampled_chunks
from radarlake.session import shared_dir, workers_can_import

SCHEMA = "layer string, chunk_row long, chunk_col long, row0 long, col0 long, height int, width int, values array<float>"


def to_chunks(pixels: DataFrame, layer: str, shape: tuple[int, int], chunk: tuple[int, int], values: tuple[str, ...] = ("value",)) -> DataFrame:
    """Pixels (row, col, values) to chunks; one shuffle, each group a chunk."""
    workers_can_import(pixels.sparkSession)
    rows, cols = shape
    ch, cw = chunk
    keyed = pixels.select(F.expr(f"row div {ch}").cast("long").alias("chunk_row"), F.expr(f"col div {cw}").cast("long").alias("chunk_col"), F.col("row").cast("long"), F.col("col").cast("long"), *(F.col(v).cast("float").alias(v) for v in values))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[0]) * ch, int(key[1]) * cw
        h, w = min(ch, rows - r0), min(cw, cols - c0)
        out = np.full((h, w, len(values)), np.nan, dtype=np.float32)
        at = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        for k, v in enumerate(values):
            out[at[0], at[1], k] = pdf[v].to_numpy(dtype=np.float32, na_value=np.nan)
        return pd.DataFrame({"layer": [layer], "chunk_row": [key[0]], "chunk_col": [key[1]], "row0": [r0], "col0": [c0], "height": [h], "width": [w], "values": [out.ravel()]})

    return keyed.groupBy("chunk_row", "chunk_col").applyInPandas(pack, SCHEMA)


def write(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by layer, sorted by chunk, so that row groups carry narrow chunk ranges."""
    chunks.repartition("layer", "chunk_row").sortWithinPartitions("layer", "chunk_row", "chunk_col").write.mode(mode).partitionBy("layer").parquet(path)


_stored: dict[tuple, str] = {}


def stored(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> str:
    """The path of a chunk table in the shared folder, made by ``make`` where this application has none of that name yet.

    It lasts as long as the application: a source that changes meanwhile needs another name.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _stored:
        path = f"{shared_dir(spark)}/radarlake-chunks/{hashlib.sha256(repr(key).encode()).hexdigest()[:32]}"
        write(make(), path, "overwrite")
        _stored[key] = path
    return _stored[key]


@atexit.register
def _clean() -> None:
    active = SparkSession.getActiveSession()
    for path in _stored.values():
        try:
            at = active.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(active.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: the folder's owner cleans it
            pass


def read(spark: SparkSession, path: str, layer: str, window: Window | None = None, chunk: tuple[int, int] | None = None, stride: tuple[int, int] = (1, 1)) -> DataFrame:
    """Chunks of a layer that hold a sample of the window's lattice: all three predicates reach the scan."""
    df = spark.read.parquet(path).filter(F.col("layer") == layer)
    if window is not None:
        if chunk is None:
            raise ValueError("a window needs the chunk size")
        df = df.filter(in_chunks(window, chunk))
        for k, name in enumerate(("chunk_row", "chunk_col")):
            if stride[k] > chunk[k]:
                start, extent = ((window.row, window.height), (window.col, window.width))[k]
                df = df.filter(F.col(name).isin(sampled_chunks(start, extent, stride[k], chunk[k])))
    return df


def to_pixels(chunks: DataFrame, window: Window | None = None, stride: tuple[int, int] = (1, 1), complex_: bool = False) -> DataFrame:
    """Pixels of chunks, only those of the window's lattice; arrays are cut in Arrow before rows are made."""
    workers_can_import(chunks.sparkSession)
    names = ("re", "im") if complex_ else ("value",)
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r0, c0, h, w = (b.column(c)[k].as_py() for c in ("row0", "col0", "height", "width"))
                field = b.column("values")[k].values.to_numpy(zero_copy_only=False).reshape(h, w, n)
                rows, cols = np.arange(r0, r0 + h), np.arange(c0, c0 + w)
                if window is not None:
                    rows = rows[(rows >= window.row) & (rows < window.row + window.height) & ((rows - window.row) % stride[0] == 0)]
                    cols = cols[(cols >= window.col) & (cols < window.col + window.width) & ((cols - window.col) % stride[1] == 0)]
                part = field[np.ix_(rows - r0, cols - c0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, len(cols))), pa.array(np.tile(cols, len(rows))), *(pa.array(part[..., j].ravel(), pa.float32(), from_pandas=True) for j in range(n))], names=["row", "col", *names])

    got = chunks.select("row0", "col0", "height", "width", "values").mapInArrow(run, "row long, col long, " + ", ".join(f"{x} float" for x in names))
    return got


def visit(chunks: DataFrame, visitor: Callable[[dict], np.ndarray], out: str = "value") -> DataFrame:
    """A block visitor: each row of aligned chunks once, its arrays to one array of the same shape."""
    workers_can_import(chunks.sparkSession)
    arrays = [f.name for f in chunks.schema.fields if f.dataType.simpleString() == "array<float>"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [c for c in b.schema.names if c not in arrays]
            got = []
            for k in range(b.num_rows):
                h, w = b.column("height")[k].as_py(), b.column("width")[k].as_py()
                got.append(np.asarray(visitor({a: b.column(a)[k].values.to_numpy(zero_copy_only=False).reshape(h, w, -1).squeeze(-1) for a in arrays}), dtype=np.float32).ravel())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(got, pa.list_(pa.float32()))], names=[*keep, out])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields if f.name not in arrays)
    return chunks.mapInArrow(run, f"{fields}, {out} array<float>")


def align(layers: dict[str, DataFrame]) -> DataFrame:
    """Chunks of several layers side by side: an equi-join on chunk numbers, one row a chunk."""
    keys = ["chunk_row", "chunk_col"]
    got = None
    for name, df in layers.items():
        part = df.select(*keys, *(() if got is not None else ("row0", "col0", "height", "width")), F.col("values").alias(name))
        got = part if got is None else got.join(part, keys)
    return got


def statistics(chunks: DataFrame) -> DataFrame:
    """Exact counts and extrema of each chunk, without making pixels."""
    ok = F.filter("values", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    return chunks.select("layer", "chunk_row", "chunk_col", F.size(ok).cast("long").alias("finite_count"), (F.size("values") - F.size(ok)).cast("long").alias("invalid_count"), F.array_min(ok).alias("minimum"), F.array_max(ok).alias("maximum"))


def pixel_window(pixels: DataFrame, w: Window) -> DataFrame:
    return pixels.filter(in_window(w))


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of a stored table: its files with sizes and times, and its schema.

    Taken before a plan is made and again before its result is used, it tells a stale
    plan. It reads a listing through Hadoop, no data.
    """
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(at, True)
    rows = []
    while files.hasNext():
        f = files.next()
        rows.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    schema = spark.read.parquet(path).schema.json()
    return hashlib.sha256(repr((sorted(rows), schema)).encode()).hexdigest()


class StalePlan(RuntimeError):
    """A table changed after it was planned for."""


def unchanged(spark: SparkSession, path: str, planned: str) -> None:
    if fingerprint(spark, path) != planned:
        raise StalePlan(f"{path} has changed since the plan was made")
