"""Optional HDF5 connector: a Python data source over h5py, and chunk decoding without it.

Files are not trusted: soft, external and user-defined links, external storage, virtual
datasets and variable-length attributes are refused, and catalog sizes are bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bounds on what a file may make the catalog hold.
MOST_LINKS, MOST_PATH_BYTES, MOST_STRINGS = 100_000, 32 << 20, 100_000
MOST_METADATA, MOST_STRING, MOST_NAME, MOST_DEPTH = 64 << 20, 1 << 20, 16 << 10, 64
MOST_CHUNK = 16 << 20
#: Filters that may be undone here, in the order they were applied.
DIRECT = ((), ("deflate",), ("shuffle", "deflate"))


def direct(filters: tuple[str, ...], chunk_bytes: int, native: bool = True) -> bool:
    """Whether a stored chunk can be decoded without the library."""
    return native and tuple(filters) in DIRECT[1:] and chunk_bytes <= MOST_CHUNK


def decode_chunk(raw: bytes, filters: tuple[str, ...], dtype: np.dtype, chunk: tuple[int, int], crop: tuple[int, int]) -> np.ndarray:
    """Inflate, undo the byte shuffle, and cut a partial edge chunk."""
    dtype = np.dtype(dtype)
    size = chunk[0] * chunk[1] * dtype.itemsize
    if tuple(filters) not in DIRECT:
        raise ValueError(f"can't decode {filters}")
    if "deflate" in filters:
        inflate = zlib.decompressobj()
        raw = inflate.decompress(raw, size + 1)
    if len(raw) != size:
        raise ValueError("a chunk has a wrong size")
    got = np.frombuffer(raw, dtype=np.uint8)
    if "shuffle" in filters:
        got = got.reshape(dtype.itemsize, -1).T.ravel()
    return np.ascontiguousarray(got).view(dtype).reshape(chunk)[: crop[0], : crop[1]]


class Budget:
    """Counts what a catalog takes and raises beyond its bounds."""

    def __init__(self):
        self.links = self.paths = self.strings = self.metadata = 0

    def link(self, name: str, path: str) -> None:
        self.links += 1
        self.paths += len(path)
        if self.links > MOST_LINKS or self.paths > MOST_PATH_BYTES or len(name) > MOST_NAME:
            raise OverflowError("the file has too many or too long links")

    def string(self, text: str) -> str:
        self.strings += 1
        self.metadata += len(text)
        if self.strings > MOST_STRINGS or self.metadata > MOST_METADATA or len(text) > MOST_STRING:
            raise OverflowError("the file has too much metadata")
        return text


def _varying(dtype: np.dtype) -> bool:
    return bool(dtype.metadata and "vlen" in dtype.metadata)


def checked(dataset: Any) -> Any:
    """A dataset whose samples and attributes lie in the file itself."""
    if getattr(dataset, "external", None) or getattr(dataset, "is_virtual", False):
        raise ValueError(f"{dataset.name}: external or virtual storage is not read")
    for name in dataset.attrs:
        if _varying(dataset.attrs.get_id(name).dtype):
            raise ValueError(f"{dataset.name}: variable-length attributes are not read")
    return dataset


def walk(group: Any, budget: Budget, depth: int = 0) -> Iterator[Any]:
    """Datasets below a group, by path, through hard links only."""
    if depth > MOST_DEPTH:
        raise OverflowError("the file is nested too deep")
    for name in sorted(group):
        path = f"{group.name.rstrip('/')}/{name}"
        budget.link(name, path)
        if type(group.get(name, getlink=True)).__name__ != "HardLink":
            raise ValueError(f"{path}: only hard links are read")
        item = group[name]
        if hasattr(item, "shape"):
            yield checked(item)
        else:
            yield from walk(item, budget, depth + 1)


def dtype_info(dtype: np.dtype) -> tuple[str, str, int, bool]:
    """(kind, description, bytes, readable) of a stored type."""
    kind, size = dtype.kind, dtype.itemsize
    if kind in "iu":
        return ("int" if kind == "i" else "uint"), f"{'u' * (kind == 'u')}int{8 * size}", size, size in (1, 2, 4, 8)
    if kind == "f":
        return "float", f"float{8 * size}", size, size in (4, 8)
    if kind == "c":
        return "complex", f"complex{8 * size}", size, size in (8, 16)
    if dtype.names and len(dtype.names) == 2:
        members = {n.lower(): dtype[n] for n in dtype.names}
        re = next((members[n] for n in ("r", "re", "real") if n in members), None)
        im = next((members[n] for n in ("i", "im", "imag", "imaginary") if n in members), None)
        if re is not None and im is not None and re == im and re.kind == "f" and re.itemsize in (4, 8):
            return "complex", f"complex{16 * re.itemsize}", 2 * re.itemsize, True
    return "unsupported", str(dtype), size, False


#: Numbers of the filters that are undone here.
FILTER_IDS = {"deflate": 1, "shuffle": 2}


def pipeline(d: Any) -> list[dict[str, Any]]:
    """A dataset's filters in the order they were applied: number, name, flags, client data."""
    low = getattr(getattr(d, "id", None), "get_create_plist", None)
    if low is not None:
        made = low()
        out = []
        for k in range(made.get_nfilters()):
            code, flags, values, name = made.get_filter(k)
            known = next((n for n, c in FILTER_IDS.items() if c == code), None)
            out.append({"id": int(code), "name": known or (name.decode() if isinstance(name, bytes) else str(name)), "flags": int(flags), "client_data": [int(v) for v in values]})
        return out
    names = [n for n, on in (("shuffle", getattr(d, "shuffle", False)), (getattr(d, "compression", None) or "", getattr(d, "compression", None))) if on]
    names = ["deflate" if n == "gzip" else n for n in names]
    return [{"id": FILTER_IDS.get(n, 0), "name": n, "flags": 0, "client_data": []} for n in names]


def fills(d: Any, kind: str) -> dict[str, Any]:
    """The creation fill and the fill attribute; of complex layers as (re, im)."""
    out: dict[str, Any] = dict.fromkeys(("creation_fill", "fill_attr", "creation_fill_c", "fill_attr_c"))
    for name, value in (("creation_fill", getattr(d, "fillvalue", None)), ("fill_attr", d.attrs.get("_FillValue"))):
        if value is None or kind == "unsupported":
            continue
        first = np.ravel(value)[0]
        if kind != "complex":
            out[name] = float(first)
        elif first.dtype.names:
            out[f"{name}_c"] = dict(zip(("re", "im"), (float(first[n]) for n in first.dtype.names), strict=True))
        else:
            out[f"{name}_c"] = {"re": float(np.real(first)), "im": float(np.imag(first))}
    return out


def _text(value: Any, budget: Budget) -> str:
    value = value.item() if hasattr(value, "item") else value
    return budget.string(value.decode() if isinstance(value, bytes) else str(value)).rstrip("\0").strip()


def _first(f: Any, *paths: str) -> Any | None:
    return next((f[p] for p in paths if p in f), None)


def _axis(d: Any, spacing: Any | None) -> dict:
    n = d.shape[0] if len(d.shape) == 1 else 0
    if not n:
        raise ValueError(f"{d.name} is no coordinate axis")
    first, last = float(d[0]), float(d[n - 1])
    step = float(spacing[()]) if spacing is not None else float(d[1]) - first if n > 1 else 0.0
    return {"path": d.name, "count": n, "first": first, "last": last, "spacing": step}


def inspect(f: Any) -> dict[str, Any]:
    """identification, frequencies and datasets (rank 2, by path) of an open file: all or an error."""
    from radarlake.sources.catalog import INSTRUMENTS, identification

    budget = Budget()
    groups = [i for i in INSTRUMENTS if f"/science/{i}/identification" in f]
    at = f"/science/{groups[0]}/identification" if groups else ""
    names = ("productType", "granuleId", "productVersion", "productSpecificationVersion")
    ident = identification({n: _text(checked(f[f"{at}/{n}"])[()], budget) for n in names if at and f"{at}/{n}" in f}, groups)
    root = f"/science/{ident['instrument']}/{ident['product_type']}"
    grids = f"{root}/grids"
    if root not in f or grids not in f:
        raise ValueError(f"{grids} is missing")
    frequencies = []
    for name in sorted(f[grids]):
        path = f"{grids}/{name}"
        if not name.startswith("frequency") or name == "frequency" or hasattr(f[path], "shape"):
            continue

        def near(leaf: str, path: str = path) -> Any | None:
            return _first(f, f"{path}/{leaf}", f"{grids}/{leaf}")

        x, y = near("xCoordinates"), near("yCoordinates")
        if x is None or y is None:
            raise ValueError(f"{path} has no coordinate axes")
        projection, epsg = near("projection"), None
        if projection is not None:
            value = projection[()]
            epsg = int(value) if np.ndim(value) == 0 and np.asarray(value).dtype.kind in "iu" else projection.attrs.get("epsg_code")
        lists = {k: [_text(v, budget) for v in f[f"{path}/{n}"][()]] if f"{path}/{n}" in f else [] for k, n in (("polarizations", "listOfPolarizations"), ("covariance_terms", "listOfCovarianceTerms"))}
        frequencies.append({"name": name.removeprefix("frequency"), "group_path": path, **lists, "x": _axis(checked(x), near("xCoordinateSpacing")), "y": _axis(checked(y), near("yCoordinateSpacing")), "epsg": None if epsg is None else int(epsg)})
    if not frequencies:
        raise ValueError(f"{grids} has no frequency")
    datasets = []
    for d in walk(f["/science"], budget):
        if len(d.shape) != 2:
            continue
        kind, description, size, readable = dtype_info(d.dtype)
        steps = pipeline(d)
        datasets.append({
            "path": d.name, "dtype": {"kind": kind, "description": description, "bytes": size, "readable": readable}, "rows": d.shape[0], "cols": d.shape[1],
            "chunk_rows": d.chunks[0] if d.chunks else None, "chunk_cols": d.chunks[1] if d.chunks else None, "layout": "chunked" if d.chunks else "contiguous", "filters": [x["name"] for x in steps], "pipeline": steps,
            **{k: _text(d.attrs.get(k, ""), budget) for k in ("units", "long_name", "description", "grid_mapping")},
            **fills(d, kind),
        })
    return {"identification": ident, "frequencies": frequencies, "datasets": sorted(datasets, key=lambda x: x["path"])}


def open_product(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """(identification, classified datasets, frequencies) of a file, as catalog DataFrames."""
    import h5py

    from radarlake.sources.catalog import classify

    with h5py.File(path, "r") as f:
        found = inspect(f)
    axis = "struct<path: string, count: long, first: double, last: double, spacing: double>"
    dtype = "struct<kind: string, description: string, bytes: int, readable: boolean>"
    fr = spark.createDataFrame(found["frequencies"], f"name string, group_path string, polarizations array<string>, covariance_terms array<string>, x {axis}, y {axis}, epsg int")
    ds = spark.createDataFrame(found["datasets"], f"path string, dtype {dtype}, rows long, cols long, chunk_rows long, chunk_cols long, layout string, filters array<string>, pipeline array<struct<id: int, name: string, flags: int, client_data: array<long>>>, units string, long_name string, description string, grid_mapping string, creation_fill double, fill_attr double, creation_fill_c struct<re: double, im: double>, fill_attr_c struct<re: double, im: double>")
    return found["identification"], classify(ds, fr, found["identification"]["product_type"]).orderBy("path"), fr


class ChunkRange(InputPartition):
    """Rows of a row of chunks, and the columns of chunks wanted of it."""

    def __init__(self, rows: tuple[int, int], chunk_cols: tuple[int, int]):
        super().__init__((*rows, *chunk_cols))


class ProductSource(DataSource):
    """spark.read.format("sar_product").option("dataset", path).load(file): rows of chunks.

    Only chunks that meet the option ``window`` ("row,col,height,width") are read, and
    none that comparisons of chunk_row and chunk_col with numbers rule out (these reach
    the reader where spark.sql.python.filterPushdown.enabled is set).
    """

    @classmethod
    def name(cls) -> str:
        return "sar_product"

    def schema(self) -> str:
        from radarlake.sources.chunks import SCHEMA

        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ProductReader(self.options)


def chunk_bounds(filters: list, n: int, name: str) -> tuple[int, int]:
    """The first chunk number and the one after the last that filters on ``name`` leave of n."""
    lo, hi = 0, n
    for f in filters:
        if getattr(f, "attribute", None) != (name,):
            continue
        v = f.value
        if isinstance(f, EqualTo):
            lo, hi = max(lo, v), min(hi, v + 1)
        elif isinstance(f, In) and len(v):
            lo, hi = max(lo, min(v)), min(hi, max(v) + 1)
        elif isinstance(f, GreaterThan):
            lo = max(lo, v + 1)
        elif isinstance(f, GreaterThanOrEqual):
            lo = max(lo, v)
        elif isinstance(f, LessThan):
            hi = min(hi, v)
        elif isinstance(f, LessThanOrEqual):
            hi = min(hi, v + 1)
    return lo, max(lo, hi)


def chunk_of(d: Any, steps: list[dict], r0: int, c0: int) -> np.ndarray:
    """A chunk's samples: its stored bytes decoded here where that can be done, else read by the library."""
    ch, cw = d.chunks or (min(512, d.shape[0]), min(512, d.shape[1]))
    h, w = min(ch, d.shape[0] - r0), min(cw, d.shape[1] - c0)
    names = tuple(x["name"] for x in steps)
    raw = getattr(getattr(d, "id", None), "read_direct_chunk", None)
    if d.chunks and raw is not None and direct(names, ch * cw * d.dtype.itemsize, d.dtype.isnative):
        skipped, data = raw((r0, c0))
        if not skipped:  # a mask of filters that this chunk was written without
            return decode_chunk(data, names, d.dtype, (ch, cw), (h, w))
    return d[r0 : r0 + h, c0 : c0 + w]


def samples(part: np.ndarray) -> np.ndarray:
    """float32 samples, complex ones interleaved."""
    if part.dtype.names:
        return np.stack([part[n].astype(np.float32) for n in part.dtype.names], axis=-1).ravel()
    if part.dtype.kind == "c":
        return np.ascontiguousarray(part.astype(np.complex64)).view(np.float32).ravel()
    return np.ascontiguousarray(part.astype(np.float32)).ravel()


class ProductReader(DataSourceReader):
    """One partition a row of chunks, each with a handle of its own."""

    def __init__(self, options: dict[str, str]):
        self.path, self.dataset, self.layer = options["path"], options["dataset"], options.get("layer", options["dataset"])
        self.window = tuple(int(x) for x in options["window"].split(",")) if "window" in options else None
        self.filters: list = []

    def pushFilters(self, filters: list) -> Iterator[Any]:
        """Comparisons of chunk numbers are used; Spark checks all filters on the rows again."""
        self.filters = list(filters)
        yield from filters

    def _open(self):
        import h5py

        return h5py.File(self.path, "r")

    def _dataset(self, f: Any) -> Any:
        found = {d.name: d for d in walk(f, Budget())}
        if self.dataset not in found:
            raise ValueError(f"{self.dataset} is not in the file")
        return found[self.dataset]

    def partitions(self) -> list[InputPartition]:
        with self._open() as f:
            d = self._dataset(f)
            ch, cw = d.chunks or (min(512, d.shape[0]), min(512, d.shape[1]))
            (r0, r1), (c0, c1) = (chunk_bounds(self.filters, -(-n // size), name) for n, size, name in ((d.shape[0], ch, "chunk_row"), (d.shape[1], cw, "chunk_col")))
            if self.window is not None:
                row, col, height, width = self.window
                r0, r1 = max(r0, row // ch), min(r1, -(-(row + height) // ch))
                c0, c1 = max(c0, col // cw), min(c1, -(-(col + width) // cw))
            return [ChunkRange((r * ch, min((r + 1) * ch, d.shape[0])), (c0, c1)) for r in range(r0, r1)] if c1 > c0 else []

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        with self._open() as f:
            d = self._dataset(f)
            ch, cw = d.chunks or (min(512, d.shape[0]), min(512, d.shape[1]))
            steps = pipeline(d)
            r0, r1, first, end = partition.value
            for c in range(first, min(end, -(-d.shape[1] // cw))):
                part = chunk_of(d, steps, r0, c * cw)[: r1 - r0]
                values = pa.array(samples(part))
                lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                numbers = [pa.array([x], t) for x, t in ((r0 // ch, pa.int64()), (c, pa.int64()), (r0, pa.int64()), (c * cw, pa.int64()), (part.shape[0], pa.int32()), (part.shape[1], pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array([self.layer]), *numbers, lists], names=["layer", "chunk_row", "chunk_col", "row0", "col0", "height", "width", "values"])
