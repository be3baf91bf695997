"""Product files through stand-ins for the HDF5 library, aligned and page plans, stale plans, the command line."""

import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from radarlake import __main__ as cli
from radarlake.plans import aligned as al
from radarlake.plans import geometry as g
from radarlake.sources import chunks, hdf5

ROOT = "/science/LSAR/GCOV/grids"


class HardLink:
    pass


class SoftLink:
    pass


class Attrs(dict):
    def get_id(self, name):
        v = self[name]
        return type("Id", (), {"dtype": np.dtype("O", metadata={"vlen": str}) if isinstance(v, str) else np.asarray(v).dtype})


class Dataset:
    def __init__(self, value, **more):
        self.value, self.attrs = np.asarray(value), Attrs(more.pop("attrs", {}))
        self.shape, self.dtype, self.chunks, self.name = self.value.shape, self.value.dtype, None, ""
        self.__dict__.update(more)

    def __getitem__(self, k):
        return self.value[k]


class Group(dict):
    """A tree by paths."""

    def __init__(self, name="/"):
        super().__init__()
        self.name, self.links = name, {}

    def put(self, path, item):
        *parents, leaf = path.strip("/").split("/")
        at = self
        for p in parents:
            at = at.setdefault(p, Group(f"{at.name.rstrip('/')}/{p}"))
        item.name = path
        dict.__setitem__(at, leaf, item)

    def __getitem__(self, path):
        at = self
        for p in path.strip("/").split("/"):
            at = dict.__getitem__(at, p)
        return at

    def __contains__(self, path):
        try:
            self[path]
        except (KeyError, TypeError, IndexError):
            return False
        return True

    def get(self, name, getlink=False):
        return self.links.get(name, HardLink())


def product():
    f = Group()
    ident = "/science/LSAR/identification/"
    for k, v in (("productType", b"gcov"), ("granuleId", b"test"), ("productVersion", b"1")):
        f.put(ident + k, Dataset(v))
    a = ROOT + "/frequencyA/"
    f.put(a + "listOfCovarianceTerms", Dataset(np.array([b"HHHH", b"HHVV"])))
    f.put(a + "xCoordinates", Dataset(1000.0 + 2 * np.arange(13)))
    f.put(a + "yCoordinates", Dataset(2000.0 - 3 * np.arange(10)))
    f.put(a + "projection", Dataset(np.uint32(32616)))
    more = {"chunks": (4, 5), "shuffle": True, "compression": "gzip"}
    f.put(a + "HHHH", Dataset(np.zeros((10, 13), np.float32), attrs={"units": np.bytes_(b"1"), "_FillValue": np.float32(np.nan)}, **more))
    f.put(a + "HHVV", Dataset(np.zeros((10, 13), [("r", "<f4"), ("i", "<f4")]), **more))
    f.put(a + "mask", Dataset(np.ones((10, 13), np.uint8), **more))
    return f


def test_inspect(spark):
    from radarlake.sources.catalog import classify

    got = hdf5.inspect(product())
    assert got["identification"]["instrument"] == "LSAR" and got["identification"]["product_type"] == "GCOV"
    fr = got["frequencies"][0]
    assert fr["name"] == "A" and fr["epsg"] == 32616 and (fr["x"]["spacing"], fr["y"]["spacing"], fr["y"]["last"]) == (2.0, -3.0, 1973.0)
    assert [d["path"].rsplit("/")[-1] for d in got["datasets"]] == ["HHHH", "HHVV", "mask"]
    assert got["datasets"][0]["filters"] == ["shuffle", "deflate"] and got["datasets"][1]["dtype"]["description"] == "complex64"
    text = cli.report("x.h5", got, True)
    assert json.loads(text)["datasets"][0]["fill_value"] == "NaN" and "frequency A: 10 x 13" in cli.report("x.h5", got, False)
    fr = spark.createDataFrame([(f["name"], f["group_path"], f["polarizations"], f["covariance_terms"]) for f in got["frequencies"]], "name string, group_path string, polarizations array<string>, covariance_terms array<string>")
    ds = spark.createDataFrame([(d["path"], d["dtype"]["kind"]) for d in got["datasets"]], "path string, kind string").select("path", F.struct("kind").alias("dtype"))
    assert [r["layer_kind"] for r in classify(ds, fr, "GCOV").orderBy("path").collect()] == ["gcov_diagonal_covariance", "gcov_off_diagonal_covariance", "mask"]


def test_hostile_and_broken_files():
    for change in (
        lambda f: f[ROOT + "/frequencyA"].links.update(HHHH=SoftLink()),
        lambda f: setattr(f[ROOT + "/frequencyA/HHHH"], "is_virtual", True),
        lambda f: setattr(f[ROOT + "/frequencyA/mask"], "external", [("x", 0, 1)]),
        lambda f: f[ROOT + "/frequencyA/HHVV"].attrs.update(long_name="varies"),
        lambda f: dict.pop(f[ROOT + "/frequencyA"], "xCoordinates"),
        lambda f: dict.pop(f[ROOT], "frequencyA"),
        lambda f: dict.pop(f["/science/LSAR/identification"], "granuleId"),
        lambda f: f.put("/science/LSAR/identification/productType", Dataset(b"RSLC")),
    ):
        f = product()
        change(f)
        with pytest.raises(ValueError):
            hdf5.inspect(f)
    budget = hdf5.Budget()
    with pytest.raises(OverflowError):
        budget.link("x" * 20_000, "/x")
    with pytest.raises(OverflowError):
        budget.string("x" * (2 << 20))


class Stored:
    """The low-level handle of a dataset: creation properties and stored chunks."""

    def __init__(self, data, chunk):
        self.data, self.chunk, self.direct = data, chunk, 0

    def get_create_plist(self):
        steps = [(2, 0, (self.data.dtype.itemsize,), b"shuffle"), (1, 0, (4,), b"deflate")]
        return type("Plist", (), {"get_nfilters": lambda _: 2, "get_filter": lambda _, k: steps[k]})()

    def read_direct_chunk(self, at):
        import zlib

        self.direct += 1
        full = np.zeros(self.chunk, self.data.dtype)
        part = self.data[at[0] : at[0] + self.chunk[0], at[1] : at[1] + self.chunk[1]]
        full[: part.shape[0], : part.shape[1]] = part
        raw = np.frombuffer(full.tobytes(), np.uint8).reshape(-1, self.data.dtype.itemsize).T.tobytes()
        return 0, zlib.compress(raw, 4)


class Opened(Group):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


@pytest.mark.parametrize("kind", ["<f4", "<c8", "u1"])
def test_reader_prunes_and_decodes(kind, monkeypatch):
    """Windows and chunk filters name the chunks that are read; stored bytes are decoded here, edges cut."""
    from pyspark.sql import datasource as ds

    data = (np.arange(130).reshape(10, 13) % 200).astype(kind)
    made = Dataset(data, chunks=(4, 5), id=Stored(data, (4, 5)), fillvalue=data[0, 0])
    f = Opened()
    f.put(ROOT + "/frequencyA/HHHH", made)
    monkeypatch.setattr(hdf5.ProductReader, "_open", lambda self: f)

    def read(filters=(), **options):
        r = hdf5.ProductReader({"path": "x", "dataset": ROOT + "/frequencyA/HHHH", **options})
        assert list(r.pushFilters(list(filters))) == list(filters)
        return {(b["chunk_row"][0].as_py(), b["chunk_col"][0].as_py()): b for p in r.partitions() for b in r.read(p)}

    every = read()
    assert sorted(every) == [(i, j) for i in range(3) for j in range(3)] and made.id.direct == 9
    for (i, j), b in every.items():
        part = data[i * 4 : i * 4 + 4, j * 5 : j * 5 + 5]
        assert (b["height"][0].as_py(), b["width"][0].as_py()) == part.shape
        got = np.array(b["values"][0].as_py(), np.float32)
        assert (got.view(np.complex64) if kind == "<c8" else got).tolist() == part.ravel().tolist()
    assert sorted(read(window="5,6,2,3")) == [(1, 1)] and sorted(read(window="0,0,1,13")) == [(0, 0), (0, 1), (0, 2)]
    assert sorted(read([ds.GreaterThanOrEqual(("chunk_row",), 1), ds.LessThan(("chunk_col",), 2), ds.EqualTo(("layer",), "x")])) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert sorted(read([ds.In(("chunk_col",), (1,)), ds.GreaterThan(("chunk_row",), 1)])) == [(2, 1)] and not read([ds.EqualTo(("chunk_row",), 9)])
    found = hdf5.pipeline(made)
    assert [x["name"] for x in found] == ["shuffle", "deflate"] and found[1] == {"id": 1, "name": "deflate", "flags": 0, "client_data": [4]}
    assert hdf5.fills(made, "complex" if kind == "<c8" else "float")["creation_fill_c" if kind == "<c8" else "creation_fill"] == ({"re": 0.0, "im": 0.0} if kind == "<c8" else 0.0)


def test_types():
    for t, want in (("<i2", ("int", True)), ("u8", ("uint", True)), ("<f2", ("float", False)), ("<f8", ("float", True)), ("c16", ("complex", True)), ("S4", ("unsupported", False)), ([("Real", "<f8"), ("Imag", "<f8")], ("complex", True)), ([("r", "<f4"), ("i", "<f8")], ("unsupported", False))):
        kind, _, _, readable = hdf5.dtype_info(np.dtype(t))
        assert (kind, readable) == want


def catalog():
    a = ROOT + "/frequencyA/"
    layers = [al.LayerInfo(a + n, "A", "gcov_diagonal_covariance", "float32", 4, (10, 13), "p", (4, 5)) for n in ("HHHH", "HVHV", "VVVV")]
    layers += [al.LayerInfo(a + "HHVV", "A", "gcov_off_diagonal_covariance", "complex64", 8, (10, 13), "p", (4, 5)), al.LayerInfo(a + "mask", "A", "mask", "uint8", 1, (10, 13), "p", (4, 5), "auxiliary")]
    return {x.path: x for x in layers}, {"A": (10, 13)}


def test_aligned_plans():
    cat, grids = catalog()
    paths = list(cat)
    p = al.aligned_plan(cat, grids, [(x, paths[4]) for x in paths[:4]], window=g.Window(3, 4, 6, 9), stride=(2, 3))
    assert p.masks == (paths[4],) and p.mask_of == (0, 0, 0, 0) and p.shape == (3, 3) and p.bytes == 9 * (4 * 3 + 8 + 1) and p.blocks == 3 * 3
    assert al.aligned_plan(cat, grids, [(paths[0], None)]).mask_of == (None,)
    for args, kw, error in (
        ([], {}, ValueError), ([(x, None) for x in paths[:4]] + [(paths[0], None)], {}, ValueError), ([(paths[0], None)] * 2, {}, ValueError), ([("x", None)], {}, ValueError), ([(paths[4], None)], {}, ValueError),
        ([(paths[0], paths[1])], {}, ValueError), ([(paths[0], None)], {"stride": (0, 1)}, ValueError), ([(paths[0], None)], {"window": g.Window(9, 9, 5, 5)}, IndexError),
        ([(paths[0], None)], {"output_bytes": 10}, OverflowError), ([(paths[0], None)], {"scratch_bytes": 10}, OverflowError),
    ):
        with pytest.raises(error):
            al.aligned_plan(cat, grids, args, **kw)
    odd = cat | {paths[1]: replace(cat[paths[1]], grid_mapping="q")}
    with pytest.raises(ValueError):
        al.aligned_plan(odd, grids, [(paths[0], None), (paths[1], None)])
    with pytest.raises(ValueError):
        al.aligned_plan(cat, {"A": (9, 13)}, [(paths[0], None)])


def test_page_plans():
    cat, grids = catalog()
    hh, hv, vv, cross, mask = cat
    allowed = {("pauli", (hh, hv, vv, cross)), ("difference", (hh, vv)), ("ratio", (hh, vv))}
    one = al.PageRequest("compare_difference", (hh, vv), mask, "linear", serial=1)
    assert one == replace(one, serial=9, generation=3) and one != replace(one, stride=(2, 2))
    plan = al.page_plan(replace(one, window=g.Window(0, 0, 10, 13)), cat, grids, allowed)
    assert plan.request.window is None and plan == al.page_plan(one, cat, grids, allowed)
    assert al.page_plan(replace(one, kind="compare_ratio_db", transform="phase"), cat, grids, allowed).request.transform == "linear"
    assert al.page_plan(al.PageRequest("pauli_rgb", (hh, hv, vv, cross), mask), cat, grids, allowed).aligned.masks == (mask,)
    for bad in (replace(one, kind="x"), replace(one, transform="phase"), replace(one, kind="compare_pair"), replace(one, rasters=(vv, hh))):
        with pytest.raises(ValueError):
            al.page_plan(bad, cat, grids, allowed)


def test_draw_geometry():
    m = g.overview_mapping(g.overview_plan((100, 60), 4, stride=(5, 2)))
    uv = g.sample_uv(m, 0.0, 0.0, 100.0, 60.0)
    assert uv.origin == pytest.approx((0.5 / 60, 2.0 / 100)) and uv.extent == pytest.approx((1.0, 1.0))
    assert g.sample_uv(m, 100.0, 0.0, 120.0, 10.0) is None and g.sample_uv(m, 5.0, 0.0, 5.0, 1.0) is None
    origin, dx, dy = g.window_uv(((10.0, 20.0), (10.0, 40.0), (30.0, 20.0)), 10.0, 20.0, 30.0, 40.0)
    assert origin == (0, 0) and dx == (1, 0) and dy == (0, 1)


def test_stale_plans(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 0, 0, 0, 1, 1, [1.0])], chunks.SCHEMA)
    path = str(tmp_path / "s")
    chunks.write(df, path)
    planned = chunks.fingerprint(spark, path)
    chunks.unchanged(spark, path, planned)
    assert "chunks" in cli.chunk_times(path, "a", 1, True).splitlines()[0]
    chunks.write(df, path)
    with pytest.raises(chunks.StalePlan):
        chunks.unchanged(spark, path, planned)
    assert cli.nearest_rank([3.0, 1.0, 2.0, 4.0], 0.5) == 2.0 and cli.nearest_rank([1.0], 0.95) == 1.0
