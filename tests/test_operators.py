"""Filters, distributions, display operators and the chunk store on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from radarlake.operators import chunked, display, scan, speckle
from radarlake.operators import distribution as dist
from radarlake.plans.geometry import Window
from radarlake.sources import chunks
from radarlake.sources.hdf5 import decode_chunk, direct

NAN = float("nan")


def impulse():
    f = np.ones((3, 3), dtype=np.float32)
    f[1, 1] = 9
    return f


def test_boxcar_and_lee_goldens():
    assert speckle.kernel(impulse(), "boxcar", 3)[1, 1] == pytest.approx(17 / 9)
    assert np.allclose(speckle.kernel(np.full((3, 3), 7, np.float32), "lee", 3, 2.0), 7)
    masked = impulse()
    masked[1, 1] = NAN
    assert np.isnan(speckle.kernel(masked, "boxcar", 3)[1, 1]) and speckle.kernel(masked, "boxcar", 3)[0, 0] == 1
    assert (speckle.kernel(np.zeros((3, 3), np.float32), "lee", 3) == 0).all()
    negative = impulse()
    negative[0, 0] = -1
    assert np.isnan(speckle.kernel(negative, "boxcar", 3)[0, 0]) and speckle.kernel(negative, "none", 3)[0, 0] == -1


def brute(field, kind, size, enl):
    r, (h, w) = size // 2, field.shape
    out = np.full(field.shape, np.nan)
    for i in range(h):
        for j in range(w):
            if not np.isfinite(field[i, j]) or field[i, j] < 0:
                continue
            near = field[max(i - r, 0) : i + r + 1, max(j - r, 0) : j + r + 1].astype(np.float64)
            near = near[np.isfinite(near) & (near >= 0)]
            mean, var = near.mean(), near.var()
            weight = 0.0
            if kind == "lee" and var > mean * mean / enl and var > 0:
                weight = min(max((var - mean * mean / enl) / var, 0), 1)
            out[i, j] = mean + weight * (field[i, j] - mean) if kind == "lee" else mean
    return out


@pytest.mark.parametrize("size", speckle.SIZES)
@pytest.mark.parametrize("kind", ["boxcar", "lee"])
def test_kernel_equals_brute_force(kind, size):
    rng = np.random.default_rng(size)
    f = rng.gamma(2.0, 1.5, (23, 31)).astype(np.float32)
    f[rng.random(f.shape) < 0.05] = np.nan
    want = brute(f, kind, size, 3.0)
    got = speckle.kernel(f, kind, size, 3.0)
    assert np.allclose(got, want, rtol=2e-5, equal_nan=True)
    amp = speckle.kernel(np.sqrt(f), kind, size, 3.0, "amplitude")
    assert np.allclose(amp, np.sqrt(np.maximum(want, 0)), rtol=1e-4, equal_nan=True)
    db = speckle.kernel((10 * np.log10(f)).astype(np.float32), kind, size, 3.0, "power_db")
    assert np.allclose(db, 10 * np.log10(np.maximum(want, 1e-20)), atol=1e-3, equal_nan=True)


def test_near_constant_field_keeps_its_variance():
    f = np.full((9, 9), 1000, np.float32)
    f[4, 4] = 1000.5
    assert np.allclose(speckle.kernel(f, "lee", 3, 4.0), brute(f, "lee", 3, 4.0), rtol=1e-5)


def pixels(spark, f, name="value"):
    rows = [(i, j, None if np.isnan(f[i, j]) else float(f[i, j])) for i in range(f.shape[0]) for j in range(f.shape[1])]
    return spark.createDataFrame(rows, f"row long, col long, {name} float")


def grid(df, shape, name="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[name] is None else r[name]
    return out


def test_tiles_equal_the_whole_field_and_the_sql_plan(spark):
    rng = np.random.default_rng(5)
    f = rng.gamma(2.0, 1.0, (37, 45)).astype(np.float32)
    f[rng.random(f.shape) < 0.04] = np.nan
    df = pixels(spark, f)
    for size in (3, 7):
        want = speckle.kernel(f, "lee", size, 3.0)
        assert np.array_equal(grid(speckle.filtered(df, "lee", size, 3.0, tile=16), f.shape).astype(np.float32), want, equal_nan=True)
        assert np.allclose(grid(speckle.filtered_sql(df, "lee", size, 3.0), f.shape), want, rtol=1e-4, equal_nan=True)


def test_filter_options():
    for bad in ({"kind": "median"}, {"size": 4}, {"enl": 0.0}, {"enl": NAN}, {"eps": 0.0}, {"domain": "phase"}, {"domain": "x"}):
        with pytest.raises(ValueError):
            speckle.check(**({"kind": "lee", "size": 5, "enl": 1.0, "domain": "power", "eps": 1e-20} | bad))
    speckle.check("boxcar", 3, NAN, "power", 1e-20)
    speckle.check("none", 4, 0.0, "phase", 1e-20)
    assert speckle.effective("gcov_off_diagonal_covariance", "amplitude", "lee", 5, 3)[0] == "none"
    assert speckle.effective("gslc_polarization", "power", "boxcar", 5, 3) == ("boxcar", 5, 1.0, "power")


def one(spark, values, **more):
    return dist.summary(spark.createDataFrame([(None if v is None else float(v),) for v in values], "value float")).first().asDict() | more


def test_distribution_goldens(spark):
    got = one(spark, [0, 10, 20, None, -200])
    assert (got["finite_count"], got["invalid_count"], got["minimum"], got["maximum"]) == (4, 1, -200, 20)
    flat = one(spark, [42] * 20)
    assert flat["bins"][128] == 20 and flat["p1"] == flat["p99"] == 42
    assert dist.auto_window(flat).low < 42 < dist.auto_window(flat).high
    none = one(spark, [None] * 12)
    assert none["finite_count"] == 0 and none["invalid_count"] == 12 and none["minimum"] is None and none["p50"] is None and dist.auto_window(none) is None
    ramp = one(spark, range(257))
    assert ramp["bins"] == [1] * 255 + [2]
    assert ramp["p50"] == pytest.approx(128.5, abs=1)
    assert dist.auto_window(ramp, "full") == (0, 256)


def test_display_window_edits():
    w = dist.DisplayWindow(np.float32(0), np.float32(1))
    assert dist.set_low(w, 0.5) == (0.5, 1) and dist.set_high(w, 2) == (0, 2)
    assert dist.set_low(w, 1.0) == (1.0, np.nextafter(np.float32(1), np.float32(2)))
    assert dist.set_high(w, -1.0).low < -1 and dist.set_low(w, NAN) is None
    assert dist.set_low(w, np.finfo(np.float32).max) is None
    assert dist.set_gamma(1e-5) is None and dist.set_gamma(2.2) == np.float32(2.2)
    assert dist.control_step(dist.DisplayWindow(np.float32(0), np.float32(100))) == 1
    assert dist.display_window(0.0, 0.0) == (np.float32(-1e-6), np.float32(1e-6))
    big = np.finfo(np.float32).max
    assert dist.display_window(float(big), float(big)).low < big
    assert "whole scene" in dist.scope_label(True, False, (0, 0, 1, 1), (5, 5)) and "regional native" in dist.scope_label(False, True, (1, 2, 3, 4), (1, 1))


def test_palettes(spark):
    first = {display.GRAYSCALE: (0, 0, 0), display.TURBO: (35, 23, 27), display.CYCLIC: (255, 64, 64), display.CUBEHELIX: (0, 0, 0), display.BALANCE: (23, 28, 66), display.CIVIDIS: (0, 32, 81), display.RD_BU: (5, 48, 97), display.PU_OR: (45, 0, 75)}
    last = {display.GRAYSCALE: (255, 255, 255), display.TURBO: (144, 12, 0), display.CYCLIC: (255, 64, 64), display.CUBEHELIX: (255, 255, 255), display.BALANCE: (60, 9, 17), display.CIVIDIS: (253, 234, 69), display.RD_BU: (103, 0, 31), display.PU_OR: (127, 59, 8)}
    for p in first:
        row = display.palette_row(p)
        assert len(row) == 256 and row[0] == first[p] and row[255] == last[p]
    assert all(c == (k, k, k) for k, c in enumerate(display.palette_row(0)))
    with pytest.raises(ValueError):
        display.palette_row(7)
    given = spark.createDataFrame([(7, 0, 1, 2, 3), (0, 0, 9, 9, 9)], "palette int, idx int, red int, green int, blue int")
    got = display.palettes(spark, given)
    assert got.count() == len(display.KNOWN) * 256 + 1 and got.filter("palette = 0 AND idx = 0").first()["red"] == 0
    df = spark.createDataFrame([(0.0,), (1.0,), (None,)], "n double")
    rows = display.colorize(df, "n", 0, got).collect()
    assert sorted((r["red"] for r in rows if r["red"] is not None)) == [0, 255]
    # approximations of the four perceptual palettes end within a few levels of their published ends
    ends = {display.VIRIDIS: ((68, 1, 84), (253, 231, 37)), display.INFERNO: ((0, 0, 4), (252, 255, 164)), display.MAGMA: ((0, 0, 4), (252, 253, 191)), display.PLASMA: ((13, 8, 135), (240, 249, 33))}
    for p, (a, b) in ends.items():
        row = display.palette_row(p)
        assert max(abs(x - y) for u, v in ((row[0], a), (row[255], b)) for x, y in zip(u, v, strict=True)) <= 8
    # every preset has colours, and a palette without any is an error, not NULL
    for mode in ("power_db", "phase", "real", "imaginary", "amplitude"):
        got = display.colorize(df.filter("n IS NOT NULL"), "n", display.preset(mode)[2], display.palettes(spark))
        assert got.filter("red IS NULL").count() == 0
    with pytest.raises(ValueError):
        display.colorize(df, "n", 7, display.palettes(spark))


def test_sampling(spark):
    page = pixels(spark, np.array([[0, 1], [2, np.nan]], dtype=np.float32))
    pts = spark.createDataFrame([(0, 0.5, 0.5), (1, 0.5, 1.0), (2, 1.5, 1.5), (3, 1.0, 1.0), (4, 5.0, 0.0), (5, 0.9, 0.9), (6, 2.0, 0.0)], "id int, y double, x double")
    got = dict(display.sample_points(pts, page, 2, 2).collect())
    assert got[0] == 0 and got[1] == 0.5 and got[2] is None and got[3] is None and got[4] is None
    assert got[5] == pytest.approx((0.24 * 1 + 0.24 * 2) / 0.84) and got[6] == 2
    near = dict(display.sample_points(pts, page, 2, 2, "nearest").collect())
    assert near[0] == 0 and near[1] == 1 and near[2] is None and near[6] == 2
    seam = pixels(spark, np.array([[math.pi - 0.1, -math.pi + 0.1], [0, math.pi]], dtype=np.float32))
    pts = spark.createDataFrame([(0, 0.5, 1.0), (1, 1.5, 1.0)], "id int, y double, x double")
    got = dict(display.sample_points(pts, seam, 2, 2, "phase").collect())
    assert abs(got[0]) == pytest.approx(math.pi, abs=1e-3) and got[1] == pytest.approx(math.pi, abs=1e-3)


def test_crossfade_and_swipe(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "row long, col long, value float")
    b = spark.createDataFrame([(0, 0, 3.0), (0, 1, 5.0), (1, 0, None)], "row long, col long, value float")
    got = {(r["row"], r["col"]): r["value"] for r in display.crossfade(a, b, (1.0, 1.0)).collect()}
    assert got == {(0, 0): 2.0, (0, 1): 5.0}
    assert display.crossfade(a, b, (0.0, 0.0)).filter("row = 0 AND col = 0").first()["value"] == 2.0
    assert display.preset("phase")[2:] == (display.CYCLIC, True) and display.preset("power_db")[:2] == (-35.0, 5.0)
    assert display.normalize(F.lit(1.0), 2.0, 2.0) is not None


def test_chunk_store(spark, tmp_path):
    f = np.arange(10 * 13, dtype=np.float32).reshape(10, 13) + 0.25
    f[5, 7] = np.nan
    stored = chunks.to_chunks(pixels(spark, f).filter("NOT (row = 2 AND col = 2)"), "HHHH", f.shape, (4, 5))
    chunks.write(stored, str(tmp_path / "c"))
    whole = chunks.read(spark, str(tmp_path / "c"), "HHHH")
    assert whole.count() == 9
    f[2, 2] = np.nan
    assert np.array_equal(grid(chunks.to_pixels(whole), f.shape).astype(np.float32), f, equal_nan=True)
    w = Window(3, 2, 6, 9)
    part = chunks.to_pixels(chunks.read(spark, str(tmp_path / "c"), "HHHH", w, (4, 5), (6, 7)), w, (6, 7))
    assert sorted((r["row"], r["col"], r["value"]) for r in part.collect()) == [(3, 2, f[3, 2]), (3, 9, f[3, 9])]
    plan = chunks.read(spark, str(tmp_path / "c"), "HHHH", w, (4, 5))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan and "GreaterThanOrEqual(chunk_row,0)" in plan
    stats = {(r["chunk_row"], r["chunk_col"]): r for r in chunks.statistics(whole).collect()}
    assert stats[1, 1]["invalid_count"] == 1 and stats[0, 0]["minimum"] == 0.25
    twice = chunks.visit(chunks.align({"a": whole, "b": whole}), lambda x: x["a"] + x["b"])
    assert twice.count() == 9 and twice.filter("chunk_row = 0 AND chunk_col = 0").first()["value"][1] == 2.5


def test_lattice_prunes_chunks(spark):
    df = pixels(spark, np.zeros((40, 40), np.float32)).withColumn("chunk_row", F.expr("row div 4")).withColumn("chunk_col", F.expr("col div 4"))
    got = scan.sample(df, Window(1, 1, 30, 30), (10, 3), (4, 4))
    assert got.count() == 3 * 10 and set(got.columns) == {"r", "c", "value"}
    with pytest.raises(ValueError):
        scan.aligned([])
    with pytest.raises(ValueError):
        scan.aligned([df.select("row", "col", "value")] * 2)


def test_chunk_decoding():
    import zlib

    data = np.arange(20, dtype="<f4").reshape(4, 5)
    shuffled = np.frombuffer(data.tobytes(), np.uint8).reshape(-1, 4).T.tobytes()
    assert np.array_equal(decode_chunk(zlib.compress(shuffled), ("shuffle", "deflate"), "<f4", (4, 5), (3, 2)), data[:3, :2])
    assert np.array_equal(decode_chunk(zlib.compress(data.tobytes()), ("deflate",), "<f4", (4, 5), (4, 5)), data)
    assert direct(("deflate",), 100) and not direct((), 100) and not direct(("deflate",), 1 << 25) and not direct(("shuffle",), 1)
    with pytest.raises(ValueError):
        decode_chunk(zlib.compress(b"x"), ("deflate",), "<f4", (4, 5), (4, 5))


def test_chunk_form_equals_pixel_form(spark):
    rng = np.random.default_rng(12)
    f = rng.gamma(2.0, 1.0, (23, 31)).astype(np.float32)
    f[rng.random(f.shape) < 0.05] = np.nan
    f[0, 0] = -1
    stored = chunks.to_chunks(pixels(spark, f), "x", f.shape, (8, 7))
    for size in (3, 7):
        got = grid(chunks.to_pixels(chunked.speckle(stored, f.shape, (8, 7), "lee", size, 3.0)), f.shape)
        assert np.array_equal(got.astype(np.float32), speckle.kernel(f, "lee", size, 3.0), equal_nan=True)
    field = chunked.transform(stored, "linear")
    want = dist.summary(chunks.to_pixels(field)).first()
    assert chunked.summary(field).first().asDict() == want.asDict()
    none = chunked.summary(chunked.transform(chunks.to_chunks(pixels(spark, np.full((3, 3), np.nan, np.float32)), "n", (3, 3), (2, 2)), "linear")).first()
    assert none["finite_count"] == 0 and none["invalid_count"] == 9 and none["p50"] is None
    z = np.array([3, 4, 0, 0, np.nan, 1, 1, -1], dtype=np.float32)
    assert np.array_equal(chunked.transform_array(z, "amplitude", True, np.array([1, 1, 1, 255])), np.array([5, 0, np.nan, np.nan], np.float32), equal_nan=True)
    assert chunked.transform_array(z, "power_db", True)[1] == -200
    with pytest.raises(ValueError):
        chunked.transform_array(z, "phase", False)
    with pytest.raises(ValueError):
        chunked.speckle(stored, f.shape, (2, 2), "lee", 7, 3.0)
