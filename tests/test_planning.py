"""Planner goldens and a seeded property loop."""

import math
import random

import pytest

from radarlake.plans import geometry as g
from radarlake.plans import navigation as n

VIEW = n.Viewport(0, 0, 1080, 900)
GCOV = n.Raster(17892, 18108, -20.0, 20.0)
GSLC = n.Raster(67824, 34488, -5.0, 5.0)
GRID = g.ChunkGrid(4 * 512 + 123, 6 * 512 + 77, 512, 512)


def test_read_plans():
    p = g.read_plan(g.Window(3, 4, 5, 6), (10, 13), (4, 5), 4)
    assert p.aligned == g.Window(0, 0, 8, 10) and p.offset == (3, 4) and p.bytes == 320
    assert g.read_plan(g.Window(8, 10, 2, 3), (10, 13), (4, 5), 4).aligned == g.Window(8, 10, 2, 3)
    assert g.read_plan(g.Window(3, 4, 5, 6), (10, 13), None, 4).aligned == g.Window(3, 4, 5, 6)
    for bad, error in ((g.Window(0, 0, 0, 1), ValueError), (g.Window(9, 0, 2, 1), IndexError), (g.Window(-1, 0, 1, 1), ValueError)):
        with pytest.raises(error):
            g.read_plan(bad, (10, 13), (4, 5), 4)


def test_mosaics():
    assert g.mosaic(GRID, (2, 3), 2) == g.Mosaic(1, 2, 2, 2, g.Window(512, 1024, 1024, 1024))
    assert g.mosaic(GRID, (4, 6), 4).window == g.Window(512, 1536, 3 * 512 + 123, 3 * 512 + 77)
    assert g.mosaic(g.ChunkGrid(100, 100, 512, 512), (0, 0), 4).window == g.Window(0, 0, 100, 100)
    with pytest.raises(ValueError):
        g.mosaic(GRID, (0, 0), 3)
    with pytest.raises(IndexError):
        g.mosaic(GRID, (5, 0), 1)
    assert g.mosaic_bytes(2048, 2048, 8, 1 << 30) == 33554432
    for args, error in (((0, 1, 1, 9), ValueError), ((4, 4, 4, 63), OverflowError), ((1 << 40, 1 << 40, 8, 1 << 62), OverflowError)):
        with pytest.raises(error):
            g.mosaic_bytes(*args)


def test_aligned_extent_bounds_every_start():
    rng = random.Random(1)
    for _ in range(300):
        dim, chunk = rng.randint(1, 90), rng.randint(1, 20)
        request = rng.randint(1, dim)
        worst = max(g._aligned(s, request, dim, chunk)[1] for s in range(dim - request + 1))
        assert worst <= g.most_aligned_extent(request, dim, chunk) <= dim


def test_resident_view():
    got = g.resident_view(GRID, (600.0, 600.0, 900.0, 1000.0))
    assert got.span == 1 and got.mosaic.window == g.Window(512, 512, 512, 512)
    assert g.resident_view(GRID, (0.0, 0.0, 512.0, 512.0)).span == 1
    assert g.resident_view(GRID, (0.0, 0.0, 512.5, 512.0)).span == 2
    assert g.resident_view(GRID, (0.0, 0.0, 2060.0, 10.0)) is None
    three = g.resident_view(GRID, (600.0, 600.0, 1600.0, 2000.0))
    assert three.span == 4 and three.mosaic.chunk_row == 0
    for bad, error in (((5.0, 0.0, 5.0, 1.0), ValueError), ((0.0, 0.0, math.nan, 1.0), ValueError), ((0.0, 0.0, 9999.0, 1.0), IndexError)):
        with pytest.raises(error):
            g.resident_view(GRID, bad)
    assert GRID.focus(-5.0, 1e9) == (0, 6)


def test_overview_plans():
    p = g.overview_plan((17892, 18108), 4, spacing=(-20.0, 20.0), chunk=(512, 512), mask=True, mask_chunk=(512, 512))
    assert p.stride == (5, 5) and p.shape == (3579, 3622) and p.whole
    p = g.overview_plan((67104, 34200), 8, spacing=(-5.0, 10.0), chunk=(512, 512), output_bytes=1 << 30)
    assert p.stride == (17, 9) and p.shape == (3948, 3800)
    assert g.overview_plan((100, 100), 4, window=g.Window(0, 0, 100, 100)) == g.overview_plan((100, 100), 4)
    assert g.overview_plan((100, 1000), 4, edge=64).stride == (16, 16)
    for kw, error in (({"edge": 5000}, ValueError), ({"stride": (0, 1)}, ValueError), ({"stride": (1, 1), "edge": 10}, ValueError), ({"output_bytes": 10}, OverflowError), ({"scratch_bytes": 10}, OverflowError), ({"window": g.Window(90, 0, 20, 1)}, IndexError)):
        with pytest.raises(error):
            g.overview_plan((100, 100), 4, **kw)
    assert g.sampled_chunks(1, 30, 10, 4) == [0, 2, 5] and g.sampled_chunks(5, 10, 2, 4) == [1, 2, 3]
    assert g.overview_mapping(g.overview_plan((100, 100), 4, stride=(5, 2))).origin == (-2.0, -0.5)
    assert g.native_mapping(g.mosaic(GRID, (1, 1), 1)).origin == (512.0, 512.0)


def test_cameras():
    cam = n.fit(GCOV, VIEW)
    assert cam.scale == pytest.approx(397.6) and (cam.row, cam.col) == (8946, 9054)
    assert n.level(cam, GCOV) == 4 and n.level(n.fit(GSLC, VIEW), GSLC) == 6
    assert n.visible(cam, GCOV, VIEW) == (0, 0, 17892, 18108)
    assert n.clamp(n.Camera(0, 0, 1e9), GCOV, VIEW) == cam
    assert n.turn(3 * math.pi) == pytest.approx(math.pi) or n.turn(3 * math.pi) == pytest.approx(-math.pi)
    w = g.Window(5000, 5000, 600, 720)
    near = n.fit_window(w, GCOV, VIEW)
    assert near.scale == pytest.approx(13.333333333) and w.contains(*n.visible(near, GCOV, VIEW))
    assert n.level_extent(GCOV, 4) == (1119, 1132)
    assert n.density(cam, GCOV, (16, 16)) == pytest.approx(397.6 / 20 / 16)
    assert n.usable(g.Window(0, 0, 17892, 18108), (16, 16), n.visible(cam, GCOV, VIEW), cam, GCOV)
    assert not n.usable(g.Window(0, 0, 17892, 18108), (64, 64), n.visible(cam, GCOV, VIEW), cam, GCOV)
    assert n.choose_page(None, cam, GCOV, VIEW, []).window is None
    for bad in ((0, 0, 0.0), (0, 0, math.nan)):
        with pytest.raises(ValueError):
            n.Camera(*bad)
    with pytest.raises(IndexError):
        n.zoom(cam, GCOV, VIEW, -1, 0, 0.5)
    limited = n.zoom_limited(n.Camera(100, 100, 1.0), GCOV, VIEW, 500, 500, 1e-9)
    assert limited.scale == pytest.approx(20 / 32)


def test_random_navigation():
    rng = random.Random(20_240_501)
    for _ in range(1000):
        raster = n.Raster(rng.randint(64, 80_000), rng.randint(64, 80_000), rng.choice((-1, 1)) * rng.uniform(0.5, 30), rng.uniform(0.5, 30))
        view = n.Viewport(rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(200, 3000), rng.uniform(200, 2000))
        whole = n.fit(raster, view, rng.uniform(-7, 7))
        cam = n.clamp(n.Camera(rng.uniform(0, raster.rows), rng.uniform(0, raster.cols), whole.scale * rng.uniform(1e-3, 1.2), whole.rotation), raster, view)
        assert cam.scale <= whole.scale and -math.pi <= cam.rotation <= math.pi
        x, y = view.x + rng.random() * view.width, view.y + rng.random() * view.height
        at = n.to_raster(cam, raster, view, x, y)
        back = n.to_screen(cam, raster, view, *at)
        assert back == pytest.approx((x, y), abs=1e-6 * max(1, abs(x), abs(y)) + 1e-7)
        seen = n.visible(cam, raster, view)
        assert 0 <= seen[0] < seen[2] <= raster.rows and 0 <= seen[1] < seen[3] <= raster.cols
        moved = n.pan(n.zoom(cam, raster, view, x, y, rng.uniform(0.3, 3)), raster, view, rng.uniform(-99, 99), rng.uniform(-99, 99))
        assert 0 <= moved.row <= raster.rows and 0 <= moved.col <= raster.cols
        rect = n.screen_rect(cam, raster, view)
        assert rect[2] <= view.width + 1e-6 and rect[3] <= view.height + 1e-6
        try:
            page = n.guarded(cam, raster, view)
        except OverflowError:
            continue
        assert page.visible.stride == 1 << page.visible.level
        assert page.at.row % 512 == 0 and page.at.col % 512 == 0 and max(page.at.height, page.at.width) <= 4096
        assert page.source.contains(*seen)


def test_guard_options():
    for kw in ({"page": 0}, {"resident": 1000}, {"texels": 0.0}, {"fraction": 1.0}, {"deepest": 64}):
        with pytest.raises(ValueError):
            n.Guard(**kw)
    cam = n.fit(GCOV, VIEW)
    with pytest.raises(OverflowError):
        n.guarded(cam, GCOV, VIEW, n.Guard(deepest=0))
    assert n.guarded(cam, GCOV, VIEW).visible.level >= 3
