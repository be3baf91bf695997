"""Cameras over a raster: fitting, zoom, pan, visible ranges, detail levels, guarded pages."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, replace

import numpy as np

from radarlake.plans.geometry import U32, OverviewPlan, ResidentView, Window, ceil_div

#: Deepest level, tolerance of "covers", largest magnification of a native sample.
DEEPEST, SLACK, MAGNIFY = 63, 32 * sys.float_info.epsilon, 32.0


@dataclass(frozen=True)
class Raster:
    rows: int
    cols: int
    row_spacing: float
    col_spacing: float

    def __post_init__(self):
        if self.rows <= 0 or self.cols <= 0:
            raise ValueError("raster dimensions must be positive")
        if not all(math.isfinite(s) and s != 0 for s in (self.row_spacing, self.col_spacing)):
            raise ValueError("spacings must be finite and not zero")

    @property
    def dy(self) -> float:
        return abs(self.row_spacing)

    @property
    def dx(self) -> float:
        return abs(self.col_spacing)


@dataclass(frozen=True)
class Viewport:
    x: float
    y: float
    width: float
    height: float

    def __post_init__(self):
        if not all(map(math.isfinite, (self.x, self.y, self.width, self.height))) or self.width <= 0 or self.height <= 0:
            raise ValueError("a viewport must be finite and not empty")

    @property
    def middle(self) -> tuple[float, float]:
        return self.x + 0.5 * self.width, self.y + 0.5 * self.height


@dataclass(frozen=True)
class Camera:
    """scale: physical units a screen pixel; rotation: clockwise, in radians."""

    row: float
    col: float
    scale: float
    rotation: float = 0.0

    def __post_init__(self):
        if not all(map(math.isfinite, (self.row, self.col, self.scale, self.rotation))) or self.scale <= 0:
            raise ValueError("a camera must be finite, its scale positive")


def turn(radians: float) -> float:
    """An angle in [-pi, pi]."""
    if not math.isfinite(radians):
        raise ValueError("a rotation must be finite")
    return math.remainder(radians, 2 * math.pi) or 0.0


def _boxed(width: float, height: float, radians: float) -> tuple[float, float]:
    """Width and height of the box around a turned rectangle."""
    c, s = abs(math.cos(radians)), abs(math.sin(radians))
    return c * width + s * height, s * width + c * height


def _positive(x: float, what: str) -> float:
    if not (math.isfinite(x) and x > 0):
        raise OverflowError(f"{what} is out of range")
    return x


def fit_scale(raster: Raster, view: Viewport, radians: float) -> float:
    w, h = _boxed(_positive(raster.cols * raster.dx, "extent"), _positive(raster.rows * raster.dy, "extent"), radians)
    return _positive(max(h / view.height, w / view.width), "fit scale")


def fit(raster: Raster, view: Viewport, rotation: float = 0.0) -> Camera:
    """The camera that shows all of a raster."""
    angle = turn(rotation)
    return Camera(0.5 * raster.rows, 0.5 * raster.cols, fit_scale(raster, view, angle), angle)


def fit_window(w: Window, raster: Raster, view: Viewport, rotation: float = 0.0) -> Camera:
    """The camera that shows a pixel window; all of the raster if that is empty."""
    if not w.height or not w.width:
        return fit(raster, view, rotation)
    width, height = _boxed(w.width * raster.dx, w.height * raster.dy, rotation)
    return clamp(Camera(w.row + 0.5 * w.height, w.col + 0.5 * w.width, max(height / view.height, width / view.width), rotation), raster, view)


def _centre(at: float, seen: float, dim: float) -> float:
    if seen + SLACK * max(1.0, abs(seen), abs(dim)) >= dim:
        return 0.5 * dim
    return min(max(at, 0.5 * seen), dim - 0.5 * seen)


def clamp(cam: Camera, raster: Raster, view: Viewport) -> Camera:
    """Never further out than a fit, never off the raster."""
    angle = turn(cam.rotation)
    scale = min(cam.scale, fit_scale(raster, view, angle))
    w, h = _boxed(view.width, view.height, angle)
    rows, cols = _positive(h * scale / raster.dy, "visible extent"), _positive(w * scale / raster.dx, "visible extent")
    return Camera(_centre(cam.row, rows, raster.rows), _centre(cam.col, cols, raster.cols), scale, angle)


def _offset(cam: Camera, raster: Raster, dx: float, dy: float) -> tuple[float, float]:
    """A screen offset in pixels as (rows, columns)."""
    c, s = math.cos(turn(cam.rotation)), math.sin(turn(cam.rotation))
    x, y = dx * cam.scale, dy * cam.scale
    return (c * y - s * x) / raster.dy, (c * x + s * y) / raster.dx


def to_raster(cam: Camera, raster: Raster, view: Viewport, x: float, y: float) -> tuple[float, float]:
    """Screen point -> (row, column)."""
    if not (math.isfinite(x) and math.isfinite(y)):
        raise ValueError("a screen point must be finite")
    rows, cols = _offset(cam, raster, x - view.middle[0], y - view.middle[1])
    return cam.row + rows, cam.col + cols


def to_screen(cam: Camera, raster: Raster, view: Viewport, row: float, col: float) -> tuple[float, float]:
    """(row, column) -> screen point."""
    if not (math.isfinite(row) and math.isfinite(col)):
        raise ValueError("a raster point must be finite")
    c, s = math.cos(turn(cam.rotation)), math.sin(turn(cam.rotation))
    x, y = (col - cam.col) * raster.dx, (row - cam.row) * raster.dy
    return view.middle[0] + (c * x - s * y) / cam.scale, view.middle[1] + (s * x + c * y) / cam.scale


def zoom(cam: Camera, raster: Raster, view: Viewport, x: float, y: float, factor: float) -> Camera:
    """Scale about a screen point, whose raster point stays under it where the clamp allows."""
    if not (math.isfinite(x) and math.isfinite(y)):
        raise ValueError("a screen point must be finite")
    if not (math.isfinite(factor) and factor > 0):
        raise ValueError("a zoom factor must be finite and positive")
    if not (view.x <= x <= view.x + view.width and view.y <= y <= view.y + view.height):
        raise IndexError("the zoom anchor is outside the viewport")
    now = clamp(cam, raster, view)
    row, col = to_raster(now, raster, view, x, y)
    scaled = replace(now, scale=_positive(now.scale * factor, "zoom scale"))
    rows, cols = _offset(scaled, raster, x - view.middle[0], y - view.middle[1])
    return clamp(replace(scaled, row=row - rows, col=col - cols), raster, view)


def zoom_limited(cam: Camera, raster: Raster, view: Viewport, x: float, y: float, factor: float) -> Camera:
    """Zoom, with no more than 32 logical pixels a sample."""
    return zoom(cam, raster, view, x, y, max(factor, max(raster.dx, raster.dy) / MAGNIFY / cam.scale))


def pan(cam: Camera, raster: Raster, view: Viewport, dx: float, dy: float) -> Camera:
    if not (math.isfinite(dx) and math.isfinite(dy)):
        raise ValueError("a pan must be finite")
    now = clamp(cam, raster, view)
    rows, cols = _offset(now, raster, dx, dy)
    return clamp(replace(now, row=now.row - rows, col=now.col - cols), raster, view)


def visible(cam: Camera, raster: Raster, view: Viewport) -> tuple[float, float, float, float]:
    """(row0, col0, row1, col1) around the viewport's corners, cut to the raster."""
    now = clamp(cam, raster, view)
    at = [to_raster(now, raster, view, x, y) for x in (view.x, view.x + view.width) for y in (view.y, view.y + view.height)]
    rows, cols = zip(*at, strict=True)

    def cut(v: float, dim: int) -> float:
        return min(max(v, 0.0), float(dim))

    return cut(min(rows), raster.rows), cut(min(cols), raster.cols), cut(max(rows), raster.rows), cut(max(cols), raster.cols)


def screen_rect(cam: Camera, raster: Raster, view: Viewport) -> tuple[float, float, float, float]:
    """(x, y, width, height) of the raster on the screen, cut to the viewport."""
    now = clamp(cam, raster, view)
    at = [to_screen(now, raster, view, float(r), float(c)) for r in (0, raster.rows) for c in (0, raster.cols)]
    xs, ys = zip(*at, strict=True)
    x0, y0 = max(view.x, min(xs)), max(view.y, min(ys))
    return x0, y0, max(0.0, min(view.x + view.width, max(xs)) - x0), max(0.0, min(view.y + view.height, max(ys)) - y0)


def level(cam: Camera, raster: Raster, deepest: int = DEEPEST) -> int:
    """How often the stride doubles while it stays within half of the samples a pixel."""
    if not 0 <= deepest <= DEEPEST:
        raise ValueError("the deepest level must be in 0..63")
    samples, k = min(cam.scale / raster.dy, cam.scale / raster.dx), 0
    while k < deepest and float(1 << k) <= 0.5 * samples:
        k += 1
    return k


def level_extent(raster: Raster, k: int) -> tuple[int, int]:
    if not 0 <= k <= DEEPEST:
        raise ValueError("a level must be in 0..63")
    return ceil_div(raster.rows, 1 << k), ceil_div(raster.cols, 1 << k)


@dataclass(frozen=True)
class LevelRequest:
    level: int
    stride: int
    source: Window
    at: Window
    extent: tuple[int, int]


def _source(raster: Raster, at: Window, stride: int) -> Window:
    r0, c0 = min(at.row * stride, raster.rows), min(at.col * stride, raster.cols)
    r1, c1 = min((at.row + at.height) * stride, raster.rows), min((at.col + at.width) * stride, raster.cols)
    return Window(r0, c0, r1 - r0, c1 - c0)


def level_request(cam: Camera, raster: Raster, view: Viewport, k: int) -> LevelRequest:
    """The visible range on the lattice of a level, whole samples."""
    extent, stride = level_extent(raster, k), 1 << k
    row0, col0, row1, col1 = visible(cam, raster, view)
    r0, c0 = min(math.floor(row0), raster.rows) // stride, min(math.floor(col0), raster.cols) // stride
    r1, c1 = ceil_div(min(math.ceil(row1), raster.rows), stride), ceil_div(min(math.ceil(col1), raster.cols), stride)
    if r1 <= r0 or c1 <= c0:
        raise RuntimeError("the visible range is empty")
    at = Window(r0, c0, r1 - r0, c1 - c0)
    return LevelRequest(k, stride, _source(raster, at, stride), at, extent)


def density(cam: Camera, raster: Raster, stride: tuple[int, int], framebuffer: tuple[float, float] = (1.0, 1.0)) -> float:
    """Resident texels a framebuffer pixel where they are fewest: the least singular value of the map."""
    if min(stride) <= 0:
        raise ValueError("strides must be positive")
    if not all(math.isfinite(f) and f > 0 for f in framebuffer):
        raise ValueError("framebuffer scales must be finite and positive")
    wide = np.longdouble
    rows = wide(cam.scale) / wide(raster.dy) / wide(stride[0])
    cols = wide(cam.scale) / wide(raster.dx) / wide(stride[1])
    c, s = wide(math.cos(turn(cam.rotation))), wide(math.sin(turn(cam.rotation)))
    m = np.array([[cols * c / framebuffer[0], cols * s / framebuffer[1]], [-rows * s / framebuffer[0], rows * c / framebuffer[1]]], dtype=wide)
    top = np.abs(m).max()
    if not (top > 0 and np.isfinite(top)):
        raise OverflowError("the texel density is out of range")
    m = m / top
    norm, det = (m * m).sum(), m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0]
    large = (norm + np.sqrt(max(wide(0), norm * norm - 4 * det * det))) / 2
    return _positive(float(top * abs(det) / np.sqrt(large)), "the texel density")


def usable(source: Window, stride: tuple[int, int], seen: tuple[float, float, float, float], cam: Camera, raster: Raster, framebuffer: tuple[float, float] = (1.0, 1.0), least: float = 1.0) -> bool:
    """A resident page covers what is seen, with at least so many texels a pixel."""
    if not (math.isfinite(least) and least > 0):
        raise ValueError("the least density must be finite and positive")
    return source.contains(*seen) and density(cam, raster, stride, framebuffer) >= least


@dataclass(frozen=True)
class Guard:
    deepest: int = DEEPEST
    page: int = 512
    resident: int = 4096
    texels: float = 1.25
    fraction: float = 0.25

    def __post_init__(self):
        if not 0 <= self.deepest <= DEEPEST:
            raise ValueError("the deepest level must be in 0..63")
        if self.page <= 0 or self.resident <= 0 or self.resident % self.page or self.resident > U32:
            raise ValueError("the resident extent must be a multiple of the page")
        if not (math.isfinite(self.texels) and self.texels > 0):
            raise ValueError("the texel density must be finite and positive")
        if not (math.isfinite(self.fraction) and 0 <= self.fraction < 1):
            raise ValueError("the guard fraction must be in [0, 1)")


@dataclass(frozen=True)
class GuardedRequest:
    visible: LevelRequest
    source: Window
    at: Window


def guarded(cam: Camera, raster: Raster, view: Viewport, guard: Guard = Guard()) -> GuardedRequest:
    """The pages around what is seen, at the first level at which they fit the resident extent."""
    capacity = guard.resident // guard.page
    spare = math.ceil(capacity * guard.fraction)
    most = max(1, capacity - min(capacity - 1, spare))
    k = level(replace(cam, scale=_positive(cam.scale / guard.texels, "camera scale")), raster, guard.deepest)

    def pages(start: int, extent: int) -> tuple[int, int]:
        first = start // guard.page
        return first, (start + extent - 1) // guard.page - first + 1

    while True:
        seen = level_request(cam, raster, view, k)
        spans = [pages(seen.at.row, seen.at.height), pages(seen.at.col, seen.at.width)]
        totals = [ceil_div(n, guard.page) for n in seen.extent]
        if all(n <= (total if total <= capacity else most) for (_, n), total in zip(spans, totals, strict=True)):
            break
        if k == guard.deepest:
            raise OverflowError("no level fits the resident extent")
        k += 1
    ends = []
    for (first, n), total, extent in zip(spans, totals, seen.extent, strict=True):
        held = min(capacity, total, n + spare)
        start = min(max(first - ceil_div(held - n, 2), 0), total - held)
        lo = min(start * guard.page, extent)
        ends.append((lo, min((start + held) * guard.page, extent) - lo))
    at = Window(ends[0][0], ends[1][0], ends[0][1], ends[1][1])
    return GuardedRequest(seen, _source(raster, at, seen.stride), at)


@dataclass(frozen=True)
class PageChoice:
    """What to show: a native mosaic, a resident page, or a page to build (regional stride or whole)."""

    native: ResidentView | None = None
    reuse: OverviewPlan | None = None
    window: Window | None = None
    stride: tuple[int, int] | None = None


def choose_page(native: ResidentView | None, cam: Camera, raster: Raster, view: Viewport, resident: list[OverviewPlan], framebuffer: tuple[float, float] = (1.0, 1.0), guard: Guard = Guard()) -> PageChoice:
    """Native where it fits; else a prepared page that still serves; else the guarded page."""
    if native is not None:
        return PageChoice(native=native)
    seen = visible(cam, raster, view)
    for plan in resident:
        if usable(plan.window, plan.stride, seen, cam, raster, framebuffer):
            return PageChoice(reuse=plan)
    want = guarded(cam, raster, view, guard)
    if want.source == Window(0, 0, raster.rows, raster.cols):
        return PageChoice()  # the whole raster: the overview planner picks its own strides
    return PageChoice(window=want.source, stride=(want.visible.stride,) * 2)
