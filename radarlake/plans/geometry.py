"""Windows, chunk-aligned read plans, mosaics, strides and memory budgets.

Plans are frozen and compare by value: an executor can tell a stale or altered plan by
making it again. Errors: ValueError for bad arguments, IndexError for what lies outside
the raster, OverflowError for what exceeds a size or budget.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

U64, U32 = (1 << 64) - 1, (1 << 32) - 1
#: Mosaic spans, largest overview edge, default budgets in bytes, fallback block.
SPANS = (1, 2, 4)
LONGEST_EDGE = 4096
OUTPUT_BYTES, SCRATCH_BYTES = 256 << 20, 64 << 20
PAGE_BYTES = 512 << 20
BLOCK = 512


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def product(*xs: int, what: str = "product") -> int:
    out = math.prod(xs)
    if out > U64:
        raise OverflowError(f"{what} overflows")
    return out


@dataclass(frozen=True)
class Window:
    """An integer window: rows row..row+height-1, columns col..col+width-1."""

    row: int
    col: int
    height: int
    width: int

    def inside(self, rows: int, cols: int) -> Window:
        """Itself, if it is not empty and lies inside a raster."""
        if min(self.row, self.col) < 0 or self.height <= 0 or self.width <= 0:
            raise ValueError("a window must have positive extents and origin >= 0")
        if self.row + self.height > rows or self.col + self.width > cols:
            raise IndexError("the window is outside the raster")
        return self

    def contains(self, row0: float, col0: float, row1: float, col1: float) -> bool:
        return row0 >= self.row and col0 >= self.col and row1 <= self.row + self.height and col1 <= self.col + self.width


@dataclass(frozen=True)
class ReadPlan:
    """What was asked for, the whole chunks that hold it, and the place of one in the other."""

    requested: Window
    aligned: Window
    offset: tuple[int, int]
    bytes: int


def _aligned(start: int, extent: int, dim: int, chunk: int) -> tuple[int, int]:
    first = start // chunk * chunk
    return first, min(ceil_div(start + extent, chunk) * chunk, dim) - first


def read_plan(w: Window, shape: tuple[int, int], chunk: tuple[int, int] | None, element_bytes: int) -> ReadPlan:
    """A window grown to chunk borders and cut at the raster; without chunks it stays."""
    w.inside(*shape)
    if chunk is None:
        aligned = w
    else:
        (r, h), (c, n) = _aligned(w.row, w.height, shape[0], chunk[0]), _aligned(w.col, w.width, shape[1], chunk[1])
        aligned = Window(r, c, h, n)
    return ReadPlan(w, aligned, (w.row - aligned.row, w.col - aligned.col), product(aligned.height, aligned.width, element_bytes, what="read size"))


def most_aligned_extent(request: int, dim: int, chunk: int) -> int:
    """The largest chunk-aligned extent that a request may grow to, wherever it starts."""
    if min(request, dim, chunk) <= 0:
        raise ValueError("extents must be positive")
    if request >= dim:
        return dim
    return min(dim, ceil_div(request + chunk - 1, chunk) * chunk)


@dataclass(frozen=True)
class Mosaic:
    chunk_row: int
    chunk_col: int
    chunk_rows: int
    chunk_cols: int
    window: Window


@dataclass(frozen=True)
class ChunkGrid:
    """A raster and its chunks."""

    rows: int
    cols: int
    chunk_height: int
    chunk_width: int

    def __post_init__(self):
        if min(self.rows, self.cols, self.chunk_height, self.chunk_width) <= 0:
            raise ValueError("raster and chunk dimensions must be positive")

    @property
    def chunks(self) -> tuple[int, int]:
        return ceil_div(self.rows, self.chunk_height), ceil_div(self.cols, self.chunk_width)

    def focus(self, row: float, col: float) -> tuple[int, int]:
        """The chunk under a raster point, which is cut to the raster."""
        out = []
        for at, dim, size, n in ((row, self.rows, self.chunk_height, self.chunks[0]), (col, self.cols, self.chunk_width, self.chunks[1])):
            pixel = math.floor(min(max(at, 0.0), math.nextafter(float(dim), 0.0)))
            out.append(min(n - 1, pixel // size))
        return out[0], out[1]


def mosaic(grid: ChunkGrid, focus: tuple[int, int], span: int) -> Mosaic:
    """1, 2 or 4 chunks a side around a focus, shifted inward at the edges."""
    if span not in SPANS:
        raise ValueError("the span must be 1, 2 or 4")
    start, count, begin, extent = [], [], [], []
    for at, n, size, dim in zip(focus, grid.chunks, (grid.chunk_height, grid.chunk_width), (grid.rows, grid.cols), strict=True):
        if not 0 <= at < n:
            raise IndexError("the focus chunk is outside the grid")
        k = min(span, n)
        s = min(max(at - span // 2, 0), n - k)
        start.append(s)
        count.append(k)
        begin.append(product(s, size, what="mosaic origin"))
        extent.append(min(product(k, size, what="mosaic extent"), dim - begin[-1]))
    return Mosaic(start[0], start[1], count[0], count[1], Window(begin[0], begin[1], extent[0], extent[1]))


def mosaic_bytes(height: int, width: int, element_bytes: int, limit: int) -> int:
    if min(height, width, element_bytes) <= 0:
        raise ValueError("dimensions and element size must be positive")
    size = product(height, width, element_bytes, what="mosaic size")
    if size > limit:
        raise OverflowError("the mosaic exceeds its budget")
    return size


@dataclass(frozen=True)
class ResidentView:
    span: int
    focus: tuple[int, int]
    mosaic: Mosaic


def resident_view(grid: ChunkGrid, visible: tuple[float, float, float, float], least_span: int = 1) -> ResidentView | None:
    """The smallest native mosaic that holds a visible range (row0, col0, row1, col1), or None.

    The end is exclusive; an odd spare chunk goes before the range.
    """
    if least_span not in SPANS:
        raise ValueError("the least span must be 1, 2 or 4")
    if not all(map(math.isfinite, visible)):
        raise ValueError("the visible range must be finite")
    row0, col0, row1, col1 = visible
    if not (row0 < row1 and col0 < col1):
        raise ValueError("the visible range must not be empty")
    if row0 < 0 or col0 < 0 or row1 > grid.rows or col1 > grid.cols:
        raise IndexError("the visible range is outside the raster")
    ends = []
    for a, b, size in ((row0, row1, grid.chunk_height), (col0, col1, grid.chunk_width)):
        ends.append((math.floor(a / size), math.floor(math.nextafter(b, -math.inf) / size)))
    needed = max(last - first + 1 for first, last in ends)
    span = next((s for s in SPANS if s >= max(needed, least_span)), 0)
    if not span:
        return None
    focus = []
    for (first, last), n in zip(ends, grid.chunks, strict=True):
        spare = min(span, n) - (last - first + 1)
        start = min(max(first - ceil_div(spare, 2), 0), n - min(span, n))
        focus.append(min(n - 1, start + span // 2))
    at = (focus[0], focus[1])
    return ResidentView(span, at, mosaic(grid, at, span))


def sampled_chunks(start: int, extent: int, stride: int, chunk: int) -> list[int]:
    """Chunk numbers on an axis that hold a sample of start, start + stride, ..."""
    if stride <= chunk:
        return list(range(start // chunk, (start + extent - 1) // chunk + 1))
    return sorted({at // chunk for at in range(start, start + extent, stride)})


@dataclass(frozen=True)
class OverviewPlan:
    """A sparse lattice over a window; ``whole`` where that is the raster."""

    window: Window
    whole: bool
    stride: tuple[int, int]
    shape: tuple[int, int]
    science_bytes: int
    mask_bytes: int
    scratch_bytes: int
    chunks: int


def auto_stride(extent: tuple[int, int], edge: int, spacing: tuple[float, float] | None) -> tuple[int, int]:
    """Strides that balance physical spacing and keep both axes within ``edge``."""
    least = tuple(ceil_div(n, edge) for n in extent)
    if spacing is None or not all(math.isfinite(s) and s != 0 for s in spacing):
        return (max(least),) * 2
    size = tuple(map(abs, spacing))
    target = max(s * n / edge for s, n in zip(size, extent, strict=True))
    out = [max(1, math.ceil(target / s), n) for s, n in zip(size, least, strict=True)]
    if max(out) > U64:
        raise OverflowError("the stride can't be represented")
    return out[0], out[1]


def overview_plan(
    shape: tuple[int, int], element_bytes: int, *, window: Window | None = None, stride: tuple[int, int] | None = None, edge: int = LONGEST_EDGE,
    spacing: tuple[float, float] | None = None, chunk: tuple[int, int] | None = None, mask: bool = False, mask_chunk: tuple[int, int] | None = None,
    output_bytes: int = OUTPUT_BYTES, scratch_bytes: int = SCRATCH_BYTES,
) -> OverviewPlan:
    """Plan a level-of-detail page; raises before any work if it breaks a budget."""
    if not 1 <= edge <= LONGEST_EDGE:
        raise ValueError(f"the longest edge must be in 1..{LONGEST_EDGE}")
    if output_bytes <= 0 or scratch_bytes <= 0:
        raise ValueError("budgets must be positive")
    if min(shape) <= 0 or element_bytes <= 0:
        raise ValueError("the layer is empty")
    w = (window or Window(0, 0, *shape)).inside(*shape)
    if stride is not None and min(stride) <= 0:
        raise ValueError("strides must be positive")
    step = stride or auto_stride((w.height, w.width), edge, spacing)
    out = (ceil_div(w.height, step[0]), ceil_div(w.width, step[1]))
    if max(out) > edge:
        raise ValueError("the strides give more than the longest edge")
    science, masks = product(*out, element_bytes), product(*out) if mask else 0
    if science + masks > output_bytes:
        raise OverflowError("the page exceeds its output budget")
    block = chunk or (min(shape[0], BLOCK), min(shape[1], BLOCK))
    n = product(*((o + e - 1) // b - o // b + 1 for o, e, b in ((w.row, w.height, block[0]), (w.col, w.width, block[1]))))
    rows, cols = min(block[0], shape[0]), min(block[1], shape[1])
    scratch = product(rows, cols, element_bytes)
    if mask and mask_chunk:
        scratch = max(scratch, product(most_aligned_extent(rows, shape[0], mask_chunk[0]), most_aligned_extent(cols, shape[1], mask_chunk[1])))
    if scratch > scratch_bytes:
        raise OverflowError("a chunk exceeds the scratch budget")
    return OverviewPlan(w, w == Window(0, 0, *shape), step, out, science, masks, scratch, n)


@dataclass(frozen=True)
class PageMapping:
    """Where a page's texels lie in the raster: texel (r, c) covers origin + stride * (r, c) .. + stride."""

    window: Window
    origin: tuple[float, float]
    stride: tuple[int, int]
    shape: tuple[int, int]


def native_mapping(m: Mosaic) -> PageMapping:
    w = m.window
    return PageMapping(w, (float(w.row), float(w.col)), (1, 1), (w.height, w.width))


def overview_mapping(p: OverviewPlan) -> PageMapping:
    """Samples sit in the middle of their texels, so the origin moves by half a stride less half a pixel."""
    w = p.window
    return PageMapping(w, (w.row + 0.5 - 0.5 * p.stride[0], w.col + 0.5 - 0.5 * p.stride[1]), p.stride, p.shape)


@dataclass(frozen=True)
class SampleUv:
    """Where a raster range lies on a page: page coordinate = origin + window coordinate * extent."""

    origin: tuple[float, float]
    extent: tuple[float, float]


def sample_uv(m: PageMapping, row0: float, col0: float, row1: float, col1: float) -> SampleUv | None:
    """(x, y) of a raster range in a page's unit square, or None where they don't meet."""
    if not all(map(math.isfinite, (row0, col0, row1, col1))) or row1 <= row0 or col1 <= col0 or min(m.stride) <= 0 or min(m.shape) <= 0:
        return None
    w = m.window
    if row1 <= w.row or col1 <= w.col or row0 >= w.row + w.height or col0 >= w.col + w.width:
        return None
    height, width = m.shape[0] * m.stride[0], m.shape[1] * m.stride[1]
    return SampleUv(((col0 - m.origin[1]) / width, (row0 - m.origin[0]) / height), ((col1 - col0) / width, (row1 - row0) / height))


def window_uv(corners: tuple[tuple[float, float], ...], row0: float, col0: float, row1: float, col1: float) -> tuple[tuple[float, float], ...]:
    """Origin, dx and dy of a screen in a range's unit square.

    corners: (row, column) under the screen's top left, top right and bottom left.
    """
    (r, c), (rx, cx), (ry, cy) = corners
    height, width = row1 - row0, col1 - col0
    return ((c - col0) / width, (r - row0) / height), ((cx - c) / width, (rx - r) / height), ((cy - c) / width, (ry - r) / height)
