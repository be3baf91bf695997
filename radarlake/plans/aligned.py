"""Plans over several layers: aligned scans, derived pages, and their canonical identity."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from radarlake.plans.geometry import BLOCK, PAGE_BYTES, SCRATCH_BYTES, Window, ceil_div, most_aligned_extent, product

MOST_RASTERS = 4
#: Kinds of derived pages and the comparison mode each needs (None: Pauli).
PAGE_KINDS = {"pauli_rgb": None, "compare_pair": "swipe", "compare_difference": "difference", "compare_ratio_db": "ratio"}
REAL_TRANSFORMS = ("linear", "power_db")
COMPLEX_TRANSFORMS = ("amplitude", "power", "power_db", "phase", "real", "imaginary", "linear")


@dataclass(frozen=True)
class LayerInfo:
    """What a plan needs of a catalogued layer."""

    path: str
    frequency: str
    kind: str
    dtype: str
    element_bytes: int
    shape: tuple[int, int]
    grid_mapping: str = ""
    chunk: tuple[int, int] | None = None
    role: str = "science"


@dataclass(frozen=True)
class AlignedPlan:
    """Layers in the order asked for, each distinct mask once (in the order of first use)."""

    rasters: tuple[str, ...]
    masks: tuple[str, ...]
    mask_of: tuple[int | None, ...]
    window: Window
    stride: tuple[int, int]
    shape: tuple[int, int]
    block: tuple[int, int]
    blocks: int
    bytes: int


def aligned_plan(
    catalog: dict[str, LayerInfo], grids: dict[str, tuple[int, int]], rasters: list[tuple[str, str | None]], *, window: Window | None = None, stride: tuple[int, int] = (1, 1),
    output_bytes: int = PAGE_BYTES, scratch_bytes: int = SCRATCH_BYTES,
) -> AlignedPlan:
    """rasters: (layer path, mask path or None); grids: rows and columns of each frequency's axes."""
    if not 1 <= len(rasters) <= MOST_RASTERS:
        raise ValueError("between one and four layers can be aligned")
    if min(stride) <= 0 or output_bytes <= 0 or scratch_bytes <= 0:
        raise ValueError("strides and budgets must be positive")
    found: list[LayerInfo] = []
    for path, _ in rasters:
        x = catalog.get(path)
        if x is None or x.role != "science" or x.element_bytes <= 0 or min(x.shape) <= 0:
            raise ValueError(f"{path} is missing, empty or not readable")
        if x in found:
            raise ValueError(f"{path} is named twice")
        found.append(x)
    first = found[0]
    if grids.get(first.frequency) != first.shape:
        raise ValueError(f"{first.path} does not match its frequency grid")
    same = (first.frequency, first.shape, first.grid_mapping)
    for x in found[1:]:
        if (x.frequency, x.shape, x.grid_mapping) != same:
            raise ValueError("all layers must share one grid and grid mapping")
    masks: list[LayerInfo] = []
    mask_of: list[int | None] = []
    for _, path in rasters:
        if path is None:
            mask_of.append(None)
            continue
        m = catalog.get(path)
        if m is None or m.kind != "mask" or m.dtype != "uint8" or (m.frequency, m.shape, m.grid_mapping) != same:
            raise ValueError(f"{path} is no uint8 mask on the layers' grid")
        if m not in masks:
            masks.append(m)
        mask_of.append(masks.index(m))
    w = (window or Window(0, 0, *first.shape)).inside(*first.shape)
    out = (ceil_div(w.height, stride[0]), ceil_div(w.width, stride[1]))
    size = product(*out, sum(x.element_bytes for x in (*found, *masks)), what="aligned output")
    if size > output_bytes:
        raise OverflowError("the aligned output exceeds its budget")
    block = first.chunk or (min(first.shape[0], BLOCK), min(first.shape[1], BLOCK))
    for x in (*found, *masks):
        extent = [min(e, b) for e, b in zip((w.height, w.width), block, strict=True)]
        if x.chunk:
            extent = [most_aligned_extent(e, d, c) for e, d, c in zip(extent, x.shape, x.chunk, strict=True)]
        if product(*extent, x.element_bytes) > scratch_bytes:
            raise OverflowError(f"a block of {x.path} exceeds the scratch budget")
    n = product(*((o + e - 1) // b - o // b + 1 for o, e, b in ((w.row, w.height, block[0]), (w.col, w.width, block[1]))))
    return AlignedPlan(tuple(x.path for x in found), tuple(m.path for m in masks), tuple(mask_of), w, stride, out, block, n, size)


@dataclass(frozen=True)
class PageRequest:
    """A derived page. The serial and the camera's generation tell requests apart, not pages."""

    kind: str
    rasters: tuple[str, ...]
    mask: str | None = None
    transform: str = "power_db"
    window: Window | None = None
    stride: tuple[int, int] = (1, 1)
    serial: int = field(default=0, compare=False)
    generation: int = field(default=0, compare=False)


@dataclass(frozen=True)
class PagePlan:
    request: PageRequest
    aligned: AlignedPlan


def page_plan(request: PageRequest, catalog: dict[str, LayerInfo], grids: dict[str, tuple[int, int]], available: set[tuple[str, tuple[str, ...]]], **budgets: int) -> PagePlan:
    """The canonical plan of a page.

    available: (mode, layer paths) that the capabilities allow; for Pauli the mode is
    'pauli'. Ratios always compare linear values, whatever transform is selected.
    """
    if request.kind not in PAGE_KINDS:
        raise ValueError(f"no page kind {request.kind!r}")
    mode = PAGE_KINDS[request.kind] or "pauli"
    if (mode, request.rasters) not in available:
        raise ValueError("the recipe is none that the catalog allows")
    if len(request.rasters) != (4 if mode == "pauli" else 2):
        raise ValueError("the page has a wrong number of layers")
    transform = "linear" if request.kind == "compare_ratio_db" else request.transform
    if mode == "pauli":
        transform = "linear"
    elif request.kind != "compare_ratio_db":
        allowed = COMPLEX_TRANSFORMS if catalog[request.rasters[0]].dtype == "complex64" else REAL_TRANSFORMS
        if transform not in allowed:
            raise ValueError(f"these layers can't be compared by {transform}")
    plan = aligned_plan(catalog, grids, [(r, request.mask) for r in request.rasters], window=request.window, stride=request.stride, **budgets)
    whole = plan.window == Window(0, 0, *catalog[request.rasters[0]].shape)
    return PagePlan(replace(request, transform=transform, window=None if whole else plan.window), plan)
