"""The builder: layer, window or lattice, mode, filter, then pixels or a distribution.

Plans are frozen and compare by value. The raw, aligned pixels of a plan are kept in a
small LRU (never styled ones), so another mode or filter doesn't read again.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radarlake.functions import transforms
from radarlake.operators import distribution, scan, speckle
from radarlake.plans.geometry import OUTPUT_BYTES, Window, overview_plan, product


@dataclass(frozen=True)
class ScenePlan:
    """What identifies a result."""

    layer: str
    layer_kind: str
    window: Window | None = None
    stride: tuple[int, int] = (1, 1)
    mode: str | None = None
    filter: tuple = ("none", 0, 1.0, None)


@dataclass(frozen=True)
class Layer:
    """A pixel table (row, col, v or re and im, mask or not) with its shape."""

    name: str
    kind: str
    pixels: DataFrame
    shape: tuple[int, int]
    spacing: tuple[float, float] | None = None
    chunk: tuple[int, int] | None = None


class Scene:
    """Layers by name, and the plan of what is wanted of one."""

    KEPT = 4

    def __init__(self, spark: SparkSession, layers: list[Layer], budget: int = OUTPUT_BYTES):
        self.spark, self.layers, self.budget = spark, {x.name: x for x in layers}, budget
        self._kept: OrderedDict[ScenePlan, DataFrame] = OrderedDict()

    def layer(self, name: str) -> View:
        if name not in self.layers:
            raise ValueError(f"no layer {name!r}")
        return View(self, ScenePlan(name, self.layers[name].kind))

    def register_views(self) -> None:
        """Temp views over the pixel tables, for SQL."""
        for x in self.layers.values():
            x.pixels.createOrReplaceTempView(x.name)

    def _raw(self, plan: ScenePlan) -> DataFrame:
        key = replace(plan, mode=None, filter=("none", 0, 1.0, None))
        if key in self._kept:
            self._kept.move_to_end(key)
            return self._kept[key]
        x = self.layers[plan.layer]
        whole = Window(0, 0, *x.shape)
        if plan.stride != (1, 1):
            df = scan.sample(x.pixels, plan.window or whole, plan.stride, x.chunk).withColumnsRenamed({"r": "row", "c": "col"})
        else:
            df = x.pixels if plan.window in (None, whole) else scan.window(x.pixels, plan.window, x.chunk)
        self._kept[key] = df.persist()
        while len(self._kept) > self.KEPT:
            self._kept.popitem(last=False)[1].unpersist()
        return self._kept[key]


@dataclass(frozen=True)
class View:
    scene: Scene
    plan: ScenePlan

    def window(self, row: int, col: int, height: int, width: int) -> View:
        x = self.scene.layers[self.plan.layer]
        w = Window(row, col, height, width).inside(*x.shape)
        product(w.height, w.width, 8, what="window")
        return View(self.scene, replace(self.plan, window=None if w == Window(0, 0, *x.shape) else w))

    def lod(self, edge: int = 4096, stride: tuple[int, int] | None = None) -> View:
        x = self.scene.layers[self.plan.layer]
        p = overview_plan(x.shape, 8 if "im" in x.pixels.columns else 4, window=self.plan.window, stride=stride, edge=edge, spacing=x.spacing, chunk=x.chunk, output_bytes=self.scene.budget)
        return View(self.scene, replace(self.plan, stride=p.stride))

    def transform(self, mode: str) -> View:
        if mode not in transforms.modes_for(self.plan.layer_kind):
            raise ValueError(f"{self.plan.layer_kind} layers have no mode {mode!r}")
        return View(self.scene, replace(self.plan, mode=mode))

    def speckle(self, kind: str, size: int = 5, enl: float = 1.0) -> View:
        """A filter over resident samples; dropped where the mode has no power domain."""
        speckle.check(kind, size, enl, "power", transforms.EPS)
        mode = self.plan.mode or transforms.default_mode(self.plan.layer_kind)
        return View(self.scene, replace(self.plan, filter=speckle.effective(self.plan.layer_kind, mode, kind, size, enl)))

    def pixels(self) -> DataFrame:
        """(row, col, value)"""
        p = self.plan
        df = self.scene._raw(p)
        cols = [F.col("re"), F.col("im")] if "im" in df.columns else [F.col("v")]
        mask = F.col("mask") if "mask" in df.columns else None
        got = df.select("row", "col", transforms.apply_mode(p.layer_kind, p.mode or transforms.default_mode(p.layer_kind), *cols, mask=mask).alias("value"))
        kind, size, enl, domain = p.filter
        return got if kind == "none" else speckle.filtered(got, kind, size, enl, domain)

    def distribution(self) -> DataFrame:
        """One row; always of the filtered field."""
        return distribution.summary(self.pixels())
