"""Per-pixel transforms of complex images and covariance terms.

All work in double precision and return float32, NULL where the mask, the inputs or the
result are not valid.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from radarlake.functions.validity import as_float, finite, mask_ok

#: Fixed value: the least power that is taken a logarithm of.
EPS = 1e-20


def checked_eps(eps: float) -> float:
    if not (math.isfinite(eps) and eps > 0):
        raise ValueError("eps must be finite and positive")
    return eps


def _d(c: Column) -> Column:
    return c.cast("double")


def decibel(power: Column, eps: float = EPS) -> Column:
    return F.lit(10e0) * F.log10(F.greatest(_d(power), F.lit(checked_eps(eps))))


def amplitude(re: Column, im: Column, mask: Column | None = None) -> Column:
    return as_float(F.hypot(_d(re), _d(im)), finite(re, im) & mask_ok(mask))


def power(re: Column, im: Column, mask: Column | None = None) -> Column:
    return as_float(_d(re) * _d(re) + _d(im) * _d(im), finite(re, im) & mask_ok(mask))


def power_db(re: Column, im: Column, mask: Column | None = None, eps: float = EPS) -> Column:
    return as_float(decibel(_d(re) * _d(re) + _d(im) * _d(im), eps), finite(re, im) & mask_ok(mask))


def phase(re: Column, im: Column, mask: Column | None = None) -> Column:
    return as_float(F.atan2(_d(im), _d(re)), finite(re, im) & mask_ok(mask))


def real_part(re: Column, im: Column, mask: Column | None = None) -> Column:
    return as_float(re, finite(re, im) & mask_ok(mask))


def imaginary_part(re: Column, im: Column, mask: Column | None = None) -> Column:
    return as_float(im, finite(re, im) & mask_ok(mask))


def linear(v: Column, mask: Column | None = None) -> Column:
    return as_float(v, finite(v) & (v >= 0) & mask_ok(mask))


def linear_db(v: Column, mask: Column | None = None, eps: float = EPS) -> Column:
    return as_float(decibel(v, eps), finite(v) & (v >= 0) & mask_ok(mask))


def correlation(re: Column, im: Column, cii: Column, cjj: Column, mask: Column | None = None, eps: float = EPS) -> Column:
    """|Cij| / sqrt(max(Cii Cjj, eps)), not clamped to 1."""
    ok = finite(re, im, cii, cjj) & (cii >= 0) & (cjj >= 0) & mask_ok(mask)
    top = F.sqrt(_d(re) * _d(re) + _d(im) * _d(im))
    return as_float(top / F.sqrt(F.greatest(_d(cii) * _d(cjj), F.lit(checked_eps(eps)))), ok)


COMPLEX_MODES: dict[str, Callable] = {"amplitude": amplitude, "power": power, "power_db": power_db, "phase": phase, "real": real_part, "imaginary": imaginary_part}
REAL_MODES: dict[str, Callable] = {"linear": linear, "power_db": linear_db}
CROSS_MODES: dict[str, Callable] = {"amplitude": amplitude, "phase": phase}
#: Modes by kind of layer, in the order offered; power_db is the default where there is one.
MODES = {"gslc_polarization": COMPLEX_MODES, "gcov_diagonal_covariance": REAL_MODES, "gcov_off_diagonal_covariance": CROSS_MODES}


def modes_for(layer_kind: str) -> tuple[str, ...]:
    return tuple(MODES.get(layer_kind, ()))


def default_mode(layer_kind: str) -> str:
    modes = modes_for(layer_kind)
    if not modes:
        raise ValueError(f"{layer_kind} layers can't be transformed")
    return "power_db" if "power_db" in modes else modes[0]


def apply_mode(layer_kind: str, mode: str, *cols: Column, mask: Column | None = None) -> Column:
    if mode not in modes_for(layer_kind):
        raise ValueError(f"{layer_kind} layers have no mode {mode!r}")
    return MODES[layer_kind][mode](*cols, mask=mask)
