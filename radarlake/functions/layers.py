"""Algebra over several aligned layers: Pauli powers, comparisons, 32-bit transports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radarlake.functions.transforms import EPS, decibel
from radarlake.functions.validity import as_float, finite

#: The range of packed Pauli decibels, its codes, and the tag of a valid word.
DB_LOW, DB_HIGH, CODES, TAG = -100.0, 50.0, 1023, 2
WORD_MASK = (1 << 32) - 1


def _f(x: float) -> Column:
    return F.lit(x).cast("float")


def pauli_powers(hhhh: Column, hvhv: Column, vvvv: Column, re: Column, im: Column) -> dict[str, Column]:
    """Red (double bounce), green (volume) and blue (surface) powers in float32; all or none are valid."""
    ok = finite(hhhh, hvhv, vvvv, re, im) & (hhhh >= 0) & (hvhv >= 0) & (vvvv >= 0)
    both, twice = hhhh + vvvv, _f(2.0) * re
    out = {"red": _f(0.5) * (both - twice), "green": _f(2.0) * hvhv, "blue": _f(0.5) * (both + twice)}
    ok = ok & finite(*out.values())
    return {k: F.when(ok, v) for k, v in out.items()}


def pauli_display(power: Column) -> Column:
    """Negative powers (from rounding of the cross term) show as 0."""
    return F.when(power.isNotNull(), F.greatest(power, _f(0.0)))


def pauli_db(power: Column) -> Column:
    db = F.lit(10e0) * F.log10(F.when(power > 0, power.cast("double")))
    return F.when(power.isNotNull(), F.when(power <= 0, F.lit(DB_LOW)).otherwise(F.greatest(F.least(db, F.lit(DB_HIGH)), F.lit(DB_LOW)))).cast("float")


def _code(db: Column) -> Column:
    return F.floor((db.cast("double") - DB_LOW) * CODES / (DB_HIGH - DB_LOW) + 0.5).cast("long")


def pauli_pack(red_db: Column, green_db: Column, blue_db: Column) -> Column:
    """Three codes of 10 bits and the tag; an invalid pixel is the word 0."""
    word = _code(red_db) + F.shiftleft(_code(green_db), 10) + F.shiftleft(_code(blue_db), 20) + F.lit(TAG << 30)
    return F.coalesce(word, F.lit(0).cast("long"))


def pauli_unpack(word: Column) -> dict[str, Column]:
    ok = F.shiftright(word, 30) == TAG
    step = (DB_HIGH - DB_LOW) / CODES
    return {k: F.when(ok, F.lit(DB_LOW) + F.shiftright(word, s).bitwiseAND(F.lit(CODES)) * F.lit(step)).cast("float") for k, s in (("red", 0), ("green", 10), ("blue", 20))}


def difference(a: Column, b: Column) -> Column:
    """a - b in float32 where both are valid; -0 becomes +0."""
    d = a.cast("float") - b.cast("float")
    return F.when(finite(a, b) & finite(d), d + _f(0.0))


def ratio(a: Column, b: Column, eps: float = EPS) -> Column:
    """a / b where a is not negative and b above eps."""
    ok = finite(a, b) & (a >= 0) & (b.cast("double") > eps)
    return as_float(F.when(ok, a.cast("double") / F.when(ok, b.cast("double"))))


def ratio_db(a: Column, b: Column, eps: float = EPS) -> Column:
    r = ratio(a, b, eps)
    return F.when(r.isNotNull(), decibel(r, eps).cast("float"))


def bf16_bits(values: np.ndarray) -> np.ndarray:
    """bfloat16 words of float32 values: round half to even, finite values never become infinite."""
    v = np.asarray(values, dtype=np.float32)
    bits = v.view(np.uint32)
    up = (bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))) >> np.uint32(16)
    out = up.astype(np.uint16)
    sign = (bits >> np.uint32(16)).astype(np.uint16) & np.uint16(0x8000)
    out = np.where(np.isfinite(v) & ((out & np.uint16(0x7FFF)) >= 0x7F80), sign | np.uint16(0x7F7F), out)
    out = np.where(np.isinf(v), sign | np.uint16(0x7F80), out)
    return np.where(np.isnan(v), np.uint16(0x7FC0), out).astype(np.uint16)


def bf16_values(bits: np.ndarray) -> np.ndarray:
    return (np.asarray(bits, dtype=np.uint32) << np.uint32(16)).view(np.float32)


@F.pandas_udf(T.LongType())
def encode_bf16(v: pd.Series) -> pd.Series:
    """A float32 column (NULL: NaN) as bfloat16 words."""
    return pd.Series(bf16_bits(v.to_numpy(dtype=np.float32, na_value=np.nan)).astype(np.int64))


@F.pandas_udf(T.FloatType())
def decode_bf16(bits: pd.Series) -> pd.Series:
    got = pd.Series(bf16_values(bits.to_numpy(dtype=np.int64).astype(np.uint32)))
    return got.where(np.isfinite(got), None)


def pair_pack(a: Column, b: Column) -> Column:
    """Two bfloat16 words in one of 32 bits, A in the low half."""
    return encode_bf16(a.cast("float")) + F.shiftleft(encode_bf16(b.cast("float")), 16)


def pair_unpack(word: Column) -> dict[str, Column]:
    return {"a": decode_bf16(word.bitwiseAND(F.lit(0xFFFF))), "b": decode_bf16(F.shiftright(word, 16).bitwiseAND(F.lit(0xFFFF)))}
