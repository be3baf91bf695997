"""Golden values of the per-pixel functions and the layer algebra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from radarlake.functions import layers as la
from radarlake.functions import transforms as tx
from radarlake.functions.validity import finite, mask_ok, nan_to_null, null_to_nan

INF, NAN = float("inf"), float("nan")
MAX = float(np.finfo(np.float32).max)


def col(*names):
    return [F.col(n) for n in names]


@pytest.fixture(scope="module")
def cplx(spark):
    rows = [(0, 3.0, 4.0, 1), (1, 0.0, 0.0, 1), (2, -2.0, 2.0, 255), (3, 1.0, -1.0, 0), (4, NAN, 1.0, 1), (5, INF, 0.0, 1), (6, MAX, MAX, 1), (7, 1e-30, 0.0, 1), (8, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "i int, re float, im float, mask int")


def values(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_complex_transforms(cplx):
    a = col("re", "im", "mask")
    assert values(cplx, tx.amplitude(*a))[:6] == [5.0, 0.0, None, None, None, None]
    assert values(cplx, tx.amplitude(*a))[6] is None  # sqrt(2) times the largest float32 is none
    assert values(cplx, tx.amplitude(*a))[7] == pytest.approx(1e-30)
    assert values(cplx, tx.power(*a))[:2] == [25.0, 0.0]
    assert values(cplx, tx.power(*a))[6] is None
    db = values(cplx, tx.power_db(*a))
    assert db[0] == pytest.approx(13.9794, abs=1e-4) and db[1] == -200.0 and db[6] == pytest.approx(773.64, abs=0.1)
    assert values(cplx, tx.phase(*a))[0] == pytest.approx(math.atan2(4, 3))
    assert values(cplx, tx.real_part(*a))[8] == 1.0 and values(cplx, tx.imaginary_part(*a))[0] == 4.0


def test_diagonals(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate((1.0, 10.0, 100.0, -1.0, 0.0, -0.0, NAN))], "i int, v float")
    assert values(df, tx.linear_db(F.col("v"))) == [0.0, 10.0, 20.0, None, -200.0, -200.0, None]
    assert values(df, tx.linear(F.col("v"))) == [1.0, 10.0, 100.0, None, 0.0, 0.0, None]


def test_correlation(spark):
    cross = [(3, 4), (0, 0), (1, 0), (NAN, 1), (1, 1), (5, 12), (MAX, 0), (MAX / 2, MAX / 2)]
    cii, cjj, mask = [25, 0, -1, NAN, 100, 4, MAX, MAX], [4, 0, 4, 1, 1, 169, MAX, MAX], [1, 254, 1, 1, 255, 1, 1, 1]
    rows = [(k, float(r), float(i), float(a), float(b), m) for k, ((r, i), a, b, m) in enumerate(zip(cross, cii, cjj, mask, strict=True))]
    df = spark.createDataFrame(rows, "i int, re float, im float, cii float, cjj float, mask int")
    got = values(df, tx.correlation(*col("re", "im", "cii", "cjj", "mask"), eps=1e-12))
    assert got[0] == pytest.approx(0.5) and got[1] == 0 and got[2] is None and got[3] is None and got[4] is None
    assert got[5] == pytest.approx(0.5) and got[6] == pytest.approx(1) and got[7] == pytest.approx(math.sqrt(0.5))


def test_modes_and_eps():
    assert tx.modes_for("gslc_polarization") == ("amplitude", "power", "power_db", "phase", "real", "imaginary")
    assert tx.default_mode("gcov_diagonal_covariance") == "power_db" and tx.default_mode("gcov_off_diagonal_covariance") == "amplitude"
    for bad in (0.0, -1.0, NAN, INF):
        with pytest.raises(ValueError):
            tx.checked_eps(bad)
    with pytest.raises(ValueError):
        tx.default_mode("mask")


@pytest.mark.parametrize(("given", "want"), [
    ((1, 0, 1, 1, 0), (0, 0, 2)), ((1, 0, 1, -1, 0), (2, 0, 0)), ((0, 1, 0, 0, 0), (0, 2, 0)), ((9, 0.25, 4, 3, -7), (3.5, 0.5, 9.5)), ((1, 0, 1, 2, 0), (-1, 0, 3)),
    ((-1, 0, 1, 0, 0), None), ((1, 0, 1, 0, NAN), None), ((MAX, 0, MAX, 0, 0), None),
])
def test_pauli(spark, given, want):
    df = spark.createDataFrame([tuple(map(float, given))], "a float, b float, c float, d float, e float")
    got = df.select(*(v.alias(k) for k, v in la.pauli_powers(*col(*"abcde")).items())).first()
    assert tuple(got) == (tuple(map(float, want)) if want else (None, None, None))


def test_pauli_words(spark):
    df = spark.createDataFrame([(0, 1.0, 1e-10, 1e5), (1, None, 1.0, 1.0), (2, -1.0, 0.0, 2.0)], "i int, red float, green float, blue float")
    db = [la.pauli_db(F.col(c)) for c in ("red", "green", "blue")]
    word = values(df, la.pauli_pack(*db))
    assert [word[0] & 1023, word[0] >> 10 & 1023, word[0] >> 20 & 1023, word[0] >> 30] == [682, 0, 1023, 2]
    assert word[1] == 0 and word[2] & 1023 == 0 and word[2] >> 30 == 2
    back = df.withColumn("w", la.pauli_pack(*db)).select("i", *(v.alias(f"{k}_db") for k, v in la.pauli_unpack(F.col("w")).items())).orderBy("i").collect()
    assert back[0]["red_db"] == pytest.approx(0, abs=0.08) and back[0]["blue_db"] == pytest.approx(50) and back[1]["red_db"] is None


def test_comparisons(spark):
    rows = [(0, 3.0, 2.0), (1, None, 2.0), (2, -1.0, 2.0), (3, 1.0, 0.0), (4, 0.0, 4.0), (5, MAX, -MAX), (6, 1.0, 1.0), (7, 1.0, 1e-21)]
    df = spark.createDataFrame(rows, "i int, a float, b float")
    a, b = col("a", "b")
    assert values(df, la.difference(a, b))[:5] == [1.0, None, -3.0, 1.0, -4.0] and values(df, la.difference(a, b))[5] is None
    assert math.copysign(1, values(df, la.difference(a, b))[6]) == 1
    assert values(df, la.ratio(a, b)) == [1.5, None, None, None, 0.0, None, 1.0, None]
    assert values(df, la.ratio_db(a, b))[4] == -200.0


def test_bfloat16_round_trip_of_all_words():
    words = np.arange(1 << 16, dtype=np.uint16)
    v = la.bf16_values(words)
    again = la.bf16_bits(v)
    ok = ~np.isnan(v)
    assert (again[ok] == words[ok]).all() and (again[~ok] == 0x7FC0).all()


@pytest.mark.parametrize(("v", "bits"), [(MAX, 0x7F7F), (-MAX, 0xFF7F), (1.00390625, 0x3F80), (1.01171875, 0x3F82), (INF, 0x7F80), (NAN, 0x7FC0), (1.0, 0x3F80), (-2.0, 0xC000), (0.0, 0)])
def test_bfloat16_values(v, bits):
    assert int(la.bf16_bits(np.array([v], dtype=np.float32))[0]) == bits


def test_pairs(spark):
    df = spark.createDataFrame([(0, 1.0, -2.0), (1, None, 4.0)], "i int, a float, b float")
    got = df.withColumn("w", la.pair_pack(*col("a", "b")))
    assert values(got, F.col("w"))[0] == 0xC0003F80
    back = got.select("i", *(v.alias(f"{k}2") for k, v in la.pair_unpack(F.col("w")).items())).orderBy("i").collect()
    assert tuple(back[0])[1:] == (1.0, -2.0) and tuple(back[1])[1:] == (None, 4.0)


def test_validity(spark):
    df = spark.createDataFrame([(0, 1.0, 1), (1, NAN, 0), (2, INF, 255), (3, None, 254), (4, -0.0, None)], "i int, v float, m int")
    assert values(df, finite(F.col("v"))) == [True, False, False, False, True]
    assert values(df, mask_ok(F.col("m"))) == [True, False, False, True, True]
    assert values(df, nan_to_null(F.col("v"))) == [1.0, None, None, None, -0.0]
    assert math.isnan(values(df, null_to_nan(F.col("v")))[3])
