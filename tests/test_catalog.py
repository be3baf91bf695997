"""Catalog rules and reasons, requests as streams, the scene builder."""

import json

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from radarlake import registry
from radarlake import testbed as tb
from radarlake.scene import Layer, Scene
from radarlake.sources import catalog as cat
from radarlake.streaming.requests import PageWorker, latest


@pytest.fixture(scope="module")
def product(spark):
    ds, fr = registry.product(spark)
    return ds.cache(), fr.cache()


def reasons(product, change=None, name="A"):
    ds, fr = product
    return cat.pauli_capabilities(change(ds) if change else ds, fr).filter(F.col("frequency") == name).first()


def swap(path, **cols):
    def f(ds):
        for k, v in cols.items():
            ds = ds.withColumn(k, F.when(F.endswith(F.col("path"), F.lit(path)), v).otherwise(F.col(k)))
        return ds

    return f


def test_pauli_reasons(product):
    ok = reasons(product)
    assert ok["available"] and ok["reason"] == "" and ok["mask_path"].endswith("frequencyA/mask")
    assert reasons(product, name="B")["reason"] == "missing HVHV covariance term; missing HHVV covariance term"
    a = "frequencyA/"
    assert reasons(product, swap(a + "VVVV", units=F.lit("dB")))["reason"] == "Pauli covariance terms use incompatible units"
    assert reasons(product, swap(a + "VVVV", rows=F.lit(41).cast("long")))["reason"] == "Pauli covariance terms have different dimensions"
    assert reasons(product, swap(a + "HVHV", grid_mapping=F.lit("other")))["reason"] == "Pauli covariance terms use different grid mappings"
    assert reasons(product, swap(a + "mask", rows=F.lit(41).cast("long")))["reason"] == "Pauli sibling mask is unreadable or grid-incompatible"
    double = F.struct(F.lit("float").alias("kind"), F.lit(8).alias("bytes"), F.lit(True).alias("readable"))
    assert reasons(product, swap(a + "HVHV", dtype=double))["reason"] == "HVHV must be a readable float32 diagonal covariance"
    assert "HHVV must be a readable complex64" in reasons(product, swap(a + "HHVV", dtype=double))["reason"]
    ds, fr = product
    bad = fr.withColumn("x", F.struct(F.col("x.count"), F.col("x.first"), F.col("x.last"), F.lit(0.0).alias("spacing")))
    assert cat.pauli_capabilities(ds, bad).filter("frequency = 'A'").first()["reason"] == "frequency grid coordinate metadata is incomplete"


def test_lookups_and_identification(product, spark):
    ds, fr = product
    assert cat.find_dataset(ds, registry.ROOT.lstrip("/") + "//frequencyA/HHHH/").count() == 1
    assert cat.find_frequency(fr, " a ").count() == 1
    assert cat.default_layer(ds).first()["path"].endswith("frequencyA/HHHH")
    assert [r["name"] for r in cat.frequency_rows(fr).collect()] == ["A", "B"]
    df = spark.createDataFrame([("HHHH",), ("HHVV",), ("HH",), ("HHH",), ("VVVV",)], "t string")
    assert [r[0] for r in df.select(cat.is_diagonal(F.col("t"))).collect()] == [True, False, False, False, True]
    assert cat.identification({"productType": "gcov", "granuleId": "g", "productVersion": "1"}, ["SSAR"])["instrument"] == "SSAR"
    for fields, groups in (({}, ["LSAR"]), ({"productType": "GCOV"}, ["LSAR"]), ({"productType": "GCOV", "granuleId": "g", "productVersion": "1"}, [])):
        with pytest.raises(ValueError):
            cat.identification(fields, groups)
    with pytest.raises(ValueError):
        cat.classify(ds, fr, "SLC")


def test_json(product, spark):
    ds, fr = product
    got = {r["frequency"]: json.loads(r["json"]) for r in cat.product_json(ds, fr).collect()}
    assert got["A"]["grid"]["rows"] == 40 and len(got["A"]["layers"]) == 6 and got["A"]["layers"][0]["name"] == "HHHH"
    df = spark.createDataFrame([(float("nan"),), (float("-inf"),), (1.5,), (None,)], "v double")
    assert [r[0] for r in df.select(cat.number_json(F.col("v"))).collect()] == ['"NaN"', '"-Infinity"', "1.5", "null"]


def test_latest_request_stream(spark, tmp_path):
    rows = [("a", 1, "x"), ("b", 5, "p"), ("a", 3, "z"), ("a", 2, "y")]
    spark.createDataFrame(rows, "viewer string, serial long, request string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("viewer string, serial long, request string").parquet(str(tmp_path / "in"))
    q = latest(stream).writeStream.outputMode("complete").format("memory").queryName("latest_requests").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("latest_requests").collect())) == [("a", 3, "z"), ("b", 5, "p")]


def test_page_worker(spark):
    w = PageWorker(spark, lambda n: spark.range(n).count())
    w.request(10)
    last = w.request(20)
    assert w.take(60) == (last, 20)
    w.request(5)
    w.supersede()
    assert w.take(60) is None
    w.foreground(True)
    held = w.request(7)
    assert w.take(0.5) is None
    w.foreground(False)
    assert w.take(60) == (held, 7)
    w.request(-1)
    failing = PageWorker(spark, lambda n: spark.sql("SELECT raise_error('no')").collect())
    failing.request(1)
    with pytest.raises(Exception, match="no"):
        failing.take(60)


def test_scene(spark):
    n = tb.table(spark, SMALL, "orders").count()
    shape = (-(-n // tb.WIDTH), tb.WIDTH)
    layer = Layer("A_HHHH", "gcov_diagonal_covariance", tb.dense_hhhh(spark, SMALL).withColumnRenamed("hhhh", "v"), shape)
    scene = Scene(spark, [layer])
    view = scene.layer("A_HHHH").window(0, 0, *shape)
    assert view.plan.window is None and hash(view.plan) == hash(scene.layer("A_HHHH").plan)
    part = scene.layer("A_HHHH").window(1, 2, 5, 100).transform("linear")
    assert part.pixels().count() == 500
    assert part.lod(stride=(2, 10)).speckle("lee", 3, 2.0).pixels().count() == 30
    assert part.distribution().first()["finite_count"] > 0
    assert len(scene._kept) == 2
    with pytest.raises(IndexError):
        view.window(0, 0, 10_000, 1)
    with pytest.raises(ValueError):
        scene.layer("B")
    with pytest.raises(ValueError):
        part.transform("phase")
    scene.register_views()
    assert spark.sql("SELECT count(*) AS n FROM A_HHHH WHERE v IS NOT NULL").first()["n"] == n
