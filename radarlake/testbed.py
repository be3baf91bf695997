"""Rasters derived from relational tables, for queries, tests and benchmarks.

slc is a complex image (embeddings as rows of 32 samples). hhhh, hvhv, vvvv, hhvv and
mask share a grid 128 wide over order keys, dense to its last row; orders without
lines have no covariance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, re, im)"""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), "embedding")
    pair = F.struct(*(F.try_element_at("embedding", 2 * F.col("j") + k).alias(n) for k, n in ((1, "re"), (2, "im"))))
    got = e.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(31)))).select("row", F.col("j").alias("col"), pair.alias("s"))
    return got.select("row", "col", "s.re", "s.im")


def _grid(df: DataFrame, key: str) -> list:
    return [F.expr(f"{key} div {WIDTH}").alias("row"), (F.col(key) % WIDTH).cast("int").alias("col")]


def _orders(spark: SparkSession, sf_dir: str, first_row: int) -> DataFrame:
    """Orders from a raster row on: a range of keys, by which row groups are pruned."""
    o = table(spark, sf_dir, "orders")
    return o.filter(F.col("o_orderkey") >= first_row * WIDTH) if first_row else o


def orders_layer(spark: SparkSession, sf_dir: str, first_row: int = 0) -> DataFrame:
    """hhhh: (row, col, hhhh)"""
    o = _orders(spark, sf_dir, first_row)
    return o.select(*_grid(o, "o_orderkey"), (F.col("o_totalprice") / F.lit(1e5)).cast("float").alias("hhhh"))


def mask(spark: SparkSession, sf_dir: str, first_row: int = 0) -> DataFrame:
    """(row, col, mask)"""
    o = _orders(spark, sf_dir, first_row)
    return o.select(*_grid(o, "o_orderkey"), (F.col("o_orderkey") % 256).cast("smallint").alias("mask"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: largest and least price, largest tax and discount."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("top"), F.min("l_extendedprice").alias("low"), F.max("l_tax").alias("tax"), F.max("l_discount").alias("disc"))


def covariance(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """hvhv, vvvv (row, col, v) and hhvv (row, col, re, im), each a layer of its own."""
    li = lines(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    cross = o.join(li, o.o_orderkey == li.l_orderkey)
    return {
        "hvhv": li.select(*_grid(li, "l_orderkey"), (F.col("top") / F.lit(1e5)).cast("float").alias("hvhv")),
        "vvvv": li.select(*_grid(li, "l_orderkey"), (F.col("low") / F.lit(1e5)).cast("float").alias("vvvv")),
        "hhvv": cross.select(*_grid(cross, "o_orderkey"), (F.col("top") / F.lit(1e5) - F.col("o_totalprice") / F.lit(4e5)).cast("float").alias("re"), (F.col("tax") - F.col("disc")).cast("float").alias("im")),
    }


def gcov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms of an order in one row: what aligned() of the layers gives, in one join.

    One aggregate by order key and one join on it; the shuffle by order key serves both.
    """
    li = lines(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    j = o.join(li, o.o_orderkey == li.l_orderkey)
    f = lambda c: c.cast("float")
    return j.select(
        *_grid(j, "o_orderkey"), f(F.col("o_totalprice") / F.lit(1e5)).alias("hhhh"), f(F.col("top") / F.lit(1e5)).alias("hvhv"), f(F.col("low") / F.lit(1e5)).alias("vvvv"),
        f(F.col("top") / F.lit(1e5) - F.col("o_totalprice") / F.lit(4e5)).alias("re"), f(F.col("tax") - F.col("disc")).alias("im"), (F.col("o_orderkey") % 256).cast("smallint").alias("mask"),
    )


def dense_hhhh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hhhh and mask on the full grid, NULL where nothing is stored."""
    o = table(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderkey")).first()[0]
    cells = spark.range((last // WIDTH + 1) * WIDTH).withColumnRenamed("id", "k")
    got = cells.join(o.select("o_orderkey", "o_totalprice"), F.col("k") == F.col("o_orderkey"), "left")
    return got.select(F.expr(f"k div {WIDTH}").alias("row"), (F.col("k") % WIDTH).cast("int").alias("col"), (F.col("o_totalprice") / F.lit(1e5)).cast("float").alias("hhhh"), F.when(F.col("o_orderkey").isNotNull(), (F.col("k") % 256).cast("smallint")).alias("mask"))


def events_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, value): a non-negative field for decibels."""
    e = table(spark, sf_dir, "events")
    return e.select(*_grid(e, "event_id"), F.col("value").cast("float").alias("value"))
