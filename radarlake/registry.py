"""Registered raster queries over the derived rasters, each with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radarlake import testbed as tb
from radarlake.functions import layers as la
from radarlake.functions import transforms as tx
from radarlake.functions.validity import finite, mask_ok
from radarlake.operators import chunked, display, distribution, scan, speckle
from radarlake.plans import geometry as geo
from radarlake.session import workers_can_import
from radarlake.sources import catalog as cat
from radarlake.sources import chunks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rasters of radarlake.testbed in SQL.
WITH = """WITH slc AS (SELECT vec_id AS "row", CAST(j AS INTEGER) AS col, embedding[2*j+1] AS re, embedding[2*j+2] AS im, CAST((vec_id*32+j) % 256 AS SMALLINT) AS mask
  FROM embeddings, (SELECT unnest(range(32)) AS j) js),
li AS (SELECT l_orderkey, max(l_extendedprice) AS top, min(l_extendedprice) AS low, max(l_tax) AS tax, max(l_discount) AS disc FROM lineitem GROUP BY l_orderkey),
px AS (SELECT o_orderkey // 128 AS "row", CAST(o_orderkey % 128 AS INTEGER) AS col, CAST(o_totalprice/1e5 AS FLOAT) AS hhhh, CAST(o_orderkey % 256 AS SMALLINT) AS mask, o_orderkey, o_totalprice FROM orders),
gcov AS (SELECT "row", col, hhhh, CAST(top/1e5 AS FLOAT) AS hvhv, CAST(low/1e5 AS FLOAT) AS vvvv, CAST(top/1e5 - o_totalprice/4e5 AS FLOAT) AS re, CAST(tax - disc AS FLOAT) AS im, mask FROM px JOIN li ON o_orderkey = l_orderkey),
dense AS (SELECT k // 128 AS "row", CAST(k % 128 AS INTEGER) AS col, hhhh, mask FROM (SELECT unnest(range(((SELECT max(o_orderkey) FROM orders) // 128 + 1) * 128)) AS k) g LEFT JOIN px ON o_orderkey = k)
"""


def query(name: str, sql: str | None = None, using: str = WITH):
    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_can_import(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = using + sql
        return f

    return put


def c(name: str):
    return F.col(name)


def slc(spark, d):
    return tb.slc(spark, d).withColumn("mask", ((c("row") * 32 + c("col")) % 256).cast("smallint"))


# --- scans

CHUNK = (16, 8)
#: The middle of the image, and that window grown to chunk borders.
MIDDLE = ', n AS (SELECT count(*) AS n FROM embeddings), w AS (SELECT n, n // 10 AS r0, n // 10 + n * 8 // 10 AS r1 FROM n)'
IN_MIDDLE = '"row" >= r0 AND "row" < r1 AND col >= 4 AND col < 28'


def middle(spark, d) -> tuple[geo.Window, tuple[int, int]]:
    n = tb.table(spark, d, "embeddings").count()
    return geo.Window(n // 10, 4, n * 8 // 10, 24), (n, 32)


@query("scan_window", MIDDLE + f' SELECT "row", col, re, im, {IN_MIDDLE} AS requested FROM slc, w WHERE "row" >= r0 // 16 * 16 AND "row" < least((r1 + 15) // 16 * 16, n)')
def _(spark, d):
    w, shape = middle(spark, d)
    return scan.planned(tb.slc(spark, d), geo.read_plan(w, shape, CHUNK, 8)).select("row", "col", "re", "im", "requested")


MOSAIC = "r AS (SELECT (max(\"row\") + 1 + 7) // 8 AS n FROM px)"


def _last_mosaic(spark, d):
    rows = tb.orders_layer(spark, d).agg(F.max("row")).first()[0] + 1
    grid = geo.ChunkGrid(rows, tb.WIDTH, 8, 32)
    return geo.mosaic(grid, (grid.chunks[0] - 1, 3), 2)


@query("scan_mosaic", f', {MOSAIC} SELECT "row", col, hhhh FROM px, r WHERE "row" >= greatest(n - 2, 0) * 8 AND col >= 64')
def _(spark, d):
    w = _last_mosaic(spark, d)
    return scan.mosaic(tb.orders_layer(spark, d, w.window.row), w)


@query("scan_mosaic_masked", f', {MOSAIC} SELECT "row", col, hhhh, CASE WHEN mask NOT IN (0, 255) THEN hhhh END AS value FROM px, r WHERE "row" >= greatest(n - 2, 0) * 8 AND col >= 64')
def _(spark, d):
    w = _last_mosaic(spark, d)
    got = scan.mosaic(tb.orders_layer(spark, d, w.window.row), w, tb.mask(spark, d, w.window.row))
    return got.select("row", "col", "hhhh", F.when(mask_ok(c("mask")), c("hhhh")).alias("value"))


@query("lod_plan", """, n AS (SELECT count(*) AS n FROM embeddings), t AS (SELECT n, greatest(5e0*n/64, 10e0*32/64) AS t FROM n),
  s AS (SELECT n, CAST(greatest(ceil(t/5e0), (n+63)//64, 1) AS BIGINT) AS sr, CAST(greatest(ceil(t/10e0), 1) AS BIGINT) AS sc FROM t)
  SELECT n AS n_rows, sr AS stride_row, sc AS stride_col, (n+sr-1)//sr AS out_rows, (32+sc-1)//sc AS out_cols, ((n+sr-1)//sr)*((32+sc-1)//sc)*8 AS science_bytes, ((n+15)//16)*4 AS n_chunks FROM s""")
def _(spark, d):
    n = tb.table(spark, d, "embeddings").count()
    p = geo.overview_plan((n, 32), 8, edge=64, spacing=(-5.0, 10.0), chunk=CHUNK)
    values = {"n_rows": n, "stride_row": p.stride[0], "stride_col": p.stride[1], "out_rows": p.shape[0], "out_cols": p.shape[1], "science_bytes": p.science_bytes, "n_chunks": p.chunks}
    return spark.range(1).select(*(F.lit(v).cast("long").alias(k) for k, v in values.items()))


STRIDE = (7, 3)
ON_LATTICE = '"row" % 7 = 0 AND col % 3 = 0'


def whole(spark, d) -> geo.Window:
    return geo.Window(0, 0, tb.table(spark, d, "embeddings").count(), 32)


@query("lod_sample", f'SELECT "row" // 7 AS r, CAST(col // 3 AS BIGINT) AS c, re, im FROM slc WHERE {ON_LATTICE}')
def _(spark, d):
    return scan.sample(tb.slc(spark, d), whole(spark, d), STRIDE)


@query("lod_sample_masked", f'SELECT "row" // 7 AS r, CAST(col // 3 AS BIGINT) AS c, re, im, CASE WHEN mask NOT IN (0, 255) THEN 1 ELSE 0 END AS valid FROM slc WHERE {ON_LATTICE}')
def _(spark, d):
    return scan.sample(slc(spark, d), whole(spark, d), STRIDE).select("r", "c", "re", "im", mask_ok(c("mask")).cast("int").alias("valid"))


@query("lod_window", MIDDLE + ' SELECT ("row" - r0) // 5 AS r, CAST((col - 4) // 2 AS BIGINT) AS c, re, im FROM slc, w WHERE ' + IN_MIDDLE + ' AND ("row" - r0) % 5 = 0 AND (col - 4) % 2 = 0')
def _(spark, d):
    return scan.sample(tb.slc(spark, d), middle(spark, d)[0], (5, 2))


@query("aligned_join_4", 'SELECT "row", col, hhhh, hvhv, vvvv, re, im, mask FROM gcov')
def _(spark, d):
    cov = tb.covariance(spark, d)
    return scan.aligned([tb.orders_layer(spark, d), cov["hvhv"], cov["vvvv"], cov["hhvv"]], {"mask": tb.mask(spark, d)}).select("row", "col", "hhhh", "hvhv", "vvvv", "re", "im", "mask")


@query("aligned_join_lod", 'SELECT "row", col, hhhh, vvvv FROM gcov WHERE "row" % 3 = 0 AND col >= 5 AND (col - 5) % 5 = 0')
def _(spark, d):
    rows = tb.table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] // tb.WIDTH + 1
    where = scan.lattice(geo.Window(0, 5, rows, 123), (3, 5))
    return scan.aligned([tb.orders_layer(spark, d), tb.covariance(spark, d)["vvvv"]], where=where).select("row", "col", "hhhh", "vvvv")


@query("chunk_statistics", """, v AS (SELECT "row" // 16 AS chunk_row, CAST(col // 8 AS BIGINT) AS chunk_col, CASE WHEN mask NOT IN (0, 255) THEN re END AS v FROM slc)
  SELECT chunk_row, chunk_col, count(v) AS finite_count, count(*) - count(v) AS invalid_count, min(v) AS minimum, max(v) AS maximum FROM v GROUP BY ALL""")
def _(spark, d):
    n = tb.table(spark, d, "embeddings").count()
    stored = chunks.to_chunks(slc(spark, d).select("row", "col", tx.real_part(c("re"), c("im"), c("mask")).alias("value")), "slc", (n, 32), CHUNK)
    return chunks.statistics(stored).drop("layer")


@query("chunk_window", MIDDLE + f' SELECT "row", CAST(col AS BIGINT) AS col, re AS value FROM slc, w WHERE {IN_MIDDLE}')
def _(spark, d):
    """A window of a written chunk table: chunk numbers prune row groups, arrays are cut in Arrow."""
    w, shape = middle(spark, d)
    path = chunks.stored(spark, f"slc-re {d}", lambda: chunks.to_chunks(tb.slc(spark, d).withColumnRenamed("re", "value"), "slc", shape, CHUNK))
    return chunks.to_pixels(chunks.read(spark, path, "slc", w, CHUNK), w)


COVARIANCE = ("hhhh", "hvhv", "vvvv", "re", "mask")


def _aligned(spark, d) -> DataFrame:
    """The covariance layers as written chunk tables, side by side: one equi-join on chunk numbers."""
    rows = tb.table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] // tb.WIDTH + 1

    def layer(name: str) -> Callable[[], DataFrame]:
        return lambda: chunks.to_chunks(tb.gcov(spark, d), name, (rows, tb.WIDTH), (32, 32), (name,))

    return chunks.align({n: chunks.read(spark, chunks.stored(spark, f"{n} {d}", layer(n)), n) for n in COVARIANCE})


@query("chunk_aligned_visit", ', t AS (SELECT "row", CAST(col AS BIGINT) AS col, (hhhh + CAST(2 AS FLOAT)*hvhv) + vvvv AS value FROM gcov WHERE mask NOT IN (0, 255)) SELECT * FROM t')
def _(spark, d):
    """Total power over aligned chunks, each row of chunks visited once."""
    def total(a):
        ok = np.isfinite(a["mask"]) & (a["mask"] != 0) & (a["mask"] != 255)
        return np.where(ok, (a["hhhh"] + np.float32(2) * a["hvhv"]) + a["vvvv"], np.float32(np.nan))

    got = chunks.visit(_aligned(spark, d), total, "values").withColumn("layer", F.lit("span"))
    return chunks.to_pixels(got).filter("value IS NOT NULL")


@query("chunk_aligned_statistics", """, t AS (SELECT "row" // 32 AS chunk_row, CAST(col // 32 AS BIGINT) AS chunk_col, re - hhhh AS v FROM gcov WHERE mask NOT IN (0, 255))
  SELECT chunk_row, chunk_col, count(v) AS finite_count, min(v) AS minimum, max(v) AS maximum FROM t GROUP BY ALL""")
def _(spark, d):
    def difference(a):
        ok = np.isfinite(a["mask"]) & (a["mask"] != 0) & (a["mask"] != 255)
        return np.where(ok, a["re"] - a["hhhh"], np.float32(np.nan))

    got = chunks.visit(_aligned(spark, d), difference, "values").withColumn("layer", F.lit("difference"))
    return chunks.statistics(got).filter("finite_count > 0").select("chunk_row", "chunk_col", "finite_count", "minimum", "maximum")


# --- predicates

@query("mask_filter", 'SELECT "row", col, hhhh FROM px WHERE mask NOT IN (0, 255)')
def _(spark, d):
    return tb.orders_layer(spark, d).join(tb.mask(spark, d), ["row", "col"]).filter(mask_ok(c("mask"))).drop("mask")


@query("finite_filter", 'SELECT "row", col, hhhh FROM dense WHERE hhhh IS NOT NULL AND isfinite(hhhh)')
def _(spark, d):
    return tb.dense_hhhh(spark, d).filter(finite(c("hhhh"))).drop("mask")


@query("domain_filter", 'SELECT "row", col, re FROM gcov WHERE re >= 0')
def _(spark, d):
    return tb.gcov(spark, d).filter(finite(c("re")) & (c("re") >= 0)).select("row", "col", "re")


@query("validity_out", 'SELECT "row", col, CASE WHEN mask NOT IN (0, 255) AND hhhh >= 0 THEN 1 ELSE 0 END AS valid FROM px')
def _(spark, d):
    got = tb.orders_layer(spark, d).join(tb.mask(spark, d), ["row", "col"])
    return got.select("row", "col", tx.linear(c("hhhh"), c("mask")).isNotNull().cast("int").alias("valid"))


# --- transforms

P = "CAST(re AS DOUBLE)*CAST(re AS DOUBLE)+CAST(im AS DOUBLE)*CAST(im AS DOUBLE)"
COMPLEX_SQL = {"amplitude": f"sqrt({P})", "power": P, "power_db": f"10e0*log10(greatest({P}, 1e-20))", "phase": "atan2(CAST(im AS DOUBLE), CAST(re AS DOUBLE))", "real": "re", "imag": "im"}


def _complex(name: str, f: Callable, expr: str) -> None:
    @query(f"tx_{name}", f'SELECT "row", col, CAST(CASE WHEN mask NOT IN (0, 255) THEN {expr} END AS FLOAT) AS value FROM slc')
    def _(spark, d):
        return slc(spark, d).select("row", "col", f(c("re"), c("im"), c("mask")).alias("value"))


for _name, _f in (("amplitude", tx.amplitude), ("power", tx.power), ("power_db", tx.power_db), ("phase", tx.phase), ("real", tx.real_part), ("imag", tx.imaginary_part)):
    _complex(_name, _f, COMPLEX_SQL[_name])


def _real(name: str, f: Callable, expr: str) -> None:
    @query(f"tx_{name}", f'SELECT "row", col, CAST(CASE WHEN mask NOT IN (0, 255) AND hhhh >= 0 THEN {expr} END AS FLOAT) AS value FROM px')
    def _(spark, d):
        got = tb.orders_layer(spark, d).join(tb.mask(spark, d), ["row", "col"])
        return got.select("row", "col", f(c("hhhh"), c("mask")).alias("value"))


_real("linear", tx.linear, "hhhh")
_real("linear_db", tx.linear_db, "10e0*log10(greatest(CAST(hhhh AS DOUBLE), 1e-20))")


@query("tx_cross_magnitude", f'SELECT "row", col, CAST(CASE WHEN mask NOT IN (0, 255) THEN sqrt({P}) END AS FLOAT) AS magnitude, CAST(CASE WHEN mask NOT IN (0, 255) THEN atan2(CAST(im AS DOUBLE), CAST(re AS DOUBLE)) END AS FLOAT) AS phase FROM gcov')
def _(spark, d):
    a = c("re"), c("im"), c("mask")
    return tb.gcov(spark, d).select("row", "col", tx.amplitude(*a).alias("magnitude"), tx.phase(*a).alias("phase"))


@query("tx_correlation", f'SELECT "row", col, CAST(CASE WHEN mask NOT IN (0, 255) THEN sqrt({P}) / sqrt(greatest(CAST(hhhh AS DOUBLE)*CAST(vvvv AS DOUBLE), 1e-20)) END AS FLOAT) AS value FROM gcov')
def _(spark, d):
    return tb.gcov(spark, d).select("row", "col", tx.correlation(c("re"), c("im"), c("hhhh"), c("vvvv"), c("mask")).alias("value"))


# --- layer algebra

PAULI = """, p AS (SELECT "row", col, CAST(0.5 AS FLOAT)*((hhhh+vvvv)-CAST(2 AS FLOAT)*re) AS red, CAST(2 AS FLOAT)*hvhv AS green, CAST(0.5 AS FLOAT)*((hhhh+vvvv)+CAST(2 AS FLOAT)*re) AS blue FROM gcov WHERE mask NOT IN (0, 255))"""
DB = lambda x: f"CAST(CASE WHEN {x} <= 0 THEN -100e0 ELSE greatest(least(10e0*log10(CASE WHEN {x} > 0 THEN CAST({x} AS DOUBLE) ELSE 1e0 END), 50e0), -100e0) END AS FLOAT)"


def pauli(spark, d) -> DataFrame:
    rgb = la.pauli_powers(c("hhhh"), c("hvhv"), c("vvvv"), c("re"), c("im"))
    return tb.gcov(spark, d).filter(mask_ok(c("mask"))).select("row", "col", *(v.alias(k) for k, v in rgb.items()))


def _rgb(df: DataFrame, f: Callable) -> DataFrame:
    return df.select("row", "col", *(f(c(k)).alias(k) for k in ("red", "green", "blue")))


@query("pauli_powers", PAULI + ' SELECT "row", col, red, green, blue FROM p')
def _(spark, d):
    return pauli(spark, d)


@query("pauli_display", PAULI + ' SELECT "row", col, greatest(red, CAST(0 AS FLOAT)) AS red, greatest(green, CAST(0 AS FLOAT)) AS green, greatest(blue, CAST(0 AS FLOAT)) AS blue FROM p')
def _(spark, d):
    return _rgb(pauli(spark, d), la.pauli_display)


@query("pauli_db", PAULI + f' SELECT "row", col, {DB("red")} AS red, {DB("green")} AS green, {DB("blue")} AS blue FROM p')
def _(spark, d):
    return _rgb(pauli(spark, d), la.pauli_db)


CODE = lambda x: f"CAST(floor((CAST({DB(x)} AS DOUBLE)+100e0)*1023e0/150e0+0.5e0) AS BIGINT)"
WORD = f"({CODE('red')} + {CODE('green')}*1024 + {CODE('blue')}*1048576 + 2147483648)"


@query("pauli_pack", PAULI + f' SELECT "row", col, {WORD} AS word FROM p')
def _(spark, d):
    p = _rgb(pauli(spark, d), la.pauli_db)
    return p.select("row", "col", la.pauli_pack(c("red"), c("green"), c("blue")).alias("word"))


VALID = 'FROM gcov WHERE mask NOT IN (0, 255)'


def pair(spark, d) -> DataFrame:
    return tb.gcov(spark, d).filter(mask_ok(c("mask"))).select("row", "col", tx.linear(c("hhhh")).alias("a"), tx.linear(c("re")).alias("b"))


@query("cmp_pair", f'SELECT "row", col, hhhh AS a, CASE WHEN re >= 0 THEN re END AS b {VALID}')
def _(spark, d):
    return pair(spark, d)


@query("cmp_difference", f'SELECT "row", col, CASE WHEN re >= 0 THEN hhhh - re + CAST(0 AS FLOAT) END AS value {VALID}')
def _(spark, d):
    return pair(spark, d).select("row", "col", la.difference(c("a"), c("b")).alias("value"))


RATIO = "CAST(CASE WHEN re > 1e-20 THEN CAST(hhhh AS DOUBLE) / CAST(nullif(re, 0) AS DOUBLE) END AS FLOAT)"


@query("cmp_ratio", f'SELECT "row", col, {RATIO} AS value {VALID}')
def _(spark, d):
    return pair(spark, d).select("row", "col", la.ratio(c("a"), c("b")).alias("value"))


@query("cmp_ratio_db", f'SELECT "row", col, CAST(CASE WHEN re > 1e-20 THEN 10e0*log10(greatest(CAST({RATIO} AS DOUBLE), 1e-20)) END AS FLOAT) AS value {VALID}')
def _(spark, d):
    return pair(spark, d).select("row", "col", la.ratio_db(c("a"), c("b")).alias("value"))


# bfloat16 of a positive normal float: eight significant bits, half to even
MANT = lambda x, e: f"(CAST({x} AS DOUBLE) / pow(2e0, {e} - 7))"


def _bits(x: str, sign: str) -> str:
    e = f"floor(log2(CAST({x} AS DOUBLE)))"
    m = MANT(x, e)
    whole = f"floor({m})"
    up = f"CASE WHEN {m} - {whole} > 0.5e0 OR ({m} - {whole} = 0.5e0 AND CAST({whole} AS BIGINT) % 2 = 1) THEN 1 ELSE 0 END"
    return f"CASE WHEN {x} IS NULL THEN 32704 WHEN {x} = 0 THEN 0 ELSE CAST(({e} + 126) * 128 + {whole} AS BIGINT) + {up} + {sign} END"


@query("cmp_bf16", f'SELECT "row", col, CAST({_bits("hhhh", "0")} AS BIGINT) AS a, CAST({_bits("(CASE WHEN re > 0 THEN re END)", "0")} AS BIGINT) AS b {VALID}')
def _(spark, d):
    p = pair(spark, d).withColumn("b", F.when(c("b") > 0, c("b")))
    return p.select("row", "col", la.encode_bf16(c("a")).alias("a"), la.encode_bf16(c("b")).alias("b"))


@query("cmp_pack", f'SELECT "row", col, CAST({_bits("hhhh", "0")} + ({_bits("(CASE WHEN re > 0 THEN re END)", "0")}) * 65536 AS BIGINT) AS word {VALID}')
def _(spark, d):
    p = pair(spark, d).withColumn("b", F.when(c("b") > 0, c("b")))
    return p.select("row", "col", la.pair_pack(c("a"), c("b")).alias("word"))


# --- distribution

FIELD = ', f AS (SELECT "row", col, CAST(CASE WHEN mask NOT IN (0, 255) THEN 10e0*log10(greatest(CAST(hhhh AS DOUBLE), 1e-20)) END AS FLOAT) AS v FROM dense), e AS (SELECT min(v) AS lo, max(v) AS hi FROM f)'
BIN = "CASE WHEN hi > lo THEN CAST(greatest(least(floor((CAST(v AS DOUBLE)-lo)*256e0/(CAST(hi AS DOUBLE)-lo)), 255), 0) AS INTEGER) ELSE 128 END"
HIST = FIELD + f', h AS (SELECT {BIN} AS bin, count(*) AS n FROM f, e WHERE v IS NOT NULL GROUP BY 1)'


def field(spark, d) -> DataFrame:
    return tb.dense_hhhh(spark, d).select("row", "col", tx.linear_db(c("hhhh"), c("mask")).alias("value"))


@query("dist_counts", FIELD + ' SELECT count(v) AS finite_count, count(*) - count(v) AS invalid_count, min(v) AS minimum, max(v) AS maximum FROM f')
def _(spark, d):
    return distribution.counts(field(spark, d))


@query("dist_counts_by_chunk", FIELD + ' SELECT "row" // 32 AS chunk_row, count(v) AS finite_count, count(*) - count(v) AS invalid_count, min(v) AS minimum, max(v) AS maximum FROM f GROUP BY 1')
def _(spark, d):
    return distribution.counts(field(spark, d).withColumn("chunk_row", F.expr("row div 32")), by=["chunk_row"])


@query("dist_histogram", HIST + ' SELECT bin, n AS "count" FROM h')
def _(spark, d):
    return distribution.histogram(field(spark, d))


def _quantiles() -> str:
    parts = []
    for name, q in distribution.QUANTILES:
        parts.append(f"""(SELECT CAST(greatest(least(CAST(lo + ((bin + greatest(least(({q}e0*(tot-1) - before + 0.5e0)/n, 1e0), 0e0))/256e0)*(CAST(hi AS DOUBLE)-CAST(lo AS DOUBLE)) AS FLOAT), hi), lo) AS FLOAT)
          FROM b, e WHERE before + n > {q}e0*(tot-1) ORDER BY bin LIMIT 1) AS {name}""")
    return ", b AS (SELECT bin, n, sum(n) OVER (ORDER BY bin) - n AS before, sum(n) OVER () AS tot FROM h) SELECT " + ", ".join(parts)


@query("dist_percentiles", HIST + _quantiles())
def _(spark, d):
    return distribution.summary(field(spark, d)).select(*(n for n, _ in distribution.QUANTILES))


@query("dist_auto_window", HIST + ", q AS (" + _quantiles().replace(", b AS (", "WITH b AS (", 1) + ") SELECT lo AS full_low, hi AS full_high, p1 AS p1_99_low, p99 AS p1_99_high, p2 AS p2_98_low, p98 AS p2_98_high FROM q, e")
def _(spark, d):
    return distribution.auto_window_columns(distribution.summary(field(spark, d)))


@query("dist_log_hist", HIST + ' SELECT bin, n AS "count", round(ln(1e0 + n), 9) AS log_count, round(CAST(lo AS DOUBLE) + bin*((CAST(hi AS DOUBLE)-CAST(lo AS DOUBLE))/256e0), 9) AS low FROM h, e')
def _(spark, d):
    got = distribution.log_histogram(field(spark, d))
    return got.select("bin", "count", F.round("log_count", 9).alias("log_count"), F.round("low", 9).alias("low"))


# --- speckle

def _near(size: int, power: str, src: str = "dense", valid: str = "mask NOT IN (0, 255)") -> str:
    r = size // 2
    return f""", pw AS (SELECT "row", col, CASE WHEN {valid} THEN {power} END AS p FROM {src}),
  o AS (SELECT a AS dr, b AS dc FROM (SELECT unnest(range(-{r}, {r + 1})) AS a) x, (SELECT unnest(range(-{r}, {r + 1})) AS b) y),
  s AS (SELECT k."row", k.col, any_value(k.p) AS p, avg(m.p) AS mean, greatest(sum(m.p*m.p)/count(m.p) - avg(m.p)*avg(m.p), 0e0) AS var
        FROM (SELECT pw.*, "row" + dr AS nr, col + dc AS nc FROM pw, o) k LEFT JOIN pw m ON m."row" = k.nr AND m.col = k.nc GROUP BY k."row", k.col)"""


def _lee(enl: float) -> str:
    return f"mean + CASE WHEN var > mean*mean/{enl}e0 AND var > 0 THEN (var - mean*mean/{enl}e0)/var ELSE 0e0 END * (p - mean)"


LINEAR = "CAST(hhhh AS DOUBLE)"


def _speckle(name: str, kind: str, size: int, sql: str, make: Callable, enl: float = 3.0, domain: str = "power") -> None:
    @query(name, sql)
    def _(spark, d):
        got = speckle.filtered_sql(make(spark, d), kind, size, enl, domain)
        return got.select("row", "col", F.round("value", 6).alias("value"))


def linear_field(spark, d) -> DataFrame:
    return tb.dense_hhhh(spark, d).select("row", "col", tx.linear(c("hhhh"), c("mask")).alias("value"))


OUT = lambda x: f' SELECT "row", col, round(CASE WHEN p IS NOT NULL THEN {x} END, 6) AS value FROM s'
for _k in speckle.SIZES:
    _speckle(f"speckle_boxcar_{_k}", "boxcar", _k, _near(_k, LINEAR) + OUT("mean"), linear_field)
    _speckle(f"speckle_lee_{_k}", "lee", _k, _near(_k, LINEAR) + OUT(f"greatest({_lee(3)}, 0e0)"), linear_field)
_speckle("speckle_none", "none", 3, ', z AS (SELECT 1) SELECT "row", col, round(CASE WHEN mask NOT IN (0, 255) THEN CAST(hhhh AS DOUBLE) END, 6) AS value FROM dense', linear_field)
_speckle("speckle_amp", "boxcar", 3, _near(3, f"CAST(CAST(sqrt({P}) AS FLOAT) AS DOUBLE)*CAST(CAST(sqrt({P}) AS FLOAT) AS DOUBLE)", "slc") + OUT("sqrt(mean)"), lambda spark, d: slc(spark, d).select("row", "col", tx.amplitude(c("re"), c("im"), c("mask")).alias("value")), domain="amplitude")
_DBV = "CAST(CAST(10e0*log10(greatest(CAST(hhhh AS DOUBLE), 1e-20)) AS FLOAT) AS DOUBLE)"
_speckle("speckle_db", "lee", 3, _near(3, f"pow(10e0, {_DBV}/10e0)") + OUT(f"10e0*log10(greatest({_lee(3)}, 1e-20))"), field, domain="power_db")


def _float32(size: int, kind: str, enl: float = 3.0) -> str:
    """The float32 kernel in SQL: each neighbour in turn updates count, mean and squares (Welford), as FLOAT."""
    r = size // 2
    f, span = "CAST({} AS FLOAT)".format, range(-r, r + 1)
    shift = lambda x, k, over: f"lag({x}, {-k}) OVER ({over})" if k < 0 else f"lead({x}, {k}) OVER ({over})" if k else x
    across = ", ".join(f"{shift('x', k, 'PARTITION BY \"row\" ORDER BY col')} AS c{k + r}" for k in span)
    around = [f"{shift(f'c{j + r}', i, 'PARTITION BY col ORDER BY \"row\"')} AS y{(i + r) * size + j + r}" for i in span for j in span]
    n = size * size
    ys = [f"y{k}" for k in range(n)]
    out = [
        ', k0 AS (SELECT "row", col, CASE WHEN mask NOT IN (0, 255) AND hhhh >= 0 THEN hhhh END AS x FROM dense)',
        f'k1 AS (SELECT "row", col, x, {across} FROM k0)',
        f'k2 AS (SELECT "row", col, x, {", ".join(around)} FROM k1)',
        f"k3 AS (SELECT *, greatest({', '.join(ys)}) AS scale FROM k2)",
        'w0 AS (SELECT "row", col, x, scale, ' + ", ".join(f"CASE WHEN {y} IS NOT NULL THEN CASE WHEN scale > 0 THEN {y} / scale ELSE {f(0)} END END AS {y}" for y in ys) + f", CASE WHEN scale > 0 THEN x / scale ELSE {f(0)} END AS own, {f(0)} AS n, {f(0)} AS mean, {f(0)} AS m2 FROM k3)",
    ]
    for k, y in enumerate(ys):
        rest = ", ".join(['"row"', "col", "x", "scale", "own", *ys[k + 1 :]])
        out.append(f"u{k} AS (SELECT {rest}, {y}, m2, mean, n + CASE WHEN {y} IS NOT NULL THEN {f(1)} ELSE {f(0)} END AS n, CASE WHEN {y} IS NOT NULL THEN mean + ({y} - mean) / (n + {f(1)}) ELSE mean END AS mean1 FROM w{k})")
        out.append(f"w{k + 1} AS (SELECT {rest}, n, mean1 AS mean, CASE WHEN {y} IS NOT NULL THEN CAST(CAST({y} - mean AS DOUBLE) * CAST({y} - mean1 AS DOUBLE) + CAST(m2 AS DOUBLE) AS FLOAT) ELSE m2 END AS m2 FROM u{k})")
    got = "mean"
    if kind == "lee":
        out.append(f"v0 AS (SELECT *, m2 / greatest(n, {f(1)}) AS var, mean * mean / {f(enl)} AS noise FROM w{n})")
        out.append(f"v1 AS (SELECT *, CASE WHEN var > noise AND var > 0 THEN least(greatest((var - noise) / var, {f(0)}), {f(1)}) ELSE {f(0)} END AS weight FROM v0)")
        got = "CAST(CAST(weight AS DOUBLE) * CAST(own - mean AS DOUBLE) + CAST(mean AS DOUBLE) AS FLOAT)"
    src = "v1" if kind == "lee" else f"w{n}"
    out.append(f'k AS (SELECT "row", CAST(col AS BIGINT) AS col, CASE WHEN x IS NOT NULL THEN scale * least(greatest({got}, {f(0)}), {f(1)}) END AS value FROM {src})')
    return ", ".join(out)


def _kernel(name: str, kind: str, size: int) -> None:
    @query(name, _float32(size, kind) + ' SELECT "row", col, round(CAST(value AS DOUBLE), 4) AS value FROM k')
    def _(spark, d):
        got = speckle.filtered(linear_field(spark, d), kind, size, 3.0, tile=64)
        return got.select("row", "col", F.round(c("value").cast("double"), 4).alias("value"))


_kernel("speckle_kernel_boxcar_5", "boxcar", 5)
_kernel("speckle_kernel_lee_5", "lee", 5)


def _stored(spark, d) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """hhhh and its mask as written tables of chunks of 32 x 32."""
    rows = tb.table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] // tb.WIDTH + 1
    shape = (rows, tb.WIDTH)

    def layer(name: str) -> DataFrame:
        path = chunks.stored(spark, f"dense {name} {d}", lambda: chunks.to_chunks(tb.dense_hhhh(spark, d), name, shape, (32, 32), (name,)))
        return chunks.read(spark, path, name)

    return layer("hhhh"), layer("mask"), shape


@query("chunk_transform", FIELD + ' SELECT "row", CAST(col AS BIGINT) AS col, v AS value FROM f')
def _(spark, d):
    layer, mask, _ = _stored(spark, d)
    return chunks.to_pixels(chunked.transform(layer, "power_db", mask=mask))


@query("chunk_percentiles", HIST + _quantiles())
def _(spark, d):
    layer, mask, _ = _stored(spark, d)
    return chunked.summary(chunked.transform(layer, "power_db", mask=mask)).select(*(n for n, _ in distribution.QUANTILES))


def _filtered_chunks(spark, d, kind: str, size: int) -> DataFrame:
    layer, mask, shape = _stored(spark, d)
    return chunked.speckle(chunked.transform(layer, "linear", mask=mask), shape, (32, 32), kind, size, 3.0)


def _chunk_speckle(kind: str, size: int) -> None:
    @query(f"chunk_speckle_{kind}_{size}", _float32(size, kind) + ' SELECT "row", col, round(CAST(value AS DOUBLE), 4) AS value FROM k')
    def _(spark, d):
        got = chunks.to_pixels(_filtered_chunks(spark, d, kind, size))
        return got.select("row", "col", F.round(c("value").cast("double"), 4).alias("value"))


for _k in speckle.SIZES:
    _chunk_speckle("boxcar", _k)
    _chunk_speckle("lee", _k)


def flagship(spark, d) -> DataFrame:
    """Distribution of the Lee-filtered raster in decibels, the whole masked raster in chunk form, with its 256 bins."""
    return chunked.summary(chunked.transform(_filtered_chunks(spark, d, "lee", 5), "power_db"))


FILTERED = _float32(5, "lee") + ", f AS (SELECT \"row\", col, CAST(CASE WHEN value IS NOT NULL THEN 10e0*log10(greatest(CAST(value AS DOUBLE), 1e-20)) END AS FLOAT) AS v FROM k), e AS (SELECT min(v) AS lo, max(v) AS hi FROM f)" + HIST.removeprefix(FIELD)


@query("flagship", FILTERED + ", q AS (" + _quantiles().replace(", b AS (", "WITH b AS (", 1) + ") SELECT (SELECT count(v) FROM f) AS finite_count, (SELECT count(*) - count(v) FROM f) AS invalid_count, lo AS minimum, hi AS maximum, q.* FROM q, e")
def _(spark, d):
    return flagship(spark, d).drop("bins")


@query("flagship_histogram", FILTERED + ' SELECT bin, n AS "count" FROM h')
def _(spark, d):
    got = flagship(spark, d).select(F.posexplode("bins").alias("bin", "count"))
    return got.filter(c("count") > 0)


# --- display

NORM = "greatest(least((CAST(v AS DOUBLE) - (-10e0))/20e0, 1e0), 0e0)"


@query("disp_normalize", FIELD + f' SELECT "row", col, round(pow({NORM}, 1e0/2.2e0), 9) AS value FROM f')
def _(spark, d):
    return field(spark, d).select("row", "col", F.round(display.normalize(c("value"), -10.0, 10.0, 2.2), 9).alias("value"))


@query("disp_colorize", FIELD + f""", k AS (SELECT "row", col, CAST(floor({NORM}*255 + 0.5e0) AS INTEGER) AS idx FROM f WHERE v IS NOT NULL)
  SELECT "row", col, {', '.join(f"CAST(floor(127.5e0+127.5e0*cos(2*pi()*(idx/255e0 - {p}/3e0))+0.5e0) AS INTEGER) AS {n}" for p, n in enumerate(('red', 'green', 'blue')))} FROM k""")
def _(spark, d):
    got = field(spark, d).filter(c("value").isNotNull()).select("row", "col", display.normalize(c("value"), -10.0, 10.0).alias("n"))
    return display.colorize(got, "n", display.CYCLIC, display.palettes(spark)).drop("n")


SIDE = 32
PAGE = ', pg AS (SELECT "row" AS pr, CAST(col AS BIGINT) AS pc, CASE WHEN mask NOT IN (0, 255) AND ("row"*7 + col) % 5 <> 0 THEN {v} END AS value FROM slc)'
POINTS = ", ht AS (SELECT count(*) AS h FROM embeddings), pt AS (SELECT id, h, ((id*37) % (3*h))/CAST(3*h AS DOUBLE)*h AS y, ((id*91) % 997)/997e0*32 AS x FROM (SELECT h, unnest(range(3*h)) AS id FROM ht) i), n AS (SELECT *, least(CAST(floor(y) AS BIGINT), h-1) AS nr, least(CAST(floor(x) AS BIGINT), 31) AS nc FROM pt)"
CORNERS = """, cn AS (SELECT id, nr, nc, greatest(least(CAST(floor(y-0.5e0) AS BIGINT)+a, h-1), 0) AS pr, greatest(least(CAST(floor(x-0.5e0) AS BIGINT)+b, 31), 0) AS pc,
  (CASE WHEN a = 1 THEN (y-0.5e0)-floor(y-0.5e0) ELSE 1-((y-0.5e0)-floor(y-0.5e0)) END)*(CASE WHEN b = 1 THEN (x-0.5e0)-floor(x-0.5e0) ELSE 1-((x-0.5e0)-floor(x-0.5e0)) END) AS w
  FROM n, (SELECT unnest([0,0,1,1]) AS a, unnest([0,1,0,1]) AS b) k),
  g AS (SELECT id, max(CASE WHEN cn.pr = nr AND cn.pc = nc THEN value END) AS v0, sum(CASE WHEN value IS NOT NULL THEN w END) AS sw, sum(w*value) AS sv, sum(w*cos(value)) AS sc, sum(w*sin(value)) AS ss FROM cn LEFT JOIN pg USING (pr, pc) GROUP BY id)"""


def _sampled(spark, d, f: Callable, mode: str) -> DataFrame:
    """Three points a row of the image, sampled from it with some pixels taken out."""
    h = tb.table(spark, d, "embeddings").count()
    points = spark.range(3 * h).select("id", (((c("id") * 37) % (3 * h)) / F.lit(3.0 * h) * h).alias("y"), (((c("id") * 91) % 997) / F.lit(997e0) * SIDE).alias("x"))
    page = slc(spark, d).select("row", c("col").cast("long").alias("col"), F.when((c("row") * 7 + c("col")) % 5 != 0, f(c("re"), c("im"), c("mask"))).cast("double").alias("value"))
    return display.sample_points(points, page, h, SIDE, mode)


_AMP = f"CAST(CAST(sqrt({P}) AS FLOAT) AS DOUBLE)"
_PHASE = "CAST(CAST(atan2(CAST(im AS DOUBLE), CAST(re AS DOUBLE)) AS FLOAT) AS DOUBLE)"


@query("disp_nearest", PAGE.format(v=_AMP) + POINTS + " SELECT id, value FROM n LEFT JOIN pg ON pr = nr AND pc = nc")
def _(spark, d):
    return _sampled(spark, d, tx.amplitude, "nearest")


@query("disp_bilinear", PAGE.format(v=_AMP) + POINTS + CORNERS + " SELECT id, round(CAST(CAST(CASE WHEN v0 IS NOT NULL THEN CASE WHEN sw > 0 THEN sv/sw ELSE v0 END END AS FLOAT) AS DOUBLE), 5) AS value FROM g")
def _(spark, d):
    got = _sampled(spark, d, tx.amplitude, "bilinear")
    return got.select("id", F.round(c("value").cast("double"), 5).alias("value"))


@query("disp_phase_interp", PAGE.format(v=_PHASE) + POINTS + CORNERS + " SELECT id, round(CAST(CAST(CASE WHEN v0 IS NOT NULL THEN CASE WHEN sw > 0 AND sc*sc+ss*ss > 1e-12*sw*sw THEN atan2(ss, sc) ELSE v0 END END AS FLOAT) AS DOUBLE), 5) AS value FROM g")
def _(spark, d):
    got = _sampled(spark, d, tx.phase, "phase")
    return got.select("id", F.round(c("value").cast("double"), 5).alias("value"))


@query("disp_pauli_rgb", PAULI + f""", w AS (SELECT "row", col, {WORD} AS word FROM p)
  SELECT "row", col, {', '.join(f"round(greatest(least((CAST(CAST(-100e0 + ((word // {1 << s}) % 1024)*(150e0/1023) AS FLOAT) AS DOUBLE) + 35e0)/40e0, 1e0), 0e0), 6) AS {n}" for n, s in (('red', 0), ('green', 10), ('blue', 20)))} FROM w""")
def _(spark, d):
    p = _rgb(pauli(spark, d), la.pauli_db)
    word = p.select("row", "col", la.pauli_pack(c("red"), c("green"), c("blue")).alias("word"))
    return word.select("row", "col", *(F.round(display.normalize(v, -35.0, 5.0), 6).alias(k) for k, v in la.pauli_unpack(c("word")).items()))


@query("disp_swipe", f'SELECT "row", col, CASE WHEN (col + 0.5e0)/128e0 >= 0.4e0 THEN CASE WHEN re >= 0 THEN re END ELSE hhhh END AS value {VALID}')
def _(spark, d):
    return pair(spark, d).select("row", "col", display.swipe((c("col") + 0.5) / 128.0, c("a"), c("b"), 0.4).alias("value"))


@query("disp_crossfade", """, a AS (SELECT "row", col, CAST(hhhh AS DOUBLE) AS a FROM gcov WHERE col < 100), b AS (SELECT "row", col, CAST(vvvv AS DOUBLE) AS b FROM gcov WHERE col >= 20)
  SELECT "row", col, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a*0.75e0 + b*0.25e0 ELSE coalesce(a, b) END AS value FROM a FULL JOIN b USING ("row", col) WHERE coalesce(a, b) IS NOT NULL""")
def _(spark, d):
    """Two pages that overlap in columns 20 to 99."""
    g = tb.gcov(spark, d)
    a, b = g.filter("col < 100").select("row", "col", c("hhhh").alias("value")), g.filter("col >= 20").select("row", "col", c("vvvv").alias("value"))
    return display.crossfade(a, b, (3.0, 1.0))


# --- catalog (a product in memory: two frequencies, the second without HVHV and on another grid)

ROOT = "/science/LSAR/GCOV/grids"
CATALOG = f"""WITH ds AS (SELECT * FROM (VALUES
  ('{ROOT}/frequencyA/HHHH', 'float', 4, 40, 60, '1', 'projection'), ('{ROOT}/frequencyA/HVHV', 'float', 4, 40, 60, 'unitless', 'projection'),
  ('{ROOT}/frequencyA/VVVV', 'float', 4, 40, 60, '1', 'projection'), ('{ROOT}/frequencyA/HHVV', 'complex', 8, 40, 60, 'Dimensionless', 'projection'),
  ('{ROOT}/frequencyA/mask', 'uint', 1, 40, 60, '', 'projection'), ('{ROOT}/frequencyA/numberOfLooks', 'float', 4, 40, 60, '1', 'projection'),
  ('{ROOT}/frequencyB/HHHH', 'float', 4, 20, 30, '1', 'projection'), ('{ROOT}/frequencyB/VVVV', 'float', 8, 20, 30, 'dB', 'projection'),
  ('{ROOT}/frequencyB/mask', 'uint', 2, 20, 30, '', 'projection'), ('/science/LSAR/GCOV/metadata/calibrationInformation/lut', 'float', 4, 5, 5, '', ''),
  ('/science/LSAR/GCOV/metadata/orbit', 'unsupported', 0, 9, 3, '', '')) v(path, kind, bytes, n_rows, n_cols, units, grid_mapping)),
fr AS (SELECT * FROM (VALUES ('A', '{ROOT}/frequencyA', 60, 500000e0, 501180e0, 20e0, 40, 4000000e0, 3999220e0, -20e0), ('B', '{ROOT}/frequencyB', 30, 500000e0, 501160e0, 40e0, 20, 4000000e0, 3999230e0, -40e0))
  v(name, group_path, nx, x0, x1, dx, ny, y0, y1, dy)),
cl AS (SELECT ds.*, coalesce(fr.name, '') AS frequency, regexp_extract(path, '[^/]*$') AS name FROM ds LEFT JOIN fr ON starts_with(path, group_path || '/')),
cc AS (SELECT *, CASE WHEN frequency <> '' AND name IN ('HHHH', 'HVHV', 'VVVV', 'HHVV') THEN CASE WHEN left(name, 2) = right(name, 2) THEN 'gcov_diagonal_covariance' ELSE 'gcov_off_diagonal_covariance' END
  WHEN frequency <> '' AND name = 'mask' THEN 'mask' WHEN frequency <> '' AND name = 'numberOfLooks' THEN 'number_of_looks'
  WHEN frequency = '' AND contains(path, '/calibrationInformation/') AND kind <> 'unsupported' THEN 'calibration_lut' ELSE 'auxiliary' END AS layer_kind FROM cl),
c2 AS (SELECT *, CASE WHEN layer_kind LIKE 'gcov%' THEN 'science' ELSE 'auxiliary' END AS role FROM cc),
mk AS (SELECT regexp_replace(path, '/[^/]*$', '') AS parent, path AS mask_path, frequency, n_rows, n_cols FROM c2 WHERE name = 'mask' AND kind = 'uint' AND bytes = 1),
sm AS (SELECT c2.*, mask_path FROM c2 LEFT JOIN mk ON regexp_replace(path, '/[^/]*$', '') = parent AND mk.frequency = c2.frequency AND mk.n_rows = c2.n_rows AND mk.n_cols = c2.n_cols WHERE role = 'science')
"""


def product(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = CATALOG.split("(VALUES", 1)[1].split(") v(", 1)[0]
    d = spark.sql(f"SELECT * FROM VALUES {rows} AS v(path, kind, bytes, n_rows, n_cols, units, grid_mapping)")
    paths = d.select(
        cat.normalize_path(c("path")).alias("path"), F.struct(c("kind"), c("bytes").cast("int").alias("bytes"), (c("kind") != "unsupported").alias("readable")).alias("dtype"),
        c("n_rows").cast("long").alias("rows"), c("n_cols").cast("long").alias("cols"), F.lit(8).cast("long").alias("chunk_rows"), F.lit(8).cast("long").alias("chunk_cols"), "units", "grid_mapping", F.lit("").alias("long_name"), F.lit("chunked").alias("layout"),
    )
    rows = CATALOG.split("fr AS (SELECT * FROM (VALUES", 1)[1].split(")\n  v(", 1)[0]
    f = spark.sql(f"SELECT * FROM VALUES {rows} AS v(name, group_path, nx, x0, x1, dx, ny, y0, y1, dy)")
    axis = lambda n, a, b, s, name: F.struct(c(n).cast("long").alias("count"), c(a).alias("first"), c(b).alias("last"), c(s).alias("spacing")).alias(name)
    freq = f.select("name", "group_path", F.array().cast("array<string>").alias("polarizations"), F.array(*map(F.lit, cat.PAULI_TERMS)).alias("covariance_terms"), axis("nx", "x0", "x1", "dx", "x"), axis("ny", "y0", "y1", "dy", "y"), F.lit(32616).alias("epsg"))
    return cat.classify(paths, freq, "GCOV"), freq


@query("catalog_classify", "SELECT path, name, frequency, role, layer_kind FROM c2", CATALOG)
def _(spark, d):
    return product(spark)[0].select("path", "name", "frequency", "role", "layer_kind")


@query("catalog_layers", "SELECT frequency, count(*) AS n_layers, count(*) FILTER (WHERE role = 'science') AS n_science FROM c2 WHERE frequency <> '' GROUP BY frequency", CATALOG)
def _(spark, d):
    return product(spark)[0].filter("frequency <> ''").groupBy("frequency").agg(F.count(F.lit(1)).alias("n_layers"), F.count_if(c("role") == "science").alias("n_science"))


@query("catalog_axis_check", "SELECT name, abs(x0 + dx*(nx-1) - x1) <= 64*2.220446049250313e-16*greatest(1e0, abs(x0 + dx*(nx-1)), abs(x1))*nx AS x_ok, abs(y0 + dy*(ny-1) - y1) <= 64*2.220446049250313e-16*greatest(1e0, abs(y0 + dy*(ny-1)), abs(y1))*ny AS y_ok FROM fr", CATALOG)
def _(spark, d):
    ok = lambda a: cat.axis_consistent(c(f"{a}.first"), c(f"{a}.last"), c(f"{a}.spacing"), c(f"{a}.count"))
    return product(spark)[1].select("name", ok("x").alias("x_ok"), ok("y").alias("y_ok"))


@query("catalog_path_norm", "SELECT p AS path, CASE WHEN n = '/' THEN n ELSE regexp_replace(n, '/$', '') END AS normal FROM (SELECT p, regexp_replace('/' || p, '/+', '/', 'g') AS n FROM (VALUES ('a//b/'), ('/'), ('///x'), ('/a/b'), ('c/d//')) v(p)) t", "")
def _(spark, d):
    got = spark.sql("SELECT * FROM VALUES ('a//b/'), ('/'), ('///x'), ('/a/b'), ('c/d//') AS v(path)")
    return got.select("path", cat.normalize_path(c("path")).alias("normal"))


@query("catalog_renderable", "SELECT path, row_number() OVER (ORDER BY CASE WHEN frequency = 'A' AND name IN ('HH', 'HHHH') THEN 0 ELSE 1 END, path) = 1 AS is_default FROM c2 WHERE (layer_kind = 'gcov_off_diagonal_covariance' AND kind = 'complex' AND bytes = 8) OR (layer_kind = 'gcov_diagonal_covariance' AND kind = 'float' AND bytes = 4)", CATALOG)
def _(spark, d):
    ds = product(spark)[0]
    first = cat.default_layer(ds).select(c("path").alias("_p"))
    return cat.renderable(ds).join(F.broadcast(first), c("path") == c("_p"), "left").select("path", c("_p").isNotNull().alias("is_default"))


@query("catalog_mask_join", "SELECT path, mask_path FROM sm", CATALOG)
def _(spark, d):
    return cat.sibling_masks(product(spark)[0]).select("path", "mask_path")


@query("catalog_units", "SELECT a.path AS a, b.path AS b, lower(trim(a.units)) = lower(trim(b.units)) OR (lower(trim(a.units)) IN ('1', 'unitless', 'dimensionless') AND lower(trim(b.units)) IN ('1', 'unitless', 'dimensionless')) AS compatible FROM c2 a JOIN c2 b ON a.frequency = b.frequency AND a.path < b.path", CATALOG)
def _(spark, d):
    ds = product(spark)[0]
    a, b = (ds.select("frequency", c("path").alias(n), c("units").alias(f"u{n}")) for n in "ab")
    return a.join(b, "frequency").filter("a < b").select("a", "b", cat.units_compatible(c("ua"), c("ub")).alias("compatible"))


@query("catalog_json", """SELECT path, '{"path":"' || path || '","name":"' || name || '","frequency":"' || frequency || '","role":"' || role || '","layer_kind":"' || layer_kind || '","shape":[' || n_rows || ',' || n_cols || '],"dtype":{"kind":"' || kind || '","canonical_element_bytes":' || bytes || ',"readable":' || CASE WHEN kind = 'unsupported' THEN 'false' ELSE 'true' END || '},"chunks":[8,8],"layout":"chunked","units":"' || units || '","long_name":""}' AS json FROM c2""", CATALOG)
def _(spark, d):
    return cat.layer_json(product(spark)[0])


LACKS = "CASE WHEN sm.path IS NULL THEN 'missing ' || t || ' covariance term' END"


@query("pauli_capability", f"""SELECT f.name AS frequency, string_agg({LACKS}, '; ' ORDER BY k) IS NULL AS available, coalesce(string_agg({LACKS}, '; ' ORDER BY k), '') AS reason,
  CASE WHEN string_agg({LACKS}, '; ' ORDER BY k) IS NULL THEN any_value(mask_path) END AS mask_path
  FROM fr f JOIN (SELECT unnest(['HHHH', 'HVHV', 'VVVV', 'HHVV']) AS t, unnest([0, 1, 2, 3]) AS k) t ON true LEFT JOIN sm ON sm.path = f.group_path || '/' || t GROUP BY f.name""", CATALOG)
def _(spark, d):
    return cat.pauli_capabilities(*product(spark))


@query("compare_capability", f"""SELECT * FROM (VALUES
  ('{ROOT}/frequencyA/HHHH', '{ROOT}/frequencyA/VVVV', 'side_by_side', true, ''), ('{ROOT}/frequencyA/HHHH', '{ROOT}/frequencyA/VVVV', 'swipe', true, ''),
  ('{ROOT}/frequencyA/HHHH', '{ROOT}/frequencyA/VVVV', 'difference', true, ''), ('{ROOT}/frequencyA/HHHH', '{ROOT}/frequencyA/VVVV', 'ratio', true, ''),
  ('{ROOT}/frequencyA/HHHH', '{ROOT}/frequencyA/HHVV', 'side_by_side', true, '')) v("first", "second", mode, available, reason)
  UNION ALL SELECT '{ROOT}/frequencyA/HHHH', '{ROOT}/frequencyA/HHVV', m, false, 'aligned comparison requires both sources to be real or both complex' FROM (SELECT unnest(['swipe', 'difference', 'ratio']) AS m) t
  UNION ALL SELECT '{ROOT}/frequencyA/HHHH', '/none', m, false, CASE WHEN m = 'side_by_side' THEN '' ELSE 'side-by-side prerequisite failed: ' END || 'second dataset path is not in the catalog' FROM (SELECT unnest(['side_by_side', 'swipe', 'difference', 'ratio']) AS m) t
  UNION ALL SELECT '{ROOT}/frequencyA/HHHH', '{ROOT}/frequencyB/HHHH', m, m = 'side_by_side', CASE WHEN m = 'side_by_side' THEN '' ELSE 'aligned comparison requires the same frequency; aligned comparison requires identical non-empty dimensions; aligned comparison has an unreadable or grid-incompatible mask' END FROM (SELECT unnest(['side_by_side', 'swipe', 'difference', 'ratio']) AS m) t""", "")
def _(spark, d):
    a = f"{ROOT}/frequencyA/"
    pairs = ", ".join(f"('{a}HHHH', '{b}')" for b in (f"{a}VVVV", f"{a}HHVV", "/none", f"{ROOT}/frequencyB/HHHH"))
    return cat.compare_capabilities(*product(spark), spark.sql(f"SELECT * FROM VALUES {pairs} AS v(first, second)"))
