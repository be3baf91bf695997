"""Display algebra: normalisation, palettes, interpolation, comparisons and crossfades."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radarlake.functions.validity import finite

LEAST_WIDTH, LEAST_GAMMA, OPPOSED = 1e-20, 1e-4, 1e-12
SAMPLES, PALETTES = 256, 20
#: Rows of palettes that are built here; the others come from a table.
GRAYSCALE, TURBO, CYCLIC, BALANCE = 0, 1, 2, 3
VIRIDIS, CIVIDIS, INFERNO, MAGMA, PLASMA, RD_BU, PU_OR, CUBEHELIX = 12, 13, 14, 15, 16, 17, 18, 19
KNOWN = (GRAYSCALE, TURBO, CYCLIC, BALANCE, VIRIDIS, CIVIDIS, INFERNO, MAGMA, PLASMA, RD_BU, PU_OR, CUBEHELIX)
#: Every 17th sample of the balance palette; those between are interpolated.
BALANCE_SAMPLES = ((23, 28, 66), (38, 51, 121), (33, 75, 181), (21, 112, 187), (66, 142, 185), (116, 169, 189), (169, 194, 202), (219, 221, 223), (232, 217, 213), (219, 177, 163), (208, 138, 115), (195, 99, 69), (179, 56, 38), (148, 18, 39), (104, 14, 36), (60, 9, 17))
#: The published eleven-class colours of two diverging schemes, low end first.
RD_BU_CLASSES = "053061 2166ac 4393c3 92c5de d1e5f0 f7f7f7 fddbc7 f4a582 d6604d b2182b 67001f".split()
PU_OR_CLASSES = "2d004b 542788 8073ac b2abd2 d8daeb f7f7f7 fee0b6 fdb863 e08214 b35806 7f3b08".split()
#: Published polynomials (degree 6, constant first) that approximate four perceptual palettes.
POLYNOMIALS = {
    VIRIDIS: ((0.2777273272234177, 0.1050930431085774, -0.3308618287255563, -4.634230498983486, 6.228269936347081, 4.776384997670288, -5.435455855934631), (0.005407344544966578, 1.404613529898575, 0.214847559468213, -5.799100973351585, 14.17993336680509, -13.74514537774601, 4.645852612178535), (0.3340998053353061, 1.384590162594685, 0.09509516302823659, -19.33244095627987, 56.69055260068105, -65.35303263337234, 26.3124352495832)),
    INFERNO: ((0.0002189403691192265, 0.1065134194856116, 11.60249308247187, -41.70399613139459, 77.162935699427, -71.31942824499214, 25.13112622477341), (0.001651004631001012, 0.5639564367884091, -3.972853965665698, 17.43639888205313, -33.40235894210092, 32.62606426397723, -12.24266895238567), (-0.01948089843709184, 3.932712388889277, -15.9423941062914, 44.35414519872813, -81.80730925738993, 73.20951985803202, -23.07032500287172)),
    MAGMA: ((-0.002136485053939582, 0.2516605407371642, 8.353717279216625, -27.66873308576866, 52.17613981234068, -50.76852536473588, 18.65570506591883), (-0.000749655052795221, 0.6775232436837668, -3.577719514958484, 14.26473078096533, -27.94360607168351, 29.04658282127291, -11.48977351997711), (-0.005386127855323933, 2.494026599312351, 0.3144679030132573, -13.64921318813922, 12.94416944238394, 4.23415299384598, -5.601961508734096)),
    PLASMA: ((0.05873234392399702, 2.176514634195958, -2.689460476458034, 6.130348345893603, -11.10743619062271, 10.02306557647065, -3.658713842777788), (0.02333670892565664, 0.2383834171260182, -7.455851135738909, 42.3461881477227, -82.66631109428045, 71.41361770095349, -22.93153465461149), (0.5433401826748754, 0.7539604599784036, 3.110799939717086, -28.51885465332158, 60.13984767418263, -54.07218655560067, 18.19190778539828)),
}
#: Window, palette and circular interpolation by mode.
MODE_PRESETS = {
    "power_db": (-35.0, 5.0, VIRIDIS, False), "phase": (-math.pi, math.pi, CYCLIC, True),
    "real": (-1.0, 1.0, BALANCE, False), "imaginary": (-1.0, 1.0, BALANCE, False),
}


def preset(mode: str) -> tuple[float, float, int, bool]:
    return MODE_PRESETS.get(mode, (0.0, 1.0, VIRIDIS, False))


def normalize(v: Column, low: float, high: float, gamma: float = 1.0) -> Column:
    """0..1 over the window, then gamma; 0 if the window is empty."""
    width = high - low
    if abs(width) <= LEAST_WIDTH:
        return F.when(v.isNotNull(), F.lit(0e0))
    n = F.greatest(F.least((v.cast("double") - F.lit(float(low))) / F.lit(float(width)), F.lit(1e0)), F.lit(0e0))
    return n if gamma == 1.0 else F.pow(n, F.lit(1.0 / max(gamma, LEAST_GAMMA)))


def _spline(classes: list[str], t: float) -> tuple[float, ...]:
    """A uniform cubic B-spline through colours, ends extended on a line."""
    colours = [tuple(int(x[k : k + 2], 16) for k in (0, 2, 4)) for x in classes]
    n = len(colours) - 1
    i = min(int(t * n), n - 1)
    u = t * n - i
    out = []
    for c in range(3):
        b, d = colours[i][c], colours[i + 1][c]
        a = colours[i - 1][c] if i else 2 * b - d
        e = colours[i + 2][c] if i < n - 1 else 2 * d - b
        out.append(((1 - u) ** 3 * a + (4 - 6 * u * u + 3 * u**3) * b + (1 + 3 * u + 3 * u * u - 3 * u**3) * d + u**3 * e) / 6)
    return tuple(out)


def palette_row(palette: int) -> list[tuple[int, int, int]]:
    """256 sRGB samples of a palette that is built here."""

    def byte(x: float) -> int:
        return max(0, min(255, math.floor(x + 0.5)))

    out = []
    for k in range(SAMPLES):
        t = k / (SAMPLES - 1)
        if palette == GRAYSCALE:
            rgb: tuple = (k, k, k)
        elif palette == CYCLIC:
            rgb = tuple(127.5 + 127.5 * math.cos(2 * math.pi * (t - p / 3)) for p in range(3))
        elif palette == TURBO:  # published polynomial
            rgb = (
                34.61 + t * (1172.33 - t * (10793.56 - t * (33300.12 - t * (38394.49 - t * 14825.05)))),
                23.31 + t * (557.33 + t * (1225.33 - t * (3574.96 - t * (1073.77 + t * 707.56)))),
                27.2 + t * (3211.1 - t * (15327.97 - t * (27814 - t * (22569.18 - t * 6838.66)))),
            )
        elif palette == CIVIDIS:  # published polynomial
            rgb = (
                -4.54 - t * (35.34 - t * (2381.73 - t * (6402.7 - t * (7024.72 - t * 2710.57)))),
                32.49 + t * (170.73 + t * (52.82 - t * (131.46 - t * (176.58 - t * 67.37)))),
                81.24 + t * (442.36 - t * (2482.43 - t * (6167.24 - t * (6614.94 - t * 2475.67)))),
            )
        elif palette in POLYNOMIALS:
            rgb = tuple(255 * sum(c * t**n for n, c in enumerate(x)) for x in POLYNOMIALS[palette])
        elif palette in (RD_BU, PU_OR):
            rgb = _spline(RD_BU_CLASSES if palette == RD_BU else PU_OR_CLASSES, t)
        elif palette == BALANCE:
            a, b = BALANCE_SAMPLES[k // 17], BALANCE_SAMPLES[min(k // 17 + 1, 15)]
            rgb = tuple(x + (y - x) * (k % 17) / 17 for x, y in zip(a, b, strict=True))
        elif palette == CUBEHELIX:  # 300 to -240 degrees, saturation 0.5, lightness 0 to 1
            h, a = math.radians(300 - 540 * t + 120), 0.5 * t * (1 - t)
            c, s = math.cos(h), math.sin(h)
            rgb = tuple(255 * (t + a * x) for x in (-0.14861 * c + 1.78277 * s, -0.29227 * c - 0.90649 * s, 1.97294 * c))
        else:
            raise ValueError(f"palette {palette} isn't built here: give a table of (palette, idx, red, green, blue)")
        out.append(tuple(map(byte, rgb)))
    return out


def palettes(spark: SparkSession, table: DataFrame | None = None) -> DataFrame:
    """(palette, idx, red, green, blue): those built here, and a user's table for other rows. 5,120 rows at most."""
    rows = ", ".join(f"({p}, {k}, {r}, {g}, {b})" for p in KNOWN for k, (r, g, b) in enumerate(palette_row(p)))
    own = spark.sql(f"SELECT * FROM VALUES {rows} AS t(palette, idx, red, green, blue)")
    if table is None:
        return own
    given = table.select(*(F.col(c).cast("int") for c in own.columns)).filter(F.col("palette").between(0, PALETTES - 1) & F.col("idx").between(0, SAMPLES - 1))
    return own.unionByName(given.filter(~F.col("palette").isin(*KNOWN)))


def palette_index(normalized: Column) -> Column:
    return F.floor(normalized * (SAMPLES - 1) + 0.5).cast("int")


def colorize(df: DataFrame, normalized: str, palette: int, table: DataFrame) -> DataFrame:
    """df with red, green, blue: a broadcast equi-join to 256 rows; a palette that the table lacks is an error."""
    palette = min(palette, PALETTES - 1)
    lut = table.filter(F.col("palette") == palette).drop("palette")
    if palette not in KNOWN and lut.count() != SAMPLES:  # 256 rows of a user's table
        raise ValueError(f"palette {palette} needs {SAMPLES} rows of (palette, idx, red, green, blue)")
    return df.withColumn("idx", palette_index(F.col(normalized))).join(F.broadcast(lut), "idx", "left").drop("idx")


def sample_points(points: DataFrame, page: DataFrame, height: int, width: int, mode: str = "bilinear") -> DataFrame:
    """points (id, y, x in texels, pixel edges) with the page's value there: nearest, bilinear or phase.

    The nearest texel decides validity; valid neighbours are weighed anew. Each point
    meets its four texels by one equi-join; coordinates off the page give NULL.
    """
    if mode not in ("nearest", "bilinear", "phase"):
        raise ValueError(f"no sampling mode {mode!r}")
    y, x = F.col("y"), F.col("x")
    inside = (y >= 0) & (x >= 0) & (y <= height) & (x <= width)
    near = {"nr": F.least(F.floor(y), F.lit(height - 1)).cast("long"), "nc": F.least(F.floor(x), F.lit(width - 1)).cast("long")}
    pts = points.withColumns(near).withColumn("inside", inside)
    cells = page.select(F.col("row").alias("pr"), F.col("col").alias("pc"), "value")
    if mode == "nearest":
        got = pts.join(cells, (F.col("nr") == F.col("pr")) & (F.col("nc") == F.col("pc")), "left")
        return got.select("id", F.when(F.col("inside"), F.col("value")).alias("value"))
    fy, fx = y - 0.5 - F.floor(y - 0.5), x - 0.5 - F.floor(x - 0.5)
    corners = [F.struct(F.greatest(F.least(F.floor(y - 0.5) + a, F.lit(height - 1)), F.lit(0)).cast("long").alias("pr"), F.greatest(F.least(F.floor(x - 0.5) + b, F.lit(width - 1)), F.lit(0)).cast("long").alias("pc"), ((fy if a else 1 - fy) * (fx if b else 1 - fx)).alias("w")) for a in (0, 1) for b in (0, 1)]
    spread = pts.withColumn("c", F.explode(F.array(*corners))).select("id", "nr", "nc", "inside", "c.*")
    got = spread.join(cells, ["pr", "pc"], "left")
    v, w = F.col("value").cast("double"), F.when(F.col("value").isNotNull(), F.col("w"))
    central = F.max(F.when((F.col("pr") == F.col("nr")) & (F.col("pc") == F.col("nc")), v))
    sums = [F.sum(w).alias("sw"), F.sum(w * v).alias("sv"), F.sum(w * F.cos(v)).alias("sc"), F.sum(w * F.sin(v)).alias("ss")]
    g = got.groupBy("id").agg(F.first("inside").alias("inside"), central.alias("v0"), *sums)
    if mode == "bilinear":
        value = F.when(F.col("sw") > 0, F.col("sv") / F.when(F.col("sw") > 0, F.col("sw"))).otherwise(F.col("v0"))
    else:
        size = F.col("sc") * F.col("sc") + F.col("ss") * F.col("ss")
        value = F.when((F.col("sw") > 0) & (size > OPPOSED * F.col("sw") * F.col("sw")), F.atan2("ss", "sc")).otherwise(F.col("v0"))
    return g.select("id", F.when(F.col("inside") & F.col("v0").isNotNull(), value).cast("float").alias("value"))


def swipe(u: Column, a: Column, b: Column, divider: float) -> Column:
    """A left of the divider, B from it on."""
    return F.when(u >= min(max(divider, 0.0), 1.0), b).otherwise(a)


def split(u: Column) -> tuple[Column, Column]:
    """(second side, coordinate inside that side) of a split view."""
    second = u >= 0.5
    return second, F.when(second, (u - 0.5) * 2).otherwise(u * 2)


def crossfade(first: DataFrame, second: DataFrame, weights: tuple[float, float]) -> DataFrame:
    """Two pages blended where both are valid; where one is, it alone."""
    w0, w1 = (max(w, 0.0) for w in weights)
    blend = min(max(w1 / (w0 + w1), 0.0), 1.0) if w0 + w1 > 1e-8 else 0.5
    a, b = (df.select("row", "col", F.col("value").cast("double").alias(n)) for df, n in ((first, "a"), (second, "b")))
    both = F.col("a") * (1 - blend) + F.col("b") * blend
    value = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), both).otherwise(F.coalesce("a", "b"))
    return a.join(b, ["row", "col"], "full").select("row", "col", value.alias("value")).filter(F.col("value").isNotNull())


def valid(v: Column) -> Column:
    return finite(v)
