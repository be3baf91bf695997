"""Catalog of a product: typed, classified layers, their masks, and what can be made of them.

datasets: path, name, frequency, role, layer_kind, dtype (struct kind, bytes, readable),
rows, cols, chunk_rows, chunk_cols, units, grid_mapping, long_name, layout.
frequencies: name, group_path, polarizations, covariance_terms, x and y (struct count,
first, last, spacing), epsg. Both are small; joins on them are broadcast by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Product types, instrument groups in the order they are looked for, covariance terms of Pauli.
PRODUCT_TYPES, INSTRUMENTS = ("GSLC", "GCOV"), ("LSAR", "SSAR")
PAULI_TERMS = ("HHHH", "HVHV", "VVVV", "HHVV")
NAMED_KINDS = {"mask": "mask", "inputDataExceptionMask": "mask", "numberOfLooks": "number_of_looks", "rtcGammaToSigmaFactor": "rtc_gamma_to_sigma_factor"}
UNITLESS = ("1", "unitless", "dimensionless")
MODES = ("side_by_side", "swipe", "difference", "ratio")


def normalize_path(path: Column) -> Column:
    """One leading slash, no doubled ones, none at the end."""
    p = F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))


def leaf(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def child(path: Column, name: str) -> Column:
    return F.concat(F.regexp_replace(path, "/$", ""), F.lit("/" + name))


def token(c: Column) -> Column:
    """Trimmed, ASCII letters lowered."""
    return F.translate(F.trim(c, F.lit(" \t\r\n")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_diagonal(term: Column) -> Column:
    n = F.length(term)
    half = (n / 2).cast("int")
    return (n >= 4) & (n % 2 == 0) & (F.substring(term, F.lit(1), half) == F.substring(term, half + 1, half))


def axis_consistent(first: Column, last: Column, spacing: Column, count: Column) -> Column:
    """The last coordinate is where the spacing puts it, within rounding."""
    there = first + spacing * (count - 1).cast("double")
    scale = F.greatest(F.lit(1e0), F.abs(there), F.abs(last))
    return (count <= 1) | (F.abs(there - last) <= F.lit(64 * 2.0**-52) * scale * count.cast("double"))


def axis_usable(axis: Column) -> Column:
    ok = axis["count"] != 0
    for k in ("first", "last", "spacing"):
        ok = ok & axis[k].isNotNull() & ~F.isnan(axis[k]) & (F.abs(axis[k]) < float("inf"))
    return ok & (axis["spacing"] != 0)


def units_compatible(a: Column, b: Column) -> Column:
    x, y = token(F.coalesce(a, F.lit(""))), token(F.coalesce(b, F.lit("")))
    return (x == y) | (x.isin(*UNITLESS) & y.isin(*UNITLESS))


def is_float32(dtype: Column) -> Column:
    return dtype["readable"] & (dtype["kind"] == "float") & (dtype["bytes"] == 4)


def is_complex64(dtype: Column) -> Column:
    return dtype["readable"] & (dtype["kind"] == "complex") & (dtype["bytes"] == 8)


def is_uint8(dtype: Column) -> Column:
    return dtype["readable"] & (dtype["kind"] == "uint") & (dtype["bytes"] == 1)


def frequency_rows(frequencies: DataFrame) -> DataFrame:
    """Groups named frequency*, by name; an empty catalog is an error for the caller."""
    return frequencies.filter(F.startswith(leaf(F.col("group_path")), F.lit("frequency"))).orderBy("name")


def classify(paths: DataFrame, frequencies: DataFrame, product_type: str) -> DataFrame:
    """paths (path, dtype, ...) with name, frequency, role and layer_kind; rank-2 layers, by path."""
    if product_type not in PRODUCT_TYPES:
        raise ValueError(f"no product type {product_type!r}")
    f = frequencies.select(F.col("name").alias("frequency"), F.col("group_path").alias("_g"), "polarizations", "covariance_terms")
    under = F.startswith(F.col("path"), F.concat(F.col("_g"), F.lit("/")))
    got = paths.withColumn("name", leaf(F.col("path"))).join(F.broadcast(f), under, "left")  # few rows a product
    here, name = F.col("frequency").isNotNull(), F.col("name")
    pol = F.lit(product_type == "GSLC") & F.coalesce(F.array_contains("polarizations", name), F.lit(False))
    cov = F.lit(product_type == "GCOV") & F.coalesce(F.array_contains("covariance_terms", name), F.lit(False))
    kind = F.when(here & pol, "gslc_polarization").when(here & cov & is_diagonal(name), "gcov_diagonal_covariance").when(here & cov, "gcov_off_diagonal_covariance")
    for n, k in NAMED_KINDS.items():
        kind = kind.when(here & (name == n), k)
    kind = kind.when(~here & F.contains(F.col("path"), F.lit("/calibrationInformation/")) & (F.col("dtype.kind") != "unsupported"), "calibration_lut").otherwise("auxiliary")
    role = F.when(here & (pol | cov), "science").otherwise("auxiliary")
    return got.withColumn("layer_kind", kind).withColumn("role", role).withColumn("frequency", F.coalesce("frequency", F.lit(""))).drop("_g", "polarizations", "covariance_terms")


def renderable(datasets: DataFrame) -> DataFrame:
    """Science layers that can be shown: complex64 images and cross terms, float32 diagonals."""
    k, d = F.col("layer_kind"), F.col("dtype")
    return datasets.filter((k.isin("gslc_polarization", "gcov_off_diagonal_covariance") & is_complex64(d)) | ((k == "gcov_diagonal_covariance") & is_float32(d)))


def default_layer(datasets: DataFrame) -> DataFrame:
    """Frequency A's HH or HHHH if it can be shown, else the first layer by path: one row at most."""
    preferred = (F.col("frequency") == "A") & F.col("name").isin("HH", "HHHH")
    return renderable(datasets).orderBy(F.when(preferred, 0).otherwise(1), "path").limit(1)


def find_dataset(datasets: DataFrame, path: str) -> DataFrame:
    return datasets.filter(normalize_path(F.lit(path)) == F.col("path"))


def find_frequency(frequencies: DataFrame, name: str) -> DataFrame:
    return frequencies.filter(token(F.col("name")) == token(F.lit(name)))


def sibling_masks(datasets: DataFrame) -> DataFrame:
    """Each science layer with the path of its valid mask (NULL: none)."""
    m = datasets.filter((F.col("name") == "mask") & (F.col("layer_kind") == "mask") & is_uint8(F.col("dtype")))
    m = m.select(F.col("path").alias("mask_path"), parent(F.col("path")).alias("_p"), F.col("rows").alias("_r"), F.col("cols").alias("_c"), token(F.col("frequency")).alias("_f"))
    s = datasets.filter("role = 'science'").withColumn("_p", parent(F.col("path"))).withColumn("_f", token(F.col("frequency")))
    return s.join(m, (s["_p"] == m["_p"]) & (s["_f"] == m["_f"]) & (s["rows"] == m["_r"]) & (s["cols"] == m["_c"]) & (s["_p"] != ""), "left").select(*datasets.columns, "mask_path")


def _reasons(*issues: tuple[Column, str | Column]) -> Column:
    return F.concat_ws("; ", *(F.when(F.coalesce(bad, F.lit(False)), F.lit(text) if isinstance(text, str) else text) for bad, text in issues))


def _declared_masks(datasets: DataFrame) -> DataFrame:
    """Whatever is called mask beside a layer, valid or not."""
    return datasets.filter("name = 'mask'").select(parent(F.col("path")).alias("_mp"), F.lit(True).alias("declared"))


def pauli_capabilities(datasets: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(frequency, available, reason, mask_path): whether Pauli colours can be made, or all that is missing."""
    masks = sibling_masks(datasets).select(F.col("path").alias("_path"), "mask_path")
    d = datasets.join(masks, F.col("path") == F.col("_path"), "left").select(F.struct(*(datasets[c] for c in ("path", "name", "frequency", "role", "layer_kind", "dtype", "rows", "cols", "units", "grid_mapping")), "mask_path").alias("d"))
    f = frequencies.withColumn("term", F.explode(F.array(*map(F.lit, PAULI_TERMS))))
    j = f.join(d, F.col("d.path") == F.concat(F.regexp_replace("group_path", "/$", ""), F.lit("/"), F.col("term")), "left")
    one = j.groupBy("name", "group_path", "x", "y").agg(*(F.first(F.when(F.col("term") == t, F.col("d")), ignorenulls=True).alias(f"t{k}") for k, t in enumerate(PAULI_TERMS)))
    one = one.join(_declared_masks(datasets), F.col("group_path") == F.col("_mp"), "left")
    t = [F.col(f"t{k}") for k in range(4)]
    missing = _reasons(*((t[k].isNull(), f"missing {n} covariance term") for k, n in enumerate(PAULI_TERMS)))
    rows, cols = t[0]["rows"], t[0]["cols"]
    issues: list = []
    for k, n in enumerate(PAULI_TERMS):
        issues += [
            (t[k]["name"] != n, f"{n} has inconsistent dataset metadata"),
            (token(t[k]["frequency"]) != token(F.col("name")), F.concat(F.lit(f"{n} does not belong to frequency "), F.col("name"))),
            (t[k]["role"] != "science", f"{n} is not a science dataset"),
        ]
    for k, n in enumerate(PAULI_TERMS[:3]):
        issues.append(((t[k]["layer_kind"] != "gcov_diagonal_covariance") | ~is_float32(t[k]["dtype"]), f"{n} must be a readable float32 diagonal covariance"))
    issues.append(((t[3]["layer_kind"] != "gcov_off_diagonal_covariance") | ~is_complex64(t[3]["dtype"]), "HHVV must be a readable complex64 cross covariance"))
    trim = lambda c: F.trim(F.coalesce(c, F.lit("")), F.lit(" \t\r\n"))
    differ = lambda test: test(1) | test(2) | test(3)
    grid = (F.col("y.count") == rows) & (F.col("x.count") == cols) & (rows != 0) & (cols != 0)
    issues += [
        ((rows == 0) | (cols == 0), "Pauli source dimensions are empty"),
        (differ(lambda k: (t[k]["rows"] != rows) | (t[k]["cols"] != cols)), "Pauli covariance terms have different dimensions"),
        (differ(lambda k: trim(t[k]["grid_mapping"]) != trim(t[0]["grid_mapping"])), "Pauli covariance terms use different grid mappings"),
        (differ(lambda k: ~units_compatible(t[0]["units"], t[k]["units"])), "Pauli covariance terms use incompatible units"),
        (~grid, "frequency grid dimensions do not match the Pauli sources"),
        (grid & ~(axis_usable(F.col("x")) & axis_usable(F.col("y"))), "frequency grid coordinate metadata is incomplete"),
        (F.col("declared").isNotNull() & t[0]["mask_path"].isNull(), "Pauli sibling mask is unreadable or grid-incompatible"),
    ]
    reason = F.when(missing != "", missing).otherwise(_reasons(*issues))
    shared = F.when((t[1]["mask_path"] == t[0]["mask_path"]) & (t[2]["mask_path"] == t[0]["mask_path"]) & (t[3]["mask_path"] == t[0]["mask_path"]), t[0]["mask_path"])
    return one.withColumn("reason", reason).select(F.col("name").alias("frequency"), (F.col("reason") == "").alias("available"), "reason", F.when(F.col("reason") == "", shared).alias("mask_path"))


def compare_capabilities(datasets: DataFrame, frequencies: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (first, second) -> (first, second, mode, available, reason) for the four modes."""
    masks = sibling_masks(datasets).select(F.col("path").alias("_path"), "mask_path")
    d = datasets.join(masks, F.col("path") == F.col("_path"), "left").join(_declared_masks(datasets), parent(F.col("path")) == F.col("_mp"), "left")
    d = d.select(F.struct(*(datasets[c] for c in ("path", "frequency", "role", "layer_kind", "dtype", "rows", "cols", "units", "grid_mapping")), "mask_path", F.coalesce("declared", F.lit(False)).alias("declared")).alias("d"))
    j = pairs
    for side in ("first", "second"):
        j = j.join(d.select(F.col("d").alias(side[0])), F.col(f"{side[0]}.path") == F.col(side), "left")
    f = frequencies.select(token(F.col("name")).alias("_f"), "x", "y", F.lit(True).alias("known"))
    j = j.join(f, token(F.col("f.frequency")) == F.col("_f"), "left")
    a, b = F.col("f"), F.col("s")
    raster = lambda t: is_float32(t["dtype"]) | is_complex64(t["dtype"])
    both = a.isNotNull() & b.isNotNull()
    related = ((a["role"] == "science") & (b["role"] == "science")) | ((a["layer_kind"] == b["layer_kind"]) & (a["layer_kind"] != "auxiliary")) | ((token(a["units"]) != "") & units_compatible(a["units"], b["units"]))
    side = _reasons(
        (a.isNull(), "first dataset path is not in the catalog"), (b.isNull(), "second dataset path is not in the catalog"),
        (both & (a["path"] == b["path"]), "choose two different datasets"),
        (both & ~raster(a), "first dataset is not a readable numeric science raster"), (both & ~raster(b), "second dataset is not a readable numeric science raster"),
        (both & raster(a) & raster(b) & ~related, "datasets do not share a science role, layer kind, or units"),
    )
    same_f = (a["frequency"] != "") & (token(a["frequency"]) == token(b["frequency"]))
    trim = lambda c: F.trim(F.coalesce(c, F.lit("")), F.lit(" \t\r\n"))
    same_size = (a["rows"] == b["rows"]) & (a["cols"] == b["cols"]) & (a["rows"] != 0) & (a["cols"] != 0)
    bad_mask = (a["declared"] & a["mask_path"].isNull()) | (b["declared"] & b["mask_path"].isNull())
    on_grid = F.lit(True)
    for t in (a, b):
        on_grid = on_grid & (F.col("y.count") == t["rows"]) & (F.col("x.count") == t["cols"]) & (t["rows"] != 0) & (t["cols"] != 0)
    known = F.coalesce(F.col("known"), F.lit(False))
    strict = _reasons(
        (~same_f, "aligned comparison requires the same frequency"),
        (~same_size, "aligned comparison requires identical non-empty dimensions"),
        (trim(a["grid_mapping"]) != trim(b["grid_mapping"]), "aligned comparison requires the same grid mapping"),
        (~units_compatible(a["units"], b["units"]), "aligned comparison requires compatible units"),
        ((a["dtype"]["kind"] == "complex") != (b["dtype"]["kind"] == "complex"), "aligned comparison requires both sources to be real or both complex"),
        (bad_mask, "aligned comparison has an unreadable or grid-incompatible mask"),
        (~bad_mask & ~a["mask_path"].eqNullSafe(b["mask_path"]), "aligned comparison requires the same validity mask policy"),
        (same_f & ~known, "frequency grid metadata is missing from the catalog"),
        (same_f & known & ~on_grid, "dataset dimensions do not match the frequency grid"),
        (same_f & known & on_grid & ~(axis_usable(F.col("x")) & axis_usable(F.col("y"))), "frequency grid coordinate metadata is incomplete"),
    )
    got = j.select("first", "second", side.alias("side"), strict.alias("strict"))
    strict_reason = F.when(F.col("side") != "", F.concat(F.lit("side-by-side prerequisite failed: "), F.col("side"))).otherwise(F.col("strict"))
    modes = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), (F.col("side") if m == "side_by_side" else strict_reason).alias("reason")) for m in MODES))).alias("m")
    return got.select("first", "second", modes).select("first", "second", "m.mode", (F.col("m.reason") == "").alias("available"), "m.reason")


def number_json(c: Column) -> Column:
    """A number as JSON text; NaN and the infinities as strings."""
    return F.when(c.isNull(), "null").when(F.isnan(c), '"NaN"').when(c == float("inf"), '"Infinity"').when(c == float("-inf"), '"-Infinity"').otherwise(c.cast("string"))


def layer_json(datasets: DataFrame) -> DataFrame:
    """(path, json): one object a layer."""
    d = F.col
    obj = F.struct(
        d("path"), d("name"), d("frequency"), d("role"), d("layer_kind"), F.array("rows", "cols").alias("shape"),
        F.struct(d("dtype.kind").alias("kind"), d("dtype.bytes").alias("canonical_element_bytes"), d("dtype.readable").alias("readable")).alias("dtype"),
        F.when(d("chunk_rows").isNotNull(), F.array("chunk_rows", "chunk_cols")).alias("chunks"), d("layout"), d("units"), d("long_name"),
    )
    return datasets.select("path", F.to_json(obj, {"ignoreNullFields": "false"}).alias("json"))


def product_json(datasets: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(frequency, json): a frequency with its grid and layers, layers by path."""
    layers = layer_json(datasets).join(datasets.select("path", "frequency"), "path").groupBy("frequency").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "json"))), lambda x: x["json"]), ",").alias("layers"))
    axis = lambda a: F.concat(F.lit('{"first":'), number_json(F.col(f"{a}.first")), F.lit(',"last":'), number_json(F.col(f"{a}.last")), F.lit(',"spacing":'), number_json(F.col(f"{a}.spacing")), F.lit("}"))
    f = frequencies.join(layers, frequencies["name"] == layers["frequency"], "left")
    text = F.concat(
        F.lit('{"name":"'), F.col("name"), F.lit('","group_path":"'), F.col("group_path"), F.lit('","grid":{"rows":'), F.col("y.count").cast("string"), F.lit(',"columns":'), F.col("x.count").cast("string"),
        F.lit(',"x":'), axis("x"), F.lit(',"y":'), axis("y"), F.lit(',"epsg":'), F.coalesce(F.col("epsg").cast("string"), F.lit("null")), F.lit('},"layers":['), F.coalesce("layers", F.lit("")), F.lit("]}"),
    )
    return f.select(F.col("name").alias("frequency"), text.alias("json"))


def identification(fields: dict[str, str], instruments: list[str]) -> dict[str, str | None]:
    """A product's checked identification, from its metadata strings."""
    instrument = next((i for i in INSTRUMENTS if i in instruments), None)
    if instrument is None:
        raise ValueError("neither instrument group is there")
    kind = fields.get("productType", "").strip().upper()
    if kind not in PRODUCT_TYPES:
        raise ValueError(f"product type {kind!r} is not supported")
    for k in ("granuleId", "productVersion"):
        if not fields.get(k):
            raise ValueError(f"{k} is missing")
    return {"product_type": kind, "granule_id": fields["granuleId"], "product_version": fields["productVersion"], "specification_version": fields.get("productSpecificationVersion"), "instrument": instrument}
