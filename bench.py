"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and is then timed to the end of a noop write. The two
a 4,194,304-value histogram and a 2048 x 2048 filter, from generated pixels.
"""

from __future__ import annotations

import json
import os
import sys
import time

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = (
    "flagship", "scan_window", "lod_sample_masked", "aligned_join_4", "tx_power_db", "tx_correlation", "pauli_pack", "cmp_ratio_db", "cmp_pack", "dist_counts_by_chunk",
    "dist_histogram", "dist_percentiles", "speckle_boxcar_5", "speckle_lee_5", "speckle_kernel_lee_5", "disp_colorize", "disp_bilinear", "chunk_statistics", "compare_capability",
)


def main() -> None:
    from pyspark.sql import functions as F

    from radarlake.operators import chunked
    from radarlake.registry import QUERIES
    from radarlake.session import session, workers_can_import

    spark = session(f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    workers_can_import(spark)

    def page(side: int):
        """A generated layer in chunks of 256 x 256, in memory."""
        n = 256
        values = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: ((F.xxhash64(F.col("id"), k) % 100_003) / 1000.0 + 101).cast("float"))
        at = spark.range((side // n) ** 2, numPartitions=int(CPUS)).withColumn("r", F.expr(f"id div {side // n}")).withColumn("c", F.col("id") % (side // n))
        return at.select(F.lit("x").alias("layer"), F.col("r").alias("chunk_row"), F.col("c").alias("chunk_col"), (F.col("r") * n).alias("row0"), (F.col("c") * n).alias("col0"), F.lit(n).alias("height"), F.lit(n).alias("width"), values.alias("values"))

    kept = page(2048).cache()
    kept.count()
    runs = {n: (lambda n=n: QUERIES[n](spark, SF)) for n in sys.argv[1:] or NAMES}
    if not sys.argv[1:]:
        runs["base_histogram_4m"] = lambda: chunked.summary(kept)
        runs["base_lee_5_2048"] = lambda: chunked.speckle(kept, (2048, 2048), (256, 256), "lee", 5, 3.0)
        runs["base_boxcar_5_2048"] = lambda: chunked.speckle(kept, (2048, 2048), (256, 256), "boxcar", 5)
    took = {}
    for name, make in runs.items():
        for _ in range(2):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds_warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
