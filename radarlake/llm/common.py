"""What the operators share: shared-folder checkpoints, skew-aware joins, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radarlake.session import workers_can_import  # noqa: F401  used by the operators

#: A key is hot when it holds more than one in so many rows; there are fewer such keys than this.
HOT_SHARE = 256

_written: dict[str, SparkSession] = {}
_own: dict[str, str] = {}


class Memo(dict):
    """token -> what make gives for it; emptied when it grows large."""

    def __init__(self, make, most: int = 150_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, token):
        if len(self) >= self.most:
            self.clear()
        got = self[token] = self.make(token)
        return got


def frugal(run: Callable, rows: int = 512) -> Callable:
    """A mapInArrow function that sees at most ``rows`` rows at once and gives memory back at its end.

    Spark's batches are counted in rows, whatever their texts' length; and a worker
    that is used again would keep what the task before it had.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or that of setCheckpointDir.

    Where neither is set, a session in this one process gets a temporary folder (tests);
    on a cluster, whose machines share no such folder, that is an error.
    """
    context = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or _own.get(context.applicationId)
    if not got:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="radarlake-")
    return got.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write Parquet to the shared folder, once, and read it back.

    Lost executors cost nothing afterwards, since the files are not theirs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/radarlake/{uuid.uuid4().hex}"
    df.write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    _written[path] = spark
    got._radarlake_path = path
    return got


def discard(*frames: DataFrame) -> None:
    """Delete what materialize() wrote of frames that nothing reads any more, and let shuffle files go."""
    for df in frames:
        path = getattr(df, "_radarlake_path", None)
        if path in _written:
            _delete(_written.pop(path), path)
    gc.collect()
    if frames:
        frames[0].sparkSession.sparkContext._jvm.System.gc()  # Spark removes shuffle files once their plans are collected


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the folder's owner cleans it
            pass


def attach(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row for each key and in ``weight`` its rows in left.

    Keys that hold over 1/256 of left are joined by broadcast (fewer than 256 rows,
    whatever the input), the rest by a shuffle in which no key is hot. ``left`` is
    read twice: pass a materialized one.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.filter(F.col(weight) * HOT_SHARE > F.lit(total))
    cold = right.filter(~(F.col(weight) * HOT_SHARE > F.lit(total)))
    one = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return one.unionByName(rest).drop(weight)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): (node, root), root the smallest node reached.

    Alternating large-star and small-star rounds over a distributed edge list until
    nothing changes; no link or component reaches the driver, only a count and a
    checksum. A centre with many neighbours is joined by broadcast, so no task gets all
    of a large star. What a round has written goes once the next one is.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(now)
    while True:
        both = materialize(now.union(now.select("b", "a")))
        star = least(both).withColumn("m", F.least("a", "m"))
        big = attach(both, star, "a", "_n").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = materialize(big.filter("a <> b").distinct())
        star = least(big)
        small = attach(big, star, "a", "_n")
        last, now = now, small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(now.union(star.select("a", F.col("m").alias("b"))).distinct())
        discard(last, both, big)
        after = mark(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
