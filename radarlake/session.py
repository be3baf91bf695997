"""Sessions, and what Python workers need of them."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Settings the engine is written for; a cluster's own settings win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("radarlake")
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def workers_can_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver did (a cluster gets it with --py-files)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)


_own: dict[str, str] = {}


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
