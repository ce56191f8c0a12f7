"""Sessions: the settings that results depend on, and the workers' import path."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import SparkSession

#: Where stage tables and checkpoints go in local mode if the session names no folder.
LOCAL_SHARED = "/tmp/checkpoints"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(app: str = "lodestone", master: str | None = None, **conf: object) -> SparkSession:
    """UTC, adaptive execution; everything else as the cluster has it, or as conf says (dots as double underscores)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), str(v))
    return reach(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without it: it gets a new folder below LOCAL_SHARED,
    which goes when the process ends. A cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"{LOCAL_SHARED}/{uuid.uuid4().hex}"
    os.makedirs(own)
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def reach(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package from where the driver has it.

    On a cluster the package comes with --py-files or an installed wheel; the extra
    entry then does no harm.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark
