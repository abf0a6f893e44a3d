"""Sends this package to Python workers and cuts lineage in the shared folder."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once for each Spark context (Spark's own file server copies the zip)."""
    sc = spark.sparkContext
    if getattr(sc, "_tessella_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tessella-zip-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "tessella.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    sc._tessella_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a folder of this process, in local mode alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own.get("dir")
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if folder is None:
        folder = _own["dir"] = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, folder, True)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def cut_estimates(df: DataFrame) -> DataFrame:
    """cut_lineage() without the plan's estimated size, which a checkpoint hands on.

    A join multiplies the estimates of its sides. In a loop of joins the number's digits therefore multiply with each round, until
    the driver's planner computes numbers of megabytes. The frame read back has Spark's default estimate instead.
    """
    cut = cut_lineage(df)
    session = df.sparkSession
    rows = cut._jdf.queryExecution().analyzed().rdd()
    return type(cut)(session._jsparkSession.internalCreateDataFrame(rows, cut._jdf.schema(), False), session)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of frames that are gone: its cleaner learns of them when the driver's heap is collected, which a
    loop of jobs with large executors may not bring about for long."""
    gc.collect()
    spark._jvm.System.gc()
