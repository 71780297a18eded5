"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and single-machine runs. Cluster deployments bring their own."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | extra
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give heavy row-wise work as many partitions as there are cores, if the input has fewer (a few small files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir. A machine's own folder serves only where all runs on it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables, in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there.

    The files survive the loss of executors. They are removed once the result is no longer referenced
    (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)
    # A checkpointed frame hands on the constraints of the plan it came from; over many rounds of joins they multiply.
    # A frame made from its rows has none.
    jdf = spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    return DataFrame(jdf, spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a cluster that doesn't have it installed (once a context)."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="millrace-ship-"), "millrace_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f"millrace/{f.relative_to(PACKAGE)}")
    sc.addPyFile(path)
    sc._millrace_shipped = True


def broadcast_below(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only if the measured number of rows is within the limit."""
    return F.broadcast(df) if rows <= limit else df
