"""Session construction and shared scratch locations."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "flagloom") -> SparkSession:
    """A session tuned for this library: AQE on, UI off, UTC clock.

    On a cluster ``master`` stays ``None`` so the launcher decides; tests and
    the bench pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _context(spark: SparkSession):
    """The SparkContext of a classic session; ``None`` on Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:  # Connect sessions have no driver-side context
        return None


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read through ``spark.conf``, so Connect sessions work too. A missing setting
    is an error: a folder of one machine is invisible to the others. A
    single-machine caller (tests, bench) sets one with
    :func:`use_local_checkpoints`.
    """
    sc = _context(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and sc is not None:
        root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster's "
                           "distributed file system) before running flagloom jobs")
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def use_local_checkpoints(spark: SparkSession) -> None:
    """Where ``spark.checkpoint.dir`` is unset in a local-mode session, set it
    beside the session's warehouse. Does nothing otherwise."""
    sc = _context(spark)
    if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        return
    if not (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint root, as a full address.

    A root without a scheme is one of the cluster's default file system, as Spark
    itself reads it; with the scheme, tasks that open files by themselves find the
    same folder. Whoever owns that root cleans it: results may still be read from the folder
    after the query that made it returns."""
    root = checkpoint_root(spark)
    if not re.match(r"[A-Za-z][\w+.-]*:/", root):
        root = _qualified(spark, root)
    return f"{root}/flagloom-{name}-{uuid.uuid4().hex[:12]}"


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority of the default file system."""
    sc = _context(spark)
    if sc is None:  # Connect: the server resolves the address, and no task opens it by itself
        return path
    full = sc._jvm.org.apache.hadoop.fs.Path(path)
    return full.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(full).toString()
