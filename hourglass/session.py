"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "hourglass", cpus: int | str | None = None,
              shuffle_partitions: int | None = None,
              driver_memory: str = "8g") -> SparkSession:
    """Local session with the settings the library assumes.

    On a cluster the submitter owns master/memory; this helper only fills in
    what is unset.  Shuffle partitions default to 2x cores locally; AQE
    coalesces them at runtime and splits skewed join partitions.
    """
    from pyspark import SparkConf

    given = SparkConf()  # what spark-submit or the environment has set wins
    local = given.get("spark.master", "local").startswith("local")
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    ours = {
        "spark.master": f"local[{cpus}]",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if local:
        ours["spark.driver.memory"] = driver_memory
        ours["spark.sql.shuffle.partitions"] = str(shuffle_partitions or max(2, 2 * int(cpus)))
    builder = SparkSession.builder.appName(app)
    for key, value in ours.items():
        if not given.contains(key):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; we only create a private one when
    the setting is missing (local tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="hourglass-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/hourglass-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df, spark: SparkSession | None = None, name: str = "stage"):
    """Materialize ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    One job computes ``df`` once (a reliable ``checkpoint()`` would compute it
    twice unless cached), the files survive executor loss, and the reader gets
    real file sizes for join planning.  The lineage of the result starts at
    the written table.
    """
    spark = spark or df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
