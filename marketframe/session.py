"""Session settings this package is tuned for."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def spark_session(app: str = "marketframe", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session with adaptive execution on and UTC timestamps.

    Nothing here fixes the number of shuffle partitions on a cluster: adaptive
    execution coalesces from ``initialPartitionNum``, which the cluster sets.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """The session used by tests and ``bench.py``."""
    return spark_session(
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": os.environ.get("MARKETFRAME_DRIVER_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            **conf,
        },
    )


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared checkpoint folder, set on the context if it is not yet.

    The cluster names it in ``spark.checkpoint.dir``; ``fallback`` only counts where it named none.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if named and not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, kind: str = "kept") -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names.

    Where none is named a local master gets a temporary folder; other masters are refused, since their executors share
    no such folder.
    """
    folder = checkpoint_dir(spark)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = checkpoint_dir(spark, tempfile.mkdtemp(prefix="checkpoints-"))
    return f"{folder.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: computed once, cheap to read again, and safe from lost executors."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver found it, whatever folder they start in."""
    root = str(Path(__file__).resolve().parents[1])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark
