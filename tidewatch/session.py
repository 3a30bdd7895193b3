"""Session set-up and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "tidewatch", **conf: str) -> SparkSession:
    """A session with the settings the library relies on; ``conf`` overrides any of them.

    On a cluster leave ``master`` unset and let spark-submit decide. Shuffle partitions are left to
    AQE coalescing: start from a generous number and let the runtime merge small ones.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of this machine, because only there do
    driver and executors share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="tidewatch-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a small intermediate result to the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, and the planner then knows the real
    size: joins against it broadcast only below ``spark.sql.autoBroadcastJoinThreshold``. ``options``
    are the Parquet writer's.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.options(**options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediates, wherever it is stored; a missing one is fine."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def folder_values(spark: SparkSession, path: str, name: str) -> list[str]:
    """The values of the folders ``name=value`` right under ``path``; only folder names are read."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    names = [f.getPath().getName() for f in found if f.isDirectory()]
    return [n.partition("=")[2] for n in names if n.startswith(f"{name}=")]
