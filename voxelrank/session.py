"""Session factory with the settings that the operators expect."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def session(master: str | None = None, app: str = "voxelrank", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; ``conf`` adds or overrides settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="voxelrank-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the driver process ends."""
    path = f"{shared_dir(spark)}/voxelrank-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_clean)
    _scratch.append((spark, path))
    return path


def _clean() -> None:
    while _scratch:
        spark, path = _scratch.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already
            return


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, for what is costly and used more than once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
