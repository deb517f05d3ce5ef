"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "riskloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and skew-join handling."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Generated methods beyond this size are never compiled by the JVM; smaller ones take their place.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # Rows partitioned by user need no second shuffle for a join on (user, card).
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode when none is set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="riskloom-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder."""
    return f"{shared_folder(spark)}/riskloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def settle(frame: DataFrame) -> DataFrame:
    """``frame`` as a table written to the shared folder and read back.

    It is computed once, later reads see the same rows even if executors are lost, prune columns and
    know the size; and, unlike a checkpointed plan, it is not evaluated a second time for the copy.
    """
    return _settled(frame, new_folder(frame.sparkSession, "table"))


def _settled(frame: DataFrame, path: str) -> DataFrame:
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


class Scratch:
    """Settled tables that only one job reads: leaving the ``with`` block deletes them.

    What outlives the block must be settled outside of it first.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, new_folder(spark, "scratch")

    def __enter__(self) -> Scratch:
        return self

    def settle(self, frame: DataFrame) -> DataFrame:
        return _settled(frame, f"{self.folder}/{uuid.uuid4().hex}")

    def __exit__(self, *error) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
