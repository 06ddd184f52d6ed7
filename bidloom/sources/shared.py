"""The folder that driver and executors share, and intermediate tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Only a local session that names none gets a local folder; elsewhere each executor would write
    to its own disk, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


class Workspace:
    """Intermediate tables of one job, as Parquet below one new path of the shared folder.

    A written table cuts the lineage: what follows reads files, so a lost executor neither repeats
    what came before nor sees other row ids than the first reader did.  The shuffles of a write end
    with it, as nothing reads them again.
    """

    _ENDED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, shared_folder(spark)

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        """``df`` as a written table."""
        before = self.spark.conf.get(self._ENDED, "false")
        self.spark.conf.set(self._ENDED, "true")
        try:
            df.write.option("compression", "zstd").parquet(f"{self.path}/{tag}")
        finally:
            self.spark.conf.set(self._ENDED, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{tag}")

    def drop(self, *tags: str) -> None:
        """Delete tables that no later step reads."""
        for tag in tags:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{tag}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
