"""Tables under the shared checkpoint folder that cut the lineage of iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is named and
    all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="docketlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Steps:
    """Keeps the latest states of an iteration as Parquet; older ones are deleted as they are replaced."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}", 0
        self.paths: list[str] = []
        atexit.register(self.forget)

    def keep(self, df: DataFrame, states: int = 4) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        self.paths.append(path)
        while len(self.paths) > states:
            self._delete(self.paths.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def forget(self) -> None:
        """Deletes all states."""
        try:
            self._delete(self.root)
        except Exception:  # the session has ended; the cluster clears the folder
            pass
