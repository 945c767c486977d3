"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of each local application that named none.
_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session without one (as in tests) gets a temporary folder of its own; on a cluster a missing
    setting is an error, as executors don't share local folders. The session's settings stay as they are."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="millrace-"))
    return root.rstrip("/")


class Scratch:
    """Places in the shared folder that are deleted together, by clear() or at the end of a with block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()

    def path(self) -> str:
        """A place that nothing else uses."""
        self.paths.append(f"{scratch_root(self.spark)}/millrace/{uuid.uuid4().hex}")
        return self.paths[-1]

    def write(self, df: DataFrame) -> DataFrame:
        """Cut the lineage: write df as Parquet and read it back."""
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        context = self.spark.sparkContext
        for path in self.paths:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage for a result that outlives the call: the table stays until the shared folder is cleaned."""
    return Scratch(df.sparkSession).write(df)
