"""Tables that iterative operators write between steps, in the folder the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The fewest tasks of a step whose work is large beside its input.
FEWEST_TASKS = 96
_OWN: dict[str, str] = {}


def task_count(spark: SparkSession) -> int:
    """Tasks to deal such a step into: input of few bytes is read in few partitions, and small ones are joined."""
    return max(FEWEST_TASKS, 4 * spark.sparkContext.defaultParallelism)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one if Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="auditlake-shared-")
            atexit.register(shutil.rmtree, _OWN[app], True)
        root = _OWN[app]
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; the file system drops it when the session's JVM ends."""
    path = f"{shared_dir(spark)}/auditlake/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
