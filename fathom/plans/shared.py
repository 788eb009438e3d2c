"""Tables written once to the folder that spark.checkpoint.dir names, so that a lost executor loses nothing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share; a temporary one only on a local master without spark.checkpoint.dir."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = _local.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="fathom-core-"))
    return f"{named.rstrip('/')}/fathom-core-{context.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for path, spark in _written.items():
        with contextlib.suppress(Exception):  # the session may already be gone at exit
            remove(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what lies there is removed when the driver exits."""
    base = shared_folder(spark)
    _written[base] = spark
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
