"""Lineage cuts: tables written once to the cluster's shared folder and read back."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset on a local master (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="fathom-"))
    return f"{named.rstrip('/')}/fathom-{app}"


def _remove_all() -> None:
    for path, spark in _written.items():
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may already be gone at exit
            return


atexit.register(_remove_all)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and return a reader of it.

    A lost executor loses nothing that a later stage needs, and the plan above starts at a scan
    with known sizes. The application's folder is removed when the driver exits.
    """
    spark = df.sparkSession
    base = shared_dir(spark)
    _written[base] = spark
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch of texts, where the session has left Spark's own sizes.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_DEFAULTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": (None, BATCH_BYTES)}


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, as each is held several times over; a session's own sizes stay."""
    set_by_hand = spark.sparkContext.getConf()
    for name, (usual, ours) in _DEFAULTS.items():
        now = spark.conf.get(name, None)
        if now is not None and not set_by_hand.contains(name) and (usual is None or now == usual):
            spark.conf.set(name, str(ours))


def settle(spark: SparkSession) -> None:
    """Have every executor collect its garbage, so that its JVM gives back the heap that an earlier stage left unused.

    Idle executors get a task each before one gets a second; a busy one may get none, and only keeps its heap.
    """
    executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size()  # with the driver, which is the only one on a local master
    spark.range(0, executors, 1, executors).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after whose last batch a Python worker gives freed memory back; else it keeps it for as long as it waits for tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
            if trim:
                trim(0)

    return wrapped
