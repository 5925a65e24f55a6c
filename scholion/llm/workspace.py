"""Shared folders, sizes and batches: intermediate tables go where every executor can read them."""

import atexit
import ctypes
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch: a batch of texts stays at a few MB in the JVM and in the worker.
BATCH_ROWS = 512
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which a cluster sets. Where it is unset a local master, as in tests, gets a new
    local folder; any other fails, for its executors would each write to a disk of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="scholion-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return f"{at.rstrip('/')}/scholion-{uuid.uuid4().hex}"


def remove(spark: SparkSession, at: str) -> None:
    """The folder and all in it, if the session still runs."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    except Exception:  # noqa: BLE001  a session that has ended, or a store that is gone, keeps the folder
        pass


def table(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, and is computed once.

    few: a table of a few numbers a row has at most an eighth of the shuffle partitions as files, but two for each core at
    least. The folder goes when the program ends, or before that by drop()."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}"
    files = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    (df.coalesce(files) if few else df).write.parquet(at)
    _kept[at] = weakref.ref(spark)
    out = spark.read.schema(df.schema).parquet(at)
    out._scholion_at = at
    return out


def drop(*tables: DataFrame | None) -> None:
    """Removes the folders of tables that nothing will read again; what table() did not make is left alone."""
    for df in tables:
        at = getattr(df, "_scholion_at", None)
        if at and _kept.pop(at, None):
            remove(df.sparkSession, at.rpartition("/")[0])


_kept: dict[str, weakref.ref] = {}


@atexit.register
def _at_exit() -> None:
    for at, ref in list(_kept.items()):
        if (spark := ref()) is not None and spark.sparkContext._jsc is not None:
            remove(spark, at.rpartition("/")[0])


def _release() -> None:
    """Gives free memory of this worker back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def per_batch(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) over batches of BATCH_ROWS rows, unless the session sets another number than Spark's own;
    a task's worker gives its free memory back at the end."""

    def whole(batches):
        yield from run(batches)
        _release()

    conf = df.sparkSession.conf
    if conf.get(_BATCHES, "10000") == "10000":
        conf.set(_BATCHES, str(BATCH_ROWS))
    return df.mapInArrow(whole, schema)


def partitions(df: DataFrame, each: int = 64 << 20) -> int:
    """Shuffle partitions for work on all of df: the session's number, more if the tables it reads are larger.

    Leaves whose size Spark does not know count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 55)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1_000_000, known // each))
