"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the operators' contracts define it; a word is a run of anything else.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Used only by a local session that names no checkpoint directory (tests, notebooks).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tidemark"

#: Whether Spark removes the shuffle files of a query when it ends, instead of whenever the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a local session that names none gets a local one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(LOCAL_CHECKPOINTS)
    return LOCAL_CHECKPOINTS


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What the queries run in here shuffle is removed as soon as they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor makes Spark redo only what follows.  The
    files are removed when the Python process ends.  What the query shuffled is
    removed at once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    relieve(spark)
    return spark.read.schema(df.schema).parquet(path)


def relieve(spark: SparkSession) -> None:
    """Give back what the driver has used for the last query.

    Plans, generated classes and what compiled them are garbage after a query,
    but the allocator keeps what is freed, and a heap grows to its limit before
    most of it is collected: after many queries in a row these add up.
    """
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        jvm.java.lang.System.gc()
    trimmed(spark)


def trimmed(spark: SparkSession) -> bool:
    """Whether the driver's JVM could give back what its allocator keeps; HotSpot on Linux can."""
    sc = spark.sparkContext
    jvm, args = sc._jvm, sc._gateway.new_array(sc._jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # by the interface: the server's own class is not open to py4j
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        invoke.invoke(server, args)
    except Py4JError:
        return False
    return True


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing reads any more."""
    for entry in list(_written):
        if any(entry[1].rpartition("/")[2] in f for f in df.inputFiles()):
            _remove(*entry)
            _written.remove(entry)


def settled(build, name: str) -> DataFrame:
    """``build()`` materialized, and what it materialized on the way, and reads no more, removed."""
    before = {path for _, path in _written}
    out = materialize(build(), name)
    for entry in _written[:-1]:
        if entry[1] not in before:
            _remove(*entry)
            _written.remove(entry)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone by now
            return


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, an Arrow function, that gives what it freed back to the system when its task ends.

    Python workers are used again by later tasks of other operators; memory
    that the allocators keep would count twice there.
    """

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim is not None:
                trim(0)

    return released


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for internal columns that no column of ``df`` has (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def q(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
