"""Session handling: UTC rendering, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup table is broadcast only when it has been counted at or below this
# many rows (a few MB for the narrow tables used here). Above it the join is
# left to shuffle, where adaptive execution splits hot keys.
BROADCAST_ROW_LIMIT = 100_000
# Pieces of work that run at the same time. More of them only queue for the cores and fill the driver with plans.
AT_ONCE = 6
# Share of the driver's heap from which its garbage is collected between pieces of work.
HEAP_SHARE = 0.6


def prepare(spark: SparkSession) -> SparkSession:
    """Render timestamps in UTC; local dates are derived explicitly from the zone.

    The cleaning projection is long. Generated methods above 8000 bytes are never
    compiled by HotSpot, so longer stages are told to use the split form instead.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Spread a log stored in fewer splits than there are cores before parsing it.

    Only small inputs have so few splits; a large log is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster for checkpoints and written stage tables."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="kerbwise-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Compute a lookup table once; mark it for broadcast only if it is small."""
    stored = cut(df)
    rows = stored.limit(limit + 1).count()
    return F.broadcast(stored) if rows <= limit else stored


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` marked so that a join with it shuffles both sides.

    The planner guesses the size of a table from the bytes of its files, and rows multiplied since
    (offered to several boxes, or read from well-packed columns) do not count. Such a join would be broadcast
    by a guess and fill the driver.
    """
    return df.hint("merge")


def trim_jvm(spark: SparkSession) -> None:
    """Return freed native memory of the driver's JVM. What its compilers and libraries free stays in the C library's arenas,
    one for each of many threads, and grows with every plan; a JVM that cannot hand it back is left as it is."""
    if not hasattr(spark, "_jvm"):
        return
    jvm = spark._jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(server, given)
    except Py4JError:
        pass


def ease_driver(spark: SparkSession) -> None:
    """Collect the garbage of plans that ended once the driver's heap has grown to most of what it may take, and hand back
    freed memory: a heap left to itself fills to its limit on top of what threads and compiled code hold."""
    if not hasattr(spark, "_jvm"):
        return
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        spark._jvm.java.lang.System.gc()
    trim_jvm(spark)


def together(spark: SparkSession, **work: Callable[[], Any]) -> dict[str, Any]:
    """Results of pieces of work that do not need each other, by name; their Spark jobs share the cluster.

    Many short jobs in a row leave most cores idle when they run alone. Up to AT_ONCE pieces run, the first named first, and the
    driver hands back after each what it has freed.
    """
    def one(piece: Callable[[], Any]) -> Any:
        found = piece()
        ease_driver(spark)
        return found

    with ThreadPoolExecutor(min(len(work), AT_ONCE)) as pool:
        started = {name: pool.submit(inheritable_thread_target(spark)(one), piece) for name, piece in work.items()}
        return {name: piece.result() for name, piece in started.items()}
