"""Session helpers: the shared work folder, and cutting lineage of small derived tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by spark.checkpoint.dir.

    Only a local-mode session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return tempfile.mkdtemp(prefix="colscope-")


def new_folder(spark: SparkSession, stem: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


#: Jobs that one call submits side by side at most.
SIDE_BY_SIDE = 8


def side_by_side(tasks: Iterable[Callable], at_once: int = SIDE_BY_SIDE) -> list:
    """Results of independent Spark actions submitted from threads of their own, in order.

    Small jobs leave most of a cluster idle; together they share it. Where the session schedules fairly, each keeps its pool.
    """
    tasks = list(tasks)
    with ThreadPoolExecutor(max(1, min(at_once, len(tasks)))) as pool:
        return [f.result() for f in [pool.submit(inheriting(t)) for t in tasks]]


def inheriting(task: Callable) -> Callable:
    """The task with the calling thread's job group, pool and tags."""
    session = SparkSession.getActiveSession()
    return (inheritable_thread_target(session) if session else inheritable_thread_target)(task)


ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def local_table(spark: SparkSession, rows, ddl: str) -> DataFrame:
    """A few driver-side rows (schemas, bounds, counts) as a local relation.

    Unlike a parallelised list it has a known size and is part of the plan, so joins with it are
    planned as what they are and no Python data travels to the executors.
    """
    schema = T.StructType.fromDDL(ddl)
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    columns = [pa.array(c, ARROW_TYPES[f.dataType.simpleString()]) for c, f in zip(zip(*rows), schema)]
    return spark.createDataFrame(pa.table(columns, names=schema.names), schema)


def settle(df: DataFrame) -> DataFrame:
    """Materialise a small table (one row per column, pair or finding) with a reliable checkpoint.

    What was computed from the data is then read back from the shared folder, so later steps
    neither rescan the data nor depend on an executor staying alive.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
