"""What the operators share: shared-folder checkpoints, shipping of Python
functions, components of a graph given by its links."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def by_value(module: str) -> None:
    """Ship the module's functions inside the tasks, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def one_thread() -> None:
    """Let numpy's matrix products use the one core that a task has: threads of several tasks would wait for each other.

    Settings in the environment come too late in a worker, so the library that is
    loaded is told; where there is none of that name, nothing happens.
    """
    try:
        with open("/proc/self/maps") as maps:
            loaded = {line.split()[-1] for line in maps if "openblas" in line}
    except OSError:
        return
    for path in loaded:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where it is set. Where it is unset: a temporary
    folder in local mode, else a folder in the warehouse.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if context.master.startswith("local") and not context.master.startswith("local-cluster"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="querrick-"))
        else:
            context.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context.getCheckpointDir()


#: Rows of a kept table for each file, where their number is known: small tables are not spread over a cluster's partitions.
ROWS_A_FILE = 100_000


def kept(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, str]:
    """``df`` computed once and written as Parquet in the shared folder, and where: it outlives lost executors and cuts lineage.

    Partitions without rows leave no file, and readers put small files together;
    of at most ``rows`` rows, if that is known, as many files are written as they need.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, "kept")
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``kept`` for tables that stay as long as the job."""
    return kept(df, rows)[0]


def forget(spark: SparkSession, path: str) -> None:
    """Removes a kept table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created there."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected links ``(a, b)``, as ``(node, root)`` with the least node as root.

    Alternating large-star and small-star rounds: each keeps at most one row a
    link, and a hub's links are only aggregated (with partial aggregation) and
    joined (which adaptive execution can split), never gathered. Nodes without
    links are not returned. Self links and repeated links are harmless.
    """
    now, place = kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    seen = mark(now)
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = place
        now, place = kept(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), 2 * seen[0])
        forget(now.sparkSession, last)
        was, seen = seen, mark(now)
        if was == seen:
            roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
