"""Where a plan is cut: rows that several later steps read are written to the shared checkpoint folder once."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where nothing is set, a local master gets a temporary folder, which goes when the process ends; any other master is
    an error, since no folder of one machine can serve several."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            own = tempfile.mkdtemp(prefix="tracewell-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(named or own)
    return named or sc._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from the written rows, so a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    kept = df.checkpoint(eager=True)
    relieve(df.sparkSession)
    return kept


def stored(df: DataFrame) -> DataFrame:
    """keep(df) as a Parquet file of the shared folder, of which each later step reads its own columns; a small part of what
    keep writes, for rows that are many."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that are read by one task, and rows that are broadcast, of a written table whose rows are a few numbers.
READ_TOGETHER, SMALL = 1 << 16, 1 << 16


def counted(df: DataFrame, *flags: Column, write=keep) -> tuple[DataFrame, list[int]]:
    """keep(df) for rows of a few numbers, with the count of its rows and of those for which each flag holds; write: stored,
    where rows are many.

    They are counted as the rows are written, so no job is run to ask; small tables are read by few tasks.  A task that
    is run again may be counted again, so the counts are bounds from above; zero is exact."""
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("n"), *(F.count_if(f).alias(f"n{i}") for i, f in enumerate(flags))]
    kept = write(df.observe(seen, *metrics))
    found = [seen.get[m] for m in ("n", *(f"n{i}" for i in range(len(flags))))]
    return kept.coalesce(max(1, -(-found[0] // READ_TOGETHER))), found


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its rows numbered from 1 in an order, by no task that sees them all: rows are dealt out by ranges and sorted
    there, and each range's numbers begin after those of the ranges before it."""
    dealt = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)  # the id is the number of the partition, and below it that of the row in it
    counts = sorted((r.p, r.n) for r in dealt.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    begins, at = [], 0
    for p, n in counts:
        begins.append((p, at))
        at += n
    known = F.broadcast(df.sparkSession.createDataFrame(begins, "__p long, __b long"))
    return dealt.withColumn("__p", part).join(known, "__p").withColumn(name, F.col("__b") + F.col("__m").bitwiseAND((1 << 33) - 1) + 1).drop("__m", "__p", "__b")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if it has few rows of a few numbers."""
    return F.broadcast(df) if rows <= SMALL else df


def release(spark: SparkSession) -> None:
    """Collects garbage on the driver, after which Spark drops the broadcasts, shuffles and metrics of steps that are over.

    A job of many small steps would else keep them until the driver's memory is full."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def relieve(spark: SparkSession) -> None:
    """release(), if the driver's heap has grown to more than half of what it may take.

    Else it grows up to that before it is collected, with what steps that are over have left, beside the driver's threads,
    buffers and Python."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        release(spark)
