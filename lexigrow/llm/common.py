"""Helpers shared by the document operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: The columns of ``documents``; pipeline stages hand on exactly these.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; set a folder only on one machine, where none is named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexigrow-"))


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: it survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes in a file of a gathered checkpoint, as Spark's cache counts them: at most, and at least if there are cores to spare.
FILE_BYTES, LEAST_BYTES = 8 << 20, 1 << 20


def gather(df: DataFrame) -> DataFrame:
    """``materialize`` into as many files as the rows' bytes need, not one for each shuffle partition.

    Hadoop's local file system without its native library starts two processes
    for each file, and each is a copy of the executor until it has become
    ``chmod``.  The rows are made in all the partitions, kept on the executors'
    disks and only written by fewer tasks; a lost block is made again.
    """
    spark = df.sparkSession
    df.persist(StorageLevel.DISK_ONLY)
    try:
        held = df.select("*")
        plan = held._jdf.queryExecution()
        plan.toRdd().count()
        size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
        files = max(1, -(-size // FILE_BYTES), min(spark.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)))
        return materialize(held.coalesce(files))
    finally:
        df.unpersist()


def release(spark: SparkSession) -> None:
    """Have the cluster drop the shuffles and checkpoints that nothing refers to any more: it looks for them after a collection."""
    spark._jvm.System.gc()


def forget(df: DataFrame) -> DataFrame:
    """The same rows without the estimates that a checkpoint takes over from its plan.

    A join's estimated size is the product of its sides'; over rounds of joins
    the numbers' digits double, until planning takes longer than the work.
    """
    spark = df.sparkSession
    rows = df._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Lift a batch function to the iterator that ``mapInPandas`` wants."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield fn(batch)

    return run


def crc_fold(doc_id, modulus: int):
    """``crc32(doc_id as text) mod modulus``; null ids count as the text ``''``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an unsigned array."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX2
    return x ^ (x >> np.uint64(31))
