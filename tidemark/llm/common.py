"""What several operators share: table reading, word patterns, checkpoints, small expressions."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores, where files are too few to give each core one: work on a row outweighs moving it."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there, with its lineage cut.

    The folder is the one the session names in ``spark.checkpoint.dir``.  Only a local session
    that names none gets a temporary one.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, for stage tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark's file systems keep it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that no other name can clash with theirs."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def row_hashes(df: DataFrame) -> list[Column]:
    """Two longs, ``h1`` and ``h2``, that tell rows apart in any column, nulls included (128 bits of hash)."""
    simple = lambda f: isinstance(f.dataType, T.AtomicType)
    of = lambda f: F.col(f"`{f.name}`") if simple(f) else F.to_json(F.struct(F.col(f"`{f.name}`")))
    parts = [x for f in df.schema for x in (F.col(f"`{f.name}`").isNull(), of(f))]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"h{seed}") for seed in (1, 2)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, divisor: int) -> Column:
    """CRC-32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor
