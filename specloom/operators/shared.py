"""What iterative and joined operators share: cutting lineage, and a side for all tasks only where its size is checked."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20
SALTS = 64


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. A local master may do without one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(found or "/tmp/specloom-checkpoints")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table to the shared folder and reads it from there: less than cut writes, read by column."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_count(side: DataFrame, n: int, width: int) -> DataFrame:
    """A join's side of n rows of about width bytes: below BROADCAST_BYTES it goes to all tasks, else both sides are dealt by
    their keys. Left alone, Spark chooses by sizes that files and checkpoints understate, and sends large sides by the driver."""
    return side.hint("broadcast" if n * width <= BROADCAST_BYTES else "merge")


def join_few(df: DataFrame, side: DataFrame, on: list[str], spread: Column, width: int, how: str = "inner") -> DataFrame:
    """df joined with a side of few rows of about width bytes, on columns of few values.

    A side below BROADCAST_BYTES goes to all tasks. Beyond it, so that no value of on meets in one task, the side is copied
    SALTS times and df is dealt over the copies by a hash of spread.
    """
    if side.count() * width <= BROADCAST_BYTES:
        return df.join(F.broadcast(side), on, how)
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")
