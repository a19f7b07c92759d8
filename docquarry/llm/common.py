"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.ordering import ensure_checkpoint_dir, numbered

__all__ = ["WORD", "documents", "ensure_checkpoint_dir", "labels", "let", "numbered", "prepare_workers", "running"]

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])

#: Words are runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch: they bound a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = "1000", "8m"

#: Settings of a Python worker's process, which stays after its task: it has one core, and gives back what it
#: frees.  Else Arrow's own pool and malloc, whose threshold for mapping rises, keep the largest batches' memory.
WORKER_ENV = {"OPENBLAS_NUM_THREADS": "1", "ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20)}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def prepare_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package and keeps their batches and what they hold small."""
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, PACKAGE_ROOT])
    env.update(WORKER_ENV)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def let(value: Column, body) -> Column:
    """Binds a value once for a larger expression: without it the optimizer may
    inline the value into a lambda and compute it again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine, least: int = 64) -> Column:
    """The array of numbers combined up to each element; combine(a, b) is associative.

    A fold copies what it has gathered at each step, so numbers are combined within blocks of about
    the root of their number, the blocks' last ones among themselves, and what stands before
    a block goes over its elements: n * sqrt(n) copies of a number, of a few nanoseconds each.
    """

    def fold(items: Column, first: Column, last: Column) -> Column:
        grow = lambda acc, i: F.concat(acc, F.array(combine(F.element_at(acc, -1), items[i])))
        return F.when(last > first, F.aggregate(F.sequence(first + 1, last), F.array(items[first]), grow)).otherwise(F.array(items[first]))

    def blocks(items: Column) -> Column:
        span = F.ceil(F.sqrt(F.size(items))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / span).cast("int")), lambda k: fold(items, k * span, F.least(k * span + span, F.size(items)) - 1))

    def joined(parts: Column) -> Column:
        upto = let(F.transform(parts, lambda b: F.element_at(b, -1)), lambda ends: fold(ends, F.lit(0), F.size(ends) - 1))
        return let(upto, lambda u: F.flatten(F.transform(parts, lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda own: combine(u[k - 1], own))))))

    def over(items: Column) -> Column:
        few = F.when(F.size(items) <= least, fold(items, F.lit(0), F.size(items) - 1))
        return F.when(F.size(items) == 0, items).otherwise(few.otherwise(let(blocks(items), joined)))

    return let(values, over)
