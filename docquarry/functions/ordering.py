"""Places in a total order, and the folder that keeps intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, spark.checkpoint.dir; one of this machine only
    where nothing but this machine is used."""
    conf = spark.sparkContext.getConf()
    if shared := conf.get("spark.checkpoint.dir"):
        return shared
    if not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/docquarry-checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the rows' places, from 0, in a total order, without one task for all rows:
    ranges are sorted apart and shifted by the number of rows before them.

    The ranges are cut anew on every evaluation, so they are kept before they are counted.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    low = (1 << 33) - 1
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright(F.col("__at"), 33)
    counts = cut.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    # one row for each partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    placed = cut.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return placed.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit(low))).drop("__at", "__part", "__before")
