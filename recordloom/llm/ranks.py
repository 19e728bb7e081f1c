"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.session import parallelism, stage


def rank_within(df: DataFrame, group: str, order: list[str], name: str = "k") -> DataFrame:
    """``df`` with the rank from 1 of each row within its group, in an order without ties.

    Rows are spread by ranges of group and order, so a group that holds a third of them is spread over many tasks:
    local ranks per range and offsets of whole ranges. Groups are not null. ``df`` is read twice, so it should be staged.
    """
    spread = stage(df.repartitionByRange(parallelism(df.sparkSession), group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = spread.groupBy(group, "_part").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(group, "_part", before.alias("_start"))
    local = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    return spread.withColumn("_local", local).join(starts, [group, "_part"]).withColumn(name, F.col("_start") + F.col("_local")).select(*df.columns, name)
