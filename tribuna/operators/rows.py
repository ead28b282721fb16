"""Rows by position: dense numbers and the positional zip, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tribuna.session import cut


def dense_id(df: DataFrame, order: list[str], name: str = "linha") -> DataFrame:
    """Rows numbered from 0 in ``order`` (which should tell them apart; equal rows get any order among them; an empty table stays empty).

    Ranges of the order are numbered on their own and shifted by the counts of the ranges before; only these counts,
    one a partition, are gathered.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("_p", before.alias("_before"))  # one row a partition
    number = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_at", number).join(F.broadcast(shifts), "_p").select(*df.columns, (F.col("_before") + F.col("_at")).cast("bigint").alias(name))


def zip_rows(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], name: str = "linha") -> DataFrame:
    """Two tables side by side by position; the longer one's rest stands beside nulls. Columns must not clash."""
    return dense_id(left, left_order, name).join(dense_id(right, right_order, name), name, "full")
