"""Rankings, volumes and the contingency table with margins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribuna import schema


#: Columns up to which a contingency table is wide.
MOST_COLUMNS = 1000


def volumes(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows of each value, nulls left out, the most frequent first (ties: by value); ``top``: only so many."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)
    return out.limit(top) if top else out


def crosstab_long(df: DataFrame, row: str, column: str, total: str = schema.TOTAL) -> DataFrame:
    """(row, column, linhas) for all pairs of values that occur, with the totals of both sides; any number of values."""
    known = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).select(F.col(row).alias("r"), F.col(column).alias("c"))
    cubed = known.cube("r", "c").agg(F.grouping("r").alias("gr"), F.grouping("c").alias("gc"), F.count("*").alias("linhas"))
    named = lambda g, c: F.when(F.col(g) == 1, total).otherwise(F.col(c))
    return cubed.where("gr = 0 or gc = 0 or linhas > 0").select(named("gr", "r").alias(row), named("gc", "c").alias(column), "linhas")


def crosstab(df: DataFrame, row: str, column: str, values: tuple[str, ...] | None = None, total: str = schema.TOTAL) -> DataFrame:
    """Rows by value pairs with totals of both sides; pairs with a null count nowhere. One aggregation: the margins are grouping sets.

    The columns are the values that occur, in order, or ``values``. More than ``MOST_COLUMNS`` of them are no table to look at: ``crosstab_long`` holds any number.
    """
    known = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).select(F.col(row).alias("r"), F.col(column).alias("c"))
    if values is None:
        values = tuple(r.c for r in known.select("c").distinct().orderBy("c").limit(MOST_COLUMNS + 1).collect())
        if len(values) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} columns: use crosstab_long")
    counts = [F.count_if(F.col("c") == v).alias(v) for v in values]
    rolled = known.rollup("r").agg(F.grouping("r").alias("g"), *counts, F.count("*").alias(total))
    return rolled.where("g = 0 or r is null").select(F.when(F.col("g") == 1, total).otherwise(F.col("r")).alias(row), *(F.col(f"`{v}`") for v in values), total)
