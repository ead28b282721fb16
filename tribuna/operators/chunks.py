"""Turns to chunks of whole sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tribuna.functions import text as T


def chunks(df: DataFrame, text: str, keys: list[str], order: list[str], limit: int = 1000) -> DataFrame:
    """Chunks of ``df[text]`` numbered from 0 within ``keys`` in the order of ``order`` and position."""
    rows = df.select("*", F.posexplode(T.pack(F.col(text), limit)).alias("pos", "chunks")).where("chunks is not null and chunks <> ''")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "pos")) - 1
    return rows.withColumn("ordem_chunk", number.cast("bigint")).drop("pos")
