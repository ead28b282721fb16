"""Hearings as they arrive: the stateless operators run on a stream as they are.

Turn numbering needs all markers of a hearing, which one record holds, so it works
per micro-batch through ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tribuna import schema
from tribuna.operators import flatten, turns


def read(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A folder of JSON Lines as a stream."""
    return spark.readStream.schema(schema.HEARING).option("maxFilesPerTrigger", per_trigger).json(path)


def opinions(stream: DataFrame) -> DataFrame:
    """Opinions of a stream of hearings; no state."""
    return flatten.opinions(stream)


def turns_batch(known: DataFrame, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes the turns of each micro-batch."""

    def run(batch: DataFrame, number: int) -> None:
        hearings = flatten.latest(batch)
        sink(turns.extract(hearings, flatten.participants(hearings), known), number)

    return run
