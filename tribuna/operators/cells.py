"""All pairs of rows, block by block: what a pair of blocks finds is worked on where it is found, so pairs are never moved."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The least number of blocks, for the cores of a small cluster; tasks that cells are dealt to.
BLOCKS = 4
TASKS = 1000

Batches = Iterator[pa.RecordBatch]
Make = Callable[[list[pa.RecordBatch], bool], Callable[[pa.RecordBatch], Batches]]


def _worked(batches: Batches, make: Make) -> Batches:
    """Rows in the order of cells, the index of each before the rows that are held against it; one index is held at a time."""
    now, held, work = None, [], None
    for batch in batches:
        cell, side = (batch.column(c).to_numpy() for c in ("cell", "side"))
        edge = [0, *(np.flatnonzero(np.diff(cell) | np.diff(side)) + 1).tolist(), batch.num_rows]
        for u, v in itertools.pairwise(edge):
            if u == v:
                continue
            part = batch.slice(u, v - u)
            if cell[u] != now:
                now, held, work = cell[u], [], None
            if side[u] == 0:
                held.append(part)
            elif held:
                work = work or make(held, part.column("same")[0].as_py())
                yield from work(part)


def pairs(rows: DataFrame, key: str, blocks: int, make: Make, schema: str) -> DataFrame:
    """Every unordered pair of blocks of the rows, by hash of ``key``, is a cell. ``make`` gets the rows of one block and
    whether the other is the same one, and returns what is done with each batch of the other.

    A row is moved ``blocks + 1`` times, whatever number of pairs there are.
    """
    tasks = min(blocks * (blocks + 1) // 2, max(TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # Side 0 is the index: block j of the cells (i, j), i <= j.
    to = lambda i, j, side: F.struct((j * (j + 1) / 2 + i).cast("int").alias("cell"), F.lit(side).alias("side"), (i == j).alias("same"))
    at = F.col("at")
    both = F.concat(F.transform(F.sequence(F.lit(0), at), lambda i: to(i, at, 0)), F.transform(F.sequence(at, F.lit(blocks - 1)), lambda j: to(at, j, 1)))
    dealt = rows.withColumn("at", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn("to", F.explode(both)).select("to.*", *rows.columns)
    return dealt.repartitionById(tasks, F.col("cell") % tasks).sortWithinPartitions("cell", "side").mapInArrow(lambda x: _worked(x, make), schema)
