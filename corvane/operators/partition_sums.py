"""Sums of arrays over all rows: each task sums its own rows, a second stage sums the tasks, the driver the few that are left."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of the second stage, each of which sends one array to the driver.
PARTS = 16


def summed(rows: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of what `add` puts into an array of doubles for each batch of rows. A task holds one array, whatever its rows."""
    size = int(np.prod(shape))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                add(batch, total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for data in batch.column("data"):
                total += np.frombuffer(data.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])

    tasks = rows.mapInArrow(first, "data binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    out = np.zeros(size)
    for row in tasks.repartition(PARTS, "part").select("data").mapInArrow(second, "data binary").toLocalIterator():
        out += np.frombuffer(row["data"])
    return out.reshape(shape)
