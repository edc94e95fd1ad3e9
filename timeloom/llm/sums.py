"""Sums of arrays of a fixed length over all rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK = 4096


def summed(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int) -> np.ndarray:
    """The sum of what ``count`` makes of each partition, an array of ``length`` doubles.

    Tasks send compressed blocks of their array (most hold small counts), which are added in two steps; only the summed array, whose length doesn't depend
    on the rows of ``df``, comes to the driver. An empty table gives zeros.
    """
    blocks = -(-length // BLOCK)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(blocks * BLOCK)
        x[:length] = count(batches)
        full = [i for i in range(blocks) if x[i * BLOCK : (i + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([zlib.compress(x[i * BLOCK : (i + 1) * BLOCK].tobytes(), 1) for i in full], pa.binary())], ["block", "cells"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK)
        for x in table.column("cells"):
            total += np.frombuffer(zlib.decompress(x.as_py()))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    parts = df.mapInArrow(part, "block int, cells binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    parts = parts.groupBy("block", "part").applyInArrow(add, "block int, cells binary")
    out = np.zeros(blocks * BLOCK)
    for r in parts.groupBy("block").applyInArrow(add, "block int, cells binary").collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(r["cells"]))
    return out[:length]
