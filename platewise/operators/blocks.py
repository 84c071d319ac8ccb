"""All pairs of two tables, block by block.

Rows are packed into blocks, a row each, which lie in a shared folder; every block of one table meets every block of the
other in some task, which reads both from there. So a row is written once, whatever the number of blocks that it meets, no pair
leaves a task, and a task holds a block and what it has found. The work grows with the product of the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from platewise.sources.stored import stored_path

BLOCK_ROWS = 4096


def runs(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The rows of a partition in runs of ``rows``."""
    held = pd.DataFrame()
    for frame in frames:
        held = pd.concat([held, frame], ignore_index=True) if len(held) else frame
        while len(held) >= rows:
            yield held.iloc[:rows]
            held = held.iloc[rows:]
    if len(held):
        yield held


def stored(blocks: DataFrame, name: str) -> DataFrame:
    """``blocks`` written to the shared folder, a file each, and read back."""
    spark = blocks.sparkSession
    path = stored_path(spark, name, uuid.uuid4().hex)
    blocks.write.option("maxRecordsPerFile", 1).parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


def meet(left: DataFrame, right: DataFrame, meeting: Callable[[dict], object], schema: str, when: Column | None = None) -> DataFrame:
    """What the blocks of ``left`` find among those of ``right``.

    Both are :func:`stored`, with columns of names of their own; ``left`` has ``block``, which names it. ``meeting(row)`` begins with a block of
    ``left``; its ``meet(row)`` takes a pair, and ``found()`` yields record batches of ``schema``, for each part of ``right`` that a task
    reads. Rows are dicts of Arrow scalars. Pairs that are not so by ``when`` do not meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
                if (block := row["block"].as_py()) != at:
                    if now is not None:
                        yield from now.found()
                    at, now = block, meeting(row)
                now.meet(row)
        if now is not None:
            yield from now.found()

    pairs = left.crossJoin(right.hint("shuffle_replicate_nl"))
    return (pairs if when is None else pairs.where(when)).mapInArrow(run, schema)
