"""Texts in blocks: what is joined to words goes to a block's distinct words once, not to every place of theirs."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bucketed

BLOCK_BYTES = 16 << 20


def blocked(docs: DataFrame, text: str, name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a ``block`` number, written in buckets by it; ``text`` names the column whose size counts.

    A block is a run of rows of one task with about ``block_bytes`` of text, or one row with more. Blocks
    are written where they are read, so the texts are not shuffled; a join by block moves the other side.
    """
    at = docs.columns.index(text)

    def run(batches):
        block, size, part = 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
            out = np.empty(len(lengths), np.int64)
            for i, n in enumerate(lengths):
                if size and size + n > block_bytes:
                    block, size = block + 1, 0
                out[i] = (part << 32) + block
                size += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "block"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in docs.columns)
    return bucketed(docs.mapInArrow(run, schema + "block long"), "block", name, deal=False)


def sides(block_rows: DataFrame, other: DataFrame):
    """Both tables grouped by block, to be handled together."""
    return block_rows.groupBy(F.col("block")).cogroup(other.groupBy(F.col("block")))
