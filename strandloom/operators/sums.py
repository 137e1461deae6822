"""Sums of numpy arrays over all rows of a table, added up by the executors.

A kernel gives one row (chunk, part, sums) for each chunk of the arrays that it
adds up over its rows; ``sums`` are little-endian doubles.  Chunks are added in
two levels, first by ``part``, so no task holds the sums of all tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = "chunk string, part int, sums binary"
PARTS = 64
#: Doubles in a chunk.
CHUNK = 1 << 13
#: Matrix cells that a kernel holds at once.
CELLS = 1 << 21
#: Rows that a kernel holds at once: where features are few, a whole Arrow batch would fit in CELLS and fill a worker with its temporaries.
ROWS = 1 << 11


def partial(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The rows of one task."""
    context = TaskContext.get()
    part = context.partitionId() % PARTS if context else 0
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([part] * len(sums), pa.int32()), pa.array([np.ascontiguousarray(v, np.float64).tobytes() for v in sums.values()], pa.binary())], ["chunk", "part", "sums"])


def add_up(parts: DataFrame) -> dict[str, np.ndarray]:
    """The sum of each chunk; the driver gets one row for each."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["sums"].iloc[0]).copy()
        for s in pdf["sums"].iloc[1:]:
            total += np.frombuffer(s)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "part": [0], "sums": [total.tobytes()]})

    once = parts.groupBy("chunk", "part").applyInPandas(add, SCHEMA)
    return {r["chunk"]: np.frombuffer(r["sums"]) for r in once.groupBy("chunk").applyInPandas(add, SCHEMA).collect()}


def split_rows(name: str, table: np.ndarray) -> dict[str, np.ndarray]:
    """Chunks of a table, cut between its rows."""
    step = max(1, CHUNK // max(1, table[0].size if len(table) else 1))
    return {f"{name}:{i}": table[i : i + step] for i in range(0, len(table), step)}


def join_rows(name: str, sums: dict[str, np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The table that :func:`split_rows` cut; zeros where no task had any."""
    out, width = np.zeros(shape), int(np.prod(shape[1:], dtype=int))
    for key, v in sums.items():
        if key.startswith(f"{name}:"):
            at = int(key.rsplit(":", 1)[1])
            out[at : at + v.size // max(1, width)] = v.reshape(-1, *shape[1:])
    return out


def dense(b: pa.RecordBatch, n: int) -> np.ndarray:
    """Rows of sorted (idx, vals) lists as an array with NaN where a row has no value."""
    idx, vals = b.column("idx"), b.column("vals")
    lengths = np.diff(idx.offsets.to_numpy())
    out = np.full((b.num_rows, n), np.nan)
    out[np.repeat(np.arange(b.num_rows), lengths), idx.flatten().to_numpy()] = vals.flatten().to_numpy(zero_copy_only=False)
    return out


def slices(b: pa.RecordBatch, n: int):
    """The batch in pieces of a bounded number of rows and of matrix cells."""
    step = max(1, min(ROWS, CELLS // max(1, n)))
    for at in range(0, b.num_rows, step):
        yield b.slice(at, step)
