"""Neighbourhood kernels on dense blocks with a halo.

Voxels meet by block: each goes to its own block, and those near a face also to the blocks beside it, so
what is shuffled is the volume once and its faces again, whatever the number of neighbours.  A kernel
sees a block and its halo as dense arrays, works with numpy and answers for the block's inside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.arrow import runs

ZYX = ["z", "y", "x"]
BLOCK = (64, 64, 64)
#: Rounds of a kernel in one pass; more are done in several, so that halos stay narrow beside blocks.
ROUNDS = 16

#: arrays of the channels, the coordinates of their first cell -> the columns of the result
Kernel = Callable[[list[np.ndarray], np.ndarray], Sequence[np.ndarray]]


def neighbour(array: np.ndarray, offset: tuple[int, int, int], fill: float = 0) -> np.ndarray:
    """The value at each cell's neighbour; ``fill`` beyond the array."""
    out = np.full_like(array, fill)
    here = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(offset, array.shape, strict=True))
    there = tuple(slice(max(0, d), n + min(0, d)) for d, n in zip(offset, array.shape, strict=True))
    out[here] = array[there]
    return out


def inside(array: np.ndarray, halo: int) -> np.ndarray:
    """The block without its halo."""
    return array[halo : array.shape[0] - halo, halo : array.shape[1] - halo, halo : array.shape[2] - halo]


def cells(keep: np.ndarray, begin: np.ndarray, halo: int, *values: np.ndarray) -> list[np.ndarray]:
    """Columns z, y, x and values of the cells of the inside that ``keep`` (of the whole array) has."""
    at = np.argwhere(inside(keep, halo))
    where = tuple((at + halo).T)
    return [*((at + halo + begin).astype(np.int32).T), *(v[where] for v in values)]


def within(shape: tuple[int, int, int], array: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which cells lie in a volume of this shape."""
    axes = [(np.arange(n) + b >= 0) & (np.arange(n) + b < s) for n, b, s in zip(array.shape, begin, shape, strict=True)]
    return axes[0][:, None, None] & axes[1][None, :, None] & axes[2][None, None, :]


def blockwise(channels: Sequence[DataFrame], halo: int, kernel: Kernel, schema: str, block: tuple[int, int, int] = BLOCK, column: str = "label") -> DataFrame:
    """kernel(...) of each block that has a voxel in it or in its halo, of any channel (z, y, x, column); 0 where none is."""
    number = "double" if any(dict(c.dtypes)[column] == "double" for c in channels) else "long"
    rows = None
    for k, df in enumerate(channels):
        part = df.select(*ZYX, F.col(column).cast(number).alias("value"), F.lit(k).alias("channel"))
        rows = part if rows is None else rows.union(part)
    keys = [f"b{c}" for c in ZYX]
    for c, b in zip(ZYX, block, strict=True):
        first, last = (F.floor((F.col(c) + d) / b).cast("int") for d in (-halo, halo))
        rows = rows.withColumn(f"b{c}", F.explode(F.sequence(first, last)) if halo else first)
    names, count, shape = [p.split()[0] for p in schema.split(", ")], len(channels), tuple(b + 2 * halo for b in block)
    kind = np.float64 if number == "double" else np.int64

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, keys):
            begin = np.array([int(table.column(k)[0].as_py()) for k in keys]) * block - halo
            at = np.stack([table.column(c).to_numpy() for c in ZYX], 1) - begin
            channel, values = table.column("channel").to_numpy(), table.column("value").to_numpy()
            arrays = [np.zeros(shape, kind) for _ in range(count)]
            for k in range(count):
                own = channel == k
                arrays[k][tuple(at[own].T)] = values[own]
            columns = kernel(arrays, begin)
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    rows = rows.select(*keys, *ZYX, "channel", "value").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(applied, schema)
