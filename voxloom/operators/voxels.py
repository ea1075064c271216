"""Voxel tables (z, y, x, label or value) and what selects, masks and relabels them.

Background is not stored.  Neighbour relations are worked out on dense blocks with a halo; small
dimension tables (ids, maps) are left to Spark's own size checks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.frame import Frame, Roi
from voxloom.operators.blocks import BLOCK, ZYX, blockwise, cells, inside, neighbour
from voxloom.session import durable


def offsets(connectivity: int, half: bool = False) -> list[tuple[int, int, int]]:
    """The 6, 18 or 26 neighbours for connectivity 1, 2 or 3; ``half``: one of each opposite pair, the later in raster order."""
    every = [(z, y, x) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if 0 < abs(z) + abs(y) + abs(x) <= connectivity]
    return [o for o in every if o > (0, 0, 0)] if half else every


def from_array(spark: SparkSession, array: np.ndarray, column: str = "label") -> DataFrame:
    """A small dense array as a voxel table; zeros are background."""
    z, y, x = np.nonzero(array)
    kind = "double" if array.dtype.kind == "f" else "long"
    rows = [(int(a), int(b), int(c), v.item()) for a, b, c, v in zip(z, y, x, array[z, y, x], strict=True)]
    return spark.createDataFrame(rows, f"z int, y int, x int, {column} {kind}")


def to_array(voxels: DataFrame, shape: tuple[int, int, int], column: str = "label") -> np.ndarray:
    """A small voxel table as a dense array, for tests and viewers."""
    rows = voxels.select(*ZYX, column).collect()
    out = np.zeros(shape, float if dict(voxels.dtypes)[column] == "double" else np.int64)
    for z, y, x, v in rows:
        out[z, y, x] = v
    return out


def raster(frame: Frame) -> Column:
    """The row-major index of a voxel."""
    _, ny, nx = frame.shape
    return (F.col("z").cast("long") * ny + F.col("y")) * nx + F.col("x")


def lattice(spark: SparkSession, frame: Frame) -> DataFrame:
    """All voxels of the volume; rows are made on the executors."""
    nz, ny, nx = frame.shape
    return spark.range(nz * ny * nx).select(F.expr(f"cast(id div {ny * nx} as int) z"), F.expr(f"cast(id div {nx} % {ny} as int) y"), F.expr(f"cast(id % {nx} as int) x"))


def densified(voxels: DataFrame, frame: Frame, column: str, fill: float = 0) -> DataFrame:
    return lattice(voxels.sparkSession, frame).join(voxels, ZYX, "left").select(*ZYX, F.coalesce(column, F.lit(fill)).alias(column))


def in_roi(voxels: DataFrame, roi: Roi) -> DataFrame:
    """Range predicates on the three coordinates, which reach the scan."""
    for name, b, e in zip(ZYX, roi.begin, roi.end, strict=True):
        voxels = voxels.where((F.col(name) >= b) & (F.col(name) < e))
    return voxels


def edge_filled(voxels: DataFrame, frame: Frame, roi: Roi, column: str) -> DataFrame:
    """A box that may reach beyond the volume, where the border voxels go on."""
    box = lattice(voxels.sparkSession, Frame(frame.voxel, roi.shape))
    inner = [F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c) + b)).alias(f"__{c}") for c, n, b in zip(ZYX, frame.shape, roi.begin, strict=True)]
    box = box.select(*((F.col(c) + b).alias(c) for c, b in zip(ZYX, roi.begin, strict=True)), *inner)
    source = voxels.select(*(F.col(c).alias(f"__{c}") for c in ZYX), column)
    return box.join(source, [f"__{c}" for c in ZYX]).select(*ZYX, column)


def threshold(voxels: DataFrame, column: str, low: float = -1, high: float = float("inf")) -> DataFrame:
    """low <= value < high."""
    kept = F.col(column) >= low
    return voxels.where(kept if high == float("inf") else kept & (F.col(column) < high))


def inverted(voxels: DataFrame, frame: Frame) -> DataFrame:
    """The background as voxels of label 1."""
    return lattice(voxels.sparkSession, frame).join(voxels, ZYX, "left_anti").select(*ZYX, F.lit(1).cast("long").alias("label"))


def masked(voxels: DataFrame, *masks: tuple[DataFrame, bool]) -> DataFrame:
    """Kept inside each inclusive mask (mask, True) and outside each exclusive one (mask, False)."""
    for mask, inclusive in masks:
        voxels = voxels.join(mask.select(*ZYX).distinct(), ZYX, "left_semi" if inclusive else "left_anti")
    return voxels


def parsed_ids(spark: SparkSession, ids: str | list[int] | DataFrame) -> DataFrame:
    """(id, position) of "1,2,3", a list, or a table with a column ``Object ID``; positions count from 1, later duplicates win."""
    if isinstance(ids, DataFrame):
        rows = numbered(ids.select(F.col("Object ID").cast("long").alias("id"), F.monotonically_increasing_id().alias("row")), "row", "position").select("id", "position")
    else:
        own = [int(v) for v in ids.split(",")] if isinstance(ids, str) else list(ids)
        rows = spark.createDataFrame([(v, k) for k, v in enumerate(own, 1)], "id long, position long")
    return rows.groupBy("id").agg(F.max("position").alias("position"))


def filter_ids(voxels: DataFrame, keep: str | list[int] | DataFrame | None = None, remove: str | list[int] | DataFrame | None = None, binarize: bool = False) -> DataFrame:
    """Keep the listed ids, renumbered by their place in the list (or all 1); or remove the listed ids."""
    if (keep is None) == (remove is None):
        raise ValueError("either ids to keep or ids to remove")
    listed = parsed_ids(voxels.sparkSession, keep if remove is None else remove)
    if remove is not None:
        return voxels.join(listed, F.col("label") == F.col("id"), "left_anti")
    label = F.lit(1).cast("long") if binarize else F.col("position")
    return voxels.join(listed, F.col("label") == F.col("id")).select(*ZYX, label.alias("label"))


def relabelled(voxels: DataFrame, mapping: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Labels by the map (old_id, new_id); ids that it lacks, or maps to 0, become background."""
    out = voxels.join(mapping, F.col("label") == F.col("old_id")).where("new_id != 0").select(*ZYX, F.col("new_id").alias("label"))
    return out if mask is None else masked(out, (mask, True))


def shifted(voxels: DataFrame, by: list[tuple[int, int, int]], *extra: str) -> DataFrame:
    """Each voxel at each of its neighbours' places."""
    steps = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"d{c}") for v, c in zip(o, ZYX, strict=True))) for o in by))).alias("d")
    out = voxels.select(*ZYX, *extra, steps)
    return out.select(*((F.col(c) + F.col(f"d.d{c}")).alias(c) for c in ZYX), *extra)


def touching_ids(voxels: DataFrame, connectivity: int, objects: DataFrame | None = None, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """(src, dst), src < dst: labels with neighbouring voxels; with ``objects`` only where both lie in the same object."""
    same_object = objects is not None

    def pairs(arrays: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
        own, found = inside(arrays[0], 1), []
        for o in offsets(connectivity, half=True):
            other = inside(neighbour(arrays[0], o), 1)
            meet = (own != 0) & (other != 0) & (own != other)
            if same_object:
                owner = inside(arrays[1], 1)
                meet &= (owner != 0) & (owner == inside(neighbour(arrays[1], o), 1))
            found.append(np.unique(np.sort(np.stack([own[meet], other[meet]], 1), 1), axis=0))
        both = np.unique(np.concatenate(found), axis=0)
        return [np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])]

    return blockwise([voxels, objects] if same_object else [voxels], 1, pairs, "src long, dst long", block).distinct()


def surface_voxels(voxels: DataFrame, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """Voxels of which a face neighbour has another label or none; beyond the volume there is none."""

    def surface(arrays: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
        own = arrays[0]
        keep = np.zeros(own.shape, bool)
        for o in offsets(1):
            keep |= neighbour(own, o) != own
        return cells(keep & (own != 0), begin, 1, own)

    return blockwise([voxels], 1, surface, "z int, y int, x int, label long", block)


def label_with_mask(voxels: DataFrame, column: str, mask: DataFrame, low: float = -1, high: float = float("inf"), surface_only: bool = False) -> DataFrame:
    """The mask's label where low <= value < high; of the result's surface only, if asked."""
    out = threshold(voxels, column, low, high).select(*ZYX).join(mask.select(*ZYX, "label"), ZYX)
    return surface_voxels(out) if surface_only else out


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with 1..n in the order of a unique column, in parallel: a range partitioning, counts before it, ranks within it."""
    parts = durable(df.repartitionByRange(column).withColumn("__part", F.spark_partition_id()))
    before = parts.groupBy("__part").agg(F.count("*").alias("n"))
    before = before.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(column))
    return parts.join(before, "__part").withColumn(name, (F.col("__before") + rank).cast("long")).drop("__part", "__before")
