"""Connected components of voxels: union within blocks, star contraction between them.

A component's root is its smallest raster index, so results do not depend on block sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.arrow import merged, runs
from voxloom.frame import Frame
from voxloom.operators.blocks import BLOCK
from voxloom.operators.graph import components
from voxloom.operators.voxels import ZYX, numbered, offsets, raster, shifted
from voxloom.session import durable

def _block(frame: Frame, block: tuple[int, int, int], suffix: str = "") -> Column:
    _, ny, nx = frame.blocks(block)
    z, y, x = (F.floor(F.col(c + suffix) / b) for c, b in zip(ZYX, block, strict=True))
    return ((z * ny + y) * nx + x).cast("long")


def local_roots(coordinates: np.ndarray, values: np.ndarray | None, near: list[tuple[int, int, int]]) -> np.ndarray:
    """For voxels in raster order, the place of the first voxel that each is connected to."""
    low = coordinates.min(0) - 1
    span = coordinates.max(0) - low + 2
    keys = np.ravel_multi_index((coordinates - low).T, span)
    a, b = [], []
    for offset in near:
        step = (offset[0] * span[1] + offset[1]) * span[2] + offset[2]
        at = np.searchsorted(keys, keys + step)
        found = at < len(keys)
        found[found] = keys[at[found]] == (keys + step)[found]
        if values is not None:
            found[found] = values[at[found]] == values[found]
        a.append(np.flatnonzero(found))
        b.append(at[found])
    return merged(len(keys), np.concatenate(a), np.concatenate(b))


def roots(voxels: DataFrame, frame: Frame, connectivity: int = 2, by_label: bool = False, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """(z, y, x, label, root) of each voxel; ``by_label``: components never hold two labels."""
    near = offsets(connectivity, half=True)
    rows = voxels.select(*ZYX, F.col("label").cast("long").alias("label"), raster(frame).alias("rid"), _block(frame, block).alias("block"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["block"]):
            coordinates = np.stack([table.column(c).to_numpy() for c in ZYX], 1).astype(np.int64)
            rid = table.column("rid").to_numpy()
            own = local_roots(coordinates, table.column("label").to_numpy() if by_label else None, near)
            yield from table.append_column("root", pa.array(rid[own])).combine_chunks().to_batches()

    local = rows.repartition("block").sortWithinPartitions("block", "rid")
    local = durable(local.mapInArrow(joined, "z int, y int, x int, label long, rid long, block long, root long"))
    on_face = F.lit(False)
    for c, b in zip(ZYX, block, strict=True):
        on_face = on_face | (F.col(c) % b == 0) | (F.col(c) % b == b - 1)
    face = local.where(on_face)
    keys = [*ZYX, "label"] if by_label else ZYX
    other = face.select(*keys, F.col("root").alias("r"), F.col("block").alias("b"))
    edges = shifted(face, near, "label", "block", "root").join(other, keys).where("b != block").select(F.col("root").alias("src"), F.col("r").alias("dst"))
    joins = components(edges).select(F.col("id").alias("root"), F.col("root").alias("top"))
    return local.join(joins, "root", "left").select(*ZYX, "label", F.coalesce("top", "root").alias("root"))


def kept_roots(rooted: DataFrame, least: float = 0, most: float = float("inf")) -> DataFrame:
    """(root, n) of the components with least <= n <= most voxels."""
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return sizes if most == float("inf") else sizes.where(F.col("n") <= most)


def voxel_bounds(frame: Frame, minimum_volume: float | str = 0, maximum_volume: float | str = float("inf")) -> tuple[float, float]:
    """Volume bounds in physical units (numbers or texts like "1E7") as voxel counts."""
    return float(minimum_volume) / frame.volume, float(maximum_volume) / frame.volume


def connected_components(voxels: DataFrame, frame: Frame, connectivity: int = 2, by_label: bool = False, least: float = 0, most: float = float("inf"), block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """(z, y, x, label): components numbered 1..n by their first voxel, after the size filter."""
    rooted = durable(roots(voxels, frame, connectivity, by_label, block))
    names = numbered(kept_roots(rooted, least, most), "root", "id")
    return rooted.join(names, "root").select(*ZYX, F.col("id").alias("label"))


def components_within(voxels: DataFrame, objects: DataFrame, frame: Frame, connectivity: int = 2, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """Components that join voxels only where both lie in the same object."""
    inside = voxels.select(*ZYX).join(objects.select(*ZYX, "label"), ZYX)
    return connected_components(inside, frame, connectivity, True, block=block)


def deduplicate_ids(voxels: DataFrame, frame: Frame, connectivity: int = 2, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """If some id has several components, one id per component; else the input as it is."""
    rooted = durable(roots(voxels, frame, connectivity, True, block))
    several = rooted.groupBy("label").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b")
    if several.limit(1).count() == 0:
        return voxels.select(*ZYX, "label")
    return rooted.join(numbered(rooted.select("root").distinct(), "root", "id"), "root").select(*ZYX, F.col("id").alias("label"))


def clean_components(voxels: DataFrame, frame: Frame, least: float = 0, most: float = float("inf"), mask: DataFrame | None = None, block: tuple[int, int, int] | None = None) -> DataFrame:
    """Ids with least <= voxels <= most inside the mask, renumbered in the order of their first block, then of their id."""
    if mask is not None:
        voxels = voxels.join(mask.select(*ZYX).distinct(), ZYX, "left_semi")
    first = F.min(_block(frame, block or frame.shape))
    sizes = voxels.groupBy("label").agg(F.count("*").alias("n"), first.alias("b")).where(F.col("n") >= least)
    sizes = sizes if most == float("inf") else sizes.where(F.col("n") <= most)
    names = numbered(sizes.withColumn("order", F.struct("b", "label")), "order", "id").select(F.col("label").alias("old_id"), F.col("id").alias("new_id"))
    return voxels.join(names, F.col("label") == F.col("old_id")).select(*ZYX, F.col("new_id").alias("label"))


# --- holes -------------------------------------------------------------------------------------


def hole_assignments(voxels: DataFrame, frame: Frame, connectivity: int = 2, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """(z, y, x, root, label) of the background voxels of each hole: label is its only neighbour, or 0 with several.

    A hole is a background component that touches no face of the volume.
    """
    from voxloom.operators.voxels import inverted

    background = durable(roots(inverted(voxels, frame), frame, connectivity, block=block))
    border = F.lit(False)
    for c, n in zip(ZYX, frame.shape, strict=True):
        border = border | (F.col(c) == 0) | (F.col(c) == n - 1)
    holes = background.join(background.where(border).select("root").distinct(), "root", "left_anti").select(*ZYX, "root")
    near = shifted(holes, offsets(connectivity), "root").join(voxels.select(*ZYX, "label"), ZYX)
    owner = near.groupBy("root").agg(F.min("label").alias("a"), F.max("label").alias("b")).select("root", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.lit(0)).alias("label"))
    return holes.join(owner, "root").select(*ZYX, "root", "label")


def fill_holes(voxels: DataFrame, frame: Frame, connectivity: int = 2, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    filled = hole_assignments(voxels, frame, connectivity, block).where("label != 0").select(*ZYX, "label")
    return voxels.select(*ZYX, "label").union(filled)
