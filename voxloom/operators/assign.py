"""Objects and organelles: the organelle that holds an object's centre, or the nearest ones; ball joins and contact sites."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.frame import Frame
from voxloom.operators.components import BLOCK, connected_components
from voxloom.operators.measure import physical
from voxloom.operators.voxels import ZYX, offsets, surface_voxels
from voxloom.session import durable


def assign_containing(objects: DataFrame, organelles: DataFrame, frame: Frame) -> DataFrame:
    """``objects`` (with com_z, com_y, com_x) and organelle: the label at the centre, 0 in background or outside.

    Indices are cut towards 0, so a centre up to a voxel below the volume counts as in its first voxel.
    """
    at = [((F.col(f"com_{c}") - o) / v).cast("int").alias(c) for c, v, o in zip(ZYX, frame.voxel, frame.corner, strict=True)]
    placed = objects.select("*", *at)
    return placed.join(organelles.select(*ZYX, F.col("label").alias("organelle")), ZYX, "left").drop(*ZYX).withColumn("organelle", F.coalesce("organelle", F.lit(0)))


def assign_nearest(objects: DataFrame, organelles: DataFrame, frame: Frame, n: int = 1, radius: float | None = None) -> DataFrame:
    """(id, rank, organelle, distance): the n nearest organelles of each object (id, com_z, com_y, com_x).

    Distances go to the centres of boundary voxels; an organelle that holds the centre is at 0.  Missing
    ranks have organelle 0 at infinity; ties go to the smaller id.  Points meet voxels over grid cells of
    edge ``radius``: what lies within it is surely in the 27 cells around, so an object whose n-th
    distance is within it is done, and the others are asked again with twice the radius.
    """
    boundary = durable(surface_voxels(organelles).select(*(p.alias(f"p{c}") for p, c in zip(physical(frame), ZYX, strict=True)), F.col("label").alias("organelle")))
    holds = assign_containing(objects.select("id", "com_z", "com_y", "com_x"), organelles, frame).select("id", F.col("organelle").alias("holder"))
    left = durable(objects.select("id", "com_z", "com_y", "com_x").join(holds, "id"))
    reach = sum((abs(s * v) for s, v in zip(frame.shape, frame.voxel, strict=True)), 0.0)
    far = left.agg(*(F.max(F.abs(F.col(f"com_{c}") - o)).alias(c) for c, o in zip(ZYX, frame.corner, strict=True))).first()
    reach += sum(v or 0.0 for v in far)
    radius = radius or 4 * max(frame.voxel)
    done = None
    while True:
        cell = [F.floor(F.col(f"p{c}") / radius).alias(f"c{c}") for c in ZYX]
        around = F.explode(F.array(*(F.struct(*(F.lit(d).alias(c) for d, c in zip(o, ZYX, strict=True))) for o in [(0, 0, 0), *offsets(3)]))).alias("o")
        asked = left.select("*", around).select("id", "com_z", "com_y", "com_x", "holder", *((F.floor(F.col(f"com_{c}") / radius) + F.col(f"o.{c}")).alias(f"c{c}") for c in ZYX))
        pairs = asked.join(boundary.select("*", *cell), ["cz", "cy", "cx"])
        square = sum(((F.col(f"p{c}") - F.col(f"com_{c}")) ** 2 for c in ZYX), F.lit(0.0))
        near = pairs.groupBy("id", "organelle").agg(F.sqrt(F.min(square)).alias("distance")).join(left.select("id", "holder"), "id", "right")
        near = near.select("id", "organelle", F.when(F.col("organelle") == F.col("holder"), F.lit(0.0)).otherwise(F.col("distance")).alias("distance"))
        held = left.where("holder != 0").select("id", F.col("holder").alias("organelle"), F.lit(0.0).alias("distance"))
        near = near.where("organelle is not null").union(held).groupBy("id", "organelle").agg(F.min("distance").alias("distance"))
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "organelle"))).where(F.col("rank") <= n)
        ranked = durable(ranked.select("id", "rank", "organelle", "distance"))
        if radius >= reach:
            done = ranked if done is None else done.union(ranked)
            break
        finished = durable(ranked.groupBy("id").agg(F.count("*").alias("k"), F.max("distance").alias("d")).where((F.col("k") == n) & (F.col("d") <= radius)).select("id"))
        part = ranked.join(finished, "id", "left_semi")
        done = part if done is None else done.union(part)
        left = durable(left.join(finished, "id", "left_anti"))
        if left.limit(1).count() == 0:
            break
        radius *= 2
    ranks = objects.select("id", F.explode(F.array(*map(F.lit, range(1, n + 1)))).alias("rank"))
    out = ranks.join(done, ["id", "rank"], "left")
    return out.select("id", "rank", F.coalesce("organelle", F.lit(0)).alias("organelle"), F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def nearest_arrays(nearest: DataFrame, name: str) -> DataFrame:
    """(id, `{name} ID`, `{name} Distance (nm)`) arrays by rank, for object tables."""
    rows = nearest.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "organelle", "distance"))).alias("r"))
    return rows.select("id", F.col("r.organelle").alias(f"{name} ID"), F.col("r.distance").alias(f"{name} Distance (nm)"))


# --- contact sites -----------------------------------------------------------------------------


def ball_join(a: DataFrame, b: DataFrame, frame: Frame, distance: float) -> DataFrame:
    """(az, ay, ax, bz, by, bx) of the voxels of a and b whose centres are at most ``distance`` apart.

    b's voxels are filed in grid cells of that edge, a's ask the 27 cells around: an equi-join.
    """
    centre = dict(zip(ZYX, physical(frame), strict=True))
    cells = [F.floor(centre[c] / distance).alias(f"c{c}") for c in ZYX]
    around = F.explode(F.array(*(F.struct(*(F.lit(d).alias(c) for d, c in zip(o, ZYX, strict=True))) for o in [(0, 0, 0), *offsets(3)]))).alias("o")
    left = a.select(*ZYX, *(centre[c].alias(f"p{c}") for c in ZYX), *cells, around)
    left = left.select(*(F.col(c).alias(f"a{c}") for c in ZYX), *(F.col(f"p{c}").alias(f"q{c}") for c in ZYX), *((F.col(f"c{c}") + F.col(f"o.{c}")).alias(f"c{c}") for c in ZYX))
    right = b.select(*(F.col(c).alias(f"b{c}") for c in ZYX), *(centre[c].alias(f"p{c}") for c in ZYX), *cells)
    square = sum(((F.col(f"p{c}") - F.col(f"q{c}")) ** 2 for c in ZYX), F.lit(0.0))
    return left.join(right, ["cz", "cy", "cx"]).where(square <= distance * distance).select("az", "ay", "ax", "bz", "by", "bx")


def bresenham(start: tuple[int, int, int], end: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """Voxels (z, y, x) of the integer line, ends included; of equal extents x drives before y before z."""
    point = list(start)
    delta = [abs(e - s) for s, e in zip(start, end, strict=True)]
    step = [1 if e > s else -1 for s, e in zip(start, end, strict=True)]
    drive = max((2, 1, 0), key=lambda axis: delta[axis])
    others = [axis for axis in (0, 1, 2) if axis != drive]
    errors = {axis: 2 * delta[axis] - delta[drive] for axis in others}
    out = [tuple(point)]
    for _ in range(delta[drive]):
        point[drive] += step[drive]
        for axis in others:
            if errors[axis] >= 0:
                point[axis] += step[axis]
                errors[axis] -= 2 * delta[drive]
            errors[axis] += 2 * delta[axis]
        out.append(tuple(point))
    return out


def line_points(pairs: DataFrame) -> DataFrame:
    """(line, z, y, x) of the lines between the voxels of pairs; line is a hash of both ends."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.stack([batch.column(c).to_numpy() for c in ("az", "ay", "ax", "bz", "by", "bx")], 1)
            lines, points = [], []
            for line, e in zip(batch.column("line").to_pylist(), ends.tolist(), strict=True):
                own = bresenham(tuple(e[:3]), tuple(e[3:]))
                points += own
                lines += [line] * len(own)
            places = np.array(points, np.int32).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), *(pa.array(places[:, i]) for i in range(3))], names=["line", *ZYX])

    ends = ["az", "ay", "ax", "bz", "by", "bx"]
    return pairs.withColumn("line", F.xxhash64(*ends)).mapInArrow(drawn, "line long, z int, y int, x int")


def contact_voxels(a: DataFrame, b: DataFrame, frame: Frame, distance: float, surface_blocks: bool = False) -> DataFrame:
    """Voxels where a and b overlap, and those on lines from a's surface to b's surface at most ``distance`` long.

    Lines start and end outside the overlap and are dropped as a whole if they pass through the inside of
    an object (or any of its voxels with ``surface_blocks``, but for the line's own ends).
    """
    surface_a, surface_b = surface_voxels(a), surface_voxels(b)
    overlap = durable(a.select(*ZYX).join(b.select(*ZYX), ZYX).distinct())
    pairs = ball_join(surface_a.join(overlap, ZYX, "left_anti"), surface_b.join(overlap, ZYX, "left_anti"), frame, distance)
    points = durable(line_points(pairs))
    solid = a.select(*ZYX).union(b.select(*ZYX))
    if not surface_blocks:
        solid = solid.join(surface_a.select(*ZYX).union(surface_b.select(*ZYX)), ZYX, "left_anti")
        blocked = points.join(solid.distinct(), ZYX, "left_semi")
    else:
        ends = pairs.withColumn("line", F.xxhash64("az", "ay", "ax", "bz", "by", "bx"))
        ends = ends.selectExpr("line", "az z", "ay y", "ax x").union(ends.selectExpr("line", "bz z", "by y", "bx x"))
        blocked = points.join(solid.distinct(), ZYX, "left_semi").join(ends, ["line", *ZYX], "left_anti")
    clear = points.join(blocked.select("line").distinct(), "line", "left_anti").select(*ZYX)
    return clear.union(overlap).distinct().withColumn("label", F.lit(1).cast("long"))


def contact_sites(a: DataFrame, b: DataFrame, frame: Frame, distance: float = 30.0, minimum_volume: float | None = None, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """Contact voxels in 26-connected sites of at least ``minimum_volume`` (a disc of the distance, if not given), numbered."""
    least = math.pi * (distance / 2) ** 2 * distance if minimum_volume is None else minimum_volume
    return connected_components(contact_voxels(a, b, frame, distance), frame, 3, least=least / frame.volume, block=block)
