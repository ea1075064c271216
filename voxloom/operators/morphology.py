"""Erosion, dilation, mask operation lists, gaussian smoothing and resampling of voxel tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.frame import Frame
from voxloom.operators.blocks import BLOCK, ROUNDS, ZYX, blockwise, cells, neighbour, within
from voxloom.operators.voxels import lattice, offsets
from voxloom.session import durable


def _rounds(voxels: DataFrame, iterations: int, one_pass) -> DataFrame:
    """one_pass(voxels, rounds) as often as it takes, checkpointed in between."""
    if iterations < 1:
        raise ValueError("at least one iteration")
    while iterations > ROUNDS:
        voxels, iterations = durable(one_pass(voxels, ROUNDS)), iterations - ROUNDS
    return one_pass(voxels, iterations)


def erode(voxels: DataFrame, frame: Frame, iterations: int = 1, connectivity: int = 1, edge: bool = False, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """Voxels all of whose neighbours have their label; ids that touch erode each other.

    Beyond the volume is background, or with ``edge`` whatever the border voxel is.
    """
    near, shape = offsets(connectivity), frame.shape

    def one_pass(voxels: DataFrame, rounds: int) -> DataFrame:
        def eroded(arrays: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
            own = arrays[0]
            volume = within(shape, own, begin) if edge else None
            for _ in range(rounds):
                keep = own != 0
                for o in near:
                    same = neighbour(own, o) == own
                    keep &= same if volume is None else same | ~neighbour(volume, o)
                own = np.where(keep, own, 0)
            return cells(own != 0, begin, rounds, own)

        return blockwise([voxels], rounds, eroded, "z int, y int, x int, label long", block)

    return _rounds(voxels, iterations, one_pass)


def dilate(voxels: DataFrame, frame: Frame, iterations: int = 1, connectivity: int = 1, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """Background takes the label of most of its neighbours, of equals the smaller; labelled voxels stay."""
    near, shape = offsets(connectivity), frame.shape

    def one_pass(voxels: DataFrame, rounds: int) -> DataFrame:
        def dilated(arrays: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
            own = arrays[0]
            volume = within(shape, own, begin)
            for _ in range(rounds):
                around = [neighbour(own, o) for o in near]
                reached = np.zeros(own.shape, bool)
                for n in around:
                    reached |= n != 0
                free = reached & (own == 0) & volume
                votes = np.stack([n[free] for n in around])
                best, most = np.zeros(votes.shape[1], np.int64), np.zeros(votes.shape[1], np.int64)
                for label in votes:
                    count = np.where(label != 0, (votes == label).sum(0), 0)
                    better = (count > most) | (count == most) & (count > 0) & (label < best)
                    best, most = np.where(better, label, best), np.where(better, count, most)
                own = own.copy()
                own[free] = best
            return cells(own != 0, begin, rounds, own)

        return blockwise([voxels], rounds, dilated, "z int, y int, x int, label long", block)

    return _rounds(voxels, iterations, one_pass)


def mask_operations(mask: DataFrame, frame: Frame, operations: list[tuple[str, int]], value: int | None = None, connectivity: int = 1) -> DataFrame:
    """An ordered list of ("erosion" or "dilation", iterations) on the mask's voxels (of one value, if given), as one object."""
    out = (mask if value is None else mask.where(F.col("label") == value)).select(*ZYX, F.lit(1).cast("long").alias("label"))
    for operation, iterations in operations:
        out = {"erosion": lambda m, i: erode(m, frame, i, connectivity, edge=True), "dilation": lambda m, i: dilate(m, frame, i, connectivity)}[operation](out, iterations)
    return out


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights -r..r of a normalised gaussian, r = int(truncate * sigma + 0.5)."""
    r = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [w / sum(raw) for w in raw]


def gaussian(values: DataFrame, frame: Frame, sigma: float, column: str = "value", block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """Separable smoothing with sigma in physical units, of every voxel of the volume; outside it is 0."""
    weights = [gaussian_weights(sigma / size) for size in frame.voxel]
    halo, shape = max(len(w) // 2 for w in weights), frame.shape

    def smoothed(arrays: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
        out = arrays[0]
        for axis, own in enumerate(weights):
            source, out = out, np.zeros_like(out)
            for k, w in enumerate(own):
                out += w * neighbour(source, tuple(k - len(own) // 2 if a == axis else 0 for a in range(3)))
        return cells(within(shape, out, begin), begin, halo, out)

    # Blocks without a value are smoothed too: each has a voxel of 0 in a channel of its own.
    corners = lattice(values.sparkSession, Frame(frame.voxel, frame.blocks(block)))
    corners = corners.select(*((F.col(c) * b).alias(c) for c, b in zip(ZYX, block, strict=True)), F.lit(0.0).alias(column))
    return blockwise([values.select(*ZYX, F.col(column).cast("double").alias(column)), corners], halo, smoothed, f"z int, y int, x int, {column} double", block, column)


def resampled(voxels: DataFrame, frame: Frame, voxel: tuple[float, float, float], tolerance: float = 0.01) -> DataFrame:
    """The nearest voxel of ``frame`` at each voxel of another size on the same corner.

    Whole factors repeat voxels or take the first of each stride; otherwise the voxel that holds the
    new voxel's centre counts.  Near-whole ratios count as whole.
    """
    out = voxels
    for axis, old, new in zip(ZYX, frame.voxel, voxel, strict=True):
        up, down = old / new, new / old
        if abs(up - round(up)) <= tolerance and round(up) >= 1:
            k = round(up)
            out = out.withColumn("__k", F.explode(F.array(*map(F.lit, range(k))))).withColumn(axis, (F.col(axis) * k + F.col("__k")).cast("int")).drop("__k")
        elif abs(down - round(down)) <= tolerance:
            k = round(down)
            out = out.where(F.col(axis) % k == 0).withColumn(axis, (F.col(axis) / k).cast("int"))
        else:  # centres (i + 0.5) * new inside [j * old, (j + 1) * old)
            first, last = F.ceil(F.col(axis) * old / new - 0.5), F.ceil((F.col(axis) + 1) * old / new - 0.5) - 1
            out = out.where(first <= last).withColumn(axis, F.explode(F.sequence(first, last)).cast("int"))
    return out
