"""Measures of labelled objects: one aggregation over voxels and one over faces, counted block by block."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.frame import Frame
from voxloom.operators.blocks import BLOCK, ZYX, blockwise, inside, neighbour

#: Columns of the merged sums that a measure is made of; partial results add up by them.
SUMS = ["n", "sum_z", "sum_y", "sum_x", "sum_r2"]


def physical(frame: Frame) -> list[Column]:
    """Coordinates of a voxel's centre."""
    return [(F.col(c) + 0.5) * v + o for c, v, o in zip(ZYX, frame.voxel, frame.corner, strict=True)]


AXES = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]


def surface_areas(voxels: DataFrame, frame: Frame, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """(label, area): faces towards another label, background or the outside; a face between two labels counts for both.

    Of the 2n faces across an axis each pair of equal neighbours hides two; pairs are counted block by block.
    """

    def counted(arrays: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
        own = inside(arrays[0], 1)
        labels, at = np.unique(own, return_inverse=True)
        columns = [labels, np.bincount(at.ravel(), minlength=len(labels))]
        for o in AXES:
            same = own == inside(neighbour(arrays[0], o), 1)
            columns.append(np.bincount(at.reshape(own.shape)[same], minlength=len(labels)))
        return [c[labels != 0].astype(np.int64) for c in columns]

    parts = blockwise([voxels], 1, counted, "label long, n long, hz long, hy long, hx long", block)
    sums = parts.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("n", "hz", "hy", "hx")))
    hidden = sum((F.col(h) * F.lit(2.0 * area) for h, area in zip(("hz", "hy", "hx"), frame.faces, strict=True)), F.lit(0.0))
    return sums.select("label", (F.col("n") * (2.0 * sum(frame.faces)) - hidden).alias("area"))


def partial_sums(voxels: DataFrame, frame: Frame, raw: str | None = None) -> DataFrame:
    """Mergeable sums of each label (of a block, a day, a stream's batch)."""
    z, y, x = physical(frame)
    aggregates = [F.count("*").alias("n"), F.sum(z).alias("sum_z"), F.sum(y).alias("sum_y"), F.sum(x).alias("sum_x"), F.sum(z * z + y * y + x * x).alias("sum_r2")]
    for c, v in zip(ZYX, (z, y, x), strict=True):
        aggregates += [F.min(v).alias(f"min_{c}"), F.max(v).alias(f"max_{c}")]
    if raw:
        aggregates += [F.sum(raw).alias("raw_sum"), F.sum(F.col(raw) * F.col(raw)).alias("raw_sum2"), F.count(raw).alias("raw_n")]
    return voxels.groupBy("label").agg(*aggregates)


def merged_sums(parts: DataFrame) -> DataFrame:
    """Partial sums of the same labels added up."""
    sums = [c for c in parts.columns if c in SUMS or c.startswith("raw_")]
    low, high = ([c for c in parts.columns if c.startswith(p)] for p in ("min_", "max_"))
    return parts.groupBy("label").agg(*(F.sum(c).alias(c) for c in sums), *(F.min(c).alias(c) for c in low), *(F.max(c).alias(c) for c in high))


def finished(sums: DataFrame, frame: Frame) -> DataFrame:
    """Volume, centre of mass, radius of gyration and box of each label, and mean and population deviation of raw values."""
    com = [F.col(f"sum_{c}") / F.col("n") for c in ZYX]
    inertia = F.col("sum_r2") / F.col("n") - sum((c * c for c in com), F.lit(0.0))
    out = [F.col("label"), F.col("n"), (F.col("n") * frame.volume).alias("volume"), F.sqrt(F.greatest(F.lit(0.0), inertia)).alias("rg")]
    out += [c.alias(f"com_{n}") for c, n in zip(com, ZYX, strict=True)] + [F.col(f"{m}_{c}") for m in ("min", "max") for c in ZYX]
    if "raw_n" in sums.columns:
        mean = F.col("raw_sum") / F.nullif(F.col("raw_n"), F.lit(0).cast("long"))
        spread = F.col("raw_sum2") / F.nullif(F.col("raw_n"), F.lit(0).cast("long")) - mean * mean
        out += [mean.alias("raw_mean"), F.sqrt(F.greatest(F.lit(0.0), spread)).alias("raw_std")]
    return sums.select(*out)


def contact_areas(contacts: DataFrame, organelle: DataFrame, frame: Frame, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """(contact, organelle, area): the organelle's surface inside each contact site; ids with no surface there stay, with 0."""

    def counted(arrays: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
        site, own = inside(arrays[0], 1), inside(arrays[1], 1)
        both = (site != 0) & (own != 0)
        pairs, at = np.unique(np.stack([site[both], own[both]], 1), axis=0, return_inverse=True)
        columns = [np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])]
        for o in AXES:
            free = sum((own != inside(neighbour(arrays[1], tuple(s * v for v in o)), 1)).astype(np.int64) for s in (1, -1))
            columns.append(np.bincount(at.ravel(), free[both], len(pairs)).astype(np.int64))
        return columns

    parts = blockwise([contacts, organelle], 1, counted, "contact long, organelle long, fz long, fy long, fx long", block)
    area = sum((F.sum(f) * F.lit(float(a)) for f, a in zip(("fz", "fy", "fx"), frame.faces, strict=True)), F.lit(0.0))
    return parts.groupBy("contact", "organelle").agg(area.alias("area"))


def measure(voxels: DataFrame, frame: Frame, raw: DataFrame | None = None, organelles: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per label with all measures; whoever writes them sorts them.

    raw: (z, y, x, value) intensities.  organelles: two named label volumes of which ``voxels`` are the
    contact sites; their ids and areas become arrays.
    """
    if organelles is not None and len(organelles) != 2:
        raise ValueError("contact sites need both organelles")
    rows = voxels if raw is None else voxels.join(raw.select(*ZYX, "value"), ZYX, "left")
    out = finished(partial_sums(rows, frame, "value" if raw is not None else None), frame).join(surface_areas(voxels, frame), "label")
    for name, organelle in (organelles or {}).items():
        pairs = contact_areas(voxels, organelle, frame).groupBy(F.col("contact").alias("label")).agg(F.sort_array(F.collect_list(F.struct("organelle", "area"))).alias("p"))
        out = out.join(pairs, "label", "left").withColumn(f"{name}_ids", F.col("p.organelle")).withColumn(f"{name}_areas", F.col("p.area")).drop("p")
    return out


def object_table(measured: DataFrame) -> DataFrame:
    """The measures under the column names of object tables, with the axes in the order X, Y, Z."""
    columns = [F.col("label").alias("Object ID"), F.col("volume").alias("Volume (nm^3)"), F.col("area").alias("Surface Area (nm^2)"), F.col("rg").alias("Radius of Gyration (nm)")]
    columns += [F.col(f"{k}_{c}").alias(f"{k.upper()} {c.upper()} (nm)") for k in ("com", "min", "max") for c in ("x", "y", "z")]
    if "raw_mean" in measured.columns:
        columns += [F.col("raw_mean").alias("Mean Intensity"), F.col("raw_std").alias("Std Intensity")]
    for name in [c.removesuffix("_ids") for c in measured.columns if c.endswith("_ids")]:
        columns += [F.col(f"{name}_ids").alias(f"Contacting {name} IDs"), F.col(f"{name}_areas").alias(f"Contacting {name} Surface Area (nm^2)")]
    return measured.select(*columns)
