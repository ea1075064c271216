"""Measures over arriving blocks: sums are mergeable, so a stream keeps one row of sums per label."""

from __future__ import annotations

from pyspark.sql import DataFrame

from voxloom.frame import Frame
from voxloom.operators.measure import finished, partial_sums


def running_measures(voxels: DataFrame, frame: Frame, raw: str | None = None) -> DataFrame:
    """Volume, centre, radius of gyration, box (and intensities) so far of each label of a stream of voxels.

    Write it in update or complete mode; the state is one row per label.
    """
    return finished(partial_sums(voxels, frame, raw), frame)
