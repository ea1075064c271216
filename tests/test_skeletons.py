"""Skeletons of many objects at once, against the plain definitions voxel by voxel, and what work they make."""

import cProfile
import itertools
import pstats

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.frame import Frame
from voxloom.operators import objects, voxels

CUBE = list(itertools.product((-1, 0, 1), repeat=3))


def parts(cells, connectivity):
    cells, out = set(cells), []
    while cells:
        part = todo = {cells.pop()}
        while todo:
            todo = {tuple(a + b for a, b in zip(c, o, strict=True)) for c in todo for o in voxels.offsets(connectivity)} & cells
            cells -= todo
            part = part | todo
        out.append(part)
    return out


def removable(cube):
    solid = {o for o in CUBE if any(o) and cube[tuple(v + 1 for v in o)]}
    free = {o for o in CUBE if 0 < sum(map(abs, o)) <= 2 and not cube[tuple(v + 1 for v in o)]}
    return len(solid) > 1 and len(parts(solid, 3)) == 1 and sum(bool(p & set(voxels.offsets(1))) for p in parts(free, 1)) == 1


def plainly_thinned(solid):
    out = np.pad(solid.astype(np.uint8), 1)
    changed = True
    while changed:
        changed = False
        for side in voxels.offsets(1):
            border = [p for p in np.argwhere(out) if not out[tuple(p + side)]]
            for p in [p for p in border if removable(out[tuple(slice(v - 1, v + 2) for v in p)])]:
                if removable(out[tuple(slice(v - 1, v + 2) for v in p)]):
                    out[tuple(p)] = 0
                    changed = True
    return out[1:-1, 1:-1, 1:-1].astype(bool)


def plain_edges(points):
    edges = {(i, j) for i, j in itertools.combinations(range(len(points)), 2) if abs(points[i] - points[j]).max() == 1}
    for a, b, c in itertools.combinations(range(len(points)), 3):
        triangle = [(a, b), (a, c), (b, c)]
        if edges.issuperset(triangle):
            edges.discard(max(triangle, key=lambda t: (sum(t), t)))
    return sorted(edges)


def noise(n, seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    found = [np.argwhere(rng.random(rng.integers(1, 9, 3)) < rng.uniform(0.3, 1)) + rng.integers(0, 90, 3) for _ in range(n)]
    return [p for p in found if len(p)]


@pytest.mark.parametrize("seed", range(3))
def test_thinning_and_edges_against_plain_definitions(seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    solid = rng.random((4, 7, 6, 8)) < np.array([0.5, 0.74, 0.9, 1]).reshape(-1, 1, 1, 1)
    thin = objects.thinned(solid)
    for own, got in zip(solid, thin, strict=True):
        assert (got == plainly_thinned(own)).all() and (got == objects.thinned(own)).all()
        points = np.argwhere(own[:4, :4, :4])
        assert objects.skeleton_edges(points) == plain_edges(points)


@pytest.mark.parametrize("erosion", [False, True])
@pytest.mark.parametrize("voxel", [(3.54, 4.0, 4.5), (4.0, 4.0, 4.0)])
def test_objects_together_are_as_each_alone(voxel, erosion):
    own, frame = noise(80, 4), Frame(voxel, (99, 99, 99), (7.0, 0.0, 9.0))
    starts = np.cumsum([0, *map(len, own[:-1])])
    got = dict(objects.skeletons(np.concatenate(own), starts, frame, erosion, 10.0, 2.0))
    assert sorted(got) == list(range(len(own)))
    for i, points in enumerate(own):
        alone = objects.skeleton(points, frame, erosion, 10.0, 2.0)
        assert all(np.array_equal(got[i][k], alone[k], equal_nan=True) for k in alone if k != "polylines")
        assert all(np.array_equal(a, b) for a, b in zip(got[i]["polylines"], alone["polylines"], strict=True))


def calls(points, starts, frame):
    profile = cProfile.Profile()
    profile.enable()
    found = list(objects.skeletons(points, starts, frame, False, 10.0, 5.0))
    profile.disable()
    assert len(found) == len(starts)
    return pstats.Stats(profile).total_calls / len(starts)


def test_work_on_noisy_objects():
    """An object of skeleton_metrics at sf0.1 took some 480,000 calls when each voxel and neighbour was visited by itself."""
    solid = np.random.Generator(np.random.PCG64(5)).random((60, 12, 7, 7)) < 0.74
    points = np.argwhere(solid)
    assert calls(points[:, 1:], np.searchsorted(points[:, 0], np.arange(60)), Frame((3.54, 4.0, 4.5), (12, 7, 7))) < 40_000


def test_work_on_rods():
    """A rod of 20 voxels took 3,872 calls when each object was worked on by itself."""
    k = np.arange(400 * 20)
    assert calls(np.stack([k // 400, k // 20 % 20, k % 20], 1), np.arange(400) * 20, Frame((4.0, 4.0, 4.0), (20, 20, 20))) < 600


def test_objects_are_dealt_to_all_tasks(spark):
    """Spark merged partitions of few rows into one task, however much work their objects are."""
    rows = spark.range(8000).selectExpr("cast(id div 400 as int) z", "cast(id div 20 % 20 as int) y", "cast(id % 20 as int) x", "1 + id div 20 label")
    out = objects.skeletonize(rows, Frame((4.0, 4.0, 4.0), (20, 20, 20)), False, 0.0, 1.0)
    tasks = out.select("label", "longest_path", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in tasks}) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1 and sorted(r.label for r in tasks) == list(range(1, 401)) and {r.longest_path for r in tasks} == {76.0}


def test_groups_of_rows_in_bulks():
    import pyarrow as pa

    from voxloom.arrow import bulks

    keys = np.repeat(np.arange(50), np.random.Generator(np.random.PCG64(6)).integers(1, 40, 50))
    table = pa.table({"k": keys, "v": np.arange(len(keys))})
    for rows, batch in itertools.product((1, 30, 10_000), (1, 7, 10_000)):
        seen = []
        for starts, k, v in bulks(iter(table.to_batches(batch)), ["k", "v"], rows):
            assert (np.diff(k)[starts[1:] - 1] != 0).all() and len(starts) == len(np.unique(k))
            seen += [(a, b.tolist()) for a, b in zip(k[starts].tolist(), np.split(v, starts[1:]), strict=True)]
        assert [a for a, _ in seen] == list(range(50)) and [i for _, b in seen for i in b] == list(range(len(keys)))
