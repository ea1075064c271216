"""Kernels over one object at a time: line fits, skeletons and their graphs.

An object's voxels meet in one task; objects are spread by label.  Each kernel is a plain numpy function.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import islice, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.arrow import bulks, runs
from voxloom.frame import Frame
from voxloom.operators import components, morphology
from voxloom.operators.blocks import blockwise, cells, neighbour
from voxloom.operators.components import local_roots
from voxloom.operators.graph import components as joined
from voxloom.operators.voxels import ZYX, numbered, offsets, raster, shifted
from voxloom.session import durable

Edge = tuple[int, int]
Offset = tuple[int, int, int]


def per_object(voxels: DataFrame, frame: Frame, kernel: Callable[[int, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """kernel(label, coordinates in raster order) -> rows, for each label."""
    names = [part.split()[0] for part in schema.split(", ")]

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["label"]):
            points = np.stack([table.column(c).to_numpy() for c in ZYX], 1).astype(np.int64)
            rows = kernel(int(table.column("label")[0].as_py()), points)
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])

    rows = voxels.select("label", *ZYX, raster(frame).alias("rid")).repartition("label").sortWithinPartitions("label", "rid")
    return rows.mapInArrow(applied, schema)


def batched(weights: DataFrame, batches: int) -> DataFrame:
    """Adds ``batch`` (0..batches - 1) to rows (id, weight): heaviest first, dealt forth and back, so that sums stay close."""
    ranked = numbered(weights.withColumn("order", F.struct((-F.col("weight")).alias("w"), "id")), "order", "place").drop("order")
    turn, at = F.floor((F.col("place") - 1) / batches), (F.col("place") - 1) % batches
    return ranked.withColumn("batch", F.when(turn % 2 == 0, at).otherwise(batches - 1 - at).cast("int")).drop("place")


# --- lines -------------------------------------------------------------------------------------


def fit_line(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two ends of the principal axis through the centre, at the extreme projections."""
    middle = points.mean(0)
    direction = np.linalg.svd(points - middle, full_matrices=False)[2][0] if len(points) > 1 else np.array([1.0, 0.0, 0.0])
    along = (points - middle) @ direction
    return middle + along.min() * direction, middle + along.max() * direction


def fit_lines(voxels: DataFrame, frame: Frame) -> DataFrame:
    """(label, start and end coordinates) of the largest 6-connected part of each object, in physical units."""

    def kernel(label: int, points: np.ndarray) -> list[tuple]:
        own = local_roots(points, None, offsets(1, half=True))
        values, counts = np.unique(own, return_counts=True)
        part = points[own == values[counts.argmax()]]
        start, end = fit_line((part + 0.5) * frame.voxel + frame.corner)
        return [(label, *map(float, start), *map(float, end))]

    return per_object(voxels, frame, kernel, "label long, start_z double, start_y double, start_x double, end_z double, end_y double, end_x double")


# --- unbridged adjacencies ---------------------------------------------------------------------


def unbridged(voxels: DataFrame, connectivity: int = 6) -> DataFrame:
    """``voxels`` without the later voxel of each edge- or vertex-adjacent pair that no voxel bridges.

    connectivity 6: pairs across an edge or a vertex need a face path; 18: pairs across a vertex need a
    voxel between.  All pairs are judged on the mask as given.
    """
    if connectivity not in (6, 18):
        raise ValueError("connectivity must be 6 or 18")
    wanted = [o for o in offsets(3, half=True) if sum(map(abs, o)) >= (2 if connectivity == 6 else 3)]

    def kept(arrays: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
        solid = arrays[0] != 0
        gone = np.zeros(solid.shape, bool)
        for o in wanted:  # the later member stands at p, the earlier at p - o
            axes = [i for i in range(3) if o[i]]
            pair = solid & neighbour(solid, tuple(-v for v in o))
            for keep in range(1, 2 ** len(axes) - 1):  # p - o + step would bridge
                step = [o[i] if i in axes and keep >> axes.index(i) & 1 else 0 for i in range(3)]
                pair &= ~neighbour(solid, tuple(s - v for s, v in zip(step, o, strict=True)))
            gone |= pair
        return cells(solid & ~gone, begin, 1, arrays[0])

    return blockwise([voxels], 1, kept, "z int, y int, x int, label long")


# --- distance transform and thinning -----------------------------------------------------------


def distance_transform(solid: np.ndarray, voxel: tuple[float, float, float]) -> np.ndarray:
    """Exact distance of each solid voxel's centre to the nearest background centre of its volume (..., z, y, x); beyond the array is solid."""
    square = np.where(solid, np.inf, 0.0)
    for axis, size in enumerate(voxel, solid.ndim - 3):
        lines = np.moveaxis(square, axis, -1)
        n = lines.shape[-1]
        cost = ((np.arange(n)[:, None] - np.arange(n)[None]) * size) ** 2
        flat = lines.reshape(-1, n)
        out = np.empty_like(flat)
        for i in range(0, len(flat), max(1, 4_000_000 // (n * n))):
            out[i : i + max(1, 4_000_000 // (n * n))] = (flat[i : i + max(1, 4_000_000 // (n * n)), None, :] + cost[None]).min(2)
        square = np.moveaxis(out.reshape(lines.shape), -1, axis)
    return np.sqrt(square)


_CUBE = [(z, y, x) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1)]
_HALF = offsets(3, half=True)


def _bits(places: Iterable[Offset]) -> int:
    return sum(1 << _CUBE.index(o) for o in places)


#: Of a 3x3x3 cube as 27 bits in raster order: for each axis the distance of neighbours, and the two layers at its ends.
_AXES = [(unit, *(np.uint32((1 << 27) - 1 - _bits(o for o in _CUBE if o[axis] == end)) for end in (1, -1))) for axis, unit in enumerate((9, 3, 1))]
_FACES, _N18 = (np.uint32(_bits(offsets(c))) for c in (1, 2))
_LOW = np.uint32((1 << 13) - 1)
#: By the 26 neighbours: 0 not known yet, 1 stays, 2 may go.  Pages that are never written take no memory.
_VERDICTS = np.zeros(1 << 26, np.uint8)
#: Voxels whose neighbourhoods are looked up at a time.
_AT_ONCE = 1 << 18


def _lowest(cubes: np.ndarray) -> np.ndarray:
    return cubes & (~cubes + np.uint32(1))


def _flooded(start: np.ndarray, within: np.ndarray, near: int) -> np.ndarray:
    """The parts of ``within`` (joined by faces for near 1, by 26 neighbours for 3) that ``start`` lies in."""
    while True:
        grown = start
        for unit, not_last, not_first in _AXES:
            base = grown if near == 3 else start
            grown = grown | (base & not_last) << unit | (base & not_first) >> unit
        grown &= within
        if (grown == start).all():
            return grown
        start = grown


def _simple(cubes: np.ndarray) -> np.ndarray:
    """Whether removing the middle of a cube keeps the topology: one 26-part of solid, one 6-part of background that faces it."""
    free = ~cubes & _N18
    one_solid = (cubes != 0) & (_flooded(_lowest(cubes), cubes, 3) == cubes)
    return one_solid & (free & _FACES != 0) & (free & _FACES & ~_flooded(_lowest(free & _FACES), free, 1) == 0)


def _removable(flat: np.ndarray, at: np.ndarray, cube: np.ndarray) -> np.ndarray:
    """Whether the voxels ``at`` are simple and no end points."""
    out = np.empty(len(at), bool)
    for i in range(0, len(at), _AT_ONCE):
        cubes = np.packbits(flat[at[i : i + _AT_ONCE, None] + cube], axis=1, bitorder="little").view("<u4")[:, 0]
        key = cubes & _LOW | cubes >> 14 << 13
        verdict = _VERDICTS[key]
        fresh = np.unique(cubes[verdict == 0]) & ~np.uint32(1 << 13)
        if len(fresh):
            _VERDICTS[fresh & _LOW | fresh >> 14 << 13] = 1 + (_simple(fresh) & (np.bitwise_count(fresh) > 1))
            verdict = _VERDICTS[key]
        out[i : i + _AT_ONCE] = verdict == 2
    return out


def _turns(at: np.ndarray, shape: tuple[int, ...]) -> list[np.ndarray]:
    """Flat indices in groups that go one after the other: no two of a group touch, and of two that touch the earlier in raster order goes first."""
    if not len(at):
        return []
    _, ny, nx = shape[-3:]
    turn = 4 * (at // (ny * nx) % shape[-3]) + 2 * (at // nx % ny) + at % nx
    order = np.argsort(turn, kind="stable")
    return np.split(at[order], np.flatnonzero(np.diff(turn[order])) + 1)


def thinned(solid: np.ndarray) -> np.ndarray:
    """A one-voxel-wide skeleton of each volume of (..., z, y, x): border voxels go, side by side, while they are simple and no end points."""
    out = np.pad(solid.astype(np.uint8), [(0, 0)] * (solid.ndim - 3) + [(1, 1)] * 3)
    flat, volume = out.reshape(-1), math.prod(out.shape[-3:])
    steps = np.array([out.shape[-2] * out.shape[-1], out.shape[-1], 1])
    cube, cells = np.array(_CUBE) @ steps, np.flatnonzero(flat)
    while len(cells):
        before = np.bincount(cells // volume, minlength=len(flat) // volume)
        for side in offsets(1):
            border = cells[flat[cells + side @ steps] == 0]
            for group in _turns(border[_removable(flat, border, cube)], out.shape):  # again, as earlier ones have gone
                flat[group[_removable(flat, group, cube)]] = 0
            cells = cells[flat[cells] == 1]
        changed = np.bincount(cells // volume, minlength=len(before)) != before
        cells = cells[changed[cells // volume]]
    return out[..., 1:-1, 1:-1, 1:-1].astype(bool)


# --- graphs ------------------------------------------------------------------------------------


#: [mask, a]: of the later neighbours b of a voxel's later neighbour a those that are in ``mask``, the voxel's later neighbours, too.
_SHARED = np.zeros((1 << 13, 13), np.uint16)
for _a, _b in product(range(13), range(13)):
    _sum = tuple(p + q for p, q in zip(_HALF[_a], _HALF[_b], strict=True))
    if _sum in _HALF:
        _SHARED[:, _a] |= (np.arange(1 << 13) >> _HALF.index(_sum) & 1).astype(np.uint16) << _b


def _edges(lines: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Edges (places in ``at``, sorted) between 26-neighbours of ``lines``, whose set cells are ``at`` and touch no border.

    Of each triangle the edge with the largest sum of indices goes, which is that between the two later
    voxels: in raster order, each voxel's later neighbours lose the edges between them.
    """
    flat, half = lines.reshape(-1), np.array(_HALF) @ (lines.shape[-2] * lines.shape[-1], lines.shape[-1], 1)
    links = np.zeros(len(flat), np.uint16)
    for k, step in enumerate(half):
        links[at] |= flat[at + step].astype(np.uint16) << k
    for group in _turns(at[np.bitwise_count(links[at]) > 1], lines.shape):
        own = links[group]
        for k, step in enumerate(half):
            has = own >> k & 1 == 1
            links[group[has] + step] &= ~_SHARED[own[has], k]
    a, k = np.nonzero(links[at, None] >> np.arange(13, dtype=np.uint16) & 1)
    return np.stack([a, np.searchsorted(at, at[a] + half[k])], 1)


def skeleton_edges(points: np.ndarray) -> list[Edge]:
    """Edges between 26-neighbours, of points in raster order; of each triangle the edge with the largest sum of indices goes."""
    lines = np.zeros(points.max(0) - points.min(0) + 3, bool)
    lines[tuple((points - points.min(0) + 1).T)] = True
    return [(a, b) for a, b in _edges(lines, np.flatnonzero(lines)).tolist()]


def _adjacent(edges: list[Edge]) -> dict[int, list[int]]:
    """Neighbours of each node, in order."""
    near: dict[int, list[int]] = defaultdict(list)
    for a, b in sorted(edges):
        near[a].append(b)
        near[b].append(a)
    return near


def polylines(edges: list[Edge]) -> list[list[int]]:
    """Chains between nodes of a degree other than 2, and closed loops."""
    return _chains(_adjacent(edges))


def _chains(near: dict[int, list[int]]) -> list[list[int]]:
    passed, out, nodes = set(), [], sorted(near)

    def walk(a: int, b: int) -> None:
        line = [a, b]
        while b != line[0] and len(near[b]) == 2:
            passed.add(b)
            first, second = near[b]
            b = second if first == line[-2] else first
            line.append(b)
        out.append(line)

    for node in nodes:
        if len(near[node]) != 2:
            for n in near[node]:
                if n not in passed if len(near[n]) == 2 else node < n:
                    walk(node, n)
    for node in nodes:
        if len(near[node]) == 2 and node not in passed:
            passed.add(node)
            walk(node, near[node][0])
    return out


def _lengths(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    apart = points[edges[:, 0]] - points[edges[:, 1]]
    return np.sqrt(np.vecdot(apart, apart))


def pruned(points: np.ndarray, edges: list[Edge], shortest: float, rounds: int = 100) -> list[Edge]:
    """Without chains from an end point to a branch point that are shorter than ``shortest``, again and again."""
    return _pruned(edges, dict(zip(edges, _lengths(points, np.array(edges, int).reshape(-1, 2)).tolist(), strict=True)), shortest, rounds)[0]


def _pruned(edges: list[Edge], lengths: dict[Edge, float], shortest: float, rounds: int = 100) -> tuple[list[Edge], list[list[int]]]:
    """The edges that stay, and their chains."""
    for turn in range(rounds + 1):
        near = _adjacent(edges)
        chains = _chains(near)
        gone = set()
        for line in chains if turn < rounds and shortest > 0 else []:
            a, b = len(near[line[0]]), len(near[line[-1]])
            if min(a, b) == 1 and max(a, b) > 2:
                own = [(p, q) if p < q else (q, p) for p, q in zip(line, line[1:], strict=False)]
                if np.array([lengths[e] for e in own]).sum() < shortest:
                    gone.update(own)
        if not gone:
            break
        edges = [e for e in edges if e not in gone]
    return edges, chains


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Ramer-Douglas-Peucker on one polyline; a closed one stays closed."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    if len(points) > 3 and (np.abs(points[0] - points[-1]) <= 1e-8 + 1e-5 * np.abs(points[-1])).all():  # as allclose, for finite points
        far = int(np.linalg.norm(points - points[0], axis=1).argmax())
        keep[far] = True
        todo = [(0, far), (far, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        start, way = points[a], points[b] - points[a]
        inner = points[a + 1 : b] - start
        t = np.clip(inner @ way / max(float(way @ way), 1e-300), 0, 1)
        apart = np.linalg.norm(inner - t[:, None] * way, axis=1)
        k = int(apart.argmax())
        if apart[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.round(points[keep], 6)


def longest_path(points: np.ndarray, edges: list[Edge]) -> float:
    """The longest of the components' shortest paths by two Dijkstra sweeps each (exact on trees)."""
    return _longest_path(edges, _lengths(points, np.array(edges, int).reshape(-1, 2)).tolist())


def _longest_path(edges: list[Edge], lengths: Iterable[float]) -> float:
    near: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for (a, b), d in zip(edges, lengths, strict=True):
        near[a].append((b, d))
        near[b].append((a, d))
    best, seen = 0.0, set()

    def sweep(start: int) -> tuple[float, int]:
        far, heap, last, reached = set(), [(0.0, start)], (0.0, start), {start: 0.0}
        while heap:
            d, node = heapq.heappop(heap)
            if node not in far:
                far.add(node)
                last = max(last, (d, node))
                for n, step in near[node]:
                    if n not in reached or d + step < reached[n]:
                        reached[n] = d + step
                        heapq.heappush(heap, (d + step, n))
        seen.update(far)
        return last

    for node in sorted(near):
        if node not in seen:
            best = max(best, sweep(sweep(node)[1])[0])
    return best


#: Voxels of boxes that are worked on together; a larger object is worked on alone.
_TOGETHER = 1 << 21


def _alike(shapes: np.ndarray, most: float) -> Iterator[np.ndarray]:
    """Objects in groups of like shape: boxes that hold each have at most three times the objects' own voxels, and ``most`` for more than one."""
    sizes = shapes.prod(1)
    order = np.lexsort((sizes, *np.ceil(np.log2(shapes)).T))
    group, box, own = [], (0, 0, 0), 0
    for i, shape, size in zip(order.tolist(), shapes[order].tolist(), sizes[order].tolist(), strict=True):
        wider = tuple(map(max, box, shape))
        padded = math.prod(wider) * (len(group) + 1)
        if group and (padded > 3 * (own + size) or padded > most):
            yield np.array(group)
            group, wider, own = [], tuple(shape), 0
        group.append(i)
        box, own = wider, own + size
    if group:
        yield np.array(group)


def skeleton(points: np.ndarray, frame: Frame, erosion: bool = True, shortest: float = 100.0, tolerance: float = 50.0) -> dict:
    """Full and simplified skeleton of one object (coordinates in raster order), with its metrics; vertices are x, y, z.

    Anisotropic voxels are first repeated to the size of the smallest edge.  Radii come from the
    object before erosion; if thinning leaves nothing, its deepest voxel is the skeleton.
    """
    return next(skeletons(points, np.array([0]), frame, erosion, shortest, tolerance))[1]


def skeletons(points: np.ndarray, starts: np.ndarray, frame: Frame, erosion: bool = True, shortest: float = 100.0, tolerance: float = 50.0) -> Iterator[tuple[int, dict]]:
    """(place, ``skeleton``) of many objects, whose points begin at ``starts``: those of like shape are worked on as one array."""
    low = np.minimum.reduceat(points, starts)
    shapes = np.maximum.reduceat(points, starts) - low + 3
    counts = np.diff(starts, append=len(points))
    voxel = np.array(frame.voxel, float)
    for group in _alike(shapes, _TOGETHER / float(np.prod(voxel / voxel.min()))):
        own = np.repeat(np.arange(len(group)), counts[group])
        at = points[np.arange(len(own)) + np.repeat(starts[group] - np.cumsum(counts[group]) + counts[group], counts[group])] - low[group][own] + 1
        solid = np.zeros((len(group), *shapes[group].max(0)), bool)
        solid[own, *at.T] = True
        step = voxel
        if voxel.max() - voxel.min() > 1e-9:
            step = np.array([voxel.min()] * 3)
            shape = np.maximum(1, np.round(np.array(solid.shape[1:]) * voxel / step)).astype(int)
            index = [np.clip(np.floor((np.arange(n) + 0.5) * f / v).astype(int), 0, s - 1) for n, f, v, s in zip(shape, step, voxel, solid.shape[1:], strict=True)]
            solid = solid[np.ix_(np.arange(len(group)), *index)]
        yield from zip(group.tolist(), _skeletons(solid, step, np.array(frame.corner) + (low[group] - 1) * voxel, erosion, shortest, tolerance), strict=True)


def _skeletons(solid: np.ndarray, step: np.ndarray, origins: np.ndarray, erosion: bool, shortest: float, tolerance: float) -> Iterator[dict]:
    """The skeletons of volumes (object, z, y, x) whose borders are background."""
    deep = distance_transform(solid, tuple(step))
    core = solid
    if erosion:
        core = solid.copy()
        for o in offsets(1):
            core &= np.roll(solid, o, (1, 2, 3))
    lines = thinned(core)
    for i in np.flatnonzero(~lines.any((1, 2, 3)) & ((not erosion) | core.any((1, 2, 3)))):
        lines[i][np.unravel_index(np.where(solid[i], deep[i], -1).argmax(), solid.shape[1:])] = True
    at = np.flatnonzero(lines)
    own, *places = np.unravel_index(at, lines.shape)
    places = np.ascontiguousarray(((np.stack(places, 1) + 0.5) * step + origins[own])[:, ::-1])
    radii, rounded = deep.reshape(-1)[at], np.round(places, 6)
    edges = _edges(lines, at)
    lengths = _lengths(places, edges).tolist()
    first = np.searchsorted(own, np.arange(len(lines) + 1))
    first_edge = np.searchsorted(edges[:, 0], first)
    for p, q, e, f in zip(first[:-1].tolist(), first[1:].tolist(), first_edge[:-1].tolist(), first_edge[1:].tolist(), strict=True):
        full = list(map(tuple, (edges[e:f] - p).tolist()))
        length = dict(zip(full, lengths[e:f], strict=True))
        short, chains = _pruned(full, length, shortest)
        pairs = iter(rounded[p + np.array([c for c in chains if len(c) == 2], int).reshape(-1, 2)])
        yield {
            "vertices": places[p:q],
            "radii": radii[p:q],
            "edges": edges[e:f] - p,
            "polylines": [next(pairs) if len(c) == 2 else simplified(places[p:q][c], tolerance) for c in chains],
            "longest": _longest_path(short, map(length.__getitem__, short)),
            "branches": len(chains),
            "radius_mean": float(radii[p:q].mean()) if q > p else math.nan,
            "radius_std": float(radii[p:q].std()) if q > p else math.nan,
        }


def _lists(arrays: list, values: pa.Array | None = None) -> pa.Array:
    """Arrow lists, one for each of ``arrays``: of their rows, or of as many of ``values`` as each is long."""
    if values is None:
        rows = np.concatenate(arrays)
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.reshape(-1)))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), values)


def skeletonize(voxels: DataFrame, frame: Frame, erosion: bool = True, shortest: float = 100.0, tolerance: float = 50.0) -> DataFrame:
    """(label, vertices, edges, polylines and metrics) of each object."""
    schema = "label long, vertices array<array<double>>, edges array<array<long>>, polylines array<array<array<double>>>, longest_path double, branches long, radius_mean double, radius_std double"
    names = [p.split()[0] for p in schema.split(", ")]

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, labels, *points in bulks(batches, ["label", *ZYX]):
            found = skeletons(np.stack(points, 1).astype(np.int64), starts, frame, erosion, shortest, tolerance)
            while some := list(islice(found, 1024)):
                own = [s for _, s in some]
                lines = [s["polylines"] for s in own]
                flat = [p for own_lines in lines for p in own_lines] or [np.zeros((0, 3))]
                arrays = [pa.array(labels[starts[[i for i, _ in some]]]), _lists([s["vertices"] for s in own]), _lists([s["edges"] for s in own]), _lists(lines, _lists(flat))]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array([s[k] for s in own]) for k in ("longest", "branches", "radius_mean", "radius_std")], names)

    # a fixed number of partitions: rows are few for the work they make, so that Spark would merge them by their size
    partitions = int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = voxels.select("label", *ZYX).repartition(partitions, "label").sortWithinPartitions("label")
    return rows.mapInArrow(applied, schema)


# --- mutex watershed ---------------------------------------------------------------------------


#: Fixed value: the share of the smoothed affinities (less a half) that is added to an affinity.
SMOOTHING = 0.001


def _smoothed(channels: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Each channel smoothed along its three axes; at the border the array is mirrored."""
    for axis, s in enumerate(sigma, 1):
        if s > 0:
            weights = morphology.gaussian_weights(float(s))
            r, n = len(weights) // 2, channels.shape[axis]
            wide = np.pad(channels, [(r, r) if a == axis else (0, 0) for a in range(4)], mode="symmetric")
            channels = sum(w * np.take(wide, range(k, k + n), axis) for k, w in enumerate(weights))
    return channels


def mutex_watershed(affinities: np.ndarray, neighbourhood: list[tuple[int, int, int]], adjacent_bias: float = -0.4, far_biases: list[float] | float = -0.6, filter_value: float = 0.5, seed: int = 0, noise: float = 1e-4) -> np.ndarray:
    """Labels 1..n of one block from affinities (channel, z, y, x): uint8 counts as /255.

    Edges go by falling |weight|: attractive ones merge unless a mutex forbids it, repulsive ones set a
    mutex.  A trace of the smoothed affinities lets ties go by their surroundings; noise that breaks the
    others is seeded.  A list of far biases moves on with each offset longer than the one before it.
    Fragments below the mean affinity ``filter_value`` are dropped.
    """
    weights = affinities / 255.0 if affinities.dtype == np.uint8 else affinities.astype(float)
    shape = weights.shape[1:]
    if weights.max(initial=0) < 1e-4:
        return np.zeros(shape, np.int64)
    mean = weights.mean(0)
    shifts, listed = [], iter(far_biases) if isinstance(far_biases, list) else None
    before = bias = None
    for offset in neighbourhood:
        size = math.sqrt(sum(v * v for v in offset))
        if listed is not None and size > 1 and before is not None and size > before:
            bias = next(listed)
        shifts.append(adjacent_bias if size <= 1 else bias if listed is not None else size * far_biases)
        before = size
    rng = np.random.Generator(np.random.PCG64(seed))
    smooth = SMOOTHING * (_smoothed(weights, np.array(neighbourhood).max(0) / 3) - 0.5)
    noisy = weights + smooth + np.array(shifts)[:, None, None, None] + rng.normal(0, noise, weights.shape)
    ids = np.arange(mean.size).reshape(shape)
    a, b, w = [], [], []
    for channel, o in enumerate(neighbourhood):
        low = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(o, shape, strict=True))
        high = tuple(slice(max(0, d), n + min(0, d)) for d, n in zip(o, shape, strict=True))
        a.append(ids[low].ravel())
        b.append(ids[high].ravel())
        w.append(noisy[channel][low].ravel())
    a, b, w = (np.concatenate(v) for v in (a, b, w))
    parent = list(range(mean.size))
    mutex: dict[int, set[int]] = defaultdict(set)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k in np.argsort(-np.abs(w), kind="stable").tolist():
        i, j = find(int(a[k])), find(int(b[k]))
        if i == j:
            continue
        if w[k] > 0:
            if j not in mutex[i]:
                if len(mutex[i]) < len(mutex[j]):
                    i, j = j, i
                parent[j] = i
                for m in mutex.pop(j, set()):
                    mutex[m].discard(j)
                    mutex[m].add(i)
                    mutex[i].add(m)
        else:
            mutex[i].add(j)
            mutex[j].add(i)
    roots = np.array([find(i) for i in range(mean.size)])
    values, labels = np.unique(roots, return_inverse=True)
    if filter_value > 0:
        average = np.bincount(labels, mean.ravel()) / np.bincount(labels)
        keep = average >= filter_value
        names = np.where(keep, np.cumsum(keep), 0)
    else:
        names = np.arange(1, len(values) + 1)
    return names[labels].reshape(shape).astype(np.int64)


def watershed_blocks(affinities: DataFrame, frame: Frame, neighbourhood: list[tuple[int, int, int]], block: tuple[int, int, int], padding: int | None = None, connectivity: int | None = None, opening: bool = False, **options) -> DataFrame:
    """(z, y, x, label) of fragments from rows (z, y, x, affs array), block by block with a halo; labels are unique by block.

    With a ``connectivity``, each connected part of a fragment is one of its own, after an erosion with ``opening``.
    """
    halo = max(max(map(abs, o)) for o in neighbourhood) if padding is None else padding
    _, ny, nx = frame.blocks(block)
    spans = []
    for c, b, n in zip(ZYX, block, frame.blocks(block), strict=True):
        first = F.greatest(F.lit(0), F.floor((F.col(c) - halo) / b)).cast("int")
        last = F.least(F.lit(n - 1), F.floor((F.col(c) + halo) / b)).cast("int")
        spans.append((f"b{c}", F.sequence(first, last)))
    rows = affinities
    for name, span in spans:
        rows = rows.withColumn(name, F.explode(span))
    rows = rows.withColumn("block", ((F.col("bz") * ny + F.col("by")) * nx + F.col("bx")).cast("long")).select("block", *ZYX, "affs")
    size = math.prod(b + 2 * halo for b in block)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["block"]):
            index = int(table.column("block")[0].as_py())
            read, write = frame.block(index, block, halo)
            points = np.stack([table.column(c).to_numpy() for c in ZYX], 1) - np.array(read.begin)
            values = np.array(table.column("affs").to_pylist(), float)
            dense = np.zeros((values.shape[1], *read.shape))
            dense[(slice(None), *points.T)] = values.T
            labels = mutex_watershed(dense, neighbourhood, **options)
            if opening:
                labels = _eroded(labels)
            if connectivity is not None:
                places = np.argwhere(labels)
                if len(places):
                    labels[tuple(places.T)] = 1 + local_roots(places, labels[tuple(places.T)], offsets(connectivity, half=True))
            inner = tuple(slice(w - r, w - r + s) for w, r, s in zip(write.begin, read.begin, write.shape, strict=True))
            at = np.argwhere(labels[inner])
            found = labels[inner][tuple(at.T)] + index * size
            at = (at + np.array(write.begin)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(pa.array(at[:, i]) for i in range(3)), pa.array(found)], names=[*ZYX, "label"])

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(cut, "z int, y int, x int, label long")


def _eroded(labels: np.ndarray) -> np.ndarray:
    """Labels without the voxels that have one of another label, or the array's border, among their 26 neighbours."""
    around, keep = np.pad(labels, 1), np.ones(labels.shape, bool)
    for o in offsets(3):
        keep &= around[tuple(slice(1 + d, 1 + d + n) for d, n in zip(o, labels.shape, strict=True))] == labels
    return np.where(keep, labels, 0)


def watershed(affinities: DataFrame, frame: Frame, neighbourhood: list[tuple[int, int, int]], block: tuple[int, int, int], connectivity: int = 2, opening: bool = True, least: float = 0, most: float = float("inf"), padding: int | None = None, mask: DataFrame | None = None, holes: bool = False, **options) -> DataFrame:
    """(z, y, x, label) of objects: fragments that touch across faces of blocks are one, numbered by their first voxel.

    With ``opening`` fragments are eroded before they are joined, which parts those that only touch, and
    dilated afterwards.  Objects have least <= voxels <= most.  Without it, any fragments that touch
    across a face are joined, different objects too.  Outside ``mask`` affinities count as 0 and objects end;
    with ``holes`` holes in objects are filled.
    """
    if mask is not None:
        affinities = affinities.join(mask.select(*ZYX).distinct(), ZYX, "left_semi")
    fragments = watershed_blocks(affinities, frame, neighbourhood, block, padding, connectivity, opening, **options)
    fragments = durable(fragments.withColumn("block", components._block(frame, block)))
    on_face = F.lit(False)
    for c, b in zip(ZYX, block, strict=True):
        on_face = on_face | (F.col(c) % b == 0) | (F.col(c) % b == b - 1)
    face = fragments.where(on_face)
    other = face.select(*ZYX, F.col("label").alias("dst"), F.col("block").alias("b"))
    edges = shifted(face, offsets(connectivity, half=True), "label", "block").join(other, ZYX).where("b != block").select(F.col("label").alias("src"), "dst")
    rooted = fragments.join(joined(edges), F.col("label") == F.col("id"), "left").select(*ZYX, F.coalesce("root", "label").alias("root"))
    sizes = durable(rooted.groupBy("root").agg(F.count("*").alias("n"), F.min(raster(frame)).alias("first")))
    if not opening:
        sizes = sizes.where(F.col("n") >= least)
        sizes = sizes if most == float("inf") else sizes.where(F.col("n") <= most)
    names = numbered(sizes.select("root", "first"), "first", "id")
    out = rooted.join(names, "root").select(*ZYX, F.col("id").alias("label"))
    if opening:
        out = components.clean_components(morphology.dilate(out, frame, 1, connectivity), frame, least, most, mask)
    return components.fill_holes(out, frame, connectivity) if holes else out
