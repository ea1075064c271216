"""Helpers for kernels over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The groups of neighbouring rows with equal integer ``keys``, of batches in which those rows stand together."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        held = pa.concat_tables([rest, part]).combine_chunks() if rest is not None else part
        change = np.zeros(held.num_rows, bool)
        for k in keys:
            column = held.column(k).to_numpy()
            change[1:] |= column[1:] != column[:-1]
        start = 0
        for cut in np.flatnonzero(change):
            yield held.slice(start, int(cut) - start)
            start = int(cut)
        rest = held.slice(start)
    if rest is not None:
        yield rest


def bulks(batches: Iterator[pa.RecordBatch], columns: Sequence[str], rows: int = 1 << 18) -> Iterator[tuple[np.ndarray, ...]]:
    """Many of the groups of ``runs`` (by the first of ``columns``) at a time: where each starts, and the columns of at least ``rows`` rows."""
    parts: list[list[np.ndarray]] = []
    held, wanted = 0, rows
    for batch in batches:
        parts.append([batch.column(c).to_numpy() for c in columns])
        held += batch.num_rows
        if held < wanted:
            continue
        whole = [np.concatenate(c) for c in zip(*parts, strict=True)]
        starts = np.flatnonzero(np.diff(whole[0], prepend=whole[0][0] - 1))
        cut = int(starts[-1])
        if cut:
            yield starts[:-1], *(c[:cut] for c in whole)
        parts, held = [[c[cut:] for c in whole]], held - cut
        wanted = max(rows, 2 * held)
    if held:
        whole = [np.concatenate(c) for c in zip(*parts, strict=True)]
        yield np.flatnonzero(np.diff(whole[0], prepend=whole[0][0] - 1)), *whole


def merged(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges (a, b) connect it to."""
    parent = np.arange(n)
    while len(a):
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(pa_, pb)[apart], np.minimum(pa_, pb)[apart])
        while (parent != parent[parent]).any():
            parent = parent[parent]
    return parent
