"""Components of edge tables against a plain union of nodes."""

import numpy as np
import pytest

from voxloom.operators.graph import components


def plain(edges):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root if find(i) != i}


def cases():
    rng = np.random.Generator(np.random.PCG64(5))
    order = rng.permutation(300).tolist()
    yield "random", [tuple(map(int, e)) for e in rng.integers(-200, 200, (250, 2))]
    yield "path", list(zip(order, order[1:], strict=False))
    yield "hub", [(500, i) for i in range(300)] + [(i, 500) for i in range(50)]
    yield "odd", [(1, 1), (None, 2), (3, None), (7, 4), (4, 7), (2**62, -(2**62))]
    yield "empty", []


@pytest.mark.parametrize("chunk", [1, 16, 100_000])
@pytest.mark.parametrize("name, edges", list(cases()))
def test_components(spark, name, edges, chunk):
    if chunk == 1 and name == "path":
        edges = edges[:40]
    table = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    got = components(table, chunk=chunk).collect()
    assert len(got) == len({r.id for r in got})
    assert {r.id: r.root for r in got} == plain(edges)
