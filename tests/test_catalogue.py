"""Each query of the catalogue that SQL expresses, against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pytest

from voxloom.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("orders", "supplier"):
        c.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns and len(ours) == len(theirs)
    ours, theirs = (df[columns].sort_values(columns).reset_index(drop=True) for df in (ours, theirs))
    for c in columns:
        assert np.array_equal(ours[c].values, theirs[c].values), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_contact_sites_cover_the_whole_volume(spark):
    import itertools

    import pyarrow.parquet as pq

    from voxloom.operators.assign import bresenham

    orders = pq.read_table(f"{SF}/orders.parquet").select(["o_orderkey", "o_totalprice"]).to_pydict()
    at = {k: (k // 400, k // 20 % 20, k % 20) for k in orders["o_orderkey"]}
    a = {at[k] for k, v in zip(orders["o_orderkey"], orders["o_totalprice"], strict=True) if v >= 440000}
    b = {at[k] for k, v in zip(orders["o_orderkey"], orders["o_totalprice"], strict=True) if v < 30000}
    faces = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]

    def plus(p, o):
        return tuple(i + j for i, j in zip(p, o, strict=True))

    def inside(own):
        return {p for p in own if all(plus(p, o) in own for o in faces)}

    solid, size, voxels = inside(a) | inside(b), (3.54, 4.0, 4.5), set()
    for p, q in itertools.product(a - inside(a), b - inside(b)):
        if sum(((i - j) * s) ** 2 for i, j, s in zip(p, q, size, strict=True)) <= 64:
            line = bresenham(p, q)
            if solid.isdisjoint(line):
                voxels |= set(line)
    sites, left = set(), set(voxels)
    while left:
        site = todo = {left.pop()}
        while todo:
            todo = {plus(p, o) for p in todo for o in itertools.product((-1, 0, 1), repeat=3)} & left
            left -= todo
            site = site | todo
        if len(site) >= 2:
            sites.add(frozenset(site))
    got = {}
    for r in QUERIES["contact_sites"](spark, SF).collect():
        got.setdefault(r.label, set()).add((r.z, r.y, r.x))
    assert {frozenset(v) for v in got.values()} == sites
    assert max(x for v in got.values() for _, _, x in v) >= 10
