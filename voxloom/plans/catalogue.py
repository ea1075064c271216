"""The query catalogue: each operator on volumes made from the ``orders`` table, with SQL for a second engine.

k = o_orderkey counts voxels of a 20 x 20 x n volume in raster order of planes of 400.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.frame import Frame, Roi, scaled_to_integers
from voxloom.operators import assign, components, measure, morphology, objects, voxels
from voxloom.operators.voxels import ZYX
from voxloom.session import checkpoint_folder
from voxloom.sources import volumes
from voxloom.sources.shards import Sharding

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VOXEL = (3.54, 4.0, 4.5)
FOREGROUND, SOLID, BLOCK = 360000, 130000, (8, 8, 8)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = BASE + sql
        return f

    return register


# --- volumes -----------------------------------------------------------------------------------


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.selectExpr("cast(o_orderkey div 400 as int) z", "cast(o_orderkey div 20 % 20 as int) y", "cast(o_orderkey % 20 as int) x", "o_totalprice value", "o_orderpriority", "o_orderstatus", "o_custkey")


def _frame(spark: SparkSession, sf_dir: str) -> Frame:
    last = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.max("o_orderkey")).first()[0]
    return Frame(VOXEL, (last // 400 + 1, 20, 20))


def _fg(s: SparkSession, d: str) -> DataFrame:
    return voxels.threshold(_raw(s, d), "value", FOREGROUND).select(*ZYX, F.lit(1).cast("long").alias("label"))


def _solid(s: SparkSession, d: str) -> DataFrame:
    return voxels.threshold(_raw(s, d), "value", SOLID).select(*ZYX, F.expr("cast(1 + z % 2 as bigint) label"))


def _halves(s: SparkSession, d: str) -> DataFrame:
    return voxels.threshold(_raw(s, d), "value", SOLID).select(*ZYX, F.expr("cast(1 + y div 10 as bigint) label"))


def _sparse(s: SparkSession, d: str) -> DataFrame:
    return voxels.threshold(_raw(s, d), "value", 400000).select(*ZYX, F.expr("cast(1 + o_custkey % 400 as bigint) label"))


def _seg1(s: SparkSession, d: str) -> DataFrame:
    return _raw(s, d).select(*ZYX, F.expr("cast(substr(o_orderpriority, 1, 1) as bigint) label"))


def _seg2(s: SparkSession, d: str) -> DataFrame:
    return _raw(s, d).where("o_orderstatus != 'P'").select(*ZYX, F.expr("cast(case o_orderstatus when 'F' then 1 else 2 end as bigint) label"))


def _mask(s: SparkSession, d: str) -> DataFrame:
    return _raw(s, d).where("o_custkey % 3 != 0").select(*ZYX)


def _points(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey id", "(s_suppkey * 7 % 3 + 0.25e0) * 3.54e0 com_z", "(s_suppkey * 3 % 20 + 0.4e0) * 4e0 com_y", "(s_suppkey * 11 % 23 + 0.3e0) * 4.5e0 com_x")


def _near(connectivity: int, half: bool = False) -> str:
    return ", ".join(f"({z}, {y}, {x})" for z, y, x in voxels.offsets(connectivity, half))


BASE = f"""WITH RECURSIVE raw AS (
    SELECT CAST(o_orderkey // 400 AS INT) AS z, CAST(o_orderkey // 20 % 20 AS INT) AS y, CAST(o_orderkey % 20 AS INT) AS x, o_totalprice AS value,
           o_orderpriority, o_orderstatus, o_custkey FROM orders
), dims AS (SELECT CAST(max(o_orderkey) // 400 + 1 AS INT) AS nz FROM orders),
lat AS (SELECT CAST(i // 400 AS INT) AS z, CAST(i // 20 % 20 AS INT) AS y, CAST(i % 20 AS INT) AS x FROM range((SELECT nz * 400 FROM dims)) t(i)),
fg AS (SELECT z, y, x, 1::BIGINT AS label FROM raw WHERE value >= {FOREGROUND}),
solid AS (SELECT z, y, x, CAST(1 + z % 2 AS BIGINT) AS label FROM raw WHERE value >= {SOLID}),
halves AS (SELECT z, y, x, CAST(1 + y // 10 AS BIGINT) AS label FROM raw WHERE value >= {SOLID}),
sparse AS (SELECT z, y, x, CAST(1 + o_custkey % 400 AS BIGINT) AS label FROM raw WHERE value >= 400000),
seg1 AS (SELECT z, y, x, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS label FROM raw),
seg2 AS (SELECT z, y, x, CAST(CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS BIGINT) AS label FROM raw WHERE o_orderstatus <> 'P'),
mask AS (SELECT z, y, x FROM raw WHERE o_custkey % 3 <> 0),
pts AS (SELECT s_suppkey AS id, (s_suppkey * 7 % 3 + 0.25e0) * 3.54e0 AS com_z, (s_suppkey * 3 % 20 + 0.4e0) * 4e0 AS com_y, (s_suppkey * 11 % 23 + 0.3e0) * 4.5e0 AS com_x FROM supplier),
n6(dz, dy, dx) AS (VALUES {_near(1)}), n18(dz, dy, dx) AS (VALUES {_near(2)}), n26(dz, dy, dx) AS (VALUES {_near(3)})
"""


# --- selection ---------------------------------------------------------------------------------


@query("SELECT z, y, x, value FROM raw WHERE value >= 100000 AND value < 200000")
def threshold_voxels(s, d):
    return voxels.threshold(_raw(s, d), "value", 100000, 200000).select(*ZYX, "value")


@query(", r AS (SELECT z, y, x FROM lat EXCEPT SELECT z, y, x FROM fg) SELECT z, y, x, 1::BIGINT AS label FROM r")
def invert_voxels(s, d):
    return voxels.inverted(_fg(s, d), _frame(s, d))


@query("SELECT z, y, x, value FROM raw WHERE z >= 1 AND z < 3 AND y >= 5 AND y < 12 AND x >= 0 AND x < 7")
def roi_filter(s, d):
    return voxels.in_roi(_raw(s, d), Roi.parse(["1:3", "5:12", "0:7"])).select(*ZYX, "value")


@query(", b AS (SELECT CAST(i // 100 - 1 AS INT) AS z, CAST(i // 10 % 10 - 2 AS INT) AS y, CAST(i % 10 + 14 AS INT) AS x FROM range(300) t(i)) SELECT b.z, b.y, b.x, raw.value FROM b, dims JOIN raw ON raw.z = greatest(0, least(nz - 1, b.z)) AND raw.y = greatest(0, least(19, b.y)) AND raw.x = greatest(0, least(19, b.x))")
def edge_fill(s, d):
    return voxels.edge_filled(_raw(s, d), _frame(s, d), Roi((-1, -2, 14), (3, 10, 10)), "value")


@query("SELECT z, y, x, label FROM fg SEMI JOIN mask USING (z, y, x)")
def mask_inclusive(s, d):
    return voxels.masked(_fg(s, d), (_mask(s, d), True))


@query("SELECT z, y, x, label FROM fg ANTI JOIN mask USING (z, y, x)")
def mask_exclusive(s, d):
    return voxels.masked(_fg(s, d), (_mask(s, d), False))


@query("SELECT z, y, x, label FROM fg SEMI JOIN mask USING (z, y, x) WHERE (z, y, x) NOT IN (SELECT (z, y, x) FROM seg2 WHERE label = 1)")
def mask_multi_and(s, d):
    return voxels.masked(_fg(s, d), (_mask(s, d), True), (_seg2(s, d).where("label = 1"), False))


@query("SELECT z, y, x, CAST(CASE label WHEN 4 THEN 1 ELSE 3 END AS BIGINT) AS label FROM seg1 WHERE label IN (4, 2)")
def filter_ids_keep(s, d):
    return voxels.filter_ids(_seg1(s, d), "4,2,2")


@query("SELECT z, y, x, 1::BIGINT AS label FROM seg1 WHERE label IN (4, 2)")
def filter_ids_binarize(s, d):
    return voxels.filter_ids(_seg1(s, d), [4, 2], binarize=True)


@query("SELECT z, y, x, label FROM seg1 WHERE label NOT IN (4, 2)")
def filter_ids_remove(s, d):
    return voxels.filter_ids(_seg1(s, d), remove=[4, 2])


@query("SELECT z, y, x, seg2.label FROM raw JOIN seg2 USING (z, y, x) WHERE value >= 100000 AND value < 300000")
def label_with_mask(s, d):
    return voxels.label_with_mask(_raw(s, d), "value", _seg2(s, d), 100000, 300000)


_SURFACE = "(SELECT a.z, a.y, a.x, a.label FROM {t} a, n6 LEFT JOIN {t} b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL HAVING count(*) FILTER (WHERE b.label = a.label) < 6)"


@query(", l AS (SELECT z, y, x, seg2.label FROM raw JOIN seg2 USING (z, y, x) WHERE value >= 50000) SELECT * FROM " + _SURFACE.format(t="l"))
def label_with_mask_surface(s, d):
    return voxels.label_with_mask(_raw(s, d), "value", _seg2(s, d), 50000, surface_only=True)


@query("SELECT z, y, x, label * 10 AS label FROM seg1 WHERE label <> 3")
def relabel_lookup(s, d):
    mapping = s.createDataFrame([(1, 10), (2, 20), (3, 0), (4, 40), (5, 50)], "old_id long, new_id long")
    return voxels.relabelled(_seg1(s, d), mapping)


# --- neighbours and components -----------------------------------------------------------------


def _touching(connectivity: int, same: str = "") -> str:
    return f"SELECT DISTINCT least(a.label, b.label) AS src, greatest(a.label, b.label) AS dst FROM sparse a, (VALUES {_near(connectivity, True)}) n(dz, dy, dx) JOIN sparse b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx {same} WHERE a.label <> b.label"


@query(_touching(1))
def touching_ids_c1(s, d):
    return voxels.touching_ids(_sparse(s, d), 1)


@query(_touching(3))
def touching_ids_c3(s, d):
    return voxels.touching_ids(_sparse(s, d), 3)


@query(_touching(2, "JOIN seg2 oa ON (oa.z, oa.y, oa.x) = (a.z, a.y, a.x) JOIN seg2 ob ON (ob.z, ob.y, ob.x) = (b.z, b.y, b.x) AND ob.label = oa.label"))
def touching_ids_same_object(s, d):
    return voxels.touching_ids(_sparse(s, d), 2, _seg2(s, d))


def _component_sql(table: str, near: str, having: str = "", same: str = "") -> str:
    return f""", v AS (SELECT *, (z * 20 + y) * 20 + x AS i FROM {table}),
    e AS (SELECT a.i AS a, b.i AS b FROM v a, {near} JOIN v b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx {same}),
    r(i, j) AS (SELECT i, i FROM v UNION SELECT r.i, e.b FROM r JOIN e ON r.j = e.a),
    c AS (SELECT i, min(j) AS root FROM r GROUP BY i),
    k AS (SELECT root, row_number() OVER (ORDER BY root) AS label FROM c GROUP BY root {having})
    SELECT v.z, v.y, v.x, CAST(k.label AS BIGINT) AS label FROM v JOIN c USING (i) JOIN k USING (root)"""


@query(_component_sql("fg", "n6"))
def connected_components_c1(s, d):
    return components.connected_components(_fg(s, d), _frame(s, d), 1, block=BLOCK)


@query(_component_sql("fg", "n18"))
def connected_components_c2(s, d):
    return components.connected_components(_fg(s, d), _frame(s, d), 2, block=BLOCK)


@query(_component_sql("fg", "n26"))
def connected_components_c3(s, d):
    return components.connected_components(_fg(s, d), _frame(s, d), 3, block=BLOCK)


@query(_component_sql("fg", "n6", "HAVING count(*) BETWEEN 2 AND 30"))
def connected_components_volume_filter(s, d):
    frame = _frame(s, d)
    least, most = components.voxel_bounds(frame, 2 * frame.volume, 30 * frame.volume)
    return components.connected_components(_fg(s, d), frame, 1, least=round(least, 6), most=round(most, 6), block=BLOCK)


@query(_component_sql("seg1", "n6", same="AND b.label = a.label"))
def connected_components_multilabel(s, d):
    return components.connected_components(_seg1(s, d), _frame(s, d), 1, by_label=True, block=BLOCK)


@query(_component_sql("(SELECT z, y, x, seg2.label FROM fg JOIN seg2 USING (z, y, x))", "n6", same="AND b.label = a.label"))
def connected_components_same_object(s, d):
    return components.components_within(_fg(s, d), _seg2(s, d), _frame(s, d), 1, block=BLOCK)


@query(_component_sql("seg1", "n6", same="AND b.label = a.label"))
def deduplicate_ids(s, d):
    return components.deduplicate_ids(_seg1(s, d), _frame(s, d), 1, block=BLOCK)


@query("SELECT z, y, x, CAST(7 + y // 10 AS BIGINT) AS label FROM raw WHERE value IS NOT NULL")
def deduplicate_ids_unique(s, d):
    whole = _raw(s, d).select(*ZYX, F.expr("cast(7 + y div 10 as bigint) label"))
    return components.deduplicate_ids(whole, _frame(s, d), 3, block=BLOCK)


@query(", m AS (SELECT seg1.* FROM seg1 SEMI JOIN mask USING (z, y, x)), k AS (SELECT label AS old, row_number() OVER (ORDER BY label) AS label FROM m GROUP BY m.label HAVING count(*) >= (SELECT count(*) // 5 FROM m)) SELECT z, y, x, CAST(k.label AS BIGINT) AS label FROM m JOIN k ON k.old = m.label")
def clean_components(s, d):
    seg, mask = _seg1(s, d), _mask(s, d)
    return components.clean_components(seg, _frame(s, d), least=voxels.masked(seg, (mask, True)).count() // 5, mask=mask)


_HOLES = """, bg AS (SELECT lat.*, (z * 20 + y) * 20 + x AS i FROM lat ANTI JOIN solid USING (z, y, x)),
    e AS (SELECT a.i AS a, b.i AS b FROM bg a, n6 JOIN bg b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx),
    r(i, j) AS (SELECT i, i FROM bg UNION SELECT r.i, e.b FROM r JOIN e ON r.j = e.a),
    c AS (SELECT i, min(j) AS root FROM r GROUP BY i),
    h AS (SELECT bg.*, root FROM bg JOIN c USING (i) WHERE root NOT IN (SELECT root FROM bg JOIN c USING (i), dims WHERE z IN (0, nz - 1) OR y IN (0, 19) OR x IN (0, 19))),
    o AS (SELECT root, min(s.label) AS a, max(s.label) AS b FROM h, n6 JOIN solid s ON s.z = h.z + dz AND s.y = h.y + dy AND s.x = h.x + dx GROUP BY root)
    """


@query(_HOLES + "SELECT h.z, h.y, h.x, CAST(CASE WHEN a = b THEN a ELSE 0 END AS BIGINT) AS label FROM h JOIN o USING (root)")
def hole_assignments(s, d):
    return components.hole_assignments(_solid(s, d), _frame(s, d), 1, BLOCK).select(*ZYX, F.col("label").cast("long").alias("label"))


@query(_HOLES + "SELECT z, y, x, label FROM solid UNION ALL SELECT h.z, h.y, h.x, a FROM h JOIN o USING (root) WHERE a = b")
def fill_holes(s, d):
    return components.fill_holes(_solid(s, d), _frame(s, d), 1, BLOCK)


# --- measures ----------------------------------------------------------------------------------

_FACES = "(VALUES (1, 0, 0, 4e0 * 4.5e0), (-1, 0, 0, 4e0 * 4.5e0), (0, 1, 0, 3.54e0 * 4.5e0), (0, -1, 0, 3.54e0 * 4.5e0), (0, 0, 1, 3.54e0 * 4e0), (0, 0, -1, 3.54e0 * 4e0)) f(dz, dy, dx, area)"
_AREA = f"SELECT a.label, sum(area) AS area FROM seg1 a, {_FACES} LEFT JOIN seg1 b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE b.label IS DISTINCT FROM a.label GROUP BY a.label"
_PHYSICAL = "SELECT label, (z + 0.5e0) * 3.54e0 AS z, (y + 0.5e0) * 4e0 AS y, (x + 0.5e0) * 4.5e0 AS x, value FROM seg1 JOIN raw USING (z, y, x)"


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("SELECT label, count(*) AS n FROM seg1 GROUP BY label")
def label_counts(s, d):
    return _seg1(s, d).groupBy("label").agg(F.count("*").alias("n"))


@query(f", a AS ({_AREA}) SELECT label, round(area, 4) AS area FROM a")
def surface_area(s, d):
    return _rounded(measure.surface_areas(_seg1(s, d), _frame(s, d)))


@query(f""", a AS ({_AREA}), p AS ({_PHYSICAL}),
    m AS (SELECT label, count(*) AS n, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx, sum(z * z + y * y + x * x) / count(*) AS r2, min(z) AS az, min(y) AS ay, min(x) AS ax, max(z) AS bz, max(y) AS by_, max(x) AS bx FROM p GROUP BY label)
    SELECT label, n, round(n * 3.54e0 * 4e0 * 4.5e0, 4) AS volume, round(sqrt(greatest(0e0, r2 - cz * cz - cy * cy - cx * cx)), 4) AS rg, round(cz, 4) AS com_z, round(cy, 4) AS com_y, round(cx, 4) AS com_x,
    round(az, 4) AS min_z, round(ay, 4) AS min_y, round(ax, 4) AS min_x, round(bz, 4) AS max_z, round(by_, 4) AS max_y, round(bx, 4) AS max_x, round(area, 4) AS area FROM m JOIN a USING (label)""")
def measure_objects(s, d):
    return _rounded(measure.measure(_seg1(s, d), _frame(s, d)))


@query(f", p AS ({_PHYSICAL}) SELECT label, round(avg(value), 2) AS raw_mean, round(stddev_pop(value), 2) AS raw_std FROM p GROUP BY label")
def measure_raw_intensity(s, d):
    frame = _frame(s, d)
    out = measure.measure(_seg1(s, d), frame, _raw(s, d).select(*ZYX, "value"))
    return _rounded(out.select("label", "raw_mean", "raw_std"), 2)


@query(f", p AS ({_PHYSICAL}) SELECT label, count(*) AS n, round(avg(z), 4) AS com_z, round(min(x), 4) AS min_x, round(max(y), 4) AS max_y FROM p GROUP BY label")
def measure_merge_blocks(s, d):
    seg, frame = _seg1(s, d), _frame(s, d)
    parts = measure.partial_sums(seg.where("z % 2 = 0"), frame).union(measure.partial_sums(seg.where("z % 2 = 1"), frame))
    return _rounded(measure.finished(measure.merged_sums(parts), frame).select("label", "n", "com_z", "min_x", "max_y"))


@query(f""", f AS (SELECT a.z, a.y, a.x, a.label, sum(CASE WHEN b.label IS DISTINCT FROM a.label THEN area ELSE 0e0 END) AS area FROM seg2 a, {_FACES} LEFT JOIN seg2 b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL)
    SELECT c.label AS contact, f.label AS organelle, round(sum(area), 4) AS area FROM seg1 c JOIN f ON (f.z, f.y, f.x) = (c.z, c.y, c.x) GROUP BY ALL""")
def contact_area_by_organelle(s, d):
    return _rounded(measure.contact_areas(_seg1(s, d), _seg2(s, d), _frame(s, d)))


# --- morphology --------------------------------------------------------------------------------


@query("SELECT a.z, a.y, a.x, a.label FROM halves a, n6 JOIN halves b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx AND b.label = a.label GROUP BY ALL HAVING count(*) = 6")
def erode_labels(s, d):
    return morphology.erode(_halves(s, d), _frame(s, d), block=BLOCK)


@query("SELECT z, y, x, label FROM halves a WHERE NOT EXISTS (SELECT 1 FROM (VALUES " + ", ".join(f"({z}, {y}, {x})" for z in range(-2, 3) for y in range(-2, 3) for x in range(-2, 3) if 0 < abs(z) + abs(y) + abs(x) <= 2) + ") n(dz, dy, dx) LEFT JOIN halves b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE b.label IS DISTINCT FROM a.label)")
def erode_labels_twice(s, d):
    return morphology.erode(_halves(s, d), _frame(s, d), 2, block=BLOCK)


@query("SELECT DISTINCT z + dz AS z, y + dy AS y, x + dx AS x, 1::BIGINT AS label FROM raw, dims, (VALUES " + ", ".join(f"({z}, {y}, {x})" for z in range(-3, 4) for y in range(-3, 4) for x in range(-3, 4) if abs(z) + abs(y) + abs(x) <= 3) + ") n(dz, dy, dx) WHERE value >= 440000 AND z + dz BETWEEN 0 AND nz - 1 AND y + dy BETWEEN 0 AND 19 AND x + dx BETWEEN 0 AND 19")
def dilate_three_times(s, d):
    few = voxels.threshold(_raw(s, d), "value", 440000).select(*ZYX, F.lit(1).cast("long").alias("label"))
    return morphology.dilate(few, _frame(s, d), 3, block=BLOCK)


@query(", b1 AS (SELECT z, y, x, 1::BIGINT AS label FROM solid) SELECT a.z, a.y, a.x, a.label FROM b1 a, n18 JOIN b1 b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL HAVING count(*) = 18")
def erode_binary(s, d):
    return morphology.erode(_solid(s, d).select(*ZYX, F.lit(1).cast("long").alias("label")), _frame(s, d), 1, 2)


@query("SELECT z, y, x, label FROM fg UNION SELECT z + dz, y + dy, x + dx, label FROM fg, n6, dims WHERE z + dz BETWEEN 0 AND nz - 1 AND y + dy BETWEEN 0 AND 19 AND x + dx BETWEEN 0 AND 19")
def dilate_binary(s, d):
    return morphology.dilate(_fg(s, d), _frame(s, d))


@query(""", l AS (SELECT z, y, x, CAST(1 + x % 3 AS BIGINT) AS label FROM fg),
    g AS (SELECT z + dz AS z, y + dy AS y, x + dx AS x, label, count(*) AS k FROM l, n26, dims WHERE z + dz BETWEEN 0 AND nz - 1 AND y + dy BETWEEN 0 AND 19 AND x + dx BETWEEN 0 AND 19 GROUP BY ALL),
    w AS (SELECT g.z, g.y, g.x, label, row_number() OVER (PARTITION BY g.z, g.y, g.x ORDER BY k DESC, label) AS r FROM g ANTI JOIN l USING (z, y, x))
    SELECT z, y, x, label FROM l UNION ALL SELECT z, y, x, label FROM w WHERE r = 1""")
def dilate_labels(s, d):
    return morphology.dilate(_fg(s, d).select(*ZYX, F.expr("cast(1 + x % 3 as bigint) label")), _frame(s, d), 1, 3)


@query("SELECT z, y, x, label FROM " + _SURFACE.format(t="solid"))
def surface_voxels(s, d):
    return voxels.surface_voxels(_solid(s, d))


@query(""", b1 AS (SELECT z, y, x FROM halves WHERE label = 1),
    e AS (SELECT a.z, a.y, a.x FROM b1 a, n6, dims LEFT JOIN b1 b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx
          GROUP BY ALL HAVING count(*) FILTER (WHERE b.z IS NULL AND a.z + dz BETWEEN 0 AND nz - 1 AND a.y + dy BETWEEN 0 AND 19 AND a.x + dx BETWEEN 0 AND 19) = 0),
    g AS (SELECT z, y, x FROM e UNION SELECT z + dz, y + dy, x + dx FROM e, n6, dims WHERE z + dz BETWEEN 0 AND nz - 1 AND y + dy BETWEEN 0 AND 19 AND x + dx BETWEEN 0 AND 19)
    SELECT z, y, x, 1::BIGINT AS label FROM g""")
def mask_erosion_dilation_list(s, d):
    return morphology.mask_operations(_halves(s, d), _frame(s, d), [("erosion", 1), ("dilation", 1)], value=1)


def _smooth_sql(sigma: float) -> str:
    out, source = "", "dense"
    for axis, size in zip(ZYX, VOXEL, strict=True):
        weights = morphology.gaussian_weights(sigma / size)
        values = ", ".join(f"({k - len(weights) // 2}, {w!r}e0)" if "e" not in repr(w) else f"({k - len(weights) // 2}, {w!r})" for k, w in enumerate(weights))
        on = " AND ".join(f"b.{c} = a.{c}" + (" + k" if c == axis else "") for c in ZYX)
        out += f", s{axis} AS (SELECT a.z, a.y, a.x, sum(w * b.value) AS value FROM {source} a, (VALUES {values}) t(k, w) JOIN {source} b ON {on} GROUP BY ALL)"
        source = f"s{axis}"
    return ", dense AS (SELECT lat.*, coalesce(value, 0e0) AS value FROM lat LEFT JOIN raw USING (z, y, x))" + out + f" SELECT z, y, x, round(value, 3) AS value FROM {source}"


@query(_smooth_sql(4.0))
def gaussian_smooth(s, d):
    return _rounded(morphology.gaussian(_raw(s, d).select(*ZYX, "value"), _frame(s, d), 4.0), 3)


@query("SELECT CAST(z * 2 + a AS INT) AS z, CAST(y * 2 + b AS INT) AS y, CAST(x * 2 + c AS INT) AS x, label FROM fg, (VALUES (0), (1)) ta(a), (VALUES (0), (1)) tb(b), (VALUES (0), (1)) tc(c)")
def resample_up(s, d):
    return morphology.resampled(_fg(s, d), _frame(s, d), tuple(v / 2 for v in VOXEL))


@query("SELECT CAST(z // 2 AS INT) AS z, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, label FROM seg1 WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0")
def resample_down(s, d):
    return morphology.resampled(_seg1(s, d), _frame(s, d), tuple(v * 2 for v in VOXEL))


# --- spatial joins -----------------------------------------------------------------------------


@query("SELECT z, y, x FROM fg SEMI JOIN seg2 USING (z, y, x)")
def overlap_voxels(s, d):
    return _fg(s, d).join(_seg2(s, d), ZYX, "left_semi").select(*ZYX)


@query(""", b AS (SELECT z, y, x FROM seg2 WHERE label = 1)
    SELECT a.z AS az, a.y AS ay, a.x AS ax, b.z AS bz, b.y AS by_, b.x AS bx FROM fg a JOIN b ON b.z BETWEEN a.z - 3 AND a.z + 3 AND abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3
    WHERE pow((a.z - b.z) * 3.54e0, 2) + pow((a.y - b.y) * 4e0, 2) + pow((a.x - b.x) * 4.5e0, 2) <= 64e0""")
def ball_join_pairs(s, d):
    return assign.ball_join(_fg(s, d), _seg2(s, d).where("label = 1"), _frame(s, d), 8.0).withColumnRenamed("by", "by_")


@query()
def contact_sites(s, d):
    frame = _frame(s, d)
    a = _raw(s, d).where("value >= 440000").select(*ZYX, F.lit(1).cast("long").alias("label"))
    b = _raw(s, d).where("value < 30000").select(*ZYX, F.lit(1).cast("long").alias("label"))
    return assign.contact_sites(a, b, frame, 8.0, 2 * frame.volume, BLOCK)


@query("SELECT id, CAST(coalesce(label, 0) AS BIGINT) AS organelle FROM pts LEFT JOIN seg2 ON z = CAST(trunc(com_z / 3.54e0) AS INT) AND y = CAST(trunc(com_y / 4e0) AS INT) AND x = CAST(trunc(com_x / 4.5e0) AS INT)")
def assign_containing(s, d):
    return assign.assign_containing(_points(s, d), _seg2(s, d), _frame(s, d)).select("id", F.col("organelle").cast("long").alias("organelle"))


def _nearest_sql(n: int) -> str:
    surface = _SURFACE.format(t="o")
    return f""", o AS (SELECT z, y, x, CAST(label * 100 + z // 2 AS BIGINT) AS label FROM seg1 WHERE label < 3), su AS (SELECT * FROM {surface}),
    h AS (SELECT id, label FROM pts JOIN o ON z = CAST(trunc(com_z / 3.54e0) AS INT) AND y = CAST(trunc(com_y / 4e0) AS INT) AND x = CAST(trunc(com_x / 4.5e0) AS INT)),
    q AS (SELECT id, label, min(sqrt(pow((z + 0.5e0) * 3.54e0 - com_z, 2) + pow((y + 0.5e0) * 4e0 - com_y, 2) + pow((x + 0.5e0) * 4.5e0 - com_x, 2))) AS dist FROM pts, su GROUP BY ALL),
    w AS (SELECT q.id, q.label, CASE WHEN h.label = q.label THEN 0e0 ELSE dist END AS dist FROM q LEFT JOIN h USING (id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, label) AS rank FROM w)
    SELECT id, CAST(rank AS INT) AS rank, label AS organelle, round(dist, 4) AS distance FROM k WHERE rank <= {n}"""


def _organelles(s: SparkSession, d: str) -> DataFrame:
    return _seg1(s, d).where("label < 3").select(*ZYX, F.expr("cast(label * 100 + z div 2 as bigint) label"))


@query(_nearest_sql(1))
def assign_nearest_1(s, d):
    return _rounded(assign.assign_nearest(_points(s, d), _organelles(s, d), _frame(s, d), 1))


@query(_nearest_sql(2))
def assign_nearest_n(s, d):
    return _rounded(assign.assign_nearest(_points(s, d), _organelles(s, d), _frame(s, d), 2))


# --- objects -----------------------------------------------------------------------------------


@query()
def fit_lines(s, d):
    return objects.fit_lines(_seg1(s, d), _frame(s, d))


def _unbridged_sql(connectivity: int) -> str:
    parts = []
    for o in voxels.offsets(3, half=True):
        axes = [i for i in range(3) if o[i]]
        if len(axes) < (2 if connectivity == 6 else 3):
            continue
        steps = [tuple(o[i] if i in axes and k >> axes.index(i) & 1 else 0 for i in range(3)) for k in range(1, 2 ** len(axes) - 1)]
        missing = " AND ".join(f"NOT EXISTS (SELECT 1 FROM fg c WHERE c.z = a.z + {z} AND c.y = a.y + {y} AND c.x = a.x + {x})" for z, y, x in steps)
        parts.append(f"SELECT p.z, p.y, p.x FROM fg a JOIN fg p ON p.z = a.z + {o[0]} AND p.y = a.y + {o[1]} AND p.x = a.x + {o[2]} WHERE {missing}")
    return f", gone AS ({' UNION '.join(parts)}) SELECT z, y, x, label FROM fg ANTI JOIN gone USING (z, y, x)"


@query(_unbridged_sql(6))
def unbridged_removal_6(s, d):
    return objects.unbridged(_fg(s, d), 6)


@query(_unbridged_sql(18))
def unbridged_removal_18(s, d):
    return objects.unbridged(_fg(s, d), 18)


def _few(s: SparkSession, d: str) -> DataFrame:
    return _raw(s, d).where(f"value >= {SOLID}").select(*ZYX, F.expr("cast(1 + x div 7 + 3 * (y div 7) + 9 * (z div 12) as bigint) label"))


@query()
def skeleton_metrics(s, d):
    return objects.skeletonize(_few(s, d), _frame(s, d), erosion=False, shortest=10.0, tolerance=5.0).select("label", "longest_path", "branches", "radius_mean", "radius_std")


@query()
def skeleton_vertices(s, d):
    out = objects.skeletonize(_few(s, d), _frame(s, d), erosion=True, shortest=10.0, tolerance=5.0)
    return out.select("label", F.explode("vertices").alias("v")).select("label", *(F.col("v")[i].alias(c) for i, c in enumerate("xyz")))


@query()
def mutex_watershed(s, d):
    near = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (3, 0, 0), (0, 3, 0), (0, 0, 3)]
    affs = _raw(s, d).select(*ZYX, F.expr("transform(sequence(1, 6), i -> ((z * 400 + y * 20 + x) * 7919L * i % 1000) / 1000e0) affs"))
    return objects.watershed(affs, _frame(s, d), near, (16, 20, 20), opening=False, far_biases=-0.2, filter_value=0.3)


@query("SELECT DISTINCT o_orderkey AS label, CAST((o_orderkey >> 2 >> 1) & 3 AS BIGINT) AS shard, CAST((o_orderkey >> 2) & 1 AS BIGINT) AS minishard FROM orders")
def shard_assignment(s, d):
    shard, minishard = Sharding(2, 2, 1).columns(F.col("label"))
    ids = s.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey label").distinct()
    return ids.select("label", shard.cast("long").alias("shard"), minishard.cast("long").alias("minishard"))


# --- sources and sinks -------------------------------------------------------------------------


def _stored(s: SparkSession, df: DataFrame, d: str, roi: Roi | None = None, path: str | None = None) -> str:
    path = path or f"{checkpoint_folder(s)}/volume-{uuid.uuid4().hex}.zarr/s0"
    volumes.write_zarr(df, _frame(s, d), path, (16, 16, 16), roi=roi)
    return path


@query("SELECT z, y, x, label FROM seg1")
def zarr_round_trip(s, d):
    return volumes.read_volume(s, _stored(s, _seg1(s, d), d))[0]


@query("SELECT z, y, x, label FROM seg1 WHERE z >= 1 AND z < 20 AND y >= 5 AND y < 12 AND x >= 0 AND x < 7")
def zarr_read_by_roi(s, d):
    return volumes.read_volume(s, _stored(s, _seg1(s, d), d), roi=Roi((1, 5, 0), (19, 7, 7)))[0]


@query("SELECT z, y, x, label FROM seg1 WHERE NOT (z >= 1 AND z < 20 AND y >= 5 AND y < 12 AND x >= 3 AND x < 18) UNION ALL SELECT z, y, x, label FROM fg WHERE z >= 1 AND z < 20 AND y >= 5 AND y < 12 AND x >= 3 AND x < 18")
def zarr_write_by_roi(s, d):
    path = _stored(s, _seg1(s, d), d)
    return volumes.read_volume(s, _stored(s, _fg(s, d), d, Roi((1, 5, 3), (19, 7, 15)), path))[0]


@query("SELECT CAST(z // 4 AS INT) AS z, CAST(y // 4 AS INT) AS y, CAST(x // 4 AS INT) AS x, label FROM seg1 WHERE z % 4 = 0 AND y % 4 = 0 AND x % 4 = 0")
def zarr_multiscale(s, d):
    path = f"{checkpoint_folder(s)}/group-{uuid.uuid4().hex}.zarr"
    volumes.write_multiscale(_seg1(s, d), _frame(s, d), path, "seg1", 3, (16, 16, 16))
    return volumes.read_volume(s, f"{path}/s2")[0]


@query(f", p AS ({_PHYSICAL}) SELECT label AS id, round(count(*) * 3.54e0 * 4e0 * 4.5e0, 4) AS volume, round(avg(x), 4) AS com_x, round(max(z), 4) AS max_z FROM p GROUP BY label")
def object_csv_round_trip(s, d):
    path = f"{checkpoint_folder(s)}/objects-{uuid.uuid4().hex}.csv"
    volumes.write_objects(measure.object_table(measure.measure(_seg1(s, d), _frame(s, d))), path)
    out = volumes.read_objects(s, path)
    return _rounded(out.select(F.col("Object ID").cast("long").alias("id"), F.col("Volume (nm^3)").alias("volume"), F.col("COM X (nm)").alias("com_x"), F.col("MAX Z (nm)").alias("max_z")))


# --- objects whose results SQL can tell ----------------------------------------------------------


def _rods(s: SparkSession, d: str) -> DataFrame:
    return _raw(s, d).select(*ZYX, F.expr("cast(1 + z * 20 + y as bigint) label"))


@query("SELECT CAST(1 + z * 20 + y AS BIGINT) AS label, round((z + 0.5e0) * 3.54e0, 4) AS z, round((y + 0.5e0) * 4e0, 4) AS y, round((min(x) + 0.5e0) * 4.5e0, 4) AS low_x, round((max(x) + 0.5e0) * 4.5e0, 4) AS high_x FROM raw GROUP BY z, y HAVING count(*) > 1")
def fit_lines_rods(s, d):
    out = objects.fit_lines(_rods(s, d), _frame(s, d)).where("abs(start_x - end_x) > 1e-9")
    return _rounded(out.select("label", F.col("start_z").alias("z"), F.col("start_y").alias("y"), F.least("start_x", "end_x").alias("low_x"), F.greatest("start_x", "end_x").alias("high_x")))


@query("SELECT CAST(1 + z * 20 + y AS BIGINT) AS label, (count(*) - 1) * 4e0 AS longest_path, CAST(count(*) > 1 AS BIGINT) AS branches, 4e0 AS radius_mean, 0e0 AS radius_std FROM raw GROUP BY z, y")
def skeletonize_rods(s, d):
    frame = replace(_frame(s, d), voxel=(4.0, 4.0, 4.0))
    return _rounded(objects.skeletonize(_rods(s, d), frame, False, 0.0, 1.0).select("label", "longest_path", "branches", "radius_mean", "radius_std"))


@query(_component_sql("fg", "n6", "HAVING count(*) >= 2"))
def watershed_objects(s, d):
    """Affinities of 1 between neighbours that are both foreground: objects are its components, across all blocks."""
    near = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    fg, frame = _fg(s, d).select(*ZYX), _frame(s, d)
    ends = None
    for k, o in enumerate(near):  # an affinity lies at the first voxel of its pair
        part = fg.join(voxels.shifted(fg, [tuple(-v for v in o)]), ZYX).withColumn("k", F.lit(k))
        ends = part if ends is None else ends.union(part)
    affs = ends.groupBy(*ZYX).agg(F.collect_set("k").alias("k")).select(*ZYX, F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.array_contains("k", k).cast("double")).alias("affs"))
    return objects.watershed(affs, frame, near, BLOCK, 1, False, adjacent_bias=-0.5, far_biases=0.0, filter_value=0.01)


@query("SELECT * FROM (VALUES ('a', 177, 200, 200, 50), ('b', 7, 8, 8, 2), ('c', 7, 9, 11, 2), ('d', 4, 4, 4, 1)) t(name, z, y, x, factor)")
def voxel_frame_scaling(s, d):
    sizes = {"a": (3.54, 4, 4), "b": (3.5, 4, 4), "c": (3.5, 4.5, 5.5), "d": (4, 4, 4)}
    rows = [(k, *scaled_to_integers(v)[0], scaled_to_integers(v)[1]) for k, v in sizes.items()]
    return s.createDataFrame(rows, "name string, z int, y int, x int, factor int")


assert math.isclose(sum(morphology.gaussian_weights(1.0)), 1.0)
