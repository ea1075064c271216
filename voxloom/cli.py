"""Command line: ``python -m voxloom.cli TOOL CONFIG`` runs one tool on volumes on disk.

The configuration (JSON, or YAML where PyYAML is there) holds the tool's keys: paths of volumes (Zarr, N5,
precomputed), ``roi`` in voxels ("z0:z1", "y0:y1", "x0:x1"), and the parameters that each tool reads below.  A
tool that makes a volume writes a Zarr group with OME metadata and its level s0 where ``output_path`` lies in
a .zarr container (by default the input's, with a suffix), else a Parquet table of voxels.  Tables are
written as folders of CSV files, sorted by Object ID.  ``num_workers``, ``delete_tmp`` and the keys of memory
and retries are Spark's own concern here and are accepted without effect.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.frame import Frame, Roi
from voxloom.functions import paths
from voxloom.operators import assign, components, measure, morphology, objects, voxels
from voxloom.operators.voxels import ZYX
from voxloom.session import durable
from voxloom.sources import shards, volumes

Tool = Callable[[SparkSession, dict], DataFrame]
INFINITE = float("inf")


# --- inputs and outputs ------------------------------------------------------------------------


def load(path: str) -> dict:
    with open(path) as source:
        if path.endswith((".yml", ".yaml")):
            import yaml

            return yaml.safe_load(source)
        return json.load(source)


def _roi(config: dict) -> Roi | None:
    return Roi.parse(config["roi"]) if config.get("roi") else None


def _volume(spark: SparkSession, config: dict, key: str = "input_path", column: str = "label", background: float | None = 0) -> tuple[DataFrame, Frame]:
    df, layout = volumes.read_volume(spark, config[key], column, roi=_roi(config), background=background)
    return df, layout.frame


def _bounds(config: dict, frame: Frame) -> tuple[float, float]:
    return components.voxel_bounds(frame, config.get("minimum_volume_nm_3", 0), config.get("maximum_volume_nm_3", INFINITE))


def masks(spark: SparkSession, config: dict, frame: Frame) -> list[tuple[DataFrame, bool]]:
    """(mask, inclusive) of each entry of ``mask_config``: path, mask_type, operation and iterations (one or lists), mask_value.

    Masks of another voxel size are resampled to ``frame``.
    """
    out = []
    for own in (config.get("mask_config") or {}).values():
        kind = own.get("mask_type", "exclusive")
        steps, rounds = ([v] if isinstance(v, (str, int)) else list(v) for v in (own.get("operation", "simple"), own.get("iterations", 0)))
        if kind not in ("inclusive", "exclusive") or len(steps) != len(rounds) or any((s == "simple") != (n == 0) for s, n in zip(steps, rounds, strict=True)):
            raise ValueError(f"a mask is inclusive or exclusive, and each operation but simple has iterations: {own}")
        mask, layout = volumes.read_volume(spark, own["path"])
        if own.get("mask_value") is not None:
            mask = mask.where(F.col("label") == own["mask_value"])
        if not np.allclose(layout.frame.voxel, frame.voxel):
            mask = morphology.resampled(mask, layout.frame, frame.voxel)
        listed = [(s, n) for s, n in zip(steps, rounds, strict=True) if s != "simple"]
        if listed:
            mask = morphology.mask_operations(mask, frame, listed, connectivity=config.get("mask_connectivity", config.get("connectivity", 2)))
        out.append((mask, kind == "inclusive"))
    return out


def _clean(spark: SparkSession, config: dict, frame: Frame) -> Callable[[DataFrame], DataFrame]:
    known = masks(spark, config, frame)
    return lambda df: voxels.masked(df, *known) if known else df


def _written(spark: SparkSession, out: DataFrame, frame: Frame, config: dict, suffix: str | None = None, source: str = "input_path") -> DataFrame:
    """``out`` written to ``output_path``; returned as it was written."""
    path = config.get("output_path") or paths.output_path(config[source], suffix)
    path = path.rstrip("/")
    if ".zarr" not in path:
        out.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    out = durable(out)
    most = out.agg(F.max("label")).first()[0] or 0
    dtype = np.min_scalar_type(int(most)).newbyteorder("<").str
    volumes.write_multiscale(out, frame, path, paths.leaf_name(path), config.get("levels", 1), tuple(config.get("chunk_shape") or (64, 64, 64)), dtype)
    return out


# --- tools -------------------------------------------------------------------------------------


def connected_components(spark: SparkSession, c: dict) -> DataFrame:
    connectivity, binarize = c.get("connectivity", 2), c.get("binarize", True)
    raw, frame = _volume(spark, c, column="value", background=None)
    raw = raw.withColumn("value", F.col("value").cast("double")) if c.get("gaussian_smoothing_sigma_nm") else raw
    if c.get("gaussian_smoothing_sigma_nm"):
        raw = morphology.gaussian(raw, frame, c["gaussian_smoothing_sigma_nm"])
    kept = voxels.threshold(raw, "value", c.get("intensity_threshold_minimum", -1), c.get("intensity_threshold_maximum", INFINITE))
    kept = kept.select(*ZYX, F.lit(1).cast("long").alias("label") if binarize else F.col("value").cast("long").alias("label")).where("label != 0")
    if c.get("invert"):
        kept = voxels.inverted(raw.where("value != 0"), frame)
    clean = _clean(spark, c, frame)
    kept = clean(kept)
    if c.get("deduplicate_ids"):
        out = components.deduplicate_ids(clean(raw.where("value != 0").select(*ZYX, F.col("value").cast("long").alias("label"))), frame, connectivity)
    elif c.get("object_labels_path"):
        out = components.components_within(kept, volumes.read_volume(spark, c["object_labels_path"])[0], frame, connectivity)
    else:
        out = components.connected_components(kept, frame, connectivity, not binarize, *_bounds(c, frame))
    if c.get("fill_holes"):
        out = clean(components.fill_holes(out, frame, connectivity))
    return _written(spark, out, frame, c, "_cc")


def clean_connected_components(spark: SparkSession, c: dict) -> DataFrame:
    labels, frame = _volume(spark, c)
    clean = _clean(spark, c, frame)
    out = components.clean_components(clean(labels), frame, *_bounds(c, frame))
    if c.get("fill_holes"):
        out = clean(components.fill_holes(out, frame, c.get("connectivity", 2)))
    return _written(spark, out, frame, c, "_cleaned")


def contact_sites(spark: SparkSession, c: dict) -> DataFrame:
    (a, frame), (b, _) = _volume(spark, c, "organelle_1_path"), _volume(spark, c, "organelle_2_path")
    return _written(spark, assign.contact_sites(a, b, frame, c.get("contact_distance_nm", 30), c.get("minimum_volume_nm_3")), frame, c, "_contacts", "organelle_1_path")


#: The default neighbourhood: the three faces, and offsets of 3 and 9 voxels along each axis.
NEIGHBOURHOOD = [tuple(n if a == axis else 0 for a in range(3)) for n in (1, 3, 9) for axis in range(3)]


def mutex_watershed(spark: SparkSession, c: dict) -> DataFrame:
    """affinities_path: one array of four axes, or a list of arrays of three."""
    near = [tuple(map(int, o)) for o in c.get("neighborhood", NEIGHBOURHOOD)]
    listed = isinstance(c["affinities_path"], list)
    parts = [volumes.read_volume(spark, p, "value", roi=_roi(c)) for p in (c["affinities_path"] if listed else [c["affinities_path"]])]
    layout = parts[0][1]
    rows = None
    for k, (df, _) in enumerate(parts):
        df = df.withColumn("channel", F.lit(k)) if listed else df
        rows = df if rows is None else rows.unionByName(df)
    scale = 255.0 if np.dtype(layout.dtype) == np.uint8 else 1.0
    values = F.map_from_entries(F.collect_list(F.struct("channel", F.col("value").cast("double"))))
    affinities = rows.groupBy(*ZYX).agg(values.alias("v")).select(*ZYX, F.transform(F.sequence(F.lit(0), F.lit(len(near) - 1)), lambda k: F.coalesce(F.col("v")[k], F.lit(0.0)) / scale).alias("affs"))
    clean = _clean(spark, c, layout.frame)
    far = c["lr_biases"] if c.get("lr_biases") is not None else c.get("lr_bias_ratio", -0.6)
    options = {"adjacent_bias": c.get("adjacent_edge_bias", -0.4), "far_biases": far, "filter_value": c.get("filter_val", 0.5), "noise": c.get("noise", 1e-4), "seed": c.get("seed", 0)}
    least, most = _bounds(c, layout.frame)
    out = objects.watershed(clean(affinities), layout.frame, near, tuple(c.get("chunk_shape") or (64, 64, 64)), c.get("connectivity", 2), c.get("do_opening", False), least, most, c.get("padding_voxels"), holes=c.get("fill_holes", False), **options)
    return _written(spark, clean(out), layout.frame, c, "_mws", "affinities_path")


def morphological_operations(spark: SparkSession, c: dict) -> DataFrame:
    """Masks are applied before and after; ``connectivity`` shapes the masks, labels erode and dilate by all 26 neighbours."""
    labels, frame = _volume(spark, c)
    clean = _clean(spark, c, frame)
    operation = {"erosion": morphology.erode, "dilation": morphology.dilate}[c.get("operation", "erosion")]
    return _written(spark, clean(operation(clean(labels), frame, c.get("iterations", 1), 3)), frame, c, "_" + c.get("operation", "erosion"))


def fill_holes(spark: SparkSession, c: dict) -> DataFrame:
    labels, frame = _volume(spark, c)
    return _written(spark, components.fill_holes(labels, frame, c.get("connectivity", 2)), frame, c, "_filled")


def _ids(spark: SparkSession, value: str | list | None) -> str | list | DataFrame | None:
    return volumes.read_objects(spark, value) if isinstance(value, str) and value.endswith(".csv") else value


def filter_ids(spark: SparkSession, c: dict) -> DataFrame:
    labels, frame = _volume(spark, c)
    return _written(spark, voxels.filter_ids(labels, _ids(spark, c.get("ids_to_keep")), _ids(spark, c.get("ids_to_remove")), c.get("binarize", False)), frame, c, "_filteredIDs")


def label_with_mask(spark: SparkSession, c: dict) -> DataFrame:
    raw, frame = _volume(spark, c, column="value", background=None)
    mask, _ = volumes.read_volume(spark, c["mask_path"])
    out = voxels.label_with_mask(raw, "value", mask, c.get("intensity_threshold_minimum", -1), c.get("intensity_threshold_maximum", INFINITE), c.get("surface_voxels_only", False))
    return _written(spark, out, frame, c, "_labeled")


def measures(spark: SparkSession, c: dict) -> DataFrame:
    labels, frame = _volume(spark, c)
    raw = volumes.read_volume(spark, c["raw_path"], "value", background=None)[0] if c.get("raw_path") else None
    organelles = {paths.leaf_name(c[k]) or k.removesuffix("_path"): volumes.read_volume(spark, c[k])[0] for k in ("organelle_1_path", "organelle_2_path") if c.get(k)} or None
    out = measure.object_table(measure.measure(labels, frame, raw, organelles))
    volumes.write_objects(out, f"{c['output_path'].rstrip('/')}/{paths.leaf_name(c['input_path']) or 'measurements'}.csv")
    return out


def fit_lines_to_segmentations(spark: SparkSession, c: dict) -> DataFrame:
    """The objects of ``input_csv`` with their lines; without it, lines of all objects."""
    labels, frame = _volume(spark, c)
    lines = durable(objects.fit_lines(labels, frame))
    named = lines.select(F.col("label").alias("Object ID"), *(F.col(f"{e}_{a}").alias(f"Line {e.title()} {a.upper()} (nm)") for e in ("start", "end") for a in "zyx"))
    if c.get("input_csv"):
        rows = volumes.read_objects(spark, c["input_csv"])
        named = rows.withColumn("Object ID", F.col("Object ID").cast("long")).join(named, "Object ID", "left")
        lines = lines.join(rows.select(F.col("Object ID").cast("long").alias("label")), "label", "left_semi")
    volumes.write_objects(named, c.get("output_csv") or c.get("input_csv", "objects.csv").removesuffix(".csv") + "_lines.csv")
    if c.get("output_annotations_dir"):
        shards.write_annotations(lines, c["output_annotations_dir"].rstrip("/"))
    return named


def assign_to_organelles(spark: SparkSession, c: dict) -> DataFrame:
    """Each table of ``organelle_csvs`` with the ids (and distances) of the containing or the n nearest organelles."""
    organelles, frame = _volume(spark, c, "target_organelle_ds_path")
    name, n, out = paths.leaf_name(c["target_organelle_ds_path"]), c.get("assignment_type", 0), None
    for csv in [c["organelle_csvs"]] if isinstance(c["organelle_csvs"], str) else c["organelle_csvs"]:
        rows = volumes.read_objects(spark, csv).withColumn("Object ID", F.col("Object ID").cast("long"))
        points = rows.select(F.col("Object ID").alias("id"), *(F.col(f"COM {a.upper()} (nm)").alias(f"com_{a}") for a in "zyx"))
        if n == 0:
            found = assign.assign_containing(points, organelles, frame).select("id", F.col("organelle").cast("long").alias(f"{name} ID"))
        else:
            found = assign.nearest_arrays(assign.assign_nearest(points, organelles, frame, n), name)
            if n == 1:
                found = found.select("id", *(F.col(f"{name} {v}")[0].alias(f"{name} {v}") for v in ("ID", "Distance (nm)")))
        out = rows.join(found.withColumnRenamed("id", "Object ID"), "Object ID", "left")
        suffix = f"containing_{name.lower()}" if n == 0 else f"nearest_{name.lower()}" if n == 1 else f"{n}_nearest_{name.lower()}s"
        stem = csv.rstrip("/").rsplit("/", 1)[-1].removesuffix(".csv")
        folder = c["output_path"].rstrip("/") + ("/contact_sites" if stem.endswith("contacts") else "")
        volumes.write_objects(out, f"{folder}/{stem}_assigned_to_{suffix}.csv")
    return out


def skeletonize(spark: SparkSession, c: dict) -> DataFrame:
    labels, frame = _volume(spark, c, "segmentation_path")
    rows = volumes.read_objects(spark, c["csv_path"]) if c.get("csv_path") else None
    if rows is not None:
        labels = labels.join(rows.select(F.col("Object ID").cast("long").alias("label")), "label", "left_semi")
    out = durable(objects.skeletonize(labels, frame, c.get("erosion", True), c.get("min_branch_length_nm", 100), c.get("tolerance_nm", 50)))
    sharding = shards.Sharding(0, c.get("shard_bits", 1), c.get("minishard_bits", 6)) if c.get("sharded", True) else None
    asked = c.get("skeleton_properties", True)
    names = ("num_branches", "longest_shortest_path_nm") if asked is True else tuple(shards.METRICS) if asked == "all" else tuple(asked or ())
    shards.write_skeletons(out, c["output_path"].rstrip("/"), sharding, names)
    if rows is not None:
        titles = {"longest_path": "Longest Shortest Path (nm)", "branches": "Number of Branches", "radius_mean": "Radius Mean (nm)", "radius_std": "Radius Std (nm)"}
        metrics = out.select(F.col("label").alias("Object ID"), *(F.when(~F.isnan(F.col(k).cast("double")), F.col(k)).alias(v) for k, v in titles.items()))
        joined = rows.withColumn("Object ID", F.col("Object ID").cast("long")).join(metrics, "Object ID", "left")
        volumes.write_objects(joined, c["csv_path"].rstrip("/").removesuffix(".csv") + "_with_skeletons.csv")
    return out


_VOLUME_TOOLS = (connected_components, clean_connected_components, contact_sites, mutex_watershed, morphological_operations, fill_holes, filter_ids, label_with_mask)
TOOLS: dict[str, Tool] = {f.__name__.replace("_", "-"): f for f in (*_VOLUME_TOOLS, fit_lines_to_segmentations, assign_to_organelles, skeletonize)} | {"measure": measures}


def main(arguments: list[str]) -> None:
    if len(arguments) != 2 or arguments[0] not in TOOLS:
        sys.exit(f"usage: python -m voxloom.cli TOOL CONFIG\ntools: {', '.join(TOOLS)}")
    TOOLS[arguments[0]](SparkSession.builder.appName(arguments[0]).getOrCreate(), load(arguments[1]))


if __name__ == "__main__":
    main(sys.argv[1:])
