"""Chunked volumes on disk as voxel tables: Zarr v2 and v3 (sharded too), N5 and precomputed.

Metadata is read once on the driver.  Chunks are files: Spark's ``binaryFile`` source lists and reads them,
so a volume can lie in any store that Spark reaches, each chunk is one row, and a kernel decodes it.  With
a region of interest only the files of its chunks are listed and read.  Labels are signed 64-bit numbers;
larger ids raise.  A fill value other than 0 raises, as chunks that are not there would have to be made.
"""

from __future__ import annotations

import gzip
import json
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.arrow import runs
from voxloom.frame import Frame, Roi
from voxloom.operators.blocks import ZYX
from voxloom.sources import codecs


@dataclass(frozen=True)
class Layout:
    """How a volume's chunks are stored; shape and chunks are in storage order."""

    kind: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    codec: str
    order: str
    pattern: str
    frame: Frame
    reversed_axes: bool = False
    fill: float = 0
    #: shape of the inner chunks of a shard, whether its index has a checksum, whether it stands first
    inner: tuple[tuple[int, ...], bool, bool] | None = None
    #: block of a compressed segmentation
    segments: tuple[int, int, int] | None = None


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file by Spark's file systems, or None."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return None
    stream = files.open(place)  # not spark.read: it skips names that begin with a dot
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _json(spark: SparkSession, path: str) -> dict | None:
    text = read_text(spark, path)
    return None if text is None else json.loads(text)


def voxel_size_and_centre(level: str, own: dict, group: dict | None) -> tuple[tuple, tuple]:
    """Voxel size and centre of voxel 0: of the OME entry of this level, else of the array's own attributes, else 1 and 0.

    Both may be there if they agree.
    """
    size = centre = None
    entries = ((group or {}).get("multiscales") or ((group or {}).get("ome") or {}).get("multiscales") or [{}])[0].get("datasets", [])
    for entry in entries:
        if entry.get("path", "").strip("/").split("/")[-1] == level:
            for t in entry.get("coordinateTransformations", []):
                if t["type"] == "scale":
                    size = tuple(map(float, t["scale"][-3:]))
                elif t["type"] == "translation":
                    centre = tuple(map(float, t["translation"][-3:]))
    for name, ours, theirs in (("voxel_size", size, own.get("voxel_size")), ("offset", centre, own.get("offset"))):
        if ours is not None and theirs is not None and not np.allclose(ours, theirs, atol=1e-6):
            raise ValueError(f"{name} {theirs} of the array contradicts {ours} of its group")
    size = size or tuple(map(float, own.get("voxel_size", ()))) or None
    if size is None and (resolution := own.get("pixelResolution")):
        size = tuple(map(float, (resolution["dimensions"] if isinstance(resolution, dict) else resolution)[::-1]))
    centre = centre or tuple(map(float, own.get("offset", (0.0, 0.0, 0.0))))
    return size or (1.0, 1.0, 1.0), centre


def open_volume(spark: SparkSession, path: str, scale: str | None = None) -> Layout:
    """The layout of the volume at ``path``, by its metadata files; unknown codecs raise."""
    path = path.removeprefix("precomputed://").rstrip("/")
    parent, level = path.rsplit("/", 1)
    if (info := _json(spark, f"{path}/info") or None) is not None:
        return _precomputed(info, scale)
    if (info := _json(spark, f"{parent}/info") or None) is not None and any(s["key"] == level for s in info.get("scales", [])):
        return _precomputed(info, level)
    if (meta := _json(spark, f"{path}/zarr.json")) is not None:
        group = (_json(spark, f"{parent}/zarr.json") or {}).get("attributes")
        size, centre = voxel_size_and_centre(level, meta.get("attributes", {}), group)
        steps, inner = meta["codecs"], None
        if steps and steps[0]["name"] == "sharding_indexed":
            shard = steps[0]["configuration"]
            inner = tuple(shard["chunk_shape"]), any(c["name"] == "crc32c" for c in shard["index_codecs"]), shard.get("index_location", "end") == "start"
            steps = shard["codecs"]
        names = [c["name"] for c in steps if c["name"] not in ("bytes", "crc32c")]
        codec = names[0] if names else "raw"
        separator = meta.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
        numbers = re.escape(separator).join([r"(\d+)"] * len(meta["shape"]))
        chunks = tuple(meta["chunk_grid"]["configuration"]["chunk_shape"])
        dtype = np.dtype(meta["data_type"]).newbyteorder("<").str
        return _checked(Layout("zarr3", tuple(meta["shape"]), chunks, dtype, codec, "C", f"/c{re.escape(separator)}{numbers}$", Frame.from_centre(size, tuple(meta["shape"][-3:]), centre), fill=meta.get("fill_value") or 0, inner=inner))
    if (meta := _json(spark, f"{path}/.zarray")) is not None:
        size, centre = voxel_size_and_centre(level, _json(spark, f"{path}/.zattrs") or {}, _json(spark, f"{parent}/.zattrs"))
        codec = (meta.get("compressor") or {}).get("id", "raw")
        numbers = re.escape(meta.get("dimension_separator", ".")).join([r"(\d+)"] * len(meta["shape"]))
        return _checked(Layout("zarr2", tuple(meta["shape"]), tuple(meta["chunks"]), meta["dtype"], codec, meta.get("order", "C"), f"/{numbers}$", Frame.from_centre(size, tuple(meta["shape"][-3:]), centre), fill=meta.get("fill_value") or 0))
    if (meta := _json(spark, f"{path}/attributes.json")) is not None:
        size, centre = voxel_size_and_centre(level, meta, _json(spark, f"{parent}/attributes.json"))
        shape = tuple(meta["dimensions"])
        codec = (meta.get("compression") or {}).get("type", "raw")
        return _checked(Layout("n5", shape, tuple(meta["blockSize"]), ">" + np.dtype(meta["dataType"]).str[1:], codec, "F", "/" + "/".join([r"(\d+)"] * len(shape)) + "$", Frame.from_centre(size, shape[::-1], centre), True))
    raise FileNotFoundError(f"no volume metadata at {path}")


def _precomputed(info: dict, scale: str | None) -> Layout:
    scales = info["scales"]
    if scale is not None and scale not in [s["key"] for s in scales]:
        raise ValueError(f"no scale {scale}")
    own = next((s for s in scales if s["key"] == scale), scales[0])
    shape = tuple(own["size"])
    corner = tuple(v * r for v, r in zip(own.get("voxel_offset", (0, 0, 0)), own["resolution"], strict=True))
    frame = Frame(tuple(map(float, own["resolution"][::-1])), shape[::-1], tuple(map(float, corner[::-1])))
    return _checked(Layout("precomputed", shape, tuple(own["chunk_sizes"][0]), np.dtype(info["data_type"]).newbyteorder("<").str, own["encoding"] if own["encoding"] != "compressed_segmentation" else "raw", "F", rf"/{re.escape(own['key'])}/(\d+)-\d+_(\d+)-\d+_(\d+)-\d+$", frame, True, segments=tuple(own["compressed_segmentation_block_size"]) if own["encoding"] == "compressed_segmentation" else None))


def _checked(layout: Layout) -> Layout:
    if layout.codec not in codecs.DECODERS:
        raise ValueError(f"chunks are compressed by {layout.codec}; read are {', '.join(codecs.DECODERS)}")
    if layout.fill:
        raise ValueError(f"the fill value is {layout.fill}; only 0 is read")
    return layout


def decoded(layout: Layout, data: bytes) -> np.ndarray:
    """One chunk's values in storage order."""
    shape = layout.chunks
    if layout.segments:
        return codecs.compressed_segmentation(data, shape[:3], layout.segments, np.dtype(layout.dtype).itemsize == 8)
    if layout.inner:
        inner, checked, at_start = layout.inner
        grid = tuple(n // i for n, i in zip(shape, inner, strict=True))
        out, plain = np.zeros(shape, layout.dtype), Layout(**{**layout.__dict__, "chunks": inner, "inner": None})
        for at, part in zip(np.ndindex(grid), codecs.inner_chunks(data, math.prod(grid), checked, at_start), strict=True):
            if part is not None:
                out[tuple(slice(i * n, (i + 1) * n) for i, n in zip(at, inner, strict=True))] = decoded(plain, part)
        return out
    if layout.kind == "n5":
        mode, n = int.from_bytes(data[:2], "big"), int.from_bytes(data[2:4], "big")
        shape = tuple(int.from_bytes(data[4 + 4 * i : 8 + 4 * i], "big") for i in range(n))
        data = data[4 + 4 * n + (4 if mode == 1 else 0) :]
    values = np.frombuffer(codecs.DECODERS[layout.codec](data), layout.dtype)
    if len(values) != math.prod(shape):
        raise ValueError(f"a chunk holds {len(values)} values, not {shape}")
    return values.reshape(shape, order=layout.order)


def _chunk_glob(layout: Layout, root: str, roi: Roi) -> str:
    """A pattern of the files of the chunks that meet ``roi``, for file systems to list."""
    low, high = ([*v[::-1]] if layout.reversed_axes else [*v] for v in (roi.begin, roi.end))
    names = []
    for n, c, a, b in zip(layout.shape[-3:] if not layout.reversed_axes else layout.shape[:3], layout.chunks[-3:] if not layout.reversed_axes else layout.chunks[:3], low, high, strict=True):
        own = range(max(0, a) // c, -(-min(n, b) // c))
        if layout.kind == "precomputed":
            corner = int(round(layout.frame.corner[2 - len(names)] / layout.frame.voxel[2 - len(names)]))
            names.append("{" + ",".join(f"{corner + k * c}-{corner + min(n, (k + 1) * c)}" for k in own) + "}")
        else:
            names.append("{" + ",".join(map(str, own)) + "}")
    every = ["*"] * (len(layout.shape) - 3) if layout.kind != "precomputed" else []
    parts = [*names, *every] if layout.reversed_axes else [*every, *names]
    if layout.kind == "precomputed":
        return f"{root}/" + "_".join(parts)
    if layout.kind == "n5":
        return f"{root}/" + "/".join(parts)
    separator = "." if r"\." in layout.pattern else "/"
    return f"{root}/" + ("c" + separator if layout.kind == "zarr3" else "") + separator.join(parts)


def read_volume(spark: SparkSession, path: str, column: str = "label", scale: str | None = None, roi: Roi | None = None, background: float | None = 0) -> tuple[DataFrame, Layout]:
    """The voxels (z, y, x, column) that are not ``background`` (None: all that are stored), and the layout; 4-D volumes add ``channel``.

    With ``roi`` (in voxels) only the chunks that meet it are listed and read, and only its voxels returned.
    """
    layout = open_volume(spark, path, scale)
    root = path.removeprefix("precomputed://").rstrip("/")
    if layout.kind == "precomputed":
        key = layout.pattern.split("/(")[0].replace("\\", "").strip("/")
        root = root if root.endswith("/" + key) else f"{root}/{key}"
    number = "double" if np.dtype(layout.dtype).kind == "f" else "long"
    wide = len(layout.shape) == 4 and layout.kind != "precomputed"
    schema = f"{'channel int, ' if wide else ''}z int, y int, x int, {column} {number}"
    place = root
    if roi is not None:
        place = _chunk_glob(layout, root, roi.intersect(Roi((0, 0, 0), layout.frame.shape)))
        pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) if "{}" not in place else []
        if not len(found):
            return spark.createDataFrame([], schema), layout
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(place).select("path", "content").where(F.col("path").rlike(layout.pattern))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                numbers = [int(v) for v in re.search(layout.pattern, name).groups()]
                start = numbers if layout.kind == "precomputed" else [p * c for p, c in zip(numbers, layout.chunks, strict=True)]
                own = layout
                if layout.kind == "precomputed":
                    start = [s - int(round(o / v)) for s, o, v in zip(start, layout.frame.corner[::-1], layout.frame.voxel[::-1], strict=True)]
                    own = Layout(**{**layout.__dict__, "chunks": tuple(min(c, n - s) for c, n, s in zip(layout.chunks, layout.shape, start, strict=True))})
                values = decoded(own, content)
                inside = tuple(slice(0, max(0, n - s)) for n, s in zip(layout.shape, start, strict=True))
                values = values[inside]
                if values.dtype.kind == "u" and values.dtype.itemsize == 8 and values.size and values.max() >= 2**63:
                    raise ValueError(f"{name} holds ids beyond 2**63 - 1")
                at = np.argwhere(np.ones(values.shape, bool) if background is None else values != background)
                found = values[tuple(at.T)].astype(np.float64 if number == "double" else np.int64)
                at = (at + start).astype(np.int32)
                if layout.reversed_axes:
                    at = at[:, ::-1]
                if roi is not None:
                    keep = ((at[:, -3:] >= roi.begin) & (at[:, -3:] < roi.end)).all(1)
                    at, found = at[keep], found[keep]
                columns = [pa.array(np.ascontiguousarray(at[:, i])) for i in range(at.shape[1])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], names=[*(["channel"] if wide else []), *ZYX, column])

    return files.mapInArrow(cut, schema), layout


def ome_metadata(name: str, frame: Frame, levels: int = 1) -> dict:
    """OME-NGFF 0.4 multiscales: level n has twice the voxel size of the one before, and its centre accordingly."""
    datasets = []
    for n in range(levels):
        scale = [v * 2**n for v in frame.voxel]
        shift = [c + v * (2**n - 1) / 2 for c, v in zip(frame.centre, frame.voxel, strict=True)]
        datasets.append({"path": f"s{n}", "coordinateTransformations": [{"type": "scale", "scale": scale}, {"type": "translation", "translation": shift}]})
    axes = [{"name": a, "type": "space", "unit": "nanometer"} for a in ZYX]
    return {"multiscales": [{"version": "0.4", "name": name, "axes": axes, "datasets": datasets, "coordinateTransformations": [{"type": "scale", "scale": [1.0, 1.0, 1.0]}]}]}


def _store(path: str):
    """The file system (local, S3, GCS, HDFS) and the place in it; executors and the driver open their own."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def put(path: str, data: bytes) -> None:
    """Write a file under a name of its own and rename it, so that a task that runs again does no harm."""
    files, place = _store(path)
    folder, name = place.rsplit("/", 1)
    files.create_dir(folder, recursive=True)
    part = f"{folder}/.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, f"{folder}/{name}")


def got(path: str) -> bytes | None:
    files, place = _store(path)
    try:
        with files.open_input_stream(place) as source:
            return source.read()
    except FileNotFoundError:
        return None


def write_zarr(voxels: DataFrame, frame: Frame, path: str, chunks: tuple[int, int, int] = (64, 64, 64), dtype: str = "<u8", column: str = "label", roi: Roi | None = None) -> None:
    """A Zarr v2 array (gzip chunks) in a shared store: chunks are made and written by the executors.

    With ``roi`` an array that is there keeps what lies outside it; inside, it becomes ``voxels``.
    """
    _, ny, nx = frame.blocks(chunks)
    spark = voxels.sparkSession
    meta = {"zarr_format": 2, "shape": list(frame.shape), "chunks": list(chunks), "dtype": dtype, "compressor": {"id": "gzip", "level": 1}, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": "/"}
    if roi is None or got(f"{path}/.zarray") is None:
        put(f"{path}/.zarray", json.dumps(meta).encode())
        put(f"{path}/.zattrs", json.dumps({"voxel_size": list(frame.voxel), "offset": list(frame.centre)}).encode())
    block = sum((F.floor(F.col(c) / k) * n for c, k, n in zip(ZYX, chunks, (ny * nx, nx, 1), strict=True)), F.lit(0)).cast("long")
    rows = voxels.select(block.alias("block"), *ZYX, F.col(column).alias("value"))
    if roi is not None:
        for c, b, e in zip(ZYX, roi.begin, roi.end, strict=True):
            rows = rows.where((F.col(c) >= b) & (F.col(c) < e))
        first, last = roi.begin, [e - 1 for e in roi.end]  # chunks that lose voxels but get none have a row too
        asked = spark.range(1).select(*(F.explode(F.sequence(F.lit(a // k), F.lit(b // k))).alias(c) if c == "z" else F.sequence(F.lit(a // k), F.lit(b // k)).alias(c) for c, a, b, k in zip(ZYX, first, last, chunks, strict=True)))
        asked = asked.select("z", F.explode("y").alias("y"), "x").select("z", "y", F.explode("x").alias("x"))
        rows = rows.union(asked.select(((F.col("z") * ny + F.col("y")) * nx + F.col("x")).cast("long"), *((F.col(c) * k).cast("int") for c, k in zip(ZYX, chunks, strict=True)), F.lit(None).cast(rows.schema["value"].dataType)))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["block"]):
            index = int(table.column("block")[0].as_py())
            at = index // (ny * nx), index // nx % ny, index % nx
            dense = np.zeros(chunks, dtype)
            name = f"{path}/{at[0]}/{at[1]}/{at[2]}"
            if roi is not None and (old := got(name)) is not None:
                dense = np.frombuffer(gzip.decompress(old), dtype).reshape(chunks).copy()
                dense[tuple(slice(max(0, b - a * k), max(0, e - a * k)) for a, k, b, e in zip(at, chunks, roi.begin, roi.end, strict=True))] = 0
            table = table.filter(table.column("value").is_valid())
            points = np.stack([table.column(c).to_numpy() for c in ZYX], 1) - np.array(at) * chunks
            dense[tuple(points.T)] = table.column("value").to_numpy()
            put(name, gzip.compress(dense.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array([index])], names=["block"])

    rows.repartition("block").sortWithinPartitions("block").mapInArrow(stored, "block long").count()


def write_multiscale(voxels: DataFrame, frame: Frame, path: str, name: str, levels: int = 1, chunks: tuple[int, int, int] = (64, 64, 64), dtype: str = "<u8", column: str = "label") -> None:
    """A group of Zarr arrays s0, s1, ..., each of every second voxel of the one before, with OME metadata."""
    put(f"{path}/.zgroup", json.dumps({"zarr_format": 2}).encode())
    put(f"{path}/.zattrs", json.dumps(ome_metadata(name, frame, levels)).encode())
    for n in range(levels):
        write_zarr(voxels, frame, f"{path}/s{n}", chunks, dtype, column)
        if n + 1 < levels:
            keep = F.lit(True)
            for c in ZYX:
                keep = keep & (F.col(c) % 2 == 0)
            voxels = voxels.where(keep).select(*((F.col(c) / 2).cast("int").alias(c) for c in ZYX), column)
            frame = Frame(tuple(2 * v for v in frame.voxel), tuple(-(-s // 2) for s in frame.shape), frame.corner)


# --- object tables -----------------------------------------------------------------------------


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """An object table; with a column "Total Objects" the last two columns are summary and go."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.drop(*df.columns[-2:]) if "Total Objects" in df.columns else df


def write_objects(df: DataFrame, path: str) -> None:
    """A folder of CSV files, sorted by Object ID; arrays as JSON text."""
    arrays = {f.name for f in df.schema if f.dataType.typeName() == "array"}
    df.select(*(F.to_json(F.col(f"`{c}`")).alias(c) if c in arrays else F.col(f"`{c}`") for c in df.columns)).orderBy("Object ID").write.mode("overwrite").csv(path, header=True)
