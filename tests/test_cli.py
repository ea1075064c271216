"""Every tool of the command line on small volumes, and the formats that they read and write."""

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from voxloom import cli
from voxloom.frame import Frame, Roi
from voxloom.functions import paths
from voxloom.operators import objects, voxels
from voxloom.sources import codecs, shards, volumes

VOXEL = (4.0, 4.0, 4.0)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Two boxes (one hollow), a rod, and a raw volume."""
    folder = str(tmp_path_factory.mktemp("world"))
    labels = np.zeros((20, 18, 16), np.int64)
    labels[2:9, 2:9, 2:9], labels[4:6, 4:6, 4:6] = 1, 0
    labels[12:16, 3:8, 3:8] = 2
    labels[3:17, 14, 12] = 5
    raw = np.arange(labels.size).reshape(labels.shape) % 97
    frame = Frame(VOXEL, labels.shape)
    volumes.write_multiscale(voxels.from_array(spark, labels), frame, f"{folder}/in.zarr/cells", "cells", 2, (8, 8, 8), "<u2")
    volumes.write_zarr(voxels.from_array(spark, raw, "value"), frame, f"{folder}/raw.zarr/s0", (8, 8, 8), "<u1", "value")
    return folder, labels, raw, frame


def result(spark, path, shape):
    df, layout = volumes.read_volume(spark, path)
    return voxels.to_array(df, shape), layout


def test_multiscale_metadata(spark, world):
    folder, labels, _, frame = world
    level, layout = result(spark, f"{folder}/in.zarr/cells/s1", (10, 9, 8))
    assert (level == labels[::2, ::2, ::2]).all() and layout.frame.voxel == (8.0, 8.0, 8.0) and layout.frame.corner == frame.corner
    assert json.loads(volumes.got(f"{folder}/in.zarr/cells/.zattrs"))["multiscales"][0]["datasets"][1]["path"] == "s1"


def test_connected_components(spark, world):
    folder, labels, raw, frame = world
    cli.connected_components(spark, {"input_path": f"{folder}/in.zarr/cells/s0", "output_path": f"{folder}/out.zarr/cc", "intensity_threshold_minimum": 1, "minimum_volume_nm_3": 20 * 64, "fill_holes": True})
    got, layout = result(spark, f"{folder}/out.zarr/cc/s0", labels.shape)
    expected = np.zeros_like(labels)
    expected[2:9, 2:9, 2:9], expected[12:16, 3:8, 3:8] = 1, 2
    assert (got == expected).all() and layout.dtype == "|u1" and layout.frame.voxel == VOXEL
    masked = {"input_path": f"{folder}/raw.zarr/s0", "output_path": f"{folder}/table", "intensity_threshold_minimum": 40, "intensity_threshold_maximum": 60, "roi": ["2:18", "0:18", "1:16"]}
    masked["mask_config"] = {"in": {"path": f"{folder}/in.zarr/cells/s0", "mask_type": "inclusive", "operation": ["dilation", "erosion"], "iterations": [1, 1], "mask_value": 1}, "not": {"path": f"{folder}/in.zarr/cells/s0", "mask_value": 2}}
    out = voxels.to_array(cli.connected_components(spark, masked), labels.shape)
    solid = np.zeros(labels.shape, bool)
    solid[2:9, 2:9, 2:9] = True  # closing fills the hole of two voxels
    wanted = (raw >= 40) & (raw < 60) & solid
    wanted[:2] = wanted[18:] = False
    wanted[:, :, :1] = False
    assert ((out > 0) == wanted).all()
    inside = cli.connected_components(spark, {"input_path": f"{folder}/in.zarr/cells/s0", "output_path": f"{folder}/table2", "intensity_threshold_minimum": 1, "object_labels_path": f"{folder}/in.zarr/cells/s0"})
    assert inside.select("label").distinct().count() == 3
    with pytest.raises(ValueError):
        cli.masks(spark, {"mask_config": {"m": {"path": "x", "operation": "erosion"}}}, frame)


def test_volume_tools(spark, world):
    folder, labels, raw, frame = world
    own = {"input_path": f"{folder}/in.zarr/cells/s0"}

    def run(tool, **config):
        return voxels.to_array(cli.TOOLS[tool](spark, {**own, "output_path": f"{folder}/{tool}", **config}), labels.shape)

    def numbered(array, ids):
        return sum((k + 1) * (array == i) for k, i in enumerate(ids))

    assert (run("clean-connected-components", minimum_volume_nm_3=20 * 64) == numbered(labels, [1, 2])).all()
    filled = labels.copy()
    filled[4:6, 4:6, 4:6] = 1
    assert (run("fill-holes") == filled).all()
    assert (run("filter-ids", ids_to_keep="5,1") == numbered(labels, [5, 1])).all()
    assert (run("filter-ids", ids_to_remove=[2]) == np.where(labels == 2, 0, labels)).all()
    assert (run("label-with-mask", input_path=f"{folder}/raw.zarr/s0", mask_path=own["input_path"], intensity_threshold_minimum=50) == np.where(raw >= 50, labels, 0)).all()
    eroded = run("morphological-operations", operation="erosion")
    core = np.zeros_like(labels)
    core[13:15, 4:7, 4:7] = 2
    assert (eroded[10:] == core[10:]).all() and eroded[7, 7, 7] == 1 and eroded[3, 3, 3] == 0  # the hole wears its shell away
    twice = run("morphological-operations", operation="dilation", iterations=2)
    assert (twice[11:18, 1:10, 1:10] == 2).all() and (twice != 0).sum() > (labels != 0).sum()
    sites = run("contact-sites", organelle_1_path=own["input_path"], organelle_2_path=own["input_path"], contact_distance_nm=4, minimum_volume_nm_3=0)
    assert ((sites > 0) == (labels > 0)).all()


def test_default_output_path(spark, world):
    folder, labels, _, _ = world
    cli.fill_holes(spark, {"input_path": f"{folder}/in.zarr/cells/s0"})
    assert result(spark, f"{folder}/in.zarr/cells_filled/s0", labels.shape)[0][4, 4, 4] == 1


def test_watershed_tool(spark, world, tmp_path):
    near = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (3, 0, 0), (0, 3, 0), (0, 0, 3)]
    labels = np.zeros((12, 8, 16), np.int64)
    labels[:, 1:7, 1:7], labels[:, 1:7, 9:15] = 1, 2
    names = []
    for k, o in enumerate(near):
        affs = np.zeros(labels.shape)
        low = tuple(slice(0, n - v) for v, n in zip(o, labels.shape, strict=True))
        high = tuple(slice(v, n) for v, n in zip(o, labels.shape, strict=True))
        affs[low] = 255 * ((labels[low] == labels[high]) & (labels[low] > 0))
        names.append(f"{tmp_path}/a{k}.zarr/s0")
        volumes.write_zarr(voxels.from_array(spark, affs.astype(int), "value"), Frame((1.0,) * 3, labels.shape), names[-1], (4, 8, 8), "<u1", "value")
    config = {"affinities_path": names, "neighborhood": near, "adjacent_edge_bias": -0.5, "lr_bias_ratio": -0.5 / 3, "filter_val": 0.05, "connectivity": 1, "chunk_shape": [4, 8, 16], "output_path": f"{tmp_path}/mws"}
    got = voxels.to_array(cli.mutex_watershed(spark, config | {"do_opening": True, "minimum_volume_nm_3": 30}), labels.shape)
    assert set(got[3:9, 3:5, 3:5].ravel().tolist()) == {1} and set(got[3:9, 3:5, 11:13].ravel().tolist()) == {2} and got.max() == 2


def test_mutex_watershed_smoothing_and_biases():
    """Two ways to join a voxel that weigh the same go by their surroundings; biases move on when offsets grow."""
    near = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 2)]
    affs = np.zeros((4, 1, 1, 9))
    affs[2, 0, 0] = [0.9, 0.9, 0.9, 0.6, 0.6, 0.7, 0.7, 0.7, 0]
    affs[3, 0, 0] = 0.1
    got = objects.mutex_watershed(affs, near, -0.5, [-0.6], 0.0, noise=0.0)[0, 0]
    assert got[3] == got[2] and got[4] != got[3]  # the stronger side takes the voxel between equal edges
    with pytest.raises(StopIteration):
        objects.mutex_watershed(affs, [*near[:3], (0, 0, 3)], -0.5, [], 0.0)


def test_measure_lines_assign_skeletonize(spark, world):
    folder, labels, raw, frame = world
    path = f"{folder}/in.zarr/cells/s0"
    cli.measures(spark, {"input_path": path, "output_path": f"{folder}/tables", "raw_path": f"{folder}/raw.zarr/s0"})
    rows = {r["Object ID"]: r for r in volumes.read_objects(spark, f"{folder}/tables/cells.csv").collect()}
    for k in (1, 2, 5):
        at = np.argwhere(labels == k)
        assert rows[k]["Volume (nm^3)"] == len(at) * 64 and rows[k]["COM X (nm)"] == pytest.approx((at[:, 2].mean() + 0.5) * 4)
        assert rows[k]["Mean Intensity"] == pytest.approx(raw[labels == k].mean()) and rows[k]["Std Intensity"] == pytest.approx(raw[labels == k].std())
    csv = f"{folder}/tables/cells.csv"
    lines = {r["Object ID"]: r for r in cli.fit_lines_to_segmentations(spark, {"input_path": path, "input_csv": csv, "output_annotations_dir": f"{folder}/lines"}).collect()}
    ends = sorted([lines[5]["Line Start Z (nm)"], lines[5]["Line End Z (nm)"]])
    assert ends == pytest.approx([14, 66]) and volumes.read_objects(spark, f"{folder}/tables/cells_lines.csv").count() == 3
    data = volumes.got(f"{folder}/lines/spatial0/0_0_0")
    assert struct.unpack_from("<Q", data)[0] == 3 and len(data) == 8 + 3 * 24 + 3 * 8
    for n, name in ((0, "containing_cells"), (1, "nearest_cells"), (2, "2_nearest_cellss")):
        out = {r["Object ID"]: r for r in cli.assign_to_organelles(spark, {"organelle_csvs": [csv], "target_organelle_ds_path": path, "output_path": f"{folder}/assigned", "assignment_type": n}).collect()}
        assert out[2]["cells ID"] == (2 if n < 2 else [2, 1]) and volumes.read_objects(spark, f"{folder}/assigned/cells_assigned_to_{name}.csv").count() == 3
    for sharded in (True, False):
        where = f"{folder}/skeletons{sharded}"
        out = {r.label: r for r in cli.skeletonize(spark, {"segmentation_path": path, "output_path": where, "csv_path": csv, "erosion": False, "min_branch_length_nm": 1, "sharded": sharded, "shard_bits": 2, "minishard_bits": 1, "skeleton_properties": "all"}).collect()}
        info = json.loads(volumes.got(f"{where}/full/info"))
        assert ("sharding" in info) == sharded
        for kind in ("full", "simplified"):
            listed = json.loads(volumes.got(f"{where}/{kind}/segment_properties/info"))["inline"]
            assert listed["ids"] == ["1", "2", "5"] and {p["id"] for p in listed["properties"]} == set(shards.METRICS)
        for label, row in out.items():
            sharding = shards.Sharding(0, 2, 1)
            data = shards.read_from_shard(volumes.got(f"{where}/full/{sharding.filename(sharding.bucket(label)[0])}"), label, info["sharding"]) if sharded else volumes.got(f"{where}/full/{label}")
            vertices, edges = shards.decode_skeleton(data)
            assert np.allclose(vertices, np.array(row.vertices)) and edges.tolist() == [list(e) for e in row.edges]
        assert out[5].longest_path == pytest.approx(13 * 4) and volumes.read_objects(spark, f"{folder}/tables/cells_with_skeletons.csv").count() == 3


def test_fit_lines_against_eigenvectors(spark):
    array = np.zeros((12, 12, 24), np.int64)
    for x in range(24):
        array[3 + x // 6 : 6 + x // 6, 4:6, x] = 1
    array[11, 11, 0] = 1  # another, smaller part
    frame = Frame((2.0, 3.0, 4.0), array.shape, (5.0, 0.0, 1.0))
    row = objects.fit_lines(voxels.from_array(spark, array), frame).first()
    part = array.copy()
    part[11, 11, 0] = 0
    points = (np.argwhere(part) + 0.5) * frame.voxel + frame.corner
    axis = np.linalg.eigh(np.cov(points.T))[1][:, -1]
    along = (points - points.mean(0)) @ axis
    expected = sorted([(points.mean(0) + t * axis).tolist() for t in (along.min(), along.max())])
    assert sorted([[row.start_z, row.start_y, row.start_x], [row.end_z, row.end_y, row.end_x]]) == [pytest.approx(e) for e in expected]


def test_write_by_roi_and_pruned_reads(spark, tmp_path):
    rng = np.random.Generator(np.random.PCG64(8))
    array, new = rng.integers(0, 3, (2, 12, 13, 14))
    frame, path, roi = Frame(VOXEL, (12, 13, 14)), f"{tmp_path}/a.zarr/s0", Roi((2, 3, 5), (7, 4, 6))
    volumes.write_zarr(voxels.from_array(spark, array), frame, path, (5, 5, 5))
    volumes.write_zarr(voxels.from_array(spark, new), frame, path, (5, 5, 5), roi=roi)
    expected, box = array.copy(), tuple(slice(b, e) for b, e in zip(roi.begin, roi.end, strict=True))
    expected[box] = new[box]
    assert (result(spark, path, array.shape)[0] == expected).all()
    part, _ = volumes.read_volume(spark, path, roi=roi)
    assert len(part.inputFiles()) == 2 * 2 * 2 and part.count() == (expected[box] != 0).sum()
    assert volumes.read_volume(spark, path, roi=Roi((50, 0, 0), (2, 2, 2)))[0].count() == 0


def blosc(data, size, codec, flags, block, split):
    """A blosc 1 container, made by hand."""
    blocks = [data[i : i + block] for i in range(0, len(data), block)]
    body, starts = b"", []
    for part in blocks:
        values = np.frombuffer(part, np.uint8)
        whole = len(part) // size
        if flags & 1:
            values = np.concatenate([values[: whole * size].reshape(whole, size).T.ravel(), values[whole * size :]])
        if flags & 4:
            whole -= whole % 8
            bits = np.unpackbits(values[: whole * size].reshape(whole, size), axis=1, bitorder="little")
            values = np.concatenate([np.packbits(bits.T, axis=1, bitorder="little").ravel(), values[whole * size :]])
        starts.append(16 + 4 * len(blocks) + len(body))
        n = size if split and len(part) == block else 1
        for piece in np.split(values, n):
            raw = piece.tobytes()
            packed = zlib.compress(raw) if codec == 3 else pa.Codec({1: "lz4_raw", 2: "snappy", 4: "zstd"}[codec]).compress(raw, asbytes=True)
            packed = raw if len(packed) >= len(raw) else packed
            body += struct.pack("<i", len(packed)) + packed
    head = struct.pack("<BBBBIII", 2, 1, flags | codec << 5 | (0 if split else 0x10), size, len(data), block, 0)
    return head + struct.pack(f"<{len(starts)}i", *starts) + body


@pytest.mark.parametrize("codec", [1, 2, 3, 4])
@pytest.mark.parametrize("flags", [0, 1, 4])
@pytest.mark.parametrize("split", [False, True])
def test_blosc(codec, flags, split):
    rng = np.random.Generator(np.random.PCG64(2))
    data = np.cumsum(rng.integers(0, 3, 3001)).astype("<u8").tobytes() + b"end"
    assert codecs.unblosc(blosc(data, 8, codec, flags, 8192, split)) == data
    with pytest.raises(ValueError):
        codecs.unblosc(struct.pack("<BBBBIII", 2, 1, 0, 1, 4, 4, 20) + data)


def test_volume_formats(spark, tmp_path):
    """Zarr v2 with blosc, Zarr v3 plain and sharded, N5, and precomputed plain and compressed, all of one array."""
    import gzip

    rng = np.random.Generator(np.random.PCG64(3))
    array = rng.integers(0, 6, (8, 8, 8)).astype("<u4") * 1000
    cut = [(p, array[tuple(slice(4 * i, 4 * i + 4) for i in p)]) for p in np.ndindex(2, 2, 2)]

    def store(name, data):
        volumes.put(f"{tmp_path}/{name}", data if isinstance(data, bytes) else json.dumps(data).encode())

    store("b.zarr/s0/.zarray", {"zarr_format": 2, "shape": [8, 8, 8], "chunks": [4, 4, 4], "dtype": "<u4", "compressor": {"id": "blosc", "cname": "lz4"}, "fill_value": 0, "order": "C", "filters": None})
    v3 = {"zarr_format": 3, "node_type": "array", "shape": [8, 8, 8], "data_type": "uint32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [4, 4, 4]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0}
    store("c.zarr/s0/zarr.json", v3 | {"codecs": [{"name": "bytes"}, {"name": "gzip"}]})
    inner = [{"name": "bytes"}, {"name": "zstd"}]
    sharded = {"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 4, 4], "codecs": inner, "index_codecs": [{"name": "bytes"}, {"name": "crc32c"}], "index_location": "end"}}
    store("d.zarr/s0/zarr.json", v3 | {"codecs": [sharded]})
    store("e.n5/s0/attributes.json", {"dimensions": [8, 8, 8], "blockSize": [4, 4, 4], "dataType": "uint32", "compression": {"type": "gzip"}})
    scale = {"key": "4_4_4", "size": [8, 8, 8], "resolution": [4, 4, 4], "chunk_sizes": [[4, 4, 4]], "voxel_offset": [0, 0, 0]}
    store("p/info", {"data_type": "uint32", "num_channels": 1, "scales": [scale | {"encoding": "raw"}]})
    store("q/info", {"data_type": "uint32", "num_channels": 1, "scales": [scale | {"encoding": "compressed_segmentation", "compressed_segmentation_block_size": [4, 4, 4]}]})
    for p, part in cut:
        raw = part.tobytes()
        if p != (1, 1, 1):
            store(f"b.zarr/s0/{'.'.join(map(str, p))}", blosc(raw, 4, 1, 1, 256, False))
        store(f"c.zarr/s0/c/{'/'.join(map(str, p))}", gzip.compress(raw))
        pieces = [pa.Codec("zstd").compress(part[i : i + 2].tobytes(), asbytes=True) for i in (0, 2)]
        index = struct.pack("<QQQQ", 0, len(pieces[0]), len(pieces[0]), len(pieces[1]))
        store(f"d.zarr/s0/c/{'/'.join(map(str, p))}", b"".join(pieces) + index + bytes(4))
        store(f"e.n5/s0/{'/'.join(map(str, p[::-1]))}", struct.pack(">HHIII", 0, 3, 4, 4, 4) + gzip.compress(part.astype(">u4").tobytes()))
        name = "_".join(f"{4 * i}-{4 * i + 4}" for i in p[::-1])
        store(f"p/4_4_4/{name}", part.tobytes())
        values, place = np.unique(part, return_inverse=True)
        bits = 4
        packed = np.packbits((place.ravel()[:, None] >> np.arange(bits) & 1).astype(np.uint8).ravel(), bitorder="little").view("<u4")
        head = np.array([(2 + len(packed)) | bits << 24, 2], "<u4")
        store(f"q/4_4_4/{name}", np.concatenate([[np.uint32(1)], head, packed, values]).astype("<u4").tobytes())
    missing = array.copy()
    missing[4:, 4:, 4:] = 0
    for name, expected in (("b.zarr/s0", missing), ("c.zarr/s0", array), ("d.zarr/s0", array), ("e.n5/s0", array), ("p", array), ("p/4_4_4", array), ("q", array)):
        assert (result(spark, f"{tmp_path}/{name}", array.shape)[0] == expected).all(), name
        part, _ = volumes.read_volume(spark, f"{tmp_path}/{name}", roi=Roi((0, 4, 1), (4, 3, 2)))
        assert part.count() == (expected[:4, 4:7, 1:3] != 0).sum() and len(part.inputFiles()) == 1, name
    store("f.zarr/s0/.zarray", {"zarr_format": 2, "shape": [2, 2, 2], "chunks": [2, 2, 2], "dtype": "<u8", "compressor": None, "fill_value": 0, "order": "C"})
    store("f.zarr/s0/0.0.0", np.full(8, 2**63 + 5, "<u8").tobytes())
    with pytest.raises(Exception, match="2\\*\\*63"):
        volumes.read_volume(spark, f"{tmp_path}/f.zarr/s0")[0].count()
    store("g.zarr/s0/.zarray", {"zarr_format": 2, "shape": [2, 2, 2], "chunks": [2, 2, 2], "dtype": "<u8", "compressor": None, "fill_value": 7, "order": "C"})
    with pytest.raises(ValueError, match="fill value"):
        volumes.open_volume(spark, f"{tmp_path}/g.zarr/s0")


def test_balanced_batches(spark):
    weights = spark.createDataFrame([(i, w) for i, w in enumerate([10, 9, 8, 7, 6, 5, 4, 3, 2, 1])], "id long, weight long")
    sums = {r.batch: r.w for r in objects.batched(weights, 4).groupBy("batch").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "w").collect()}
    assert len(sums) == 4 and max(sums.values()) <= 1.3 * 55 / 4


def test_small_helpers(tmp_path):
    assert paths.size_text(1536) == "1.5 KB" and paths.size_text(12) == "12 B"
    assert paths.run_folder("cc").startswith("cc-2")
    assert Frame((1.0,) * 3, (9, 9, 9)).first_id(3, (4, 4, 4)) == 192
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert cli.load(str(tmp_path / "c.json")) == {"a": 1}
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yml").write_text(yaml.dump({"roi": ["0:1", "0:2", "0:3"]}))
    assert cli.load(str(tmp_path / "c.yml")) == {"roi": ["0:1", "0:2", "0:3"]}


def test_many_rounds_of_dilation(spark):
    from voxloom.operators import morphology

    array = np.zeros((40, 3, 3), np.int64)
    array[0, 1, 1] = 4
    got = voxels.to_array(morphology.dilate(voxels.from_array(spark, array), Frame(VOXEL, array.shape), 20, 1), array.shape)
    assert (got[:19] == 4).all() and got[20, 1, 1] == 4 and got[21].sum() == 0
