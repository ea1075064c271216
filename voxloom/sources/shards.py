"""Binary encodings of skeletons, line annotations and sharded files, and their sinks."""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.arrow import runs
from voxloom.session import durable
from voxloom.sources.volumes import put


def encode_skeleton(vertices: np.ndarray, edges: list) -> bytes:
    """Counts as uint32, x, y, z as float32, edges as uint32; an empty skeleton is eight zero bytes."""
    points, pairs = np.asarray(vertices, "<f4").reshape(-1, 3), np.asarray(edges, "<u4").reshape(-1, 2)
    return struct.pack("<II", len(points), len(pairs)) + points.tobytes() + pairs.tobytes()


def decode_skeleton(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = struct.unpack_from("<II", data)
    return np.frombuffer(data, "<f4", 3 * n, 8).reshape(n, 3), np.frombuffer(data, "<u4", 2 * m, 8 + 12 * n).reshape(m, 2)


def encode_lines(ids: list[int], lines: np.ndarray) -> bytes:
    """A count as uint64, six float32 per line, then the ids as uint64."""
    return struct.pack("<Q", len(ids)) + np.asarray(lines, "<f4").tobytes() + np.asarray(ids, "<u8").tobytes()


@dataclass(frozen=True)
class Sharding:
    preshift_bits: int = 0
    shard_bits: int = 1
    minishard_bits: int = 6

    def spec(self) -> dict:
        return {"@type": "neuroglancer_uint64_sharded_v1", "hash": "identity", "preshift_bits": self.preshift_bits, "minishard_bits": self.minishard_bits, "shard_bits": self.shard_bits, "minishard_index_encoding": "raw", "data_encoding": "raw"}

    def bucket(self, object_id: int) -> tuple[int, int]:
        key = object_id >> self.preshift_bits
        return key >> self.minishard_bits & (1 << self.shard_bits) - 1, key & (1 << self.minishard_bits) - 1

    def columns(self, object_id: Column) -> tuple[Column, Column]:
        """Shard and minishard of an id column."""
        key = F.shiftright(object_id, self.preshift_bits)
        return F.shiftright(key, self.minishard_bits).bitwiseAND((1 << self.shard_bits) - 1), key.bitwiseAND((1 << self.minishard_bits) - 1)

    def filename(self, shard: int) -> str:
        return f"{shard:0{max(1, math.ceil(self.shard_bits / 4))}x}.shard"


def pack_shard(own: dict[int, bytes], sharding: Sharding) -> bytes:
    """One shard file: a fixed index of minishards, the data sorted by id, and delta-encoded minishard indices."""
    minishards: dict[int, list[int]] = {}
    for object_id in sorted(own):
        minishards.setdefault(sharding.bucket(object_id)[1], []).append(object_id)
    body, ranges = b"", [(0, 0)] * (1 << sharding.minishard_bits)
    for minishard, ids in sorted(minishards.items()):
        start, deltas = len(body), []
        for k, object_id in enumerate(ids):
            body += own[object_id]
            deltas.append((object_id - (ids[k - 1] if k else 0), start if not k else 0, len(own[object_id])))
        index = np.array(deltas, "<u8").T.tobytes()
        ranges[minishard] = (len(body), len(body) + len(index))
        body += index
    return b"".join(struct.pack("<QQ", *r) for r in ranges) + body


def read_from_shard(data: bytes, object_id: int, spec: dict) -> bytes | None:
    """The bytes of one id, or None; other hashes and encodings than identity and raw raise."""
    if spec["hash"] != "identity" or spec["data_encoding"] != "raw" or spec["minishard_index_encoding"] != "raw":
        raise ValueError("only identity hashes and raw encodings")
    sharding = Sharding(spec["preshift_bits"], spec["shard_bits"], spec["minishard_bits"])
    minishard = sharding.bucket(object_id)[1]
    head = 16 << sharding.minishard_bits
    start, end = struct.unpack_from("<QQ", data, 16 * minishard)
    if start == end:
        return None
    deltas = np.frombuffer(data, "<u8", (end - start) // 8, head + start).reshape(3, -1)
    ids = np.cumsum(deltas[0])
    at = np.flatnonzero(ids == object_id)
    if not len(at):
        return None
    offset = int(deltas[1][: at[0] + 1].sum() + deltas[2][: at[0]].sum())
    return data[head + offset : head + offset + int(deltas[2][at[0]])]


def skeleton_bytes(vertices: list, edges: list) -> bytes:
    return encode_skeleton(np.array(vertices, float).reshape(-1, 3), edges)


def chains_bytes(chains: list) -> bytes:
    """Polylines as one skeleton: each one's points in a row."""
    points, edges = [], []
    for chain in chains:
        edges += [(len(points) + i, len(points) + i + 1) for i in range(len(chain) - 1)]
        points += chain
    return skeleton_bytes(points, edges)


#: Name in the properties file -> column of skeletons.
METRICS = {"num_branches": "branches", "longest_shortest_path_nm": "longest_path", "radius_mean_nm": "radius_mean", "radius_std_nm": "radius_std"}


def write_skeletons(skeletons: DataFrame, path: str, sharding: Sharding | None = None, properties: tuple[str, ...] = ("num_branches", "longest_shortest_path_nm")) -> None:
    """Full and simplified skeletons (rows of ``objects.skeletonize``) below ``path``, with their info and properties.

    One file for each object, or with ``sharding`` one task and one file for each shard: a shard's skeletons
    meet in a task, so there should be enough of them.  The properties file lists all ids, as its format asks.
    """
    skeletons = durable(skeletons)
    kinds = {"full": ("vertices", "edges"), "simplified": ("polylines",)}
    for kind, columns in kinds.items():
        info = {"@type": "neuroglancer_skeletons", "transform": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0], "segment_properties": "segment_properties"}
        put(f"{path}/{kind}/info", json.dumps(info | ({"sharding": sharding.spec()} if sharding else {})).encode())
        shard = sharding.columns(F.col("label"))[0] if sharding else F.lit(0)
        rows = skeletons.select(shard.cast("long").alias("shard"), "label", *columns)
        rows = rows.repartition("shard").sortWithinPartitions("shard", "label") if sharding else rows

        def stored(batches: Iterator[pa.RecordBatch], kind: str = kind, columns: tuple[str, ...] = columns) -> Iterator[pa.RecordBatch]:
            encode = skeleton_bytes if kind == "full" else chains_bytes
            tables = runs(batches, ["shard"]) if sharding else (pa.Table.from_batches([b]) for b in batches)
            for table in tables:
                own = {r["label"]: encode(*(r[c] for c in columns)) for r in table.to_pylist()}
                if sharding and own:
                    put(f"{path}/{kind}/{sharding.filename(int(table.column('shard')[0].as_py()))}", pack_shard(own, sharding))
                for label, data in ({} if sharding else own).items():
                    put(f"{path}/{kind}/{label}", data)
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64())], names=["label"])

        rows.mapInArrow(stored, "label long").count()
    known = skeletons.select("label", *(F.col(METRICS[p]).cast("double").alias(p) for p in properties)).orderBy("label").collect()
    listed = segment_properties([r["label"] for r in known], {p: [r[p] for r in known] for p in properties})
    for kind in kinds:
        put(f"{path}/{kind}/segment_properties/info", json.dumps(listed, allow_nan=False).encode())


def write_annotations(lines: DataFrame, path: str) -> None:
    """Lines (label, start_z .. end_x) as one annotation file with its info; the format holds them in a single file."""
    rows = lines.orderBy("label").collect()
    ends = np.array([[r[f"{e}_{c}"] for e in ("start", "end") for c in "zyx"] for r in rows], float).reshape(-1, 6)
    put(f"{path}/spatial0/0_0_0", encode_lines([r["label"] for r in rows], ends))
    most = [int(v) + 1 for v in ends.reshape(-1, 3).max(0)] if len(rows) else [1, 1, 1]
    info = {"@type": "neuroglancer_annotations_v1", "dimensions": {c: [1, "nm"] for c in "zyx"}, "by_id": {"key": "by_id"}, "lower_bound": [0, 0, 0], "upper_bound": most, "annotation_type": "line"}
    info |= {"properties": [], "relationships": [], "spatial": [{"chunk_size": most, "grid_shape": [1, 1, 1], "key": "spatial0", "limit": 1}]}
    put(f"{path}/info", json.dumps(info).encode())


def segment_properties(ids: list[int], properties: dict[str, list[float]], default: float = 0.0) -> dict:
    """The info of number properties; what is not a number becomes ``default``."""
    inline = [{"id": name, "type": "number", "data_type": "float32", "values": [default if v is None or math.isnan(v) else float(v) for v in values]} for name, values in properties.items()]
    return {"@type": "neuroglancer_segment_properties", "inline": {"ids": [str(i) for i in ids], "properties": inline}}
