"""Chunk codecs: gzip, zlib, zstd, lz4, the blosc container, Zarr v3 shards and compressed segmentations.

Fixed values: layouts, flags and numbers of these public formats.
"""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
import pyarrow as pa

#: Codec numbers in the flags of a blosc container; blosclz (0) is not read.
_BLOSC = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}


def _unzstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def unblosc(data: bytes) -> bytes:
    """The content of a blosc 1 container: blocks, split by byte or not, shuffled by byte or bit or not."""
    _, _, flags, size, n, block, _ = struct.unpack_from("<BBBBIII", data)
    if flags & 2:
        return data[16 : 16 + n]
    codec = _BLOSC.get(flags >> 5)
    if codec is None:
        raise ValueError("blosc chunks of the codec blosclz are not read")
    out = bytearray()
    for k in range(-(-n // block)):
        at = struct.unpack_from("<i", data, 16 + 4 * k)[0]
        own = min(block, n - k * block)
        splits = size if not flags & 0x10 and size <= 16 and block // size >= 128 and own == block else 1
        part = bytearray()
        for _ in range(splits):
            length = struct.unpack_from("<i", data, at)[0]
            piece, at = data[at + 4 : at + 4 + length], at + 4 + length
            if length != own // splits:
                piece = zlib.decompress(piece) if codec == "zlib" else _unzstd(piece) if codec == "zstd" else pa.Codec(codec).decompress(piece, own // splits, asbytes=True)
            part += piece
        values = np.frombuffer(bytes(part), np.uint8)
        whole = own // size
        if flags & 1 and size > 1:
            values = np.concatenate([values[: whole * size].reshape(size, whole).T.ravel(), values[whole * size :]])
        elif flags & 4:
            whole -= whole % 8
            planes = np.unpackbits(values[: whole * size].reshape(size * 8, whole // 8), axis=1, bitorder="little")
            values = np.concatenate([np.packbits(planes.T, axis=1, bitorder="little").ravel(), values[whole * size :]])
        out += values.tobytes()
    return bytes(out)


DECODERS = {"raw": lambda d: d, "gzip": gzip.decompress, "zlib": zlib.decompress, "zstd": _unzstd, "blosc": unblosc, "lz4": lambda d: pa.Codec("lz4_raw").decompress(d[4:], struct.unpack_from("<I", d)[0], asbytes=True)}


def inner_chunks(data: bytes, count: int, checked: bool, at_start: bool) -> list[bytes | None]:
    """The inner chunks of a Zarr v3 shard in row-major order; None where there is none."""
    length = 16 * count + (4 if checked else 0)
    index = data[:length] if at_start else data[len(data) - length :]
    spans = np.frombuffer(index[: 16 * count], "<u8").reshape(count, 2)
    return [None if int(o) == 2**64 - 1 else data[int(o) : int(o) + int(n)] for o, n in spans]


def compressed_segmentation(data: bytes, shape: tuple[int, ...], block: tuple[int, int, int], wide: bool) -> np.ndarray:
    """The labels (x, y, z) of one channel: blocks of few labels, each by a table and bit-packed places in it."""
    words = np.frombuffer(data, "<u4")
    words = words[int(words[0]) :]
    grid = tuple(-(-n // b) for n, b in zip(shape, block, strict=True))
    out = np.zeros(tuple(g * b for g, b in zip(grid, block, strict=True)), np.uint64 if wide else np.uint32)
    n = int(np.prod(block))
    for k in range(int(np.prod(grid))):
        x, y, z = k % grid[0], k // grid[0] % grid[1], k // (grid[0] * grid[1])
        table, bits, start = int(words[2 * k]) & 0xFFFFFF, int(words[2 * k]) >> 24, int(words[2 * k + 1])
        place = np.zeros(n, np.int64)
        if bits:
            packed = np.unpackbits(words[start : start + -(-n * bits // 32)].view(np.uint8), bitorder="little")[: n * bits]
            place = packed.reshape(n, bits).astype(np.int64) @ (1 << np.arange(bits))
        if wide:
            values = words[table + 2 * place].astype(np.uint64) | words[table + 2 * place + 1].astype(np.uint64) << np.uint64(32)
        else:
            values = words[table + place]
        low = tuple(slice(i * b, (i + 1) * b) for i, b in zip((x, y, z), block, strict=True))
        out[low] = values.reshape(block, order="F")
    return out[tuple(slice(0, s) for s in shape)]
