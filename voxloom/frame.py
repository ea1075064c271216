"""The physical frame of a volume: voxel size, corner and shape, always in the order z, y, x."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from fractions import Fraction
from functools import reduce

Triple = tuple[float, float, float]


def is_integer_size(size: Triple, tolerance: float = 1e-9) -> bool:
    return all(abs(v - round(v)) <= tolerance for v in size)


def scaled_to_integers(size: Triple) -> tuple[tuple[int, ...], int]:
    """The voxel size in whole units and the factor that makes it so: the LCM of the denominators up to 10,000."""
    if is_integer_size(size):
        return tuple(round(v) for v in size), 1
    parts = [Fraction(v).limit_denominator(10_000) for v in size]
    factor = math.lcm(*(p.denominator for p in parts))
    return tuple(int(p * factor) for p in parts), factor


def common_factor(*factors: int) -> int:
    """The scale factor that several volumes share."""
    return reduce(math.lcm, factors, 1)


@dataclass(frozen=True)
class Roi:
    """A half-open box of voxel indices."""

    begin: tuple[int, int, int]
    shape: tuple[int, int, int]

    @property
    def end(self) -> tuple[int, int, int]:
        return tuple(b + s for b, s in zip(self.begin, self.shape, strict=True))

    def grow(self, n: int) -> Roi:
        return Roi(tuple(b - n for b in self.begin), tuple(s + 2 * n for s in self.shape))

    def intersect(self, other: Roi) -> Roi:
        begin = tuple(map(max, self.begin, other.begin))
        return Roi(begin, tuple(max(0, min(a, b) - c) for a, b, c in zip(self.end, other.end, begin, strict=True)))

    def snap(self, block: tuple[int, int, int]) -> Roi:
        """Outward to multiples of ``block``."""
        begin = tuple(b // k * k for b, k in zip(self.begin, block, strict=True))
        return Roi(begin, tuple(-(-e // k) * k - b for e, k, b in zip(self.end, block, begin, strict=True)))

    @staticmethod
    def parse(parts: list[str]) -> Roi:
        """From ["z0:z1", "y0:y1", "x0:x1"]."""
        pairs = [tuple(int(v) for v in p.split(":")) for p in parts]
        return Roi(tuple(a for a, _ in pairs), tuple(b - a for a, b in pairs))


@dataclass(frozen=True)
class Frame:
    """voxel: size of a voxel; corner: physical corner of voxel (0, 0, 0); shape: voxels along each axis."""

    voxel: Triple
    shape: tuple[int, int, int]
    corner: Triple = (0.0, 0.0, 0.0)

    @property
    def volume(self) -> float:
        return self.voxel[0] * self.voxel[1] * self.voxel[2]

    @property
    def faces(self) -> Triple:
        """Areas of the faces that stand across z, y and x."""
        z, y, x = self.voxel
        return y * x, z * x, z * y

    @property
    def centre(self) -> Triple:
        """What metadata files store: the centre of voxel (0, 0, 0)."""
        return tuple(c + v / 2 for c, v in zip(self.corner, self.voxel, strict=True))

    @staticmethod
    def from_centre(voxel: Triple, shape: tuple[int, int, int], centre: Triple) -> Frame:
        return Frame(tuple(voxel), tuple(shape), tuple(c - v / 2 for c, v in zip(centre, voxel, strict=True)))

    def rescaled(self, factor: int) -> Frame:
        return replace(self, voxel=tuple(v * factor for v in self.voxel), corner=tuple(c * factor for c in self.corner))

    def blocks(self, block: tuple[int, int, int]) -> tuple[int, int, int]:
        """Blocks along each axis."""
        return tuple(-(-s // b) for s, b in zip(self.shape, block, strict=True))

    def first_id(self, index: int, block: tuple[int, int, int]) -> int:
        """What is added to a block's own ids 1..n so that no two blocks share one."""
        return index * block[0] * block[1] * block[2]

    def block(self, index: int, block: tuple[int, int, int], halo: int = 0) -> tuple[Roi, Roi]:
        """(read, write) boxes of the block with this row-major index; reads reach ``halo`` voxels further, inside the volume."""
        _, ny, nx = self.blocks(block)
        at = index // (ny * nx), index // nx % ny, index % nx
        whole = Roi((0, 0, 0), self.shape)
        write = Roi(tuple(a * b for a, b in zip(at, block, strict=True)), tuple(block)).intersect(whole)
        return write.grow(halo).intersect(whole), write
