"""Names and places of datasets."""

from __future__ import annotations

import datetime
import posixpath
import re

_SCALE = re.compile(r"^(.*?)(/s\d+)/?$")


def split_scale(path: str) -> tuple[str, str]:
    """("/a/b", "/s0") of "/a/b/s0"; the second part is empty without a scale."""
    m = _SCALE.match(path)
    return (m.group(1), m.group(2)) if m else (path.rstrip("/"), "")


def is_remote(path: str) -> bool:
    return bool(re.match(r"^(s3|gs|https?)://", without_precomputed(path)))


def is_precomputed(path: str) -> bool:
    return path.startswith("precomputed://")


def without_precomputed(path: str) -> str:
    return path.removeprefix("precomputed://")


def split_container(path: str) -> tuple[str, str]:
    """("/a/b.zarr", "c/s0") of "/a/b.zarr/c/s0"; the container is the part up to .zarr or .n5."""
    m = re.match(r"^(.*?\.(?:zarr|n5))(?:/(.*))?$", path)
    if not m:
        raise ValueError(f"no .zarr or .n5 container in {path}")
    return m.group(1), (m.group(2) or "").strip("/")


def leaf_name(path: str) -> str:
    """The dataset's own name, without scale and container suffix."""
    base, _ = split_scale(without_precomputed(path).rstrip("/"))
    return re.sub(r"\.(zarr|n5)$", "", posixpath.basename(base))


def output_path(path: str, suffix: str = "_output") -> str:
    """The default place of a result: the suffix follows the dataset's name, and the container's where it has no name."""
    container, dataset = split_container(path)
    name, _ = split_scale("/" + dataset)
    name = name.strip("/")
    if name and not re.fullmatch(r"s\d+", name):
        return f"{container}/{name}{suffix}"
    stem, kind = posixpath.splitext(container)
    return f"{stem}{suffix}{kind}"


def public_https(path: str) -> str:
    """The https address of a public bucket path."""
    m = re.match(r"^(s3|gs)://([^/]+)/?(.*)$", path)
    if not m:
        return path
    return f"https://{m.group(2)}.s3.amazonaws.com/{m.group(3)}" if m.group(1) == "s3" else f"https://storage.googleapis.com/{m.group(2)}/{m.group(3)}"


def run_folder(name: str, at: datetime.datetime | None = None) -> str:
    """A folder name for one run: the name and the time."""
    return f"{name}-{at or datetime.datetime.now():%Y%m%d.%H%M%S}"


def size_text(count: int) -> str:
    """A number of bytes for people: 1536 is 1.5 KB."""
    value, units = float(count), ["B", "KB", "MB", "GB", "TB", "PB"]
    while abs(value) >= 1024 and len(units) > 1:
        value, units = value / 1024, units[1:]
    return f"{value:.1f} {units[0]}" if units[0] != "B" else f"{count} B"
