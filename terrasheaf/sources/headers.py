"""Inventories of rasters and point clouds from the headers of each file, wherever in it they stand."""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import Blocks, listed, rows_of_files, with_content

#: Number formats of tag types; the tags of an image whose values are read.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 12: "d", 16: "Q"}
_WANTED = (256, 257, 277, 322, 323, 33550, 33922, 34735)
_RASTER = "path string, width long, height long, bands int, crs string, min_x double, min_y double, max_x double, max_y double, tiled boolean, tile_width long, tile_height long, overview_count int, cloud_optimized boolean"
_CLOUD = "path string, point_count long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, crs string, center_x double, center_y double, center_z double, half_size double, spacing double, hierarchy_entries long"


class _Layout:
    """Widths of a TIFF file's fields: classic (32-bit places) or big (64-bit)."""

    def __init__(self, head: Blocks):
        self.order = {b"II": "<", b"MM": ">"}.get(head.at(0, 2))
        version = struct.unpack(self.order + "H", head.at(2, 2))[0] if self.order else 0
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        big = version == 43
        self.place, self.count = ("Q", "Q") if big else ("I", "H")
        self.first = struct.unpack(self.order + self.place, head.at(8 if big else 4, struct.calcsize(self.place)))[0]

    def directory(self, head: Blocks, at: int) -> tuple[dict[int, tuple], int]:
        """(values of the wanted tags, place of the next directory or 0), wherever in the file they stand."""
        wide = struct.calcsize(self.place)
        size = struct.calcsize(self.count)
        (n,) = struct.unpack(self.order + self.count, head.at(at, size))
        raw, entry, out = head.at(at + size, n * (4 + 2 * wide) + wide), 4 + 2 * wide, {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(self.order + "HH" + self.place, raw, k * entry)
            letter = _TYPES.get(kind)
            if letter is None or tag not in _WANTED:
                continue
            length, field = struct.calcsize("=" + letter) * count, raw[k * entry + 4 + wide : (k + 1) * entry]
            values = field[:length] if length <= wide else head.at(struct.unpack(self.order + self.place, field)[0], length)
            out[tag] = struct.unpack(f"{self.order}{count}{letter}", values)
        return out, struct.unpack_from(self.order + self.place, raw, n * entry)[0]


def raster_header(head: Blocks) -> dict:
    """Fields of a TIFF header, classic or big; overviews are the further images of the file."""
    layout = _Layout(head)
    first, after = layout.directory(head, layout.first)
    overviews, seen = 0, {layout.first}
    while after and after not in seen:
        seen.add(after)
        _, after = layout.directory(head, after)
        overviews += 1
    one = lambda tag, default=0: first.get(tag, (default,))[0]
    width, height = one(256), one(257)
    scale, tie, keys = first.get(33550), first.get(33922), first.get(34735, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    epsg = codes.get(3072) or codes.get(2048)
    box = (tie[3], tie[4] - height * scale[1], tie[3] + width * scale[0], tie[4]) if scale and tie else (0.0, 0.0, float(width), float(height))
    tiled = 322 in first
    return {"width": width, "height": height, "bands": one(277, 1), "crs": f"EPSG:{epsg}" if epsg else "unknown", "box": box, "tiled": tiled, "tile": (one(322), one(323)), "overviews": overviews}


def cloud_header(head: Blocks) -> dict:
    """Fields of a LAS 1.4 header and of the COPC info record behind it."""
    if head.at(0, 4) != b"LASF":
        raise ValueError("not a LAS file")
    fixed = head.at(0, 375)
    size, vlrs = struct.unpack_from("<H", fixed, 94)[0], struct.unpack_from("<I", fixed, 100)[0]
    (points,) = struct.unpack_from("<Q", fixed, 247)
    max_x, min_x, max_y, min_y, max_z, min_z = struct.unpack_from("<6d", fixed, 179)
    at, projected, info = size, False, None
    for _ in range(vlrs):
        record = head.at(at, 54)
        user, kind, length = record[2:18].rstrip(b"\0"), *struct.unpack_from("<HH", record, 18)
        projected |= user == b"LASF_Projection"
        if user == b"copc" and kind == 1:
            info = struct.unpack("<5d2Q", head.at(at + 54, 56))
        at += 54 + length
    if info is None:
        raise ValueError("no COPC info record")
    return {"points": points, "box": (min_x, min_y, min_z, max_x, max_y, max_z), "crs": "projected" if projected else "unknown", "center": info[:3], "half": info[3], "spacing": info[4], "root": info[5:7]}


#: An entry of a hierarchy page: a node's level and place, and its data; no points of its own (-1): a further page there.
_ENTRY = np.dtype([("level", "<i4"), ("xyz", "<i4", 3), ("offset", "<u8"), ("bytes", "<i4"), ("points", "<i4")])


def hierarchy(head: Blocks, root: tuple[int, int]) -> list[tuple[int, int, int]]:
    """(level, nodes, points) of all hierarchy pages of a point cloud, by level. An entry that points to a page is no node;
    the page is read by its range, each once."""
    todo, seen, nodes, points = [root], {root}, Counter(), Counter()
    while todo:
        at, size = todo.pop()
        page = np.frombuffer(head.at(at, size - size % _ENTRY.itemsize), _ENTRY)
        own = page[page["points"] >= 0]
        for level in np.unique(own["level"]).tolist():
            mine = own["points"][own["level"] == level]
            nodes[level] += len(mine)
            points[level] += int(mine.sum(dtype=np.int64))
        for entry in page[page["points"] < 0]:
            below = int(entry["offset"]), int(entry["bytes"])
            if below not in seen:
                seen.add(below)
                todo.append(below)
    return [(level, nodes[level], points[level]) for level in sorted(nodes)]


def pointcloud_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(path, level, nodes, points): the octree nodes of each file by level, from all its hierarchy pages."""

    def rows(name: str, file: pa.NativeFile) -> list[tuple]:
        head = Blocks(file)
        return [(name, *row) for row in hierarchy(head, cloud_header(head)["root"])]

    return rows_of_files(with_content(listed(spark, path)), "path string, level int, nodes long, points long", rows)


def _inventory(spark: SparkSession, path: str, schema: str, row: Callable[[Blocks], tuple]) -> DataFrame:
    """A row per file, of which only the blocks are read that headers, directories and tags stand in."""

    def rows(name: str, file: pa.NativeFile) -> list[tuple]:
        return [(name, *row(Blocks(file)))]

    return rows_of_files(with_content(listed(spark, path)), schema, rows)


def raster_inventory(spark: SparkSession, path: str) -> DataFrame:
    def row(head: Blocks) -> tuple:
        h = raster_header(head)
        return h["width"], h["height"], h["bands"], h["crs"], *h["box"], h["tiled"], *h["tile"], h["overviews"], h["tiled"] and h["overviews"] > 0

    return _inventory(spark, path, _RASTER, row)


def pointcloud_inventory(spark: SparkSession, path: str) -> DataFrame:
    def row(head: Blocks) -> tuple:
        h = cloud_header(head)
        nodes = sum(n for _, n, _ in hierarchy(head, h["root"]))
        return h["points"], *h["box"], h["crs"], *h["center"], h["half"], h["spacing"], nodes

    return _inventory(spark, path, _CLOUD, row)
