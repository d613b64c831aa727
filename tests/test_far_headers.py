"""Raster headers that stand far behind the start of a file."""

import struct

from terrasheaf.sources import headers as H


def directory(entries, after):
    out = struct.pack("<H", len(entries))
    for tag, kind, count, value in entries:
        out += struct.pack("<HHII", tag, kind, count, value)
    return out + struct.pack("<I", after)


def test_directories_at_the_end(spark, tmp_path):
    far = 200_000
    scale = struct.pack("<3d", 0.5, 0.5, 0.0)
    tie = struct.pack("<6d", 0, 0, 0, 10.0, 50.0, 0)
    entries = [(256, 4, 1, 640), (257, 4, 1, 480), (322, 4, 1, 256), (323, 4, 1, 256), (33550, 12, 3, far), (33922, 12, 6, far + 24)]
    at = far + 72
    second = at + 2 + 12 * len(entries) + 4
    start = struct.pack("<2sHI", b"II", 42, at)
    data = start + bytes(far - len(start)) + scale + tie + directory(entries, second) + directory([(256, 4, 1, 320)], 0)
    (tmp_path / "far.tif").write_bytes(data)
    (row,) = H.raster_inventory(spark, str(tmp_path / "*.tif")).collect()
    assert (row["width"], row["height"], row["overview_count"], row["cloud_optimized"]) == (640, 480, 1, True)
    assert (row["min_x"], row["min_y"], row["max_x"], row["max_y"]) == (10.0, 50.0 - 240.0, 330.0, 50.0)
