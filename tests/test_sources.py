"""Sources on any store, single items, overlays, the map sink and the SQL functions."""

import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from terrasheaf.functions import geometry as G
from terrasheaf.functions import text as X
from terrasheaf.operators import catalog as C
from terrasheaf.plans import steps
from terrasheaf.sources import files, geoparquet as GP
from terrasheaf.sources import headers as H
from terrasheaf.sources import json_features as J

RINGS = "array<array<struct<x: double, y: double>>>"


def wards(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    triangle = [(5.0, 0.0), (6.0, 0.0), (5.0, 1.0), (5.0, 0.0)]
    rows = [(i, None if i % 5 == 4 else [[{"x": x, "y": y} for x, y in r] for r in ([square, triangle] if i % 2 else [square])]) for i in range(40)]
    return spark.createDataFrame(rows, f"n long, rings {RINGS}")


@pytest.mark.parametrize("ranged", [files.RANGED, ()])
def test_geoparquet_through_ranges_or_whole_files(spark, tmp_path, monkeypatch, ranged):
    """Without a store that is read by range, tasks get the bytes from Spark."""
    monkeypatch.setattr(files, "RANGED", ranged)
    monkeypatch.setattr(GP, "FILE_BYTES", 2000)
    df, path = wards(spark).repartition(3), str(tmp_path / "g")
    GP.write_geoparquet(df, path, row_group_rows=4)
    foot = GP.geoparquet_footer(spark, path).collect()
    assert len(foot) > 3 and {r["crs"] for r in foot} == {"EPSG:4326"} and all(r["row_group_count"] >= 1 for r in foot)
    want = sorted((r["n"], str(r["rings"])) for r in df.filter("rings is not null").collect())
    assert sorted((r["n"], str(r["rings"])) for r in GP.read_geoparquet(spark, path).collect()) == want
    assert sorted(r["id"] for r in GP.read_geoparquet(spark, path, ids=True).collect()) == list(range(32))
    first = GP.read_geoparquet(spark, path, row_groups=[0], ids=True).collect()
    assert sorted(r["id"] for r in first) == list(range(len(first))) and len(first) < 32
    again = {r["n"]: r["id"] for r in GP.read_geoparquet(spark, path, ids=True).collect()}
    assert again == {r["n"]: r["id"] for r in GP.read_geoparquet(spark, path, ids=True).collect()}


def test_missing_footer_and_empty_table(spark, tmp_path):
    wards(spark).select("n").write.parquet(str(tmp_path / "plain"))
    with pytest.raises(Exception, match="no geo metadata"):
        GP.geoparquet_footer(spark, str(tmp_path / "plain")).collect()
    GP.write_geoparquet(wards(spark).limit(0), str(tmp_path / "none"))
    assert files.listed(spark, str(tmp_path / "none")).filter("length > 0").count() == 0


def big_tiff(far):
    """BigTIFF with its directory, tags and an overview behind `far` bytes."""
    keys = [(256, 4, 1, 900), (257, 4, 1, 600), (277, 3, 1, 3), (322, 3, 1, 256), (323, 3, 1, 256), (34735, 3, 8, far)]
    geo = struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, 6668)
    at = far + len(geo)
    directory = lambda entries, after: struct.pack("<Q", len(entries)) + b"".join(struct.pack("<HHQQ", *e) for e in entries) + struct.pack("<Q", after)
    first = directory(keys, at + 8 + 20 * len(keys) + 8)
    start = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at)
    return start + bytes(far - len(start)) + geo + first + directory([(256, 4, 1, 450)], 0)


@pytest.mark.parametrize("ranged", [files.RANGED, ()])
def test_big_tiff_and_broken_files(spark, tmp_path, monkeypatch, ranged):
    monkeypatch.setattr(files, "RANGED", ranged)
    (tmp_path / "a b.tif").write_bytes(big_tiff(300_000))
    (row,) = H.raster_inventory(spark, str(tmp_path / "*.tif")).collect()
    assert (row["width"], row["bands"], row["crs"], row["tile_width"], row["overview_count"], row["cloud_optimized"]) == (900, 3, "EPSG:6668", 256, 1, True)
    (tmp_path / "c.tif").write_bytes(b"II*\0" + struct.pack("<I", 5000))
    with pytest.raises(Exception, match="outside a file"):
        H.raster_inventory(spark, str(tmp_path / "c.tif")).collect()


def test_blocks():
    import pyarrow as pa

    data = bytes(range(256)) * 4000
    b = H.Blocks(pa.BufferReader(data))
    for start, n in ((0, 4), (files.BLOCK_BYTES - 2, 5), (10, 700_000), (len(data) - 3, 3), (7, 0)):
        assert b.at(start, n) == data[start : start + n]
    with pytest.raises(ValueError):
        b.at(len(data) - 1, 2)


def test_stac_item(spark, tmp_path):
    item = {"type": "Feature", "id": "i", "bbox": [0, 0, 1, 2], "properties": {"license": "x"}, "assets": {"d": {"href": "a", "type": "t"}}}
    (tmp_path / "a.json").write_text(json.dumps(item, indent=1))
    row = J.read_stac_item(spark, str(tmp_path / "a.json")).first()
    assert row["id"] == "i" and row["max_y"] == 2.0 and row["assets"]["d"]["roles"] == [] and row["links"] == []
    (tmp_path / "b.json").write_text(json.dumps({"type": "Collection", "id": "c"}))
    with pytest.raises(Exception, match="no STAC item"):
        J.read_stac_item(spark, str(tmp_path / "b.json")).collect()


def test_overlay(spark, tmp_path):
    catalog = spark.createDataFrame([("a", "old"), ("b", "old")], "id string, title string")
    path = str(tmp_path / "o")
    assert C.upsert_overlay(catalog, C.read_overlay(catalog, path)).count() == 2
    C.write_overlay(spark.createDataFrame([("b", "new"), ("c", "new")], catalog.schema), path)
    assert {r["id"]: r["title"] for r in C.upsert_overlay(catalog, C.read_overlay(catalog, path)).collect()} == {"a": "old", "b": "new", "c": "new"}
    bad = tmp_path / "bad.json"
    bad.write_text('{"id": broken\n')
    assert C.read_overlay(catalog, str(bad)).count() == 0


def test_map_sink(spark, tmp_path):
    df = spark.createDataFrame([("M 0 0 Z", "#fff", 'A & "B"', 12.6), ("M 1 1 Z", "#000", None, 0.0)], "path string, color string, ward_name string, density_per_km2 double")
    J.write_svg_paths(df, str(tmp_path / "s"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "s")).collect())
    assert lines == ['<path d="M 0 0 Z" fill="#fff"><title>A &amp; &quot;B&quot;: 13</title></path>', '<path d="M 1 1 Z" fill="#000"><title>: 0</title></path>']


def test_first_text(spark):
    cases = {'{"a": {"license": 1}, "license": "x"}': "x", '{"license": {"license": "y"}}': "unknown", '{"license": 4}': "unknown", '{"license": null, "l2": "z"}': "z", "{broken": "unknown", None: "unknown", '{"license": ""}': ""}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "p string, want string")
    assert df.filter(~(X.first_text(F.col("p"), ("license", "l2")) == F.col("want"))).count() == 0


def test_sql_functions_equal_the_column_forms(spark):
    steps.register_functions(spark)
    circle = [{"x": math.cos(t / 5), "y": math.sin(t / 5)} for t in range(30)]
    df = spark.createDataFrame([(circle, {"min_x": -1.0, "min_y": -1.0, "max_x": 3.0, "max_y": 1.0})], "ring array<struct<x: double, y: double>>, box struct<min_x: double, min_y: double, max_x: double, max_y: double>")
    df.createOrReplaceTempView("shapes")
    box, ring = F.col("box"), F.col("ring")
    pairs = {
        "ensure_closed(ring)": G.ensure_closed(ring), "simplify_ring(ring, 2)": G.simplify_ring(ring, F.lit(2)), "simplify_ring(ring, 0)": G.simplify_ring(ring, F.lit(0)), "simplify_ring(ring, 5)": G.simplify_ring(ring, F.lit(5)),
        "to_ndc(0.5D, 0.25D, box, 800D, 600D)": G.to_ndc(F.lit(0.5), F.lit(0.25), box, 800.0, 600.0), "svg_path(ring, box, 800D, 600D, 10D)": G.svg_path(ring, box, 800.0, 600.0, 10.0),
    }
    for sql, column in pairs.items():
        assert spark.sql(f"select {sql} v from shapes").first()["v"] == df.select(column.alias("v")).first()["v"], sql
    assert spark.sql("select equal_interval(1D, 5D, 4) v").first()["v"] == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_stac_items_in_lines(spark, tmp_path):
    """Suppliers' items take a bounded number of files; lines read as files of their own do."""
    items = [{"type": "Feature", "id": f"i{k}", "bbox": [k, 0, 1, 2], "assets": {"d": {"href": "a"}}} for k in range(5)]
    (tmp_path / "a.ndjson").write_text("\n".join(map(json.dumps, items)))
    for k, item in enumerate(items):
        (tmp_path / f"{k}.json").write_text(json.dumps(item))
    read = lambda df: sorted(map(str, df.drop("endpoint_file").collect()))
    assert read(J.read_stac_item(spark, str(tmp_path / "a.ndjson"), lines=True)) == read(J.read_stac_item(spark, str(tmp_path / "*.json")))
    (tmp_path / "b.ndjson").write_text('{"type": "Collection", "id": "c"}')
    with pytest.raises(Exception, match="no STAC item"):
        J.read_stac_item(spark, str(tmp_path / "b.ndjson"), lines=True).collect()
