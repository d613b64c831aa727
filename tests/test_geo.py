"""Edge rules, file formats and streams."""

import json
import math
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terrasheaf.functions import geometry as G
from terrasheaf.functions import text as X
from terrasheaf.operators import density as D
from terrasheaf.operators import federation as E
from terrasheaf.operators import intent as I
from terrasheaf.operators import logs as L
from terrasheaf.plans import steps
from terrasheaf.sources import geoparquet as GP
from terrasheaf.sources import headers as H
from terrasheaf.sources import json_features as J
from terrasheaf.streaming import logs as SL

RINGS = "array<array<struct<x: double, y: double>>>"


def rings(spark, *features):
    return spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in f]) for i, f in enumerate(features)], f"id long, rings {RINGS}")


def one(df, col):
    return df.select(col.alias("v")).first()["v"]


SQUARE = [(136.90, 35.15), (136.909, 35.15), (136.909, 35.159), (136.90, 35.159), (136.90, 35.15)]


def test_area(spark):
    df = rings(spark, [SQUARE], [SQUARE[:2]], [], [SQUARE, SQUARE], [SQUARE[::-1]])
    got = [r["a"] for r in df.select(G.area_km2(F.col("rings")).alias("a")).collect()]
    assert 0.8 < got[0] < 1.2 and got[1] == 0 and got[2] == 0 and math.isclose(got[3], 2 * got[0]) and math.isclose(got[4], got[0])


def test_density_nan_and_zero(spark):
    df = spark.createDataFrame([(10, 2.0), (10, 0.0), (10, float("nan")), (10, None)], "p long, a double")
    assert [r[0] for r in df.select(G.density(F.col("p"), F.col("a"))).collect()] == [5.0, 0.0, 0.0, 0.0]


def test_classes(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.1,), (9.0,), (float("nan"),)], "v double")
    breaks = F.array(*map(F.lit, (0.0, 2.0, 4.0, 6.0)))
    assert [r[0] for r in df.select(G.classify(F.col("v"), breaks)).collect()] == [0, 0, 1, 2, 2]
    assert D.equal_interval(df.filter("v = 2"), "v", 1).first()["breaks"] == [2.0, 3.0, 4.0]
    with pytest.raises(ValueError):
        D.equal_interval(df, "v", 6)


def test_simplify_and_close(spark):
    circle = [(math.cos(t / 10), math.sin(t / 10)) for t in range(60)]
    df = rings(spark, [circle])
    ring = F.col("rings")[0]
    assert one(df, F.size(G.simplify_ring(ring, F.lit(2)))) == 16  # 15 picked and the first again
    assert one(df, F.size(G.simplify_ring(ring, F.lit(0)))) == 60
    assert one(df, F.size(G.simplify_ring(ring, F.lit(9)))) == 60  # too few would be left
    assert one(df, F.size(G.ensure_closed(ring))) == 61


def test_bbox(spark):
    assert tuple(D.dataset_bbox(rings(spark, [])).first()) == (0.0, 0.0, 0.0, 0.0)
    assert tuple(D.dataset_bbox(rings(spark, [[(1, 2), (float("nan"), 9)]])).first()) == (1.0, 2.0, 1.0, 9.0)


def test_text_rules(spark):
    df = spark.range(1)
    assert one(df, X.url_admission(F.lit("https://u:p@example.com/"), ["example.com"]))["reason"] == "credentials"
    assert one(df, X.url_admission(F.lit("http://127.0.0.1/x"), [], True))["allowed"]
    assert not one(df, X.url_admission(F.lit("https://example.net/"), ["*.example.net"]))["allowed"]
    assert one(df, X.url_admission(F.lit("ftp://example.com/"), ["example.com"]))["reason"] == "scheme"
    assert one(df, X.crs_text(F.lit('{"crs": {"id": {"authority": "EPSG", "code": 6668}}}'))) == "EPSG:6668"
    assert one(df, X.crs_text(F.lit('{"crs": "OGC:CRS84"}'))) == "OGC:CRS84"
    assert one(df, X.crs_text(F.lit("{}"))) == "EPSG:4326"
    assert one(df, X.first_text(F.lit('{"license": 4, "other": "x"}'), ["license", "other"])) == "x"
    assert one(df, X.normalize_prompt(F.lit("  A　B\tc\n"))) == "a b c"
    assert one(df, X.resolve_href(F.lit("file:///a/b"), F.lit("x/y.json"))) == "/a/b"
    assert one(df, X.resolve_href(F.lit("b"), F.lit("file:///x/y.json"))) == "/x/b"


def test_prompts(spark):
    texts = ["名古屋市の人口密度を表示", "nagoya geoparquet density", "nagoya geoparquet", "local raster", "fetch STAC from https://x.org/c.json", "nagoya", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r for r in I.route(I.tag_intent(df)).collect()}
    assert [got[i]["workflow"] for i in range(7)] == ["nagoya-density", "nagoya-geoparquet-density", "nagoya-geoparquet", "local-cog-demo", "external-stac-demo", None, None]
    assert got[0]["place"] == "名古屋市" and got[0]["matched"] == ["place:nagoya", "metric:population_density", "viz:choropleth"]
    assert [got[i]["status"] for i in (4, 5, 6)] == ["routed", "ambiguous", "empty"] and got[0]["confidence"] == 1.0


def test_geojson(spark, tmp_path):
    hole = [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]
    doc = {"type": "FeatureCollection", "name": "w", "features": [{"type": "Feature", "properties": {"a": 1}, "geometry": {"type": "Polygon", "coordinates": hole}}, {"type": "Feature", "properties": None, "geometry": {"type": "MultiPolygon", "coordinates": [hole, hole]}}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    features, meta = J.read_geojson(spark, str(tmp_path / "a.json"))
    got = features.orderBy("id").collect()
    assert [len(r["rings"]) for r in got] == [1, 2] and got[1]["properties"] is None and meta.first()["name"] == "w" and meta.first()["crs"] == "EPSG:4326"
    lines = tmp_path / "b.json"
    lines.write_text("\n".join(json.dumps(f) for f in doc["features"]))
    assert J.read_geojson_lines(spark, str(lines)).count() == 2
    for bad in ({"type": "Feature"}, {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}}]}, {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}]}):
        (tmp_path / "c.json").write_text(json.dumps(bad))
        with pytest.raises(Exception, match="FeatureCollection|geometry"):
            J.read_geojson(spark, str(tmp_path / "c.json"))[0].collect()


def test_stac(spark, tmp_path):
    item = {"type": "Feature", "id": "i", "bbox": [0, 0, 1, 1], "properties": {"license": "x"}, "assets": {"d": {"href": "a", "type": "t"}}}
    for name, text in (("a", json.dumps({"type": "FeatureCollection", "features": [item]})), ("b", "{broken"), ("c", json.dumps({"type": "Other"}))):
        (tmp_path / f"{name}.json").write_text(text)
    items, outcomes = J.read_stac_items(spark, str(tmp_path))
    row = items.first()
    assert row["id"] == "i" and row["assets"]["d"]["roles"] == [] and row["links"] == [] and row["max_x"] == 1.0
    assert sorted((r["error"] or "", r["matched"]) for r in outcomes.collect()) == [("", 1), ("corrupt response", 0), ("not a FeatureCollection", 0)]


def test_runs(spark, tmp_path):
    steps_ = [{"id": "1", "role": "planner"}, {"id": "2", "role": "verifier"}]
    (tmp_path / "a.json").write_text(json.dumps({"id": "r", "prompt": "p", "verified": False, "attempts": 0, "steps": steps_}))
    (tmp_path / "b.json").write_text(json.dumps({"id": "s", "verified": False, "steps": steps_[:1]}))
    (tmp_path / "x.txt").write_text("no")
    runs = J.read_runs(spark, str(tmp_path))
    assert runs.count() == 2 and J.read_runs(spark, str(tmp_path / "none")).count() == 0
    found = L.failure_comments(runs).collect()
    assert len(found) == 1 and found[0]["step_id"] == "2" and "1 attempt" in found[0]["body"]


def test_geoparquet_round_trip(spark, tmp_path):
    df = rings(spark, *[[SQUARE]] * 19, [SQUARE, SQUARE]).withColumn("name", F.concat(F.lit("n"), "id")).coalesce(1)
    path = str(tmp_path / "g")
    GP.write_geoparquet(df, path, row_group_rows=8, crs="EPSG:6668")
    foot = GP.geoparquet_footer(spark, path).first()
    assert foot["row_group_count"] == 3 and foot["geometry_column"] == "geometry" and foot["crs"] == "EPSG:6668"
    back = GP.read_geoparquet(spark, path)
    assert sorted(back.select("id", "rings").collect()) == sorted(df.select("id", "rings").collect())
    assert GP.read_geoparquet(spark, path, [1]).count() == 8 and GP.read_geoparquet(spark, path, []).count() == 0
    assert GP.read_geoparquet(spark, path, [0, 1, 2]).count() == 20
    with pytest.raises(Exception, match="row group"):
        GP.read_geoparquet(spark, path, [9]).count()
    plain = tmp_path / "plain.parquet"
    pq.write_table(pa.table({"a": [1]}), plain)
    with pytest.raises(Exception, match="no geo metadata"):
        GP.geoparquet_footer(spark, str(plain)).collect()
    text = back.withColumn("x", F.lit(float("nan"))).select(GP.properties_json(back.withColumn("x", F.lit(float("nan"))).select("id", "x", "rings")).alias("p")).first()["p"]
    assert json.loads(text)["x"] is None


def test_wkb():
    ring = struct.pack(">I", 4) + struct.pack(">8d", 0, 0, 1, 0, 1, 1, 0, 0)
    big = struct.pack(">BII", 0, 3, 1) + ring
    assert GP._exterior(big, 0)[0][0].tolist()[1] == [1.0, 0.0]
    assert len(GP._exterior(struct.pack(">BII", 0, 6, 2) + big + big, 0)[0]) == 2
    high = struct.pack("<BIII", 1, 1003, 1, 4) + struct.pack("<12d", *range(12))
    assert GP._exterior(high, 0)[0][0].tolist()[1] == [3.0, 4.0]
    for bad in (struct.pack("<BI", 1, 1) + bytes(16), struct.pack("<BIII", 1, 3, 1, 3) + bytes(48), struct.pack("<BII", 1, 3, 0)):
        with pytest.raises(ValueError):
            GP._exterior(bad, 0)


def tiff(tiled):
    extra = [(322, 3, 1, 256), (323, 3, 1, 256)] if tiled else []
    tags = [(256, 3, 1, 64), (257, 3, 1, 48), (277, 3, 1, 1), *extra]
    ifd = lambda after: struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", after)
    first = 8 + len(ifd(0))
    return b"II" + struct.pack("<HI", 42, 8) + ifd(first if tiled else 0) + (ifd(0) if tiled else b"")


def test_headers(spark, tmp_path):
    for name, data in (("a.tif", tiff(True)), ("b.tif", tiff(False))):
        (tmp_path / name).write_bytes(data)
    got = {r["path"][-5:]: r for r in H.raster_inventory(spark, str(tmp_path / "*.tif")).collect()}
    assert got["a.tif"]["cloud_optimized"] and not got["b.tif"]["cloud_optimized"] and got["a.tif"]["width"] == 64 and got["b.tif"]["crs"] == "unknown"
    head = bytearray(375)
    head[:4] = b"LASF"
    struct.pack_into("<H", head, 94, 375)
    struct.pack_into("<I", head, 100, 1)
    struct.pack_into("<6d", head, 179, 2, 1, 4, 3, 6, 5)
    struct.pack_into("<Q", head, 247, 518862)
    vlr = bytearray(54 + 160)
    vlr[2:6] = b"copc"
    struct.pack_into("<HH", vlr, 18, 1, 160)
    struct.pack_into("<5d2Q", vlr, 54, 1, 2, 3, 10, 0.5, 375 + len(vlr), 64)
    root = b"".join(struct.pack("<4iQ2i", level, 0, 0, 0, 1, 1, 5) for level in (0, 1))
    (tmp_path / "c.laz").write_bytes(bytes(head + vlr) + root)
    row = H.pointcloud_inventory(spark, str(tmp_path / "c.laz")).first()
    assert row["point_count"] == 518862 and row["max_z"] == 6.0 and row["hierarchy_entries"] == 2 and row["crs"] == "unknown"


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([("a", "x", "hi", 0), ("a", "x", "again", 1), ("b", "y", "yo", 2), ("c", " ", "no", 3)], "id string, author string, body string, t int").withColumn("created_at", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    df.coalesce(1).write.parquet(src)
    stream = SL.stream_comments(spark.readStream.schema(df.schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("found_comments").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r[0] for r in spark.sql("select id from found_comments order by id").collect()] == ["a", "b"]
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):  # a restart from the checkpoint writes nothing twice
        SL.stream_provenance(spark.readStream.schema(df.schema).parquet(src).withColumnRenamed("created_at", "at"), out, check, once=True).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_steps_and_sql(spark):
    steps.register_functions(spark)
    df = rings(spark, [SQUARE])
    df.createOrReplaceTempView("f")
    assert math.isclose(spark.sql("select feature_area_km2(rings) a from f").first()["a"], one(df, G.area_km2(F.col("rings"))))
    assert spark.sql("select class_color(density_class(3D, array(0D, 2D, 4D)))").first()[0] == G.PALETTE[1]
    out = steps.run_steps(df, [steps.Step("n", lambda d: d.withColumn("n", F.size("rings")), "id long, n int")])
    assert out.first()["n"] == 1
    with pytest.raises(ValueError):
        steps.run_steps(df, [steps.Step("n", lambda d: d, "n int")])


def test_merges(spark):
    a = spark.createDataFrame([("1", "old", 1), ("2", "keep", 5)], "id string, body string, created_at int")
    b = spark.createDataFrame([("1", "new", 2), ("2", "late", 4)], "id string, body string, created_at int")
    assert {r["id"]: r["body"] for r in L.merge_comments(a, b).collect()} == {"1": "new", "2": "keep"}
    empty = spark.createDataFrame([], "name string, created_at int")
    assert [r["name"] for r in L.merge_branches(empty, empty).collect()] == ["main"]
    hits = spark.createDataFrame([("e", 0, "i", None, 0.0, 0.0, 1.0, 1.0)] * 2, "endpoint_id string, ord int, id string, collection string, min_x double, min_y double, max_x double, max_y double")
    assert E.federated_search(hits).first()["source_endpoints"] == ["e"]
