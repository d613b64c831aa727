"""Layouts, pruning and skew: what is read, what is a key, what a task sees."""

import json
import math
import random
import struct
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from terrasheaf.functions import geometry as G
from terrasheaf.operators import catalog, curve, density, logs, tiles
from terrasheaf.sources import geoparquet, headers
from terrasheaf.sources.files import Blocks, running_totals
from terrasheaf.streaming.logs import land_comments, stream_provenance


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 20_000)
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    """Files that the scan of a filtered DataFrame opens, after row groups and files are skipped by statistics."""
    return df.select(F.input_file_name()).distinct().count()


def test_curve(spark):
    points = [(0, 0), (1, 0), (0, 1), (5, 9), (2**31 - 1, 2**31 - 1), (2**30, 3)]
    want = [int("".join(a + b for a, b in zip(f"{y:031b}", f"{x:031b}", strict=True)), 2) for y, x in points]
    got = spark.createDataFrame(points, "y long, x long").select(curve.morton(F.col("y"), F.col("x")).alias("k"))
    assert [r["k"] for r in got.collect()] == want


@pytest.mark.parametrize("most", [1, 2, 5, 16, 1000])
def test_cover_holds_every_point(most):
    rng = random.Random(most)
    key = lambda y, x: int("".join(a + b for a, b in zip(f"{y:05b}", f"{x:05b}", strict=True)), 2)
    for _ in range(30):
        y0, x0 = rng.randrange(30), rng.randrange(30)
        y1, x1 = y0 + rng.randrange(1, 9), x0 + rng.randrange(1, 9)
        ranges = curve.cover(y0, y1, x0, x1, most)
        assert len(ranges) <= most and all(a <= b for a, b in ranges) and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
        inside = {key(y, x) for y in range(y0, min(y1, 31) + 1) for x in range(x0, min(x1, 31) + 1)}
        covered = {k for a, b in ranges for k in range(a, min(b, 1023) + 1)}
        assert inside <= covered
        if most == 1000 and max(y1, x1) < 32:
            assert inside == covered
    assert curve.cover(5, 4, 0, 3) == [] and curve.cover(-9, -1, 0, 3) == []


def raster_tiles(spark, side, tile, rasters=2):
    n = side // tile
    cells = spark.range(rasters).select(F.col("id").alias("raster_id")).crossJoin(spark.range(n * n).select((F.col("id") / n).cast("int").alias("tile_row"), (F.col("id") % n).cast("int").alias("tile_col")))
    pixel = lambda i: (F.col("raster_id") * 7 + (F.col("tile_row") * tile + F.floor(i / tile)) * side + F.col("tile_col") * tile + i % tile).cast("int")
    return cells.withColumn("pixels", F.transform(F.sequence(F.lit(0), F.lit(tile * tile - 1)), pixel)).select("*", *(F.lit(v).alias(n) for n, v in (("w", tile), ("h", tile), ("width", side), ("height", side))))


def test_window_reads_the_files_it_meets(spark, tmp_path):
    grid = raster_tiles(spark, 256, 8)
    path = str(tmp_path / "rasters")
    tiles.write_raster_tiles(grid, path, 32)
    for window in ((0, 0, 8, 8), (100, 60, 17, 3), (0, 0, 256, 256), (255, 255, 1, 1)):
        got = tiles.read_raster_window(spark, path, *window)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tiles.raster_window(grid, *window).collect()))
    plan = plan_of(tiles.read_raster_window(spark, path, 100, 60, 17, 3))
    assert "GreaterThanOrEqual(tile_key" in plan and "LessThanOrEqual(tile_key" in plan and "LessThan(y0,117)" in plan
    stored = spark.read.parquet(f"{path}/tiles")
    near = lambda *w: stored.filter(curve.in_ranges(F.col("tile_key"), curve.cover(*w)))
    assert files_read(stored) >= 24 and files_read(near(0, 7, 0, 7)) <= 2 and files_read(near(0, 63, 0, 63)) <= 6
    for window in ((250, 0, 7, 1), (-1, 0, 2, 2)):
        with pytest.raises(Exception, match="window outside the raster"):
            tiles.read_raster_window(spark, path, *window).collect()


def test_pyramid_levels_and_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(str(k), [[(rng.random() * 10 + k % 9, rng.random() * 10) for _ in range(rng.choice([1, 2, 4, 5, 9, 40, 300]))] for _ in range(rng.randrange(1, 4))]) for k in range(60)] + [("none", []), ("flat", [[]])]
    features = spark.createDataFrame(rows, "ward_code string, rings array<array<struct<x: double, y: double>>>")
    tiled = tiles.tile_features(features, 7, 5, 9)
    direct = features.filter("ward_code not in ('none', 'flat')").withColumn("lod", F.explode(F.sequence(F.lit(0), F.lit(8)))).select("ward_code", "lod", F.transform("rings", lambda r: G.simplify_ring(r, F.col("lod"))).alias("rings"))
    assert sorted(map(str, tiled.select("ward_code", "lod", "rings").collect())) == sorted(map(str, direct.collect()))
    path = str(tmp_path / "tiles")
    tiles.write_tiles(tiled, path, 6)
    assert 3 <= len(list(Path(path).glob("*.parquet"))) <= 6
    some = tiles.read_tiles(spark, path, 2, (1, 3), (0, 2))
    want = tiled.filter("lod = 2 and tx between 1 and 3 and ty between 0 and 2")
    assert sorted(map(str, some.select("ward_code", "tx", "ty").collect())) == sorted(map(str, want.select("ward_code", "tx", "ty").collect()))
    assert "EqualTo(lod,2)" in plan_of(some) and "(tile_key," in plan_of(some)


def stored_wards(spark, path, n=400, parts=3, group=25):
    ring = lambda k: F.array(*(F.struct((k + dx).cast("double").alias("x"), (k * 0 + dy).cast("double").alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 0))))
    rows = spark.range(n).repartitionByRange(parts, "id").sortWithinPartitions("id").select(F.concat(F.lit("w"), "id").alias("ward_code"), F.col("id").alias("k"), F.when(F.col("id") % 7 != 3, F.array(ring(F.col("id")))).alias("rings"))
    geoparquet.write_geoparquet(rows, path, row_group_rows=group)


def test_row_groups_are_skipped_and_columns_pruned(spark, tmp_path):
    path = str(tmp_path / "wards")
    stored_wards(spark, path)
    assert all(p.suffix == ".parquet" for p in Path(path).iterdir() if p.name[0] not in "._")
    stats = geoparquet.row_group_stats(spark, path)
    box = (100.2, 0.0, 130.0, 1.0)
    assert stats.count() >= 16 and geoparquet._meeting(stats, box).count() <= 4
    assert all(r["min_x"] <= r["max_x"] for r in stats.collect())
    assert stats.agg(F.sum("rows"), F.sum("kept")).first()[:2] == (400, sum(k % 7 != 3 for k in range(400)))
    read = geoparquet.read_geoparquet(spark, path, ids=True, columns=["k"], box=box)
    want = [k for k in range(100, 131) if k % 7 != 3 and k + 1 >= 100.2 and k <= 130]
    assert sorted(r["k"] for r in read.collect()) == want and read.columns == ["k", "id", "rings"]
    whole = geoparquet.read_geoparquet(spark, path, columns=["k"], box=box)
    assert sorted(r["k"] for r in whole.collect()) == want
    assert "ward_code" not in plan_of(whole) and "LessThanOrEqual(min_x,130.0)" in plan_of(whole)
    read_columns = geoparquet.read_geoparquet(spark, path, row_groups=[0], columns=["ward_code"])
    assert read_columns.columns == ["ward_code", "rings"] and "k#" not in plan_of(read_columns).split("MapInArrow")[1].split("\n")[0]


def test_ids_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "wards")
    stored_wards(spark, path)
    read = geoparquet.read_geoparquet(spark, path, ids=True)
    assert "row_index" not in plan_of(read)
    files = sorted(str(p) for p in Path(path).glob("*.parquet"))
    import pyarrow.parquet as pq

    want = [k for f in files for k, g in zip(pq.read_table(f)["k"].to_pylist(), pq.read_table(f)["geometry"].to_pylist(), strict=True) if g is not None]
    assert [r["k"] for r in read.orderBy("id").collect()] == want
    assert [r["id"] for r in read.select("id").orderBy("id").collect()] == list(range(len(want)))
    first = geoparquet.read_geoparquet(spark, path, row_groups=[1], ids=True)
    assert [r["id"] for r in first.select("id").orderBy("id").collect()] == list(range(first.count()))
    assert geoparquet.read_geoparquet(spark, path, row_groups=[], ids=True).count() == 0


def test_running_totals(spark):
    rows = [(f"f{k:03}", (k * 37) % 11) for k in range(300)]
    random.Random(3).shuffle(rows)
    got = running_totals(spark.createDataFrame(rows, "name string, n long"), "name", "n", "before").orderBy("name").collect()
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["n"]
    assert len(got) == 300


def test_common_tags_are_no_keys(spark, monkeypatch):
    monkeypatch.setattr(catalog, "HOT_RECORDS", 50)
    monkeypatch.setattr(catalog, "HOT_TAGS", 10**9)
    rng = random.Random(5)
    records = [(str(k), ["all", f"g{k % 40}", f"t{rng.randrange(9)}", f"t{rng.randrange(9)}"]) for k in range(2000)]
    requests = [("a", ["all", "g7"]), ("b", ["all", "t1", "t2", "t2"]), ("c", ["all"]), ("d", ["all", "absent"]), ("e", []), ("f", ["g3", "g4"])]
    want_all, wanted = spark.createDataFrame(records, "id string, tags array<string>"), spark.createDataFrame(requests, "request_id string, required array<string>")
    got = sorted(tuple(r) for r in catalog.bind_datasets(wanted, want_all).collect())
    assert got == sorted((q, i) for q, need in requests for i, have in records if need and set(need) <= set(have))
    few = wanted.filter("request_id <> 'c'")
    counts = catalog.tag_counts(want_all)
    rare = catalog.rarest_tags(few, counts)
    offered = catalog.offered_tags(want_all, rare, counts)
    assert offered.filter("tag = 'all'").count() == 0
    assert {r["request_id"]: r["tag"] in ("g7", "t1", "t2", "g3", "g4") for r in rare.collect()} == {"a": True, "b": True, "f": True}
    slots = catalog.offered_tags(want_all, catalog.rarest_tags(wanted, counts), counts).filter("tag = 'all'").groupBy("slot").count().collect()
    assert len(slots) == 40 and max(r["count"] for r in slots) < 150


def test_medians_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(density, "LARGE_VALUES", 100)
    rng = random.Random(2)
    rows = [("wide", rng.randrange(-(2**63), 2**63)) for _ in range(2001)] + [("near", rng.randrange(-300, 300)) for _ in range(3000)] + [("few", rng.randrange(5)) for _ in range(800)] + [(None, k * k) for k in range(500)] + [("even", k) for k in range(1000)] + [("one", 7), ("one", None)]
    got = {r["g"]: tuple(r)[1:] for r in density.timing_summary(spark.createDataFrame(rows, "g string, v long"), "g", "v").collect()}
    for g in {r[0] for r in rows}:
        values = sorted(v for name, v in rows if name == g and v is not None)
        mean = abs(sum(values)) // len(values) * (1 if sum(values) >= 0 else -1)
        assert got[g] == (values[0], values[-1], mean, values[len(values) // 2]), g
    assert len(got) == 6


def test_equal_area(spark):
    """The whole ellipsoid and single degrees against the areas of the authalic sphere and of numeric integration."""
    boxes = [(-180.0, -90.0, 180.0, 90.0), (10.0, 0.0, 11.0, 1.0), (10.0, 59.0, 11.0, 60.0), (-5.0, -80.0, -4.0, -79.0)]
    frame = spark.createDataFrame(boxes, "a double, b double, c double, d double").select(G.equal_area_km2(F.array(G.bbox_polygon(F.col("a"), F.col("b"), F.col("c"), F.col("d")))).alias("km2"))
    got = [r["km2"] for r in frame.collect()]
    assert got[0] == pytest.approx(510065621.724, rel=1e-9)
    e2, a = G.ECCENTRICITY2, G.SEMI_MAJOR_KM

    def integral(box, steps=20000):
        low, high = math.radians(box[1]), math.radians(box[3])
        total = 0.0
        for k in range(steps):
            lat = low + (k + 0.5) * (high - low) / steps
            total += math.cos(lat) / (1 - e2 * math.sin(lat) ** 2) ** 2
        return a * a * (1 - e2) * total * (high - low) / steps * math.radians(box[2] - box[0])

    for value, box in zip(got[1:], boxes[1:], strict=True):
        assert value == pytest.approx(integral(box), rel=1e-6)


def test_hierarchy_pages(spark, tmp_path):
    """Three levels of pages, a page that two entries point to, one that points back, and one outside the file."""
    node = lambda level, at, size, points: struct.pack("<4iQ2i", level, 0, 0, 0, at, size, points)
    page = [b"", b"", b""]
    page[2] = node(3, 0, 1, 4) + node(3, 0, 1, 0) + node(1, 0, 64, -1)
    page[1] = node(1, 0, 1, 5) + node(2, 0, 1, 6) + node(3, 64 + 96, 96, -1) + b""
    page[0] = node(0, 0, 1, 7) + node(1, 64, 96, -1)
    data = page[0] + page[1] + page[2]
    import pyarrow as pa

    assert headers.hierarchy(Blocks(pa.BufferReader(data)), (0, 64)) == [(0, 1, 7), (1, 1, 5), (2, 1, 6), (3, 2, 4)]
    with pytest.raises(ValueError, match="outside"):
        headers.hierarchy(Blocks(pa.BufferReader(node(0, 5000, 64, -1))), (0, 32))


def test_provenance_can_be_appended_again(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("b", "2024-01-02 10:00:00"), ("b", "2024-01-02 10:00:00"), ("c", None)], "entry_id string, at string").withColumn("at", F.to_timestamp("at"))
    logs.append_provenance(rows.filter("entry_id = 'a'"), path)
    for _ in range(3):
        logs.append_provenance(rows, path)
    assert sorted(r["entry_id"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    rows.write.parquet(str(tmp_path / "in"))
    for k in range(2):  # the second stream knows nothing of the first
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        stream_provenance(stream, str(tmp_path / "streamed"), str(tmp_path / f"offsets{k}"), once=True).awaitTermination()
    assert sorted(r["entry_id"] for r in spark.read.parquet(str(tmp_path / "streamed")).collect()) == ["a", "b", "c"]


def test_comments_a_day_late(spark, tmp_path):
    source, path, offsets = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "offsets")
    source.mkdir()
    kind = "id string, author string, body string, created_at timestamp"
    for name, said in (("1", [("x", "a", "first", "2024-01-01T00:00:00Z"), ("x", "a", "second", "2024-01-01T00:01:00Z"), ("y", "", "blank", "2024-01-01T00:00:00Z")]), ("2", [("z", "b", "new", "2024-01-05T00:00:00Z")]), ("3", [("x", "a", "late", "2024-01-02T00:00:00Z"), ("w", "c", "old but new", "2023-01-01T00:00:00Z")])):
        (source / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("id", "author", "body", "created_at"), s, strict=True))) for s in said))
        land_comments(spark.readStream.schema(kind).json(str(source)), path, offsets, once=True).awaitTermination()
    assert sorted((r["id"], r["body"]) for r in spark.read.parquet(path).collect()) == [("w", "old but new"), ("x", "first"), ("z", "new")]


def test_first_row_groups_of_many_files(spark, tmp_path):
    """Over 20,000 wards lie in several files, of each of which the first row group is read."""
    from terrasheaf.queries import ORACLE_SQL, QUERIES

    names = spark.sql("select id p_partkey, concat('w', id) p_name, cast(id % 50 as int) p_size from range(0, 25003)")
    names.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = tuple(QUERIES["s05_row_groups"](spark, str(tmp_path)).first())
    assert got == (300, 0, 25_003)
    duck = duckdb.connect()
    duck.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert got == duck.execute(ORACLE_SQL["s05_row_groups"]).fetchone()


def test_neighbouring_row_groups_are_read_together(spark, tmp_path, monkeypatch):
    """Files end after so many row groups; a task opens a file once for many of them, ids and rows as in the files."""
    monkeypatch.setattr(geoparquet, "FILE_GROUPS", 30)
    path = str(tmp_path / "wards")
    stored_wards(spark, path, n=400, parts=1, group=5)
    assert geoparquet.geoparquet_footer(spark, path).agg(F.max("row_group_count"), F.count("*")).first()[:2] == (30, 3)
    read = geoparquet.read_geoparquet(spark, path, ids=True)
    assert read.rdd.getNumPartitions() == 3  # 80 row groups
    rows = read.orderBy("id").collect()
    assert [(r["id"], r["k"]) for r in rows] == list(enumerate(k for k in range(400) if k % 7 != 3))
    monkeypatch.setattr(geoparquet, "READ_BYTES", 1000)
    assert geoparquet.read_geoparquet(spark, path, ids=True).orderBy("id").collect() == rows


def test_tags_are_compared_once_for_a_set(spark, monkeypatch):
    """Records and requests of equal tags share one comparison; repeated ids and sets give a pair once."""
    records = [(f"r{k}", ["all", f"g{k % 3}"][:: 1 if k % 2 else -1]) for k in range(300)] + [("r0", ["all", "g1"])]
    requests = [(f"q{k}", ["g1", "all", "g1"]) for k in range(50)] + [("q0", ["all"]), ("q0", ["all"]), ("none", None)]
    offered, asked = spark.createDataFrame(records, "id string, tags array<string>"), spark.createDataFrame(requests, "request_id string, required array<string>")
    once = [F.array_sort(F.array_distinct(c)).alias(c) for c in ("tags", "required")]
    assert catalog.matching_sets(asked.select(once[1]), offered.select(once[0])).count() == 4
    want = sorted({(q, i) for q, need in requests for i, have in records if need and set(need) <= set(have)})
    for hot in (100_000, 20):
        monkeypatch.setattr(catalog, "HOT_RECORDS", hot)
        assert sorted(tuple(r) for r in catalog.bind_datasets(asked, offered).collect()) == want


def test_rows_of_a_hot_key_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(density, "SOURCE_ROWS", 50)
    rows = spark.range(400).select("id", F.when(F.col("id") % 10 > 0, F.lit(1)).when(F.col("id") % 20 > 0, F.col("id")).alias("dataset_id")).coalesce(1)
    cited = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (10, "c"), (30, None)], "dataset_id long, citation string")
    got = density.attach_sources(rows, cited)
    want = {k: ["a", "b"] if k % 10 else ["c"] if k == 10 else [] for k in range(400)}
    assert {r["id"]: r["sources"] for r in got.collect()} == want and got.columns == ["id", "dataset_id", "sources"]
    tasks = got.filter("dataset_id = 1").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 120
    texts = density.attach_sources(rows, cited, joined="; ")
    assert {r["id"]: r["sources"] for r in texts.collect()} == {k: "; ".join(v) for k, v in want.items()}
