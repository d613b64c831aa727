"""FeatureCollection files read in byte ranges: the same features as in one task, wherever the ranges are cut."""

import json
import random

import pytest

from terrasheaf.sources import json_features, json_splits


def feature(k, rng):
    ring = [[k, 0], [k + 1, 0.5], [k + 1, 1e1], [k, 0]]
    text = rng.choice(['a "quoted" name', "back\\slash\\\\", "[{,}]", '\\"', "üあ😀", ""]) * rng.randrange(4)
    kind = {"type": "Polygon", "coordinates": [ring, ring]} if k % 3 else {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}
    return {"type": "Feature", "properties": {"k": k, "text": text, "list": [[1, {"features": [1, 2]}], "x,y"], "none": None}, "geometry": kind}


def document(n, rng, indent=None, after=True):
    doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:6668", "features": [{"a": [1, 2]}, {}]}}, "extra": ["features", {"features": [3]}]}
    doc["features"] = [feature(k, rng) for k in range(n)]
    if after:
        doc |= {"name": "w\\\\ards", "more": [[], [1], {"features": []}], "bbox": [0, 0, 1, 1]}
    return json.dumps(doc, indent=indent, ensure_ascii=False)


def rows(df):
    return [(r["id"], r["properties"], r["rings"]) for r in df.orderBy("id").collect()]


@pytest.mark.parametrize(("n", "split", "step", "indent"), [(0, 50, 7, None), (1, 40, 16, None), (40, 101, 13, 1), (40, 1 << 20, 1 << 20, None), (25, 700, 4096, None)])
def test_ranges_give_what_one_task_gives(spark, tmp_path, monkeypatch, n, split, step, indent):
    (tmp_path / "a.geojson").write_text(document(n, random.Random(n + split), indent, after=n != 25), encoding="utf-8")
    path = str(tmp_path / "a.geojson")
    monkeypatch.setattr(json_splits, "STEP_BYTES", step)
    features, meta = json_features.read_geojson(spark, path, split)
    monkeypatch.setattr(json_features, "splittable", lambda *_: False)
    whole, theirs = json_features.read_geojson(spark, path)
    assert len(rows(whole)) == n and meta.collect() == theirs.collect()
    mine = rows(features)
    assert [(i, json.loads(p), g) for i, p, g in mine] == [(i, json.loads(p), g) for i, p, g in rows(whole)]


def test_a_scanner_does_not_depend_on_where_it_is_cut():
    import numpy as np

    text = np.frombuffer(document(6, random.Random(2)).encode(), np.uint8)
    whole = json_splits.Scanner(False, False, 0)
    change, after = whole.feed(text)
    for cut in range(0, len(text), 3):
        scan = json_splits.Scanner(False, False, 0)
        one, two = scan.feed(text[:cut]), scan.feed(text[cut:])
        assert (np.r_[one[1], two[1]] == after).all() and (np.r_[one[0], two[0]] == change).all()
    assert whole.depth == 0 and not whole.inside


def test_one_file_gives_many_tasks(spark, tmp_path):
    rng = random.Random(4)
    (tmp_path / "big.geojson").write_text(document(3000, rng))
    size = (tmp_path / "big.geojson").stat().st_size
    elements, _ = json_splits.feature_texts(spark, str(tmp_path / "big.geojson"), size // 20)
    counts = [r["count"] for r in elements.groupBy(json_splits.F.spark_partition_id()).count().collect()]
    assert elements.rdd.getNumPartitions() >= 20 and len(counts) >= 12 and max(counts) < 3000 / 4
    assert [r["id"] for r in elements.select("id").orderBy("id").collect()] == list(range(3000))


def test_several_files_and_errors(spark, tmp_path):
    for k in (2, 5):
        (tmp_path / f"{k}.geojson").write_text(document(k, random.Random(k)))
    features, meta = json_features.read_geojson(spark, str(tmp_path / "*.geojson"), 90)
    assert sorted(r["id"] for r in features.collect()) == [0, 0, 1, 1, 2, 3, 4] and meta.count() == 2
    for text, says in (('{"type": "Topology", "features": []}', "not a FeatureCollection"), ('{"type": "FeatureCollection"}', "not a FeatureCollection"), ('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": null}]}', "feature without geometry"), ('{"type": "FeatureCollection", "features": [7]}', "feature without geometry")):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(Exception, match=says):
            json_features.read_geojson(spark, str(tmp_path / "bad.json"), 16)[0].collect()


def test_small_ranges_share_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_splits, "RANGE_TASKS", 5)
    (tmp_path / "big.geojson").write_text(document(300, random.Random(6)))
    elements, _ = json_splits.feature_texts(spark, str(tmp_path / "big.geojson"), 500)
    assert elements.rdd.getNumPartitions() == 5
    assert [r["id"] for r in elements.select("id").orderBy("id").collect()] == list(range(300))
