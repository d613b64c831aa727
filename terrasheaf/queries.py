"""The registered geospatial queries, each with DuckDB SQL for the same rows. Keys start with the operator's id."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrasheaf.functions import geometry as G
from terrasheaf.functions import text as X
from terrasheaf.operators import catalog as C
from terrasheaf.operators import density as D
from terrasheaf.operators import federation as E
from terrasheaf.operators import intent as I
from terrasheaf.operators import logs as L
from terrasheaf.operators import tiles as T
from terrasheaf.oracle_views import oracle
from terrasheaf.plans import steps
from terrasheaf.sources import geoparquet as GP
from terrasheaf.sources import headers as H
from terrasheaf.sources import json_features as J
from terrasheaf.sources.files import scratch
from terrasheaf.streaming import logs as SL
from terrasheaf.views import view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MEDIA = ("application/vnd.apache.parquet", "image/tiff")
SEARCH_BOX = (135.0, 32.0, 155.0, 38.0)
HOSTS = ("example.com", "*.example.net", "tion.example.org")


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def wards(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_wards")


def boxed(spark: SparkSession, d: str) -> DataFrame:
    """v_wards with the map box as a struct column `box`."""
    w = wards(spark, d)
    return w.join(F.broadcast(D.dataset_bbox(w).select(F.struct("*").alias("box"))))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


# geometry

@query("f01_ring_area", "SELECT ward_code, ring_no, round(area,6) area FROM v_area")
def _(s, d):
    rings = wards(s, d).select("ward_code", F.posexplode("rings").alias("ring_no", "ring"))
    return rings.select("ward_code", F.col("ring_no").cast("long").alias("ring_no"), r(G.ring_area_km2(F.col("ring"))).alias("area"))


@query("a04_feature_area", "SELECT ward_code, round(area_km2,6) area_km2 FROM v_density")
def _(s, d):
    return D.with_density(wards(s, d)).select("ward_code", r("area_km2").alias("area_km2"))


@query("f02_density", "SELECT ward_code, round(density_per_km2,3) density_per_km2 FROM v_density")
def _(s, d):
    return D.with_density(wards(s, d)).select("ward_code", r("density_per_km2", 3).alias("density_per_km2"))


@query("a01_dataset_bbox", "SELECT round(min_x,6) min_x, round(min_y,6) min_y, round(max_x,6) max_x, round(max_y,6) max_y FROM v_box")
def _(s, d):
    return D.dataset_bbox(wards(s, d)).select(*(r(c).alias(c) for c in E.BOX))


@query("a02_dataset_summary", "SELECT 'wards' AS name, (SELECT count(*) FROM v_wards) feature_count, 'EPSG:4326' AS crs, round(min_x,6) min_x, round(max_y,6) max_y FROM v_box")
def _(s, d):
    return D.dataset_summary(wards(s, d), "wards", "EPSG:4326").select("name", "feature_count", "crs", r("min_x").alias("min_x"), r("max_y").alias("max_y"))


@query("a03_value_range", "SELECT round(min(density_per_km2),3) lo, round(max(density_per_km2),3) hi FROM v_density")
def _(s, d):
    return D.value_range(D.with_density(wards(s, d)), "density_per_km2").select(r("lo", 3).alias("lo"), r("hi", 3).alias("hi"))


@query("f05_equal_interval", "SELECT generate_subscripts(b,1)-1 AS i, round(unnest(b),3) AS value FROM v_breaks")
def _(s, d):
    b = D.equal_interval(D.with_density(wards(s, d)), "density_per_km2").select(F.posexplode("breaks").alias("i", "value"))
    return b.select(F.col("i").cast("long").alias("i"), r("value", 3).alias("value"))


@query("f06_f07_classes", "SELECT ward_code, cast(cls AS int) AS class, ['#edf4fc','#bfd8f2','#72ade0','#3372bf','#0c3f8c'][cls+1] AS color FROM v_classed")
def _(s, d):
    return D.population_density(wards(s, d)).select("ward_code", "class", "color")


@query("c01_population_density", "SELECT ward_code, ward_name, population, round(area_km2,6) area_km2, round(density_per_km2,3) density_per_km2, ['#edf4fc','#bfd8f2','#72ade0','#3372bf','#0c3f8c'][cls+1] AS color FROM v_classed")
def _(s, d):
    good, _ = D.require_attributes(wards(s, d))
    return D.population_density(good).select("ward_code", "ward_name", "population", r("area_km2").alias("area_km2"), r("density_per_km2", 3).alias("density_per_km2"), "color")


def _some_empty(w: DataFrame) -> DataFrame:
    """Wards of which every 500th has no people."""
    return w.withColumn("population", F.when(F.col("ward_code").cast("long") % 500 == 0, 0).otherwise(F.col("population")))


def _n_parts(s, d) -> int:
    return s.read.parquet(f"{d}/part.parquet").count()


@query("c02_density_checks", """SELECT kind, unnest(['crs_declared','area_method_recorded','population_positive','density_unit','feature_count','boundary_source']) AS name,
  unnest([kind<>'local', true, bool_and(population>0 AND (kind<>'empty' OR cast(ward_code AS bigint)%500<>0)), true, kind<>'local', true]) AS passed,
  count(*) FILTER (WHERE area_km2<=0) n_flat FROM v_density, (SELECT unnest(['all','empty','local']) kind) GROUP BY kind""")
def _(s, d):
    w, n = D.with_density(wards(s, d)), _n_parts(s, d)
    cases = {"all": (w, "EPSG:4326", n), "empty": (_some_empty(w), "EPSG:4326", n), "local": (w, "local", n + 1)}
    out = None
    for kind, (df, crs, expected) in cases.items():
        checks = D.density_checks(df, crs, expected).join(F.broadcast(df.agg(F.count_if(F.col("area_km2") <= 0).alias("n_flat")))).select(F.lit(kind).alias("kind"), "name", "passed", "n_flat")
        out = checks if out is None else out.unionByName(checks)
    return out


@query("a07_verify_density", "SELECT count(*) n, count(*) FILTER (WHERE area_km2>0 AND abs(density_per_km2-population/area_km2)<0.01) n_right FROM v_density")
def _(s, d):
    return D.verify_density(D.with_density(wards(s, d))).select("n", "n_right")


@query("a05_top_density", "SELECT ward_code, round(density_per_km2,3) density_per_km2 FROM v_density ORDER BY v_density.density_per_km2 DESC, ward_code DESC LIMIT 1")
def _(s, d):
    return D.top_density(D.with_density(wards(s, d))).select("ward_code", r("density_per_km2", 3).alias("density_per_km2"))


@query("a10_review_status", "SELECT kind, CASE WHEN bool_and(population>0 AND (kind='all' OR cast(ward_code AS bigint)%500<>0)) THEN 'executed' ELSE 'pending_review' END AS status FROM v_density, (SELECT unnest(['all','empty']) kind) GROUP BY kind")
def _(s, d):
    w, n = D.with_density(wards(s, d)), _n_parts(s, d)
    status = lambda kind, df: D.review_status(D.density_checks(df, "EPSG:4326", n)).select(F.lit(kind).alias("kind"), "status")
    return status("all", w).unionByName(status("empty", _some_empty(w)))


@query("c03_verify_features", "SELECT p_size%2=0 AS halved, (SELECT count(*) FROM part) - (CASE WHEN p_size%2=0 THEN count(*) ELSE 0 END) feature_count, p_size%2<>0 AS passed FROM part GROUP BY p_size%2")
def _(s, d):
    n, w = _n_parts(s, d), wards(s, d)
    whole, odd = D.verify_features(w, "EPSG:4326", n), D.verify_features(w.filter("population div 1000 % 2 <> 0"), "EPSG:4326", n)
    return whole.select(F.lit(False).alias("halved"), "*").unionByName(odd.select(F.lit(True).alias("halved"), "*"))


@query("c07_analysis_summary", "SELECT 'map density' AS goal, 'wards' AS dataset, count(*) feature_count, bool_and(population>0) AS all_passed, round(max(density_per_km2),3) top_density, max_by(ward_name, {'d': density_per_km2, 'c': ward_code}) AS top_name FROM v_density")
def _(s, d):
    out = D.analysis_summary(D.with_density(wards(s, d)), "map density", "wards", "EPSG:4326", _n_parts(s, d))
    return out.select("goal", "dataset", "feature_count", "all_passed", r("top_density", 3).alias("top_density"), "top_name")


@query("c08_execution_receipt", "SELECT 'data/wards.parquet' AS source_uri, 'EPSG:4326' AS crs, bool_and(population>0 AND cast(ward_code AS bigint)%500<>0) AS passed FROM v_density")
def _(s, d):
    summary = D.analysis_summary(D.with_density(_some_empty(wards(s, d))), "map density", "wards", "EPSG:4326", _n_parts(s, d))
    return L.execution_receipt(summary, "data/wards.parquet", "wards", "EPSG:4326", D.UNIT, "unknown", "density").select("source_uri", "crs", "passed")


@query("f13_legend", "SELECT i AS class, cast(round_even(b[i+1],0) AS bigint)::varchar || ' – ' || cast(round_even(b[i+2],0) AS bigint)::varchar || ' persons/km²' AS label FROM v_breaks, (SELECT unnest(range(0,5)) i)")
def _(s, d):
    return D.legend(D.equal_interval(D.with_density(wards(s, d)), "density_per_km2")).select(F.col("class").cast("long").alias("class"), "label")


@query("f03_bbox_polygon", "SELECT id, round(min_x,6) x1, round(min_y,6) y1, round(max_x,6) x3, round(max_y,6) y3, 5 AS n FROM v_catalog")
def _(s, d):
    p = view(s, d, "v_catalog").select("id", G.bbox_polygon(*(F.col(c) for c in E.BOX)).alias("p"))
    return p.select("id", r(F.col("p")[0]["x"]).alias("x1"), r(F.col("p")[0]["y"]).alias("y1"), r(F.col("p")[2]["x"]).alias("x3"), r(F.col("p")[2]["y"]).alias("y3"), F.size("p").alias("n"))


@query("f04_ensure_closed", "SELECT ward_code, ring_no, len(ring) + (CASE WHEN len(ring)>=2 AND (ring[1].x<>ring[len(ring)].x OR ring[1].y<>ring[len(ring)].y) THEN 1 ELSE 0 END) AS n FROM v_rings")
def _(s, d):
    rings = wards(s, d).select("ward_code", F.posexplode("rings").alias("ring_no", "ring"))
    return rings.select("ward_code", F.col("ring_no").cast("long").alias("ring_no"), F.size(G.ensure_closed(F.col("ring"))).cast("long").alias("n"))


@query("a13_centroid", "SELECT ward_code, round(cx,6) cx, round(cy,6) cy FROM v_centroid")
def _(s, d):
    c = wards(s, d).select("ward_code", G.vertex_centroid(F.col("rings")).alias("c")).filter("c is not null")
    return c.select("ward_code", r("c.x").alias("cx"), r("c.y").alias("cy"))


_TX = "cast(least(greatest(floor((cx-min_x)/greatest(max_x-min_x,1e-9)*7),0),6) AS int)"
_TY = "cast(least(greatest(floor((cy-min_y)/greatest(max_y-min_y,1e-9)*5),0),4) AS int)"


@query("f08_tile_for_point", f"SELECT ward_code, {_TX} tx, {_TY} ty FROM v_centroid, v_box")
def _(s, d):
    c = boxed(s, d).withColumn("c", G.vertex_centroid(F.col("rings"))).filter("c is not null")
    return c.select("ward_code", G.tile_for_point(F.col("c.x"), F.col("c.y"), F.col("box"), 7, 5).alias("t")).select("ward_code", "t.tx", "t.ty")


@query("c11_tile_pyramid", f"""SELECT lod, {_TX} tx, {_TY} ty, count(*) n_features,
  cast(sum(list_sum(list_transform(rings, lambda g: CASE WHEN len(g)<=4 OR lod=0 THEN len(g) WHEN lod=1 THEN (CASE WHEN len(g)=5 THEN 5 ELSE len(g) END) ELSE len(g) END))) AS bigint) AS n_vertices
  FROM v_wards JOIN v_centroid USING (ward_code), v_box, (SELECT unnest([0,1,2]) lod) GROUP BY 1,2,3""")
def _(s, d):
    return T.tile_counts(T.tile_features(wards(s, d), 7, 5, 3))


@query("a14_tile_features", f"SELECT ward_code, lod, {_TX} tx, {_TY} ty FROM v_centroid, v_box, (SELECT unnest([0,1,2]) lod)")
def _(s, d):
    return T.tile_features(wards(s, d), 7, 5, 3).select("ward_code", "lod", "tx", "ty")


_THINNED = "list_transform(list_filter(range(0,32), lambda i: i % (1 << least(lod,6)) = 0), lambda i: e[2*i+1]::double)"


@query("f09_simplify", f"""SELECT vec_id, lod, CASE WHEN lod=0 OR k<3 THEN 32 ELSE k+1 END AS n, round(CASE WHEN lod=0 OR k<3 THEN list_sum(list_transform(range(0,32), lambda i: e[2*i+1]::double)) ELSE list_sum(xs)+xs[1] END, 6) AS sum_x
  FROM (SELECT vec_id, lod, e, {_THINNED} xs, len({_THINNED}) k FROM (SELECT vec_id, embedding e, unnest(range(0,8)) lod FROM embeddings))""")
def _(s, d):
    # every embedding as a ring of 32 vertices, thinned at eight levels; closing adds the first vertex again
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get("embedding", 2 * i).cast("double").alias("x"), F.get("embedding", 2 * i + 1).cast("double").alias("y"))).alias("ring"))
    thin = e.withColumn("lod", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("t", G.simplify_ring(F.col("ring"), F.col("lod")))
    return thin.select("vec_id", F.col("lod").cast("long").alias("lod"), F.size("t").cast("long").alias("n"), r(F.aggregate(F.transform("t", lambda p: p["x"]), F.lit(0.0), lambda a, x: a + x)).alias("sum_x"))


@query("f10_lod_for_zoom", "SELECT event_id, CASE WHEN value/100>=1 THEN 0 WHEN value/100>=0.5 THEN 1 ELSE 3 END AS lod FROM events")
def _(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", G.lod_for_zoom(F.col("value") / 100, 4).alias("lod"))


@query("f11_ndc", """SELECT ward_code, round(cast((24.0 + (752.0-dw)/2 + (cx-min_x)/dx*dw)/800.0*2-1 AS float)::double,4) x, round(cast(1-(24.0 + (552.0-dh)/2 + (max_y-cy)/dy*dh)/600.0*2 AS float)::double,4) y
  FROM (SELECT *, CASE WHEN dx/dy > 752.0/552.0 THEN 752.0 ELSE dx/dy*552.0 END dw, CASE WHEN dx/dy > 752.0/552.0 THEN 752.0/(dx/dy) ELSE 552.0 END dh FROM (SELECT *, greatest(max_x-min_x,1e-9) dx, greatest(max_y-min_y,1e-9) dy FROM v_centroid, v_box))""")
def _(s, d):
    c = boxed(s, d).withColumn("c", G.vertex_centroid(F.col("rings"))).filter("c is not null")
    n = c.select("ward_code", G.to_ndc(F.col("c.x"), F.col("c.y"), F.col("box"), 800.0, 600.0).alias("n"))
    return n.select("ward_code", r(F.col("n.x").cast("double"), 4).alias("x"), r(F.col("n.y").cast("double"), 4).alias("y"))


@query("f12_svg_path", """SELECT ward_code, ring_no, list_aggregate(list_transform(range(1,len(ring)+1), lambda i: (CASE WHEN i=1 THEN 'M ' ELSE 'L ' END) || format('{:.2f}', 10.0+(ring[i].x-min_x)/greatest(max_x-min_x,1e-9)*780.0) || ' ' || format('{:.2f}', 10.0+(max_y-ring[i].y)/greatest(max_y-min_y,1e-9)*580.0)), 'string_agg', ' ') || ' Z' AS path FROM v_rings, v_box""")
def _(s, d):
    rings = boxed(s, d).select("ward_code", "box", F.posexplode("rings").alias("ring_no", "ring"))
    return rings.select("ward_code", F.col("ring_no").cast("long").alias("ring_no"), G.svg_path(F.col("ring"), F.col("box"), 800.0, 600.0, 10.0).alias("path"))


@query("p01_bbox_contains", "SELECT ward_code FROM v_centroid WHERE cx BETWEEN 136.2 AND 136.6 AND cy BETWEEN 35.1 AND 35.3")
def _(s, d):
    box = F.struct(*(F.lit(v).alias(n) for n, v in zip(E.BOX, (136.2, 35.1, 136.6, 35.3), strict=True)))
    c = wards(s, d).select("ward_code", G.vertex_centroid(F.col("rings")).alias("c"))
    return c.filter(G.bbox_contains(box, F.col("c.x"), F.col("c.y"))).select("ward_code")


@query("p02_bbox_intersects", "SELECT id FROM v_catalog WHERE min_x<=136.5 AND max_x>=136.3 AND min_y<=35.2 AND max_y>=35.1")
def _(s, d):
    c = view(s, d, "v_catalog")
    return c.filter(G.bbox_intersects({x: F.col(x) for x in E.BOX}, {"min_x": 136.3, "max_x": 136.5, "min_y": 35.1, "max_y": 35.2})).select("id")


@query("p09_require_attributes", "SELECT p_partkey%7=0 AS rejected, count(*) n FROM part GROUP BY 1")
def _(s, d):
    bad = wards(s, d).withColumn("population", F.when(F.col("ward_code").cast("long") % 7 == 0, -1).otherwise(F.col("population")))
    good, rejected = D.require_attributes(bad)
    count = lambda df, flag: df.agg(F.count("*").alias("n")).select(F.lit(flag).alias("rejected"), "n")
    return count(good, False).unionByName(count(rejected, True))


@query("c12_sources", "SELECT ward_code, 'census; boundaries' AS sources FROM v_wards")
def _(s, d):
    return D.attach_sources(wards(s, d), ["census", "boundaries"]).select("ward_code", F.array_join("sources", "; ").alias("sources"))


@query("j01_join_population", "SELECT p.ward_code, p.population, count(r.ring_no) n_rings FROM v_population p LEFT JOIN v_rings r USING (ward_code) GROUP BY 1,2")
def _(s, d):
    rings = wards(s, d).select("ward_code", F.posexplode("rings").alias("ring_no", "ring"))
    return D.join_population(rings, view(s, d, "v_population")).select("ward_code", "population", F.size("rings").cast("long").alias("n_rings"))


@query("a11_timing_summary", """SELECT event_type, min(v) min_value, max(v) max_value, cast(sum(v)//count(*) AS bigint) mean_value, list_sort(list(v))[cast(count(*)//2 AS bigint)+1] median_value FROM (SELECT event_type, cast(floor(value) AS bigint) v FROM events) GROUP BY 1""")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_type", F.floor("value").alias("v"))
    return D.timing_summary(e, "event_type", "v")


# rasters

@query("f25_cells_to_polygons", "SELECT raster_id, r, c, round(c/8.0,6) x0, round((r+1)/8.0,6) y2, round(px/255.0,6) red, round(px/255.0*0.85,6) green, round(px/255.0*0.7,6) blue FROM v_pixels")
def _(s, d):
    p = T.cells_to_polygons(view(s, d, "v_pixels"), 8, 8)
    ring = F.col("rings")[0]
    return p.select("raster_id", "r", "c", r(ring[0]["x"]).alias("x0"), r(ring[2]["y"]).alias("y2"), *(r(x).alias(x) for x in ("red", "green", "blue")))


def _raster_tiles(s, d) -> DataFrame:
    p = view(s, d, "v_pixels").withColumn("tr", F.floor(F.col("r") / 4)).withColumn("tc", F.floor(F.col("c") / 4))
    tiles = p.groupBy("raster_id", F.col("tr").alias("tile_row"), F.col("tc").alias("tile_col")).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "c", "px"))), lambda x: x["px"]).alias("pixels"))
    return tiles.select("*", *(F.lit(v).alias(n) for n, v in (("w", 4), ("h", 4), ("width", 8), ("height", 8))))


@query("f26_raster_window", "SELECT raster_id, r, c, px FROM v_pixels WHERE r BETWEEN 2 AND 5 AND c BETWEEN 3 AND 6")
def _(s, d):
    return T.raster_window(_raster_tiles(s, d), 2, 3, 4, 4)


@query("f26_window_of_files", "SELECT raster_id, r, c, px FROM v_pixels WHERE r BETWEEN 5 AND 7 AND c BETWEEN 0 AND 3")
def _(s, d):
    path = scratch(s, "rasters")
    T.write_raster_tiles(_raster_tiles(s, d), path, 8)
    return T.read_raster_window(s, path, 5, 0, 3, 4)


# catalog

@query("s10_registry", "SELECT id, title FROM v_catalog ORDER BY id")
def _(s, d):
    return C.listed(view(s, d, "v_catalog")).select("id", "title")


@query("s11_u02_register", "SELECT id, CASE WHEN cast(id AS bigint)%10=0 THEN 'new' ELSE title END AS title FROM v_catalog")
def _(s, d):
    c = view(s, d, "v_catalog")
    return C.upsert_overlay(c, c.filter("cast(id as bigint) % 10 = 0").withColumn("title", F.lit("new"))).select("id", "title")


_REQ = "(SELECT 'a' AS request_id, ['Brand#11'] req UNION ALL SELECT 'b', ['Brand#13','size1'] UNION ALL SELECT 'c', ['nothing'] UNION ALL SELECT 'd', ['size0','size0'])"


def _requests(s) -> DataFrame:
    return s.createDataFrame([("a", ["Brand#11"]), ("b", ["Brand#13", "size1"]), ("c", ["nothing"]), ("d", ["size0", "size0"])], "request_id string, required array<string>")


@query("p04_has_all_tags", "SELECT id FROM v_catalog WHERE list_contains(tags,'Brand#13') AND list_contains(tags,'size1')")
def _(s, d):
    return view(s, d, "v_catalog").filter(X.has_all_tags(F.col("tags"), F.array(F.lit("Brand#13"), F.lit("size1")))).select("id")


@query("j02_bind_datasets", f"SELECT request_id, id FROM {_REQ}, v_catalog WHERE list_has_all(tags, req)")
def _(s, d):
    return C.bind_datasets(_requests(s), view(s, d, "v_catalog"))


@query("t02_match_dataset", f"SELECT request_id, CASE count(id) WHEN 0 THEN 'no_match' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status, min(id) id, count(id) n_ids FROM {_REQ} LEFT JOIN v_catalog ON list_has_all(tags, req) GROUP BY 1")
def _(s, d):
    return C.match_dataset(_requests(s), view(s, d, "v_catalog"))


@query("t02_ambiguous_ids", f"SELECT request_id, id FROM {_REQ}, v_catalog WHERE list_has_all(tags, req) AND request_id IN (SELECT request_id FROM {_REQ}, v_catalog WHERE list_has_all(tags, req) GROUP BY 1 HAVING count(*)>1)")
def _(s, d):
    return C.ambiguous_ids(_requests(s), view(s, d, "v_catalog"))


@query("a06_collection_items", "SELECT id, format FROM v_catalog ORDER BY id")
def _(s, d):
    return C.collection_items(view(s, d, "v_catalog"))


@query("a06_collection_summary", "SELECT round(min(min_x),6) min_x, round(max(max_y),6) max_y, count(*) item_count, min(id) first_id, (SELECT string_agg(format||'='||n, ',' ORDER BY format) FROM (SELECT format, count(*) n FROM v_catalog GROUP BY 1)) formats FROM v_catalog")
def _(s, d):
    return C.collection_summary(view(s, d, "v_catalog")).select(r("min_x").alias("min_x"), r("max_y").alias("max_y"), "item_count", "first_id", "formats")


@query("f20_records_to_items", "SELECT id, format AS asset_key, uri AS href, './'||id||'.json' AS self FROM v_catalog")
def _(s, d):
    i = C.records_to_items(view(s, d, "v_catalog"))
    return i.select("id", F.map_keys("assets")[0].alias("asset_key"), F.map_values("assets")[0]["href"].alias("href"), F.col("links")[0]["href"].alias("self"))


@query("f19_items_to_records", "SELECT id, title, 'items/data/'||id||'.parquet' AS uri, format, 'EPSG:4326' AS crs, license, 'stac,imported,asset:'||format AS tags FROM v_catalog")
def _(s, d):
    items = C.records_to_items(view(s, d, "v_catalog")).withColumn("uri", F.lit("items/x.json"))
    return C.items_to_records(items).withColumn("tags", F.array_join("tags", ","))


# federation

@query("p03_stac_filter", "SELECT ord, id FROM v_hits WHERE min_x<=155 AND max_x>=135 AND min_y<=38 AND max_y>=32 AND collection IN ('FRANCE','CHINA','BRAZIL','NATION_1','NATION_2','NATION_3')")
def _(s, d):
    return E.stac_filter(view(s, d, "v_hits"), SEARCH_BOX, ("FRANCE", "CHINA", "BRAZIL", "NATION_1", "NATION_2", "NATION_3")).select("ord", "id")


@query("u01_federated_merge", "SELECT item_key, id, sources FROM v_items")
def _(s, d):
    return E.federated_search(view(s, d, "v_hits")).select(F.col("key").alias("item_key"), "id", F.array_join("source_endpoints", ",").alias("sources"))


@query("t03_limit_after_merge", "SELECT item_key FROM v_items WHERE min_x<=155 AND max_x>=135 AND min_y<=38 AND max_y>=32 ORDER BY item_key LIMIT 10")
def _(s, d):
    return E.federated_search(view(s, d, "v_hits"), SEARCH_BOX, limit=10).select(F.col("key").alias("item_key"))


def _endpoints(s, d) -> DataFrame:
    region = s.read.parquet(f"{d}/region.parquet")
    return region.select(F.col("r_name").alias("endpoint_id"), F.col("r_regionkey").alias("ord"), F.concat(F.lit("https://"), F.lower("r_name"), F.lit(".example.com/")).alias("url"), F.when(F.col("r_regionkey") == 4, "corrupt response").alias("error"))


@query("a08_endpoint_outcomes", "SELECT r_name endpoint_id, count(h.id) matched, r_regionkey<>4 AS ok FROM region LEFT JOIN v_hits h ON r_name=endpoint_id GROUP BY r_name, r_regionkey")
def _(s, d):
    return E.endpoint_outcomes(view(s, d, "v_hits"), _endpoints(s, d)).select("endpoint_id", "matched", "ok")


@query("u03_outcome_totals", "SELECT 4 AS succeeded, 1 AS failed, count(*) matched FROM v_hits")
def _(s, d):
    t = E.outcome_totals(E.endpoint_outcomes(view(s, d, "v_hits"), _endpoints(s, d)))
    return t.select(F.col("succeeded").cast("int").alias("succeeded"), F.col("failed").cast("int").alias("failed"), "matched")


@query("j06_select_endpoints", "SELECT r_name endpoint_id FROM region WHERE r_name IN ('ASIA','EUROPE')")
def _(s, d):
    return E.select_endpoints(_endpoints(s, d), ("ASIA", "EUROPE")).select("endpoint_id")


def _items(s, d) -> DataFrame:
    """Merged items with three assets each; crs and license are missing on some."""
    n = F.col("id").cast("long")
    asset = lambda href, kind, roles: F.struct(F.concat(F.lit(href), F.col("id")).alias("href"), F.lit(kind).alias("type"), F.array(*map(F.lit, roles)).cast("array<string>").alias("roles"))
    props = F.to_json(F.struct(F.when(n % 5 != 0, "EPSG:4326").alias("proj:code"), F.lit("persons").alias("units"), F.when(n % 11 != 0, "CC-BY-4.0").alias("license")))
    assets = F.create_map(F.lit("data"), asset("s3://a/", MEDIA[0], ["data"]), F.lit("cog"), asset("s3://b/", MEDIA[1], ["data"]), F.lit("thumb"), asset("s3://c/", "image/png", ["thumbnail"]))
    return E.federated_search(view(s, d, "v_hits")).withColumn("properties", props).withColumn("assets", assets)


def _scored(s, d) -> DataFrame:
    a = E.explode_assets(E.item_metadata(_items(s, d))).withColumn("asset_type", F.col("asset.type")).withColumn("roles", F.col("asset.roles"))
    return E.score_assets(a, MEDIA)


@query("j05_explode_assets", "SELECT item_key, asset_key, asset_type FROM v_cands")
def _(s, d):
    return E.explode_assets(_items(s, d)).select(F.col("key").alias("item_key"), "asset_key", F.col("asset.type").alias("asset_type"))


@query("p05_data_role", "SELECT item_key, asset_key FROM v_cands WHERE data_role")
def _(s, d):
    a = E.explode_assets(_items(s, d))
    return a.filter(X.has_data_role(F.col("asset.roles"))).select(F.col("key").alias("item_key"), "asset_key")


@query("f17_item_metadata", "SELECT DISTINCT item_key, crs, 'persons' AS units, license FROM v_cands")
def _(s, d):
    return E.item_metadata(_items(s, d)).select(F.col("key").alias("item_key"), "crs", "units", "license")


@query("f17_nested_metadata", "SELECT id, CASE WHEN cast(id AS bigint)%3=0 THEN 'EPSG:6668' WHEN cast(id AS bigint)%3=1 THEN 'unknown' ELSE 'local' END AS crs, CASE WHEN cast(id AS bigint)%2=0 THEN title ELSE 'unknown' END AS license FROM v_catalog")
def _(s, d):
    c = view(s, d, "v_catalog")
    n = F.col("id").cast("long")
    code = F.when(n % 3 == 0, '"EPSG:6668"').when(n % 3 == 1, "6668").otherwise('null, "alt:crs": "local"')
    text = F.concat(F.lit('{"inner": {"license": 1, "proj:code": "x"}, "proj:code": '), code, F.lit(', "license": '), F.when(n % 2 == 0, F.to_json(F.array("title"))).otherwise("[1]"), F.lit("}"))
    made = c.withColumn("properties", F.when(n % 2 == 0, F.regexp_replace(text, r"\[(.*)\]\}$", "$1}")).otherwise(text))
    return E.item_metadata(made, ("proj:code", "alt:crs")).select("id", "crs", "license")


@query("f16_score_assets", "SELECT item_key, asset_key, compatible, cast(score AS int) score FROM v_scored")
def _(s, d):
    return _scored(s, d).select(F.col("key").alias("item_key"), "asset_key", "compatible", "score")


@query("a15_check_counts", "SELECT item_key, asset_key, cast((asset_type<>'image/png')::int + data_role::int + 2 + (crs<>'unknown')::int + (license<>'unknown')::int AS bigint) n_passed, cast(6 AS bigint) AS n_checks FROM v_cands")
def _(s, d):
    v = _scored(s, d).select(F.col("key").alias("item_key"), "asset_key", F.explode("verifications").alias("c")).select("item_key", "asset_key", "c.passed")
    return D.check_counts(v, ["item_key", "asset_key"])


@query("t01_rank_candidates", "SELECT item_key, asset_key, cast(row_number() OVER (PARTITION BY item_key ORDER BY score DESC, asset_key) AS int) AS place FROM v_scored")
def _(s, d):
    return E.rank_candidates(_scored(s, d), "key").select(F.col("key").alias("item_key"), "asset_key", "place")


@query("a09_compare_and_bind", """SELECT item_key, asset_key, cast(score AS int) score, sources, crs, license,
  (SELECT string_agg('https://'||lower(r_name)||'.example.com/', ',' ORDER BY r_regionkey) FROM region WHERE list_contains(string_split(sources, ','), r_name)) AS source_urls
  FROM v_scored WHERE compatible ORDER BY v_scored.score DESC, item_key, asset_key LIMIT 1""")
def _(s, d):
    b = E.compare_and_bind(_items(s, d), _endpoints(s, d), MEDIA)
    return b.select(F.col("key").alias("item_key"), "asset_key", "score", F.array_join("source_endpoints", ",").alias("sources"), "crs", "license", F.array_join("source_urls", ",").alias("source_urls"))


# text and addresses

@query("p06_url_admission", "SELECT page_id, (h='example.com' OR h LIKE '%.example.net' OR h='tion.example.org') AS allowed FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) h FROM pages)")
def _(s, d):
    return E.url_report(pages(s, d), "url", HOSTS).select("page_id", F.col("admission.allowed").alias("allowed"))


@query("p07_size_guard", "SELECT page_id, coalesce(strlen(html)<=3000, false) AS admitted FROM pages")
def _(s, d):
    return E.size_guard(pages(s, d).withColumn("n", F.octet_length("html")), "n", 3000).select("page_id", "admitted")


@query("f14_crs_text", """SELECT n_nationkey, CASE n_nationkey%5 WHEN 0 THEN 'EPSG:'||n_nationkey WHEN 1 THEN 'OGC:'||n_name WHEN 2 THEN 'IAU:'||n_nationkey WHEN 3 THEN n_name ELSE 'EPSG:4326' END AS crs FROM nation""")
def _(s, d):
    n, key, name = s.read.parquet(f"{d}/nation.parquet"), F.col("n_nationkey").cast("string"), F.col("n_name")
    shapes = [('{"crs": {"authority": "EPSG", "code": ', key, "}}"), ('{"crs": {"auth_name": "OGC", "code": "', name, '"}}'), ('{"crs": {"type": "GeographicCRS", "id": {"authority": "IAU", "code": ', key, "}}}"), ('{"crs": "', name, '"}'), ('{"encoding": "', name, '"}')]
    meta = F
    for k, (before, value, after) in enumerate(shapes):
        meta = meta.when(F.col("n_nationkey") % 5 == k, F.concat(F.lit(before), value, F.lit(after)))
    return n.select("n_nationkey", X.crs_text(meta).alias("crs"))


def _stored(s, d) -> str:
    """v_wards as GeoParquet in the shared folder."""
    path = scratch(s, "wards")
    GP.write_geoparquet(wards(s, d), path, row_group_rows=100, crs="EPSG:6668")
    return path


@query("s03_geoparquet", "SELECT row_number() OVER ()-1 AS id, count(*) OVER () AS n FROM v_wards")
def _(s, d):
    return GP.read_geoparquet(s, _stored(s, d), ids=True).select("id", F.count("*").over(Window.partitionBy()).alias("n"))


@query("s07_geoparquet_rings", "SELECT ward_code, ward_name, population, len(rings) n_rings, cast(list_sum(list_transform(rings, lambda g: len(g))) AS bigint) n_vertices, round(list_sum(list_transform(rings, lambda g: list_sum(list_transform(g, lambda p: p.x)))),6) sum_x, round(list_min(list_transform(rings, lambda g: list_min(list_transform(g, lambda p: p.y)))),6) min_y FROM v_wards WHERE cast(ward_code AS bigint)%97<>0")
def _(s, d):
    path = scratch(s, "wards")
    GP.write_geoparquet(wards(s, d).filter("cast(ward_code as long) % 97 <> 0"), path, row_group_rows=100)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    return GP.read_geoparquet(s, path).select(
        "ward_code", "ward_name", "population", F.size("rings").cast("long").alias("n_rings"), F.size(F.flatten("rings")).cast("long").alias("n_vertices"),
        r(total(F.transform(F.flatten("rings"), lambda p: p["x"]))).alias("sum_x"), r("min_y").alias("min_y"),
    )


@query("s04_geoparquet_footer", "SELECT 'geometry' AS geometry_column, 'EPSG:6668' AS crs, cast(8 AS bigint) AS n_fields, count(*) AS n_rows FROM v_wards")
def _(s, d):
    path = _stored(s, d)
    foot = GP.geoparquet_footer(s, path).agg(F.min("geometry_column").alias("geometry_column"), F.max("crs").alias("crs"), F.max(F.size("schema_fields")).cast("long").alias("n_fields"))
    return foot.join(F.broadcast(GP.read_geoparquet(s, path).agg(F.count("*").alias("n_rows"))))


@query("s05_row_groups", "SELECT cast(coalesce(sum(least(100, n)), 0) AS bigint) AS n_first, cast(0 AS bigint) AS n_none, cast(coalesce(sum(n), 0) AS bigint) AS n_all FROM (SELECT count(*) n FROM v_wards GROUP BY cast(ward_code AS bigint)%(SELECT count(*)//10000+1 FROM v_wards))")
def _(s, d):
    # row groups are counted in each file, so the files are fixed: count div 10,000 + 1, a ward's by its code
    path, w = scratch(s, "wards"), wards(s, d)
    files = w.count() // 10_000 + 1
    GP.write_geoparquet(w.repartitionById(files, F.expr(f"cast(cast(ward_code as long) % {files} as int)")), path, row_group_rows=100)
    count = lambda groups, name: GP.read_geoparquet(s, path, groups).agg(F.count("*").alias(name))
    return count([0], "n_first").join(F.broadcast(count([], "n_none"))).join(F.broadcast(count(None, "n_all")))


@query("s05_groups_by_box", "SELECT ward_code, population FROM v_wards WHERE list_max(list_transform(flatten(rings), lambda p: p.x)) >= 136.2 AND list_min(list_transform(flatten(rings), lambda p: p.x)) <= 136.25 AND list_max(list_transform(flatten(rings), lambda p: p.y)) >= 35.1 AND list_min(list_transform(flatten(rings), lambda p: p.y)) <= 35.3 AND cast(ward_code AS bigint)%97<>0")
def _(s, d):
    path = scratch(s, "wards")
    w = wards(s, d).filter("cast(ward_code as long) % 97 <> 0")
    GP.write_geoparquet(w.repartitionByRange(F.get(F.get("rings", F.lit(0)), F.lit(0))["x"]).sortWithinPartitions(F.get(F.get("rings", F.lit(0)), F.lit(0))["x"]), path, row_group_rows=50)
    return GP.read_geoparquet(s, path, ids=True, columns=["ward_code", "population"], box=(136.2, 35.1, 136.25, 35.3)).select("ward_code", "population")


@query("s06_properties", """SELECT ward_code, '{"ward_code":"' || ward_code || '","area":' || CASE WHEN cast(ward_code AS bigint)%3=0 THEN 'null' ELSE cast(cast(ward_code AS bigint)%7 AS varchar) || '.5' END || ',"population":' || CASE WHEN cast(ward_code AS bigint)%4=0 THEN 'null' ELSE cast(population AS varchar) END || ',"even":' || CASE WHEN cast(ward_code AS bigint)%2=0 THEN 'true' ELSE 'false' END || '}' AS properties FROM v_wards""")
def _(s, d):
    # numbers that are not finite and nulls of a stored file, both null in the object
    path, k = scratch(s, "wards"), F.col("ward_code").cast("long")
    odd = F.when(k % 3 == 0, F.when(k % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise((k % 7).cast("double") + 0.5)
    w = wards(s, d).select("ward_code", odd.alias("area"), F.when(k % 4 != 0, F.col("population")).alias("population"), (k % 2 == 0).alias("even"), "rings")
    GP.write_geoparquet(w, path, row_group_rows=100)
    read = GP.read_geoparquet(s, path).drop("min_x", "min_y", "max_x", "max_y")
    return read.select("ward_code", GP.properties_json(read).alias("properties"))


@query("c06_federated_execute", """SELECT item_key, unnest(['schema_fields','crs_matches_binding','source_matches_binding']) AS name, unnest([true, false, true]) AS passed
  FROM (SELECT item_key FROM v_scored WHERE compatible AND asset_type='application/vnd.apache.parquet' ORDER BY v_scored.score DESC, item_key LIMIT 1)""")
def _(s, d):
    # the binding says EPSG:4326, the stored file EPSG:6668
    path = _stored(s, d)
    hits = view(s, d, "v_hits").join(_items(s, d).select("id", "properties", "assets").dropDuplicates(["id"]), "id")
    bound, _, checks = steps.federated_execute(hits, _endpoints(s, d), MEDIA[:1], locate=lambda href: path)
    return checks.join(F.broadcast(bound.select(F.col("key").alias("item_key")))).select("item_key", "name", "passed")


@query("p10_is_remote", "SELECT page_id, starts_with(url,'http://') OR starts_with(url,'https://') AS remote FROM pages")
def _(s, d):
    return pages(s, d).select("page_id", X.is_remote_uri(F.col("url")).alias("remote"))


@query("f21_resolve_href", "SELECT page_id, regexp_replace(url,'/[^/]*$','')||'/a/b.parquet' AS href FROM pages")
def _(s, d):
    return pages(s, d).select("page_id", X.resolve_href(F.lit("a/b.parquet"), F.col("url")).alias("href"))


@query("f22_dataset_name", r"SELECT page_id, CASE WHEN n='' THEN 'geoparquet' ELSE n END AS name FROM (SELECT page_id, regexp_replace(string_split(regexp_extract(url,'[^/\\]*$',0),'?')[1],'\.parquet$','') n FROM pages)")
def _(s, d):
    return pages(s, d).select("page_id", X.dataset_name(F.col("url")).alias("name"))


@query("f23_search_url", "SELECT page_id, CASE WHEN rtrim(url,'/') LIKE '%/search' THEN rtrim(url,'/') ELSE rtrim(url,'/')||'/search' END AS url FROM pages")
def _(s, d):
    return pages(s, d).select("page_id", X.search_url(F.col("url")).alias("url"))


@query("f15_item_key", "SELECT ord, CASE WHEN collection IS NULL THEN id ELSE collection||'/'||id END AS item_key FROM v_hits")
def _(s, d):
    return view(s, d, "v_hits").select("ord", X.item_key(F.col("collection"), F.col("id")).alias("item_key"))


@query("f18_format", "SELECT id, format FROM v_catalog")
def _(s, d):
    i = C.records_to_items(view(s, d, "v_catalog"))
    return i.select("id", X.format_from_media_type(F.map_values("assets")[0]["type"]).alias("format"))


@query("f24_escape_xml", """SELECT doc_id, md5(replace(replace(replace(replace(text,'&','&amp;'),'<','&lt;'),'>','&gt;'),'"','&quot;')) AS h FROM documents""")
def _(s, d):
    return documents(s, d).select("doc_id", F.md5(X.escape_xml(F.col("text"))).alias("h"))


@query("f27_normalize", r"SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS text FROM conversations")
def _(s, d):
    return s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", X.normalize_prompt(F.col("text")).alias("text"))


@query("f29_catalog_url", r"SELECT page_id, trim(url, '.,;:)([]''""') AS found FROM pages")
def _(s, d):
    p = pages(s, d).withColumn("t", F.concat(F.lit("import stac, from ("), F.col("url"), F.lit("), please")))
    return p.select("page_id", X.extract_catalog_url(F.col("t")).alias("found"))


_PROMPT = "CASE doc_id%9 WHEN 0 THEN 'Nagoya population density map' WHEN 1 THEN 'show GeoParquet density of nagoya' WHEN 2 THEN 'remote COG' WHEN 3 THEN 'bundled raster, density' WHEN 4 THEN 'density' WHEN 5 THEN 'nagoya' WHEN 6 THEN 'import STAC from (https://example.org/c.json)' WHEN 7 THEN 'geo parquet 名古屋' ELSE '' END"


def _prompts(s, d) -> DataFrame:
    """A literal prompt before each whole text."""
    return documents(s, d).select("doc_id", F.expr(f"concat({_PROMPT}, ' ', coalesce(text, ''))").alias("text"))


def _any_word(group: str) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in I.WORDS[group]) + ")"


def _metric(values: dict[str, str], other: str) -> str:
    """The first metric rule that holds, as SQL over low and url."""
    tests = {name: " AND ".join([*map(_any_word, groups), *(["url"] if needs_url else [])]) for name, groups, needs_url, _ in I.METRICS}
    return "CASE " + " ".join(f"WHEN {tests[n]} THEN {v}" for n, v in values.items()) + f" ELSE {other} END"


_TAGGED = f"""(SELECT doc_id, low, url, CASE WHEN {_any_word('place')} THEN '{I.PLACE}' END AS place, {_metric({n: f"'{n}'" for n, *_ in I.METRICS}, 'NULL')} AS metric,
  {_metric({n: str(w) for n, *_, w in I.METRICS}, '0')}::double AS weight, {_any_word('map')} AS map
  FROM (SELECT doc_id, regexp_replace(lower(t), '[\\s　]+', ' ', 'g') low, len(list_filter(string_split_regex(t, '[\\s　]+'), lambda x: regexp_matches(trim(x, '"''「」,.;:)(]['), '^(http://|https://|file://|examples/)')))>0 AS url
  FROM (SELECT doc_id, {_PROMPT} || ' ' || coalesce(text, '') t FROM documents)))"""


@query("f28_tag_intent", f"SELECT doc_id, place, metric, round(least(1.0, (CASE WHEN place IS NOT NULL THEN 0.45 ELSE 0 END) + weight + (CASE WHEN map THEN 0.2 ELSE 0 END))::double, 6) AS confidence, CASE WHEN map THEN 'choropleth' END AS visualization FROM {_TAGGED}")
def _(s, d):
    return I.tag_intent(_prompts(s, d)).select("doc_id", "place", "metric", "confidence", "visualization")


#: Tags of a workflow's datasets on some records: one of the first, none of the second, several of the others.
_DATASETS = """CASE WHEN cast(id AS bigint)=11 THEN {0} WHEN cast(id AS bigint)%40=7 THEN {1} WHEN cast(id AS bigint)=12 THEN {2} WHEN cast(id AS bigint)=13 THEN {3} WHEN cast(id AS bigint)%50=4 THEN {4} ELSE {5} END"""
_SETS = [("nagoya", "density", "population"), ("cog", "demo", "local"), ("stac", "demo", "external", "extra"), ("nagoya", "geoparquet", "density", "demo"), ("cog", "remote"), ("other",)]


_BOUND = f"""(SELECT workflow, count(id) n, min(id) id FROM (VALUES {", ".join(f"('{name}', [{', '.join(repr(t) for t in tags)}])" for *_, name, tags in I.WORKFLOWS)}) w(workflow, req)
  LEFT JOIN (SELECT id, {_DATASETS.format(*(str(list(t)) for t in _SETS))} AS tags FROM v_catalog) c ON list_has_all(c.tags, w.req) GROUP BY 1)"""
_ROUTED = f"(SELECT *, CASE {' '.join(f"WHEN metric='{m}'{' AND place IS NOT NULL' if place else ''} THEN '{name}'" for m, place, name, _ in I.WORKFLOWS)} END AS workflow FROM {_TAGGED})"


@query("c10_route_prompts", f"""SELECT doc_id, r.workflow, CASE WHEN trim(low)='' THEN 'empty' WHEN r.workflow IS NOT NULL THEN 'routed' WHEN (place IS NOT NULL AND metric IS NULL) OR (metric='population_density' AND place IS NULL) OR url THEN 'ambiguous' ELSE 'unresolved' END AS status,
  CASE WHEN r.workflow IS NULL THEN NULL WHEN n=0 THEN 'no_match' WHEN n=1 THEN 'matched' ELSE 'ambiguous' END AS dataset_status, CASE WHEN n=1 THEN id END AS dataset_id FROM {_ROUTED} r LEFT JOIN {_BOUND} b ON r.workflow=b.workflow""")
def _(s, d):
    tags = _DATASETS.format(*("array(" + ", ".join(repr(x) for x in t) + ")" for t in _SETS))
    catalog = view(s, d, "v_catalog").select("id", F.expr(tags).alias("tags"))
    return I.route_prompts(_prompts(s, d), catalog).select("doc_id", "workflow", "status", "dataset_status", "dataset_id")


# logs

@query("p08_validate_ids", "SELECT n_name FROM nation WHERE regexp_full_match(n_name, '[A-Za-z0-9_-]+')")
def _(s, d):
    return E.validate_ids(s.read.parquet(f"{d}/nation.parquet"), "n_name")[0].select("n_name")


@query("p08_validate_comments", "SELECT id FROM v_comments WHERE trim(author)<>'' AND trim(body)<>''")
def _(s, d):
    return L.validate_comments(view(s, d, "v_comments"))[0].select("id")


@query("u04_merge_comments", "SELECT id, max(CASE WHEN src<>0 THEN body||'!' ELSE body END) AS body FROM v_comments GROUP BY id")
def _(s, d):
    c = view(s, d, "v_comments")
    return L.merge_comments(c.filter("src < 2"), c.filter("src > 0").withColumn("body", F.concat("body", F.lit("!")))).select("id", "body")


@query("u04_merge_branches", "SELECT n_name AS name, CASE WHEN n_nationkey<10 THEN n_nationkey WHEN n_nationkey<15 THEN greatest(n_nationkey, 25-n_nationkey) ELSE 25-n_nationkey END AS created_at FROM nation")
def _(s, d):
    n = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    a, b = n.filter("k < 15").withColumn("created_at", F.col("k")), n.filter("k >= 10").withColumn("created_at", 25 - F.col("k"))
    return L.merge_branches(a, b).select("name", "created_at")


@query("u05_create_branches", "SELECT n_name AS name FROM nation WHERE n_regionkey<3 AND n_nationkey>=10 AND regexp_full_match(n_name, '[A-Za-z0-9_-]+')")
def _(s, d):
    n = s.read.parquet(f"{d}/nation.parquet")
    known = s.read.parquet(f"{d}/region.parquet").filter("r_regionkey < 3").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("name")).unionByName(n.filter("n_nationkey < 10").select(F.col("n_name").alias("name")))
    return L.create_branches(known, n.select(F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent")))[0].select("name")


@query("a12_collab_summary", "SELECT (SELECT count(*) FROM v_comments) AS comments, (SELECT count(*) FROM region) AS branches, (SELECT count(*) FROM v_runs) AS provenance, (SELECT string_agg(r_name, ',' ORDER BY r_name) FROM region) AS branch_names")
def _(s, d):
    return L.collab_summary(view(s, d, "v_comments"), s.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("name")), view(s, d, "v_runs"))


@query("t04_latest_run", "SELECT id, started_at FROM v_runs ORDER BY started_at DESC, id DESC LIMIT 1")
def _(s, d):
    return L.latest_run(view(s, d, "v_runs"))


@query("t04_run_history", "SELECT id, workflow_id FROM v_runs")
def _(s, d):
    return L.run_history(view(s, d, "v_runs")).select("id", "workflow_id")


@query("c09_classify_runs", "SELECT id, CASE WHEN verified THEN 'agent_run_verified' WHEN plan_only THEN 'agent_plan_pending' ELSE 'agent_run_failed' END AS action FROM v_runs")
def _(s, d):
    return L.classify_runs(view(s, d, "v_runs")).select("id", "action")


@query("p11_provenance_for_run", "SELECT id AS run_id, workflow_id AS target FROM v_runs WHERE id='17'")
def _(s, d):
    return L.provenance_for_run(L.provenance_of(view(s, d, "v_runs")), "17").select("run_id", "target")


@query("s13_provenance", "SELECT id AS run_id, 'agent' AS actor, workflow_id AS target FROM v_runs")
def _(s, d):
    return L.provenance_of(view(s, d, "v_runs")).select("run_id", "actor", "target")


@query("c13_failure_comments", "SELECT id AS run_id, '3' AS step_id, 'Verification failed after 1 attempt(s) for prompt: '||workflow_id AS body FROM v_runs WHERE NOT verified AND NOT plan_only AND cast(id AS bigint)%2=0")
def _(s, d):
    step = lambda i, role: F.struct(F.lit(i).alias("id"), F.lit(role).alias("role"))
    runs = view(s, d, "v_runs").withColumn("steps", F.when(F.col("id").cast("long") % 2 == 0, F.array(step("1", "planner"), step("2", "verifier"), step("3", "verifier"))).otherwise(F.array(step("1", "planner"))))
    runs = runs.withColumn("attempts", F.lit(0)).withColumn("prompt", F.col("workflow_id"))
    return L.failure_comments(runs).select("run_id", "step_id", "body")


@query("s17_audit_bundle", "SELECT (SELECT count(*) FROM v_catalog) AS items, (SELECT count(*) FROM v_comments) AS comments, (SELECT count(*) FROM v_runs) AS runs")
def _(s, d):
    c, runs = view(s, d, "v_catalog"), view(s, d, "v_runs")
    b = L.audit_bundle(c, c.filter("cast(id as bigint) < 10"), view(s, d, "v_comments"), L.provenance_of(runs), runs)
    number = lambda p: F.get_json_object("bundle", p).cast("long")
    return b.select(number("$.merged.item_count").alias("items"), number("$.comments").alias("comments"), number("$.runs").alias("runs"))


@query("c04_verify_rasters", "SELECT vec_id raster_id, vec_id%3<>0 AND vec_id%5<>0 AND vec_id%7<>0 AS passed FROM embeddings")
def _(s, d):
    n = F.col("raster_id")
    inv = view(s, d, "v_pixels").groupBy("raster_id").agg((F.max("c") + 1).alias("width"), (F.max("r") + 1).alias("height"))
    inv = inv.withColumn("bands", F.when(n % 3 == 0, 0).otherwise(n % 3)).withColumn("crs", F.when(n % 5 == 0, F.when(n % 2 == 0, "").otherwise(F.lit(None))).otherwise("EPSG:4326")).withColumn("width", F.when(n % 7 == 0, 0).otherwise(F.col("width")))
    return T.verify_rasters(inv).select("raster_id", "passed")


@query("c05_verify_collections", "SELECT r_name AS id, r_regionkey<>2 AS passed FROM region")
def _(s, d):
    c = s.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("id"), F.when(F.col("r_regionkey") == 2, "Feature").otherwise("Collection").alias("type"))
    return C.verify_collections(c).select("id", "passed")


@query("s17_audit_items", "SELECT snapshot, id FROM (SELECT 'base' AS snapshot, id FROM v_catalog UNION ALL SELECT 'overlay', id FROM v_catalog WHERE cast(id AS bigint)<10 UNION ALL SELECT 'merged', id FROM v_catalog)")
def _(s, d):
    return _audit(s, d)["items"].select("snapshot", "id")


@query("s17_audit_runs", "SELECT id, workflow_id, CASE WHEN verified THEN 'agent_run_verified' WHEN plan_only THEN 'agent_plan_pending' ELSE 'agent_run_failed' END AS action FROM v_runs")
def _(s, d):
    return _audit(s, d)["runs"].select("id", "workflow_id", "action")


def _audit(s, d) -> dict[str, DataFrame]:
    c, runs = view(s, d, "v_catalog"), view(s, d, "v_runs")
    return L.audit_tables(c, c.filter("cast(id as bigint) < 10"), view(s, d, "v_comments"), L.provenance_of(runs), runs)


# files that a query stages in the shared folder and reads back

def _geojson(s, d) -> DataFrame:
    """v_wards as one GeoJSON feature a line."""
    parts = F.to_json(F.transform("rings", lambda g: F.array(F.transform(g, lambda p: F.array(p["x"], p["y"])))))
    single = F.to_json(F.array(F.transform(F.get("rings", F.lit(0)), lambda p: F.array(p["x"], p["y"]))))
    many = F.size("rings") > 1
    shape = F.concat(F.lit('{"type":"'), F.when(many, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'), F.when(many, parts).otherwise(single), F.lit("}"))
    return wards(s, d).select(F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct("ward_code", "population")), F.lit(',"geometry":'), shape, F.lit("}")).alias("value"))


@query("s01_geojson", "SELECT ward_code, population, len(rings) n_rings, cast(list_sum(list_transform(rings, lambda g: len(g))) AS bigint) n_vertices, round(list_sum(list_transform(rings, lambda g: list_sum(list_transform(g, lambda p: p.y)))),6) sum_y FROM v_wards")
def _(s, d):
    path = scratch(s, "geojson")
    _geojson(s, d).write.text(path)
    f = J.read_geojson_lines(s, path)
    text = lambda k: F.get_json_object("properties", f"$.{k}")
    total = F.aggregate(F.transform(F.flatten("rings"), lambda p: p["y"]), F.lit(0.0), lambda t, x: t + x)
    return f.select(text("ward_code").alias("ward_code"), text("population").cast("long").alias("population"), F.size("rings").cast("long").alias("n_rings"), F.size(F.flatten("rings")).cast("long").alias("n_vertices"), r(total).alias("sum_y"))


@query("s01_feature_collection", """SELECT ward_code, population, 'wards ' || cast(cast(ward_code AS bigint)//500 AS varchar) AS name, row_number() OVER (PARTITION BY cast(ward_code AS bigint)//500 ORDER BY cast(ward_code AS bigint))-1 AS id, len(rings) n_rings FROM v_wards""")
def _(s, d):
    # files of 500 features at most, each read in ranges of 16 KiB; names come from what stands around the features
    path, k = scratch(s, "collections"), F.col("f.properties.ward_code").cast("long")
    lines = _geojson(s, d).withColumn("f", F.from_json("value", "properties struct<ward_code: string>")).select(k.alias("k"), F.expr("f.properties.ward_code div 500").cast("long").alias("file"), "value")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]), ",\n")
    whole = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), "features", F.lit('], "bbox": [1, [2]], "name": "wards '), F.col("file").cast("string"), F.lit('"}'))
    lines.groupBy("file").agg(listed.alias("features")).select(whole.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    f, meta = J.read_geojson(s, path, split_bytes=16 << 10)
    text = lambda c: F.get_json_object("properties", f"$.{c}")
    rows = f.select(text("ward_code").alias("ward_code"), text("population").cast("long").alias("population"), "id", F.size("rings").cast("long").alias("n_rings"))
    return rows.join(meta.select("name", F.expr("cast(substring(name, 7) as long)").alias("file")), F.expr("ward_code div 500") == F.col("file")).drop("file")


@query("s08_population", "SELECT ward_code, ward_name, population, cast(2020 AS int) census_year FROM v_wards")
def _(s, d):
    path = scratch(s, "population")
    listed = F.to_json(F.struct(F.lit(2020).alias("census_year"), F.lit("census").alias("source"), F.collect_list(F.struct("ward_code", "ward_name", "population")).alias("wards")))
    wards(s, d).groupBy(F.pmod(F.xxhash64("ward_code"), F.lit(10)).alias("k")).agg(listed.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return J.read_population(s, path).select("ward_code", "ward_name", "population", "census_year")


@query("s09_stac_items", "SELECT id, collection, round(min_x,6) min_x, round(max_y,6) max_y, 1 AS n_roles FROM v_hits UNION ALL SELECT 'errors', string_agg(e, ',' ORDER BY e), NULL, NULL, count(*) FROM (VALUES ('corrupt response'), ('not a FeatureCollection')) t(e)")
def _(s, d):
    path = scratch(s, "stac")
    item = F.struct(F.lit("Feature").alias("type"), "id", "collection", F.array("min_x", "min_y", "max_x", "max_y").alias("bbox"), F.create_map(F.lit("data"), F.struct(F.lit("a").alias("href"), F.array(F.lit("data")).alias("roles"))).alias("assets"))
    good = view(s, d, "v_hits").groupBy("endpoint_id").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(item).alias("features"))).alias("value")).select("value")
    bad = s.sql("select explode(array('{broken', '{\"type\": \"Other\"}')) value")
    good.unionByName(bad).write.option("maxRecordsPerFile", 1).text(path)
    items, outcomes = J.read_stac_items(s, path)
    found = items.select("id", "collection", r("min_x").alias("min_x"), r("max_y").alias("max_y"), F.size(F.col("assets")["data"]["roles"]).cast("long").alias("n_roles"))
    errors = outcomes.filter("error is not null").agg(F.array_join(F.sort_array(F.collect_list("error")), ",").alias("collection"), F.count("*").alias("n_roles"))
    none = F.lit(None).cast("double")
    return found.unionByName(errors.select(F.lit("errors").alias("id"), "collection", none.alias("min_x"), none.alias("max_y"), "n_roles"))


@query("s09_stac_item", "SELECT cast(s_suppkey AS varchar) id, CASE WHEN s_suppkey%7=0 THEN NULL ELSE 'c'||(s_suppkey%3) END AS collection, round(130+(s_suppkey%60)*0.5, 6) min_x, CASE WHEN s_suppkey%2=0 THEN 1 ELSE 0 END AS n_assets, cast(0 AS bigint) n_links FROM supplier")
def _(s, d):
    # one document an item; every other one has no assets, none has links. A hundred at most are files of their own, the
    # others lines of files, so that files do not grow with the items
    path, packed, k = scratch(s, "item"), scratch(s, "items"), F.col("s_suppkey")
    asset = F.when(k % 2 == 0, F.create_map(F.lit("data"), F.struct(F.lit("a").alias("href"))))
    x = F.lit(130.0) + (k % 60) * 0.5
    item = F.struct(F.lit("Feature").alias("type"), k.cast("string").alias("id"), F.when(k % 7 != 0, F.concat(F.lit("c"), (k % 3).cast("string"))).alias("collection"), F.array(x, F.lit(1.0), x, F.lit(2.0)).alias("bbox"), asset.alias("assets"))
    suppliers, alone = s.read.parquet(f"{d}/supplier.parquet"), (k % 10 == 0) & (k >= 0) & (k < 1000)
    suppliers.filter(alone).select(F.to_json(item).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    suppliers.filter(~alone).select(F.to_json(item).alias("value")).write.text(packed)
    items = J.read_stac_item(s, path).unionByName(J.read_stac_item(s, packed, lines=True))
    return items.select("id", "collection", r("min_x").alias("min_x"), F.size("assets").alias("n_assets"), F.size("links").cast("long").alias("n_links"))


@query("s09_stac_collection", "SELECT n_name AS id, r_name AS title, n_nationkey%2=0 AS passed FROM nation JOIN region ON n_regionkey=r_regionkey")
def _(s, d):
    path = scratch(s, "collection")
    nations = s.read.parquet(f"{d}/nation.parquet").join(F.broadcast(s.read.parquet(f"{d}/region.parquet")), F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.when(F.col("n_nationkey") % 2 == 0, "Collection").otherwise("Catalog")
    nations.select(F.to_json(F.struct(kind.alias("type"), F.col("n_name").alias("id"), F.col("r_name").alias("title"), F.lit("CC0").alias("license"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return C.verify_collections(J.read_stac_collection(s, path)).select("id", "title", "passed")


@query("s12_runs", "SELECT id, workflow_id, verified, plan_only FROM v_runs")
def _(s, d):
    path = scratch(s, "runs")
    runs = view(s, d, "v_runs").withColumn("k", F.pmod(F.xxhash64("id"), F.lit(20)))
    runs.groupBy("k").agg(F.to_json(F.collect_list(F.struct("id", "workflow_id", "verified", "plan_only"))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    # the reader takes *.json; the sink names its files *.txt
    return J.read_runs(s, path, "*.txt").select("id", "workflow_id", "verified", "plan_only")


@query("s14_map_paths", """SELECT '<path d="' || path || '" fill="' || color || '"><title>' || ward_name || ': ' || format('{:.0f}', density_per_km2) || '</title></path>' AS line FROM
  (SELECT c.ward_code, ward_name, density_per_km2, ['#edf4fc','#bfd8f2','#72ade0','#3372bf','#0c3f8c'][cls+1] AS color,
  list_aggregate(list_transform(range(1,len(ring)+1), lambda i: (CASE WHEN i=1 THEN 'M ' ELSE 'L ' END) || format('{:.2f}', 10.0+(ring[i].x-min_x)/greatest(max_x-min_x,1e-9)*780.0) || ' ' || format('{:.2f}', 10.0+(max_y-ring[i].y)/greatest(max_y-min_y,1e-9)*580.0)), 'string_agg', ' ') || ' Z' AS path
  FROM v_classed c JOIN v_rings r ON c.ward_code=r.ward_code AND ring_no=0, v_box)""")
def _(s, d):
    path = scratch(s, "paths")
    w = D.population_density(wards(s, d)).join(F.broadcast(D.dataset_bbox(wards(s, d)).select(F.struct("*").alias("box"))))
    J.write_svg_paths(w.withColumn("path", G.svg_path(F.get("rings", F.lit(0)), F.col("box"), 800.0, 600.0, 10.0)), path)
    return s.read.text(path).select(F.col("value").alias("line"))


@query("s11_overlay_file", "SELECT id, CASE WHEN cast(id AS bigint)%10=0 THEN 'new' ELSE title END AS title FROM v_catalog")
def _(s, d):
    c, path = view(s, d, "v_catalog"), scratch(s, "overlay")
    none = C.upsert_overlay(c, C.read_overlay(c, path))
    C.write_overlay(none.filter("cast(id as bigint) % 10 = 0").withColumn("title", F.lit("new")), path)
    return C.upsert_overlay(none, C.read_overlay(c, path)).select("id", "title")


@query("s13_provenance_log", "SELECT cast(started_at AS date)::varchar AS day, count(*) n FROM v_runs GROUP BY 1")
def _(s, d):
    path = scratch(s, "provenance")
    rows = L.provenance_of(view(s, d, "v_runs"))
    L.append_provenance(rows.filter("run_id % 2 = 0"), path)
    L.append_provenance(rows.filter("run_id % 2 = 1"), path)
    return s.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("w01_provenance_stream", "SELECT cast(ts AS date)::varchar AS day, count(*) n FROM events GROUP BY 1")
def _(s, d):
    table, path = s.read.parquet(f"{d}/events.parquet"), scratch(s, "stream")
    stream = s.readStream.schema(table.schema).parquet(f"{d}/events.parque[t]").withColumnRenamed("ts", "at")
    SL.stream_provenance(stream, path, scratch(s, "offsets"), once=True).awaitTermination()
    return s.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("w02_comment_stream", "SELECT id, count(*) n FROM (SELECT DISTINCT id FROM v_comments WHERE trim(author)<>'' AND trim(body)<>'') GROUP BY 1")
def _(s, d):
    table, path = s.read.parquet(f"{d}/conversations.parquet"), scratch(s, "stream")
    stream = s.readStream.schema(table.schema).parquet(f"{d}/conversations.parque[t]")
    said = stream.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("author"), F.col("text").alias("body"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("created_at"))
    SL.stream_comments(said.unionByName(said)).writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(s, "offsets")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(path).groupBy("id").agg(F.count("*").alias("n"))


@query("x01_sql_functions", "SELECT w.ward_code, round(area_km2,6) area_km2, round(density_per_km2,3) density_per_km2, round(c.cx,6) cx FROM v_density w LEFT JOIN v_centroid c USING (ward_code)")
def _(s, d):
    steps.register_functions(s)
    wards(s, d).createOrReplaceTempView("x01_wards")
    return s.sql("SELECT ward_code, round(a, 6) area_km2, round(density(p, a), 3) density_per_km2, round(c.x, 6) cx FROM (SELECT ward_code, cast(population AS double) p, feature_area_km2(rings) a, vertex_centroid(rings) c FROM x01_wards)")


@query("x02_steps", "SELECT ward_code, round(density_per_km2,3) density_per_km2 FROM v_density WHERE density_per_km2>0")
def _(s, d):
    named = [steps.Step("density", D.with_density, "area_km2 double, density_per_km2 double"), steps.Step("inhabited", lambda df: df.filter("density_per_km2 > 0")), steps.Step("columns", lambda df: df.select("ward_code", r("density_per_km2", 3).alias("density_per_km2")), "ward_code string, density_per_km2 double")]
    return steps.run_steps(wards(s, d), named)


def _staged(df: DataFrame, key: str, encode: Callable[[int], bytes], name: str) -> str:
    """A file for each key in the shared folder, a line feed after its bytes."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode(k) for k in batch.column(0).to_pylist()], pa.binary())], names=["value"])

    path = scratch(df.sparkSession, name)
    df.select(F.col(key).cast("long").alias(key)).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _tiff(k: int) -> bytes:
    """A TIFF header of which size, tiles, overviews and CRS follow from k; its directories stand at its end."""
    far = 70_000
    keys = struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, 4000 + k)
    entries = [(256, 4, 1, 100 + k), (257, 4, 1, 50 + k), (277, 4, 1, 1 + k % 4), (34735, 3, 8, far)] + ([(322, 4, 1, 256), (323, 4, 1, 128)] if k % 2 else [])
    directory = lambda rows, after: struct.pack("<H", len(rows)) + b"".join(struct.pack("<HHII", *e) for e in rows) + struct.pack("<I", after)
    sizes = [2 + 12 * len(entries) + 4] + [2 + 12 + 4] * (k % 3)
    starts = [far + len(keys) + sum(sizes[:i]) for i in range(len(sizes))] + [0]
    images = directory(entries, starts[1]) + b"".join(directory([(256, 4, 1, 8)], starts[i + 1]) for i in range(1, len(sizes)))
    return struct.pack("<2sHI", b"II", 42, starts[0]) + bytes(far - 8) + keys + images


@query("s15_raster_inventory", "SELECT 100+n_nationkey AS width, 50+n_nationkey AS height, 1+n_nationkey%4 AS bands, 'EPSG:'||(4000+n_nationkey) AS crs, n_nationkey%2=1 AS tiled, n_nationkey%3 AS overview_count, n_nationkey%2=1 AND n_nationkey%3>0 AS cloud_optimized FROM nation")
def _(s, d):
    path = _staged(s.read.parquet(f"{d}/nation.parquet"), "n_nationkey", _tiff, "rasters")
    return H.raster_inventory(s, path).select("width", "height", F.col("bands").cast("long").alias("bands"), "crs", "tiled", F.col("overview_count").cast("long").alias("overview_count"), "cloud_optimized")


def _cloud(k: int) -> bytes:
    """A LAS 1.4 header with a COPC info record, a projection record for odd k, and hierarchy pages of three levels: one
    node in the root page, 1 + k % 4 in the page that it points to, k % 3 in a page that this one points to."""
    head = bytearray(375)
    head[:4] = b"LASF"
    struct.pack_into("<H", head, 94, 375)
    struct.pack_into("<I", head, 100, 1 + k % 2)
    struct.pack_into("<6d", head, 179, k + 2.0, k, 4, 3, 6, 5)
    struct.pack_into("<Q", head, 247, 1000 * k)
    projection = bytearray(54)
    projection[2:17] = b"LASF_Projection"
    records = bytes(head) + (bytes(projection) if k % 2 else b"")
    node = lambda level, at, size, points: struct.pack("<4iQ2i", level, 0, 0, 0, at, size, points)
    root = len(records) + 54 + 160 + 5
    sizes = (64, 32 * (2 + k % 4), 32 * (k % 3))
    starts = (root, root + sizes[0] + 3, root + sizes[0] + 3 + sizes[1] + 7)
    pages = node(0, 1, 1, 10 + k) + node(1, starts[1], sizes[1], -1) + bytes(3)
    pages += b"".join(node(1, 1, 1, 20 + k) for _ in range(1 + k % 4)) + node(2, starts[2], sizes[2], -1) + bytes(7)
    pages += b"".join(node(2, 1, 1, 30 + k) for _ in range(k % 3))
    info = bytearray(54 + 160 + 5)
    info[2:6] = b"copc"
    struct.pack_into("<HH", info, 18, 1, 160)
    struct.pack_into("<5d2Q", info, 54, k + 1.0, 2, 3, 10, 0.5, root, sizes[0])
    return records + bytes(info) + pages


@query("s16_pointcloud_inventory", "SELECT 1000*n_nationkey AS point_count, n_nationkey::double AS min_x, n_nationkey+2::double AS max_x, CASE WHEN n_nationkey%2=1 THEN 'projected' ELSE 'unknown' END AS crs, n_nationkey+1::double AS center_x, 2+n_nationkey%4+n_nationkey%3 AS hierarchy_entries FROM nation")
def _(s, d):
    path = _staged(s.read.parquet(f"{d}/nation.parquet"), "n_nationkey", _cloud, "clouds")
    return H.pointcloud_inventory(s, path).select("point_count", "min_x", "max_x", "crs", "center_x", "hierarchy_entries")


@query("s16_pointcloud_nodes", """SELECT n_regionkey, level, sum(n)::bigint nodes, sum(n*(10*(level+1)+k))::bigint points FROM (SELECT n_regionkey, n_nationkey k, unnest([0,1,2]) level, unnest([1,1+n_nationkey%4,n_nationkey%3]) n FROM nation) WHERE n>0 GROUP BY 1,2""")
def _(s, d):
    nations = s.read.parquet(f"{d}/nation.parquet")
    path = _staged(nations, "n_nationkey", _cloud, "clouds")
    found = H.pointcloud_nodes(s, path).join(H.pointcloud_inventory(s, path).select("path", F.expr("point_count div 1000").alias("k")), "path")
    return found.join(nations, F.col("k") == F.col("n_nationkey")).groupBy("n_regionkey", "level").agg(F.sum("nodes").alias("nodes"), F.sum("points").alias("points"))


_Q = "(0.9933056200098587::double * (sin(radians({0})) / (1 - 0.0066943799901413165::double * sin(radians({0})) * sin(radians({0}))) + atanh(0.08181919084262149::double * sin(radians({0}))) / 0.08181919084262149::double))"


@query("x03_equal_area", f"""SELECT ward_code, round(list_sum(list_transform(rings, lambda g: CASE WHEN len(g)<3 THEN 0.0 ELSE abs(list_sum(list_transform(range(1,len(g)+1), lambda i:
  (radians(g[i].x)-radians(g[1].x)) * ({_Q.format('g[i%len(g)+1].y')} - {_Q.format('g[1].y')}) - (radians(g[i%len(g)+1].x)-radians(g[1].x)) * ({_Q.format('g[i].y')} - {_Q.format('g[1].y')})))) * 6378.137*6378.137/4 END)),5) area_km2,
  round(radians(rings[1][1].x)*6378.137,6) x, round(6378.137/2*{_Q.format('rings[1][1].y')},6) y FROM v_wards""")
def _(s, d):
    # the declared reprojection before areas are computed, as a named step
    done = steps.run_steps(wards(s, d), [steps.Step("ReprojectForAreaCalculation", D.with_equal_area, "area_km2 double")])
    first = F.get(F.get("rings", F.lit(0)), F.lit(0))
    return done.select("ward_code", r("area_km2", 5).alias("area_km2"), r(first["x"]).alias("x"), r(first["y"]).alias("y"))


@query("a11_large_groups", """SELECT grp, min(v) min_value, max(v) max_value, cast(sum(v)//count(*) AS bigint) mean_value, list_sort(list(v))[cast(count(*)//2 AS bigint)+1] median_value FROM (SELECT l_linenumber%2 AS grp, cast(l_orderkey*7919-l_partkey*1000003 AS bigint) v FROM lineitem) GROUP BY 1""")
def _(s, d):
    # half a million distinct values a group at sf0.1
    rows = s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_linenumber") % 2).alias("grp"), (F.col("l_orderkey") * 7919 - F.col("l_partkey") * 1000003).alias("v"))
    return D.timing_summary(rows, "grp", "v")


@query("w02_late_comments", "SELECT id, count(*) n FROM (SELECT DISTINCT id FROM v_comments WHERE trim(author)<>'' AND trim(body)<>'') GROUP BY 1")
def _(s, d):
    # all comments land twice, the second time a day later and from a stream of its own
    table, path = s.read.parquet(f"{d}/conversations.parquet"), scratch(s, "comments")
    for late in (0, 86_400):
        stream = s.readStream.schema(table.schema).parquet(f"{d}/conversations.parque[t]")
        said = stream.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("author"), F.col("text").alias("body"), F.timestamp_seconds(F.lit(1_700_000_000 + late)).alias("created_at"))
        SL.land_comments(said, path, scratch(s, "offsets"), once=True).awaitTermination()
    return s.read.parquet(path).filter("created_at < '2023-11-15'").groupBy("id").agg(F.count("*").alias("n"))


@query("s13_rerun", "SELECT cast(started_at AS date)::varchar AS day, count(*) n FROM v_runs GROUP BY 1")
def _(s, d):
    path, rows = scratch(s, "provenance"), L.provenance_of(view(s, d, "v_runs"))
    L.append_provenance(rows.filter("run_id % 3 > 0"), path)
    L.append_provenance(rows, path)
    L.append_provenance(rows, path)
    return s.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("j02_common_tag", "SELECT w.id AS request_id, c.id FROM v_catalog w JOIN v_catalog c ON list_has_all(list_append(c.tags, 'everywhere'), list_append(w.tags, 'everywhere')) WHERE cast(w.id AS bigint)%10=0")
def _(s, d):
    # every record has one tag, which every request asks for besides its own
    c = view(s, d, "v_catalog").withColumn("tags", F.concat("tags", F.array(F.lit("everywhere"))))
    return C.bind_datasets(c.filter("id % 10 = 0").select(F.col("id").alias("request_id"), F.col("tags").alias("required")), c)


@query("c12_citations", """SELECT c_custkey, coalesce(string_agg(DISTINCT s_name, '; ' ORDER BY s_name), '') AS sources FROM customer LEFT JOIN supplier ON c_nationkey=s_nationkey AND s_suppkey%3>0 GROUP BY 1""")
def _(s, d):
    # a customer's nation stands for the dataset, a nation's suppliers for what is cited; each citation is given twice
    customers = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("dataset_id"))
    cited = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("dataset_id"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).alias("citation"))
    return D.attach_sources(customers, cited.unionByName(cited), joined="; ").select("c_custkey", "sources")


@query("x01_more_functions", """SELECT ward_code, CASE WHEN z>=1 THEN 0 WHEN z>=0.5 THEN 1 ELSE 3 END AS lod, cls AS density_class, ['#edf4fc','#bfd8f2','#72ade0','#3372bf','#0c3f8c'][cls+1] AS color, len(ring) AS n_closed,
  round(10.0*2/4,6) AS third_break, cast(least(greatest(floor((cx-min_x)/greatest(max_x-min_x,1e-9)*7),0),6) AS int) AS tx, len(ring) AS n_simple
FROM (SELECT c.*, (cast(c.ward_code AS bigint)%12)/10.0 z FROM v_classed c) JOIN v_rings USING (ward_code) JOIN v_centroid USING (ward_code), v_box WHERE ring_no=0 AND len(ring)>2""")
def _(s, d):
    steps.register_functions(s)
    D.population_density(wards(s, d)).join(F.broadcast(D.equal_interval(D.with_density(wards(s, d)), "density_per_km2", 5).select("breaks"))).join(F.broadcast(D.dataset_bbox(wards(s, d)).select(F.struct("*").alias("box")))).createOrReplaceTempView("x01_dense")
    return s.sql(
        "SELECT ward_code, lod_for_zoom((cast(ward_code AS bigint) % 12) / 10D, 4) lod, cast(density_class(density_per_km2, breaks) AS bigint) density_class, class_color(density_class(density_per_km2, breaks)) color, "
        "cast(size(ensure_closed(rings[0])) AS bigint) n_closed, round(equal_interval(0D, 10D, 4)[2], 6) third_break, tile_index(vertex_centroid(rings).x, box.min_x, box.max_x, 7) tx, cast(size(simplify_ring(rings[0], 1)) AS bigint) n_simple FROM x01_dense WHERE size(rings[0]) > 2"
    )
