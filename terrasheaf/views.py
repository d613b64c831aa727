"""Geospatial views over the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_wards": """SELECT cast(p_partkey AS string) ward_code, p_name ward_name, cast(p_size*1000 AS bigint) population,
  CASE WHEN p_partkey%97=0 THEN array(array(struct(x0 AS x,y0 AS y), struct(x0+w AS x,y0 AS y)))
       WHEN p_partkey%5=0 THEN array(
         array(struct(x0 AS x,y0 AS y),struct(x0+w AS x,y0 AS y),struct(x0+w AS x,y0+w AS y),struct(x0 AS x,y0+w AS y),struct(x0 AS x,y0 AS y)),
         array(struct(x0+1 AS x,y0 AS y),struct(x0+1+w AS x,y0 AS y),struct(x0+1 AS x,y0+w AS y),struct(x0+1 AS x,y0 AS y)))
       ELSE array(array(struct(x0 AS x,y0 AS y),struct(x0+w AS x,y0 AS y),struct(x0+w AS x,y0+w AS y),struct(x0 AS x,y0+w AS y),struct(x0 AS x,y0 AS y))) END rings
FROM (SELECT *, 136.0D+(p_partkey%100)*0.01D x0, 35.0D+(p_partkey%37)*0.01D y0, 0.005D+p_size*0.0001D w FROM {part})""",
    "v_hits": """SELECT r_regionkey ord, r_name endpoint_id, cast(s_suppkey AS string) id, CASE WHEN s_suppkey%7=0 THEN NULL ELSE n_name END collection,
  130.0D+(s_suppkey%60)*0.5D min_x, 30.0D+(s_suppkey%20)*0.5D min_y, 130.4D+(s_suppkey%60)*0.5D max_x, 30.4D+(s_suppkey%20)*0.5D max_y
FROM {supplier} JOIN {nation} ON s_nationkey=n_nationkey JOIN {region} ON s_suppkey%(r_regionkey+2)=0""",
    "v_pixels": """SELECT vec_id raster_id, cast(pos div 8 AS int) r, cast(pos%8 AS int) c, cast(greatest(0,least(255,floor((cast(v as double)+0.5)*255))) AS int) px
FROM (SELECT vec_id, posexplode(embedding) AS (pos,v) FROM {embeddings})""",
    "v_comments": """SELECT concat(cast(conv_id AS string),'-',cast(turn AS string)) id, cast(conv_id AS string) thread_id, role author, text body, conv_id%3 src,
  timestamp_seconds(1700000000+conv_id*60+turn) created_at FROM {conversations}""",
    "v_runs": """SELECT cast(event_id AS string) id, ts started_at, event_type workflow_id, value>50 verified, user_id%5=0 plan_only FROM {events}""",
    "v_catalog": """SELECT cast(p_partkey AS string) id, p_name title, concat('data/',cast(p_partkey AS string),'.parquet') uri,
  CASE WHEN p_partkey%3=0 THEN 'geojson' WHEN p_partkey%3=1 THEN 'geoparquet' ELSE 'cog' END format, 'EPSG:4326' crs, CASE WHEN p_partkey%4=0 THEN 'unknown' ELSE 'CC-BY-4.0' END license,
  array(p_brand, p_type, concat('size', cast(p_size%5 AS string))) tags,
  136.0D+(p_partkey%100)*0.01D min_x, 35.0D+(p_partkey%37)*0.01D min_y, 136.1D+(p_partkey%100)*0.01D max_x, 35.1D+(p_partkey%37)*0.01D max_y FROM {part}""",
    "v_population": "SELECT cast(l_partkey AS string) ward_code, cast(sum(l_quantity) AS bigint) population FROM {lineitem} GROUP BY l_partkey",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name; the tables it names are read from sf_dir."""
    tables = ("part", "supplier", "nation", "region", "embeddings", "conversations", "events", "lineitem")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables if "{" + t + "}" in VIEWS[name]}
    return spark.sql(VIEWS[name], **used)
