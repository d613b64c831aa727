"""The views of views.py in DuckDB's dialect, for oracle queries."""

from __future__ import annotations

import re

_BOX = "{'x':x0,'y':y0},{'x':x0+w,'y':y0},{'x':x0+w,'y':y0+w},{'x':x0,'y':y0+w},{'x':x0,'y':y0}"
DUCK = {
    "v_wards": f"""SELECT cast(p_partkey AS varchar) ward_code, p_name ward_name, cast(p_size*1000 AS bigint) population,
  CASE WHEN p_partkey%97=0 THEN [[{{'x':x0,'y':y0}},{{'x':x0+w,'y':y0}}]]
       WHEN p_partkey%5=0 THEN [[{_BOX}],[{{'x':x0+1,'y':y0}},{{'x':x0+1+w,'y':y0}},{{'x':x0+1,'y':y0+w}},{{'x':x0+1,'y':y0}}]]
       ELSE [[{_BOX}]] END rings
FROM (SELECT *, 136.0::double+(p_partkey%100)*0.01::double x0, 35.0::double+(p_partkey%37)*0.01::double y0, 0.005::double+p_size*0.0001::double w FROM part)""",
    "v_rings": "SELECT ward_code, unnest(rings) ring, generate_subscripts(rings,1)-1 ring_no FROM v_wards",
    "v_area": """SELECT ward_code, ring_no, ring, CASE WHEN len(ring)<3 THEN 0.0 ELSE
  abs(list_sum(list_transform(range(1,len(ring)+1), lambda i: ring[i].x*ring[i%len(ring)+1].y - ring[i%len(ring)+1].x*ring[i].y)))
  * cos(radians(list_sum(list_transform(ring, lambda p: p.y))/len(ring))) * (111.32::double*111.32::double*0.5::double) END area FROM v_rings""",
    "v_density": """SELECT w.ward_code, ward_name, population, area_km2, CASE WHEN area_km2>0 THEN population/area_km2 ELSE 0.0 END density_per_km2
FROM v_wards w JOIN (SELECT ward_code, sum(area) area_km2 FROM v_area GROUP BY 1) a USING (ward_code)""",
    "v_breaks": "SELECT list_transform(range(0,6), lambda i: lo + (CASE WHEN hi>lo THEN (hi-lo)/5 ELSE 1.0 END)*i) b FROM (SELECT min(density_per_km2) lo, max(density_per_km2) hi FROM v_density)",
    "v_classed": "SELECT d.*, len(list_filter(b[2:5], lambda x: density_per_km2 > x)) AS cls FROM v_density d, v_breaks",
    "v_box": "SELECT min(list_min(list_transform(ring, lambda p: p.x))) min_x, min(list_min(list_transform(ring, lambda p: p.y))) min_y, max(list_max(list_transform(ring, lambda p: p.x))) max_x, max(list_max(list_transform(ring, lambda p: p.y))) max_y FROM v_rings",
    "v_centroid": "SELECT ward_code, list_sum(list_transform(ring, lambda p: p.x))/len(ring) cx, list_sum(list_transform(ring, lambda p: p.y))/len(ring) cy FROM v_rings WHERE ring_no=0 AND len(ring)>0",
    "v_hits": """SELECT r_regionkey ord, r_name endpoint_id, cast(s_suppkey AS varchar) id, CASE WHEN s_suppkey%7=0 THEN NULL ELSE n_name END collection,
  130.0::double+(s_suppkey%60)*0.5::double min_x, 30.0::double+(s_suppkey%20)*0.5::double min_y, 130.4::double+(s_suppkey%60)*0.5::double max_x, 30.4::double+(s_suppkey%20)*0.5::double max_y
FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON s_suppkey%(r_regionkey+2)=0""",
    "v_items": """SELECT CASE WHEN collection IS NULL THEN id ELSE collection||'/'||id END AS item_key, min(id) id, min(collection) collection, min(min_x) min_x, min(min_y) min_y, max(max_x) max_x, max(max_y) max_y,
  string_agg(endpoint_id, ',' ORDER BY ord) sources, count(*) n_sources FROM (SELECT DISTINCT * FROM v_hits) GROUP BY 1""",
    "v_cands": """SELECT i.*, a.asset_key, a.asset_type, a.data_role, CASE WHEN cast(id AS bigint)%5=0 THEN 'unknown' ELSE 'EPSG:4326' END crs, CASE WHEN cast(id AS bigint)%11=0 THEN 'unknown' ELSE 'CC-BY-4.0' END AS license
FROM v_items i, (VALUES ('cog','image/tiff',true),('data','application/vnd.apache.parquet',true),('thumb','image/png',false)) a(asset_key, asset_type, data_role)""",
    "v_scored": """SELECT *, (data_role AND asset_type<>'image/png' AND crs<>'unknown' AND license<>'unknown') AS compatible,
  (CASE asset_type WHEN 'application/vnd.apache.parquet' THEN 100 WHEN 'image/tiff' THEN 90 ELSE 0 END) + (CASE WHEN data_role THEN 20 ELSE 0 END) + 5*n_sources
  + (CASE WHEN data_role AND asset_type<>'image/png' AND crs<>'unknown' AND license<>'unknown' THEN 1000 ELSE 0 END) AS score FROM v_cands""",
    "v_pixels": """SELECT vec_id raster_id, cast((pos-1)//8 AS int) r, cast((pos-1)%8 AS int) c, cast(greatest(0,least(255,floor((v::double+0.5::double)*255))) AS int) px
FROM (SELECT vec_id, unnest(embedding) v, generate_subscripts(embedding,1) pos FROM embeddings)""",
    "v_comments": """SELECT cast(conv_id AS varchar)||'-'||cast(turn AS varchar) id, cast(conv_id AS varchar) thread_id, role author, text body, conv_id%3 src FROM conversations""",
    "v_runs": "SELECT cast(event_id AS varchar) id, ts started_at, event_type workflow_id, value>50 verified, user_id%5=0 plan_only FROM events",
    "v_catalog": """SELECT cast(p_partkey AS varchar) id, p_name title, 'data/'||cast(p_partkey AS varchar)||'.parquet' uri, CASE WHEN p_partkey%3=0 THEN 'geojson' WHEN p_partkey%3=1 THEN 'geoparquet' ELSE 'cog' END AS format,
  CASE WHEN p_partkey%4=0 THEN 'unknown' ELSE 'CC-BY-4.0' END AS license, [p_brand, p_type, 'size'||cast(p_size%5 AS varchar)] tags,
  136.0::double+(p_partkey%100)*0.01::double min_x, 35.0::double+(p_partkey%37)*0.01::double min_y, 136.1::double+(p_partkey%100)*0.01::double max_x, 35.1::double+(p_partkey%37)*0.01::double max_y FROM part""",
    "v_population": "SELECT cast(l_partkey AS varchar) ward_code, cast(sum(l_quantity) AS bigint) population FROM lineitem GROUP BY l_partkey",
}


def oracle(sql: str) -> str:
    """sql with the views that it names, directly or through others, as common table expressions."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+\b", text):
            if name in DUCK and name not in need:
                visit(DUCK[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    return ("WITH " + ",\n".join(f"{n} AS ({DUCK[n]})" for n in need) + "\n" if need else "") + sql
