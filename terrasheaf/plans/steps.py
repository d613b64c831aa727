"""Named steps over a DataFrame, and the functions by name in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrasheaf.operators.federation import compare_and_bind, federated_search
from terrasheaf.sources.geoparquet import geoparquet_footer, read_geoparquet


class Step(NamedTuple):
    name: str
    run: Callable[[DataFrame], DataFrame]
    schema: str | None = None


def run_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """df through all steps; a step that declares a schema must give these columns with these types."""
    for step in steps:
        df = df.transform(step.run)
        if step.schema is not None:
            want, got = StructType.fromDDL(step.schema), {f.name: f.dataType for f in df.schema}
            wrong = [f.name for f in want if got.get(f.name) != f.dataType]
            if wrong:
                raise ValueError(f"step {step.name}: columns {wrong} differ from the declared schema")
    return df


_RING, _RINGS = "array<struct<x: double, y: double>>", "array<array<struct<x: double, y: double>>>"
_BOX = "struct<min_x: double, min_y: double, max_x: double, max_y: double>"
#: Width and height of the box on a viewport padded by 24, and the point's place on it.
_WIDE = "(greatest(box.max_x - box.min_x, 1e-9D) / greatest(box.max_y - box.min_y, 1e-9D))"
_DRAWN = (f"(CASE WHEN {_WIDE} > (width - 48) / (height - 48) THEN width - 48 ELSE {_WIDE} * (height - 48) END)", f"(CASE WHEN {_WIDE} > (width - 48) / (height - 48) THEN (width - 48) / {_WIDE} ELSE height - 48 END)")
_NDC = (
    f"named_struct('x', cast((24 + (width - 48 - {_DRAWN[0]}) / 2 + (x - box.min_x) / greatest(box.max_x - box.min_x, 1e-9D) * {_DRAWN[0]}) / width * 2 - 1 AS FLOAT), "
    f"'y', cast(1 - (24 + (height - 48 - {_DRAWN[1]}) / 2 + (box.max_y - y) / greatest(box.max_y - box.min_y, 1e-9D) * {_DRAWN[1]}) / height * 2 AS FLOAT))"
)
FUNCTIONS = {
    "ring_area_km2(ring " + _RING + ")": "CASE WHEN size(ring) < 3 THEN 0.0D ELSE abs(aggregate(zip_with(ring, concat(slice(ring, 2, size(ring)), slice(ring, 1, 1)), (p, q) -> p.x * q.y - q.x * p.y), 0.0D, (t, v) -> t + v)) * cos(radians(aggregate(transform(ring, p -> p.y), 0.0D, (t, v) -> t + v) / size(ring))) * (111.32D * 111.32D * 0.5D) END",
    "density(population DOUBLE, area DOUBLE)": "CASE WHEN area > 0 AND NOT isnan(area) THEN population / area ELSE 0.0D END",
    "lod_for_zoom(zoom DOUBLE, levels INT)": "CASE WHEN zoom >= 1 THEN 0 WHEN zoom >= 0.5 THEN least(1, greatest(levels - 1, 0)) ELSE greatest(levels - 1, 0) END",
    "vertex_centroid(rings " + _RINGS + ")": "CASE WHEN size(get(rings, 0)) > 0 THEN named_struct('x', aggregate(transform(get(rings, 0), p -> p.x), 0.0D, (t, v) -> t + v) / size(get(rings, 0)), 'y', aggregate(transform(get(rings, 0), p -> p.y), 0.0D, (t, v) -> t + v) / size(get(rings, 0))) END",
    "bbox_polygon(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE)": "array(named_struct('x', a, 'y', b), named_struct('x', c, 'y', b), named_struct('x', c, 'y', d), named_struct('x', a, 'y', d), named_struct('x', a, 'y', b))",
    "density_class(value DOUBLE, breaks array<double>)": "CASE WHEN isnan(value) THEN size(breaks) - 2 ELSE size(filter(slice(breaks, 2, greatest(size(breaks) - 2, 0)), b -> value > b)) END",
    "class_color(number INT)": "element_at(array('#edf4fc', '#bfd8f2', '#72ade0', '#3372bf', '#0c3f8c'), number + 1)",
    "ensure_closed(ring " + _RING + ")": "CASE WHEN size(ring) >= 2 AND (abs(get(ring, 0).x - get(ring, size(ring) - 1).x) > 2.220446049250313E-16D OR abs(get(ring, 0).y - get(ring, size(ring) - 1).y) > 2.220446049250313E-16D) THEN concat(ring, slice(ring, 1, 1)) ELSE ring END",
    "equal_interval(low DOUBLE, high DOUBLE, classes INT)": "transform(sequence(0, greatest(classes, 2)), i -> low + (CASE WHEN high > low THEN (high - low) / greatest(classes, 2) ELSE 1.0D END) * i)",
    "simplify_ring(ring " + _RING + ", lod INT)": "CASE WHEN size(ring) <= 4 OR lod < 1 THEN ring ELSE element_at(transform(array(ensure_closed(filter(ring, (p, i) -> i % cast(pow(2, least(lod, 6)) AS INT) = 0))), s -> CASE WHEN size(s) < 4 THEN ring ELSE s END), 1) END",
    "to_ndc(x DOUBLE, y DOUBLE, box " + _BOX + ", width DOUBLE, height DOUBLE)": _NDC,
    "svg_path(ring " + _RING + ", box " + _BOX + ", width DOUBLE, height DOUBLE, pad DOUBLE)": "concat_ws(' ', array_join(transform(ring, (p, i) -> format_string('%s %.2f %.2f', CASE WHEN i = 0 THEN 'M' ELSE 'L' END, pad + (p.x - box.min_x) / greatest(box.max_x - box.min_x, 1e-9D) * (width - 2 * pad), pad + (box.max_y - p.y) / greatest(box.max_y - box.min_y, 1e-9D) * (height - 2 * pad))), ' '), 'Z')",
    "tile_index(v DOUBLE, low DOUBLE, high DOUBLE, n INT)": "cast(least(greatest(floor((v - low) / greatest(high - low, 1e-9D) * n), 0), n - 1) AS INT)",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the geometry functions callable from SQL by name; as SQL functions they stay visible to the optimizer."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    area = "CREATE OR REPLACE TEMPORARY FUNCTION feature_area_km2(rings " + _RINGS + ") RETURN aggregate(transform(rings, r -> CASE WHEN size(r) < 3 THEN 0.0D ELSE abs(aggregate(zip_with(r, concat(slice(r, 2, size(r)), slice(r, 1, 1)), (p, q) -> p.x * q.y - q.x * p.y), 0.0D, (t, v) -> t + v)) * cos(radians(aggregate(transform(r, p -> p.y), 0.0D, (t, v) -> t + v) / size(r))) * (111.32D * 111.32D * 0.5D) END), 0.0D, (t, v) -> t + v)"
    spark.sql(area)
    return [h.split("(")[0] for h in FUNCTIONS] + ["feature_area_km2"]


def federated_execute(hits: DataFrame, endpoints: DataFrame, media_types: Sequence[str], bbox: Sequence[float] | None = None, locate: Callable[[str], str] = str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bound, rows, checks): search, merge, bind, then row group 0 of the bound asset (a GeoParquet file or folder; locate
    maps its address to where it is read). One binding row reaches the driver.

    checks (name, passed, detail): the schema is not empty, its CRS is the binding's, and what was read is what was bound."""
    bound = compare_and_bind(federated_search(hits, bbox), endpoints, media_types, bbox)
    spark = hits.sparkSession
    one = bound.select("href", "crs").first()
    path = locate(one["href"])
    rows = read_geoparquet(spark, path, row_groups=[0])
    footers = geoparquet_footer(spark, path)
    binding = F.struct(F.lit(one["href"]).alias("href"), F.lit(one["crs"]).alias("crs"), F.lit(path).alias("path"))
    seen = footers.agg(F.min(F.size("schema_fields")).alias("fields"), F.min("crs").alias("crs"), F.bool_and(F.col("crs") == one["crs"]).alias("same_crs"), F.count("*").alias("files"), F.count_if(F.contains(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), F.regexp_replace(binding["path"], "^[a-z0-9]+:/*", "/"))).alias("of_source")).withColumn("b", binding)
    check = lambda name, passed, detail: F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.alias("detail"))
    checks = F.array(
        check("schema_fields", F.col("fields") > 0, F.col("fields").cast("string")),
        check("crs_matches_binding", F.col("same_crs"), F.concat_ws(" / ", "crs", "b.crs")),
        check("source_matches_binding", (F.col("files") > 0) & (F.col("files") == F.col("of_source")), F.col("b.href")),
    )
    return bound, rows, seen.select(F.explode(checks).alias("c")).select("c.*")
