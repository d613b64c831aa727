"""GeoJSON, nested lookups, STAC documents and run files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_splits import SPLIT_BYTES, feature_texts, splittable

_POSITIONS = "array<array<double>>"
_FEATURE = "type string, id string, properties string, geometry struct<type: string, coordinates: string>"
_ASSETS = "map<string, struct<href: string, type: string, roles: array<string>, title: string>>"
STAC_ITEM = f"type string, id string, collection string, bbox array<double>, properties string, assets {_ASSETS}, links array<struct<rel: string, href: string>>"


def to_rings(kind: Column, coordinates: Column) -> Column:
    """Exterior rings of a Polygon (one) or MultiPolygon (one a part) from coordinates as JSON; holes are dropped.

    Empty geometries and other types raise when the row is read."""
    xy = lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    polygon = F.from_json(coordinates, f"array<{_POSITIONS}>")
    multi = F.from_json(coordinates, f"array<array<{_POSITIONS}>>")
    rings = F.when(kind == "Polygon", F.transform(F.slice(polygon, 1, 1), xy)).when(kind == "MultiPolygon", F.transform(multi, lambda part: xy(F.get(part, F.lit(0)))))
    bad = F.raise_error(F.concat(F.lit("no rings in geometry "), F.coalesce(kind, F.lit("null")))).cast("array<array<struct<x: double, y: double>>>")
    return F.when(rings.isNull() | (F.size(rings) == 0) | F.exists(rings, lambda r: r.isNull() | (F.size(r) == 0)), bad).otherwise(rings)


def read_geojson(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(features, meta) of FeatureCollection files: (id by position, properties JSON, rings) and (name, crs).

    Another root type or a feature without geometry raises when read. Files are read in ranges of split_bytes by many
    tasks where tasks can read ranges of the store, else each file by one task; rows are the same."""
    if splittable(spark, path):
        elements, roots = feature_texts(spark, path, split_bytes)
        doc = roots.select("path", "complete", F.from_json("root", "type string, name string, crs string").alias("d")).select("path", "complete", "d.*")
        good = F.coalesce((F.col("type") == "FeatureCollection") & F.col("complete"), F.lit(False))
        wrong = F.raise_error(F.lit("not a FeatureCollection")).cast("boolean")
        features = _features(elements.select("id", F.from_json("element", _FEATURE).alias("f")))
        refused = doc.filter(F.when(good, F.lit(False)).otherwise(wrong))  # never a row: it raises where a file is none
        none = refused.select(*(F.lit(None).cast(t).alias(n) for n, t in features.dtypes))
        return features.unionByName(none), doc.filter(F.when(good, F.lit(True)).otherwise(wrong)).select(*_meta())
    doc = spark.read.schema(f"type string, name string, crs string, features array<struct<{_FEATURE}>>").option("multiLine", True).json(path)
    features = F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(F.raise_error(F.lit("not a FeatureCollection")))
    return _features(doc.select(F.posexplode(features).alias("id", "f"))), doc.select(*_meta())


def _meta() -> list[Column]:
    named = F.when(~F.col("crs").startswith("{"), F.col("crs"))
    return [F.coalesce("name", F.lit("unnamed")).alias("name"), F.coalesce(F.get_json_object("crs", "$.properties.name"), named, F.lit("EPSG:4326")).alias("crs")]


def _features(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("f.geometry").isNull(), F.raise_error(F.lit("feature without geometry"))).otherwise(F.col("f.geometry.type"))
    return df.select(F.col("id").cast("long").alias("id"), F.col("f.properties").alias("properties"), to_rings(kind, F.col("f.geometry.coordinates")).alias("rings"))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features of newline-delimited GeoJSON; splittable. Ids ascend with file and line but are not dense."""
    rows = spark.read.schema(_FEATURE).json(path)
    return _features(rows.select(F.monotonically_increasing_id().alias("id"), F.struct("*").alias("f")))


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """(census_year, source, ward_code, ward_name, population) of a nested lookup file."""
    schema = "census_year int, source string, wards array<struct<ward_code: string, ward_name: string, ward_name_en: string, population: bigint>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("census_year", "source", F.explode("wards").alias("w")).select("census_year", "source", "w.*")


def _defaults(df: DataFrame) -> DataFrame:
    kept = F.transform_values("assets", lambda _, a: F.struct(a["href"].alias("href"), a["type"].alias("type"), F.coalesce(a["roles"], F.array().cast("array<string>")).alias("roles"), a["title"].alias("title")))
    return df.withColumn("assets", F.coalesce(kept, F.create_map().cast(_ASSETS))).withColumn("links", F.coalesce("links", F.array().cast("array<struct<rel: string, href: string>>")))


def _box() -> list[Column]:
    return [F.get("bbox", F.lit(k)).alias(n) for k, n in enumerate(("min_x", "min_y", "max_x", "max_y"))]


def read_stac_items(spark: SparkSession, paths: list[str] | str) -> tuple[DataFrame, DataFrame]:
    """(items, outcomes): items of landed search responses, one file an endpoint, and a row per file with its error.

    A file that is not JSON or not a FeatureCollection gives an error row and no items; the others go on."""
    item = f"struct<{STAC_ITEM}>"
    docs = spark.read.schema(f"type string, features array<{item}>, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(paths).withColumn("endpoint_file", F.input_file_name())
    error = F.when(F.col("_corrupt").isNotNull(), "corrupt response").when(~F.coalesce(F.col("type") == "FeatureCollection", F.lit(False)), "not a FeatureCollection")
    judged = docs.withColumn("error", error)
    items = judged.filter("error is null").select("endpoint_file", F.explode(F.coalesce("features", F.array().cast(f"array<{item}>"))).alias("i")).select("endpoint_file", "i.*")
    matched = F.when(F.col("error").isNull(), F.coalesce(F.size("features"), F.lit(0))).otherwise(0)
    return _defaults(items).select("*", *_box()), judged.select("endpoint_file", "error", matched.alias("matched"))


def read_stac_item(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Items that stand alone, one a file, in the shape of read_stac_items; another type or no id is an error when read.

    lines: one a line, as many items are better kept; such files are read in splits."""
    docs = spark.read.schema(STAC_ITEM).option("multiLine", not lines).json(path).withColumn("endpoint_file", F.input_file_name())
    good = F.coalesce((F.col("type") == "Feature") & F.col("id").isNotNull(), F.lit(False))
    checked = docs.withColumn("id", F.when(good, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no STAC item in "), F.col("endpoint_file")))))
    return _defaults(checked).select("endpoint_file", *(c for c in checked.columns if c != "endpoint_file"), *_box())


def read_stac_collection(spark: SparkSession, path: str) -> DataFrame:
    schema = "type string, id string, title string, description string, license string, extent string, links array<struct<rel: string, href: string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_runs(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Runs of a folder of JSON files, one or a list in each; other files and those that do not parse are skipped, no folder: no rows."""
    schema = "id string, prompt string, workflow_id string, started_at timestamp, verified boolean, plan_only boolean, attempts int, steps array<struct<id: string, role: string>>"
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", pattern).json(folder)
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)


def write_svg_paths(df: DataFrame, path: str) -> None:
    """df (path, color, ward_name, density_per_km2) as one SVG path element a line."""
    from terrasheaf.functions.text import escape_xml

    name = escape_xml(F.coalesce("ward_name", F.lit("")))
    df.select(F.format_string('<path d="%s" fill="%s"><title>%s: %.0f</title></path>', "path", "color", name, "density_per_km2").alias("value")).write.text(path)
