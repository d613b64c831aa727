"""Dataset catalog: a table of records keyed by id, tag search and binding, STAC export and import."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasheaf.functions import geometry as G
from terrasheaf.functions import text as X


def register(catalog: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """catalog with new's rows in place of those with the same key."""
    return catalog.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def read_overlay(catalog: DataFrame, path: str) -> DataFrame:
    """The overlay written at path, with the catalog's columns; absent: no rows; lines that do not parse are left out."""
    spark = catalog.sparkSession
    try:
        return spark.read.schema(catalog.schema).option("mode", "DROPMALFORMED").json(path).filter(F.col("id").isNotNull())
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], catalog.schema)


def write_overlay(overlay: DataFrame, path: str) -> None:
    """Persists imported records, in place of those of the path."""
    overlay.write.mode("overwrite").json(path)


def upsert_overlay(catalog: DataFrame, overlay: DataFrame | None) -> DataFrame:
    return catalog if overlay is None else register(catalog, overlay)


def require(catalog: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The records of all ids; a row that asks for an unknown id raises when it is read."""
    known = catalog.withColumn("_known", F.lit(True))
    found = ids.select(key).distinct().join(known, key, "left")
    name = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no dataset "), F.col(key)))).otherwise(F.col(key))
    return found.withColumn(key, name).drop("_known")


def remove(catalog: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """catalog without ids; an unknown id raises when it is read."""
    unknown = ids.select(key).join(catalog.select(key), key, "left_anti").select(F.raise_error(F.concat(F.lit("no dataset "), F.col(key))).cast("string").alias(key))
    return catalog.join(ids.select(key).unionByName(unknown), key, "left_anti")


def listed(catalog: DataFrame, key: str = "id") -> DataFrame:
    return catalog.orderBy(key)


#: A tag on more records than this, and than a HOT_TAGS-th of all tags given, is hot; HOT_TAGS tags can be, at most.
HOT_RECORDS, HOT_TAGS = 100_000, 10_000


def tag_counts(catalog: DataFrame) -> DataFrame:
    """(tag, records, slots): records with each tag, counted where they are first; slots: 1, or for a hot tag so many
    that each has about HOT_RECORDS of them."""
    counts = catalog.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("records"))
    total = F.broadcast(counts.agg(F.sum("records").alias("total")))
    hot = F.col("records") > F.greatest(F.lit(HOT_RECORDS), F.expr(f"total div {HOT_TAGS}"))
    return counts.join(total).select("tag", "records", F.when(hot, F.ceil(F.col("records") / HOT_RECORDS)).otherwise(1).cast("int").alias("slots"))


def rarest_tags(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """(request_id, required, tag, slots): the required tag that the fewest records have; requests with none of a tag
    anywhere, and those without tags, are left out."""
    wanted = requests.select("request_id", F.array_distinct("required").alias("required")).filter(F.size("required") > 0)
    each = wanted.select("request_id", "required", F.explode("required").alias("tag")).join(counts, "tag")
    chosen = each.groupBy("request_id", "required").agg(F.min(F.struct("records", "tag", "slots")).alias("rare"), F.count("*").alias("known"))
    return chosen.filter(F.col("known") == F.size("required")).select("request_id", "required", "rare.tag", "rare.slots")


def offered_tags(catalog: DataFrame, rare: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, tags, tag, slot): a row for each record and tag, without hot tags that are no request's rarest."""
    used = rare.select("tag").distinct()
    hot = counts.filter("slots > 1").join(used.withColumn("used", F.lit(True)), "tag", "left").select("tag", F.col("slots").alias("_slots"), F.coalesce("used", F.lit(False)).alias("used"))
    rows = catalog.select("id", "tags", F.explode(F.array_distinct("tags")).alias("tag")).join(F.broadcast(hot), "tag", "left")  # HOT_TAGS rows at most
    return rows.filter("used is null or used").select("id", "tags", "tag", F.pmod(F.xxhash64("id"), F.coalesce("_slots", F.lit(1))).cast("int").alias("slot"))


def matching_sets(asked: DataFrame, offered: DataFrame) -> DataFrame:
    """(required, tags): the distinct sets of tags asked for, each with the distinct sets offered that hold all of it.

    A set meets only those with its rarest tag, and the others of its tags are looked for there; so a tag that most have is
    no key of the join unless a set has no other. Such a tag's sets are dealt to several slots, each of which is asked."""
    requests, catalog = asked.select(F.col("required").alias("request_id"), "required").distinct(), offered.select(F.col("tags").alias("id"), "tags").distinct()
    counts = tag_counts(catalog)
    rare = rarest_tags(requests, counts)
    asked = rare.select("request_id", "required", "tag", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    met = asked.join(offered_tags(catalog, rare, counts), ["tag", "slot"])
    return met.filter(X.has_all_tags(F.col("tags"), F.col("required"))).select("required", "tags")


def bind_datasets(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """(request_id, id) for each record with all of a request's tags (array `required`); no tags: no match.

    Tags are compared once for each pair of different sets of tags, whatever the number of requests and records that share
    them; then records and requests meet by the set asked for, so no pair is made that is not a result. The records of a
    set that very many answer are dealt to slots. Repeated tags, requests and records count once."""
    once = lambda tags: F.array_sort(F.array_distinct(tags))
    offered, asked = catalog.select("id", once("tags").alias("tags")), requests.select("request_id", once("required").alias("required"))
    rows = offered.join(matching_sets(asked, offered), "tags").select("required", "id").distinct()
    hot = F.broadcast(rows.groupBy("required").agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_RECORDS).select("required", F.ceil(F.col("_n") / HOT_RECORDS).cast("int").alias("_slots")))
    dealt = rows.join(hot, "required", "left").select("required", "id", F.pmod(F.xxhash64("id"), F.coalesce("_slots", F.lit(1))).cast("int").alias("slot"))
    sets = asked.groupBy("request_id").agg(F.collect_set("required").alias("sets"))

    def met(some: DataFrame) -> DataFrame:
        each = some.select("request_id", F.explode("sets").alias("required")).join(hot, "required", "left")
        slots = F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)) - 1)
        return each.select("request_id", "required", F.explode(slots).alias("slot")).join(dealt, ["required", "slot"]).select("request_id", "id")

    # an id that asks for one set meets a record once
    return met(sets.filter("size(sets) = 1")).unionByName(met(sets.filter("size(sets) > 1")).distinct())


def match_dataset(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """(request_id, status, id, n_ids): one match is `matched`, none `no_match`, several `ambiguous`; n_ids counts them
    and id is the smallest, so no list grows with the catalog. ambiguous_ids() has all of them, as rows."""
    found = bind_datasets(requests, catalog).groupBy("request_id").agg(F.count("*").alias("n_ids"), F.min("id").alias("id"))
    joined = requests.select("request_id").join(found, "request_id", "left").withColumn("n_ids", F.coalesce("n_ids", F.lit(0)))
    return joined.select("request_id", F.when(F.col("n_ids") == 0, "no_match").when(F.col("n_ids") == 1, "matched").otherwise("ambiguous").alias("status"), "id", "n_ids")


def ambiguous_ids(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """(request_id, id): every id of the requests that several records match, in order."""
    found = bind_datasets(requests, catalog)
    several = found.groupBy("request_id").count().filter(F.col("count") > 1).select("request_id")
    return found.join(several, "request_id", "left_semi").orderBy("request_id", "id")


def collection_summary(catalog: DataFrame) -> DataFrame:
    """One row: union of the boxes, item count and the number of items by format (as JSON, formats in order)."""
    box = catalog.agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"), F.count("*").alias("item_count"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    formats = catalog.groupBy("format").count().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("format", "count"))), lambda s: F.concat_ws("=", s["format"], s["count"].cast("string"))), ",").alias("formats"))
    return box.join(F.broadcast(formats))


def collection_items(catalog: DataFrame) -> DataFrame:
    """The same order for ids and formats, as rows: a list of all items in one row would not scale."""
    return catalog.select("id", "format").orderBy("id")


def records_to_items(catalog: DataFrame) -> DataFrame:
    """STAC items: box polygon, properties as JSON, one asset keyed by format, self link."""
    geometry = G.bbox_polygon(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"))
    media = F.create_map(*(F.lit(x) for pair in X.MEDIA.items() for x in pair))
    asset = F.struct(F.col("uri").alias("href"), F.element_at(media, F.col("format")).alias("type"), F.array(F.lit("data")).alias("roles"), F.col("title").alias("title"))
    return catalog.select(
        "id", F.lit("Feature").alias("type"), geometry.alias("geometry"), F.array("min_x", "min_y", "max_x", "max_y").alias("bbox"),
        F.to_json(F.struct("title", "license", F.col("crs").alias("proj:code"), "tags")).alias("properties"),
        F.create_map(F.col("format"), asset).alias("assets"), F.array(F.struct(F.lit("self").alias("rel"), F.concat(F.lit("./"), F.col("id"), F.lit(".json")).alias("href"))).alias("links"),
    )


def items_to_records(items: DataFrame, item_uri: str = "uri") -> DataFrame:
    """Catalog records of STAC items: the first asset (by key) with role `data`, else the first; none: rejected by error.

    title defaults to the id, license to `unknown`, crs to EPSG:4326 unless the item declares one."""
    entries = F.array_sort(F.map_entries("assets"))
    data = F.filter(entries, lambda e: X.has_data_role(e["value"]["roles"]))
    chosen = F.coalesce(F.get(data, F.lit(0)), F.get(entries, F.lit(0)))
    picked = items.withColumn("_a", F.when(F.coalesce(F.size("assets"), F.lit(0)) > 0, chosen).otherwise(F.raise_error(F.concat(F.lit("no asset in item "), F.col("id")))))
    text = lambda *keys: X.first_text(F.col("properties"), keys)
    known = lambda value, default: F.when(value != "unknown", value).otherwise(default)
    return picked.select(
        "id", known(text("title"), F.col("id")).alias("title"), X.resolve_href(F.col("_a.value.href"), F.col(item_uri)).alias("uri"),
        X.format_from_media_type(F.coalesce("_a.value.type", F.lit(""))).alias("format"), known(text("proj:code"), F.lit("EPSG:4326")).alias("crs"), text("license").alias("license"),
        F.array(F.lit("stac"), F.lit("imported"), F.concat(F.lit("asset:"), F.col("_a.key"))).alias("tags"),
    )


def verify_collections(df: DataFrame) -> DataFrame:
    return df.withColumn("passed", (F.coalesce("id", F.lit("")) != "") & F.coalesce(F.col("type") == "Collection", F.lit(False)))
