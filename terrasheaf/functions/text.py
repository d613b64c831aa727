"""Text and URI rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types of the three vector and raster formats.
MEDIA = {"geojson": "application/geo+json", "geoparquet": "application/vnd.apache.parquet", "cog": "image/tiff; application=geotiff; profile=cloud-optimized"}
_TRIM = "\"'「」,.;:)(]["


def escape_xml(text: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def normalize_prompt(text: Column) -> Column:
    """Lower case; white space, the ideographic space included, becomes single spaces; no space at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[\s　\u0085 ]+", " "))


def extract_catalog_url(text: Column) -> Column:
    """The first word that, without punctuation around it, starts like a catalog address; else null."""
    words = F.transform(F.split(text, r"[\s　]+"), lambda w: F.btrim(w, F.lit(_TRIM)))
    starts = ("http://", "https://", "file://", "examples/")
    return F.get(F.filter(words, lambda w: w.startswith(starts[0]) | w.startswith(starts[1]) | w.startswith(starts[2]) | w.startswith(starts[3])), F.lit(0))


def is_remote_uri(uri: Column) -> Column:
    return uri.startswith("http://") | uri.startswith("https://")


def search_url(url: Column) -> Column:
    base = F.rtrim(url, F.lit("/"))
    return F.when(base.endswith("/search"), base).otherwise(F.concat(base, F.lit("/search")))


def dataset_name(uri: Column) -> Column:
    """Last path part without query and `.parquet`; nothing left: `geoparquet`."""
    name = F.regexp_replace(F.split_part(F.regexp_extract(uri, r"[^/\\]*$", 0), F.lit("?"), F.lit(1)), r"\.parquet$", "")
    return F.when(name == "", F.lit("geoparquet")).otherwise(name)


def resolve_href(href: Column, item_uri: Column) -> Column:
    """Absolute addresses and paths stay, `file://` is taken off; relative ones join the item's folder."""
    plain = lambda u: F.regexp_replace(u, "^file://", "")
    absolute = is_remote_uri(href) | href.startswith("file://") | href.startswith("/")
    folder = F.regexp_extract(plain(item_uri), "^(.*)/", 1)
    joined = F.when(plain(item_uri).contains("/"), F.concat(folder, F.lit("/"), href)).otherwise(href)
    return F.when(absolute, plain(href)).otherwise(joined)


def format_from_media_type(media: Column) -> Column:
    return F.when(media.contains("parquet"), "geoparquet").when(media.contains("tiff"), "cog").otherwise("geojson")


def item_key(collection: Column, item: Column) -> Column:
    return F.when(collection.isNotNull(), F.concat(collection, F.lit("/"), item)).otherwise(item)


def crs_text(meta: Column) -> Column:
    """CRS of a GeoParquet column's metadata (JSON): authority and code, at the top or under `id`; a plain string as it
    is; else EPSG:4326."""
    value = lambda p: F.get_json_object(meta, "$.crs" + p)
    coded = [F.concat(value(a), F.lit(":"), value(c)) for a, c in ((".authority", ".code"), (".auth_name", ".code"), (".id.authority", ".id.code"))]
    plain = F.when(~F.coalesce(value("").startswith("{"), F.lit(True)), value(""))
    return F.coalesce(*coded, plain, F.lit("EPSG:4326"))


def first_text(properties: Column, keys: Sequence[str]) -> Column:
    """The first of the keys whose JSON value is a string; else `unknown`. Numbers, null and objects are passed over."""
    document = F.try_parse_json(properties)

    def string(key: str) -> Column:
        path = f"$['{key}']"
        kind = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
        return F.when(kind == "STRING", F.try_variant_get(document, path, "string"))

    return F.coalesce(*map(string, keys), F.lit("unknown"))


def has_all_tags(tags: Column, required: Column) -> Column:
    """Whether tags has every required one; nothing required: no."""
    return F.coalesce((F.size(required) > 0) & (F.size(F.array_except(required, tags)) == 0), F.lit(False))


def has_data_role(roles: Column) -> Column:
    return F.coalesce(F.array_contains(roles, "data"), F.lit(False))


def url_admission(url: Column, allowed_hosts: Sequence[str], allow_loopback: bool = False) -> Column:
    """struct(allowed, reason): http or https, no user info, a listed host (`*.name`: names below it only) or, if
    allowed, the own machine. The host list is configuration, so it is part of the expression."""
    part = lambda what: F.try_parse_url(url, F.lit(what))
    host = F.lower(part("HOST"))
    listed = F.lit(False)
    for name in allowed_hosts:
        name = name.strip().lower()
        listed = listed | (host.endswith(name[1:]) if name.startswith("*.") else host == name)
    own = (host.isin("localhost", "[::1]") | host.rlike(r"^127\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$")) if allow_loopback else F.lit(False)
    scheme = F.lower(F.coalesce(part("PROTOCOL"), F.lit("")))
    reason = (
        F.when(~scheme.isin("http", "https"), "scheme")
        .when(part("USERINFO").isNotNull(), "credentials")
        .when(host.isNull() | (host == ""), "no host")
        .when(own, "loopback")
        .when(listed, "listed")
        .otherwise("host not listed")
    )
    return F.struct(reason.isin("loopback", "listed").alias("allowed"), reason.alias("reason"))
