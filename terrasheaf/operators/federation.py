"""Federated catalog search: hits of many endpoints merged, ranked, verified and bound.

hits: one row per endpoint and item (endpoint_id, ord, id, collection, min_x .. max_y, and for binding properties and
assets). endpoints: (endpoint_id, ord, url, error).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasheaf.functions import geometry as G
from terrasheaf.functions import text as X

BOX = ("min_x", "min_y", "max_x", "max_y")


def validate_ids(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): identifiers of letters, digits, _ and - only."""
    good = F.coalesce(F.col(col).rlike("^[A-Za-z0-9_-]+$"), F.lit(False))
    return df.filter(good), df.filter(~good)


def select_endpoints(endpoints: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Endpoints of the given ids, in registration order; none given: all; an unknown id is an error."""
    if not ids:
        return endpoints.orderBy("ord")
    spark = endpoints.sparkSession
    wanted = spark.createDataFrame([(i,) for i in ids], "endpoint_id string")
    found = wanted.distinct().join(endpoints, "endpoint_id", "left")
    name = F.when(F.col("ord").isNull(), F.raise_error(F.concat(F.lit("no endpoint "), F.col("endpoint_id")))).otherwise(F.col("endpoint_id"))
    return found.withColumn("endpoint_id", name).orderBy("ord")


def stac_filter(items: DataFrame, bbox: Sequence[float] | None = None, collections: Sequence[str] = ()) -> DataFrame:
    """Items whose box meets bbox and whose collection is listed (a null collection never is). Dates are left to the
    endpoints, as the request carries them there."""
    if bbox is not None:
        items = items.filter(G.bbox_intersects({c: F.col(c) for c in BOX}, dict(zip(BOX, bbox, strict=True))))
    return items.filter(F.col("collection").isin(*collections)) if collections else items


def endpoint_outcomes(hits: DataFrame, endpoints: DataFrame) -> DataFrame:
    """By endpoint: matched items before the merge, its error, whether it answered."""
    counts = hits.groupBy("endpoint_id").agg(F.count("*").alias("matched"))
    return endpoints.join(counts, "endpoint_id", "left").select("endpoint_id", "ord", F.coalesce("matched", F.lit(0)).alias("matched"), "error", F.col("error").isNull().alias("ok"))


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.sum("matched").alias("matched"))


def federated_search(hits: DataFrame, bbox: Sequence[float] | None = None, collections: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """One row per item key: the first endpoint's item, and all endpoints that have it (distinct, in registration order).

    The filter runs before the shuffle, the merge is one aggregate with a partial step, the limit follows it in key order."""
    kept = stac_filter(hits, bbox, collections).withColumn("key", X.item_key(F.col("collection"), F.col("id")))
    payload = [c for c in hits.columns if c not in ("endpoint_id", "ord")]
    merged = kept.groupBy("key").agg(F.min_by(F.struct(*payload), F.col("ord")).alias("item"), F.sort_array(F.collect_set(F.struct("ord", "endpoint_id"))).alias("s"))
    out = merged.select("key", "item.*", F.transform("s", lambda x: x["endpoint_id"]).alias("source_endpoints"))
    return out.orderBy("key").limit(limit) if limit is not None else out


def explode_assets(items: DataFrame) -> DataFrame:
    return items.select("*", F.explode("assets").alias("asset_key", "asset"))


def item_metadata(df: DataFrame, crs_keys: Sequence[str] = ("proj:code",), unit_keys: Sequence[str] = ("units",), license_keys: Sequence[str] = ("license",)) -> DataFrame:
    """df with crs, units and license from its JSON properties; `unknown` where no key has a string."""
    p = F.col("properties")
    return df.withColumn("crs", X.first_text(p, crs_keys)).withColumn("units", X.first_text(p, unit_keys)).withColumn("license", X.first_text(p, license_keys))


def score_assets(candidates: DataFrame, media_types: Sequence[str], bbox: Sequence[float] | None = None, require_metadata: bool = True) -> DataFrame:
    """candidates (asset_type, roles, source_endpoints, box, crs, units, license) with verifications, compatible, score.

    Score: 100 less 10 for each place of the media type in the list (not listed: 0), 20 for the data role, 5 an
    endpoint, 1000 if every check passes."""
    data = X.has_data_role(F.col("roles"))
    covers = F.lit(True) if bbox is None else F.coalesce(G.bbox_intersects({c: F.col(c) for c in BOX}, dict(zip(BOX, bbox, strict=True))), F.lit(False))
    place = F.array_position(F.array(*map(F.lit, media_types)), F.col("asset_type"))
    listed = F.coalesce(place > 0, F.lit(False))
    check = lambda name, passed, seen: F.struct(F.lit(name).alias("check"), passed.alias("passed"), seen.alias("evidence"))
    checks = [check("media_type", listed, F.coalesce("asset_type", F.lit(""))), check("data_role", data, F.array_join("roles", ",")), check("source_coverage", covers, F.concat_ws(",", *(F.col(c).cast("string") for c in BOX)))]
    if require_metadata:
        checks += [check(n, F.col(n) != "unknown", F.col(n)) for n in ("crs", "units", "license")]
    out = candidates.withColumn("verifications", F.array(*checks)).withColumn("compatible", F.forall("verifications", lambda v: v["passed"]))
    rank = F.when(listed, F.lit(110) - 10 * place).otherwise(0)
    return out.withColumn("score", (rank + F.when(data, 20).otherwise(0) + 5 * F.size("source_endpoints") + F.when(F.col("compatible"), 1000).otherwise(0)).cast("int"))


def rank_candidates(scored: DataFrame, request: str | None = None) -> DataFrame:
    """Best first: score, then item key, then asset key; per request a place number, without one a sorted table."""
    order = [F.col("score").desc(), F.col("key"), F.col("asset_key")]
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(request).orderBy(*order))) if request else scored.orderBy(*order)


def compare_and_bind(items: DataFrame, endpoints: DataFrame, media_types: Sequence[str], bbox: Sequence[float] | None = None, require_metadata: bool = True) -> DataFrame:
    """One row: the best compatible asset with its metadata, the URLs of its endpoints and the reason; none: an error.

    The best is found by a maximum over the candidates, not by sorting them."""
    assets = explode_assets(item_metadata(items)).withColumn("asset_type", F.col("asset.type")).withColumn("roles", F.col("asset.roles"))
    good = score_assets(assets, media_types, bbox, require_metadata).filter("compatible")
    keep = ("key", "asset_key", "score", "asset_type", "source_endpoints", "crs", "units", "license", "id", "collection", "verifications")
    best = good.agg(F.min_by(F.struct(*keep, F.col("asset.href").alias("href")), F.struct(-F.col("score"), F.col("key"), F.col("asset_key"))).alias("b"))
    best = best.select(F.when(F.col("b").isNull(), F.raise_error(F.lit("no compatible, verified asset"))).otherwise(F.col("b")).alias("b")).select("b.*")
    urls = best.select(F.explode("source_endpoints").alias("endpoint_id")).join(endpoints, "endpoint_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "url"))), lambda x: x["url"]).alias("source_urls"))
    reason = F.format_string("Selected %s/%s: verified all %d checks; score %d (%d sources).", "key", "asset_key", F.size("verifications"), "score", F.size("source_endpoints"))
    return best.join(F.broadcast(urls)).withColumn("reason", reason)


def url_report(df: DataFrame, url_col: str, allowed_hosts: Sequence[str], allow_loopback: bool = False) -> DataFrame:
    return df.withColumn("admission", X.url_admission(F.col(url_col), allowed_hosts, allow_loopback))


def size_guard(df: DataFrame, length_col: str, max_bytes: int = 8 << 20) -> DataFrame:
    return df.withColumn("admitted", F.coalesce(F.col(length_col) <= max_bytes, F.lit(False)))
