"""Keyword intents of prompts and their routing to workflows and datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasheaf.functions import text as X

from .catalog import match_dataset

#: Keyword groups.
WORDS = {
    "place": ("名古屋", "nagoya"),
    "parquet": ("geoparquet", "geo parquet", "geo-parquet", "パーケット", "parquet"),
    "density": ("人口密度", "人口", "density", "population density"),
    "raster": ("cog", "geotiff", "ラスタ", "raster"),
    "local": ("ローカル", "local", "同梱", "bundled"),
    "remote": ("リモート", "remote", "http"),
    "stac": ("stac", "スタック"),
    "fetch": ("fetch", "import", "取得", "外部", "external", "discover"),
    "map": ("表示", "見せ", "地図", "map", "choropleth", "コロプレス"),
}
#: Metric rules, the first that holds counts: metric, groups that must all occur, whether a catalog URL must, weight.
METRICS = (
    ("local_cog", ("raster", "local"), False, 0.40),
    ("remote_cog", ("raster", "remote"), False, 0.40),
    ("external_stac", ("stac", "fetch"), True, 0.45),
    ("geoparquet_density", ("parquet", "density"), False, 0.55),
    ("geoparquet", ("parquet",), False, 0.35),
    ("population_density", ("density",), False, 0.35),
)
PLACE_WEIGHT, MAP_WEIGHT = 0.45, 0.20
#: The place, and the workflows by precedence: metric, whether the place is needed, id, dataset tags.
PLACE, PLACE_TOKEN = "名古屋市", "place:nagoya"
WORKFLOWS = (
    ("external_stac", False, "external-stac-demo", ("stac", "external", "demo")),
    ("geoparquet_density", True, "nagoya-geoparquet-density", ("nagoya", "geoparquet", "density")),
    ("geoparquet", True, "nagoya-geoparquet", ("nagoya", "geoparquet", "demo")),
    ("population_density", True, "nagoya-density", ("nagoya", "density", "population")),
    ("remote_cog", False, "remote-cog-demo", ("cog", "remote", "demo")),
    ("local_cog", False, "local-cog-demo", ("cog", "local", "demo")),
)


def tag_intent(prompts: DataFrame, text_col: str = "text") -> DataFrame:
    """prompts with place, metric, visualization (null: none), confidence and matched (array). Narrow: the rules are part
    of the expression. Null text: nothing matches."""
    low = X.normalize_prompt(F.coalesce(text_col, F.lit("")))
    url = X.extract_catalog_url(F.btrim(F.coalesce(text_col, F.lit(""))))
    df = prompts.withColumn("_low", low).withColumn("_url", url)

    def has(group: str) -> Column:
        out = F.lit(False)
        for word in WORDS[group]:
            out = out | F.contains(F.col("_low"), F.lit(word))
        return out

    metric, weight = F, F
    for name, groups, needs_url, value in METRICS:
        test = F.lit(True)
        for group in groups:
            test = test & has(group)
        if needs_url:
            test = test & F.col("_url").isNotNull()
        metric, weight = metric.when(test, name), weight.when(test, value)
    df = df.withColumn("place", F.when(has("place"), PLACE)).withColumn("metric", metric).withColumn("_weight", weight.otherwise(0.0)).withColumn("visualization", F.when(has("map"), "choropleth"))
    total = F.when(F.col("place").isNotNull(), PLACE_WEIGHT).otherwise(0.0) + F.col("_weight") + F.when(F.col("visualization").isNotNull(), MAP_WEIGHT).otherwise(0.0)
    matched = F.array_compact(F.array(F.when(F.col("place").isNotNull(), PLACE_TOKEN), F.concat(F.lit("metric:"), F.col("metric")), F.concat(F.lit("viz:"), F.col("visualization"))))
    return df.withColumn("confidence", F.least(F.round(total, 6), F.lit(1.0))).withColumn("matched", matched).withColumn("catalog_url", F.col("_url")).drop("_low", "_url", "_weight")


def route(tagged: DataFrame, text_col: str = "text") -> DataFrame:
    """tagged with workflow and status: routed, ambiguous (place, metric or URL alone), unresolved, or empty (blank)."""
    workflow = F
    for metric, needs_place, name, _ in WORKFLOWS:
        test = F.col("metric") == metric
        workflow = workflow.when(test & F.col("place").isNotNull() if needs_place else test, name)
    df = tagged.withColumn("workflow", F.when(F.btrim(F.coalesce(text_col, F.lit(""))) == "", F.lit(None)).otherwise(workflow))
    density_only = (F.col("metric") == "population_density") & F.col("place").isNull()
    place_only = F.col("place").isNotNull() & F.col("metric").isNull()
    status = F.when(F.btrim(F.coalesce(text_col, F.lit(""))) == "", "empty").when(F.col("workflow").isNotNull(), "routed").when(F.coalesce(place_only | density_only, F.lit(False)) | F.col("catalog_url").isNotNull(), "ambiguous").otherwise("unresolved")
    return df.withColumn("status", status)


def route_prompts(prompts: DataFrame, catalog: DataFrame, text_col: str = "text") -> DataFrame:
    """Prompts routed and bound: the dataset comes from each workflow's tags, joined as one row per workflow (six rows).

    dataset_status tells `matched`, `no_match` or `ambiguous`; only the first has a dataset_id."""
    spark = prompts.sparkSession
    flows = spark.createDataFrame([(name, list(tags)) for *_, name, tags in WORKFLOWS], "request_id string, required array<string>")
    bound = match_dataset(flows, catalog).select(F.col("request_id").alias("workflow"), F.col("status").alias("dataset_status"), F.when(F.col("status") == "matched", F.col("id")).alias("dataset_id"))
    return route(tag_intent(prompts, text_col), text_col).join(F.broadcast(bound), "workflow", "left")
