"""Polygon measures, density classes and the verification that goes with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasheaf.functions import geometry as G
from terrasheaf.sources.files import scratch

UNIT = "persons/km²"


def require_attributes(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): ward_name must be there, population a whole number of 0 or more; ward_code defaults to
    `unknown`. Rejected rows get a reason."""
    number = F.expr("try_cast(population as double)")
    reason = F.when(F.col("ward_name").isNull(), "ward_name missing").when(number.isNull() | F.isnan(number) | (number < 0) | (number != F.floor(number)), "population not a whole number")
    judged = features.withColumn("ward_code", F.coalesce("ward_code", F.lit("unknown"))).withColumn("reason", reason)
    good = judged.filter(F.col("reason").isNull()).drop("reason").withColumn("population", F.col("population").cast("long"))
    return good, judged.filter(F.col("reason").isNotNull())


def with_density(features: DataFrame) -> DataFrame:
    """features with area_km2 and density_per_km2; narrow, no shuffle."""
    return features.withColumn("area_km2", G.area_km2(F.col("rings"))).withColumn("density_per_km2", G.density(F.col("population"), F.col("area_km2")))


def value_range(df: DataFrame, field: str) -> DataFrame:
    x = G.no_nan(F.col(field))
    return df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))


def equal_interval(df: DataFrame, field: str, classes: int = 5) -> DataFrame:
    """One row (breaks array<double>): classes + 1 equal steps from the smallest to the largest value; equal ends: steps
    of 1. Fewer than 2 classes count as 2; more than the palette has are refused."""
    classes = max(classes, 2)
    if classes > len(G.PALETTE):
        raise ValueError(f"at most {len(G.PALETTE)} classes")
    step = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / classes).otherwise(1.0)
    return value_range(df, field).select(F.transform(F.sequence(F.lit(0), F.lit(classes)), lambda i: F.col("lo") + step * i).alias("breaks"))


def classified(df: DataFrame, field: str, classes: int = 5) -> DataFrame:
    """df with class and color; the breaks are one row, joined by broadcast."""
    breaks = equal_interval(df, field, classes)
    number = G.classify(F.col(field), F.col("breaks"))
    return df.join(F.broadcast(breaks)).withColumn("class", number).withColumn("color", G.class_color(F.col("class"))).drop("breaks")


def legend(breaks: DataFrame, unit: str = UNIT) -> DataFrame:
    """A row per class: label `lo – hi unit` without decimals (ties to even) and color."""
    rows = breaks.select("breaks", F.explode(F.sequence(F.lit(0), F.size("breaks") - 2)).alias("class"))
    shown = lambda x: F.bround(x, 0).cast("long").cast("string")
    label = F.concat(shown(F.get("breaks", F.col("class"))), F.lit(" – "), shown(F.get("breaks", F.col("class") + 1)), F.lit(f" {unit}"))
    return rows.select("class", label.alias("label"), G.class_color(F.col("class")).alias("color"))


def population_density(features: DataFrame, classes: int = 5) -> DataFrame:
    """Features to area, density, class and color."""
    return classified(with_density(features), "density_per_km2", classes)


def _facts(df: DataFrame) -> list[Column]:
    """Aggregates over df (population, area_km2) that the checks read: n, positive, flat."""
    positive = F.coalesce(F.bool_and(F.coalesce(F.col("population") > 0, F.lit(False))), F.lit(True))
    return [F.count("*").alias("n"), positive.alias("positive"), F.count_if(F.col("area_km2") <= 0).alias("flat")]


def _checks(crs: str, expected: int, boundary_source: str) -> Column:
    """The six checks (name, passed, detail) of a row of _facts."""
    check = lambda name, passed, detail: F.struct(F.lit(name).alias("name"), passed.alias("passed"), detail.alias("detail"))
    yes = F.lit(True)
    return F.array(
        check("crs_declared", F.lit(crs.startswith("EPSG:")), F.lit(f"CRS = {crs}")),
        check("area_method_recorded", yes, F.concat(F.lit("planar WGS84 scaling; features without area: "), F.col("flat").cast("string"))),
        check("population_positive", F.col("positive"), F.concat(F.col("n").cast("string"), F.lit(" features"))),
        check("density_unit", yes, F.lit(UNIT)),
        check("feature_count", F.col("n") == expected, F.concat(F.lit(f"{expected} expected, found "), F.col("n").cast("string"))),
        check("boundary_source", yes, F.lit(boundary_source)),
    )


def density_checks(df: DataFrame, crs: str, expected: int, boundary_source: str = "unknown") -> DataFrame:
    """Six rows (name, passed, detail) from one aggregate over df (population, area_km2)."""
    return df.agg(*_facts(df)).select(F.explode(_checks(crs, expected, boundary_source)).alias("c")).select("c.*")


def verify_density(df: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row: rows, rows whose density is population / area within the tolerance (no area: not), and whether all are."""
    right = F.abs(F.col("density_per_km2") - F.try_divide(F.col("population"), F.col("area_km2"))) < tolerance
    return df.agg(F.count("*").alias("n"), F.count_if(right).alias("n_right")).withColumn("passed", F.col("n") == F.col("n_right"))


def top_density(df: DataFrame, id_col: str = "ward_code") -> DataFrame:
    """The densest feature; of equal ones that of the largest id. NaN is left out."""
    x = G.no_nan(F.col("density_per_km2"))
    return df.filter(x.isNotNull()).agg(F.max_by(F.struct(*df.columns), F.struct("density_per_km2", id_col)).alias("t")).select("t.*")


def review_status(checks: DataFrame) -> DataFrame:
    return checks.agg(F.when(F.bool_and("passed"), "executed").otherwise("pending_review").alias("status"))


def check_counts(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(group or [])).agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n_checks"))


def dataset_bbox(df: DataFrame, rings: str = "rings") -> DataFrame:
    """One row (min_x, min_y, max_x, max_y) over all vertices, NaN left out; no vertex: zeros. Rows are reduced before
    the aggregate, nothing is exploded."""
    flat = F.flatten(F.col(rings))
    xs, ys = (_side(flat, c) for c in ("x", "y"))
    each = df.select(F.array_min(xs).alias("a"), F.array_min(ys).alias("b"), F.array_max(xs).alias("c"), F.array_max(ys).alias("d"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return each.agg(zero(F.min("a")).alias("min_x"), zero(F.min("b")).alias("min_y"), zero(F.max("c")).alias("max_x"), zero(F.max("d")).alias("max_y"))


def _side(points: Column, name: str) -> Column:
    return F.transform(points, lambda p: G.no_nan(p[name]))


def dataset_summary(df: DataFrame, name: str, crs: str) -> DataFrame:
    count = df.agg(F.count("*").alias("feature_count"))
    return dataset_bbox(df).join(F.broadcast(count)).select(F.lit(name).alias("name"), "feature_count", F.lit(crs).alias("crs"), "min_x", "min_y", "max_x", "max_y")


def verify_features(df: DataFrame, crs: str, expected: int) -> DataFrame:
    return df.agg(F.count("*").alias("feature_count")).withColumn("passed", (F.col("feature_count") == expected) & F.lit(crs.startswith("EPSG:")))


def analysis_summary(df: DataFrame, goal: str, dataset: str, crs: str, expected: int, boundary_source: str = "unknown") -> DataFrame:
    """One row from one aggregate: goal, dataset, feature count, unit, crs, whether all of density_checks pass, densest
    feature (of equal ones that of the largest ward_code; NaN left out)."""
    x = G.no_nan(F.col("density_per_km2"))
    top = F.max_by(F.struct("ward_name", "density_per_km2"), F.when(x.isNotNull(), F.struct("density_per_km2", "ward_code"))).alias("top")
    passed = F.forall(_checks(crs, expected, boundary_source), lambda c: c["passed"])
    return df.agg(*_facts(df), top).select(F.lit(goal).alias("goal"), F.lit(dataset).alias("dataset"), F.col("n").alias("feature_count"), F.lit(UNIT).alias("unit"), F.lit(crs).alias("crs"), passed.alias("all_passed"), F.col("top.ward_name").alias("top_name"), F.col("top.density_per_km2").alias("top_density"))


#: A key with more rows than this, and than a SOURCE_KEYS-th of all rows, is hot; so many keys can be, at most.
SOURCE_ROWS, SOURCE_KEYS = 1000, 10_000


def attach_sources(df: DataFrame, citations: list[str] | DataFrame, key: str = "dataset_id", joined: str | None = None) -> DataFrame:
    """df with `sources`: the same citations for each row, or, of a table (key, citation), those of the row's key, distinct
    and in order. A key without any, or null: an empty array. The citations of one key are what a person reads, few.

    joined: `sources` is one text, its citations joined by this, made once a key. Rows of hot keys are dealt evenly to all
    tasks, where the citations of these keys are broadcast; only the others meet theirs by key."""
    none = F.array().cast("array<string>")
    if isinstance(citations, list):
        listed = F.array(*map(F.lit, citations)).cast("array<string>")
        return df.withColumn("sources", listed if joined is None else F.array_join(listed, joined))
    by_key = citations.filter(F.col("citation").isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_set("citation")).alias("sources"))
    if joined is not None:
        by_key, none = by_key.select("_key", F.array_join("sources", joined).alias("sources")), F.lit("")
    counts = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n"))
    total = F.broadcast(counts.agg(F.sum("_n").alias("_total")))
    hot = F.broadcast(counts.join(total).filter(F.col("_n") > F.greatest(F.lit(SOURCE_ROWS), F.expr(f"_total div {SOURCE_KEYS}"))).select("_hot"))
    marked = df.join(hot, F.col(key) == F.col("_hot"), "left")
    few = F.broadcast(by_key.join(hot, F.col("_key") == F.col("_hot"), "left_semi"))
    many = marked.filter("_hot is not null").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).join(few, F.col(key) == F.col("_key"), "left")
    met = many.unionByName(marked.filter("_hot is null").join(by_key, F.col(key) == F.col("_key"), "left"))
    return met.drop("_key", "_hot").withColumn("sources", F.coalesce("sources", none))


def join_population(boundaries: DataFrame, population: DataFrame) -> DataFrame:
    """population with all rings of its ward_code's boundary rows (ring_no orders them); none: an empty array.

    Both sides meet by ward_code; rings are gathered per ward, which a ward's own size bounds."""
    rings = boundaries.groupBy("ward_code").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring_no", "ring"))), lambda s: s["ring"]).alias("rings"))
    joined = population.join(rings, "ward_code", "left")
    return joined.withColumn("rings", F.coalesce("rings", F.array().cast(rings.schema["rings"].dataType)))


#: A group of more distinct values than this, and than a LARGE_GROUPS-th of all, is large; so many can be, at most.
LARGE_VALUES, LARGE_GROUPS = 100_000, 10_000


def timing_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """By group: least, largest, whole mean and upper median (element n div 2) of whole values; nulls do not count.

    Values are counted first, with a partial step. In a small group the median is the first value whose running count
    passes half of it. In a large one it is found by its bits: four counts of 16 bits each, a bucket a row, say which
    bucket holds it, so that no task sees the group's values together."""
    counts = df.groupBy(F.col(group).alias("g"), F.col(value).cast("long").alias("v")).agg(F.count("*").alias("c")).filter("v is not null")
    path = scratch(df.sparkSession, "values")
    counts.write.parquet(path)
    counts = df.sparkSession.read.schema(counts.schema).parquet(path)
    mean = F.expr("cast(sum(cast(v AS decimal(38, 0)) * c) div sum(c) AS bigint)")
    totals = counts.groupBy("g").agg(F.min("v").alias("min_value"), F.max("v").alias("max_value"), mean.alias("mean_value"), F.sum("c").alias("n"), F.count("*").alias("distinct"))
    most = max(LARGE_VALUES, (totals.agg(F.sum("distinct")).first()[0] or 0) // LARGE_GROUPS)
    large = totals.filter(F.col("distinct") > most).select("g", F.expr("n div 2").alias("rank"))
    medians = _small_medians(counts, large).unionByName(_large_medians(counts, large))
    joined = totals.alias("t").join(medians.alias("m"), F.col("t.g").eqNullSafe(F.col("m.g")))
    return joined.select(F.col("t.g").alias(group), "min_value", "max_value", "mean_value", "median_value")


def _small_medians(counts: DataFrame, large: DataFrame) -> DataFrame:
    order = Window.partitionBy("g").orderBy("v")
    named = F.broadcast(large.select(F.col("g").alias("h"), F.lit(True).alias("is_large")))  # LARGE_GROUPS rows at most
    small = counts.join(named, F.col("g").eqNullSafe(F.col("h")), "left").filter("is_large is null")
    upto = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = small.select("g", "v", (upto > F.floor(n / 2)).alias("past"))
    return ranked.groupBy("g").agg(F.min(F.when(F.col("past"), F.col("v"))).alias("median_value"))


def _large_medians(counts: DataFrame, large: DataFrame) -> DataFrame:
    """The value at `rank` of each large group, 16 bits more of it with each pass over the counted values."""
    bits = F.col("v").bitwiseXOR(F.lit(-(1 << 63)))  # as unsigned numbers these stand in the values' order
    found = large.select("g", F.lit(0).cast("long").alias("prefix"), F.col("rank"))
    for shift in (48, 32, 16, 0):
        # the state is LARGE_GROUPS rows at most
        state = F.broadcast(found.select(F.col("g").alias("h"), "prefix", "rank"))
        above = F.lit(0).cast("long") if shift == 48 else F.shiftrightunsigned(bits, shift + 16)
        inside = counts.join(state, F.col("g").eqNullSafe(F.col("h")) & (above == F.col("prefix")))
        bucket = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0xFFFF))
        buckets = inside.groupBy("g", "prefix", "rank", bucket.alias("bucket")).agg(F.sum("c").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # 65,536 buckets at most
        here = buckets.withColumn("upto", upto).filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
        found = here.select("g", F.shiftleft("prefix", 16).bitwiseOR(F.col("bucket")).alias("prefix"), (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))
    return found.select("g", F.col("prefix").bitwiseXOR(F.lit(-(1 << 63))).alias("median_value"))


def with_equal_area(df: DataFrame, rings: str = "rings") -> DataFrame:
    """df with rings on the equal-area plane, in km, and the area there."""
    return df.withColumn("area_km2", G.equal_area_km2(F.col(rings))).withColumn(rings, F.transform(rings, G.reproject_ring))
