"""Append-only logs: comments, branches, runs, provenance."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasheaf.sources.files import scratch


def validate_comments(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): author and body must not be blank."""
    good = F.coalesce((F.btrim("author") != "") & (F.btrim("body") != ""), F.lit(False))
    return df.filter(good), df.filter(~good)


def _latest(a: DataFrame, b: DataFrame, key: str, time: str) -> DataFrame:
    """One row per key of both logs: the later write; at equal times that of b; at equal logs the larger row."""
    both = a.withColumn("_rank", F.lit(0)).unionByName(b.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c != "_rank"]
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(time, "_rank", F.to_json(F.struct(*cols)))).alias("_row")).select("_row.*")


def merge_comments(a: DataFrame, b: DataFrame) -> DataFrame:
    return _latest(a, b, "id", "created_at").orderBy("id")


def merge_branches(a: DataFrame, b: DataFrame) -> DataFrame:
    """As merge_comments by name; both logs empty: one branch `main`."""
    merged = _latest(a, b, "name", "created_at")
    main = merged.limit(1).agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("main").alias("name"))
    return merged.unionByName(main, allowMissingColumns=True).orderBy("name")


def create_branches(branches: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of requests (name, parent): the name must be new, the parent known (null: none needed)."""
    known = branches.select("name").distinct()
    marked = requests.join(known.withColumn("_taken", F.lit(True)), "name", "left").join(known.select(F.col("name").alias("parent"), F.lit(True).alias("_parent")), "parent", "left")
    reason = F.when(~F.coalesce(F.col("name").rlike("^[A-Za-z0-9_-]+$"), F.lit(False)), "bad name").when(F.col("_taken"), "name taken").when(F.col("parent").isNotNull() & F.col("_parent").isNull(), "no such parent")
    judged = marked.withColumn("reason", reason).drop("_taken", "_parent")
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def collab_summary(comments: DataFrame, branches: DataFrame, provenance: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias(name))
    names = branches.agg(F.count("*").alias("branches"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("branch_names"))
    return count(comments, "comments").join(F.broadcast(names)).join(F.broadcast(count(provenance, "provenance")))


def run_history(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("id").desc())


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by("id", F.struct("started_at", "id")).alias("id"), F.max("started_at").alias("started_at"))


def classify_runs(runs: DataFrame) -> DataFrame:
    """runs with action: verified, else plan-only pending, else failed (nulls count as false)."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    action = F.when(yes("verified"), "agent_run_verified").when(yes("plan_only"), "agent_plan_pending").otherwise("agent_run_failed")
    return runs.withColumn("action", action).withColumn("workflow_id", F.coalesce("workflow_id", F.lit("unknown")))


def provenance_of(runs: DataFrame, actor: str = "agent") -> DataFrame:
    """Provenance rows of runs: a repeatable id, time, actor, action, target, details as JSON."""
    classed = classify_runs(runs)
    details = F.to_json(F.struct("plan_only", "verified"))
    return classed.select(F.sha2(F.concat_ws("|", F.col("id"), F.col("action")), 256).alias("entry_id"), F.col("started_at").alias("at"), F.lit(actor).alias("actor"), "action", F.col("workflow_id").alias("target"), details.alias("details"), F.col("id").alias("run_id"), "workflow_id")


def provenance_for_run(df: DataFrame, run_id: str | None = None) -> DataFrame:
    return df if run_id is None else df.filter(F.col("run_id") == run_id)


def append_new(df: DataFrame, path: str, key: str, day: str | None = None) -> int:
    """Appends the rows whose key has not landed at path yet, one row a key; running it again appends nothing.

    day: a column that the table is partitioned by; only the days of df are looked through, of these the key alone.
    Returns the number of rows appended."""
    spark = df.sparkSession
    kept, landing = df.dropDuplicates([key]), scratch(spark, "landing")
    try:
        landed = spark.read.parquet(path)
    except AnalysisException as problem:
        if not any(x in str(problem) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        landed = None  # nothing has landed yet
    if landed is not None:
        if day is not None:
            days = [r[0] for r in kept.select(day).distinct().collect()]  # a row a day
            known = F.col(day).isin([x for x in days if x is not None])
            landed = landed.filter(known | F.col(day).isNull() if None in days else known)
        kept = kept.join(landed.select(key), key, "left_anti")
    kept.write.parquet(landing)  # what is appended is settled before the table changes
    new = spark.read.schema(kept.schema).parquet(landing)
    n = new.count()
    if n:
        writer = new.write.mode("append")
        (writer.partitionBy(day) if day is not None else writer).parquet(path)
    return n


def append_provenance(df: DataFrame, path: str) -> None:
    """Adds entries to the log at path, by day; an entry_id that is there already is passed over, so a job can be rerun."""
    append_new(df.withColumn("day", F.to_date("at")), path, "entry_id", "day")


def failure_comments(runs: DataFrame) -> DataFrame:
    """A comment for each failed run with a verifier step, tied to the last such step (steps array<struct<id, role>>)."""
    verifier = F.filter("steps", lambda s: s["role"] == "verifier")
    failed = classify_runs(runs).filter("action = 'agent_run_failed'").withColumn("_v", F.get(verifier, F.size(verifier) - 1)).filter("_v is not null")
    body = F.format_string("Verification failed after %d attempt(s) for prompt: %s", F.greatest(F.coalesce("attempts", F.lit(1)), F.lit(1)), F.coalesce("prompt", F.lit("")))
    return failed.select(F.concat_ws("-", "id", "_v.id").alias("id"), F.col("id").alias("run_id"), F.col("_v.id").alias("step_id"), F.lit("agent").alias("author"), body.alias("body"), F.col("started_at").alias("created_at"))


def execution_receipt(summary: DataFrame, source_uri: str, source_id: str, crs: str, units: str, license: str, verifier: str) -> DataFrame:
    fields = {"source_uri": source_uri, "source_id": source_id, "crs": crs, "units": units, "license": license, "verifier": verifier}
    return summary.select(F.sha2(F.to_json(F.struct("*")), 256).alias("command_id"), *(F.lit(v).alias(k) for k, v in fields.items()), F.col("all_passed").alias("passed"))


def audit_bundle(catalog: DataFrame, overlay: DataFrame, comments: DataFrame, provenance: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of JSON: counts and extents of the base, overlay and merged catalogs and of the logs, and the latest run.

    What grows with the catalog or the logs does not fit a row: audit_tables() has it."""
    from .catalog import collection_summary, upsert_overlay

    snaps = [collection_summary(df).select(F.struct("*").alias(name)) for name, df in (("base", catalog), ("overlay", overlay), ("merged", upsert_overlay(catalog, overlay)))]
    logs = [df.agg(F.count("*").alias(name)) for name, df in (("comments", comments), ("provenance", provenance), ("runs", runs))]
    one = snaps[0]
    for more in (*snaps[1:], *logs, latest_run(runs).select(F.col("id").alias("latest_run_id"))):
        one = one.join(F.broadcast(more))
    return one.select(F.to_json(F.struct("*")).alias("bundle"))


def audit_tables(catalog: DataFrame, overlay: DataFrame, comments: DataFrame, provenance: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    """The rows behind audit_bundle(): items of the three snapshots, comments and provenance in order, run summaries,
    latest first."""
    from .catalog import upsert_overlay

    items = None
    for name, df in (("base", catalog), ("overlay", overlay), ("merged", upsert_overlay(catalog, overlay))):
        one = df.select(F.lit(name).alias("snapshot"), "*")
        items = one if items is None else items.unionByName(one, allowMissingColumns=True)
    summaries = run_history(classify_runs(runs)).select("id", "started_at", "workflow_id", "action")
    return {"items": items, "comments": comments.orderBy("id"), "provenance": provenance.orderBy("at", "entry_id"), "runs": summaries}
