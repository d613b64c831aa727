"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies c = target / source size, 0 to `cap`. Its whole
part is given outright. Fractional copy probabilities are paired: a random transfer that keeps the pair's expected words moves
mass from one to the other until one of them is 0 or 1. What stays fractional (one document a block) goes up a
reduction tree of blocks, so a source's taken words miss its target by half a document at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a source that one task rounds, and residuals that meet in one node of the tree.
BLOCK_ROWS, FAN_IN = 20_000, 512
#: Equal rows that one task writes out, and parts in which a key's rows are numbered.
UNIT_ROWS, NUMBER_PARTS = 10_000, 64


def document_sizes(docs: DataFrame, text_col: str, size_col: str) -> DataFrame:
    """docs without its text and with the number of words `[^\\x20\\x09-\\x0D]+` (null: 0)."""
    keep = [c for c in docs.columns if c != text_col]
    kind = docs.select(*keep).schema.add(size_col, "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text_col, 1 << 24):
            first = common.word_bounds(*common.buffers(common.column(batch, text_col)))[2]
            yield pa.RecordBatch.from_arrays([*(common.column(batch, c) for c in keep), pa.array(np.diff(first), pa.int64())], names=[*keep, size_col])

    return docs.select(*keep, text_col).mapInArrow(common.tidy(count), kind)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): `share` of all words by weight; above `cap` times a source's words the excess is
    dealt again by weight until none is above.

    Sources are ordered by code point, null last, and take the weights in turn. The water level is found by one sort
    of the sources by cap / weight: those below it are capped, the others share the rest. Sources without words get 0.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (turn + 1).cast("int"))
    by_source = by_source.withColumn("_w", weight).withColumn("_all", F.sum("source_size").over(_whole(order)) * float(share)).withColumn("_cap", F.col("source_size") * float(cap))
    rank = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    below = rank.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        by_source.withColumn("_capped", F.coalesce(F.sum("_cap").over(below), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(_whole(rank)) - F.coalesce(F.sum("_w").over(below), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_left"))
        # the first source whose cap lies above the level ends the capped ones
        .withColumn("_free", F.col("_cap") / F.col("_w") > F.col("_level"))
    )
    level = ranked.withColumn("_at", F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level")))).over(_whole(rank))["level"])
    return level.select("source", "source_size", F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_at") * F.col("_w"))).alias("target"))


def _whole(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _unit(keys: np.ndarray, salt: int) -> np.ndarray:
    """A repeatable uniform number in [0, 1) for each key."""
    h = common.mixed(keys.astype(np.int64).view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64)))
    return (h >> np.uint64(11)) * 2.0**-53


def pivotal_rounds(keys: np.ndarray, sizes: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """p after pairing until at most one entry is strictly between 0 and 1. Sum of sizes * p stays, but for rounding.

    The one that is still fractional meets the next. A pair (i, j) moves along (1 / size_i, -1 / size_j), up or down
    with chances that keep both expectations, as far as the first bound. Large sizes come first, so that small ones
    are left to take up the rest and the last fractional entry tends to be small."""
    order = np.lexsort((keys, -sizes))
    chance = _unit(keys, seed)[order].tolist()
    size, part, out = sizes[order].tolist(), p[order].tolist(), p[order].copy()
    i = -1
    for j in range(len(part)):
        if not 0.0 < part[j] < 1.0:
            continue
        if i < 0:
            i = j
            continue
        a, b, x, y = size[i], size[j], part[i], part[j]
        up, down = min((1 - x) * a, y * b), min(x * a, (1 - y) * b)
        if chance[j] * (up + down) < down:
            ends_i, ends_j = (1 - x) * a <= y * b, (1 - x) * a >= y * b
            x, y = 1.0 if ends_i else x + up / a, 0.0 if ends_j else y - up / b
        else:
            ends_i, ends_j = x * a <= (1 - y) * b, x * a >= (1 - y) * b
            x, y = 0.0 if ends_i else x - down / a, 1.0 if ends_j else y + down / b
        part[i], part[j], out[i], out[j] = x, y, x, y
        i = j if ends_i and not ends_j else -1 if ends_i else i
    back = np.empty_like(out)
    back[order] = out
    return back


def pivotal_round(rows: DataFrame, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows (key long, grp string or null, size double > 0, p double in (0, 1)), told apart by key, grp and size, with
    whole p (0 or 1) as `copies`.

    Groups are cut into blocks of about block_rows by key hash, so a hot source spreads over many tasks. Each pass
    leaves one fractional row a block; passes of FAN_IN blocks follow until a group has one, which is rounded to the nearer side: half a document at most."""
    counts = rows.groupBy("grp").count().select(F.col("grp").alias("_g"), F.greatest(F.lit(1), F.ceil(F.col("count") / block_rows)).alias("blocks"))
    rows = rows.join(counts, rows["grp"].eqNullSafe(counts["_g"])).select("key", "grp", "size", "p", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks")).alias("block"))
    done, level = [], 0
    while True:
        last = level > 0 and not rows.filter(F.col("block") > 0).take(1)
        out = common.written(rows.groupBy("grp", "block").applyInPandas(_block_rounder(seed + 101 * level, last), "key long, grp string, block long, size double, p double"), "pivotal")
        done.append(out.filter("p = 0 or p = 1").select("key", "grp", "size", F.col("p").cast("long").alias("copies")))
        if last:
            break
        rows = out.filter("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / FAN_IN))
        level += 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def _block_rounder(seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "size"], kind="stable", ignore_index=True)
        keys, p = pdf["key"].to_numpy(np.int64), pdf["p"].to_numpy(float)
        p = pivotal_rounds(keys, pdf["size"].to_numpy(float), p, seed)
        if last:
            p = np.where((p > 0) & (p < 1), (p >= 0.5).astype(float), p)
        return pdf.assign(p=p)

    return run


def _row_key(doc_col: str, source_col: str, text_col: str) -> Column:
    """What rows are told apart by: id, source and text. Rows equal in all three are one unit of several rows."""
    cols = F.col(doc_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col).cast("string")
    return F.xxhash64(*cols, *(c.isNull() for c in cols))  # the hash passes over nulls, which would shift values between columns


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, doc_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, key) for every document.

    Each source's taken words miss its target by half a document at most. Null source: a source of its own, last. Null
    or empty text: size 0, no copies. Repeated or null doc_id: each row is rounded by itself; of rows equal in id,
    source and text, which nothing tells apart, as many take one copy more as their number times the mean asks for.
    Empty table: empty result. Reruns agree: chance comes from id, source, text and the seed alone.
    """
    base = docs.select(F.col(doc_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"), _row_key(doc_col, source_col, text_col).alias("key"))
    sizes = common.written(document_sizes(base, "text", "size"), "sizes")
    targets = common.written(source_targets(sizes, weights, share, cap).withColumnRenamed("source", "_s"), "targets")
    units = sizes.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("n"))
    units = units.join(F.broadcast(targets) if _few(targets) else targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    want = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap))) * F.col("n")).otherwise(0.0)
    units = units.withColumn("_want", want).withColumn("_whole", F.floor(F.col("_want") + 1e-9)).withColumn("_p", F.greatest(F.col("_want") - F.col("_whole"), F.lit(0.0)))
    parts = units.filter("_p > 0").select("key", F.col("source").alias("grp"), F.col("size").cast("double").alias("size"), F.col("_p").alias("p"))
    rounded = pivotal_round(parts, seed).select(F.col("key").alias("_k"), F.col("grp").alias("_g"), F.col("size").alias("_n"), F.col("copies").alias("_more"))
    units = units.join(rounded, (F.col("key") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_g")) & (F.col("size") == F.col("_n")), "left")
    return _shared_out(units.withColumn("_total", F.col("_whole") + F.coalesce("_more", F.lit(0)))).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "key")


def _shared_out(units: DataFrame) -> DataFrame:
    """A row for each of a unit's n rows, with its share of _total as `copies`. Large units are cut into chunks that
    spread over tasks."""
    size = F.lit(UNIT_ROWS)
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size)))
    large = units.filter(F.col("n") > size).withColumn("_chunk", chunk)
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = units.filter(F.col("n") <= size).withColumn("_chunk", F.lit(0).cast("long")).unionByName(large.repartition(parts, "key", "_chunk"))
    rows = cut.withColumn("_i", F.explode(F.sequence(F.col("_chunk") * size, F.least(F.col("n"), (F.col("_chunk") + 1) * size) - 1)))
    return rows.withColumn("copies", _share(F.col("_total"), F.col("n"), F.col("_i")))


def _share(total: Column, n: Column, i: Column) -> Column:
    """Copies of row i of n rows that share `total` as evenly as whole numbers allow."""
    return (F.floor(total / n) + F.when(i < total % n, 1).otherwise(0)).cast("long")


def _few(targets: DataFrame, limit: int = 100_000) -> bool:
    """Whether there are few enough sources to broadcast (counted, not assumed)."""
    return targets.limit(limit + 1).count() <= limit


def take(docs: DataFrame, mixed: DataFrame, doc_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs, null ids too, each as often as the mix takes it; columns unchanged. Names as given to mix().

    Rows that nothing tells apart are numbered to share their copies, if they do not all have the same."""
    names = {n: common.free_name(docs, n) for n in ("_copies", "_key", "_total", "_n", "_i")}
    copies, key, total, n, i = names.values()
    plan = mixed.groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(total), F.count("*").alias(n)).filter(F.col(total) > 0)
    joined = docs.withColumn(key, _row_key(doc_col, source_col, text_col)).join(plan, key)
    uneven = F.col(total) % F.col(n) > 0
    rows = joined.filter(~uneven).withColumn(i, F.lit(0).cast("long"))
    if plan.filter(uneven).take(1):
        rows = rows.unionByName(_numbered(joined.filter(uneven), key, i))
    rows = rows.withColumn(copies, _share(F.col(total), F.col(n), F.col(i))).filter(F.col(copies) > 0)
    return rows.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*(f"`{c}`" for c in docs.columns))


def _numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with their number among the rows of their key, from 0. A key's rows are counted in NUMBER_PARTS parts, so a
    hot key spreads over as many tasks; rows are written first, so that both counts see the same."""
    row, part, before = (common.free_name(rows, x) for x in ("_row", "_part", "_before"))
    kept = common.written(rows.withColumn(row, F.monotonically_increasing_id()), "ties").withColumn(part, F.pmod(F.xxhash64(row), F.lit(NUMBER_PARTS)))
    up_to = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy(key, part).count().select(key, part, F.coalesce(F.sum("count").over(up_to), F.lit(0)).alias(before))
    inner = kept.withColumn(name, F.row_number().over(Window.partitionBy(key, part).orderBy(row)) - 1)
    return inner.join(offsets, [key, part]).withColumn(name, F.col(name) + F.col(before)).drop(row, part, before)
