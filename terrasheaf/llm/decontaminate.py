"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window (13 consecutive item words, or a shorter item whole) can occur in a document only if each of its 5-word
shingles does. Shingles are ordered by their count over all documents, rarest first; full containment needs a prefix of
one, so each window is joined by its rarest shingle alone. The place of the shingle in the window bounds where the
window must start and end in the document; what is left is compared word by word.

A benchmark of a bounded size is broadcast. A larger one meets the documents by shuffles: words that a bitmap of the
shingles refuses stay where they are, the others go by shingle with the words around them, and what starts a window by
its spelling. The texts are read twice, however many windows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW, SHINGLE = 13, 5
#: Windows that are broadcast (about 300 bytes each), and items that a broadcast window may list. All windows together
#: list twice BROADCAST_WINDOWS items at most. A benchmark beyond any of these is shuffled; the result is the same.
BROADCAST_WINDOWS, BROADCAST_ITEMS = 100_000, 1_000
#: Bits of the largest bitmap (128 MiB). Fuller bitmaps let more words through, none too few.
BITMAP_BITS = 1 << 30
#: Parts of a window that very many documents hold, where it meets its items.
HOT_PARTS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators: ASCII that is neither letter nor digit. Upper case counts as letter, so that it can be lowered later.
_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_EDGE = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def split_words(text: Column) -> Column:
    """Words of a text as they stand; null or without words: an empty array."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(_EDGE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _SEPARATOR))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def folded(text: Column) -> Column:
    """text in full lower case, each letter without regard to its neighbours (the final sigma would depend on them).

    Whatever A-Z lowering makes equal is equal here too, so joins may use it, and a comparison of exact words follows."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def _shingle(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *(F.get(words, at + k) for k in range(width)))


def _tokens(width: int) -> Column:
    places = F.sequence(F.lit(0), F.col("len") - width)
    return F.transform(places, lambda i: F.xxhash64(F.lit(width), *(F.get("low", i + j) for j in range(width))))


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, win), distinct: the windows of each item, words in A-Z lowering. Items without words have none."""
    words = items.select(F.col(item_col).cast("string").alias("item"), split_words(ascii_lower(F.col(text_col))).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return words.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), window).alias("win")).distinct()


def window_tokens(windows: DataFrame, width: int = SHINGLE) -> DataFrame:
    """windows (win, ...) with one row for each shingle place: low, len, offset, token. low is in full lower case, which
    tokens hash."""
    each = windows.withColumn("len", F.size("win")).withColumn("low", F.transform("win", folded))
    places = [F.when(F.least(F.col("len"), F.lit(width)) == k, _tokens(k)) for k in range(1, width + 1)]
    return each.select("*", F.posexplode(F.coalesce(*places)).alias("offset", "token"))


def _positions(docs: DataFrame, widths: list[int], carried: list[str]) -> DataFrame:
    """A row for each document word (one for a document without any) with its shingle's token; nothing is shuffled.
    The words as they stand (`_raw`) are split once for a document, not for each candidate."""
    base = docs.withColumn("_words", split_words(folded(F.col("text")))).withColumn("_raw", split_words(F.col("text")))
    rows = base.select(*carried, "_words", F.posexplode_outer("_words").alias("_at", "_word"))
    if len(widths) == 1:
        return rows.withColumn("_token", _shingle(F.col("_words"), F.col("_at"), widths[0]))
    return rows.withColumn("_token", F.explode(F.array(*(_shingle(F.col("_words"), F.col("_at"), k) for k in widths))))


def prefix_windows(docs: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    """windows with only their rarest shingle over all documents (ties: smallest token, then first place)."""
    tokens = windows.select("token").distinct()
    seen = _positions(docs.select("text"), widths, []).select("_token").join(F.broadcast(tokens), F.col("_token") == F.col("token"))
    counts = seen.groupBy("token").count()
    ranked = windows.join(counts, "token", "left").withColumn("rank", F.row_number().over(Window.partitionBy("win").orderBy(F.coalesce("count", F.lit(0)), "token", "offset")))
    # a window whose rarest shingle occurs nowhere cannot occur
    return ranked.filter("rank = 1 and count is not null").select("token", "offset", "len", "win", "low", "items")


def decontaminate(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, contaminated) for each row of docs.

    Null text or item: no words, no window. Repeated item texts: each item counts. Null item ids are left out of
    item_ids. Repeated or null doc_id: rows stay apart. Empty benchmark: nothing is hit. Empty documents: empty result.
    Long texts: each word is looked at once for each item window that its shingle starts. Other columns do not matter.
    """
    pairs = common.written(item_windows(items, item_col, item_text_col, window), "pairs")
    listed = pairs.groupBy("win").agg(F.count("*").alias("n"))
    n, refs, longest = (x or 0 for x in listed.agg(F.count("*"), F.sum("n"), F.max("n")).first())
    few = n <= BROADCAST_WINDOWS and refs <= 2 * BROADCAST_WINDOWS and longest <= BROADCAST_ITEMS
    windows = pairs.groupBy("win").agg(F.collect_set("item").alias("items")) if few else pairs.select("win").distinct()
    windows = common.written(window_tokens(windows, width), "windows")
    sizes = windows.select(F.least("len", F.lit(width)).alias("k")).distinct().orderBy("k").limit(width)  # at most `width` values
    widths = [r["k"] for r in sizes.collect()] or [width]
    texts = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("_row", F.monotonically_increasing_id())
    if few:
        found = _occurrences(texts, prefix_windows(texts, windows, widths), widths)
        item_ids = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
        by_doc = found.groupBy("_row", "doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), item_ids.alias("item_ids"))
    else:
        by_doc = _shuffled(texts, pairs, windows, widths, window)
    merged = F.aggregate(
        F.col("spans"),
        F.struct(F.lit(0).alias("reach"), F.lit(0).alias("total")),
        lambda acc, s: F.struct(F.greatest(acc["reach"], s["e"]).alias("reach"), (acc["total"] + F.greatest(F.lit(0), s["e"] - F.greatest(acc["reach"], s["s"]))).alias("total")),
        lambda acc: acc["total"],
    )
    out = by_doc.select("doc_id", F.col("n_words").cast("long").alias("n_words"), merged.cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _occurrences(keyed: DataFrame, prefix: DataFrame, widths: list[int]) -> DataFrame:
    """A row per occurrence, and one at least per document (span null), with the document's number of words."""
    rows = _positions(keyed, widths, ["_row", "doc_id", "_raw"])
    joined = rows.join(F.broadcast(prefix), F.col("_token") == F.col("token"), "left")
    start = F.col("_at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("len") <= F.size("_words"))
    # no lambda here: it would end the compiled stage, and each word's row would be built with its whole text
    exact = ascii_lower(F.array_join(F.slice("_raw", start + 1, F.col("len")), " ")) == F.array_join("win", " ")
    hit = F.when(F.col("len").isNotNull(), F.when(fits, F.when(F.slice("_words", start + 1, F.col("len")) == F.col("low"), exact)))
    checked = joined.withColumn("_hit", F.coalesce(hit, F.lit(False))).filter(F.col("_hit") | F.coalesce(F.col("_at") == 0, F.lit(True)))
    span = F.when(F.col("_hit"), F.struct(start.alias("s"), (start + F.col("len")).alias("e")))
    return checked.select("_row", "doc_id", F.size("_words").alias("n_words"), span.alias("span"), F.when(F.col("_hit"), F.col("items")).alias("items"))


def _bitmap(tokens: DataFrame, n: int, each: int) -> tuple[DataFrame, int]:
    """((_bucket, _mask), bits): a bitmap of the n tokens, `each` bits for one, as rows of 512 longs."""
    bits = min(BITMAP_BITS, max(1 << 15, 1 << (n * each).bit_length()))
    own = tokens.select((F.col("token").bitwiseAND(F.lit(bits - 1))).alias("h")).select(F.shiftright("h", 6).alias("long"), F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("bit"))
    every = own.unionByName(tokens.sparkSession.range(bits >> 6).select(F.col("id").alias("long"), F.lit(0).cast("long").alias("bit")))
    longs = every.groupBy("long").agg(F.bit_or("bit").alias("bits"))
    rows = longs.groupBy(F.shiftright("long", 9).alias("_bucket")).agg(F.sort_array(F.collect_list(F.struct("long", "bits"))).alias("all"))
    return rows.select("_bucket", F.col("all.bits").alias("_mask")), bits


def _sifted(rows: DataFrame, mask: DataFrame, bits: int) -> DataFrame:
    """rows with _in: false where the bitmap rules out _token."""
    marked = rows.withColumn("_bucket", F.shiftright(F.col("_token").bitwiseAND(F.lit(bits - 1)), 15)).join(F.broadcast(mask), "_bucket", "left")
    return marked.withColumn("_in", F.expr("coalesce(getbit(get(_mask, cast(shiftright(_token, 6) & 511 AS int)), cast(_token & 63 AS int)) = 1, false)"))


def _rarest(texts: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    """(win, len, token, offset) as of prefix_windows, for any number of windows."""
    tokens = common.written(windows.groupBy("token").agg(F.count("*").alias("n")), "tokens")
    mask, bits = _bitmap(tokens, tokens.count(), 16)
    seen = _sifted(_positions(texts.select("text"), widths, []).select("_token"), mask, bits).filter("_in").groupBy(F.col("_token").alias("token")).agg(F.count("*").alias("seen"))
    counts = common.written(tokens.join(seen, "token", "left").select("token", F.coalesce("seen", F.lit(0)).alias("seen")), "seen")
    ranked = common.join_hot(windows.select("win", "len", "offset", "token"), counts, ["token"], tokens)
    best = ranked.groupBy("win").agg(F.min(F.struct("seen", "token", "offset")).alias("best"), F.first("len").alias("len"))
    # a window whose rarest shingle occurs nowhere cannot occur
    return best.filter("best.seen > 0").select("win", "len", "best.token", "best.offset")


def _shuffled(texts: DataFrame, pairs: DataFrame, windows: DataFrame, widths: list[int], window: int) -> DataFrame:
    """(doc_id, n_words, spans, item_ids) for each row of texts; no window, item list or token is broadcast whole."""
    prefix = common.written(_rarest(texts, windows, widths), "prefix")
    shapes = common.written(prefix.groupBy("token").agg(F.collect_set(F.struct("offset", "len")).alias("shapes")), "shapes")
    mask, bits = _bitmap(shapes, shapes.count(), 64)
    near = F.greatest(F.col("_at") - (window - 1), F.lit(0))
    rows = _sifted(_positions(texts, widths, ["_row", "doc_id", "_raw"]), mask, bits).filter(F.col("_in") | F.coalesce(F.col("_at") == 0, F.lit(True)))
    around = F.when(F.col("_in"), F.slice("_raw", near + 1, 2 * window - 1))
    sifted = common.written(rows.select("_row", "doc_id", F.size("_words").alias("n_words"), F.col("_token").alias("token"), (F.col("_at") - near).alias("_rel"), near.alias("_near"), around.alias("_around"), "_in", F.coalesce(F.col("_at") == 0, F.lit(True)).alias("_first")), "sifted")

    # words whose shingle is the rarest of a window, with the windows' shapes; frequent ones that are not leave here too
    some = sifted.filter("_in").drop("_in", "_first", "doc_id")
    met = common.join_hot(some, shapes, ["token"], some.groupBy("token").agg(F.count("*").alias("n")))
    start = F.col("_rel") - F.col("shape.offset")
    fits = (start >= 0) & (F.col("_near") + start + F.col("shape.len") <= F.col("n_words"))
    shaped = met.withColumn("shape", F.explode("shapes")).filter(fits).withColumn("s", F.col("_near") + start)
    spelled = ascii_lower(F.array_join(F.slice("_around", start + 1, F.col("shape.len")), " "))
    tried = common.written(shaped.select("_row", F.struct("s", (F.col("s") + F.col("shape.len")).alias("e")).alias("span"), spelled.alias("spelled")), "tried")
    often = tried.groupBy("spelled").agg(F.count("*").alias("n"))
    hits = common.written(common.join_hot(tried, prefix.select(F.array_join("win", " ").alias("spelled")), ["spelled"], often), "hits")
    spans = hits.groupBy("_row").agg(F.array_sort(F.collect_set("span")).alias("spans"))

    # each document meets the items of its windows once; a window of very many documents in parts
    held = common.written(hits.select("_row", "spelled").distinct(), "held")
    hot = common.written(held.groupBy("spelled").count().filter(F.col("count") > max(common.HOT_ROWS, held.count() // common.HOT_KEYS)).select("spelled", F.lit(HOT_PARTS).alias("parts")), "hot")
    parts = F.coalesce("parts", F.lit(1))
    dealt = held.join(F.broadcast(hot), "spelled", "left").withColumn("part", F.pmod(F.xxhash64("_row"), parts).cast("int")).drop("parts")
    lists = pairs.filter("item is not null").select(F.array_join("win", " ").alias("spelled"), "item").join(F.broadcast(hot), "spelled", "left")
    lists = lists.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    named = dealt.join(lists, ["spelled", "part"]).groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))

    base = sifted.filter("_first").groupBy("_row", "doc_id").agg(F.max("n_words").alias("n_words"))
    out = base.join(spans, "_row", "left").join(named, "_row", "left")
    empty = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    return out.select("doc_id", "n_words", empty("spans", spans.schema["spans"].dataType), empty("item_ids", "array<string>"))


def drop_contaminated(docs: DataFrame, found: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """docs without the contaminated ones; columns unchanged, null ids stay, rows of a repeated id go together."""
    gone = common.free_name(docs, "_gone")
    return docs.join(found.filter("contaminated").select(F.col("doc_id").alias(gone)).distinct(), docs[doc_col] == F.col(gone), "left_anti")
