"""Spelling variants: words one edit apart, found by comparing blocks of padded code points.

Two words differ by one inserted, deleted or replaced code point if and only if they are unequal and their common prefix
and common suffix together reach the longer length less one. One of the two then reaches half of that, rounded up; so
words that share such a prefix, or such a suffix, form groups, and only blocks of one group are compared, densely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, ONE_IN = 5, 3, 97
#: A group of more words, if it is hot, is cut into blocks of about so many, which meet two by two. Inside a task, blocks of
#: TILE words are compared, about CELLS pairs at once, for all groups among GATHER rows.
BLOCK_WORDS, TILE, CELLS, GATHER = 2048, 64, 1 << 19, 50_000


def runs(text: Column) -> Column:
    """All maximal runs of letters of a whole text; null: none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), F.array().cast("array<string>"))


def garbled(doc: Column, run: Column, one_in: int = ONE_IN) -> Column:
    """run without the code point at crc32("doc:run") modulo its length, if one_in divides the crc32; else run."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of min_length code points and min_count occurrences at least, over all rows."""
    each = docs.select(F.col(doc_col).alias("doc"), F.explode(runs(F.col(text_col).cast("string"))).alias("run"))
    words = each.select("doc", F.translate("run", UPPER, LOWER).alias("run")).select(garbled(F.col("doc"), F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.col("n") >= min_count) & (F.length("word") >= min_length))


def _tiles(first: np.ndarray, size: np.ndarray, block: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, I, J): for groups of rows first[g] .. first[g] + size[g], matrices of row numbers, -1 beyond the end, whose
    lines are blocks of up to TILE rows to compare with each other. A group that was cut compares only its blocks left
    and right; pairs i < j are met once."""
    small = (size > 1) & (size <= TILE) & (left == right)
    width = 1 << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64)
    for s in np.unique(width[small]):
        group = np.flatnonzero(small & (width == s))
        place = np.arange(s)[None, :]
        index = np.where(place < size[group][:, None], first[group][:, None] + place, -1)
        yield group, index, index
    groups, rows, cols = [], [], []
    for g in np.flatnonzero((size > 1) & ~small).tolist():
        own = np.arange(first[g], first[g] + size[g])
        sides = [own[block[own] == x] for x in (left[g], right[g])]
        cut = [[np.pad(x[k : k + TILE], (0, max(0, k + TILE - len(x))), constant_values=-1) for k in range(0, len(x), TILE)] for x in sides]
        for a, x in enumerate(cut[0]):
            for y in cut[1][a:] if left[g] == right[g] else cut[1]:
                groups.append(g)
                rows.append(x)
                cols.append(y)
    if groups:
        yield np.array(groups), np.array(rows), np.array(cols)


def _reach(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """(tile, i, j): length of the common front of a[rows[tile, i]] and b[cols[tile, j]]; padding, 0, equals nothing."""
    alive, out = np.ones((*rows.shape, cols.shape[1]), bool), np.zeros((*rows.shape, cols.shape[1]), np.uint8 if a.shape[1] < 256 else np.uint32)
    for k in range(a.shape[1]):
        x, y = a[rows, k], b[cols, k]
        alive &= (x[:, :, None] == y[:, None, :]) & (x != 0)[:, :, None]
        if not alive.any():
            break
        out += alive
    return out


def _links(words: list[str], longer: int, suffix: np.ndarray, *groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of a group that are one edit apart, at least one of them `longer` long. suffix: groups that
    share the end; a pair that shares the front as well is left to that group."""
    length = np.array([len(w) for w in words])
    front = np.array(words, f"U{longer}").view(np.uint32).reshape(len(words), longer)
    back = np.array([w[::-1] for w in words], f"U{longer}").view(np.uint32).reshape(len(words), longer)
    if max(front.max(initial=0), back.max(initial=0)) < 256:
        front, back = front.astype(np.uint8), back.astype(np.uint8)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for group, rows, cols in _tiles(*groups):
        step = max(1, CELLS // (rows.shape[1] * cols.shape[1]))
        for at in range(0, len(group), step):
            g, x, y = group[at : at + step], rows[at : at + step], cols[at : at + step]
            prefix = _reach(front, front, x, y)
            near = prefix + _reach(back, back, x, y).astype(np.int64) >= longer - 1
            near &= (length[x] == longer)[:, :, None] | (length[y] == longer)[:, None, :]
            near &= ((x[:, :, None] < y[:, None, :]) | (x[:, :1] != y[:, :1])[:, :, None]) & (x >= 0)[:, :, None] & (y >= 0)[:, None, :]
            near &= ~suffix[g][:, None, None] | (prefix < longer // 2)
            t, a, b = np.nonzero(near)
            found.append((x[t, a], y[t, b]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _best(words: list[str], n: np.ndarray, longer: np.ndarray, side: np.ndarray, group: np.ndarray, block: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """For whole groups of rows, side by side: each word's number of near words and the best of them. Words are in order within a group."""
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[head, len(group)])
    pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for kind in np.unique(longer[head]):
        some = np.flatnonzero(longer[head] == kind)
        rows = np.repeat(head[some], size[some]) + common.ragged(size[some])
        first = np.cumsum(size[some]) - size[some]
        i, j = _links([words[k] for k in rows.tolist()], int(kind), side[head[some]] == "s", first, size[some], block[rows], left[head[some]], right[head[some]])
        pairs += [(rows[i], rows[j]), (rows[j], rows[i])]
    i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    text = np.array(words, object)
    rank = np.argsort(np.argsort(text, kind="stable"), kind="stable")
    order = np.lexsort((rank[j], -n[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
    near = np.diff(np.r_[first, len(i)])
    return pa.RecordBatch.from_arrays([pa.array(text[i[first]], pa.string()), pa.array(near, pa.int64()), pa.array(n[j[first]], pa.int64()), pa.array(text[j[first]], pa.string())], names=["word", "n_near", "form_n", "near"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, near): number of words one edit apart, and the one of largest n, ties to the smallest, for
    each of the distinct words (word, n) that has any."""
    longer = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longer")
    half = F.expr("longer div 2").cast("int")  # half of longer - 1, rounded up
    sides = F.explode(F.array(F.struct(F.lit("p").alias("side"), F.substring(F.col("word"), F.lit(1), F.col("half")).alias("shared")), F.struct(F.lit("s").alias("side"), F.right("word", "half").alias("shared"))))
    keyed = words.select("word", "n", longer).withColumn("half", half).select("word", "n", "longer", sides.alias("at")).select("word", "n", "longer", "at.*")
    key = ["longer", "side", "shared"]
    counts = common.written(keyed.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1"), "groups")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    hot = counts.filter(F.col("rows") > max(BLOCK_WORDS, total // common.HOT_KEYS)).select(*key, F.ceil(F.col("rows") / BLOCK_WORDS).cast("int").alias("blocks"))
    dealt = keyed.join(F.broadcast(hot), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # hot: HOT_KEYS rows at most
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    tiles = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
    group = [*key, "left", "right"]
    dealt = tiles.select("word", "n", *group, "block").repartition(*group).sortWithinPartitions(*group, "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def solve(t: pa.Table) -> pa.RecordBatch:
            longer, block, left, right, n = (t[c].to_numpy() for c in ("longer", "block", "left", "right", "n"))
            side, shared = (np.array(t[c].to_pylist(), object) for c in ("side", "shared"))
            new = np.zeros(len(n), bool)
            new[1:] = (shared[1:] != shared[:-1]) | (side[1:] != side[:-1])
            for c in (longer, left, right):
                new[1:] |= c[1:] != c[:-1]
            return _best(t["word"].to_pylist(), n, longer, side, np.cumsum(new), block, left, right)

        def same(t: pa.Table, k: int) -> bool:
            return all(t[c][k] == t[c][-1] for c in group)

        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            if held.num_rows >= GATHER:
                low, high = 0, held.num_rows - 1  # where the last group, which may go on, begins
                while low < high:
                    mid = (low + high) // 2
                    low, high = (low, mid) if same(held, mid) else (mid + 1, high)
                if low:
                    yield solve(held.slice(0, low).combine_chunks())
                    held = held.slice(low).combine_chunks()
        if held is not None and held.num_rows:
            yield solve(held.combine_chunks())

    parts = dealt.mapInArrow(common.tidy(run), "word string, n_near long, form_n long, near string")
    best = F.min_by(F.struct("form_n", "near"), F.struct(-F.col("form_n"), F.col("near")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, each followed to the last. A form's count is at least twice its word's, so chains are short;
    each round doubles the steps taken."""
    steps = forms.select("word", F.coalesce("form", "word").alias("root"))
    current = common.written(forms.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = common.written(common.join_hot(current, ahead, ["root"], current.groupBy("root").agg(F.count("*").alias("n"))), "roots")
        current = moved.select("word", F.col("ahead").alias("root"))
        if moved.filter("root <> ahead").isEmpty():
            return current
        steps = current.unionByName(forms.filter("form is null").select("word", F.col("word").alias("root")))


def spelling_variants(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the vocabulary of docs.

    form: the word one edit apart of largest n, ties to the smallest, if it occurs at least twice as often; root: the
    last of the forms that follow one another, the word itself if it has none. Null text: no words; null doc_id: hashed
    as if empty; repeated rows count again; empty table: empty result. Texts are read whole, and words of any length."""
    spark = docs.sparkSession
    with common.passing(spark) as keep:
        words = common.written(vocabulary(docs, doc_col, text_col, min_length, min_count), "words")
        near = near_words(words)
        form = F.col("form_n") >= 2 * F.col("n")
        forms = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("near")).alias("form"), F.when(form, F.col("form_n")).alias("form_n"))
        forms = keep(common.written(forms, "forms"))
        roots = keep(common.written(_roots(forms.select("word", "form")), "variant_roots"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
