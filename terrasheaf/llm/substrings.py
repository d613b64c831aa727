"""Substring dedup over a De Bruijn graph of words.

Edges are windows of k words; an edge leads from its first k - 1 words (a node) to its last k - 1 words. Edges of a
document that follow each other under one anchor (the smallest 4-word hash in each of them) travel as one chain, without
a row for each word; equal edges have equal anchors, so they meet in one join by anchor. There an edge is repeated if a
smaller document holds it, and that holder is its source. Repeated edges that leave one node and enter the next in both
the document and the source compact into nonbranching paths by joins of the nodes that edges leave with those that edges
enter. Each path is verified at its source coordinates: the words there must be the same.

Edges travel as 48 bits of their hash, beside the 64 bits of their anchor, and the chains of a bucket of anchors as one
packed value, which is unpacked behind the shuffle.

An anchor in very many contexts does not meet in one task: where a task sees many edges of it, they go on edge by edge,
and a marker tells the join to send on whatever else it gets of that anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, ANCHOR = 13, 4
EDGE_BYTES = 6
#: Edges whose equal chains collapse before the shuffle (about 100 bytes each while they do).
FLUSH_EDGES = 4_000_000
#: Distinct edges of an anchor in one flush, or in one task of the join, above which they go on edge by edge.
LOCAL_EDGES, JOIN_EDGES = 4_096, 65_536
#: Id of rows without one: after all others, and never a smaller document.
NO_ID = (1 << 63) - 1
#: Kinds of chain rows: an anchor's marker, a chain, a run of edges settled in its task, edges that pass through.
_MARK, _CHAIN, _SETTLED, _LOOSE = range(4)
_CHAINS = "anchor long, kind int, doc long, tag int, first int, chain binary"
_HITS = "doc long, tag int, first int, edges int, src_doc long, src_tag int, src_first int"


def _doc_chains(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """For each chain: document, anchor, first window's word place in the document, windows; then all windows' hashes, of
    EDGE_BYTES."""
    starts, ends, first = common.word_bounds(data, offsets)
    words = common.byte_range_hashes(data, starts, ends)
    n = np.diff(first)
    size = np.maximum(n - window + 1, 0)
    begin = np.repeat(first[:-1], size) + common.ragged(size)
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none, none.view(np.uint64)
    width = min(ANCHOR, window)
    places = np.arange(max(len(words) - width + 1, 0))
    grams = common.range_hashes(words, places, places + width)
    doc = np.repeat(np.arange(len(n)), size)
    head, anchor, _ = common.anchor_runs(grams, begin, doc, window - width + 1)
    d = doc[head]
    return d, anchor, begin[head] - first[d], np.diff(np.r_[head, len(begin)]), common.range_hashes(words, begin, begin + window) >> np.uint64(64 - 8 * EDGE_BYTES)


def _holders(key: np.ndarray) -> np.ndarray:
    """For each place, the first place that has an equal key."""
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order[1:]] != key[order[:-1]]][: len(order)]
    out = np.empty(len(key), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return out


def _runs(doc, tag, place, src_doc, src_tag, src_place) -> pa.RecordBatch:
    """_HITS: repeated edges that follow each other in document and source as one row. Arrays in document order."""
    new = np.ones(len(doc), bool)
    step = lambda x: x[1:] - x[:-1]
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (step(place) != 1) | (src_doc[1:] != src_doc[:-1]) | (src_tag[1:] != src_tag[:-1]) | (step(src_place) != 1)
    at = np.flatnonzero(new)
    cols = (doc[at], tag[at], place[at], np.diff(np.r_[at, len(doc)]), src_doc[at], src_tag[at], src_place[at])
    return common.record("doc tag first edges src_doc src_tag src_first", *(pa.array(c.astype(np.int64 if k in (0, 4) else np.int32)) for k, c in enumerate(cols)))


def _chain_rows(anchor, kind: int, doc, tag, first, chain: pa.Array) -> pa.RecordBatch:
    return common.record("anchor kind doc tag first chain", anchor.view(np.int64), np.full(len(doc), kind, np.int32), doc.astype(np.int64), tag.astype(np.int32), first.astype(np.int32), chain)


def _settled_rows(doc, tag, first, count, src_doc, src_tag, src_first) -> pa.RecordBatch:
    info = np.stack([src_doc, src_tag, src_first, count], axis=1).astype("<i8")
    return _chain_rows(common.mixed(doc.astype(np.int64).view(np.uint64) + first.astype(np.uint64)), _SETTLED, doc, tag, first, common.binaries(info, 32 * np.arange(1, len(doc) + 1)))


def _hash_lists(hashes: np.ndarray, count: np.ndarray, width: int = EDGE_BYTES) -> pa.Array:
    return common.binaries(np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]), width * np.cumsum(count))


def _hashes_of(chain: pa.Array, width: int = EDGE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(all hashes, number of each row)."""
    data, offsets = common.buffers(chain)
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(-1, width)
    return out.view("<u8").reshape(-1), np.diff(offsets) // width


def _edge_keys(anchor: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """64 bits of an edge, from its anchor and its hash."""
    return common.mixed(anchor.view(np.uint64) ^ common.mixed(hashes))


def _key_lists(keys: np.ndarray) -> pa.Array:
    return _hash_lists(keys, np.ones(len(keys), np.int64), 8)


def _flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Chain rows of all held chains. Of equal chains, those with a smaller holder here are settled; so are equal edges
    of anchors with many edges, of which the rest is loose."""
    doc, tag, anchor, first, count = (np.concatenate([h[k] for h in held]) for k in range(5))
    hashes = np.concatenate([h[5] for h in held])
    begin = np.cumsum(count) - count
    order = np.lexsort((first, tag, doc))
    mix = common.range_hashes(common.mixed(hashes), begin, begin + count) ^ common.mixed(anchor + count.astype(np.uint64))
    source = np.empty(len(order), np.int64)
    source[order] = order[_holders(mix[order])]
    copy = doc[source] < doc
    c, s = np.flatnonzero(copy), source[copy]
    if len(c):
        yield _settled_rows(doc[c], tag[c], first[c], count[c], doc[s], tag[s], first[s])
    own = order[~copy[order]]
    place, total = np.unique(anchor[own], return_inverse=True)
    hot = (np.bincount(total, count[own]) > LOCAL_EDGES)[total]
    rest = own[~hot]
    each = np.repeat(begin[rest], count[rest]) + common.ragged(count[rest])
    yield _chain_rows(anchor[rest], _CHAIN, doc[rest], tag[rest], first[rest], _hash_lists(hashes[each], count[rest]))
    if hot.any():
        marks = np.unique(anchor[own[hot]])
        none = np.zeros(len(marks), np.int64)
        yield _chain_rows(marks, _MARK, none, none, none, common.binaries(np.zeros(0, np.uint8), none))
        h = own[hot]
        step = common.ragged(count[h])
        e_doc, e_tag, e_place, e_hash = np.repeat(doc[h], count[h]), np.repeat(tag[h], count[h]), np.repeat(first[h], count[h]) + step, hashes[np.repeat(begin[h], count[h]) + step]
        source = _holders(_edge_keys(np.repeat(anchor[h], count[h]), e_hash))
        again = e_doc[source] < e_doc
        runs = _runs(e_doc[again], e_tag[again], e_place[again], e_doc[source[again]], e_tag[source[again]], e_place[source[again]])
        yield _settled_rows(*(common.column(runs, x).to_numpy() for x in ("doc", "tag", "first", "edges", "src_doc", "src_tag", "src_first")))
        k = ~again
        keys = _edge_keys(np.repeat(anchor[h], count[h])[k], e_hash[k])
        yield _chain_rows(common.mixed(keys), _LOOSE, e_doc[k], e_tag[k], e_place[k], _key_lists(keys))


#: Buckets of anchors for each partition of the join: so many packs of chains that their number evens out.
PARTITION_BUCKETS = 16
_PACKS = "bucket int, pack binary"


def _planes(values: np.ndarray) -> bytes:
    """Bytes of a column of numbers, the lowest of all first: those that are mostly zero compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _from_planes(raw: memoryview, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n), at + n * size


def _packed(rows: list[pa.RecordBatch], buckets: int) -> pa.RecordBatch:
    """_PACKS of chain rows: those of a bucket of anchors as one value, columns apart. A chain costs about 45 bytes so,
    where a row of its own costs 60."""
    table = pa.Table.from_batches(rows).combine_chunks()
    anchor, kind, doc, tag, first = (table[c].to_numpy() for c in ("anchor", "kind", "doc", "tag", "first"))
    anchor = anchor.view(np.uint64)
    bucket = (common.mixed(anchor) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((anchor, bucket))
    data, offsets = common.buffers(table["chain"].combine_chunks() if isinstance(table["chain"], pa.ChunkedArray) else table["chain"])
    begin = np.flatnonzero(np.r_[True, bucket[order[1:]] != bucket[order[:-1]]])
    packs = []
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
        own = order[a:b]
        docs, index = np.unique(np.stack([doc[own], tag[own].astype(np.int64)], axis=1), axis=0, return_inverse=True)
        size = (offsets[own + 1] - offsets[own]).astype(np.uint32)
        columns = (np.diff(anchor[own], prepend=np.uint64(0)), index.reshape(-1).astype(np.uint32), first[own].view(np.uint32), size, kind[own].astype(np.uint8), docs[:, 0].copy(), docs[:, 1].astype(np.int32))
        meta = pa.compress(b"".join(map(_planes, columns)), codec="zstd", asbytes=True)
        places = np.repeat(offsets[own], size) + common.ragged(size.astype(np.int64))
        packs.append(np.array([len(own), len(docs), len(meta)], "<u4").tobytes() + meta + data[places].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[order[begin]]), pa.array(packs, pa.binary())], names=["bucket", "pack"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chain rows of _PACKS."""
    for batch in batches:
        for pack in common.column(batch, "pack"):
            raw = memoryview(pack.as_buffer())
            n, n_docs, length = np.frombuffer(raw, "<u4", 3).tolist()
            meta = memoryview(pa.decompress(raw[12 : 12 + length], decompressed_size=21 * n + 12 * n_docs, codec="zstd", asbytes=True))
            columns, at = [], 0
            for kind, m in (("<u8", n), ("<u4", n), ("<i4", n), ("<u4", n), ("u1", n), ("<i8", n_docs), ("<i4", n_docs)):
                values, at = _from_planes(meta, at, m, kind)
                columns.append(values)
            step, index, first, size, kind, doc, tag = columns
            chain = common.binaries(np.frombuffer(raw, np.uint8, offset=12 + length), np.cumsum(size.astype(np.int64)))
            yield common.record("anchor kind doc tag first chain", np.cumsum(step).view(np.int64), kind.astype(np.int32), doc[index], tag[index], first, chain)


def chains(docs: DataFrame, window: int) -> DataFrame:
    """_PACKS for docs (doc, tag, text)."""
    buckets = PARTITION_BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in common.slices(batches, "text"):
            ids, tags = common.column(batch, "doc").to_numpy(), common.column(batch, "tag").to_numpy()
            d, anchor, first, count, hashes = _doc_chains(*common.buffers(common.column(batch, "text")), window)
            if len(d):
                held.append((ids[d], tags[d], anchor, first, count, hashes))
                size += len(hashes)
            if size >= FLUSH_EDGES:
                yield _packed(list(_flush(held)), buckets)
                held, size = [], 0
        if held:
            yield _packed(list(_flush(held)), buckets)

    return docs.mapInArrow(common.tidy(run), _PACKS)


_JOINED = f"{_HITS}, chain binary"


def _as_joined(hits: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*hits.columns, pa.nulls(hits.num_rows, pa.binary())], names=[*hits.schema.names, "chain"])


def _loose(doc, tag, first, chain: pa.Array) -> pa.RecordBatch:
    none = pa.array(np.zeros(len(doc), np.int32))
    return common.record("doc tag first edges src_doc src_tag src_first chain", doc.astype(np.int64), tag.astype(np.int32), first.astype(np.int32), none, doc.astype(np.int64), none, none, chain)


def joined_chains(rows: DataFrame) -> DataFrame:
    """_HITS of the edges of chains (_PACKS) that a smaller document holds, with the smallest one's coordinates; and, with
    64-bit keys in `chain`, the edges of anchors that are too large for one task.

    Rows of an anchor come in document order, so the first holder of an edge is its smallest. Distinct edges of the
    anchor at hand are remembered, JOIN_EDGES at most."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "bucket").mapInArrow(common.tidy(_unpacked), _CHAINS).sortWithinPartitions("anchor", "kind", "doc", "tag", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list[np.ndarray] | None = None  # of the last anchor: its edges' anchor, hash, doc, tag, place
        open_ = None  # the last anchor, if it is sent on
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, kind, doc, tag, first = (common.column(batch, c).to_numpy() for c in ("anchor", "kind", "doc", "tag", "first"))
            chain = common.column(batch, "chain")
            done = np.flatnonzero(kind == _SETTLED)
            if len(done):
                info = np.frombuffer(common.buffers(chain.take(pa.array(done)))[0].tobytes(), "<i8").reshape(-1, 4)
                yield _as_joined(common.record("doc tag first edges src_doc src_tag src_first", doc[done], tag[done], first[done], info[:, 3].astype(np.int32), info[:, 0], info[:, 1].astype(np.int32), info[:, 2].astype(np.int32)))
            marked = np.isin(anchor, anchor[kind == _MARK])
            if open_ is not None:
                marked |= anchor == open_
            on = np.flatnonzero(kind == _LOOSE)
            if len(on):
                yield _loose(doc[on], tag[on], first[on], chain.take(pa.array(on)))
            on = np.flatnonzero((kind == _CHAIN) & marked)
            if len(on):
                hashes, count = _hashes_of(chain.take(pa.array(on)))
                yield _loose(doc[on], tag[on], first[on], _hash_lists(_edge_keys(np.repeat(anchor[on], count), hashes), count, 8))
            real = np.flatnonzero(kind <= _CHAIN)
            last = anchor[real[-1]] if len(real) else None
            if last is not None and not (open_ is not None and last == open_):
                open_ = last if marked[real[-1]] else None
            pick = np.flatnonzero((kind == _CHAIN) & ~marked)
            if not len(pick):
                if last is not None and state is not None and state[0][0] != last:
                    state = None
                continue
            hashes, count = _hashes_of(chain.take(pa.array(pick)))
            step = common.ragged(count)
            e = [np.repeat(anchor[pick], count), hashes, np.repeat(doc[pick], count), np.repeat(tag[pick], count), np.repeat(first[pick], count) + step]
            known = 0
            if state is not None and state[0][0] == anchor[pick[0]]:
                known = len(state[0])
                e = [np.concatenate([a, b]) for a, b in zip(state, e, strict=True)]
            source = _holders(_edge_keys(e[0], e[1]))
            again = e[2][source] < e[2]
            again[:known] = False
            if again.any():
                s = source[again]
                yield _as_joined(_runs(e[2][again], e[3][again], e[4][again], e[2][s], e[3][s], e[4][s]))
            keep = (source == np.arange(len(source))) & (e[0] == e[0][-1])
            state = [x[keep] for x in e]
            if last != e[0][-1]:
                state = None
            elif len(state[0]) > JOIN_EDGES:
                yield _loose(state[2], state[3], state[4], _key_lists(_edge_keys(state[0], state[1])))
                open_, state = last, None

    return dealt.mapInArrow(common.tidy(run), _JOINED)


def loose_edges(joined: DataFrame) -> DataFrame:
    """_HITS of the edges that go edge by edge: dealt by their hash, each meets its smallest holder."""
    n = int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, count = _hashes_of(common.column(batch, "chain"), 8)
            row = np.repeat(np.arange(batch.num_rows), count)
            doc, tag, first = (common.column(batch, c).to_numpy()[row] for c in ("doc", "tag", "first"))
            yield common.record("edge doc tag place", keys.view(np.int64), doc, tag, (first + common.ragged(count)).astype(np.int32))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the first holder of the edge at hand
        for batch in batches:
            if not batch.num_rows:
                continue
            e = [common.column(batch, c).to_numpy() for c in ("edge", "doc", "tag", "place")]
            known = 0
            if held is not None and held[0][0] == e[0][0]:
                known, e = 1, [np.concatenate([a, b]) for a, b in zip(held, e, strict=True)]
            new = np.r_[True, e[0][1:] != e[0][:-1]]
            source = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            again = np.flatnonzero(e[1][source] < e[1])
            again = again[again >= known]
            again = again[np.lexsort((e[3][again], e[2][again], e[1][again]))]
            s = source[again]
            yield _runs(e[1][again], e[2][again], e[3][again], e[1][s], e[2][s], e[3][s])
            held = [x[source[-1:]] for x in e]

    edges = joined.filter("chain is not null").select("doc", "tag", "first", "chain").mapInArrow(common.tidy(cut), "edge long, doc long, tag int, place int")
    return edges.repartition(n, "edge").sortWithinPartitions("edge", "doc", "tag", "place").mapInArrow(common.tidy(meet), _HITS)


def repeated_edges(rows: DataFrame) -> DataFrame:
    """_HITS of all chains (_PACKS)."""
    joined = common.written(joined_chains(rows), "edges")
    hits = joined.filter("chain is null").drop("chain")
    return hits.unionByName(loose_edges(joined)) if joined.filter("chain is not null").take(1) else hits


_SOURCE = ("doc", "tag", "src_doc", "src_tag", "shift")


def paths(hits: DataFrame, window: int) -> DataFrame:
    """(doc, tag, start, stop, src_doc, src_tag, src_start): nonbranching paths of repeated edges, in words covered, ends
    exclusive.

    A node is the k - 1 words at a place of the document and at the place of the source that goes with it. An edge has
    one source, so one edge at most leaves a node and one enters it. Nodes without an entering edge begin a path, nodes
    without a leaving one end it: two anti-joins, whose n-th rows belong together."""
    runs = hits.withColumn("shift", F.col("first") - F.col("src_first"))
    leaves, enters = runs.select(*_SOURCE, F.col("first").alias("node")), runs.select(*_SOURCE, (F.col("first") + F.col("edges")).alias("node"))
    on = [*_SOURCE, "node"]
    begins = leaves.join(enters, on, "left_anti").groupBy(*_SOURCE).agg(F.sort_array(F.collect_set("node")).alias("begins"))
    ends = enters.join(leaves, on, "left_anti").groupBy(*_SOURCE).agg(F.sort_array(F.collect_set("node")).alias("ends"))
    path = begins.join(ends, list(_SOURCE)).select(*_SOURCE, F.explode(F.arrays_zip("begins", "ends")).alias("p"))
    start = F.col("p.begins")
    return path.select("doc", "tag", start.alias("start"), (F.col("p.ends") + (window - 1)).alias("stop"), "src_doc", "src_tag", (start - F.col("shift")).alias("src_start"))


_SPAN = ["src_doc", "src_tag", "src_start", "src_stop"]
#: Paths of one source span for each of its slots.
SLOT_PATHS = 1_000


def _hot_spans(found: DataFrame) -> DataFrame:
    """(_SPAN, slots): source spans of very many paths; common.HOT_KEYS rows at most."""
    counts = found.groupBy(*_SPAN).agg(F.count("*").alias("n"))
    total = F.broadcast(found.agg(F.count("*").alias("total")))
    hot = F.col("n") > F.greatest(F.lit(SLOT_PATHS), F.expr(f"total div {common.HOT_KEYS}"))
    return counts.join(total).filter(hot).select(*_SPAN, F.ceil(F.col("n") / SLOT_PATHS).cast("int").alias("slots"))


def _digest(words: list[bytes], start: int, stop: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start:stop]), digest_size=16).digest()


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, removed array<struct<start, stop>> in words, kept_text) for each row of docs.

    A word goes if a window of `window` words over it also starts in a document of smaller doc_id. Null text: no
    words. Null doc_id: counts as larger than all others. Rows of equal doc_id do not remove each other's words.
    Empty table: empty result. Other columns do not matter. Very long or periodic texts: chains are cut by edges, not by
    texts, and periodic text has as few chains as any other. Texts are shuffled once, and that shuffle is read by both
    sides of the verification. A source span that very many documents repeat meets them in several
    slots, each with a copy of its digest."""
    if not 1 <= window <= 60:
        raise ValueError("window must be 1 to 60")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.coalesce(F.col(doc_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.hash(text).alias("tag"), text.alias("text"))
    with common.passing(docs.sparkSession) as keep:
        found = keep(common.written(paths(repeated_edges(chains(base.select("doc", "tag", "text"), window)), window), "paths"))
    dealt = base.repartition(n, "doc", "tag")
    found = found.withColumn("src_stop", F.col("src_start") + F.col("stop") - F.col("start"))
    wanted = found.groupBy(F.col("src_doc").alias("doc"), F.col("src_tag").alias("tag")).agg(F.collect_set(F.struct("src_start", "src_stop")).alias("spans"))
    seen = dealt.select("doc", "tag", "text").join(wanted.hint("shuffle_hash"), ["doc", "tag"]).mapInArrow(common.tidy(_source_digests), "src_doc long, src_tag int, src_start int, src_stop int, digest binary").dropDuplicates(_SPAN)
    # a span that very many documents repeat: they and its digest, once for each of its slots, meet in many tasks
    hot = F.broadcast(common.written(_hot_spans(found), "hot_spans"))
    slot = F.pmod(F.xxhash64("doc", "tag", "start"), F.coalesce("slots", F.lit(1))).cast("int")
    spread = found.join(hot, _SPAN, "left").withColumn("slot", slot).drop("slots")
    digests = seen.join(hot, _SPAN, "left").withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))).drop("slots")
    checked = spread.join(digests, [*_SPAN, "slot"])
    own = checked.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "stop", "digest")).alias("spans"))
    return dealt.join(own.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc_id", "text", "spans").mapInArrow(common.tidy(_without()), "doc_id long, n_words long, n_removed long, removed array<struct<start: int, stop: int>>, kept_text string")


def _source_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, tag, text, spans in zip(*(common.column(batch, c).to_pylist() for c in ("doc", "tag", "text", "spans")), strict=True):
            words = text.encode().split()
            out += [(doc, tag, s["src_start"], s["src_stop"], _digest(words, s["src_start"], s["src_stop"])) for s in spans]
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["src_doc", "src_tag", "src_start", "src_stop", "digest"])


def _without():
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            n_words, n_removed, removed, kept = [], [], [], []
            for text, spans in zip(common.column(batch, "text").to_pylist(), common.column(batch, "spans").to_pylist(), strict=True):
                words = text.encode().split()
                true = sorted((s["start"], s["stop"]) for s in spans or () if _digest(words, s["start"], s["stop"]) == s["digest"])
                a, b = common.covered_runs(*(np.array([t[k] for t in true], np.int64) for k in range(2)))
                left, at = [], 0
                for s, e in zip(a.tolist(), b.tolist(), strict=True):
                    left += words[at:s]
                    at = e
                left += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                removed.append([{"start": s, "stop": e} for s, e in zip(a.tolist(), b.tolist(), strict=True)])
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "removed", "kept_text"])

    return run
