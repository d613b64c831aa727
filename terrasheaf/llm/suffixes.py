"""Byte-substring dedup with suffix arrays of shards.

A sampling step keeps suffix arrays to what can repeat: every string of `length` bytes has an anchor in it (the smallest
60-byte hash), equal strings have equal anchors, so only places whose anchor occurs twice go on. Each such place
carries the bytes around its anchor to the shard that holds the anchor. A shard sorts its suffixes by Larsson-Sadakane
refinement, takes common prefixes by Kasai's rule, and marks strings that two places share. An anchor with more bytes
than a shard holds spans several, whose sorted suffixes are merged by binary search.

An anchor in very many contexts (beyond MERGE_SHARDS shards, or beyond LOCAL_BYTES where its pieces are cut) would be too
much for one task. Its pieces are cut anew by longer anchors, which take in the bytes around it and so part its contexts,
and go through suffix arrays again; the longest anchor is the string itself, whose group has equal strings only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, ANCHOR = 200, 60
#: Bytes of text of one suffix array.
SHARD_BYTES = 1 << 21
#: Shards of one anchor that are merged in one task.
MERGE_SHARDS = 4
#: Places, and bytes of pieces, whose equals collapse before a shuffle; bytes of an anchor's pieces that are cut at once.
FLUSH_PLACES, FLUSH_BYTES, LOCAL_BYTES = 1_000_000, 32 << 20, 1 << 18
#: Turns in which anchors grow to whole strings.
TURNS = 3
#: Kinds of piece rows: an anchor's marker, a piece, a range settled in its task, a piece that passes through.
_MARK, _PIECE, _SETTLED, _LOOSE = range(4)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number (zeros past the end)."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out |= padded[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def suffix_array(data: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """All suffixes of data in order, by refinement of groups that share a prefix (Larsson and Sadakane): a pass sorts
    the members of groups not yet single by the rank of what follows the shared prefix, and doubles its length."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    words = _words(data) if words is None else words
    order = np.argsort(words, kind="stable")
    # a suffix that ends within the eight bytes equals a longer one with zeros there: shorter ones come first
    tail = np.minimum(n - np.arange(n), 8)[order]
    value = words[order]
    if (value[1:] == value[:-1]).any() and n > 1:
        order = order[np.lexsort((tail, value))]
        value, tail = words[order], np.minimum(n - order, 8)
    new = np.r_[True, (value[1:] != value[:-1]) | (tail[1:] != tail[:-1])]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    width = 8
    slots = np.flatnonzero(~(new & np.r_[new[1:], True]))  # places of the array in groups of several
    while len(slots):
        who = order[slots]
        after = who + width
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        group = rank[who]
        by = np.argsort(group * (n + 1) + key, kind="stable")
        who, key, group = who[by], key[by], group[by]
        order[slots] = who
        new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
        rank[who] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        slots = slots[~(new & np.r_[new[1:], True])]
        width *= 2
    return order


def _shared(words: np.ndarray, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b have in common."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        room = np.minimum(8, n - np.maximum(x, y))
        differ = words[np.minimum(x, n - 1)] ^ words[np.minimum(y, n - 1)]
        same = np.full(len(live), 8, np.int64)
        some = differ != 0
        # leading zero bytes of the difference
        d = differ[some]
        lead = np.zeros(len(d), np.int64)
        for k in range(7, 0, -1):
            lead += (d >> np.uint64(8 * (8 - k))) == 0
        same[some] = lead
        same = np.minimum(same, np.maximum(room, 0))
        out[live] += same
        live = live[same == 8]
    return out


def common_prefixes(data: np.ndarray, order: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Common prefix length of each suffix in order with the one before it (first: 0), by Kasai's rule: where the bytes
    before both suffixes agree, the length is one less than theirs; only the other places are compared."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    words = _words(data) if words is None else words
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    derived = np.zeros(n, bool)
    derived[1:] = (before[1:] > 0) & (data[:-1] == data[np.maximum(before[1:], 1) - 1]) & (before[1:] > 0)
    direct = np.flatnonzero(~derived & (before >= 0))
    length = np.zeros(n, np.int64)
    length[direct] = _shared(words, n, direct, before[direct])
    last = np.maximum.accumulate(np.where(derived, -1, place))
    length[derived] = length[last[derived]] - (place - last)[derived]
    return length[order]


def _sorted_windows(data: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(valid places in suffix order, number of their class): places of a class start the same `length` bytes."""
    words = _words(data)
    order = suffix_array(data, words)
    prefix = common_prefixes(data, order, words)
    cls = np.cumsum(prefix < length)
    keep = valid[order]
    return order[keep], cls[keep]


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], length: int) -> np.ndarray:
    """For each place of shard a (data, places in order), whether a place of shard b starts the same bytes: binary search
    of all at once, eight bytes at a time."""
    (da, pa_), (db, pb) = a, b
    wa, wb = _words(da), _words(db)
    lo, hi = np.zeros(len(pa_), np.int64), np.full(len(pa_), len(pb), np.int64)
    equal = np.zeros(len(pa_), bool)
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 and length >= 8 else [])]
    while (live := np.flatnonzero((lo < hi) & ~equal)).size:
        mid = (lo[live] + hi[live]) // 2
        x, y = pa_[live], pb[mid]
        sign = np.zeros(len(live), np.int8)
        for k in steps:
            open_ = np.flatnonzero(sign == 0)
            if not len(open_):
                break
            u, v = wa[x[open_] + k], wb[y[open_] + k]
            sign[open_] = np.where(u < v, -1, np.where(u > v, 1, 0))
        equal[live[sign == 0]] = True
        hi[live[sign < 0]] = mid[sign < 0]
        lo[live[sign > 0]] = mid[sign > 0] + 1
    return equal


def repeated_windows(pieces: list[bytes], counts: np.ndarray, length: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each distinct piece, a mask over its places that start `length` bytes which start at another place too (in
    any piece; a piece with count > 1 repeats all of its own). Pieces beyond shard_bytes are sorted in several shards."""
    sizes = np.array([len(p) for p in pieces])
    shards: list[list[int]] = [[]]
    total = 0
    for i, s in enumerate(sizes.tolist()):
        if shards[-1] and total + s > shard_bytes:
            shards.append([])
            total = 0
        shards[-1].append(i)
        total += s
    out = [np.full(max(len(p) - length + 1, 0), c > 1) for p, c in zip(pieces, counts.tolist(), strict=True)]
    kept = []
    for members in shards:
        data = np.frombuffer(b"".join(pieces[i] for i in members), np.uint8)
        begin = np.r_[0, np.cumsum(sizes[members])]
        room = np.repeat(begin[1:], sizes[members]) - np.arange(len(data))
        places, cls = _sorted_windows(data, room >= length, length)
        twice = np.bincount(cls, minlength=1)[cls] > 1 if len(cls) else np.zeros(0, bool)
        kept.append([data, places, cls, twice, begin, members])
    for i, one in enumerate(kept):
        for j, other in enumerate(kept):
            if i != j:
                one[3] = one[3] | _merge((one[0], one[1]), (other[0], other[1]), length)
    for data, places, _, twice, begin, members in kept:
        mask = np.zeros(len(data), bool)
        mask[places[twice]] = True
        for k, i in enumerate(members):
            out[i] |= mask[begin[k] : begin[k] + len(out[i])]
    return out


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, width: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """For each run of strings under one anchor: document, anchor, first string's place in the document, strings, and
    whether the run is tied (its strings may be equal to each other)."""
    width = min(width, length)
    size = np.maximum(np.diff(offsets) - length + 1, 0)
    if not size.sum():
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none, none.astype(bool)
    at = np.arange(len(data) - width + 1)
    grams = common.byte_range_hashes(data, at, at + width)
    begin = np.repeat(offsets[:-1], size) + common.ragged(size)
    doc = np.repeat(np.arange(len(size)), size)
    head, anchor, tied = common.anchor_runs(grams, begin, doc, length - width + 1)
    return doc[head], anchor, begin[head] - offsets[doc[head]], np.diff(np.r_[head, len(begin)]), tied


def anchor_places(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, doc, tag, first, twice): of anchors that a task meets more than once, the first is sent as `twice`; the
    others are settled there and then and leave as (null anchor). A tied run has its anchor twice by itself."""
    schema = "anchor long, doc long, tag int, first int, twice boolean"

    def flush(held: list[tuple]) -> pa.RecordBatch:
        doc, tag, anchor, first, tied = (np.concatenate([h[k] for h in held]) for k in range(5))
        order = np.argsort(anchor, kind="stable")
        head = np.r_[True, anchor[order[1:]] != anchor[order[:-1]]]
        follow = np.zeros(len(doc), bool)
        follow[order] = ~head
        twice = tied.copy()
        twice[order] |= head & np.r_[~head[1:], False]
        return common.record("anchor doc tag first twice", pa.array(anchor.view(np.int64), mask=follow), doc, tag.astype(np.int32), first.astype(np.int32), twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in common.slices(batches, "text"):
            ids, tags = common.column(batch, "doc").to_numpy(), common.column(batch, "tag").to_numpy()
            d, anchor, first, _, tied = _anchors(*common.buffers(common.column(batch, "text")), length)
            if len(d):
                held.append((ids[d], tags[d], anchor, first, tied))
                size += len(d)
            if size >= FLUSH_PLACES:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(common.tidy(run), schema)


def _equals(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """`columns` of rows that are `sure` or share `keys` with another row; those settled have keys of their own."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, while the next may share its keys
        was = False
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            same = np.ones(table.num_rows - 1, bool)
            for k in keys:
                x = common.column(table, k).to_numpy()
                same &= x[1:] == x[:-1]
            keep = common.column(table, "sure").to_numpy(zero_copy_only=False) | np.r_[was, same] | np.r_[same, False]
            held, was = table.slice(table.num_rows - 1), bool(same[-1]) if len(same) else was
            yield table.slice(0, table.num_rows - 1).select(columns).filter(pa.array(keep[:-1]))
        if held is not None and (was or common.column(held, "sure")[0].as_py()):
            yield held.select(columns)

    return dealt.mapInArrow(common.tidy(run), rows.select(*columns).schema)


def repeated_places(places: DataFrame) -> DataFrame:
    """(doc, tag, first) of places whose anchor occurs more than once."""
    settled = F.col("anchor").isNull()
    key = F.coalesce("anchor", F.xxhash64("doc", "first"))
    return _equals(places.select(key.alias("anchor"), (settled | F.col("twice")).alias("sure"), "doc", "tag", "first"), ["anchor"], ["doc", "tag", "first"])


_PIECES = "anchor long, kind int, doc long, tag int, first int, strings int, piece binary, copies int, tied boolean"


def _flushed(held: list[tuple], final: bool) -> Iterator[pa.RecordBatch]:
    """_PIECES of the pieces held: of equal ones, all repeated, one goes on with copies 2, the others leave settled, with an
    empty piece. Anchors with many bytes are marked and go on loose, unless they are the whole strings (final)."""
    doc, tag, anchor, first, count, tied, copies = (np.concatenate([h[k] for h in held]) for k in range(7))
    pieces = [p for h in held for p in h[7]]
    seen: dict[bytes, int] = {}
    copies, kind = copies.astype(np.int32), np.full(len(pieces), _PIECE, np.int32)
    size = np.array([len(p) for p in pieces], np.int64)
    for i, p in enumerate(pieces):
        if (j := seen.setdefault(p, i)) != i:
            copies[j], kind[i], pieces[i] = 2, _SETTLED, b""
    own = np.flatnonzero(kind == _PIECE)
    names, group = np.unique(anchor[own], return_inverse=True)
    hot = (np.bincount(group, size[own], minlength=len(names)) > LOCAL_BYTES) & (not final)
    kind[own[hot[group]]] = _LOOSE
    key = np.where(kind == _PIECE, anchor, common.mixed(doc.view(np.uint64) + first.astype(np.uint64)))
    yield common.record("anchor kind doc tag first strings piece copies tied", key.view(np.int64), kind, doc, tag.astype(np.int32), first.astype(np.int32), count.astype(np.int32), pa.array(pieces, pa.binary()), copies, tied)
    if hot.any():
        marks = names[hot]
        none = np.zeros(len(marks), np.int32)
        yield common.record("anchor kind doc tag first strings piece copies tied", marks.view(np.int64), none + _MARK, none.astype(np.int64), none, none, none, pa.array([b""] * len(marks), pa.binary()), none, none.astype(bool))


def pieces_of(docs: DataFrame, length: int) -> DataFrame:
    """_PIECES: the bytes of all strings under each wanted anchor of docs (doc, tag, text, firsts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in common.slices(batches, "text"):
            data, offsets = common.buffers(common.column(batch, "text"))
            d, anchor, first, count, tied = _anchors(data, offsets, length)
            wanted = common.column(batch, "firsts")
            flat, ends = wanted.flatten().to_numpy(), wanted.offsets.to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            mine = np.flatnonzero(np.isin((d << 40) + first, (owner << 40) + flat.astype(np.int64)))
            raw = data.tobytes()
            while len(mine):  # a very long text is cut in several turns
                cut = max(1, int(np.searchsorted(np.cumsum(count[mine] + length), FLUSH_BYTES)))
                m, mine = mine[:cut], mine[cut:]
                at = (offsets[d[m]] + first[m]).tolist()
                pieces = [raw[a : a + c + length - 1] for a, c in zip(at, count[m].tolist(), strict=True)]
                held.append((common.column(batch, "doc").to_numpy()[d[m]], common.column(batch, "tag").to_numpy()[d[m]], anchor[m], first[m], count[m], tied[m], np.ones(len(m), np.int32), pieces))
                size += int(count[m].sum()) + length * len(m)
                if size >= FLUSH_BYTES:
                    yield from _flushed(held, length <= ANCHOR)
                    held, size = [], 0
        if held:
            yield from _flushed(held, length <= ANCHOR)

    return docs.mapInArrow(common.tidy(run), _PIECES)


def recut_pieces(ranges: DataFrame, length: int, width: int) -> DataFrame:
    """_PIECES of the pieces that ranges (_RANGES) sends on, under anchors of `width` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for a, b in _portions(np.cumsum(common.lengths(common.column(batch, "piece"))), SHARD_BYTES):
                part = batch.slice(a, b - a)
                data, offsets = common.buffers(common.column(part, "piece"))
                d, anchor, first, count, tied = _anchors(data, offsets, length, width)
                doc, tag, start = (common.column(part, c).to_numpy() for c in ("doc", "tag", "start"))
                copies = 1 + common.column(part, "sure").to_numpy(zero_copy_only=False).astype(np.int32)
                raw, mine = data.tobytes(), np.arange(len(d))
                while len(mine):
                    cut = max(1, int(np.searchsorted(np.cumsum(count[mine] + length), FLUSH_BYTES)))
                    m, mine = mine[:cut], mine[cut:]
                    at = (offsets[d[m]] + first[m]).tolist()
                    pieces = [raw[x : x + c + length - 1] for x, c in zip(at, count[m].tolist(), strict=True)]
                    held.append((doc[d[m]], tag[d[m]], anchor[m], start[d[m]] + first[m], count[m], tied[m], copies[d[m]], pieces))
                    size += int(count[m].sum()) + length * len(m)
                    if size >= FLUSH_BYTES:
                        yield from _flushed(held, width >= length)
                        held, size = [], 0
        if held:
            yield from _flushed(held, width >= length)

    return ranges.filter("piece is not null").mapInArrow(common.tidy(run), _PIECES)


_RANGES = "doc long, tag int, start int, stop int, piece binary, sure boolean"


def sharded_ranges(pieces: DataFrame, length: int, shard_bytes: int = SHARD_BYTES, final: bool = False) -> DataFrame:
    """_RANGES: byte ranges that repeated strings cover, from the shards' suffix arrays (piece null); and the pieces of
    anchors that are too large for one task. final: anchors are whole strings, and none is too large."""
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(n, "anchor").sortWithinPartitions("anchor", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(length, shard_bytes)
        open_ = None  # the anchor at hand, if it is sent on
        for batch in batches:
            cols = [common.column(batch, c).to_pylist() for c in ("anchor", "kind", "doc", "tag", "first", "strings", "piece", "copies", "tied")]
            for anchor, kind, doc, tag, first, strings, piece, copies, tied in zip(*cols, strict=True):
                if kind == _SETTLED:
                    shard.settled.append((doc, tag, first, first + strings + length - 1, None, True))
                elif kind == _LOOSE or (kind == _PIECE and anchor == open_):
                    shard.send_on(piece, copies, (doc, tag, first))
                elif kind == _MARK:
                    open_ = anchor
                else:
                    if anchor != shard.anchor:
                        shard.next_anchor(anchor)
                        if shard.size >= shard_bytes:
                            shard.solve()
                    shard.add(piece, copies, tied, (doc, tag, first))
                    if not final and shard.own_size > MERGE_SHARDS * shard_bytes:
                        shard.give_up()
                        open_ = anchor
                if shard.waiting > 1 << 22:
                    yield shard.out()
        shard.next_anchor(None)
        shard.solve()
        yield shard.out()

    return dealt.mapInArrow(common.tidy(run), _RANGES)


class _Shard:
    """Distinct pieces of whole anchors up to a size, with the places they come from."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit, self.anchor = length, limit, None
        self.settled: list[tuple] = []
        self.loose = 0
        self.clear()

    def clear(self) -> None:
        self.pieces: list[bytes] = []
        self.places: list[list[tuple]] = []
        self.copies: list[int] = []
        self.own: dict[bytes, int] = {}
        self.start = self.size = self.own_size = 0
        self.tied = False

    @property
    def waiting(self) -> int:
        """Bytes, about, of what is to go out."""
        return 60 * len(self.settled) + self.loose

    def add(self, piece: bytes, copies: int, tied: bool, place: tuple) -> None:
        self.tied |= tied
        k = self.own.get(piece)
        if k is None:
            self.own[piece] = k = len(self.pieces)
            self.pieces.append(piece)
            self.places.append([])
            self.copies.append(0)
            self.size += len(piece)
            self.own_size += len(piece)
        elif self.copies[k] > 1:  # known to be repeated whole: the place need not wait
            self.settled.append((*place, place[2] + len(piece), None, True))
            return
        self.copies[k] += copies
        self.places[k].append(place)

    def next_anchor(self, anchor) -> None:
        """A lone distinct piece whose strings differ needs no sorting: it is repeated whole or not at all."""
        if len(self.pieces) - self.start == 1 and not self.tied:
            piece = self.pieces.pop()
            copies, places = self.copies.pop(), self.places.pop()
            self.size -= len(piece)
            if copies > 1:
                self.settled += [(*p, p[2] + len(piece), None, True) for p in places]
        self.anchor, self.own, self.start, self.own_size, self.tied = anchor, {}, len(self.pieces), 0, False

    def send_on(self, piece: bytes, copies: int, place: tuple) -> None:
        self.settled.append((*place, place[2] + len(piece), piece, copies > 1))
        self.loose += len(piece)

    def give_up(self) -> None:
        """Sends on the pieces of the anchor at hand."""
        for piece, copies, places in zip(self.pieces[self.start :], self.copies[self.start :], self.places[self.start :], strict=True):
            self.send_on(piece, copies, places[0])
            self.settled += [(*p, p[2] + len(piece), None, True) for p in places[1:]]
        self.pieces, self.copies, self.places = self.pieces[: self.start], self.copies[: self.start], self.places[: self.start]
        self.size -= self.own_size
        self.own, self.own_size, self.tied = {}, 0, False

    def solve(self) -> None:
        if self.pieces:
            for piece, mask, places in zip(self.pieces, repeated_windows(self.pieces, np.array(self.copies), self.length, self.limit), self.places, strict=True):
                at = np.flatnonzero(mask)
                if len(at):
                    a, b = common.covered_runs(at, at + self.length)
                    self.settled += [(d, t, f + x, f + y, None, True) for d, t, f in places for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        self.clear()

    def out(self) -> pa.RecordBatch:
        cols = list(zip(*self.settled, strict=True)) or [()] * 6
        self.settled, self.loose = [], 0
        return common.record("doc tag start stop piece sure", *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()), strict=True)))


def _portions(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield at, to
        at = to


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, removed array<struct<start, stop>> in bytes, kept binary) for each row.

    A byte goes if a string of `length` bytes over it starts anywhere else too, in any row or its own. Null text: empty.
    Null doc_id: as any other. Rows that repeat both id and text are each counted, so both lose their strings. Cuts may
    split a character, hence kept is binary. Empty table: empty result. Other columns do not matter. Very long or periodic
    texts: pieces are cut by bytes, and periodic text has as few of them as any other. Texts are shuffled once and read
    twice."""
    if length < 8:
        raise ValueError("length must be 8 or more")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.coalesce(F.col(doc_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.hash(text).alias("tag"), text.alias("text"))
    dealt = base.repartition(n, "doc", "tag")
    wanted = repeated_places(anchor_places(base.select("doc", "tag", "text"), length)).groupBy("doc", "tag").agg(F.collect_set("first").alias("firsts"))
    pieces = pieces_of(dealt.select("doc", "tag", "text").join(wanted.hint("shuffle_hash"), ["doc", "tag"]), length)
    found = common.written(sharded_ranges(pieces, length, shard_bytes, length <= ANCHOR), "ranges")
    ranges = found.filter("piece is null").select("doc", "tag", "start", "stop")
    for turn in range(1, TURNS + 1):
        if not found.filter("piece is not null").take(1):
            break
        width = ANCHOR + (length - ANCHOR) * turn // TURNS
        found = common.written(sharded_ranges(recut_pieces(found, length, width), length, shard_bytes, width >= length), "ranges")
        ranges = ranges.unionByName(found.filter("piece is null").select("doc", "tag", "start", "stop"))
    ranges = ranges.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return dealt.join(ranges.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc_id", "text", "spans").mapInArrow(common.tidy(_without), "doc_id long, n_bytes long, n_removed long, n_spans long, removed array<struct<start: int, stop: int>>, kept binary")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    for batch in common.slices(batches, "text"):
        n_bytes, n_removed, removed, kept = [], [], [], []
        for text, spans in zip(common.column(batch, "text").to_pylist(), common.column(batch, "spans").to_pylist(), strict=True):
            raw = text.encode()
            cuts = sorted((s["start"], s["stop"]) for s in spans or ())
            a, b = common.covered_runs(*(np.array([c[k] for c in cuts], np.int64) for k in range(2)))
            parts, at = [], 0
            for s, e in zip(a.tolist(), b.tolist(), strict=True):
                parts.append(raw[at:s])
                at = e
            parts.append(raw[at:])
            kept.append(b"".join(parts))
            n_bytes.append(len(raw))
            n_removed.append(len(raw) - len(kept[-1]))
            removed.append([{"start": s, "stop": e} for s, e in zip(a.tolist(), b.tolist(), strict=True)])
        yield common.record("doc_id n_bytes n_removed n_spans removed kept", common.column(batch, "doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(r) for r in removed], pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary()))
