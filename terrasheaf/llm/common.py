"""Helpers shared by the training-data operators: shared scratch tables, Arrow slices, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import threading
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasheaf.sources.files import scratch

#: Bytes of text that one numpy step handles; a longer document is handled alone and whole.
SLICE_BYTES = 1 << 21

#: ASCII white space, the separators of the word rule `[^\x20\x09-\x0D]+`.
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)

_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df cut from its lineage: written as Parquet in the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    if blocks := _open_blocks():
        blocks[-1].append(path)
    return out


_LOCAL = threading.local()


def _open_blocks() -> list[list[str]]:
    """Paths written in each open block of passing() of this thread, the innermost last."""
    if not hasattr(_LOCAL, "blocks"):
        _LOCAL.blocks = []
    return _LOCAL.blocks


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block at whose end the tables written in it are removed, but for those given to the function it yields. What the
    block hands on must be written itself, so that no lost executor asks for what is gone."""
    own: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._scratch)
        return df

    blocks = _open_blocks()
    blocks.append(own)
    try:
        yield keep
    finally:
        blocks.pop()
        if blocks:
            blocks[-1].extend(p for p in own if p in kept)
        remove(spark, [p for p in own if p not in kept])


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Removes folders of the shared store through Spark's own file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        name = jvm.org.apache.hadoop.fs.Path(path)
        name.getFileSystem(conf).delete(name, True)


#: A key is hot with over HOT_ROWS rows and a HOT_KEYS-th of all: HOT_KEYS keys can be, at most.
HOT_ROWS, HOT_KEYS = 1_000, 10_000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, n: str = "n") -> DataFrame:
    """left joined with right, which has one row a key; counts (on, n) tells the rows of left by key.

    Rows of hot keys stay where they are and meet the few rows of right by broadcast; only the others are dealt by key."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    hot = counts.filter(F.col(n) > max(HOT_ROWS, total // HOT_KEYS)).select(*on)
    if not hot.take(1):
        return left.join(right, on)
    hot = written(hot, "hot")
    few = right.join(F.broadcast(hot), on, "left_semi")
    rest = left.join(F.broadcast(hot), on, "left_anti").join(right, on)
    return left.join(F.broadcast(few), on).unionByName(rest)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def tidy(run: Callable) -> Callable:
    """run, an Arrow batch function, that hands freed memory back to the system when its task ends.

    Python workers live on and serve other jobs; what their allocators keep would add up to an executor's memory."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return tidied


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about `limit` bytes of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(lengths(column(batch, text)))
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def lengths(text: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each value, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if text.null_count:
        text = text.fill_null("")
    if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(text.buffers()[1], kind, len(text) + 1 + text.offset)[text.offset :].astype(np.int64)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte bounds of all words, and each document's first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    some = offsets[1:] > offsets[:-1]
    at, to = offsets[:-1][some], offsets[1:][some] - 1
    begins[at] |= inside[at]
    stops[to] |= inside[to]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier modulo 2**64, and of its inverse."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_MUL, _INV)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.cumprod(step)
        if size > 1 << 23:  # kept for ordinary sizes only
            out = _POWERS[0][:n], _POWERS[1][:n]
            _POWERS[:] = [x[: 1 << 20].copy() for x in _POWERS]
            return out
    return _POWERS[0][:n], _POWERS[1][:n]


_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finalizer: spreads every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each pair, from one running polynomial sum."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def byte_range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(_BYTE[data], starts, ends)


#: Lower bits of a number that hold its place while window minima are sought; the upper ones are compared.
_PLACE_BITS = 24


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum, by the upper 40 bits, of values[i : i + width] for each full window."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(values) > 1 << _PLACE_BITS:
        step = (1 << _PLACE_BITS) - width
        return np.concatenate([at + window_minima(values[at : at + step + width - 1], width) for at in range(0, n, step)])
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    low = (values & ~mask) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= width:  # minima of spans of a power of two, two of which cover a window
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return (np.minimum(low[:n], low[width - span : width - span + n]) & mask).astype(np.int64)


def anchor_runs(values: np.ndarray, begin: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head, anchor, tied): windows begin[head[k]] up to the next head have anchor[k], a value that each window holds.

    begin are the windows' first places, consecutive within a document, doc their documents. A window's anchor is its
    least value, so equal windows have equal anchors. Where that value stands several times in a window (periodic text),
    a run keeps its place as long as it can; such runs are tied, as equal strings may stand in one run."""
    least = window_minima(values, width)[begin]
    head = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])][: len(least)])
    place = least[head]
    link = (doc[head[1:]] == doc[head[:-1]]) & (values[place[1:]] == values[place[:-1]])
    tied = np.r_[False, link] | np.r_[link, False] if len(head) else np.zeros(0, bool)
    if link.any():
        stop = np.r_[head[1:], len(begin)]
        first, last = np.flatnonzero(tied & np.r_[True, ~link]), np.flatnonzero(tied & np.r_[~link, True])
        heads, places = [], []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            own, at, end = place[a : b + 1], int(head[a]), int(stop[b])
            while at < end:
                start = int(begin[at])
                pick = int(own[np.searchsorted(own, start + width - 1, side="right") - 1])
                heads.append(at)
                places.append(pick)
                at += pick - start + 1
        head, place = np.concatenate([head[~tied], np.array(heads, np.int64)]), np.concatenate([place[~tied], np.array(places, np.int64)])
        tied = np.arange(len(head)) >= len(head) - len(heads)
        order = np.argsort(head)
        head, place, tied = head[order], place[order], tied[order]
    return head, values[place], tied


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the bytes of data, cut at ends (in bytes)."""
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def record(names: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names.split())


def ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, .., counts[0] - 1, 0, 1, .., counts[1] - 1, ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def covered_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs (touching ones join); starts ascending."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.r_[True, starts[1:] > reach[:-1]]
    return starts[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]]
