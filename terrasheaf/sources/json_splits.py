"""Large FeatureCollection files in byte ranges, many tasks a file.

A range cannot know by itself whether it begins inside a string, or how deep. Three passes, each a task a range:
1. under both assumptions (inside a string or not), how many quotes there are and by how much the depth changes; running
   sums over a file's ranges then give the true state at every range's beginning;
2. where the root's `features` array opens and closes, and how many of its commas lie in the range; running sums number them;
3. the elements that begin in the range, read on beyond its end to where the last one ends, with ids by position.
What is summed has one row a range. The text outside the array (name, crs, other members) is read as one small document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import RANGED, listed, open_file, scratch

#: Bytes of a range, and of what a task looks at in one step.
SPLIT_BYTES, STEP_BYTES = 32 << 20, 4 << 20
#: So many ranges have a task each; of more, small ones share tasks of SPLIT_BYTES.
RANGE_TASKS = 200
_QUOTE, _BACKSLASH, _COMMA = b'"\\,'
_DEPTH = np.zeros(256, np.int8)
_DEPTH[list(b"{[")] = 1
_DEPTH[list(b"}]")] = -1


class Scanner:
    """Structure of a JSON text that is handed over piece by piece: which bytes stand outside strings, and how deep."""

    def __init__(self, inside: bool, escaped: bool, depth: int):
        self.inside, self.escaped, self.depth = inside, escaped, depth

    def feed(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(change, after): for each byte, the change of depth it makes (0 in strings) and the depth after it. A comma
        counts only where `outside` has it; see commas()."""
        quotes = data == _QUOTE
        slashes = data == _BACKSLASH
        if self.escaped or slashes.any():
            place = np.arange(len(data))
            last = np.maximum.accumulate(np.where(slashes, -1, place))  # the last byte that is no backslash, up to here
            run = place - np.r_[-1, last[:-1]] - 1  # backslashes right before
            run[run == place] += self.escaped
            quotes &= run % 2 == 0
            tail = len(data) - 1 - (last[-1] if len(data) else 0)
            self.escaped = bool((tail + (self.escaped if tail == len(data) else 0)) % 2) if len(data) else self.escaped
        parity = (np.cumsum(quotes) + self.inside) % 2 == 1
        self.outside = ~parity
        self.inside = bool(parity[-1]) if len(data) else self.inside
        change = np.where(self.outside, _DEPTH[data], 0)
        after = self.depth + np.cumsum(change)
        self.depth = int(after[-1]) if len(data) else self.depth
        return change, after

    def commas(self, data: np.ndarray) -> np.ndarray:
        return (data == _COMMA) & self.outside


def _escaped(file: pa.NativeFile, at: int) -> bool:
    """Whether an odd number of backslashes stands right before a place."""
    n, step = 0, 64
    while at - n > 0:
        piece = file.read_at(min(step, at - n), max(0, at - n - step))
        own = len(piece) - len(piece.rstrip(b"\\"))
        n += own
        if own < len(piece):
            break
        step *= 4
    return n % 2 == 1


def _pieces(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(start, end, STEP_BYTES):
        yield at, np.frombuffer(file.read_at(min(STEP_BYTES, end - at), at), np.uint8)


def _key_before(file: pa.NativeFile, at: int) -> bytes:
    """The member name whose value begins at a place, as written; empty if there is none."""
    back = 256
    while True:
        text = file.read_at(min(back, at), max(0, at - back)).rstrip(b" \t\r\n")
        name = text[:-1].rstrip(b" \t\r\n") if text.endswith(b":") else b""
        if text and not name and back < at and text.endswith(b":"):
            back *= 4
            continue
        if not name.endswith(b'"'):
            if not text and back < at:
                back *= 4
                continue
            return b""
        stop = len(name) - 1
        begin = name.rfind(b'"', 0, stop)
        while begin > 0 and (len(name[:begin]) - len(name[:begin].rstrip(b"\\"))) % 2:
            begin = name.rfind(b'"', 0, begin)
        if begin > 0 or (begin == 0 and back >= at):  # at the very start of what was read, a backslash may stand before it
            return name[begin + 1 : stop]
        if back >= at:
            return b""
        back *= 4


def _mapped(df: DataFrame, schema: str, rows) -> DataFrame:  # noqa: ANN001
    """rows(row as a dict, open file) -> lists of columns, for each row of df (path, ...), in tasks."""
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    names = [x.split()[0] for x in schema.split(", ")]
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as file:
                    for cols in rows(row, file):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def _first_pass(row: dict, file: pa.NativeFile) -> Iterator[list]:
    ways = [Scanner(inside, _escaped(file, row["start"]), 0) for inside in (False, True)]
    for _, data in _pieces(file, row["start"], row["end"]):
        for way in ways:
            way.feed(data)
    yield [[row["path"]], [row["start"]], [row["end"]], [int(ways[0].inside)], [ways[0].depth], [ways[1].depth]]


def _second_pass(row: dict, file: pa.NativeFile) -> Iterator[list]:
    """Events: places where a root array named features opens or any root array closes, with the commas of depth 2 before."""
    scan, seen = Scanner(row["inside"], _escaped(file, row["start"]), row["depth"]), 0
    opens, closes, open_commas, close_commas = [], [], [], []
    for at, data in _pieces(file, row["start"], row["end"]):
        change, after = scan.feed(data)
        commas = np.flatnonzero(scan.commas(data) & (after == 2))
        for k in np.flatnonzero((data == ord("[")) & (change == 1) & (after == 2)).tolist():
            if _key_before(file, at + k) == b"features":
                opens.append(at + k)
                open_commas.append(seen + int(np.searchsorted(commas, k)))
        for k in np.flatnonzero((data == ord("]")) & (change == -1) & (after == 1)).tolist():
            closes.append(at + k)
            close_commas.append(seen + int(np.searchsorted(commas, k)))
        seen += len(commas)
    yield [[row["path"]], [row["start"]], [row["end"]], [row["inside"]], [row["depth"]], [opens], [open_commas], [closes], [close_commas], [seen]]


def _third_pass(row: dict, file: pa.NativeFile) -> Iterator[list]:
    """(path, id, element) of the elements that begin in the range."""
    scan, number, stop = Scanner(row["inside"], _escaped(file, row["start"]), row["depth"]), row["before"], row["closes"]
    held: list[bytes] | None = None
    for at, data in _pieces(file, row["start"], stop + 1):
        change, after = scan.feed(data)
        place = np.arange(at, at + len(data))
        cuts = np.flatnonzero(((scan.commas(data) & (after == 2)) & (place > row["opens"]) & (place < stop)) | (place == row["opens"]) | (place == stop))
        raw, begin, found, over = data.tobytes(), 0, [], False
        for k in cuts.tolist():
            if held is not None:
                text = b"".join([*held, raw[begin:k]])
                if at + k != stop or number > 0 or text.strip():  # an empty array has no element
                    found.append(text.decode())
                held = None
            if at + k >= row["end"] or at + k == stop:
                over = True
                break
            held, begin = [], k + 1
        if held is not None:
            held.append(raw[begin:])
        if found:
            yield [[row["path"]] * len(found), list(range(number, number + len(found))), found]
            number += len(found)
        if over or (held is None and at + len(data) >= row["end"]):
            return


def _root(row: dict, file: pa.NativeFile) -> Iterator[list]:
    """The document without its features."""
    begin, end = row["opens"], row["closes"]
    if begin is None or end is None:
        text = file.read_at(min(file.size(), STEP_BYTES), 0)
    else:
        text = file.read_at(begin + 1, 0) + file.read_at(file.size() - end, end)
    yield [[row["path"]], [text.decode("utf-8-sig", "replace")]]


def splittable(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether tasks can read the files by range."""
    first = listed(spark, path).select("path").first()
    return first is not None and first["path"].partition(":")[0] in RANGED


def feature_texts(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """((path, id, element), (path, root, complete)): each element of the `features` array of each file as JSON text, id
    its position; and the document around it, with whether such an array was found. A file without one has no elements.

    The text is UTF-8. Two members of that name: the last one counts. Nothing is checked beyond the structure."""
    files = listed(spark, path).filter("length > 0").select("path", "length")
    count, total = files.agg(F.sum(F.ceil(F.col("length") / split_bytes)), F.sum("length")).first()
    n = max(1, min(10_000, count or 1, max(RANGE_TASKS, -(-(total or 0) // SPLIT_BYTES))))
    starts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = starts.select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("end")).repartition(n)
    first = _mapped(ranges, "path string, start long, end long, flips long, plain long, quoted long", _first_pass)
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    inside = first.withColumn("inside", F.coalesce(F.sum("flips").over(earlier), F.lit(0)) % 2 == 1)
    change = F.when(F.col("inside"), F.col("quoted")).otherwise(F.col("plain"))
    states = inside.select("path", "start", "end", "inside", F.coalesce(F.sum(change).over(earlier), F.lit(0)).alias("depth")).repartition(n)
    second = _mapped(states, "path string, start long, end long, inside boolean, depth long, opens array<long>, open_commas array<long>, closes array<long>, close_commas array<long>, commas long", _second_pass)
    whole = Window.partitionBy("path")
    opened = second.withColumn("own", F.array_max("opens")).withColumn("first", F.max("own").over(whole))
    shut = opened.withColumn("last", F.min(F.array_min(F.filter("closes", lambda k: k > F.col("first")))).over(whole))
    before = lambda place, places, commas: F.when(F.col(place) < F.col("start"), 0).when(F.col(place) >= F.col("end"), F.col("commas")).otherwise(F.element_at(F.col(commas), F.array_position(places, F.col(place)).cast("int")))
    holds = (F.col("first") >= F.col("start")) & (F.col("first") < F.col("end"))
    cuts = before("last", "closes", "close_commas") - before("first", "opens", "open_commas") + holds.cast("long")
    counted = shut.withColumn("cuts", F.when(F.col("last").isNotNull(), cuts).otherwise(0))
    numbered = counted.select("path", "start", "end", "inside", "depth", F.col("first").alias("opens"), F.col("last").alias("closes"), "cuts", F.coalesce(F.sum("cuts").over(earlier), F.lit(0)).alias("before"))
    kept = scratch(spark, "ranges")
    numbered.write.parquet(kept)  # the first two passes are made once, for features and for roots
    numbered = spark.read.parquet(kept)
    elements = _mapped(numbered.filter("cuts > 0").drop("cuts").repartition(n), "path string, id long, element string", _third_pass)
    spans = numbered.groupBy("path").agg(F.max("opens").alias("opens"), F.max("closes").alias("closes"))
    roots = _mapped(spans, "path string, root string", _root).join(spans.select("path", F.col("closes").isNotNull().alias("complete")), "path")
    return elements, roots
