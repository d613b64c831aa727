"""Vector code compression: Lloyd rounds over partition-local cover trees.

Vectors become whole numbers and are cut into parts. Each task gathers shards of rows and builds one cover tree a part and
shard: a node's points lie within its radius of its own point, its children are points over a fraction of that radius
apart, and a subtree's points stand side by side, so running sums give the sum and number of any subtree at once. The
trees are written once. A round sends the codebook to the trees: a subtree whose point is nearer to one entry than to
every other by more than twice its radius belongs to that entry whole; only other nodes descend, to exact comparisons at
last. The driver sees the 256 first rows and, each round, one row for each entry of the codebook.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of one shard; a subtree of up to BUCKET points is not divided further; radii shrink by SHRINK from level to level.
SHARD_ROWS, BUCKET, SHRINK = 4096, 16, 1.3
#: Components from this size on have no place in the fixed-point range: their squared distances could leave 64 bits.
LARGEST = float(1 << 15)


class CoverTree:
    """points (n, w) of whole numbers; order: the points, subtree by subtree.

    Node i stands for order[first[i]:last[i]], its own point being center[i] (a row of points) and radius[i] the largest
    distance to it; its children are the nodes kids[i] to kids[i] + n_kids[i]. Nodes without children are leaves."""

    def __init__(self, order: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.order, self.nodes, self.radius = order, nodes, radius
        self.center, self.first, self.last, self.kids, self.n_kids = nodes.T

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        points = points.astype(np.float64)
        order = np.arange(len(points))
        nodes, radius = [], []

        def far(center: int, members: np.ndarray) -> np.ndarray:
            return np.sqrt(((points[members] - points[center]) ** 2).sum(axis=1))

        def add(center: int, first: int, last: int, away: np.ndarray) -> None:
            nodes.append([center, first, last, 0, 0])
            radius.append(float(away.max(initial=0)))

        if len(points):
            add(0, 0, len(points), far(0, order))
        at = 0
        while at < len(nodes):  # level by level; the children of a node are appended together
            center, first, last, _, _ = nodes[at]
            if last - first > BUCKET and radius[at] > 0:
                members, apart = order[first:last].copy(), radius[at] / SHRINK
                near, owner, centers = far(center, members), np.zeros(last - first, np.int64), [center]
                while (far_off := int(near.argmax())) >= 0 and near[far_off] > apart:
                    away = far(int(members[far_off]), members)
                    owner[away < near] = len(centers)
                    near = np.minimum(near, away)
                    centers.append(int(members[far_off]))
                place = np.argsort(owner, kind="stable")
                order[first:last], near, ends = members[place], near[place], np.cumsum(np.bincount(owner, minlength=len(centers)))
                nodes[at][3:] = len(nodes), len(centers)
                for k, c in enumerate(centers):
                    begin = int(ends[k - 1]) if k else 0
                    add(c, first + begin, first + int(ends[k]), near[begin : int(ends[k])])
            at += 1
        return cls(order, np.array(nodes, np.int64).reshape(-1, 5), np.array(radius))

    def assign(self, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, entry): runs of `order` whose points are nearest to one entry, ties to the lower one."""
        if max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)) < 1 << 20:  # products stay exact in double precision
            points, entries = points.astype(np.float64), entries.astype(np.float64)
        out = [np.zeros((0, 3), np.int64)]
        front = np.arange(min(1, len(self.radius)))
        while len(front):
            found = vectors.squared_distances(points[self.center[front]], entries)
            best = found.argmin(axis=1)  # the lowest of equal entries
            found = found.astype(np.float64)
            low = found[np.arange(len(front)), best]
            found[np.arange(len(front)), best] = np.inf
            room = np.sqrt(found.min(axis=1)) - np.sqrt(np.maximum(low, 0))
            radius = self.radius[front]
            whole = (radius == 0) | (room > 2 * radius * (1 + 1e-9) + 1e-6)  # roots are rounded; exact ones decide below
            done = front[whole]
            out.append(np.stack([self.first[done], self.last[done], best[whole]], axis=1))
            front = front[~whole]
            leaf = self.n_kids[front] == 0
            ambiguous, front = front[leaf], front[~leaf]
            if len(ambiguous):
                place = np.repeat(self.first[ambiguous], self.last[ambiguous] - self.first[ambiguous]) + common.ragged(self.last[ambiguous] - self.first[ambiguous])
                nearest = vectors.squared_distances(points[self.order[place]], entries).argmin(axis=1)
                out.append(np.stack([place, place + 1, nearest], axis=1))
            front = np.repeat(self.kids[front], self.n_kids[front]) + common.ragged(self.n_kids[front])
        first, last, entry = np.concatenate(out).T
        return first, last, entry


def _trees(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """One row a shard: its ids, labels and points, and one tree a part as arrays in bytes."""
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = f"ids array<{kinds['id'].simpleString()}>, labels array<string>, points binary, trees array<struct<order: binary, nodes: binary, radius: binary>>"

    def shard(ids: list[pa.Array], labels: list[pa.Array], points: np.ndarray) -> pa.RecordBatch:
        size = width // parts
        built = [CoverTree.build(points[:, p * size : (p + 1) * size]) for p in range(parts)]
        trees = [{"order": t.order.astype(np.int32).tobytes(), "nodes": t.nodes.astype(np.int32).tobytes(), "radius": t.radius.tobytes()} for t in built]
        ids, labels = pa.concat_arrays(ids), pa.concat_arrays(labels)
        held = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, labels)]
        kind = pa.list_(pa.struct([("order", pa.binary()), ("nodes", pa.binary()), ("radius", pa.binary())]))
        return pa.RecordBatch.from_arrays([*held, pa.array([points.astype(np.int32).tobytes()]), pa.array([trees], kind)], names=["ids", "labels", "points", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, points, n = [], [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                cut = batch.slice(at, min(SHARD_ROWS - n, batch.num_rows - at))
                at += cut.num_rows
                n += cut.num_rows
                ids.append(common.column(cut, "id"))
                labels.append(common.column(cut, "label"))
                points.append(np.floor(SCALE * vectors.fitted(common.column(cut, "vector"), width)).astype(np.int64))
                if n == SHARD_ROWS:
                    yield shard(ids, labels, np.concatenate(points))
                    ids, labels, points, n = [], [], [], 0
        if n:
            yield shard(ids, labels, np.concatenate(points))

    return rows.select("id", "label", "vector").mapInArrow(common.tidy(run), schema)


def _loaded(batch: pa.RecordBatch, width: int, parts: int) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, CoverTree]]]]:
    """(row, points, [(points of the part, its tree)]) of each shard."""
    size = width // parts
    for k in range(batch.num_rows):
        n = len(common.column(batch, "ids")[k])
        points = np.frombuffer(common.column(batch, "points")[k].as_py(), np.int32).reshape(n, width).astype(np.int64)
        trees = []
        for p, t in enumerate(common.column(batch, "trees")[k].as_py()):
            tree = CoverTree(np.frombuffer(t["order"], np.int32).astype(np.int64), np.frombuffer(t["nodes"], np.int32).reshape(-1, 5).astype(np.int64), np.frombuffer(t["radius"]))
            trees.append((points[:, p * size : (p + 1) * size], tree))
        yield k, points, trees


def _round(trees: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, place) after one round of assignment and means rounded down."""
    parts, _, size = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64)
        for batch in batches:
            for _, _, held in _loaded(batch, parts * size, parts):
                for p, (points, tree) in enumerate(held):
                    first, last, entry = tree.assign(points, codebooks[p])
                    running = np.concatenate([np.zeros((1, size), np.int64), np.cumsum(points[tree.order], axis=0)])
                    np.add.at(sums[p], entry, running[last] - running[first])
                    np.add.at(counts[p], entry, last - first)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    found = trees.mapInArrow(common.tidy(run), "part long, entry long, n long, sums array<long>")
    total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(size)))
    out = codebooks.copy()
    for row in total.collect():  # parts x entries rows, whatever the input
        out[row["part"], row["entry"]] = [row[f"s{k}"] // row["n"] for k in range(size)]
    return out


def _codes(trees: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(id, label, code, error) of every row."""
    parts, _, size = codebooks.shape
    kinds = {f.name: f.dataType for f in trees.schema}
    id_kind = kinds["ids"].elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, _, held in _loaded(batch, parts * size, parts):
                ids, labels = (common.column(batch, c)[k].values for c in ("ids", "labels"))
                codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, (points, tree) in enumerate(held):
                    first, last, entry = tree.assign(points, codebooks[p])
                    place = np.repeat(first, last - first) + common.ragged(last - first)
                    row, each = tree.order[place], np.repeat(entry, last - first)
                    codes[row, p] = each
                    error[row] += ((points[row] - codebooks[p][each]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return trees.mapInArrow(common.tidy(run), f"id {id_kind.simpleString()}, label string, code string, error long")


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, code, error, label_error) of each row kept, codebooks as an array by part, entry and place).

    Component x counts as floor(1024 x). A part's codebook starts as that part of the rows of smallest id (fewer rows:
    fewer entries; rows of equal id by their vector, rows without an id last). entries is 256 at most: a code is a byte.
    Dropped: null vectors and those with null or non-finite components. Kept, with null code and error, and of no
    weight in the codebooks: vectors of another length than the first row's, of a length that `parts` does not divide,
    or with components of 32,768 and more, whose squared distances may leave 64 bits. label_error sums the errors of
    equal labels, nulls together; it is null where no row of a label has a code. Repeated ids: each row by itself.
    Empty table: empty result and empty codebooks. Other columns do not matter."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    spark = rows.sparkSession
    given = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector")).filter(vectors.finite(F.col("vector")))
    fits = F.forall("vector", lambda x: F.abs(x) < LARGEST) & (F.size("vector") % parts == 0)
    start = given.filter(fits).orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    width = len(start[0]["vector"]) if start else 0
    same = [r["vector"] for r in start if len(r["vector"]) == width]
    first = np.floor(SCALE * np.array(same, np.float64)).astype(np.int64).reshape(len(same), parts, width // parts)
    codebooks = first.transpose(1, 0, 2).copy()
    usable = fits & (F.size("vector") == width)
    with common.passing(spark) as keep:
        if len(first):
            trees = common.written(_trees(given.filter(usable), width, parts), "trees")
            for _ in range(rounds):
                codebooks = _round(trees, codebooks)
            coded = _codes(trees, codebooks)
        else:
            coded = given.limit(0).select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        without = given.filter(~usable).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        out = keep(common.written(coded.unionByName(without).select("*", F.col("label").isNull().alias("no_label"), F.coalesce("label", F.lit("")).alias("key")), "codes"))
    sums = common.written(out.groupBy("no_label", "key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "sums")
    joined = common.join_hot(out, sums.drop("n"), ["no_label", "key"], sums.select("no_label", "key", "n"))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error"), codebooks
