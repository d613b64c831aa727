"""Embedding near-duplicates: coarse lists, residual product codes, table-lookup distances, exact cosine.

Unit vectors of a cosine of at least t lie within r = sqrt(2 - 2 t) of each other. A row is in the list of its nearest
centroid; it probes each further list whose bisecting plane with its own list is within r, for a row beyond that plane
by more cannot be linked to it, so the probes suffice for every link. In a list, a row's code says where it lies but for
its stored coding error; a probe's distance to the coded place, summed from tables, refuses it where even that error
cannot bring it within r. What is left is compared by cosine in double precision. `reach` below 1 probes less far and
may lose links.

Equal vectors are one row. Around dense places (balls of half the linking angle, found on the sample) all rows are linked
to each other by the triangle inequality; their links are counted, not compared, so a large group of near copies costs
what its size is, not the square. The sample decides costs alone, never results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash, vectors

MIN_COSINE = 0.93
#: Rows of the sample that centroids, codes and balls are fitted on, and of its largest width; at most so many lists; a
#: list for each LIST_ROWS rows of the largest label. Codes: PART components a part, 256 entries each.
SAMPLE_ROWS, SAMPLE_VALUES, MAX_LISTS, LIST_ROWS, PART, ENTRIES = 4096, 1 << 21, 256, 2048, 4, 256
#: A ball holds BALL_ROWS of the sample at least. Rows of one comparison: a list's block and a chunk of its probes.
BALL_ROWS, MAX_BALLS, BLOCK_ROWS, CHUNK_ROWS, STEP = 16, 256, 2048, 4096, 256
#: Room for rounding in bounds that refuse or accept without an exact comparison.
SLACK = 1e-5


class Index:
    """Fitted on a sample of unit rows: centroids, their distances, codebooks of residuals, centres of balls."""

    def __init__(self, sample: np.ndarray, lists: int, min_cosine: float):
        self.width, self.r = sample.shape[1], float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
        self.half = float(np.arccos(np.clip(min_cosine, -1, 1))) / 2 - SLACK
        self.centroids = _means(sample, lists)
        self.apart = np.sqrt(np.maximum(vectors.squared_distances(self.centroids, self.centroids), 1e-12))
        self.parts = -(-self.width // PART)
        residual = self._padded(sample - self.centroids[vectors.squared_distances(sample, self.centroids).argmin(axis=1)])
        self.codebooks = np.stack([_means(residual[:, p * PART : (p + 1) * PART], ENTRIES) for p in range(self.parts)])
        self.balls = self._dense(sample)

    def _padded(self, rows: np.ndarray) -> np.ndarray:
        return np.pad(rows, ((0, 0), (0, self.parts * PART - self.width)))

    def _dense(self, sample: np.ndarray) -> np.ndarray:
        """Centres of balls of half the linking angle that hold many rows of the sample, the fullest first."""
        found, left = [], sample[np.linalg.norm(sample, axis=1) > 1 - SLACK]
        while self.half > 0 and len(left) >= BALL_ROWS and len(found) < MAX_BALLS:
            near = np.zeros(len(left), np.int64)
            for at in range(0, len(left), STEP):
                near[at : at + STEP] = (left[at : at + STEP] @ left.T >= np.cos(self.half)).sum(axis=1)
            if near.max() < BALL_ROWS:
                break
            center = left[near.argmax()]
            for _ in range(3):
                center = left[left @ center >= np.cos(self.half)].sum(axis=0)
                center /= np.linalg.norm(center)
            inside = left @ center >= np.cos(self.half)
            if inside.sum() < BALL_ROWS:
                break
            found.append(center)
            left = left[~inside]
        return np.array(found).reshape(-1, self.width)

    def encode(self, rows: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, probes as a matrix of booleans, codes, coding errors, ball or -1) of rows."""
        away = vectors.squared_distances(rows, self.centroids)
        own = away.argmin(axis=1)
        line = np.arange(len(rows))
        plane = (away - away[line, own][:, None]) / (2 * self.apart[own])
        probes = plane <= self.r * reach + SLACK
        probes[line, own] = True
        residual = self._padded(rows - self.centroids[own])
        codes, error = np.zeros((len(rows), self.parts), np.uint8), np.zeros(len(rows))
        for p in range(self.parts):
            found = vectors.squared_distances(residual[:, p * PART : (p + 1) * PART], self.codebooks[p])
            codes[:, p] = found.argmin(axis=1)
            error += ((residual[:, p * PART : (p + 1) * PART] - self.codebooks[p][codes[:, p]]) ** 2).sum(axis=1)
        ball = np.full(len(rows), -1)
        if len(self.balls):
            near = rows @ self.balls.T
            best = near.argmax(axis=1)
            ball = np.where((near[line, best] >= np.cos(self.half)), best, -1)
        return own, probes, codes, np.sqrt(error), ball

    def tables(self, rows: np.ndarray, of_list: int) -> np.ndarray:
        """(part, row, entry): squared distance of each row, less the list's centroid, to each entry."""
        rows = self._padded(rows - self.centroids[of_list])
        return np.stack([vectors.squared_distances(rows[:, p * PART : (p + 1) * PART], self.codebooks[p]) for p in range(self.parts)]).astype(np.float32)


def _means(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k means of rows (fewer if there are fewer), by Lloyd's rounds from evenly spaced rows."""
    out = rows[np.unique(np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int))].copy()
    for _ in range(rounds):
        own = vectors.squared_distances(rows, out).argmin(axis=1)
        n = np.bincount(own, minlength=len(out))
        sums = np.stack([np.bincount(own, rows[:, c], minlength=len(out)) for c in range(rows.shape[1])], axis=1)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that no square leaves the range of doubles."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _unit_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each row of a list column at length 1, one after another, and the rows' lengths."""
    values, offsets = vectors.rows_of(column)
    size = np.diff(offsets)
    largest = np.maximum.reduceat(np.abs(values), offsets[:-1]) if len(size) else np.zeros(0)
    values = values / np.repeat(largest, size)
    norm = np.sqrt(np.add.reduceat(values * values, offsets[:-1])) if len(size) else np.zeros(0)
    return values / np.repeat(norm, size), size


def fit(classes: DataFrame, min_cosine: float = MIN_COSINE) -> Index | None:
    """An index fitted on the SAMPLE_ROWS classes of least hash; None without rows. Its width is the sample's most
    frequent; rows of other widths are coded by their first components, whose distances never exceed the whole ones."""
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    if not largest:
        return None
    widest = classes.agg(F.max(F.size("vector"))).first()[0]
    rows = max(256, min(SAMPLE_ROWS, SAMPLE_VALUES // widest))
    sample = classes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(rows).collect()
    sizes = [len(r["vector"]) for r in sample]
    width = max(sorted(set(sizes)), key=sizes.count)
    same = np.array([r["vector"] for r in sample if len(r["vector"]) == width], np.float64)
    return Index(_units(same), int(min(MAX_LISTS, -(-largest // LIST_ROWS))), min_cosine)


def _encoded(classes: DataFrame, index: Index, reach: float) -> DataFrame:
    """(cid, label, rep, n, width, list, probes, ball, unit, code, error) of each class; unit: doubles in bytes."""
    keep = ["cid", "label", "rep", "n"]
    added = "width int, list int, ball int, probes array<int>, unit binary, code binary, error double"
    kind = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in classes.select(*keep).schema), added])
    names = [*keep, *(x.split()[0] for x in added.split(", "))]
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, size = _unit_arrays(common.column(batch, "vector"))
            column = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(unit))
            own, probes, codes, error, ball = index.encode(vectors.fitted(column, index.width), reach)
            ball[size != index.width] = -1
            probes &= np.arange(probes.shape[1])[None, :] >= own[:, None]  # two lists meet once, from the lower one
            row, at = np.nonzero(probes)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32)), pa.array(at.astype(np.int32)))
            units = common.binaries(unit.view(np.uint8), np.cumsum(size) * 8)
            coded = common.binaries(codes.reshape(-1), np.cumsum(np.full(len(size), index.parts)))
            values = [pa.array(size.astype(np.int32)), pa.array(own.astype(np.int32)), pa.array(ball.astype(np.int32)), lists, units, coded, pa.array(error)]
            yield pa.RecordBatch.from_arrays([*(common.column(batch, c) for c in keep), *values], names=names)

    return classes.select(*keep, "vector").mapInArrow(common.tidy(run), kind)


PLACE = ["label", "width", "list"]


def _tiles(rows: DataFrame) -> DataFrame:
    """Rows dealt to comparisons: each to those of its own block (base), and to all blocks of the lists it probes."""
    probing = rows.select("cid", "label", "width", F.col("list").alias("home"), F.col("ball").alias("own_ball"), F.explode("probes").alias("list"), "unit", "n")
    blocks = rows.groupBy(*PLACE, "ball").agg(F.count("*").alias("rows")).groupBy(*PLACE).agg(F.sum("rows").alias("rows"), F.collect_list(F.struct("ball", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("n"))).alias("blocks"))
    chunks = probing.groupBy(*PLACE).agg(F.count("*").alias("probes"))  # a list has MAX_BALLS + 1 balls at most
    places = common.written(blocks.join(chunks, PLACE).select(*PLACE, "rows", "probes", "blocks", F.ceil(F.col("probes") / CHUNK_ROWS).cast("int").alias("chunks")), "places")
    base = common.join_hot(rows.select("cid", *PLACE, "ball", "unit", "n", "code", "error"), places.select(*PLACE, "blocks", "chunks"), PLACE, places.select(*PLACE, F.col("rows").alias("weight")), "weight")
    number = F.element_at(F.filter("blocks", lambda b: b.ball == F.col("ball")), 1).n
    base = base.select(*PLACE, "ball", F.pmod(F.xxhash64("cid"), number).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("base"), F.lit(False).alias("own"), "cid", "n", "unit", "code", "error")
    probe = common.join_hot(probing, places.select(*PLACE, "blocks", "chunks"), PLACE, places.select(*PLACE, F.col("probes").alias("weight")), "weight")
    others = F.filter("blocks", lambda b: (b.ball == -1) | (b.ball != F.col("own_ball")))
    probe = probe.select("*", F.explode(others).alias("to")).select("*", F.explode(F.sequence(F.lit(0), F.col("to.n") - 1)).alias("block"))
    chunk = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("chunks")).cast("int").alias("chunk")
    probe = probe.select(*PLACE, F.col("to.ball").alias("ball"), "block", chunk, F.lit(False).alias("base"), (F.col("home") == F.col("list")).alias("own"), "cid", "n", "unit", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error"))
    return base.unionByName(probe)


def _compare(index: Index, of_list: int, base: np.ndarray, codes: np.ndarray, error: np.ndarray, base_id: np.ndarray, probe: np.ndarray, probe_id: np.ndarray, own: np.ndarray, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (i of probe, j of base). own: whether a probe's own list is this one, where each pair is met from both sides."""
    fit = lambda x: x[:, : index.width] if x.shape[1] >= index.width else np.pad(x, ((0, 0), (0, index.width - x.shape[1])))
    limit = (index.r + error + SLACK) ** 2 * (1 + SLACK) + SLACK
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(probe), STEP):
        some = probe[at : at + STEP]
        tables = index.tables(fit(some), of_list)
        away = np.zeros((len(some), len(base)), np.float32)
        for p in range(index.parts):
            away += np.take(tables[p], codes[:, p], axis=1)
        near = away <= limit[None, :]
        near &= ~own[at : at + STEP, None] | (probe_id[at : at + STEP, None] < base_id[None, :])
        i, j = np.nonzero(near)
        if len(i) > near.size >> 4:  # dense: a product of matrices is cheaper than pairs
            rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            linked = near[np.ix_(rows, cols)] & (some[rows] @ base[cols].T >= min_cosine)
            i, j = np.nonzero(linked)
            i, j = rows[i], cols[j]
        elif len(i):
            linked = np.concatenate([(some[i[k : k + 4096]] * base[j[k : k + 4096]]).sum(axis=1) >= min_cosine for k in range(0, len(i), 4096)])
            i, j = i[linked], j[linked]
        found.append((i + at, j))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _found(rows: DataFrame, index: Index, min_cosine: float) -> DataFrame:
    """(cid, links, root): for each comparison, its classes with links there, their number (copies counted) and the
    smallest class that they are connected with inside it."""
    shared = rows.sparkSession.sparkContext.broadcast(index)
    schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        index, width, of_list = shared.value, key[1].as_py(), key[2].as_py()
        is_base = table["base"].to_numpy()
        base, probe = table.filter(pa.array(is_base)), table.filter(pa.array(~is_base))
        if not (base.num_rows and probe.num_rows):
            return schema.empty_table()
        matrix = lambda t: np.frombuffer(b"".join(t["unit"].to_pylist())).reshape(-1, width)
        base_id, probe_id, base_n, probe_n = (t[c].to_numpy() for c in ("cid", "n") for t in (base, probe))
        codes = np.frombuffer(b"".join(base["code"].to_pylist()), np.uint8).reshape(-1, index.parts)
        i, j = _compare(index, of_list, matrix(base), codes, base["error"].to_numpy(), base_id, matrix(probe), probe_id, probe["own"].to_numpy(), min_cosine)
        ids, place = np.unique(np.concatenate([probe_id[i], base_id[j]]), return_inverse=True)
        a, b = place[: len(i)], place[len(i) :]
        links = np.bincount(a, base_n[j], minlength=len(ids)) + np.bincount(b, probe_n[i], minlength=len(ids))
        return pa.table([ids, links.astype(np.int64), ids[simhash.roots(a, b, len(ids))]], schema=schema)

    return _tiles(rows).groupBy("label", "width", "list", "ball", "block", "chunk").applyInArrow(run, "cid long, links long, root long")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", min_cosine: float = MIN_COSINE, reach: float = 1.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: other rows of the same label whose vector has a cosine of at
    least min_cosine (over 0), and the smallest id reachable by such links, its own included.

    A row links with nothing if its label or vector is null, if the vector is empty or all zero, or if it holds null or
    non-finite components; vectors of different lengths do not link. Equal vectors of a label are linked. Repeated ids
    are rows like others; a null id names a component only if it has no other. kept: the id is the component's. Links
    are whole at reach 1, whatever the data; below it, rows that lie beyond a plane by over reach * r are not compared.
    Empty table: empty result. Other columns do not matter."""
    if not 0 < min_cosine <= 1:
        raise ValueError("min_cosine must be over 0 and at most 1")
    spark = rows.sparkSession
    given = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    linkable = F.col("label").isNotNull() & vectors.finite(F.col("vector")) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    with common.passing(spark) as keep:
        classes = given.filter(linkable).groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
        classes = common.written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # written, so that numbers stay
        index = fit(classes, min_cosine)
        if index is None:
            return given.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
        coded = common.written(_encoded(classes, index, reach), "coded")
        found = common.written(_found(coded, index, min_cosine), "found")
        inside = coded.filter("ball >= 0")
        balls = common.written(inside.groupBy("label", "ball").agg(F.sum("n").alias("all"), F.min("cid").alias("root"), F.count("*").alias("rows")), "balls")
        inside = common.join_hot(inside.select("cid", "n", "label", "ball"), balls.drop("rows"), ["label", "ball"], balls.select("label", "ball", F.col("rows").alias("weight")), "weight")
        linked = found.unionByName(inside.select("cid", (F.col("all") - F.col("n")).alias("links"), "root"))
        links = linked.groupBy("cid").agg(F.sum("links").alias("links"))
        roots = common.written(simhash.components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b"))), "vector_roots")
        joined = classes.join(links, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
        joined = common.written(joined.select("label", "vector", "rep", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root")), "vector_links")
        names = common.written(joined.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("rows")), "names")
        named = keep(common.written(common.join_hot(joined, names.drop("rows"), ["root"], names.select("root", F.col("rows").alias("weight")), "weight"), "named"))
    met = common.join_hot(given.filter(linkable), named.select("label", "vector", "n", "links", "component_id"), ["label", "vector"], named.select("label", "vector", F.col("n").alias("weight")), "weight")
    met = met.select("id", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    alone = given.filter(~linkable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = met.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
