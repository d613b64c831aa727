"""SimHash near-duplicates: fingerprints, links by pivot distance tables, components.

Two fingerprints within 2 bits agree in at least 6 of their 8 bytes, so both stand in one of 28 blocks (a block: equal
masked fingerprints, 16 bits free, hence at most 65,536 members whatever the input). A table of Hamming distances to
reference fingerprints (pivots) discards pairs of a block whose coordinates differ by more than 2 anywhere, which the
triangle inequality allows; survivors are compared bit by bit. Pivots alone cannot index random 64-bit codes: their
distances crowd around 32, so without blocks the pairs to discard would grow with the square of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_BITS = 2
N_PIVOTS = 16
PIVOTS = np.random.default_rng(11).integers(0, 1 << 63, N_PIVOTS, dtype=np.uint64) * np.uint64(2) + (np.arange(N_PIVOTS, dtype=np.uint64) & np.uint64(1))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(common.SPACES)] = True


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle (lower case A-Z, words joined by one space) and each document's number of shingles.

    Fewer words than width: one shingle of all words; none: no shingle."""
    from xxhash import xxh64_intdigest

    starts, ends, first = common.word_bounds(data, offsets)
    n_words = np.diff(first)
    if not len(starts):
        return np.zeros(0, np.uint64), n_words
    space = _SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first white space after a word
    flat = np.where(space, np.uint8(32), _LOWER[data])[keep].tobytes()
    place = np.cumsum(keep) - 1
    starts, ends = place[starts], place[ends - 1] + 1
    counts = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    head = np.repeat(first[:-1], counts) + common.ragged(counts)
    tail = head + np.minimum(width, np.repeat(n_words, counts)) - 1
    hashes = np.fromiter((xxh64_intdigest(flat[a:b], seed) for a, b in zip(starts[head].tolist(), ends[tail].tolist(), strict=True)), np.uint64, len(head))
    return hashes, counts


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts[i] hashes, the bits set in over half of them (no hashes: 0).

    Eight byte-wise counters are added at once; chunks of 255 keep each from running over."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    chunks = -(-n // 255)
    begin = np.repeat(np.cumsum(n) - n, chunks) + 255 * common.ragged(chunks)
    first = np.cumsum(chunks) - chunks
    for shift in range(8):
        lanes = (hashes >> np.uint64(shift)) & np.uint64(0x0101010101010101)
        sums = np.add.reduceat(lanes, begin).astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(sums, first, axis=0)
        for byte in range(8):
            out[some] |= (2 * total[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def fingerprints(docs: DataFrame, width: int = 3, text_col: str = "text", result_col: str = "fp") -> DataFrame:
    """docs without its text and with a 64-bit SimHash (long). Null text: as empty, fingerprint 0."""
    keep = [c for c in docs.columns if c != text_col]
    kind = docs.select(*keep).schema.add(result_col, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text_col):
            fp = majority_bits(*shingle_hashes(*common.buffers(common.column(batch, text_col)), width))
            yield pa.RecordBatch.from_arrays([*(common.column(batch, c) for c in keep), pa.array(fp.view(np.int64))], names=[*keep, result_col])

    return docs.select(*keep, text_col).mapInArrow(common.tidy(run), kind)


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each node's component, for nodes 0..n-1 and links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (jump := new[new]).tolist() != new.tolist():
            new = jump
        if (new == label).all():
            return label
        label = new


def _block_links(block: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) inside runs of equal block numbers, found through the pivot table."""
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    order = np.lexsort((table[:, 0], block))
    block, fp, table = block[order], fp[order], table[order]
    found_a, found_b = [], []
    live, offset = np.arange(len(fp)), 1
    while len(live):
        live = live[live + offset < len(fp)]
        other = live + offset
        # sorted by the first coordinate: once it is too far, all that follow are
        near = (block[other] == block[live]) & (table[other, 0] - table[live, 0] <= max_bits)
        live, other = live[near], other[near]
        pair = np.abs(table[other] - table[live]).max(axis=1, initial=0) <= max_bits
        a, b = live[pair], other[pair]
        same = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
        found_a.append(order[a[same]])
        found_b.append(order[b[same]])
        offset += 1
    return np.concatenate([np.zeros(0, np.int64), *found_a]), np.concatenate([np.zeros(0, np.int64), *found_b])


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints `fp` as all links within max_bits (0 to 2) bits do.

    Each block's links are thinned to a star per component, so rows stay in proportion to the fingerprints."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2: the blocks are complete for these")
    masks = [sum(0xFF << (8 * k) for k in range(8) if k not in out) for out in combinations(range(8), 2)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    blocks = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed))).alias("part", "masked"))
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(n, "part", "masked").sortWithinPartitions("part", "masked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve(part: np.ndarray, masked: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            new = np.r_[True, (part[1:] != part[:-1]) | (masked[1:] != masked[:-1])][: len(part)]
            block = np.cumsum(new) - 1
            many = np.bincount(block)[block] > 1 if len(block) else np.zeros(0, bool)
            block, fp = block[many], fp[many]
            a, b = _block_links(block, fp.view(np.uint64), max_bits)
            root = roots(a, b, len(fp)) if len(a) else np.arange(len(fp))
            moved = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part, masked, fp = (np.concatenate([*(h[k : k + 1] for h in held), common.column(batch, c).to_numpy()[None]], axis=1)[0] if held else common.column(batch, c).to_numpy() for k, c in enumerate(("part", "masked", "fp")))
            last = (part == part[-1]) & (masked == masked[-1])
            done = int(np.argmax(last))
            held = [np.stack([part[done:].astype(np.int64), masked[done:], fp[done:]])]
            if done:
                yield solve(part[:done], masked[:done], fp[:done])
        if held:
            yield solve(*held[0])

    return dealt.mapInArrow(common.tidy(run), "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a long, b long): root is the component's smallest node.

    Alternating large-star and small-star joins; each round is written to the shared folder, so a lost executor costs
    one round. Rounds grow with the logarithm of the longest chain."""
    with common.passing(edges.sparkSession) as keep:
        current = keep(_stars(edges, max_rounds))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(u, v): every other node of a component with its smallest."""
    current = common.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        outward = both.filter("v > u")  # a hub has a row for each of its nodes: these stay where they are
        large = common.join_hot(outward, low, ["u"], outward.groupBy("u").agg(F.count("*").alias("n"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = common.written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        new = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state:
            return current
        state = new
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = MAX_BITS, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, fingerprint hex, component_id: smallest doc_id of the component) for each row of docs.

    Null or wordless text: fingerprint 0, linked like any other. Null doc_id: kept, never a component's name unless
    the component has no other. Repeated doc_id: each row has its own fingerprint. Empty table: empty result."""
    ids = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = common.written(fingerprints(ids, width), "prints")
    each = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "fps")
    joined = each.join(components(links(each.select("fp"), max_bits)), F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = joined.join(joined.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    return common.join_hot(prints, named, ["fp"], each.select("fp", "n"), "n").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, found: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """docs without those that are not their component's smallest doc_id; columns unchanged, null ids stay. Rows of a
    repeated id stay or go together: all go if one of them has a smaller partner."""
    gone = common.free_name(docs, "_gone")
    return docs.join(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), docs[doc_col] == F.col(gone), "left_anti")


#: For similar texts: one document in SAMPLE is counted for the shingles that stand last in the common order, which are
#: those in COMMON_COUNT sampled documents at least (COMMON_ROWS at most). Blocks are first thinned by STAR_ROUNDS
#: rounds of one leader each; what these leave open is compared whole, in tiles of TILE_ROWS. None of them cuts results.
SAMPLE, COMMON_COUNT, COMMON_ROWS = 16, 4, 1 << 18
STAR_ROUNDS, TILE_ROWS = 2, 1024
#: So many pairs are broadcast, so that texts need not be dealt out by id.
BROADCAST_PAIRS = 400_000
#: Longs of a set's short parity code: bit b tells whether an odd number of its hashes end in b. Two codes differ in no
#: more bits than members stand in one set alone. The short code is part of the join of candidates; a long one, of at
#: least two bits a member, refuses most of the pairs of larger sets before any text travels.
PARITY = ("b0", "b1", "b2", "b3")


def _distinct(hashes: np.ndarray, counts: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles, by rank and hash, and their number."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner)) if rank is None else np.lexsort((hashes, rank, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.r_[True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])][: len(hashes)]
    return hashes[first], np.bincount(owner[first], minlength=len(counts))


def _common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Hashes of shingles that many documents of a sample hold, rarest first. They set the order alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(_distinct(*shingle_hashes(*common.buffers(common.column(batch, "text")), width))[0].view(np.int64))], names=["shingle"])

    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(common.tidy(run), "shingle long")
    top = sample.groupBy("shingle").count().filter(F.col("count") >= COMMON_COUNT).orderBy(F.desc("count"), "shingle").limit(COMMON_ROWS).toArrow()
    return top["shingle"].to_numpy()[::-1].view(np.uint64)


def _sketch(docs: DataFrame, width: int, similarity: float, last: np.ndarray) -> DataFrame:
    """(doc, fp, digest, b0 .. b3, n, code, keys): SimHash, digest, parity codes and size of each set of shingles, and the
    prefix of it, in the common order, that it shares a member of with every set of that similarity."""
    place = np.argsort(last)
    shared = docs.sparkSession.sparkContext.broadcast((last[place], place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = shared.value
        for batch in common.slices(batches, "text"):
            hashes, counts = shingle_hashes(*common.buffers(common.column(batch, "text")), width)
            rank = np.zeros(len(hashes), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                rank = np.where(known[at] == hashes, ranks[at] + 1, 0)
            hashes, n = _distinct(hashes, counts, rank)
            ends = np.cumsum(n)
            digest, bits, some = np.zeros(len(n), np.uint64), np.zeros((len(PARITY), len(n)), np.uint64), n > 0
            if len(hashes):
                digest = common.range_hashes(common.mixed(hashes), ends - n, ends)
                one, word = np.uint64(1) << (hashes & np.uint64(63)), (hashes >> np.uint64(6)) % np.uint64(len(PARITY))
                for k in range(len(PARITY)):
                    bits[k, some] = np.bitwise_xor.reduceat(np.where(word == k, one, np.uint64(0)), (ends - n)[some])
            take = np.where(some, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
            keys = hashes[common.ragged(n) < np.repeat(take, n)].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(take)], pa.int32()), pa.array(keys))
            codes = [pa.array(x.view(np.int64)) for x in bits]
            fp = pa.array(majority_bits(hashes, n).view(np.int64))
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc"), fp, pa.array(digest.view(np.int64)), *codes, pa.array(n, pa.int64()), _long_codes(hashes, n), lists], names=["doc", "fp", "digest", *PARITY, "n", "code", "keys"])

    return docs.mapInArrow(common.tidy(run), f"doc long, fp long, digest long, {', '.join(f'{c} long' for c in PARITY)}, n long, code binary, keys array<long>")


def _long_codes(hashes: np.ndarray, n: np.ndarray) -> pa.Array:
    """Parity codes of 256 bits or the power of two from twice the members on."""
    bits = np.maximum(256, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    ends = np.cumsum(bits)
    at = np.repeat(ends - bits, n) + (hashes & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0) & 1
    return common.binaries(np.packbits(odd.astype(np.uint8), bitorder="little"), ends // 8)


def _code_distance(x: bytes, y: bytes) -> int:
    """Bits in which two parity codes differ; the longer one is folded to the length of the other."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _close_pairs(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that the long codes of both do not refuse."""
    x, y = (classes.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("code").alias(f"code_{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = common.column(batch, "n_a").to_numpy() + common.column(batch, "n_b").to_numpy()
            most = (n - 2 * (similarity / (1 + similarity) * n - 1e-6)).tolist()
            near = [_code_distance(p.as_py(), q.as_py()) <= m for p, q, m in zip(common.column(batch, "code_a"), common.column(batch, "code_b"), most, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "code_a", "code_b").mapInArrow(common.tidy(run), "a long, b long")


def _shared_keys(classes: DataFrame) -> DataFrame:
    """(key, doc, place): the rows of each key that two documents show at least."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.select("doc", F.posexplode("keys").alias("place", "key")).select("key", "doc", "place")
    rows = rows.repartition(parts, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, linked = None, False  # the last row, whose block may go on, and whether it has met another
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            key = common.column(table, "key").to_numpy()
            same = key[1:] == key[:-1]
            keep = np.r_[linked, same] | np.r_[same, False]
            held, linked = table.slice(table.num_rows - 1), bool(keep[-1])
            yield table.slice(0, table.num_rows - 1).filter(pa.array(keep[:-1]))
        if linked:
            yield held

    return rows.mapInArrow(common.tidy(run), rows.schema)


def _may(a: str, b: str, similarity: float) -> str:
    """Whether rows a and b of a key can be of sets that similar: by sizes, places of the key, and parity codes. Bounds
    only: no similar pair is refused."""
    differ = " + ".join(f"bit_count({a}.{c} ^ {b}.{c})" for c in PARITY)
    need = f"({similarity / (1 + similarity)!r}D * ({a}.n + {b}.n) - 1e-6D)"
    return (
        f"least({a}.n, {b}.n) >= {similarity!r}D * greatest({a}.n, {b}.n) - 1e-6D"
        f" and least({a}.place, {b}.place) + least({a}.n - {a}.place, {b}.n - {b}.place) >= {need}"
        f" and {differ} <= {a}.n + {b}.n - 2 * {need}"
    )


def _fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): documents whose SimHash fingerprints link: by equal ones, and by those of up to MAX_BITS differing bits that
    the pivot table finds. A star a component, as in links()."""
    prints = common.written(classes.groupBy("fp").agg(F.min("doc").alias("lead"), F.count("*").alias("n")), "prints")
    alike = common.join_hot(classes.select("doc", "fp"), prints.filter("n > 1").select("fp", "lead"), ["fp"], prints.select("fp", "n"), "n").filter("doc <> lead")
    x, y = (prints.select(F.col("fp").alias(c), F.col("lead").alias(f"doc_{c}")) for c in "ab")
    near = links(prints.select("fp")).join(x, "a").join(y, "b").select("doc_a", "doc_b")
    pairs = alike.select(F.col("doc").alias("doc_a"), F.col("lead").alias("doc_b")).unionByName(near)
    return pairs.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct()


_PAIR = ("least(x.doc, y.doc) as a", "greatest(x.doc, y.doc) as b")
_ROW = ("doc", "n", *PARITY, "place", "root")


def _star_pairs(blocks: DataFrame, turn: int, similarity: float) -> DataFrame:
    """(a, b): in each block of several components, its leader of this turn with the members of other components."""
    row = F.struct(*_ROW)
    lead = blocks.groupBy("key").agg(F.min_by(row, F.xxhash64(F.lit(turn), "doc")).alias("x"), F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo < _hi").select("key", "x")
    return blocks.select("key", row.alias("y")).join(lead, "key").filter(f"x.root <> y.root and {_may('x', 'y', similarity)}").selectExpr(*_PAIR).distinct()


def _open_pairs(blocks: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of a block that no component joins yet. One side leaves out the block's largest component."""
    sizes = blocks.groupBy("key", "root").count()
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("_rows"), F.count("*").alias("_roots")).filter("_roots > 1")
    main = main.select("key", "main", F.ceil(F.col("_rows") / TILE_ROWS).alias("tiles"))
    rows = blocks.join(main, "key")
    row = F.struct(*_ROW, (F.col("root") == F.col("main")).alias("in_main"))
    left = rows.filter("root <> main").select("key", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), row.alias("x"))
    right = rows.select("key", F.pmod(F.xxhash64("doc"), F.col("tiles")).alias("tile"), row.alias("y"))
    return left.join(right, ["key", "tile"]).filter(f"x.root <> y.root and (y.in_main or x.doc < y.doc) and {_may('x', 'y', similarity)}").selectExpr(*_PAIR).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Texts travel, which pack better than hashes; a repeated id counts with
    any of its texts."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = pairs.select(F.col("a").alias("doc"), "a", "b").unionByName(pairs.select(F.col("b").alias("doc"), "a", "b"))
    few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    rows = docs.join(F.broadcast(sides) if few else sides, "doc").select("a", "b", "doc", "text")
    rows = rows.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "doc")

    def similar(pair: tuple[int, int], held: list) -> bool:
        for s in (x for doc, x in held if doc == pair[0]):
            for t in (x for doc, x in held if doc == pair[1]):
                both = len(np.intersect1d(s, t, assume_unique=True))
                if both >= similarity * (len(s) + len(t) - both) - 1e-9:
                    return True
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = None, []  # the rows of the last pair, which may go on in the next slice
        for batch in common.slices(batches, "text"):
            hashes, n = _distinct(*shingle_hashes(*common.buffers(common.column(batch, "text")), width))
            ends, good = np.cumsum(n).tolist(), []
            for k, (a, b, doc) in enumerate(zip(*(common.column(batch, c).to_pylist() for c in ("a", "b", "doc")), strict=True)):
                if pair != (a, b):
                    if held and similar(pair, held):
                        good.append(pair)
                    pair, held = (a, b), []
                held.append((doc, hashes[(ends[k - 1] if k else 0) : ends[k]]))
            held = [(doc, x.copy()) for doc, x in held]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in good], pa.int64()) for k in (0, 1)], names=["a", "b"])
        if held and similar(pair, held):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in pair], names=["a", "b"])

    return rows.mapInArrow(common.tidy(run), "a long, b long")


def similar_texts(docs: DataFrame, width: int = 5, similarity: float = 0.8, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of the documents that have words: component_id is the smallest doc_id of the texts that
    chains of pairs connect whose sets of `width`-word shingles have a Jaccard similarity of at least `similarity`.

    Fingerprints of the sets, within MAX_BITS bits by the pivot table, propose pairs first, which are verified on texts. What
    no such pair joins is sought on by prefixes, since similar texts may differ in more bits.
    Exact up to equal 64-bit hashes: similar sets share a member of their prefixes in any common order, here rare
    shingles first; every pair of a shared key is verified unless bounds refuse it or a component joins it already.
    Equal sets are one from the start. Texts without words are left out, as are null ids. Empty table: empty result."""
    ids = docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc is not null")
    sketch = common.written(_sketch(ids, width, similarity, _common_shingles(ids, width)), "sketch")
    same = ["digest", "b0", "n"]
    classes = sketch.filter("n > 0").groupBy(*same).agg(F.min("doc").alias("doc"), F.count("*").alias("rows"), *(F.first(c).alias(c) for c in (*PARITY[1:], "fp", "code", "keys")))
    classes = common.written(classes, "classes")
    with common.passing(docs.sparkSession) as keep:
        roots_ = _joined_classes(classes, ids, width, similarity)
        if roots_ is not None:
            keep(roots_)
    named = classes.select(*same, F.col("doc").alias("component_id"))
    if roots_ is not None:
        named = classes.join(roots_, F.col("doc") == F.col("node"), "left").select(*same, F.coalesce("root", "doc").alias("component_id"))
    return common.join_hot(sketch.select("doc", *same), named, same, classes.select(*same, "rows"), "rows").select(F.col("doc").alias("doc_id"), "component_id")


def _joined_classes(classes: DataFrame, ids: DataFrame, width: int, similarity: float) -> DataFrame | None:
    """(node, root) of classes that similar pairs join; none: null."""
    shared = common.written(_shared_keys(classes).join(classes.select("doc", "n", *PARITY), "doc"), "shared")
    seen, edges, roots_ = None, None, None
    for turn in range(-1, STAR_ROUNDS + 1):
        blocks = shared.withColumn("root", F.col("doc"))
        if roots_ is not None:
            blocks = shared.join(roots_, F.col("doc") == F.col("node"), "left").select("key", "doc", "n", *PARITY, "place", F.coalesce("root", "doc").alias("root"))
        if turn < 0:
            pairs = _fingerprint_pairs(classes)
        else:
            pairs = _star_pairs(blocks, turn, similarity) if turn < STAR_ROUNDS else _open_pairs(blocks, similarity)
        pairs = common.written(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        seen = pairs if seen is None else seen.unionByName(pairs)
        close = common.written(_close_pairs(pairs, classes, similarity), "close")
        found = common.written(_verified(close, ids, width, similarity), "edges")
        if found.take(1):
            edges = found if edges is None else edges.unionByName(found)
            roots_ = common.written(components(edges), "roots")
    return roots_
