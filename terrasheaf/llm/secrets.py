"""Secret scans with corpus-wide ownership frequency.

One pass over the texts finds candidates; only their hashes are shuffled. A value that stands in many owners'
repositories is a copied example, one that stays with an owner looks live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

#: The base patterns, on UTF-8 bytes, so that only ASCII letters have two cases.
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"passw", b"secret", b"token", b"api")
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 8, 16, 32
#: Further candidates: runs of at least so many base64 or URL-safe characters, letters and digits mixed, of so many bits a character.
TOKEN_MIN, TOKEN_BITS = 20, 3.5
#: A value with this many owners is a copied example.
EXAMPLE_OWNERS = 3


def _set(chars: bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(chars)] = False
    return out


_NOT_HEX = _set(b"0123456789abcdef")
_NOT_TOKEN = _set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=")


def _long_runs(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, least: int) -> dict[int, list[tuple[int, int]]]:
    """By document, the (start, end) in it of runs of at least `least` bytes that are no separators."""
    starts, ends, _ = common.word_bounds(data, offsets, separator)
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    out: dict[int, list[tuple[int, int]]] = {}
    for d, a, b in zip(doc.tolist(), (starts - offsets[doc]).tolist(), (ends - offsets[doc]).tolist(), strict=True):
        out.setdefault(d, []).append((a, b))
    return out


def _bits(value: bytes) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _found(raw: bytes, hexes: list, tokens: list) -> list[tuple[int, int, int, bytes, bool]]:
    """(byte start, end, kind, value, whether the base rule finds it), by start and kind."""
    out, low = [], raw.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), 0, m[1], True) for m in ASSIGN.finditer(raw) if len(m[1]) >= ASSIGN_MIN]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1, m[0], True) for m in ACCESS.finditer(raw) if len(m[0]) >= ACCESS_MIN]
    out += [(a, b, 2, raw[a:b], True) for a, b in hexes]
    base = list(out)
    for a, b in tokens:
        value = raw[a:b].strip(b"=/-")
        a = raw.index(value, a) if value else a
        b = a + len(value)
        mixed = re.search(rb"[0-9]", value) and re.search(rb"[A-Za-z]", value)
        if len(value) >= TOKEN_MIN and mixed and _bits(value) >= TOKEN_BITS and not any(a < e and s < b for s, e, *_ in base):
            out.append((a, b, 3, value, False))
    return sorted(out)


_SCAN = "n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start: long, kind_no: int, end: long, hash: string, base: boolean>>"


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text and with the base counts, the base digest and all candidates (places in code points)."""
    keep = [c for c in docs.columns if c != text_col]
    kind = StructType([*docs.select(*keep).schema, *StructType.fromDDL(_SCAN)])
    item = pa.struct([("start", pa.int64()), ("kind_no", pa.int32()), ("end", pa.int64()), ("hash", pa.string()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text_col):
            data, offsets = common.buffers(common.column(batch, text_col))
            hexes, tokens = _long_runs(data, offsets, _NOT_HEX, HEX_MIN), _long_runs(data, offsets, _NOT_TOKEN, TOKEN_MIN)
            whole = data.tobytes()
            counts, digests, found = [], [], []
            for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                raw = whole[a:b]
                own = _found(raw, hexes.get(d, []), tokens.get(d, []))
                place = (lambda x: x) if raw.isascii() else (lambda x, raw=raw: len(raw[:x].decode()))
                own = [(place(s), k, place(e), hashlib.sha256(v).hexdigest(), base) for s, e, k, v, base in own]
                base = [x for x in own if x[4]]
                counts.append([sum(x[1] == k for x in base) for k in range(3)])
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in base).encode()).hexdigest())
                found.append([dict(zip(("start", "kind_no", "end", "hash", "base"), x, strict=True)) for x in own])
            arrays = [*(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(digests, pa.string()), pa.array(found, pa.list_(item))]
            yield pa.RecordBatch.from_arrays([*(common.column(batch, c) for c in keep), *arrays], names=[*keep, "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    return docs.select(*keep, text_col).mapInArrow(common.tidy(run), kind)


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) over all candidates of scanned (found, repo, owner); copies collapse before the shuffle."""
    each = scanned.select("repo", "owner", F.explode("found.hash").alias("hash")).distinct()
    return each.groupBy("hash").agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"))


def find_secrets(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, found) for each row of docs.

    spans: base spans, and further candidates whose owners are fewer than example_owners. Owners alone decide: a
    credential in many repositories of one owner is still that owner's. found tells, for each
    candidate, its repositories and owners and whether it looks live. Null text: empty. Null owner or repository
    columns count as one owner. Repeated or null doc_id: rows stay apart. Empty table: empty result. A value that very many
    documents hold meets its spread by broadcast. Other columns do not matter."""
    rows = docs.select(F.col(doc_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols)).alias("repo"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    scanned = common.written(scan(rows), "secrets")
    spread = ownership(scanned)
    candidates = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    counts = candidates.groupBy("hash").agg(F.count("*").alias("n"))
    judged = common.join_hot(candidates, spread, ["hash"], counts).withColumn("live", F.col("n_owners") < example_owners)
    item = F.struct("start", "kind_no", "end", "hash", "base", "live", "n_repos", "n_owners")
    by_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(item)).alias("all"))
    none = by_row.schema["all"].dataType
    found = F.coalesce("all", F.array().cast(none))
    shown = F.filter("found", lambda x: x["base"] | x["live"])
    kind = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(shown, lambda x: F.concat_ws(":", F.element_at(kind, x["kind_no"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    out = scanned.drop("found").join(by_row, "row", "left").withColumn("found", found)
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), count(lambda x: x["live"]).alias("n_live"), count(lambda x: ~x["live"]).alias("n_example"), "found")
