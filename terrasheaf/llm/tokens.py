"""Token ids as ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of doc_id, so each file holds one range in order, and files read stripe by stripe in
parallel. A row carries its place within the file; the place in the whole corpus follows from the files' totals, which
stand in a table beside them, so that a read of a few documents skips all other stripes.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The side table of the files' totals; Spark's readers of the folder above pass it by.
TOTALS = "_totals"
END_ID = 1
#: Distinct words whose ids a Python worker remembers; above it, it starts anew. Bytes of text looked up together. Each
#: lookup hashes the remembered words, and an executor holds a worker for each of its cores.
CACHE_WORDS, LOOKUP_BYTES = 300_000, 4 << 20
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.create.index": "true", "compression": "zstd"}

#: The rules of word_bpe_49k.json, which let words be encoded one by one.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts through the tokenizers library, each distinct word encoded once.

    The vocabulary's rules drop white space, never join what it separates, always split a letter from a mark after it,
    and lower the case. So a text's ids are its words' ids in order, with marks cut off and ASCII words lowered first.
    Texts with one of the vocabulary's special tokens are encoded whole, as are all if the rules are others."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [s["pattern"].get("Regex") for s in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
        self.by_word = normal == NORMALIZERS and splits == [SPLIT_RULE]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.ids = np.zeros(0, np.int32)
        self.begin = self.count = np.zeros(0, np.int64)

    def learn(self, words: pa.Array, together: int = 200) -> None:
        """Encodes words in lines of many; each id goes to the word in which its text starts.

        Lines go one by one: a batch would hold all their encodings at once, in threads beyond the task's core."""
        ids, counts = [self.ids], []
        for k in range(0, len(words), together):
            line = words.slice(k, together).to_pylist()
            e = self.tokenizer.encode(" ".join(line), add_special_tokens=False)
            sizes = np.fromiter(map(len, line), np.int64, len(line))
            starts = np.cumsum(sizes + 1) - sizes - 1
            at = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
            counts.append(np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(line)))
            ids.append(np.array(e.ids, np.int32))
        count = np.concatenate(counts)
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate(ids)
        self.words = pa.concat_arrays([self.words, words])

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); null is empty."""
        text = pc.fill_null(text.cast(pa.string()), "")
        if not self.by_word or any(pc.any(pc.match_substring(text, s)).as_py() for s in self.special):
            found = [np.array(self.tokenizer.encode(t.as_py(), add_special_tokens=False).ids, np.int32) for t in text]
            return np.concatenate([np.zeros(0, np.int32), *found]), np.array([len(x) for x in found], np.int64)
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(text, r"([A-Za-z])([.,;:!?])", r"\1 \2"))
        words = lists.flatten().dictionary_encode()
        own = words.dictionary
        own = pc.if_else(pc.string_is_ascii(own), pc.ascii_lower(own), own)
        if len(self.words) > CACHE_WORDS:
            self.forget()
        place = pc.index_in(own, self.words)
        if place.null_count:
            missing = pc.is_null(place)
            lost, known = own.filter(missing), len(self.words)
            new = lost.unique()
            self.learn(new)
            place = pc.replace_with_mask(place, missing, pc.add(pc.index_in(lost, new), pa.scalar(known, pa.int32())))
        at = place.to_numpy()[words.indices.to_numpy()]
        counts = self.count[at]
        ends = np.r_[0, np.cumsum(counts)]
        source = np.repeat(self.begin[at] - ends[:-1], counts)
        source += np.arange(len(source))
        ids = self.ids[source]
        doc = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ids, ends[doc[1:]] - ends[doc[:-1]]


@functools.lru_cache(maxsize=2)
def shared_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker, so that words learned by one serve the next."""
    return WordEncoder(path)


def encode(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """docs (doc_id, text) as (shard, doc_id, shard_start, n_tokens, ids), in ascending doc_id order over partitions.

    Without a number of partitions, adaptive execution joins small ones; they stay in order. Null text: no ids but the
    end id. Null doc_id: first. Equal doc_ids: by the text's length, then by text."""
    path = vocabulary or default_vocabulary()
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    by = ("doc_id", F.length("text"))
    dealt = (base.repartitionByRange(partitions, *by) if partitions else base.repartitionByRange(*by)).sortWithinPartitions(*by, "text")
    dealt = dealt.withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = shared_encoder(path), 0
        for batch in common.slices(batches, "text", LOOKUP_BYTES):
            ids, counts = encoder.encode(common.column(batch, "text"))
            ends = np.cumsum(counts + 1)
            full = np.full(ends[-1], end_id, np.int32)
            inner = np.ones(ends[-1], bool)
            inner[ends - 1] = False
            full[inner] = ids
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(full))
            yield pa.RecordBatch.from_arrays([common.column(batch, "shard"), common.column(batch, "doc_id"), pa.array(start + ends - counts - 1), pa.array(counts + 1), lists], names=["shard", "doc_id", "shard_start", "n_tokens", "ids"])
            start += int(ends[-1])

    return dealt.mapInArrow(common.tidy(run), "shard int, doc_id long, shard_start long, n_tokens long, ids array<int>")


def write_token_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, doc_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes ORC files of token ids under path, one range of doc_id a file, and their totals; returns path.

    Empty table: no rows. Very long texts: one row each, whatever their length. Other columns of docs are left out."""
    encode(docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), vocabulary, end_id).write.options(**ORC_OPTIONS).orc(path)
    rows = docs.sparkSession.read.schema(_ROW).orc(path)
    rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).coalesce(1).write.parquet(f"{path}/{TOTALS}")
    return path


_ROW = "shard int, doc_id long, shard_start long, n_tokens long, ids array<int>"


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of written files. start: ids of all documents before it.

    Files' totals are one row a file; they meet in one running sum, the ids do not."""
    rows = spark.read.schema(_ROW).orc(path)
    totals = spark.read.schema("shard int, n long").parquet(f"{path}/{TOTALS}")
    before = totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), F.col("shard") == F.col("_shard")).select("doc_id", (F.col("_before") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def with_crc32(rows: DataFrame) -> DataFrame:
    """rows (doc_id, start, n_tokens, ids) with ids replaced by the CRC-32 of the ids as little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = common.column(batch, "ids")
            offsets = lists.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(common.column(batch, c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(common.tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of given documents; ORC statistics and Bloom filters skip files, stripes and row
    groups, and nothing else of the corpus is read but the files' totals."""
    return read_token_ids(spark, path).filter(F.col("doc_id").isin(doc_ids))
