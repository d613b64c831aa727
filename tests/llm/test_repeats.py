"""Repeated words and bytes against brute force: hot anchors, small batches, periodic and very long texts."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from terrasheaf.llm import common, substrings, suffixes

SCHEMA = "doc_id long, text string, n_words int, KEPT string"


def hot_texts():
    """A passage in every document between own words, near copies, periodic texts, null and equal ids."""
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(40))
    out = []
    for i in range(120):
        own = [f"o{rng.randrange(60)}" for _ in range(30)]
        out.append((i, " ".join(own[:15]) + " " + passage + " " + " ".join(own[15:])))
    out += [(200 + i, out[i][1].replace("p7 ", f"q{i} ")) for i in range(40)]
    out += [(None, out[3][1]), (None, None), (5, "a " * 300), (6, "a " * 50 + "b"), (7, "x y " * 100), (7, "x y " * 100), (8, ""), (9, "ab" * 300), (10, "ab" * 130), (11, "z" * 900)]
    rng.shuffle(out)
    return out


def brute_words(rows, k=13):
    key = lambda i: float("inf") if i is None else i
    first, want = {}, []
    for i, t in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            first[g] = min(first.get(g, float("inf")), key(i))
    for i, t in rows:
        w, gone = (t or "").encode().split(), set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < key(i):
                gone |= set(range(j, j + k))
        want.append((str(i), len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(want)


def brute_bytes(rows, length=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    want = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        want.append((str(i), len(b), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-2]][: len(b)]).sum()), bytes(c for c, g in zip(b, gone, strict=False) if not g)))
    return sorted(want)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA).repartition(parts)


def words_of(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect())


def bytes_of(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect())


@pytest.fixture
def small_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("limits", [(4096, 65536), (3, 65536), (10**9, 5), (3, 5)])
def test_words_of_hot_anchors(spark, limits, monkeypatch, small_batches):
    monkeypatch.setattr(substrings, "LOCAL_EDGES", limits[0])
    monkeypatch.setattr(substrings, "JOIN_EDGES", limits[1])
    monkeypatch.setattr(substrings, "FLUSH_EDGES", 500)
    rows = hot_texts()
    assert words_of(substrings.remove_repeats(frame(spark, rows))) == brute_words(rows)


def test_windows_of_other_widths(spark):
    rows = hot_texts()
    for k in (1, 3, 40):
        assert words_of(substrings.remove_repeats(frame(spark, rows), window=k)) == brute_words(rows, k)


def test_long_and_periodic_words(spark):
    rows = [(1, "a " * 1_000_000), (2, "a " * 12), (3, "a " * 200_000 + "b"), (4, " ".join(f"w{k}" for k in range(300_000)))]
    began = time.time()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: (1_000_000, 0), 2: (12, 0), 3: (200_001, 200_000), 4: (300_000, 0)}
    assert time.time() - began < 90


def test_runs_join_into_paths(spark):
    hits = spark.createDataFrame([(2, 0, 5, 3, 1, 0, 15), (2, 0, 8, 1, 1, 0, 18), (2, 0, 10, 2, 1, 0, 20), (2, 0, 12, 1, 1, 0, 30)], "doc long, tag int, first int, edges int, src_doc long, src_tag int, src_first int")
    got = sorted((r["start"], r["stop"], r["src_start"]) for r in substrings.paths(hits, 13).collect())
    assert got == [(5, 9 + 12, 15), (10, 12 + 12, 20), (12, 13 + 12, 30)]


def test_anchor_runs():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, w, k = int(rng.integers(1, 80)), int(rng.integers(1, 12)), int(rng.choice([1, 2, 5, 1000]))
        v = common.mixed(rng.integers(0, k, n).astype(np.uint64) + np.uint64(7))
        begin = np.arange(max(0, n - w + 1))
        head, anchor, tied = common.anchor_runs(v, begin, np.zeros(len(begin), np.int64), w)
        run = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(begin)]))
        for i in begin.tolist():
            assert anchor[run[i]] == v[i : i + w][np.argmin(v[i : i + w] >> np.uint64(24))]
        for r in range(len(head)):
            own = [v[b : b + w].tobytes() for b in begin[run == r].tolist()]
            assert tied[r] or len(set(own)) == len(own)
    assert len(common.anchor_runs(np.full(200_000, 5 << 30, np.uint64), np.arange(199_860), np.zeros(199_860, np.int64), 141)[0]) < 1500


@pytest.mark.parametrize("limits", [(1 << 18, 4, 1 << 21), (500, 4, 1 << 21), (1 << 30, 1, 700), (500, 1, 700)])
def test_bytes_of_hot_anchors(spark, limits, monkeypatch, small_batches):
    monkeypatch.setattr(suffixes, "LOCAL_BYTES", limits[0])
    monkeypatch.setattr(suffixes, "MERGE_SHARDS", limits[1])
    monkeypatch.setattr(suffixes, "FLUSH_BYTES", 20_000)
    rows = hot_texts()
    assert bytes_of(suffixes.remove_repeats(frame(spark, rows), shard_bytes=limits[2])) == brute_bytes(rows)


def test_long_and_periodic_bytes(spark):
    rng = random.Random(2)
    rows = [(1, "a" * 20_000_000), (2, "ab" * 150), (3, "".join(rng.choices("0123456789abcdef", k=2_000_000))), (4, "xyz" * 100_000 + "q")]
    began = time.time()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: (20_000_000, 20_000_000, 1), 2: (300, 300, 1), 3: (2_000_000, 0, 0), 4: (300_001, 300_000, 1)}
    assert time.time() - began < 120


def test_hot_keys_meet_by_broadcast(spark, monkeypatch):
    """The join of counted keys gives the same rows with and without hot ones, nulls and missing keys included."""
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    left = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 1), (None, 1), (3, 7)], "key int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "key int, w string")
    counts = left.groupBy("key").count().withColumnRenamed("count", "n")
    assert sorted(common.join_hot(left, right, ["key"], counts).collect()) == sorted(left.join(right, "key").collect())
    rows = hot_texts()
    assert words_of(substrings.remove_repeats(frame(spark, rows))) == brute_words(rows)
