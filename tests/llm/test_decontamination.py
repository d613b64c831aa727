"""Decontamination at its edges: letters whose case hangs on their neighbours, long texts, a benchmark beyond what is broadcast."""

import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from terrasheaf.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(spark, docs, items):
    out = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    return {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["item_ids"])) for r in out.collect()}


def test_only_a_to_z_is_lowered(spark):
    items = [("sigma", "ΟΔΟΣ"), ("umlaut", "über"), ("kelvin", "k1"), ("upper", "ABC")]
    docs = [(1, "ΟΔΟΣ.Α x"), (2, "οδος"), (3, "Über über"), (4, "K1 K1"), (5, "aBc"), (6, "ΟΔΟΣ"), (7, "ΟΔΟΣΑ")]
    assert hits(spark, docs, items) == {1: (3, 1, ["sigma"]), 2: (1, 0, []), 3: (2, 1, ["umlaut"]), 4: (2, 1, ["kelvin"]), 5: (1, 1, ["upper"]), 6: (1, 1, ["sigma"]), 7: (1, 0, [])}


def test_long_text_with_a_frequent_item(spark):
    text = " ".join("the" if k % 2 else f"w{k}" for k in range(100_000))
    began = time.time()
    assert hits(spark, [(1, text)], [("a", "the"), ("b", "w2 the")]) == {1: (100_000, 50_001, ["a", "b"])}
    assert time.time() - began < 60


LIMITS = {"windows": ("BROADCAST_WINDOWS", 50), "items": ("BROADCAST_ITEMS", 0), "few bits": ("BITMAP_BITS", 1 << 15)}


@pytest.mark.parametrize("limit", LIMITS)
def test_shuffled_benchmark_gives_the_same(spark, monkeypatch, limit):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = lambda: sorted(map(str, decontaminate.decontaminate(docs.union(docs.limit(5)), items).collect()))
    whole = rows()
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 50)
    monkeypatch.setattr(decontaminate, *LIMITS[limit])
    assert rows() == whole


def test_shuffled_benchmark_with_hot_windows(spark, monkeypatch):
    """A passage of every item in a third of all documents, among frequent words, awkward letters and nulls."""
    passage = " ".join(f"P{k}" for k in range(15))
    items = [(f"i{k:03}", f"{passage} tail{k} the the") for k in range(40)] + [(None, "of the"), ("sigma", "ΟΔΟΣ"), ("none", None), ("empty", " ."), ("twice", "of the"), ("far", "never seen here")]
    docs = [(k, f"the of the {passage.lower() if k % 3 == 0 else 'ΟΔΟΣ'} w{k} " + "of " * (k % 7)) for k in range(300)]
    docs += [(7, passage), (None, passage), (900, None), (901, ""), (902, "the " * 3000), (903, f"{passage} tail3 the"), (903, f"{passage} tail3 the")]
    rows = lambda: sorted(map(str, decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()))
    whole = rows()
    for name, value in (("BROADCAST_WINDOWS", 3), ("HOT_PARTS", 4)):
        monkeypatch.setattr(decontaminate, name, value)
    monkeypatch.setattr(decontaminate.common, "HOT_ROWS", 20)
    monkeypatch.setattr(decontaminate.common, "HOT_KEYS", 10)
    assert rows() == whole


def test_shuffled_plan_reads_texts_twice_and_has_no_python(spark, monkeypatch, capsys):
    """A word is dropped by the bitmap before anything is shuffled, in the stage that makes it."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    windows = decontaminate.window_tokens(decontaminate.item_windows(spark.read.parquet(f"{SF}/benchmark.parquet")).select("win").distinct())
    mask, bits = decontaminate._bitmap(windows.select("token").distinct(), 1000, 16)
    words = decontaminate._positions(docs.withColumn("_row", F.monotonically_increasing_id()), [5], ["_row", "doc_id", "_raw"])
    decontaminate._sifted(words, mask, bits).filter("_in").select("_row", F.slice("_raw", F.col("_at") + 1, 25)).explain()
    text = capsys.readouterr().out
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Python" not in text
    reads = []
    positions = decontaminate._positions
    monkeypatch.setattr(decontaminate, "_positions", lambda *args: reads.append(1) or positions(*args))
    out = decontaminate.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    out.explain()
    assert len(reads) == 2 and "Python" not in capsys.readouterr().out and "Arrow" not in text


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    key = lambda r: r["doc_id"]
    mine = queries.op10_decontamination(spark, sf).toPandas()
    theirs = con.execute(queries.ORACLE_SQL["op10_decontamination"]).df()
    assert sorted(map(tuple, mine[sorted(mine.columns)].astype(str).to_numpy())) == sorted(map(tuple, theirs[sorted(theirs.columns)].astype(str).to_numpy()))
    assert (mine["n_hit"] > 0).any() and key is not None
