"""Similar texts of the pipeline against brute force: short texts, hot blocks, blocks cut by Arrow batches."""

import random
import re

import pytest

from terrasheaf.llm import simhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, width=5):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, similarity=0.8):
    """doc_id to the smallest doc_id of its component."""
    sets = {i: shingles(t) for i, t in rows if shingles(t)}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {i: top(i) for i in ids}


def found(spark, rows):
    out = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r["doc_id"]: r["component_id"] for r in out}


def short_texts():
    """Pairs of 20 to 30 words, changed at one end."""
    rng, rows = random.Random(3), []
    for i in range(300):
        base = [f"q{rng.randrange(10_000)}" for _ in range(rng.randint(20, 30))]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(["new", *base] if i % 2 else [*base[:-1], "new"]))]
    return rows


def hot_texts():
    """400 documents that share a passage, every second one with its near copy, which shares little else."""
    rng, rows = random.Random(4), []
    passage = [f"licence{k}" for k in range(150)]
    for i in range(200):
        own = [f"o{rng.randrange(1_000_000)}" for _ in range(50)]
        rows += [(i, " ".join([*passage, *own])), (9_000 - i, " ".join([*passage, *own[:-2], "x", "y"]))]
    return rows


def test_short_texts_are_all_found(spark):
    rows = short_texts()
    assert found(spark, rows) == brute(rows)


def test_large_blocks_lose_no_pair(spark):
    rows = hot_texts()
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("size", ["3", "50"])
def test_batch_borders_lose_no_pair(spark, size):
    rng = random.Random(5)
    line = [f"c{k}" for k in range(12)]
    rows = [(i, " ".join([*line, *(f"u{i % 50}.{k}" for k in range(12)), *(["end"] if i >= 50 else [])])) for i in range(100)]
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_template_variants(spark, monkeypatch):
    """Variants at many distances from each other; the tiles are small, so that one block takes several."""
    monkeypatch.setattr(simhash, "TILE_ROWS", 16)
    rng = random.Random(6)
    template = [f"t{k}" for k in range(120)]
    rows = []
    for i in range(300):
        w = list(template)
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(120)] = f"z{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    assert found(spark, rows) == brute(rows)


def test_pairs_that_meet_in_a_large_block_alone(spark):
    """300 pairs under one line of text; own words are too few for another common chunk in most pairs."""
    line = [f"c{k}" for k in range(12)]
    rows = [(i, " ".join([*line, *(f"u{i % 300}.{k}" for k in range(12)), *(["end"] if i >= 300 else [])])) for i in range(600)]
    assert found(spark, rows) == brute(rows)


def test_fingerprints_join_near_copies(spark, monkeypatch):
    """SimHash proposes pairs by itself, prefixes do not stand in for it; a pair that is not similar is refused on texts."""
    monkeypatch.setattr(simhash, "_star_pairs", lambda blocks, *_: blocks.selectExpr("doc as a", "doc as b").limit(0))
    monkeypatch.setattr(simhash, "_open_pairs", lambda blocks, *_: blocks.selectExpr("doc as a", "doc as b").limit(0))
    base = " ".join(f"w{k}" for k in range(3000))
    rows = [(5, base), (7, base + " end"), (9, base), (11, " ".join(f"v{k}" for k in range(3000)))]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {5: 5, 7: 5, 9: 5, 11: 11}
