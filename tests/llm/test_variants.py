"""Spelling variants against brute force: hot groups cut into blocks, ties, chains of forms, awkward rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from terrasheaf.llm import common, variants

KIND = "doc_id long, text string, N string, Word string"


def texts(seed=1, n=40):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdéèÀstüÿ") for _ in range(rng.randrange(4, 12))) for _ in range(60)] + ["aaaaaa", "aaaaa", "internal", "interval", "Internal"]
    words = []
    for w in base:
        words += [w] * rng.randrange(1, 60)
        for _ in range(12):  # variants in several steps, of falling counts
            if len(w) < 3:
                break
            k, how = rng.randrange(len(w)), rng.randrange(3)
            w = w[:k] + (rng.choice("abcé") if how < 2 else "") + w[k + (how > 0) :]
            words += [w] * rng.choice([1, 3, 3, 6, 14])
    words += [f"prefix{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26) for _ in range(3)]
    rng.shuffle(words)
    step = len(words) // n
    return [(k, rng.choice([" ", ", ", "\n", "1"]).join(words[k * step : (k + 1) * step]), "x", "y") for k in range(n)] + [(n, None, "x", None), (n + 1, "", None, None), (3, "prefixaa " * 50, "x", "y"), (None, "prefixab " * 400, "x", "y")]


def brute(rows):
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = sorted(w for w in n if len(w) >= 5 and n[w] >= 3)

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [o for o in words if abs(len(o) - len(w)) < 2 and one_edit(w, o)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize(("block", "tile", "gather"), [(2048, 64, 50_000), (40, 8, 100), (7, 2, 1)])
def test_variants(spark, monkeypatch, block, tile, gather):
    for name, value in (("BLOCK_WORDS", block), ("TILE", tile), ("GATHER", gather), ("CELLS", 1 << 12)):
        monkeypatch.setattr(variants, name, value)
    monkeypatch.setattr(common, "HOT_KEYS", 10**6)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = texts(block)
    got = variants.spelling_variants(spark.createDataFrame(rows, KIND).repartition(3)).collect()
    want = brute(rows)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want and len(got) == len(want)
    assert sum(f is not None for f, *_ in want.values()) > 50 and any(root != f for f, root, *_ in want.values() if f)
    assert max(v[3] for v in want.values()) > 20


def test_other_alphabets(spark):
    """Code points beyond 255 and beyond 16 bits, through the general interface."""
    words = spark.createDataFrame([("жизньа", 9), ("жизнь", 4), ("жизно", 5), ("x😀y😀z", 3), ("x😀yz", 9), ("xyz", 1)], "word string, n long")
    got = {r["word"]: (r["n_near"], r["near"], r["form_n"]) for r in variants.near_words(words).collect()}
    assert got == {"жизньа": (1, "жизнь", 4), "жизнь": (2, "жизньа", 9), "жизно": (1, "жизнь", 4), "x😀y😀z": (1, "x😀yz", 9), "x😀yz": (2, "x😀y😀z", 3), "xyz": (1, "x😀yz", 9)}


def test_awkward_tables(spark):
    assert variants.spelling_variants(spark.createDataFrame([], KIND)).collect() == []
    assert variants.spelling_variants(spark.createDataFrame([(1, None, "", "")], KIND)).collect() == []
    long = "a" * 3000
    rows = [(k, f"{long} {long}b Worden worden", "x", "y") for k in range(4)]
    got = {r["word"]: r["n_near"] for r in variants.spelling_variants(spark.createDataFrame(rows, KIND)).collect()}
    assert got[long] == 1 and got[long + "b"] == 1 and got["worden"] == 0
