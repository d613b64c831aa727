"""Operators against brute force, on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import gzip
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from terrasheaf.llm import common, decontaminate, mixing, pii, quality, secrets, simhash, substrings, suffixes, tokens, warc

WORD = re.compile("[^\x20\x09-\x0d]+")


def texts():
    rng = random.Random(5)
    vocabulary = ["the", "of", "Ünder", "der", "que", "naïve", "x1", "lorem", "Ipsum", "and"] + [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([5, 30, 80, 200]))) for _ in range(30)]
    out = [None, "", "  \n ", "one", "a b\tc", *base, base[3], base[4] + " tail", "head " + base[5], "\n".join([base[6]] * 3), "a " * 40]
    long = " ".join(rng.choices(vocabulary, k=3000))
    return [*out, long, long + " " + base[7]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "en", -1) for i, t in enumerate(texts())]
    rows += [(None, "null id " * 30, "s1", "en", 0), rows[8], rows[8]]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_words int").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return WORD.findall(t or "")


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    targets = {r["source"]: r["target"] for r in got}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6
    for s, target in targets.items():
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own) * 3
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    assert mixing.mix(empty).count() == 0
    assert mixing.take(docs, mixing.mix(docs)).columns == docs.columns


def test_pivotal_keeps_mass():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 500, 400).astype(float), rng.random(400)
    out = mixing.pivotal_rounds(np.arange(400), size, p, 3)
    assert abs((size * out).sum() - (size * p).sum()) < 1e-6 and ((out > 0) & (out < 1)).sum() <= 1


def test_substrings(docs, empty):
    got = substrings.remove_repeats(docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    first = {}
    key = lambda i: float("inf") if i is None else i
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, float("inf")), key(i))
    want = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < key(i):
                gone |= set(range(k, k + 13))
        want.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == sorted(want)
    assert substrings.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("shard", [1 << 21, 500])
def test_suffixes(docs, empty, shard):
    raw = [((r["text"] or "").encode(), r["doc_id"]) for r in docs.collect()]
    seen = Counter(b[k : k + 200] for b, _ in raw for k in range(len(b) - 199))
    want = []
    for b, i in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want.append((str(i), len(b), int(gone.sum()), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    got = suffixes.remove_repeats(docs, shard_bytes=shard).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got) == sorted(want)
    assert suffixes.remove_repeats(empty).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n, k in ((1, 1), (9, 1), (400, 2), (2000, 4)):
        data = rng.integers(0, k, n, dtype=np.uint8)
        b, order = data.tobytes(), suffixes.suffix_array(data)
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
        for r, length in enumerate(suffixes.common_prefixes(data, order)[1:], 1):
            x, y = b[order[r - 1] :], b[order[r] :]
            assert x[:length] == y[:length] and x[length : length + 1] != y[length : length + 1]


def test_quality(docs, empty):
    got = quality.quality_rules(docs).select("text", "quality.*").collect()
    for r in got:
        t = r["text"] or ""
        w = words(t)
        c, g = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
        for i in range(len(w) - 7):
            if c[tuple(w[i : i + 8])] > 1:
                g |= set(range(i, i + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(g), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(g) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(empty).count() == 0
    with pytest.raises(ValueError):
        quality.quality_rules(docs, result_col="LANG")


def test_warc(spark, tmp_path):
    page = "é" * 600
    rows = [(1, "http://b.com/x", page), (3, "http://www.a.com/y#z", page), (2, "http://a.com/y", page), (4, "http://a.com/y", "short"), (5, None, "short"), (6, "u\r\nv", None), (None, "http://n.org", page)]
    path = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"))
    index = warc.capture_index(warc.read_captures(spark, path)).collect()
    got = {r["page_id"]: r for r in index}
    assert len(index) == 7 and [got[i]["record_type"] for i in (1, 2, 3, 4, 5, 6, None)] == ["revisit", "revisit", *["response"] * 5]
    assert got[1]["refers_to"] == 3 and got[1]["payload_bytes"] == 1200 and got[6]["payload_bytes"] == 0
    assert got[2]["payload_digest"] == hashlib.sha1(page.encode()).hexdigest()
    keys = [(r["url_key"], r["captured"]) for r in index]
    assert keys == sorted(keys)
    assert warc.capture_index(warc.read_captures(spark, warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e")))).count() == 0
    files = {f"file:{p}": p.read_bytes() for p in (tmp_path / "w").glob("part-*")}
    assert len(list(warc.records(b"".join(map(gzip.decompress, files.values()))))) == 7
    for r in index:
        headers, block = warc.fetch(files[r["run"].replace("file://", "file:")], r["offset"], r["length"])
        assert headers["WARC-Payload-Digest"] == "sha1:" + r["payload_digest"] and (r["record_type"] == "revisit" or len(block.partition(b"\r\n\r\n")[2]) == r["payload_bytes"])


def test_warc_of_any_page_id(spark, tmp_path):
    """The largest and smallest ids, which no timestamp could count in seconds."""
    ids = [2**63 - 1, -(2**63), 10**13, -1, 0, 7]
    rows = [(i, "http://a.org/", "same text " * 200) for i in ids]
    path = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"))
    index = warc.capture_index(warc.read_captures(spark, path)).collect()
    assert {r["page_id"]: r["refers_to"] for r in index} == {i: None if i == max(ids) else max(ids) for i in ids}
    assert [r["captured"] for r in index] == sorted(r["captured"] for r in index) and len(index) == 6


def test_warc_large_records(spark, tmp_path, monkeypatch):
    """Records of several members, small ranges and blocks, one much captured URL, repeated rows."""
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    rng = random.Random(4)
    huge = "".join(rng.choices("abcdefgh", k=17_000_000))
    rows = [(i, "http://hot.org/" if i % 3 else f"http://h{i % 7}.org/{i}", f"page {i % 40} " * 120, 9) for i in range(300)] + [(900, "http://big.org", huge, 9), (901, "http://big.org", huge, 9), (5, "http://hot.org/", "page 5 " * 120, 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, URL_key int").repartition(4)
    index = warc.capture_index(warc.read_captures(spark, warc.write_warc(df, str(tmp_path / "w")))).collect()
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in index]
    assert keys == sorted(keys) and len(keys) == 303
    big = {r["page_id"]: r for r in index if r["page_id"] in (900, 901)}
    assert big[900]["refers_to"] == 901 and big[901]["payload_digest"] == hashlib.sha1(huge.encode()).hexdigest() and big[901]["payload_bytes"] == 17_000_000
    last = {}
    for i, _, html, _ in rows:
        last[html] = max(last.get(html, 0), i)
    want = Counter((i, None if last[html] == i or len(html) < 1000 else last[html]) for i, _, html, _ in rows)
    assert Counter((r["page_id"], r["refers_to"]) for r in index) == want


def test_loser_tree():
    rng = random.Random(2)
    for k in range(7):
        runs = [sorted(rng.choices(range(50), k=rng.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_pii(spark):
    t = "+1 (293) 555-9179, 4111 1111 1111 1111, 1984-02-29, 8.196.197.208, a.b@c.com, 123-45-6789; 4111111111111112 999.1.1.1 1984-02-30"
    df = spark.createDataFrame([(0, t), (1, None), (2, ""), (3, "4111111111111111 x")], "id int, text string")
    out = {r["id"]: r for r in pii.pseudonymize(df, "k").collect()}
    new = out[0]["text"]
    assert out[1]["text"] is None and out[2]["text"] == ""
    for private in ("293) 555", "4111 1111 1111 1111", "1984-02-29", "8.196.197.208", "a.b@", "123-45-6789"):
        assert private not in new
    assert new.endswith("; 4111111111111112 999.1.1.1 1984-02-30")
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0]
    assert out[3]["text"] == card.replace(" ", "") + " x"
    digits = [int(c) for c in card if c != " "][::-1]
    assert sum(digits[::2] + [2 * d - 9 * (d > 4) for d in digits[1::2]]) % 10 == 0
    days = spark.range(2000).selectExpr("cast(date_add(date'1990-01-01', cast(id as int)) as string) text")
    assert pii.pseudonymize(days, "k").select("text").distinct().count() == 2000


def test_tokens(spark, docs, empty):
    from tokenizers import Tokenizer

    extra = docs.union(spark.createDataFrame([(900, "a <|endoftext|> b c é ΣΑΣ it's 12x", "s", "en", 0)], docs.schema)).dropDuplicates(["doc_id", "text"])
    got = tokens.with_crc32(tokens.read_token_ids(spark, tokens.write_token_ids(extra, common.scratch(spark, "ids")))).collect()
    coder, start = Tokenizer.from_file(tokens.default_vocabulary()), 0
    by = {r["doc_id"]: r for r in got}
    for r in sorted(extra.collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"]):
        ids = [*coder.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        g = by[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert tokens.read_token_ids(spark, tokens.write_token_ids(empty, common.scratch(spark, "ids"))).count() == 0


def test_secrets(spark, empty):
    live, copied = "q9Zk3TtL0aPz7XvB2mNc", "E4mpl3K3yThatAllCopy99x"
    rows = [(0, f'é API_KEY = "abcd1234" AKIAABCDEFGHIJKL {"0a" * 20} {live}', "a"), (1, copied, "a"), (2, copied, "b"), (3, copied, "c"), (4, None, None), (5, "token: short", "a")]
    out = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"), repo_cols=("source",)).collect()}
    assert (out[0]["n_assign"], out[0]["n_access"], out[0]["n_hex"]) == (1, 1, 1) and out[0]["spans"].startswith("assign:2:21,access:23:39,hex:40:80,entropy:81:")
    assert out[1]["spans"] == "" and out[1]["n_example"] == 1 and out[4]["spans"] == "" and out[5]["n_assign"] == 0
    assert secrets.find_secrets(empty).count() == 0


def test_simhash(docs, empty):
    from xxhash import xxh64_intdigest

    def print_of(t):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        s = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in s) > len(s))

    rows, got = docs.collect(), simhash.near_duplicates(docs).collect()
    codes = {(r["doc_id"], r["text"]): print_of(r["text"]) for r in rows}
    ids = list(codes)
    group = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if (codes[a] ^ codes[b]).bit_count() <= 2 and group[a] != group[b]:
                old = group[b]
                group = {k: group[a] if v == old else v for k, v in group.items()}
    want = Counter((str(a[0]), f"{codes[a]:016x}", str(min((k[0] for k in ids if group[k] == group[a] and k[0] is not None), default=None))) for a in ((r["doc_id"], r["text"]) for r in rows))
    assert Counter((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_similar_texts(spark):
    rng = random.Random(9)
    base = [f"v{rng.randrange(500)}" for _ in range(200)]
    near = base[:50] + ["changed"] + base[51:]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(reversed(base))), (4, " ".join(base).upper()), (5, None), (6, "")]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 1}


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, texts()[9]), (2, "one"), (3, None), (4, ""), (5, "A B, c"), (5, texts()[10])], "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for r in items.collect():
        w = cut(r["text"])
        for i in range(max(1, len(w) - 12)) if w else []:
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(r["item_id"]))
    want = []
    for r in docs.collect():
        w, hit, seen = cut(r["text"]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    seen |= found
        want.append((str(r["doc_id"]), len(w), len(hit), sorted(seen), bool(hit) and 20 * len(hit) >= len(w)))
    got = [(str(r["doc_id"]), r["n_words"], r["n_hit"], list(r["item_ids"]), r["contaminated"]) for r in decontaminate.decontaminate(docs, items).collect()]
    assert sorted(got) == sorted(want)
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert {r["n_hit"] for r in decontaminate.decontaminate(docs, items.limit(0)).collect()} == {0}
