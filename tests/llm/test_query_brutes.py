"""Queries that SQL cannot express against brute force over the smallest tables, and each pipeline stage."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from terrasheaf.llm import common, decontaminate, mixing, quality, simhash, tokens
from terrasheaf.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"select doc_id, coalesce(text, ''), source from '{SF}/documents.parquet' order by doc_id").fetchall()


def test_tokens(spark, texts):
    from tokenizers import Tokenizer

    coder, start, want = Tokenizer.from_file(tokens.default_vocabulary()), 0, []
    for i, t, _ in texts:
        ids = [*coder.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = QUERIES["op7_token_ids"](spark, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_documents_are_read_without_the_rest(spark, texts):
    """Row indexes and Bloom filters are in the files; a read of some ids pushes them down and takes totals from aside."""
    path = tokens.write_token_ids(spark.read.parquet(f"{SF}/documents.parquet"), common.scratch(spark, "ids"))
    whole = {r["doc_id"]: r for r in tokens.read_token_ids(spark, path).collect()}
    wanted = [texts[3][0], texts[50][0], -5]
    some = tokens.documents(spark, path, wanted)
    assert {r["doc_id"]: r for r in some.collect()} == {i: whole[i] for i in wanted[:2]}
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan or "In(doc_id, [" in plan
    orc = spark.read.orc(path)
    assert orc.count() == len(texts)
    reader = spark._jvm.org.apache.orc.OrcFile
    conf = spark._jsc.hadoopConfiguration()
    name = spark.read.format("binaryFile").option("pathGlobFilter", "*.orc").load(path).select("path").first()["path"]
    file = reader.createReader(spark._jvm.org.apache.hadoop.fs.Path(name), reader.readerOptions(conf))
    assert file.getRowIndexStride() == 1000 and len(file.getStripes()) >= 1 and "doc_id" in str(file.getSchema())


BASE = (
    ("assign", re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
)


def secrets_of(t):
    found = [[(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in rule.finditer(t) if len(m[group]) >= least] for k, (kind, rule, group, least) in enumerate(BASE)]
    return [len(f) for f in found], hashlib.sha256(",".join(x[2] for x in sorted(x for f in found for x in f)).encode()).hexdigest(), {x[2] for f in found for x in f}


def test_secrets(spark):
    sf = "/root/testdata/sf0.01"
    texts = duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r for r in QUERIES["op8_secrets"](spark, sf).collect()}
    assert len(got) == len(texts)
    total = 0
    for i, t in texts:
        counts, digest, spans = secrets_of(t)
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts and r["base_sha256"] == digest
        shown = r["spans"].split(",") if r["spans"] else []
        assert spans <= set(shown) and [int(x.split(":")[1]) for x in shown] == sorted(int(x.split(":")[1]) for x in shown)
        total += sum(counts)
    assert total > 0


def test_simhash(spark, texts):
    from xxhash import xxh64_intdigest

    def code(t):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()).split()
        s = [xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in s) > len(s))

    codes = {i: code(t) for i, t, _ in texts}
    label = {i: i for i in codes}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in codes:
        for b in codes:
            if a < b and (codes[a] ^ codes[b]).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                label[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash"](spark, SF).collect()}
    assert got == {i: (f"{c:016x}", top(i)) for i, c in codes.items()}


def similar(rows, similarity=0.8):
    """doc_id to its component's smallest, by all pairs of five-word shingle sets."""
    sets = {}
    for i, t in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()).split()
        if w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids, near = sorted(sets), 0
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)):
                n = len(x & y)
                if n >= similarity * (len(x) + len(y) - n):
                    near += x != y
                    p, q = sorted((top(a), top(b)))
                    label[q] = p
    return {i: top(i) for i in ids}, near


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_recall_of_near_duplicates(spark, similarity):
    """Against all pairs of sf0.01: every similar pair is joined, and no other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, near = similar([(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()], similarity)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs, similarity=similarity).collect()}
    print(f"similarity {similarity}: {near} pairs of differing sets, all joined: {got == want}")
    assert got == want


EXTRA = "doc_id long, text string, source string, lang string, _gone int, _MIXED_id int, _quality string, _copies int, n_words int"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, repeated ids and rows, clashing names, a very long text."""
    prose = "the quick brown fox jumps over the lazy dog and it runs into the wood that is not far away from the old house of the man with a hat "
    rows = [(1, prose * 2 + "one", "a"), (1, prose + "two and more words for it", "a"), (1, prose * 2 + "one", "a"), (2, prose * 2 + "one", None), (None, prose + "null id and other words", None), (None, None, "b"), (3, "", "b"), (4, " ".join(f"the w{k} of" for k in range(40_000)), "b"), (5, prose.upper(), "a")]
    return spark.createDataFrame([(i, t, s, None, 1, 1, "q", 1, 1) for i, t, s in rows], EXTRA).repartition(2)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, awkward, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, awkward, SF)
    assert out.columns == awkward.columns and out.schema["text"].dataType == awkward.schema["text"].dataType
    assert out.count() > 0 and stage(spark, awkward.limit(0), SF).count() == 0


def test_stages_on_awkward_rows(spark, awkward):
    run = dict(corpus_pipeline.STAGES)
    assert run["near_duplicates"](spark, awkward, SF).filter("doc_id is null").count() == 2
    kept = Counter(r["doc_id"] for r in run["near_duplicates"](spark, awkward, SF).collect())
    assert kept[2] == 0 and kept[1] == 3 and kept[4] == 1
    ids = run["token_ids"](spark, awkward, SF)
    assert ids.columns == ["doc_id", "start", "n_tokens", "ids"] and ids.count() == awkward.count()
    assert run["quality_rules"](spark, awkward, SF).filter("text is null or text = ''").count() == 0


def test_pipeline_stage_by_stage(spark, texts):
    """Every stage's rows are those that brute force or the operator's own verdict name, on what came before it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    run = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    good = common.written(run["quality_rules"](spark, docs, SF), "q")
    assert ids(good) == ids(quality.quality_rules(docs).filter("quality.kept"))
    rows = [(r["doc_id"], r["text"] or "") for r in good.collect()]
    label, _ = similar(rows)
    single = common.written(run["near_duplicates"](spark, good, SF), "n")
    assert ids(single) == sorted(i for i, _ in rows if label.get(i, i) == i)
    clean = common.written(run["decontamination"](spark, single, SF), "d")
    found = decontaminate.decontaminate(single, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(clean) == ids(found.filter("not contaminated"))
    mixed = common.written(run["mixing"](spark, clean, SF), "m")
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    assert Counter(ids(mixed)) == +Counter(plan)
    last = run["token_ids"](spark, mixed, SF).collect()
    assert Counter(r["doc_id"] for r in last) == Counter(ids(mixed))
    ends = sorted((r["start"], r["n_tokens"]) for r in last)
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == Counter(ids(mixed))


def test_secrets_of_awkward_rows(spark):
    """Nulls in every column, repeated rows and ids, a long text, names that clash with the operator's own."""
    from terrasheaf.llm import secrets

    key = 'api_key = "abcd1234efgh"'
    rows = [(1, key, "a", None), (1, key, "a", None), (None, key, None, "en"), (2, None, None, None), (3, "", "b", "en"), (4, "é " * 100_000 + key, "b", "en")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, source string, lang string, found int, ROW int, hash int, n int")
    out = secrets.find_secrets(docs).collect()
    assert Counter((r["doc_id"], r["n_assign"], r["spans"]) for r in out) == Counter([(1, 1, "assign:0:23"), (1, 1, "assign:0:23"), (None, 1, "assign:0:23"), (2, 0, ""), (3, 0, ""), (4, 1, "assign:200000:200023")])
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_scratch_of_a_block_is_removed(spark):
    import os

    with common.passing(spark) as keep:
        lost = common.written(spark.range(3), "lost")
        with common.passing(spark) as inner:
            kept = inner(common.written(spark.range(4), "kept"))
        keep(kept)
    there = lambda df: os.path.isdir(df._scratch.removeprefix("file://"))
    assert there(kept) and not there(lost) and kept.count() == 4
