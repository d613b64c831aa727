"""Operators on embeddings against brute force: links in dense and mixed data, codebooks, cover trees, awkward rows."""

import numpy as np
import pytest

from terrasheaf.llm import codebooks, neighbors

KIND = "vec_id long, embedding array<float>, label int, Label2 string"


def clustered(seed=3, width=16):
    """Random rows, chains of near rows, a large group of near copies, exact copies and rows that link with nothing."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    rows = [unit(rng.normal(size=width)) for _ in range(120)]
    for start in range(6):
        x = rows[start]
        for _ in range(5):
            x = unit(x + 0.25 * unit(rng.normal(size=width)))
            rows.append(x)
    hub = unit(rng.normal(size=width))
    rows += [unit(hub + 0.1 * rng.random() * unit(rng.normal(size=width))) for _ in range(150)]
    rows += [unit(hub + 0.4 * rng.random() * unit(rng.normal(size=width))) for _ in range(40)]
    rows += [rows[130]] * 30
    out = [(i, [float(np.float32(3 * c)) for c in x], [None, 1, 1, 1, 2][int(rng.integers(5))], "x") for i, x in enumerate(rows)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * width, [nan] + [1.0] * (width - 1), [inf] * width, [None] + [1.0] * (width - 1), [1.0, 0.0], [1.0, 0.01], [3e38, 3e36], [1e-30, 1e-32], [1.0] * (width + 3), [1.0] * (width + 3)]
    return out + [(1000 + k, v, 1, None) for k, v in enumerate(odd)]


def brute_links(rows, least):
    """{vec_id: (n_links, component)}"""
    fine = [(i, np.array(v, np.float64), lab) for i, v, lab, _ in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v))]
    near = {i: set() for i, *_ in rows}
    for i, a, la in fine:
        for j, b, lb in fine:
            if i != j and la == lb and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                near[i].add(j)
    root = {}
    for i in sorted(near):
        todo = [] if i in root else [i]
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = i
                todo += near[k]
    return {i: (len(near[i]), root[i]) for i in near}


@pytest.mark.parametrize(("lists", "block", "balls"), [(2048, 2048, 16), (40, 25, 16), (40, 25, 10**9)])
def test_links(spark, monkeypatch, lists, block, balls):
    for name, value in (("LIST_ROWS", lists), ("BLOCK_ROWS", block), ("CHUNK_ROWS", 2 * block), ("BALL_ROWS", balls)):
        monkeypatch.setattr(neighbors, name, value)
    rows = clustered()
    got = neighbors.near_vectors(spark.createDataFrame(rows, KIND).repartition(3)).collect()
    want = brute_links(rows, neighbors.MIN_COSINE)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want and len(got) == len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert max(n for n, _ in want.values()) > 100 and len({c for _, c in want.values()}) > 100


def test_links_in_few_dimensions(spark, monkeypatch):
    """Rows in a plane: differences lie along the lines between centroids, where too few probes would lose links."""
    monkeypatch.setattr(neighbors, "LIST_ROWS", 20)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(np.cos(a))), float(np.float32(np.sin(a)))], 1, "x") for i, a in enumerate(rng.random(300) * 6.2)]
    got = neighbors.near_vectors(spark.createDataFrame(rows, KIND), min_cosine=0.999).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_links(rows, 0.999)


def test_recall_of_shorter_reach(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "LIST_ROWS", 40)
    rows = clustered(8, 48)
    got = neighbors.near_vectors(spark.createDataFrame(rows, KIND), reach=0.5).collect()
    want = brute_links(rows, neighbors.MIN_COSINE)
    assert sum(r["n_links"] for r in got) >= 0.9 * sum(n for n, _ in want.values()) and all(r["n_links"] <= want[r["vec_id"]][0] for r in got)


def test_links_of_awkward_tables(spark):
    assert neighbors.near_vectors(spark.createDataFrame([], KIND)).collect() == []
    rows = [(None, [1.0, 2.0], 1, "a"), (7, [1.0, 2.0], 1, "b"), (7, [1.0, 2.0], 1, "b"), (8, [2.0, 4.0], 1, "c"), (None, [0.0], 1, "d")]
    got = neighbors.near_vectors(spark.createDataFrame(rows, KIND)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in got) == [("7", 3, 7, True), ("7", 3, 7, True), ("8", 3, 7, False), ("None", 0, None, True), ("None", 3, 7, False)]
    alone = neighbors.near_vectors(spark.createDataFrame([(1, None, 1, "a")], KIND)).collect()
    assert [tuple(r) for r in alone] == [(1, 0, 1, True)]


def brute_codes(rows, entries=256, rounds=4, parts=4):
    kept = [(i, [int(np.floor(1024 * np.float64(c))) for c in v], lab) for i, v, lab, _ in rows if v is not None and None not in v and np.isfinite(v).all()]
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    first = sorted(kept, key=lambda r: r[0])[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min((gap(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        own = [[nearest(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), o in zip(kept, own, strict=True) if o[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = {i: [nearest(v, p) for p in range(parts)] for i, v, _ in kept}
    error = {i: sum(d for d, _ in x) for i, x in last.items()}
    total = {}
    for i, _, lab in kept:
        total[lab] = total.get(lab, 0) + error[i]
    labels = {i: lab for i, _, lab in kept}
    return {i: ("".join(f"{k:02x}" for _, k in x), error[i], total[labels[i]]) for i, x in last.items()}, books


@pytest.mark.parametrize(("entries", "shard"), [(256, 4096), (5, 64), (1, 7)])
def test_codebooks(spark, monkeypatch, entries, shard):
    monkeypatch.setattr(codebooks, "SHARD_ROWS", shard)
    rows = [r for r in clustered() if r[1] is None or len(r[1]) == 16]
    got, books = codebooks.compress(spark.createDataFrame(rows, KIND).repartition(3), entries=entries)
    want, theirs = brute_codes(rows, entries)
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got.collect()} == want
    assert books.tolist() == theirs


def test_cover_tree():
    """Points lie within a node's radius, children part their node's points, siblings stand apart, assignments are exact."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-900, 900, (200, 3)), rng.integers(0, 8, (400, 3)), np.full((300, 3), 5)])
    tree = codebooks.CoverTree.build(points)
    for k, (center, first, last, kids, n) in enumerate(tree.nodes):
        own = points[tree.order[first:last]]
        assert np.sqrt(((own - points[center]) ** 2).sum(axis=1)).max() <= tree.radius[k] + 1e-9
        if n:
            below = tree.nodes[kids : kids + n]
            assert below[0][1] == first and below[-1][2] == last and (below[1:, 1] == below[:-1, 2]).all()
            c = points[below[:, 0]].astype(float)
            gaps = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))[~np.eye(n, dtype=bool)]
            assert n == 1 or gaps.min() > tree.radius[k] / codebooks.SHRINK
    assert sorted(tree.order) == list(range(len(points)))
    for scale in (1, 1 << 15):
        entries = points[rng.permutation(len(points))[:40]] * scale
        first, last, entry = tree.assign(points, entries)
        got = np.full(len(points), -1)
        for a, z, e in zip(first, last, entry, strict=True):
            got[tree.order[a:z]] = e
        want = ((points[:, None].astype(object) - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (got == want).all()
        assert scale > 1 or len(first) < 0.7 * len(points)  # many subtrees go whole


def test_codebooks_of_awkward_tables(spark):
    out, books = codebooks.compress(spark.createDataFrame([], KIND))
    assert out.collect() == [] and books.size == 0
    rows = [(2, [1.0] * 8, None, "a"), (2, [-1.5] * 8, 3, "b"), (None, [0.25] * 8, 3, "c"), (9, [1.0] * 3, 3, "d"), (10, [1e6] * 8, 4, "e"), (11, [None] * 8, 4, "f"), (12, None, 4, "g")]
    got, books = codebooks.compress(spark.createDataFrame(rows, KIND))
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in got.collect()) == [("10", None, None, None), ("2", "00000000", 0, 0), ("2", "01010101", 0, 0), ("9", None, None, 0), ("None", "02020202", 0, 0)]
    assert sorted(books[0].tolist()) == [[-1536, -1536], [256, 256], [1024, 1024]]
