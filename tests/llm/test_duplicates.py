"""Near-duplicates of texts and vectors against brute force."""

import re

import numpy as np
import pytest

from lodestore.llm import embedding_dup, near_dup
from lodestore.llm.components import components


def roots_of(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return sets, roots_of(len(sets), links)


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (7, 8), (9, 7), (6, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}


@pytest.mark.parametrize("hub", [1, 3, 4096])
def test_components_with_hubs(spark, monkeypatch, hub):
    from lodestore.llm import components as module

    monkeypatch.setattr(module, "HUB", hub)
    monkeypatch.setattr(module, "TASK", 10 * hub)
    rng = np.random.default_rng(hub)
    links = [(0, i) for i in range(1, 40, 2)] + [(50, i) for i in range(51, 70)] + [tuple(map(int, x)) for x in rng.integers(70, 130, size=(35, 2))] + [(69, 39), (200, 201)]
    roots = roots_of(202, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: roots[i] for i in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_against_brute_force(spark, docs, texts):
    sets, roots = brute(texts)
    got = {r.doc_id: r for r in near_dup.link_documents(docs).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), roots[i], roots[i] == i)
    assert len(set(roots)) < len(roots)


def test_salted_pivots(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(near_dup, "SALTED", 3)
    monkeypatch.setattr(near_dup, "SMALL", 2)
    _, roots = brute(texts)
    got = {r.doc_id: r.component_id for r in near_dup.link_documents(docs).collect()}
    assert [got[i] for i in range(len(texts))] == roots


def test_lists_that_still_cross_are_settled(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(near_dup, "ROUNDS", 0)
    monkeypatch.setattr(near_dup, "CHUNK", 5)
    monkeypatch.setattr(near_dup, "LOAD", 300)
    _, roots = brute(texts)
    got = {r.doc_id: r.component_id for r in near_dup.link_documents(docs).collect()}
    assert [got[i] for i in range(len(texts))] == roots


def test_duplicates_of_odd_tables(spark, empty):
    assert near_dup.link_documents(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in near_dup.link_documents(odd).collect()) == [("3", 3, True), ("3", 3, True), ("4", 4, True), ("None", 3, True)]


def test_deduplicate_keeps_columns(spark, docs, texts):
    _, roots = brute(texts)
    left = near_dup.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == [i for i in range(len(texts)) if roots[i] == i]


def test_deduplicate_loses_no_text(spark):
    a, b, c = "a b c d e f g", "h i j k l m n o", "p q"
    data = [(2, a), (5, a), (5, b), (7, c), (7, c), (7, c.upper()), (None, a), (None, "r s t u v w"), (None, "r s t u v w"), (9, ""), (9, ""), (4, None)]
    df = spark.createDataFrame([(i, t, k, "x", "y", 1) for k, (i, t) in enumerate(data)], "doc_id long, text string, fp int, mark string, `group` string, n int")
    left = near_dup.deduplicate(df)
    assert left.columns == df.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in left.collect())
    assert got in [sorted((str(i), str(t)) for i, t in [(2, a), (5, b), (7, x), (None, "r s t u v w"), (9, ""), (9, ""), (4, None)]) for x in (c, c.upper())]


def test_screening_of_blocks_by_sketches():
    """No set of a pair at the threshold is screened out, and few of the others are kept."""
    rng = np.random.default_rng(3)
    sets, comp = [], []
    passage = np.unique(rng.integers(1 << 62, size=60))
    for k in range(120):
        size = int(rng.choice([10, 50, 64, 70, 150, 600]))
        own = np.unique(rng.integers(1 << 62, size=size))
        sets.append(np.union1d(own, passage) if k % 2 else own)
        comp.append(k)
        if k % 5 == 0:  # a partner at the threshold
            away = rng.permutation(sets[-1])[: len(sets[-1]) - int(len(sets[-1]) * 0.14)]
            new = rng.integers(1 << 62, size=int(len(away) * 0.14))
            sets.append(np.union1d(away, new))
            comp.append(1000 + k)
    sketches, n = [s[: near_dup.KEPT] for s in sets], np.array([len(s) for s in sets])
    may = near_dup._may_link(sketches, n, np.array(comp), 75)
    linked = np.zeros(len(sets), dtype=bool)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (n[i] + n[j] - both):
                linked[[i, j]] = True
    assert linked.sum() > 10 and may[linked].all() and may.sum() < 0.8 * len(sets)


@pytest.mark.parametrize("chunk", [1024, 7])
def test_vectors_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dup, "CHUNK", chunk)
    monkeypatch.setattr(embedding_dup, "FEW", min(embedding_dup.FEW, chunk))
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 32))
    data = []
    for i in range(400):
        v = centres[rng.integers(30)] + rng.normal(size=32) * rng.choice([0.0, 0.1, 0.25, 1.0])
        data.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    odd = [(400, None, 1), (401, [0.0] * 32, 1), (402, [float("nan")] * 32, 1), (403, [1.0, None], 0), (404, data[0][1], None), (405, [1.0, 2.0], 0), (406, [2.0, 4.0], 0), (407, [], 0)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, label int")
    unit = np.array([d[1] for d in data])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    label = np.array([d[2] for d in data])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(400, dtype=bool)
    roots = roots_of(400, list(zip(*np.nonzero(np.triu(near)), strict=True)))
    got = {r.vec_id: r for r in embedding_dup.link_vectors(df).collect()}
    found = sum(got[i].n_links for i in range(400))
    assert found >= 0.99 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(400))
    assert np.mean([got[i].component_id == roots[i] for i in range(400)]) >= 0.99
    assert all(got[i].n_links == 0 and got[i].kept for i in (400, 401, 402, 403, 404, 407))
    assert (got[405].n_links, got[406].n_links, got[406].component_id) == (1, 1, 405)


@pytest.mark.parametrize("share", [0.5, 0.7])
def test_links_of_vectors_far_from_the_origin(share):
    """Pairs at the threshold meet as often as promised when the mean holds much of the squared length."""
    rng, n, length = np.random.default_rng(6), 3000, 64
    width, bands, tables = embedding_dup.plan(1 << 16, length, 0.93)
    middle = np.full(length, length**-0.5)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    across = lambda x, y: unit(x - (x * y).sum(axis=1)[:, None] * y)
    first = unit(share**0.5 * middle + (1 - share) ** 0.5 * unit(rng.normal(size=(n, length))))
    # the other of a pair: as far from the mean, at cosine 0.93
    flat = np.tile(middle, (n, 1))
    own = across(first, flat)
    part = (first * flat).sum(axis=1)[:, None]
    turn = (0.93 - part**2) / (1 - part**2)
    second = part * flat + np.sqrt(1 - part**2) * (turn * own + np.sqrt(1 - turn**2) * across(across(rng.normal(size=(n, length)), flat), own))
    assert np.allclose((first * second).sum(axis=1), 0.93)
    model = embedding_dup.learn(first, tables, length)
    model = model if isinstance(model, tuple) else (model,)
    keys = [embedding_dup.band_keys(embedding_dup.encode(x, *model), width, bands) for x in (first, second)]
    found = (keys[0] == keys[1]).any(axis=1).mean()
    print(f"share {share}: width {width}, {tables} tables, recall {found:.4f}")
    assert found >= 0.98


@pytest.mark.parametrize(("length", "floor"), [(64, 0.99), (256, 0.99), (768, 0.99)])
@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_of_links(length, floor, clusters):
    """Links at the threshold that meet in a band and pass the Hamming test, by length and with or without clusters."""
    rng, n = np.random.default_rng(length + clusters), 3000
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    first = rng.normal(size=(n, length))
    if clusters:
        first = rng.normal(size=(clusters, length))[rng.integers(clusters, size=n)] + 0.6 * first
    first = unit(first)
    away = rng.normal(size=(n, length))
    away = unit(away - (away * first).sum(axis=1)[:, None] * first)
    second = 0.93 * first + np.sqrt(1 - 0.93**2) * away
    bits = min(embedding_dup.CODE_BITS, length)
    width, bands, tables = embedding_dup.plan(1 << 16, bits, 0.93)
    model = embedding_dup.learn(first[:2000], tables, bits)
    codes = [embedding_dup.encode(x, model) for x in (first, second)]
    keys = [embedding_dup.band_keys(c, width, bands) for c in codes]
    some = min(embedding_dup.COMPARED, tables)
    close = np.bitwise_count(codes[0][:, :some] ^ codes[1][:, :some]).sum(axis=1) <= embedding_dup.most_apart(some * bits, 0.93)
    met = (keys[0] == keys[1]).any(axis=1)
    print(f"{length} numbers, {clusters} clusters: met {met.mean():.4f}, close {close.mean():.4f}, both {(met & close).mean():.4f}")
    assert (met & close).mean() >= floor


@pytest.mark.parametrize("largest", [10, 10**6, 10**9, 10**12])
def test_the_plan_holds_its_recall_at_any_size(largest):
    width, bands, tables = embedding_dup.plan(largest, 64, 0.93)
    same = (1 - np.arccos(0.93) / np.pi) ** width
    assert 1 - (1 - same) ** (bands * tables) >= embedding_dup.RECALL


def test_vectors_with_repeated_and_null_ids(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(None, a, 1, "x"), (3, a, 1, "x"), (3, b, 1, "x"), (2, b, 1, "y"), (2, b, 1, "y"), (None, b, None, "z")], "vec_id long, embedding array<double>, label int, cid string")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dup.link_vectors(df).collect())
    assert got == sorted([("None", 1, "3", True), ("3", 1, "3", True), ("3", 2, "2", False), ("2", 2, "2", True), ("2", 2, "2", True), ("None", 0, "None", True)])


def test_empty_vectors(spark):
    assert embedding_dup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
