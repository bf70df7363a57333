"""Rollups, embeddings and the pipeline against brute force on odd rows."""

import collections
import math
import random

import numpy as np
import pytest

import corpus_pipeline
from scenemark.llm import exact, fuse, graph, language, mix_query, mixing, simhash, vectors
from scenemark.llm.rollup import Rollup, deletes, inserts, revisions

COUNTS = "source string, lang string, version string, tokens bigint"


def totals(store):
    return {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in store.totals().collect()}


def test_rollup(spark, tmp_path):
    r = random.Random(1)
    draw = lambda n, version: [(r.choice(["a", "b", None]), r.choice(["en", None]), version, r.choice([0, 5, 9, None])) for _ in range(n)]
    first, second = draw(200, "v1"), draw(50, "v1")
    gone, moved = first[:30], second[:20]
    again = [(s, g, "v2", (t or 0) * 2) for s, g, _, t in moved]
    frame = lambda rows: spark.createDataFrame(rows, COUNTS)
    store = Rollup(spark, str(tmp_path / "store"))
    assert totals(store) == {}
    batches = [(1, inserts(frame(first))), (2, inserts(frame(second)).unionByName(deletes(frame(gone)))), (3, revisions(frame(moved), frame(again)))]
    assert [store.commit(*b) for b in batches] == [True] * 3
    assert [store.commit(*b) for b in batches] == [False] * 3
    left = collections.Counter(first + second + again)
    left.subtract(gone + moved)
    want = collections.defaultdict(lambda: [0, 0])
    for (s, g, v, t), n in left.items():
        want[s, g, v][0] += n
        want[s, g, v][1] += n * (t or 0)
    want = {k: tuple(v) for k, v in want.items() if any(v)}
    assert totals(store) == want
    store.compact()
    store.compact()
    assert totals(store) == want and not store.commit(2, batches[1][1])
    (tmp_path / "store" / "batch-4").mkdir()  # a batch that broke off does not count
    assert totals(store) == want
    assert store.commit(4, deletes(frame(first[30:]).unionByName(frame(second[20:])).unionByName(frame(again))))
    assert totals(store) == {}
    assert not store.commit(5, inserts(frame([]))) or totals(store) == {}


def test_late_batches(spark, tmp_path):
    """A batch that comes after a base of larger numbers counts, once."""
    store = Rollup(spark, str(tmp_path / "late"))
    batch = lambda n: inserts(spark.createDataFrame([("a", "en", "v", n)], COUNTS))
    assert store.commit(1, batch(1)) and store.commit(3, batch(30))
    store.compact()
    assert store.commit(2, batch(200)) and totals(store) == {("a", "en", "v"): (3, 231)}
    store.compact()
    assert [store.commit(n, batch(5)) for n in (1, 2, 3)] == [False] * 3 and totals(store) == {("a", "en", "v"): (3, 231)}
    store.compact()
    assert store.commit(0, batch(4000)) and totals(store) == {("a", "en", "v"): (4, 4231)}


def test_fuse_filters():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 60_000):
        keys = r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
        made = fuse.build(np.concatenate((keys, keys[:5])))
        assert fuse.maybe(keys, *made).all()
        others = r.integers(0, 2**63, 50_000, dtype=np.int64).astype(np.uint64)
        assert fuse.maybe(others, *made).mean() < 0.008
        if n > 5000:
            assert len(made[2]) < 1.3 * n


def test_snapshot_screens(spark):
    rows = lambda a, b: spark.createDataFrame([(i, i, f"d{i:08}", f"d{i:08}") for i in range(a, b)], "row long, key long, sha string, digest string")
    snapshot = exact.Snapshot(exact.grouped(rows(0, 3000)), 4)
    told = {r.digest: r.maybe for r in snapshot.screen(exact.grouped(rows(2000, 6000))).collect()}
    assert len(told) == 4000 and all(told[f"d{i:08}"] for i in range(2000, 3000))
    assert sum(told.values()) < 1100


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 60)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(120)] + [(7, 7), (None, 3)]
    root = {}
    for a, b in links:
        if None not in (a, b) and a != b:
            x, y = {a} | root.get(a, set()), {b} | root.get(b, set())
            for n in x | y:
                root[n] = x | y
    changed = True
    while changed:
        changed = False
        for n in root:
            whole = set().union(*(root[m] for m in root[n]))
            if whole != root[n]:
                root[n], changed = whole, True
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {n: min(s) for n, s in root.items()}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def vector_rows():
    r = np.random.default_rng(4)
    rows = []
    for label in (1, 2, None):
        for _ in range(6):
            c = r.normal(size=24)
            for noise in (0, 0, 0.02, 0.05, 0.08, 0.12, 0.3):
                rows.append((label, (c + noise * r.normal(size=24)).tolist()))
    base = rows[0][1]
    rows += [(1, [x * 1e30 for x in base]), (1, [x * 1e-30 for x in base]), (1, [0.0] * 24), (1, None), (1, []), (1, [math.nan] * 24), (1, [math.inf] + base[1:]), (1, [None] + base[1:]), (1, base[:12]), (1, base[:12]), (1, [2.0]), (1, [3.0]), (1, [-3.0])]
    made = [(i * 2, label, v, "x", 1, 2, 3) for i, (label, v) in enumerate(rows)]
    return made + [(None, 1, base, "x", 1, 2, 3), (None, 5, base, "x", 1, 2, 3)]


VECTORS = "vec_id bigint, label int, embedding array<float>, node string, v int, m int, least int"


@pytest.mark.parametrize("block", [1024, 3])
def test_vectors(spark, block):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    unit = []
    for _, label, v, *_ in rows:
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v)
        x = np.array(v, np.float32).astype(float) if ok else None
        unit.append(vectors._unit(x[None])[0] if ok and x.any() else None)
    n = len(rows)
    near = [[i != j and unit[i] is not None and unit[j] is not None and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.98 for j in range(n)] for i in range(n)]
    seen = list(range(n))
    for _ in range(n):
        new = [min([seen[i], *(seen[j] for j in range(n) if near[i][j])]) for i in range(n)]
        if new == seen:
            break
        seen = new
    want = collections.Counter()
    for i in range(n):
        keys = [rows[j][0] for j in range(n) if seen[j] == seen[i] and rows[j][0] is not None]
        want[(rows[i][0], sum(near[i]), min(keys) if keys else None)] += 1
    got = vectors.near_duplicates(frame, block=block).collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_vector_recall():
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 64))
    y = x + 0.198 * np.linalg.norm(x, axis=1, keepdims=True) * vectors._unit(r.normal(size=x.shape))  # cosine about 0.98
    a, b = vectors.codes(vectors._unit(x)), vectors.codes(vectors._unit(y))
    assert (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() > 0.99
    assert np.allclose(np.linalg.norm(vectors.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_pipeline(spark, small):
    """Each stage against brute force on what the stage before kept."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    given = {r.doc_id: r for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language ID"](spark, docs, small).cache()
    assert one.columns == docs.columns
    accepted = {r.doc_id for r in language.identify(docs).filter("accepted").collect()}
    assert {r.doc_id for r in one.collect()} == accepted and len(accepted) >= 0.98 * len(given)
    groups = collections.defaultdict(list)
    for i in accepted:
        groups[(given[i].text or "").encode().lower()].append(i)
    two = stage["exact dedup"](spark, one, small).cache()
    kept = {r.doc_id for r in two.collect()}
    assert two.columns == docs.columns and kept == {max(v) for v in groups.values()}
    words = {i: (given[i].text or "").encode().lower().split() for i in kept}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    root = {i: i for i in kept}
    links = [(i, j) for i in kept for j in kept if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        new = dict(root)
        for i, j in links:
            new[i] = new[j] = min(new[i], new[j])
        changed, root = new != root, new
    assert links
    three = stage["SimHash near-dedup"](spark, two, small).cache()
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == set(root.values())
    four = stage["source mix"](spark, three, small).cache()
    m = mix_query
    want = {r.doc_id for r in mixing.mix(three, m.levels(), m.WEIGHTS, corpus_pipeline.SHARE, 1, m.SEED).collect()}
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} == want
    five = stage["SentencePiece"](spark, four, small)
    assert {r.doc_id for r in five.collect()} == want
    assert {r.doc_id for r in corpus_pipeline.run(spark, small).collect()} == want
