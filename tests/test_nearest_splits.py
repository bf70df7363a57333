"""Nearest objects, greedy rounds, series and split-aware readers against brute force."""

import itertools
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scenemark import schemas
from scenemark.operators import nearest as N
from scenemark.operators import scenes as Sc
from scenemark.operators import similarity as Si
from scenemark.sources import readers as Rd
from scenemark.sources.splits import json_records, placed_lines


def contours(rng, n, sizes):
    base = rng.random((6, max(sizes), 2))
    made = []
    for i in range(n):
        k = int(rng.choice(sizes))
        made.append(base[i % 6, :k] + rng.normal(0, 0.05, (k, 2)) if i % 3 else rng.random((k, 2)))
    return made


def frame(spark, items, ids):
    return spark.createDataFrame([(int(i), [tuple(map(float, p)) for p in x]) for i, x in zip(ids, items)], f"id long, points array<{schemas.POINT}>").repartition(5)


@pytest.mark.parametrize("metric,sizes", [(N.Hausdorff(), [1, 5, 12, 30]), (N.ShapeContext(6), [8, 20, 32])])
@pytest.mark.parametrize("n,slice_", [(3, 2048), (5, 7)])
def test_nearest_equals_brute_force(spark, monkeypatch, metric, sizes, n, slice_):
    """Copies tie and are ordered by id; a third of the pool is one contour."""
    monkeypatch.setattr(N, "SLICE", slice_)
    rng = np.random.default_rng(1)
    pool, queries = contours(rng, 150, sizes), contours(rng, 20, sizes)
    pool += [pool[0]] * 75
    queries += [pool[0], pool[10]]
    ids = rng.permutation(1000)[: len(pool)]
    got = N.nearest(frame(spark, queries, range(len(queries))), frame(spark, pool, ids), n, metric).collect()
    for q, x in enumerate(queries):
        item = metric.item(x.ravel())
        far = [metric.exact(item, metric.block([metric.item(p.ravel())]), np.inf)[0] for p in pool]
        far = dict(zip(ids.tolist(), metric.report(np.array(far)).tolist()))
        want = sorted((d, i) for i, d in far.items())[:n]
        mine = sorted((r.distance, r.match) for r in got if r.id == q)
        assert [d for d, _ in mine] == pytest.approx([d for d, _ in want], abs=1e-9)
        assert [far[i] for _, i in mine] == pytest.approx([d for d, _ in mine], abs=1e-9) and len({i for _, i in mine}) == n
        if isinstance(metric, N.Hausdorff):  # exact, so ties are settled
            assert mine == want


def test_nearest_of_small_and_empty_pools(spark):
    rng = np.random.default_rng(2)
    q = frame(spark, contours(rng, 3, [9]), range(3))
    two = N.nearest(q, frame(spark, contours(rng, 2, [9]), [5, 6]), 4, N.Hausdorff())
    assert sorted((r.id, r.match) for r in two.collect()) == [(i, m) for i in range(3) for m in (5, 6)]
    none = spark.createDataFrame([(9, None), (8, [])], f"id long, points array<{schemas.POINT}>")
    assert N.nearest(q, none, 2, N.Hausdorff()).collect() == []
    assert N.nearest(none, q, 2, N.Hausdorff()).collect() == []


def test_assignment_is_the_cheapest_permutation():
    rng = np.random.default_rng(0)
    for n in (1, 2, 4, 6):
        for k in range(30):
            c = rng.random((n, n)).round(1 if k % 2 else 6)
            assert N.assign(c) == pytest.approx(min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_shape_context_bound_and_scale():
    rng = np.random.default_rng(3)
    m = N.ShapeContext()
    x = rng.random((32, 2))
    items = m.block([m.item(p.ravel()) for p in [x, x * 7 + 3, *rng.random((60, 32, 2))]])
    far = m.exact(items[0], items, np.inf)
    assert far[1] == pytest.approx(0, abs=1e-6) and (m.pivot(items[0], items) <= far + 1e-12).all()


@pytest.mark.parametrize("metric,most", [(N.Hausdorff(), 0.1), (N.ShapeContext(), 0.5)])
def test_block_bounds_leave_few_pairs_to_compare(monkeypatch, metric, most):
    """Bounds never exceed distances, and only few of a block's objects are compared in full."""
    rng = np.random.default_rng(4)
    items = [metric.item(p.ravel()) for p in rng.normal(0.5, 0.125, (1500, 32, 2))]
    metric.fit(items[:256])
    block, queries = metric.block(items[:1400]), items[1400:1410]
    bounds, exact, compared = metric.bounds(block), metric.exact, []
    monkeypatch.setattr(metric, "exact", lambda item, some, bound: compared.append(len(some)) or exact(item, some, bound), raising=False)
    for q in queries:
        far = exact(q, block, np.inf)
        assert (metric.least(q, bounds, np.inf) <= far + 1e-9).all()
        third = np.sort(far)[2]
        where, best = N._best(metric, 3, q, np.zeros(1), third, block, np.zeros((1400, 1)), bounds)
        assert sorted(where.tolist()) == sorted(np.argsort(far)[:3].tolist()) and best.max() == pytest.approx(third)
    assert sum(compared) < most * len(queries) * len(block)


def test_many_assignments_at_once():
    rng = np.random.default_rng(5)
    for n in (1, 3, 8, 11):
        costs = rng.random((6, n, n)).round(2)
        assert N.assigned(costs) == pytest.approx([N.assign(c) for c in costs])


def greedy(pairs):
    gone = set()
    for i, j, a, b in sorted(pairs):
        if i not in gone and j not in gone:
            gone.add(j if a >= b else i)
    return gone


@pytest.mark.parametrize("kind", ["tree", "chain", "star"])
def test_one_cluster_of_many_lines(spark, kind):
    """One cluster: a random tree of 100,000 lines, a chain whose every pair waits for the one
    before, a hub that all others hang on."""
    rng = random.Random(7)
    n = {"tree": 100_000, "chain": 400, "star": 20_000}[kind]
    length = [rng.randint(2, 5) for _ in range(n)]
    name = list(range(n))
    rng.shuffle(name)
    if kind == "tree":
        links = [(name[rng.randrange(k)], name[k]) for k in range(1, n)] + [tuple(rng.sample(range(n), 2)) for _ in range(n // 2)]
    elif kind == "chain":
        links = [(k, k + 1) for k in range(n - 1)]
    else:
        links = [(n // 2, k) for k in range(n) if k != n // 2]
    pairs = {(min(p), max(p)) for p in links}
    rows = pd.DataFrame([(1, i, j, length[i], length[j]) for i, j in pairs], columns=["image_id", "i", "j", "len_i", "len_j"])
    got = Si.removed_lines(spark.createDataFrame(rows))
    seqs = [r.seq for r in got.collect()]
    assert len(seqs) == len(set(seqs)) and set(seqs) == greedy([(i, j, length[i], length[j]) for i, j in pairs])


@pytest.mark.parametrize("w", [1, 2, 3, 7])
def test_smooth_over_stretches(spark, w):
    rng = random.Random(w)
    rows = [(g, k, rng.random() if rng.random() < 0.9 else None) for g, n in enumerate([1, 2, 6, 27, 28, 29, 200]) for k in range(1, n + 1)]
    df = spark.createDataFrame(rows, "g long, seq long, v double")
    got = Sc.smooth(df, "g", "seq", "v", w, stretch=1).toPandas().sort_values(["g", "seq"])  # stretches of 4 w
    for g, part in got.groupby("g"):
        v = [x for a, _, x in rows if a == g]
        half = w // 2
        for k, x in enumerate(part["smoothed"]):
            near = [y for y in v[max(0, k - half) : k + half + 1] if y is not None]
            want = v[k] if len(v) < w else (sum(near) / len(near) if near else None)
            assert (pd.isna(x) and want is None) or x == pytest.approx(want)


# --- readers -----------------------------------------------------------------------------------


@pytest.fixture
def small_splits(spark):
    """Splits of 2 kB."""
    keys = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def objects(n):
    rng = random.Random(3)
    odd = ["}", "{", '"', "\\", "\n", ",", "[", "]", "é", "}{", '\"}', "x" * 50]
    make = lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, 30)))
    return [{"id": i, "t": make(), "deep": {"a": {"b": make()}, "l": [{"c": make()}, {"c": ""}]}} for i in range(n)]


SCHEMA = "id long, t string, deep struct<a:struct<b:string>,l:array<struct<c:string>>>"


@pytest.mark.parametrize("indent", [None, 1])
def test_json_arrays_in_many_splits(spark, small_splits, tmp_path, indent):
    rows = objects(300)
    (tmp_path / "a.json").write_text(json.dumps(rows[:290], indent=indent))
    (tmp_path / "b.json").write_text("[" + json.dumps(rows[290]) + "]\n")
    (tmp_path / "c.json").write_text("[]")
    path = str(tmp_path)
    assert placed_lines(spark, path, "}").select("file", "split").distinct().count() > 20
    got, rejects = Rd.read_json_records(spark, path, SCHEMA, "nr")
    found = sorted(got.collect(), key=lambda r: r.id)
    assert [json.loads(json.dumps(r.asDict(True), sort_keys=True)) for r in [x for x in found]] == [{**rows[i], "nr": i if i < 290 else 0} for i in range(291)]
    assert rejects.count() == 0


def test_json_maps_in_many_splits(spark, small_splits, tmp_path):
    rows = {f'k"{i}\\}}{{': o for i, o in enumerate(objects(200))}
    (tmp_path / "m.json").write_text(json.dumps(rows))
    got, rejects = Rd.read_json_entries(spark, str(tmp_path), SCHEMA)
    assert {r.key: r.t for r in got.collect()} == {k: v["t"] for k, v in rows.items()} and rejects.count() == 0


def test_broken_json_files(spark, small_splits, tmp_path):
    """What does not fit is rejected with its file; what a file breaks off in too."""
    text = json.dumps(objects(50))
    (tmp_path / "cut.json").write_text(text[: text.index('"id": 40') + 7])
    (tmp_path / "odd.json").write_text('[{"id": "seven"}, {"id": 8}, {"id": 9, }]')
    got, rejects = Rd.read_json_records(spark, str(tmp_path), "id long")
    assert sorted(r.id for r in got.collect()) == sorted([8, *range(40)])
    bad = sorted((r.file.rpartition("/")[2], r.line) for r in rejects.collect())
    assert [b[0] for b in bad] == ["cut.json", "odd.json", "odd.json"] and '"seven"' in bad[1][1]
    assert [r.whole for r in json_records(spark, str(tmp_path / "cut.json"), False).collect()].count(False) == 1


def test_order_of_lines_over_files_and_splits(spark, small_splits, tmp_path):
    rng = random.Random(5)
    names = ["z.jsonl", "a.jsonl", "m.jsonl"]
    want, bad = [], 0
    for name in names:
        lines = []
        for _ in range(400):
            k = rng.randrange(10**9)
            if rng.random() < 0.05:
                lines.append(rng.choice(["", "   ", "{broken"]))
                bad += lines[-1] == "{broken"
            want += [k]
            lines.append(json.dumps({"k": k}))
        (tmp_path / name).write_text("\n".join(lines) + rng.choice(["", "\n"]))
    paths = [str(tmp_path / n) for n in names]
    assert placed_lines(spark, paths[0]).select("split").distinct().count() > 2
    rows, rejects = Rd.read_ordered(spark, paths, "k long", 5)
    assert [r.k for r in sorted(rows.collect(), key=lambda r: r.id)] == want
    assert sorted(r.id for r in rows.collect()) == list(range(5, 5 + len(want))) and rejects.count() == bad


def test_csv_rejects_do_not_depend_on_the_columns_asked_for(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n1,x,2.5\n2,"y ""q"", z",3\nthree,x,1\n4,x\n5,x,1,more\n6,,\n')
    (tmp_path / "b.csv").write_text("a,b,c\n7,x,none\n8,x,1\n")
    rows, rejects = Rd.read_csv_checked(spark, str(tmp_path), "a int, b string, c double")
    assert sorted(r.a for r in rows.select("a").collect()) == [1, 2, 6, 8]
    assert rows.select("b").count() == rows.count() == 4
    assert sorted((r.file.rpartition("/")[2], r.line) for r in rejects.collect()) == [("a.csv", "4,x"), ("a.csv", "5,x,1,more"), ("a.csv", "three,x,1"), ("b.csv", "7,x,none")]
    assert rejects.select("file").count() == 4
    assert rows.filter("a = 2").first().b == 'y "q", z'


def test_kernel_sums_of_many_labels(spark):
    from scenemark.operators import measures as M

    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"l": rng.choice(["a", "b", None, "one"], 400, p=[0.5, 0.3, 0.195, 0.005]), "x": rng.normal(0, 3, 400).round(1)})
    got = M.kde(spark.createDataFrame(pdf, "l string, x double").repartition(4), "l", "x", 20)
    assert "Generate" not in got._jdf.queryExecution().toString()
    at = np.linspace(pdf.x.min(), pdf.x.max(), 20)
    for label in ("a", "b"):
        v = pdf.x[pdf.l == label].to_numpy()
        h = v.std(ddof=1) * len(v) ** -0.2
        want = [np.exp(-0.5 * ((a - v) / h) ** 2).sum() / (h * np.sqrt(2 * np.pi) * 400) for a in at]
        mine = got.filter(F.col("label") == label).orderBy("g").toPandas()
        assert np.allclose(mine["density"], want) and np.allclose(mine["at"], at)
