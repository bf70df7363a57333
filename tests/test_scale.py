"""Steps that must keep to arrays and single exchanges, and give what plain loops give."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenemark import dims, schemas
from scenemark.functions import geometry as G
from scenemark.operators import captions as C
from scenemark.operators import questions as Q
from scenemark.operators import scenes as Sc
from scenemark.operators import scoring as S
from scenemark.operators import similarity as Si


def points(rng, n, spread=1.0):
    return [(rng.random() * spread, rng.random() * spread) for _ in range(n)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_spirals_are_sampled_in_arrays(spark):
    rows = [(0, 0.3, 0.4, 0.01, 0.02, [0.003, 2.0, 0.5], 9.0), (1, 0.1, 0.2, 0.5, -0.1, [0.1, 3.0, 0.0], 4.0), (2, 0.1, 0.2, None, 0.1, [0.1, 3.0, 0.0], 4.0), (3, None, 0.2, 0.5, 0.1, [0.1, 3.0, 0.0], 4.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double, r0 double, g double, p array<double>, top double")
    got = df.select("id", G.spiral_box(G.pt(F.col("x"), F.col("y")), "r0", "g", "p", "top").alias("b"), G.spiral_area("r0", "g", "p", "top").alias("a"))
    assert "999" not in plan_of(got)  # no sequence of samples in the row
    found = {r.id: r for r in got.collect()}
    for i, x, y, r0, g, (e, w, p), top in rows[:2]:
        th = [k * (top / 999.0) for k in range(1000)]
        r = [r0 + (g + e * math.sin(w * t + p)) * t for t in th]
        xs, ys = [x + a * math.cos(t) for a, t in zip(r, th)], [y + a * math.sin(t) for a, t in zip(r, th)]
        assert tuple(found[i].b) == pytest.approx((min(xs), max(ys), max(xs), min(ys)), abs=1e-12)
        th = np.linspace(max(0.0, top - 2 * np.pi), top, 100001)
        assert found[i].a == pytest.approx(np.trapezoid(0.5 * (r0 + (g + e * np.sin(w * th + p)) * th) ** 2, th), rel=1e-6)
    assert found[2].a is None and tuple(found[2].b) == (None,) * 4
    assert found[3].a is not None and found[3].b.min_x is None and found[3].b.min_y is not None


def _scenes(spark):
    rng = random.Random(11)
    rows = [(i % 40, i, points(rng, rng.randint(0, 6), rng.choice([0.2, 1.0]))) for i in range(400)]
    rows += [(99, 1000 + i, points(rng, 4)) for i in range(90)]  # a crowded one
    rows += [(None, 1, points(rng, 4)), (None, 2, points(rng, 4)), (3, None, points(rng, 4)), (3, 4000, None), (3, 4001, points(rng, 4)), (3, 4001, points(rng, 5))]
    return rows, spark.createDataFrame(rows, f"image_id long, shape_idx long, points array<{schemas.POINT}>")


def test_small_scenes_move_once_and_count_as_plain_loops(spark):
    rows, df = _scenes(spark)
    got = Counter(tuple(r) for r in Sc.crossings(df).collect())
    pairs = [(a, b) for a in rows for b in rows if None not in (*a, *b, a[0], a[1]) and a[0] == b[0] and a[1] < b[1] and min(len(a[2]), len(b[2])) >= 2]
    flat = spark.createDataFrame([(b[0], b[1], a[2], b[2]) for a, b in pairs], f"image_id long, shape_idx long, p array<{schemas.POINT}>, q array<{schemas.POINT}>")
    n = flat.groupBy("image_id", "shape_idx").agg(F.sum(Sc.count_crossings(F.col("p"), F.col("q"))).alias("n"))
    found = {(r.image_id, r.shape_idx): r.n for r in n.collect()}
    assert got == Counter((*k, found.get(k, 0)) for k in {r[:2] for r in rows})
    few = Sc.crossings(df.filter("image_id < 40"))
    assert Counter(tuple(r) for r in few.collect()) == Counter({r: c for r, c in got.items() if r[0] is not None and r[0] < 40})
    # the shapes and the sums, of them and of those without a scene
    assert plan_of(Sc.crossings(df.filter("image_id < 40"))).count("Exchange") <= 3


def test_duplicate_pairs_of_plain_loops(spark):
    rng = random.Random(12)
    rows = [(i % 5, i, points(rng, rng.randint(1, 6), 300.0)) for i in range(60)] + [(7, 100 + i, points(rng, 3, 300.0)) for i in range(70)]
    rows += [(1, 500, [(1.0, float("nan"))]), (1, 501, []), (1, 502, None)]
    df = spark.createDataFrame(rows, f"image_id long, seq long, points array<{schemas.POINT}>")
    got = {(r.image_id, r.i, r.j, r.len_i, r.len_j) for r in Si.duplicate_pairs(df, 90.0, 1000.0).collect()}

    def far(a, b):
        gap = lambda p, q: math.dist(p, q)
        return (sum(min(gap(p, q) for q in b) for p in a) + sum(min(gap(p, q) for p in a) for q in b)) / (len(a) + len(b))

    fine = rows[:-3]
    assert got == {(a[0], a[1], b[1], len(a[2]), len(b[2])) for a in fine for b in fine if a[0] == b[0] and a[1] < b[1] and far(a[2], b[2]) < 90}


def test_bleu_counts_grams_in_the_row(spark):
    rng = random.Random(13)
    text = lambda: " ".join(rng.choice("the cat sat on a Mat , . é".split()) for _ in range(rng.randint(0, 30)))
    rows = [(text(), [text() for _ in range(rng.randint(1, 3))]) for _ in range(40)] + [(None, ["a b"]), ("a b c d", None), ("", ["x"]), ("a b", [])]
    df = spark.createDataFrame(rows, "hypothesis string, references array<string>")
    got = S.bleu4(df)
    assert "explode" not in plan_of(got)
    got, want = got.first(), Counter()
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for own, others in rows:
        own, others = (own or "").lower().split(), others and [o.lower().split() for o in others]
        if others is None:
            continue
        for n in range(1, 5):
            most = Counter()
            for o in others:
                most |= grams(o, n)
            want[f"m{n}"] += (grams(own, n) & most).total()
            want[f"t{n}"] += grams(own, n).total()
        want["hl"] += len(own)
    assert {k: got[k] for k in want} == want


def test_profiles_do_not_depend_on_crowds(spark, monkeypatch):
    rng = random.Random(14)
    rows = []
    for i in range(600):
        x, y = rng.random(), rng.random()
        rows.append((None if i % 97 == 0 else i % 30 if i < 400 else 77, i, rng.choice(["line", "circle", "ellipse", "sector", None]), x, y, rng.random(), rng.choice([0.1, 0.2]), None, (x - 0.1, y + 0.1, x + 0.1, y - 0.1)))
    df = spark.createDataFrame(rows, f"image_id long, shape_idx long, type string, cx double, cy double, area double, major_axis double, rotation double, box {schemas.BOX}")
    every = lambda: Counter(repr(r) for r in Q.profiles(df).collect())
    alone = every()
    monkeypatch.setattr(Q, "CROWD", 10)
    assert every() == alone and alone.total() == 32
    # small scenes: one move by scene; before, one by scene and type and one by scene
    monkeypatch.setattr(Q, "CROWD", 4096)
    assert plan_of(Q.profiles(df)).count("hashpartitioning(image_id") <= 3


def test_rule_texts_move_once_by_image(spark):
    rng = random.Random(5)
    keys = [(i, f) for i in ("a", "b", "c", None) for f in ("length", "chomata", "axis_shape", "size", None)]
    some = lambda words, n: [(*rng.choice(keys), rng.choice(words)) for _ in range(n)]
    texts = ["about 3 mm", "2 to 4 mm", "massive, high", "axis straight", "", None]
    out, ref, ratings = some(texts, 40), some(texts, 25), some([1.0, 2.0, None], 30) + [("z", "length", 3.0)]
    frames = [spark.createDataFrame(rows, f"image string, feature string, {v}") for rows, v in ((ratings, "rating double"), (out, "text string"), (ref, "text string"))]
    rules = [f for f in ("length", "chomata", "axis_shape", "size") if f in dims.RULE_FEATURES]
    pairs = [(i, f, a, b) for i, f, a in out for j, g, b in ref if i is not None and (i, f) == (j, g) and f in rules]
    flat = spark.createDataFrame(pairs, "image string, feature string, o string, r string")
    rule = [r.v for r in flat.select(S.rule_rating("feature", F.col("o"), F.col("r")).alias("v")).collect()]
    want = Counter()
    for i, f, v in ratings:
        met = [(b, x) for (j, g, _a, b), x in zip(pairs, rule) if (i, f) == (j, g)]
        want.update((i, f, v if v is None or b is None else x) for b, x in met or [(None, None)])
    got = S.apply_rule_scores(*frames)
    assert Counter(tuple(r) for r in got.collect()) == want
    # frames that lie by image are joined where they are
    lie = [f.repartition(4, "image").groupBy("image", "feature").agg(F.max(f.columns[2]).alias(f.columns[2])) for f in frames]
    assert plan_of(S.apply_rule_scores(*lie)).count("Exchange") == 3


def test_paths_of_small_scenes_move_once(spark):
    rng = random.Random(3)
    at = lambda: rng.choice([0.1, 0.3, 0.5, 0.52, 0.5201, 0.50000001, 0.9, rng.random(), rng.choice([0.4, None])])
    sizes = [rng.randint(1, 12) for _ in range(40)] + [70]
    rows = [
        (rng.choice([i] * 30 + [None]), rng.choice([k, k, k, 0, None]), rng.choice(["a", "b", "c", None]), at(), at(), rng.choice([1.0, 2.0, 3.0, None]), f"{i}:{k}")
        for i, n in enumerate(sizes)
        for k in range(n)
    ]
    df = spark.createDataFrame(rows, "image_id long, shape_idx long, name string, cx double, cy double, weight double, more string")
    got, want = C.shape_paths(df), C._wide_paths(df)
    assert got.columns == want.columns
    found = Counter(tuple(r) for r in got.collect())
    assert found == Counter(tuple(r) for r in want.collect())
    assert max(r[-1].count("::") for r in found) > C.SHALLOW + 2  # scenes that need more than the first levels
    plan = plan_of(C.shape_paths(df.filter("image_id < 40")))
    assert plan.count("Exchange") == 1 and "Join" not in plan
