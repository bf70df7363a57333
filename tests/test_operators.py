"""Brute-force checks of operators without SQL twins, and of skewed inputs."""

import json
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scenemark import schemas
from scenemark.functions import classes as Cl
from scenemark.functions import geometry as G
from scenemark.operators import captions as C
from scenemark.operators import corpus as Co
from scenemark.operators import sampling as Sm
from scenemark.operators import scenes as Sc
from scenemark.operators import similarity as Si
from scenemark.sources import readers as Rd
from scenemark.streaming.predictions import read_sink, stream_predictions


def points(rng, n, spread=1.0):
    return [(rng.random() * spread, rng.random() * spread) for _ in range(n)]


def lines_frame(spark, rows):
    return spark.createDataFrame(rows, f"image_id long, seq long, points array<{schemas.POINT}>")


def mean_dist(a, b):
    d = lambda p, q: ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5
    return (sum(min(d(p, q) for q in b) for p in a) + sum(min(d(p, q) for p in a) for q in b)) / (len(a) + len(b))


def test_dedup_polylines_equals_nested_loops(spark):
    rng = random.Random(5)
    rows, keep = [], []
    for image in range(6):
        base = [points(rng, rng.randint(2, 6), 900) for _ in range(4)]
        lines = []
        for s in range(12):
            src = rng.choice(base)
            lines.append([(x + rng.random() * 120, y + rng.random() * 120) for x, y in src[: rng.randint(2, len(src))]])
        flags = [True] * len(lines)
        for i in range(len(lines)):
            if not flags[i]:
                continue
            for j in range(i + 1, len(lines)):
                if flags[j] and mean_dist(lines[i], lines[j]) < 100:
                    if len(lines[i]) >= len(lines[j]):
                        flags[j] = False
                    else:
                        flags[i] = False
                        break
        rows += [(image, s, [tuple(p) for p in ln]) for s, ln in enumerate(lines)]
        keep += [(image, s) for s, f in enumerate(flags) if f]
    got = Si.dedup_polylines(lines_frame(spark, rows), 100.0, 1100.0)
    assert sorted((r["image_id"], r["seq"]) for r in got.collect()) == sorted(keep)


def test_chain_of_duplicates_is_one_cluster(spark):
    n = 60
    pairs = spark.createDataFrame([(1, i, i + 1, 3, 3) for i in range(n)], "image_id long, i long, j long, len_i int, len_j int")
    comp = Si._components(pairs)
    assert {r["comp"] for r in comp.collect()} == {0} and comp.count() == n + 1


def test_greedy_batches_equal_the_sequential_fill(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 500)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, length int")
    got = Co.greedy_batches(df, 4, 4, "s").toPandas()
    ln = dict(rows)
    for _, g in got.groupby("mega"):
        ids = sorted(g["id"], key=lambda i: (-ln[i], i))
        chunk = dict(zip(g["id"], g["chunk"]))
        if len(ids) % 4:
            assert [chunk[i] for i in ids] == [k % 4 for k in range(len(ids))]
            continue
        total, size = [0.0] * 4, [0] * 4
        for i in ids:
            c = int(np.argmin(total))
            assert chunk[i] == c
            size[c] += 1
            total[c] = float("inf") if size[c] == len(ids) // 4 else total[c] + ln[i]
    assert got["id"].nunique() == 100


def test_snake_chunks_are_even(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.randint(1, 1000)) for i in range(320)], "id long, length int")
    pdf = Co.length_batches(df, 8, 4, "s").toPandas()
    sums = pdf.groupby(["mega", "chunk"])["length"].sum().unstack()
    assert (sums.max(axis=1) / sums.min(axis=1)).max() < 1.5


def test_segments_intersect(spark):
    def hit(a, b, c, d):
        p = [G.pt(*map(float, x)) for x in (a, b, c, d)]
        return spark.range(1).select(G.segments_intersect(*p)).first()[0]

    assert hit((0, 0), (1, 1), (0, 1), (1, 0))
    assert not hit((0, 0), (1, 0), (0, 1), (1, 1))
    assert hit((0, 0), (1, 0), (0.5, 0), (2, 0))
    assert not hit((0, 0), (1, 0), (2, 0), (3, 0))
    assert hit((0, 0), (1, 0), (1.05, -1), (1.05, 1))  # within the tolerance
    assert not hit((0, 0), (1, 0), (1.2, -1), (1.2, 1))


@pytest.mark.parametrize("per_cell", [1, 4, 1000])
def test_crossings_do_not_depend_on_the_cells(spark, per_cell):
    rng = random.Random(3)
    rows = [(i % 3, i, points(rng, rng.randint(2, 6), rng.choice([0.01, 0.2, 1.0, 30.0]))) for i in range(60)]
    df = lines_frame(spark, rows).withColumnRenamed("seq", "shape_idx")
    want = {(r["image_id"], r["shape_idx"]): r["crossings"] for r in Sc.crossings(df, 10**6).collect()}
    got = {(r["image_id"], r["shape_idx"]): r["crossings"] for r in Sc.crossings(df, per_cell).collect()}
    assert got == want and sum(want.values()) > 0


def test_levels_follow_each_scene(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3900, 1).otherwise(F.col("id")).alias("image_id"), "id")
    assert [tuple(r) for r in Sc.scene_levels(df).collect()] == [(1, 4)]


def test_cells_of_a_scene_of_a_million_shapes(spark):
    """Small boxes: no cell that pairs are sought in holds many, and a box lies in few."""
    x, y = (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**6)) / 1e6 for k in (1, 2))
    df = spark.range(1_000_000).select(F.lit(7).alias("image_id"), "id", G.box(x, y + 0.002, x + 0.002, y).alias("box"))
    cells = Sc.box_cells(df, F.struct("id", "box")).filter("own = level")
    fullest, rows = cells.groupBy("level", "x", "y").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert fullest < 100 and rows < 4_000_000


def test_ranks_of_a_hot_group(spark):
    """A third of all rows in one group: ranks stay dense and ordered."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"), "id", ((F.col("id") * 7919) % 9973).alias("v"))
    got = Sm.ordered_rank(df, ["g"], F.col("v"), ["id"], "r").toPandas()
    want = got.sort_values(["g", "v", "id"]).groupby("g").cumcount() + 1
    assert (got.loc[want.index, "r"] == want).all()
    hashed = Sm.hash_rank(df, ["g"], ["id"], "s", "r").toPandas()
    assert all(sorted(x["r"]) == list(range(1, len(x) + 1)) for _, x in hashed.groupby("g"))


def test_forward_fill_equals_pandas(spark):
    rng = random.Random(4)
    rows = [(i % 4, i, rng.randint(1, 9) if rng.random() < 0.2 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, o long, v int")
    got = Sm.forward_fill(df, ["g"], F.col("o"), "v", ["o"], 1).toPandas().sort_values(["g", "o"])
    pdf = pd.DataFrame(rows, columns=["g", "o", "v"]).sort_values(["g", "o"])
    assert list(got["v"]) == list(pdf.groupby("g")["v"].ffill().fillna(1).astype(int))


def test_seq_id_is_dense_over_partitions(spark):
    df = spark.range(1000).repartition(13).select((999 - F.col("id")).alias("k"))
    got = Sm.with_seq_id(df, ["k"]).toPandas()
    assert (got["k"] == got["id"]).all()


def test_few_shot_gives_k_distinct_demos(spark):
    test = spark.range(50).withColumnRenamed("id", "t")
    train = spark.range(7).select(F.col("id").alias("demo"))
    pdf = Sm.few_shot(test, train, 3, "s", "t", ["demo"]).toPandas()
    assert (pdf.groupby("t")["demo"].nunique() == 3).all() and len(pdf) == 150


def test_weighted_sampling_prefers_heavy_rows(spark):
    df = spark.range(2000).select((F.col("id") / 2).cast("int").alias("g"), "id", F.when(F.col("id") % 2 == 0, 9).otherwise(1).alias("w"))
    pdf = Sm.sample_weighted(df, ["g"], "w", 1, "s", ["id"]).toPandas()
    assert 0.85 < (pdf["id"] % 2 == 0).mean() < 0.95


def test_coil_phrase_follows_the_runs(spark):
    def say(*labels):
        df = spark.createDataFrame([(list(labels),)], "l array<string>")
        return df.select(C.coil_phrase(F.col("l"))).first()[0]

    t, m, x = "tightly coiled", "moderately coiled", "loosely expanded"
    assert say() == "moderately coiled"
    assert say(t, t) == t
    assert say(t, t, x) == f"{t} in first 3 volutions while {x} in outer volutions"
    assert say(m, x) == f"{x} in outer volutions"
    assert say(t, m) == f"{t} in first 2 volutions"
    assert say(t, x, t) == t


def test_llama_rendering(spark):
    turns = [("human", "hi"), ("gpt", "yo"), ("human", "bye"), ("gpt", "ok")]
    df = spark.createDataFrame([(turns,)], f"c {schemas.TURNS}")
    tpl = dict(style="llama2", system="Sys.", sep="<s>", sep2="</s>")
    got = df.select(Co.render("c", tpl)).first()[0]
    want = "[INST] <<SYS>>\nSys.\n<</SYS>>\n\nhi [/INST] yo </s><s>[INST] bye [/INST] ok </s>"
    assert got == want
    assert df.select(Co.render_plain_pair("c", "\n")).first()[0] is None


def test_spiral_area_against_quadrature(spark):
    r0, g, (e, w, p), top = 0.01, 0.02, (0.003, 2.0, 0.5), 9.0
    th = np.linspace(top - 2 * np.pi, top, 200001)
    r = r0 + (g + e * np.sin(w * th + p)) * th
    want = np.trapezoid(0.5 * r * r, th)
    got = spark.range(1).select(
        G.spiral_area(F.lit(r0), F.lit(g), F.array(F.lit(e), F.lit(w), F.lit(p)), F.lit(top))
    ).first()[0]
    assert got == pytest.approx(want, rel=1e-6)


def test_stream_appends_each_key_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema, key = "model string, image_id long, response string", ("model", "image_id")
    (tmp_path / "in").mkdir()

    def drop(name, ids):
        lines = [json.dumps({"model": "m", "image_id": i, "response": f"r{i}"}) for i in ids]
        (tmp_path / "in" / name).write_text("\n".join(lines))

    drop("a.json", range(10))
    stream_predictions(spark, src, out, ck, schema, key).awaitTermination()
    drop("b.json", range(5, 20))
    stream_predictions(spark, src, out, ck, schema, key).awaitTermination()
    drop("c.json", [0, 3, 25, 25])  # the checkpoint is lost, the files are read again
    stream_predictions(spark, src, out, str(tmp_path / "ck2"), schema, key).awaitTermination()
    got = Counter(r["image_id"] for r in read_sink(spark, out, schema).collect())
    assert got == Counter([*range(20), 25])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_stream_state_needs_no_python(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema, key = "model string, image_id long, response string", ("model", "image_id")
    (tmp_path / "in").mkdir()

    def drop(name, keys):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"model": m, "image_id": i, "response": name}) for m, i in keys))

    def run(checkpoint):
        q = stream_predictions(spark, src, out, str(tmp_path / checkpoint), schema, key, 1)
        q.awaitTermination()
        return {o.operatorName for p in q.recentProgress for o in p.stateOperators}

    drop("a.json", [("m", 1), ("m", None), (None, 1), ("m", 1), ("null", 1)])
    drop("b.json", [("m", 2), ("m", None)])
    assert run("ck") == {"dedupe"}
    drop("c.json", [(None, 1), ("m", None), (None, None), ("m", 2), ("m", 3)])  # and the checkpoint is lost
    run("ck2")
    drop("d.json", [("m", 3), ("m", 4), (None, None)])
    run("ck2")
    rows = read_sink(spark, out, schema).collect()
    got = Counter((r["model"], r["image_id"]) for r in rows)
    assert got == Counter([("m", 1), ("m", None), (None, 1), ("null", 1), ("m", 2), (None, None), ("m", 3), ("m", 4)])
    assert {r["response"] for r in rows if r["image_id"] == 4} == {"d.json"}


def test_read_any_rejects_other_suffixes(spark):
    with pytest.raises(ValueError):
        Rd.read_any(spark, "x.xml", "a int")


def test_scene_records(spark):
    scene = {
        "image_id": 1,
        "shapes": [
            {"type": "polygon", "points": [{"x": 0.1, "y": 0.1}, {"x": 0.5, "y": 0.1}, {"x": 0.1, "y": 0.5}], "special_info": ""},
            {"type": "segment", "points": [{"x": 0.0, "y": 0.0}, {"x": 0.6, "y": 0.8}]},
            {"type": "ellipse", "center": {"x": 0.5, "y": 0.5}, "major_axis": 0.4, "minor_axis": 0.4, "special_info": "circle "},
        ],
        "relations": [{"head": 0, "tail": 1, "relation": "tangent line"}],
    }
    df = spark.createDataFrame([(json.dumps(scene),)], "v string").select(F.from_json("v", schemas.SCENES).alias("s")).select("s.*")
    e = {r["type"]: r for r in Sc.enrich(Sc.explode_scenes(df)).collect()}
    assert set(e) == {"triangle", "line", "circle"}
    assert e["triangle"]["area"] == 0.08 and e["line"]["area"] == 0 and e["circle"]["area"] == 0.13
    assert e["circle"]["box"]["max_x"] == 0.7 and e["line"]["center"]["y"] == 0.4
    assert Sc.explode_relations(df).first()["relation"] == "tangent line"


def test_ordered_rank_keeps_types_and_nulls_first(spark):
    big = 2**60
    rows = [("a", big + i, i) for i in (5, 3, 0, 7, 1, 6, 2, 4)] + [("a", None, 99)] + [("b", 1, i) for i in range(200)] + [("b", big * 4, 500), (None, 2, 1)]
    df = spark.createDataFrame(rows, "g string, v bigint, id int").repartition(7)
    got = {(r.g, r.v, r.id): r.seq for r in Sm.ordered_rank(df, ["g"], F.col("v"), ["id"]).collect()}
    for g in ("a", "b", None):
        mine = sorted([r for r in rows if r[0] == g], key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r] for r in mine] == list(range(1, len(mine) + 1))


def test_any_k(spark):
    df = spark.range(5000).select("id", (F.col("id") % 2).alias("g"), (F.col("id") % 10 + 1.0).alias("w"))
    assert Sm.sample_weighted(df, ["g"], "w", 2000, "s", ["id"]).groupBy("g").count().filter("count <> 2000").count() == 0


def test_range_class_join_keeps_equal_rows(spark):
    table = spark.createDataFrame([("low", 0.0, 5.0, 1), ("mid", 5.0, 9.0, 2)], "label string, lo double, hi double, ord int")
    df = spark.createDataFrame([(5.0,), (5.0,), (7.0,), (50.0,)], "v double")
    assert sorted(r.label for r in Cl.range_class_join(df, "v", table).collect()) == ["", "low", "low", "mid"]


def test_one_modality_is_plain_grouping(spark):
    df = spark.createDataFrame([(i, 10 + i * 7 % 13, 10 + i * 7 % 13) for i in range(70)], "id int, length int, modality_length int")
    plain = {r.id: (r.mega, r["rank"], r.chunk) for r in Co.length_batches(df, 4, 4, "s").collect()}
    mixed = {r.id: (r["rank"], r.chunk, r.tail) for r in Co.modality_batches(df, 4, 4, "s").collect()}
    assert {k: (v[1], v[2], False) for k, v in plain.items()} == mixed
