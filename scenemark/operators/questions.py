"""Multiple-choice questions from enriched scenes.

Every perspective works on one row per scene, the *profile*: statistics per shape type,
so at most one entry per type however many shapes a scene has.  Shapes are reduced to
(scene, type) with map-side combining before anything is shuffled; pairs are pairs of
types, never of shapes; sampling inside a profile is hash order.  After the profile all
six perspectives are narrow projections.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenemark import dims
from scenemark.functions import geometry as G
from scenemark.functions.answers import let
from scenemark.functions.rnd import hash_key, pick_weighted, shuffle_by_hash, u01
from scenemark.functions.wording import (
    canonical_relation,
    clarify_choices,
    inverse_relation,
    parent_name,
    plural_mark,
    quadrant,
)
from scenemark.operators.sampling import hash_rank, top_k, weighted_key
from scenemark.operators.scenes import split_scenes
from scenemark.session import work_partitions

BOX = ("min_x", "max_y", "max_x", "min_y")
QA = "array<struct<question:string,choices:array<string>,answer:string>>"


# --- profile ---------------------------------------------------------------------------


def _region_masks(b: str) -> tuple[Column, Column, Column]:
    """Bit r of the three masks over a box column: candidate in region r, mostly inside,
    mostly outside.  Plain arithmetic, so it stays inside generated code."""
    e = "0.0001D"
    x0, y1, x1, y0 = f"({b}.min_x - {e})", f"({b}.max_y + {e})", f"({b}.max_x + {e})", f"({b}.min_y - {e})"
    area = f"abs(({x1} - {x0}) * ({y1} - {y0}))"

    def share(r, grow):
        a0, b1, a1, b0 = r
        w = f"greatest(0.0D, least({a1 + grow!r}D, {x1}) - greatest({a0 - grow!r}D, {x0}))"
        h = f"greatest(0.0D, least({b1 + grow!r}D, {y1}) - greatest({b0 - grow!r}D, {y0}))"
        return f"({w} * {h} / {area})"

    terms = {"cand": [], "near": [], "far": []}
    for r, (_t, *corners) in enumerate(dims.REGIONS):
        inner, outer, bit = share(corners, 0.0), share(corners, 2 * dims.REGION_MARGIN), 1 << r
        terms["cand"].append(f"IF({outer} >= 0.9999D AND {inner} >= {dims.REGION_INSIDE}D, {bit}, 0)")
        terms["near"].append(f"IF({outer} >= 0.5D, {bit}, 0)")
        terms["far"].append(f"IF({outer} < 0.5D, {bit}, 0)")
    return tuple(F.expr(" + ".join(terms[k])) for k in ("cand", "near", "far"))


def type_stats(shapes: DataFrame) -> DataFrame:
    """(image_id, type) statistics from (image_id, shape_idx, type, cx, cy, box, area,
    major_axis, rotation)."""
    cand, near, far = _region_masks("box")
    # Order by major axis (6 decimals), the earlier shape first on ties, as one number: with
    # plain number buffers the aggregate hashes instead of sorting its input.
    axis = F.bround(F.col("major_axis") * 1000000, 0).cast("decimal(18,0)")
    rank = axis * F.lit("10000000000000000000").cast("decimal(20,0)") - F.col("shape_idx").cast("decimal(19,0)")
    s = shapes.select(
        "image_id", "type", "shape_idx", "cx", "cy", "area",
        F.coalesce("rotation", F.lit(0.0)).alias("rot"),
        *[F.col(f"box.{k}").alias(k) for k in BOX],
        cand.alias("c"), near.alias("m"), far.alias("f"), rank.cast("decimal(38,0)").alias("rank"),
    )
    one = [F.min(k) == F.max(k) for k in ("cx", "cy")]
    return s.groupBy("image_id", "type").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("area").alias("min_area"),
        F.max("area").alias("max_area"),
        *[F.max_by(k, "rank").alias(k) for k in ("shape_idx", "cx", "cy", "area", *BOX)],
        (one[0] & one[1] & ((F.col("type") != "ellipse") | (F.min("rot") == F.max("rot")))).alias("one_spot"),
        F.bit_or("c").alias("cand"),
        F.bit_or("m").alias("near"),
        F.bit_or("f").alias("far"),
    )


def _type_ord(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in dims.SHAPE_TYPES]), kind)


#: Scenes of more shapes are combined before they move.
CROWD = 4096


def _type_lists(st: DataFrame) -> DataFrame:
    entry = F.struct(
        "ord", "type", "n", "min_area", "max_area", "one_spot", "cand", "near", "far",
        F.col("shape_idx").alias("idx"), "cx", "cy", F.struct(*BOX).alias("box"), "area",
    )
    return st.withColumn("ord", _type_ord(F.col("type"))).groupBy("image_id").agg(F.sort_array(F.collect_list(entry)).alias("types"))


def profiles(shapes: DataFrame) -> DataFrame:
    """One row per scene: types (declared order), present, absent and singles.

    The shapes of a scene move once, as they came, and are combined where they arrive; those of
    crowded scenes, and those without a scene, are combined by type before they move."""
    bare = shapes.select("image_id", "shape_idx", "type", "cx", "cy", "box", "area", "major_axis", "rotation")
    n = work_partitions(shapes)
    small, crowded = split_scenes(bare, CROWD)
    p = _type_lists(type_stats(small.repartition(n, "image_id")))
    rest = bare.filter(F.col("image_id").isNull())
    rest = rest if crowded is None else rest.unionByName(crowded)
    p = p.unionByName(_type_lists(type_stats(rest)))
    vocab = F.array(*[F.lit(t) for t in dims.SHAPE_TYPES])
    return (
        p.withColumn("present", F.transform("types", lambda t: t["type"]))
        .withColumn("absent", F.array_except(vocab, F.col("present")))
        .withColumn("singles", F.filter("types", lambda t: t["n"] == 1))
    )


def relation_pairs(shapes: DataFrame, relations: DataFrame) -> DataFrame:
    """Per scene the related type pairs (head type, tail type, last canonical relation); the
    relation is NULL where a pair has only relations that no question names.

    ``relations(image_id, ord, head, tail, relation)``; at most types² pairs per scene."""
    kind = shapes.select("image_id", "shape_idx", "type")
    head = kind.select("image_id", F.col("shape_idx").alias("head"), F.col("type").alias("t1"))
    tail = kind.select("image_id", F.col("shape_idx").alias("tail"), F.col("type").alias("t2"))
    typed = (
        relations.withColumn("rel", canonical_relation("relation"))
        .join(head, ["image_id", "head"])
        .join(tail, ["image_id", "tail"])
    )
    last = typed.groupBy("image_id", "t1", "t2").agg(F.max_by("rel", F.when(F.col("rel").isNotNull(), F.col("ord"))).alias("rel"))
    return last.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("t1", "t2", "rel"))).alias("rels"))


def rejected_relations(relations: DataFrame) -> DataFrame:
    """Relations that need more than two shapes, counted instead of failing the job."""
    return relations.filter(canonical_relation("relation").isNull()).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def with_relations(profile: DataFrame, pairs: DataFrame) -> DataFrame:
    empty = F.array().cast("array<struct<t1:string,t2:string,rel:string>>")
    return profile.join(pairs, "image_id", "left").withColumn("rels", F.coalesce("rels", empty))


# --- array helpers -----------------------------------------------------------------------


def by_hash(arr: Column, seed: str, *fields: str) -> Column:
    """Array of structs in digest order of (image, fields)."""
    tagged = F.transform(
        arr, lambda t: F.struct(hash_key(seed, "image_id", *[t[f] for f in fields]).alias("h"), t.alias("v"))
    )
    return F.transform(F.array_sort(tagged), lambda s: s["v"])


def strings_by_hash(arr: Column, seed: str, *keys) -> Column:
    return shuffle_by_hash(arr, seed, "image_id", *keys)


def qa(question: Column, choices: Column, answer: Column) -> Column:
    return F.struct(question.alias("question"), choices.alias("choices"), answer.alias("answer"))


def say(kind: Column, plural: bool = False) -> Column:
    """Clarified wording of a type, looked up in the scene's prepared names."""
    name = F.try_element_at(F.col("names")["many" if plural else "one"], kind)
    return F.coalesce(name, F.concat(kind, F.lit("s")) if plural else kind)


def with_names(profile: DataFrame) -> DataFrame:
    """Adds the clarified names, singular and plural, of the types that can have children
    (VQA-10); all others keep their name in ``say``."""
    parents = F.array(*[F.lit(t) for t in dims.TYPE_CHILDREN])
    names = lambda plural: F.map_from_arrays(parents, F.array(*[parent_name(t, F.col("present"), plural) for t in dims.TYPE_CHILDREN]))
    return profile.withColumn("names", F.struct(names(False).alias("one"), names(True).alias("many")))


def prepare(profile: DataFrame, seed: str = "vqa") -> DataFrame:
    """Columns that several questions share: evaluated once per scene."""
    df = with_names(profile).withColumn("single_types", F.transform("singles", lambda t: t["type"]))
    pool = F.array(*[F.lit(k) for k in ("TT", "TF", "FT", "FF")])
    df = df.withColumn("pair_kinds", F.slice(strings_by_hash(pool, f"{seed}:exkind"), 1, 2))
    if "rels" in df.columns:
        df = df.withColumn(
            "usable",
            F.filter(
                "rels",
                lambda r: r["rel"].isNotNull()
                & F.array_contains(F.col("single_types"), r["t1"])
                & F.array_contains(F.col("single_types"), r["t2"]),
            ),
        )
    return df


def _labelled(perspective: str, questions: Column) -> Column:
    return F.transform(
        questions,
        lambda q, i: F.struct(F.lit(perspective).alias("perspective"), i.cast("int").alias("question_id"), q.alias("q")),
    )


def ask(profile: DataFrame, perspectives: list[str], seed: str = "vqa") -> DataFrame:
    """Questions of the named perspectives in one pass over the profile."""
    parts = [_labelled(p, PERSPECTIVE_PLANS[p](seed)) for p in perspectives]
    return (
        prepare(profile, seed)
        .select("image_id", F.explode(F.concat(*parts)).alias("x"))
        .select("x.perspective", "image_id", "x.question_id", "x.q.question", "x.q.choices", "x.q.answer")
    )


def _when_list(*items: Column) -> Column:
    """Array of the non-NULL structs."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


# --- VQA-2 counting -----------------------------------------------------------------------


def counting(seed: str = "vqa") -> Column:
    n_sel = dims.MAX_QUESTIONS - 1
    weighted = F.transform(
        "types",
        lambda t: F.struct(
            weighted_key(t["n"].cast("double"), f"{seed}:count", "image_id", t["type"]).alias("k"), t["type"].alias("type"), t["n"].alias("n")
        ),
    )
    chosen = F.transform(F.slice(F.array_sort(weighted), 1, n_sel), lambda s: F.struct(s["type"].alias("type"), s["n"].alias("n")))
    pool = F.when(
        F.size("absent") > 0, F.transform("absent", lambda a: F.struct(a.alias("type"), F.lit(0).cast("bigint").alias("n")))
    ).otherwise(F.transform("types", lambda t: F.struct(t["type"].alias("type"), t["n"].alias("n"))))
    extra = F.slice(by_hash(pool, f"{seed}:zero", "type"), 1, 1)

    def ask(s, i):
        pos = pick_weighted(u01(f"{seed}:cpos", "image_id", i, s["type"]), dims.ANSWER_POSITION_WEIGHTS)
        four = F.sequence(F.lit(0), F.lit(3))
        around = let(
            pos, lambda p: F.transform(four, lambda k: F.greatest(F.lit(0).cast("bigint"), s["n"] + k - p))
        )
        nums = let(around, lambda a: F.when(F.size(F.array_distinct(a)) < 4, four.cast("array<bigint>")).otherwise(a))
        return qa(
            F.concat(F.lit("How many "), say(s["type"], plural=True), F.lit(" are there in the image?")),
            nums.cast("array<string>"),
            s["n"].cast("string"),
        )

    return F.transform(F.concat(chosen, extra), ask)


# --- VQA-3 relation -----------------------------------------------------------------------


def relation(seed: str = "vqa") -> Column:
    """VQA-3; the profile must carry ``rels`` (see with_relations)."""
    picked = F.slice(by_hash(F.col("usable"), f"{seed}:rel", "t1", "t2"), 1, dims.MAX_QUESTIONS - 1)

    def oriented(r):
        flip = (u01(f"{seed}:flip", "image_id", r["t1"], r["t2"]) < 0.5) & inverse_relation(r["rel"]).isNotNull()
        return F.struct(
            F.when(flip, r["t2"]).otherwise(r["t1"]).alias("t1"),
            F.when(flip, r["t1"]).otherwise(r["t2"]).alias("t2"),
            F.when(flip, inverse_relation(r["rel"])).otherwise(r["rel"]).alias("rel"),
        )

    pair_type = "array<struct<t1:string,t2:string,rel:string>>"
    all_pairs = F.flatten(
        F.transform(
            "single_types",
            lambda a: F.transform(
                F.col("single_types"), lambda b: F.struct(a.alias("t1"), b.alias("t2"), F.lit(dims.NONE_CHOICE).alias("rel"))
            ),
        )
    )
    unrelated = F.filter(
        all_pairs,
        lambda p: (p["t1"] != p["t2"])
        & ~F.exists(
            F.col("rels"),
            lambda r: ((r["t1"] == p["t1"]) & (r["t2"] == p["t2"])) | ((r["t1"] == p["t2"]) & (r["t2"] == p["t1"])),
        ),
    )
    none = F.when(
        u01(f"{seed}:none", "image_id") < dims.NO_RELATION_PROB, F.slice(by_hash(unrelated, f"{seed}:nonepair", "t1", "t2"), 1, 1)
    ).otherwise(F.array().cast(pair_type))
    rels = F.array(*[F.lit(r) for r in dims.RELATIONS])

    def ask(p):
        key = [p["t1"], p["t2"]]
        others = F.slice(strings_by_hash(F.filter(rels, lambda r: r != p["rel"]), f"{seed}:rdis", *key), 1, 2)
        real = strings_by_hash(F.concat(F.array(p["rel"]), others), f"{seed}:rshuf", *key)
        fake = F.slice(strings_by_hash(rels, f"{seed}:rdis", *key), 1, 3)
        return qa(
            F.concat(
                F.lit("What is the relationship of the "), say(p["t1"]), F.lit(" to the "),
                say(p["t2"]), F.lit(" in the image?"),
            ),
            F.concat(F.when(p["rel"] == dims.NONE_CHOICE, fake).otherwise(real), F.array(F.lit(dims.NONE_CHOICE))),
            p["rel"],
        )

    return F.transform(F.concat(F.transform(picked, oriented), none), ask)


# --- VQA-4 size ---------------------------------------------------------------------------


def size_choices(value: Column, u: Column) -> Column:
    """struct(choices, answer): four values 0.15 apart inside [0, 1] around ``value``; the
    answer's position is drawn by weight among the feasible ones.  NULL if none is."""
    w = dims.ANSWER_POSITION_WEIGHTS
    at = lambda p, i: value + F.lit(dims.SIZE_STEP) * F.lit(float(i - p))
    ok = [(at(p, 0) >= 0) & (at(p, 0) <= 1) & (at(p, 3) >= 0) & (at(p, 3) <= 1) for p in range(4)]
    weights = F.array(*[F.when(ok[p], F.lit(w[p])).otherwise(0.0) for p in range(4)])

    def place(ws):
        cum = [reduce(lambda a, b: a + b, [F.get(ws, i) for i in range(p + 1)]) for p in range(4)]
        out = None
        for p in range(4):
            cond = (F.get(ws, p) > 0) & (u * cum[3] < cum[p])
            out = F.when(cond, p) if out is None else out.when(cond, p)
        return out

    def text(p):
        c = F.transform(
            F.sequence(F.lit(0), F.lit(3)),
            lambda i: (F.bround(value + F.lit(dims.SIZE_STEP) * (i - p).cast("double"), 2) + 0.0).cast("string"),
        )
        return F.when(p.isNotNull(), F.struct(c.alias("choices"), F.get(c, p).alias("answer")))

    return let(let(weights, place), text)


def size(seed: str = "vqa") -> Column:
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    asked = []
    for dim in dims.DIMENSIONS:
        pool = F.filter("singles", lambda t: t["type"] != "line") if dim == "area" else F.col("singles")
        pick = F.get(by_hash(pool, f"{seed}:size:{dim}", "type"), 0)
        asked.append(_size_question(pick, dim, clip, seed))
    return F.filter(F.array(*asked), lambda x: x.isNotNull())


def _size_question(pick: Column, dim: str, clip, seed: str) -> Column:
    def ask(t):
        b = t["box"]
        value = {
            "horizontal span": F.abs(clip(b["max_x"]) - clip(b["min_x"])),
            "vertical span": F.abs(clip(b["max_y"]) - clip(b["min_y"])),
            "area": t["area"],
        }[dim]
        built = let(value, lambda v: size_choices(v, u01(f"{seed}:spos", "image_id", F.lit(dim))))
        q = F.concat(
            F.lit(f"Suppose that the width and height of the image is 1, which of the following is closest to the {dim} of the "),
            say(t["type"]),
            F.lit("?"),
        )
        return let(
            built,
            lambda c: F.when(
                c.isNotNull(), qa(q, strings_by_hash(c["choices"], f"{seed}:sshuf", F.lit(dim)), c["answer"])
            ),
        )

    return let(pick, lambda t: F.when(t.isNotNull(), ask(t)))


# --- VQA-5/6 location -----------------------------------------------------------------------


_POSITIONS = ["upper left", "upper right", "lower left", "lower right"]


def location(seed: str = "vqa") -> Column:
    n_rel = dims.MAX_QUESTIONS // 2
    n_abs = dims.MAX_QUESTIONS - n_rel
    four = F.array(*[F.lit(p) for p in _POSITIONS])
    placed = F.transform(
        "singles",
        lambda t: F.struct(
            t["type"].alias("t1"), F.lit("").alias("t2"), quadrant(t["cx"], t["cy"], F.lit(0.5), F.lit(0.5)).alias("pos")
        ),
    )
    absolute = F.slice(by_hash(F.filter(placed, lambda s: s["pos"].isNotNull()), f"{seed}:loc", "t1"), 1, n_abs)
    pairs = F.flatten(
        F.transform(
            "singles",
            lambda a: F.transform(
                F.col("singles"),
                lambda b: F.struct(
                    a["type"].alias("t1"), b["type"].alias("t2"),
                    F.when(a["type"] != b["type"], quadrant(a["cx"], a["cy"], b["cx"], b["cy"])).alias("pos"),
                ),
            ),
        )
    )
    relative = F.slice(by_hash(F.filter(pairs, lambda s: s["pos"].isNotNull()), f"{seed}:locrel", "t1", "t2"), 1, n_rel)

    def ask(s):
        a = say(s["t1"])
        return qa(
            F.when(
                s["t2"] == "", F.concat(F.lit("Considering the centroid, where is the "), a, F.lit(" located in the image?"))
            ).otherwise(
                F.concat(
                    F.lit("Considering the centroid, where is the "), a, F.lit(" located relative to the "),
                    say(s["t2"]), F.lit("?"),
                )
            ),
            strings_by_hash(four, f"{seed}:locshuf", s["t1"], s["t2"]),
            s["pos"],
        )

    return F.transform(F.concat(absolute, relative), ask)


# --- VQA-7 reference ------------------------------------------------------------------------


def ref_size(seed: str = "vqa") -> Column:
    """VQA-7a: one question struct or NULL.  A type qualifies if all its members are larger
    (smaller) than all of the anchor's, which is a comparison of per-type extremes."""
    larger = u01(f"{seed}:sattr", "image_id") < 0.5
    m = dims.AREA_MARGIN
    kinds = F.filter("types", lambda t: t["type"] != "line")
    beats = lambda a, b: F.when(larger, a["min_area"] - b["max_area"] >= m).otherwise(b["min_area"] - a["max_area"] >= m)

    def build(ts):
        pairs = F.flatten(
            F.transform(ts, lambda a: F.transform(F.filter(ts, lambda b: beats(a, b)), lambda b: F.struct(a["type"].alias("a"), b.alias("b"))))
        )
        tagged = F.transform(
            pairs, lambda p: F.struct(hash_key(f"{seed}:spair", "image_id", p["a"], p["b"]["type"]).alias("h"), p.alias("p"))
        )
        best = F.array_min(F.transform(tagged, lambda s: F.struct(s["h"].alias("h"), s["p"]["a"].alias("a"), s["p"]["b"]["type"].alias("b"))))
        return let(best, lambda s: F.when(s.isNotNull(), ask(ts, s["a"], s["b"])))

    def ask(ts, a, b):
        anchor = F.get(F.filter(ts, lambda t: t["type"] == b), 0)
        ranked = F.array_sort(
            F.transform(
                F.filter(ts, lambda t: (t["type"] != a) & (t["type"] != b) & beats(anchor, t)),
                lambda t: F.struct(F.when(larger, -t["max_area"]).otherwise(t["min_area"]).alias("k"), t["ord"].alias("o"), t["type"].alias("t")),
            )
        )
        others = F.slice(
            F.concat(F.transform(ranked, lambda s: s["t"]), F.filter("absent", lambda t: t != "line")), 1, 3
        )
        words = F.transform(F.concat(others, F.array(a)), lambda t: say(t))
        text = say(b)
        named = F.when(anchor["n"] == 1, F.concat(F.lit("the "), text)).otherwise(
            F.concat(F.lit("all the "), plural_mark(text, "s"))
        )
        return qa(
            F.concat(
                F.lit("Which of the following is presented in the image and has a "), F.when(larger, "larger").otherwise("smaller"),
                F.lit(" area than "), named, F.lit("?"),
            ),
            strings_by_hash(words, f"{seed}:sizeshuf"),
            say(a),
        )

    return let(kinds, build)


def ref_freq(seed: str = "vqa") -> Column:
    """VQA-7b: one question struct or NULL."""
    more = u01(f"{seed}:fattr", "image_id") < 0.5
    up = F.array_sort(F.transform("types", lambda t: F.struct(t["n"].alias("n"), t["type"].alias("t"))))
    ordered = F.when(more, F.reverse(up)).otherwise(up)

    def build(ts):
        beats = lambda a, b: F.when(more, a["n"] > b["n"]).otherwise(a["n"] < b["n"])
        pairs = F.flatten(
            F.transform(
                ts,
                lambda a: F.transform(
                    F.filter(ts, lambda b: beats(a, b)),
                    lambda b: F.struct(hash_key(f"{seed}:fpair", "image_id", a["t"], b["t"]).alias("h"), a["t"].alias("a"), b["t"].alias("b")),
                ),
            )
        )
        return let(F.array_min(pairs), lambda s: F.when(s.isNotNull(), ask(ts, s["a"], s["b"])))

    def ask(ts, a, b):
        names = F.transform(ts, lambda t: t["t"])
        after = F.slice(names, F.array_position(names, b).cast("int") + 1, F.size(names))
        words = F.transform(
            F.concat(F.slice(F.concat(after, F.col("absent")), 1, 3), F.array(a)), lambda t: say(t)
        )
        return qa(
            F.concat(
                F.lit("Which of the following is presented in the image and appears "), F.when(more, "more").otherwise("less"),
                F.lit(" frequently than "), plural_mark(say(b), "(s)"), F.lit("?"),
            ),
            strings_by_hash(words, f"{seed}:freqshuf"),
            say(a),
        )

    return let(ordered, build)


def ref_direction(seed: str = "vqa") -> Column:
    """VQA-7c: array of question structs, one per direction that has an anchor.

    Candidates are single shapes and the largest of concentric circles or ellipses, so at
    most one per type."""
    round_kinds = ["circle", "ellipse"]
    cands = F.filter(
        "types",
        lambda t: ((t["n"] == 1) & (t["type"] != "line"))
        | ((t["n"] > 1) & t["type"].isin(*round_kinds) & t["one_spot"]),
    )
    order = lambda t: F.struct(
        F.when(t["n"] == 1, 0).when(t["type"] == "circle", 1).otherwise(2).alias("g"), t["idx"].alias("i")
    )
    listed = F.transform(
        F.array_sort(F.transform(cands, lambda t: F.struct(order(t).alias("o"), t.alias("t")))), lambda s: s["t"]
    )

    def related(a, b):
        return F.exists(
            F.col("rels"),
            lambda r: ((r["t1"] == a) & (r["t2"] == b)) | ((r["t1"] == b) & (r["t2"] == a)),
        )

    def one(ts, way):
        text, vx, vy = way["text"], way["vx"], way["vy"]
        proj = F.transform(
            ts,
            lambda t, i: F.struct(
                (-(t["cx"] * vx + t["cy"] * vy)).alias("neg"), (-(t["cx"] * vy - t["cy"] * vx)).alias("negp"), i.alias("i"),
                t["type"].alias("type"), t["box"].alias("box"),
            ),
        )

        def find(s):
            top = F.get(s, 0)

            def fits(b, j):
                gap, side = b["neg"] - top["neg"], F.abs(b["negp"] - top["negp"])
                clear = F.forall(
                    F.slice(s, F.lit(2), F.greatest(j - 1, F.lit(0))),
                    lambda m: F.atan2(F.abs(m["negp"] - b["negp"]), F.abs(m["neg"] - b["neg"])) >= dims.DIRECTION_CLEARANCE,
                )
                over = G.overlap_area(top["box"], b["box"])
                apart = (F.coalesce(F.try_divide(over, G.box_area(b["box"])), F.lit(0.0)) <= 0.5) & (
                    F.coalesce(F.try_divide(over, G.box_area(top["box"])), F.lit(0.0)) <= 0.5
                )
                return (
                    (j > 0)
                    & (gap >= dims.DIRECTION_GAP)
                    & (F.atan2(side, F.abs(gap)) <= dims.DIRECTION_DEVIATION)
                    & ~related(top["type"], b["type"])
                    & clear
                    & apart
                )

            anchor = F.get(F.filter(s, fits), 0)
            return let(anchor, lambda b: F.when(b.isNotNull(), ask(ts, text, top["type"], b["type"])))

        return let(F.array_sort(proj), find)

    def ask(ts, text, a, b):
        pool = F.slice(F.concat(F.transform(ts, lambda t: t["type"]), F.col("absent")), 1, 5)
        others = F.slice(F.filter(pool, lambda t: (t != a) & (t != b)), 1, 3)
        words = F.transform(F.concat(others, F.array(a)), lambda t: say(t))
        return qa(
            F.concat(F.lit("Considering the centroid, which of the following is "), text, F.lit(" the "), say(b), F.lit("?")),
            strings_by_hash(words, f"{seed}:dirshuf", text),
            say(a),
        )

    def build(ts):
        ways = F.array(
            *[F.struct(F.lit(t).alias("text"), F.lit(x).alias("vx"), F.lit(y).alias("vy")) for t, x, y in dims.DIRECTIONS]
        )
        qs = F.transform(ways, lambda way: one(ts, way))
        return F.when(F.size(ts) >= 3, F.filter(qs, lambda q: q.isNotNull())).otherwise(F.array().cast(QA))

    return let(listed, build)


def ref_region(seed: str = "vqa") -> Column:
    """VQA-7d: array of question structs, one per region with a candidate."""
    regions = F.array(
        *[F.struct(F.lit(1 << r).alias("bit"), F.lit(text).alias("text")) for r, (text, *_b) in enumerate(dims.REGIONS)]
    )
    return F.filter(F.transform(regions, lambda g: _region_question(g["bit"], g["text"], seed)), lambda q: q.isNotNull())


def _region_question(bit: Column, text: Column, seed: str) -> Column:
    has = lambda v: v.bitwiseAND(bit) > 0
    cand = F.transform(F.filter("types", lambda t: has(t["cand"]) & ~has(t["far"])), lambda t: t["type"])
    answer = F.get(strings_by_hash(cand, f"{seed}:region", text), 0)

    def ask(a):
        free = F.transform(F.filter("types", lambda t: ~has(t["near"]) & (t["ord"] > 0)), lambda t: t["type"])
        words = F.transform(F.concat(F.slice(F.concat(free, F.col("absent")), 1, 3), F.array(a)), lambda t: say(t))
        return qa(
            F.concat(F.lit("Considering the centroid, which of the following is "), text, F.lit("?")),
            strings_by_hash(words, f"{seed}:regshuf", text),
            say(a),
        )

    return let(answer, lambda a: F.when(a.isNotNull(), ask(a)))


def combine_reference(direction: Column, region: Column, sized: Column, freq: Column, seed: str = "vqa") -> Column:
    """VQA-7e: location questions of at most two distinct answers, one each, then at most
    three of all."""

    def keyed(arr, name, *fields):
        return F.array_sort(
            F.transform(
                arr, lambda q: F.struct(hash_key(f"{seed}:{name}", "image_id", *[q[f] for f in fields]).alias("h"), q.alias("q"))
            )
        )

    def spatial(both):
        pool = F.filter(both, lambda q: q["answer"] != "line")
        answers = F.slice(
            strings_by_hash(F.array_distinct(F.transform(pool, lambda q: q["answer"])), f"{seed}:refans"), 1, 2
        )
        ordered = keyed(pool, "refpick", "question")
        return F.transform(answers, lambda a: F.get(F.filter(ordered, lambda s: s["q"]["answer"] == a), 0)["q"])

    every = F.concat(let(F.concat(direction, region), spatial), _when_list(sized, freq))
    return F.transform(F.slice(keyed(every, "reffinal", "question"), 1, dims.MAX_QUESTIONS), lambda s: s["q"])


def reference(seed: str = "vqa") -> Column:
    """VQA-7; the profile must carry ``rels``."""
    return combine_reference(ref_direction(seed), ref_region(seed), ref_size(seed), ref_freq(seed), seed)


# --- VQA-8 existence ------------------------------------------------------------------------


def existence(seed: str = "vqa") -> Column:
    present, absent = F.col("present"), F.col("absent")
    draw = lambda arr, name, k: F.slice(strings_by_hash(arr, f"{seed}:{name}"), 1, k)

    def pair(a, b, answer, name):
        flip = u01(f"{seed}:{name}idx", "image_id") < 0.5
        only = lambda t: F.concat(F.lit("No, only the "), t, F.lit(" exists."))
        return qa(
            F.concat(F.lit("Is there a "), a, F.lit(" and a "), b, F.lit(" in the image?")),
            F.array(
                F.lit("Yes, both exist."), F.when(flip, only(b)).otherwise(only(a)), F.when(flip, only(a)).otherwise(only(b)),
                F.lit("No, neither exists."),
            ),
            answer,
        )

    def two(arr, name, answer):
        return let(draw(arr, name, 2), lambda v: pair(say(F.get(v, 0)), say(F.get(v, 1)), F.lit(answer), name))

    kind_has = lambda *ks: F.arrays_overlap(F.col("pair_kinds"), F.array(*[F.lit(k) for k in ks]))
    tt = F.when(kind_has("TT") & (F.size(present) >= 2), two(present, "extt", "Yes, both exist."))
    ff = F.when(kind_has("FF") & (F.size(absent) >= 2), two(absent, "exff", "No, neither exists."))

    def mixed(v):
        p, a = say(v["p"]), say(v["a"])
        swap = u01(f"{seed}:exswap", "image_id") < 0.5
        return pair(
            F.when(swap, a).otherwise(p), F.when(swap, p).otherwise(a), F.concat(F.lit("No, only the "), p, F.lit(" exists.")), "extf"
        )

    drawn = F.struct(F.get(draw(present, "extfp", 1), 0).alias("p"), F.get(draw(absent, "extfa", 1), 0).alias("a"))
    tf = F.when(kind_has("TF", "FT") & (F.size(present) >= 1) & (F.size(absent) >= 1), let(drawn, mixed))
    can_a = (F.size(present) >= 3) & (F.size(absent) >= 1)
    can_p = (F.size(present) >= 1) & (F.size(absent) >= 3)
    ask_absent = F.when(can_a & can_p, u01(f"{seed}:exmc", "image_id") < 0.5).otherwise(can_a)

    def choose(many, one, around_all):
        """Three of one side and one of the other, clarified."""

        def build(v):
            ch = strings_by_hash(F.concat(v["m"], v["o"]), f"{seed}:exmcshuf")
            return clarify_choices(ch, F.get(v["o"], 0), present if around_all else v["m"])

        return let(F.struct(many.alias("m"), one.alias("o")), build)

    mc_absent = let(
        choose(draw(present, "exmcp", 3), draw(absent, "exmca", 1), False),
        lambda c: qa(F.lit("Which of the following is absent in the image?"), c["choices"], c["answer"]),
    )
    mc_present = let(
        choose(draw(absent, "exmca", 3), draw(present, "exmcp", 1), True),
        lambda c: qa(F.lit("Which of the following is present in the image?"), c["choices"], c["answer"]),
    )
    mc = F.when(can_a | can_p, F.when(ask_absent, mc_absent).otherwise(mc_present))
    return _when_list(tt, ff, tf, mc)


# --- VQA-1 dispatch -------------------------------------------------------------------------


PERSPECTIVE_PLANS = {
    "existence": existence,
    "counting": counting,
    "size": size,
    "location": location,
    "reference": reference,
    "relation": relation,
}


def gen_questions(
    shapes: DataFrame, relations: DataFrame, perspectives: list[str] = dims.PERSPECTIVES, seed: str = "vqa"
) -> DataFrame:
    """VQA-1: all perspectives; ``question_id`` is dense per (image, perspective)."""
    profile = profiles(shapes)
    if {"relation", "reference"} & set(perspectives):
        profile = with_relations(profile, relation_pairs(shapes, relations))
    return ask(profile, perspectives, seed)


# --- prompts and survey samples ----------------------------------------------------------------


def questionnaire(
    questions: DataFrame,
    per: int = 10,
    perspectives: list[str] = dims.PERSPECTIVES,
    seed: str = "survey",
    images: DataFrame | None = None,
) -> DataFrame:
    """VQA-13: images in random order, image k asks perspective k mod 6; at most ``per``
    questions each, with the answer's letter.  ``images`` saves a pass over the questions
    where the image list is known."""
    images = questions if images is None else images
    images = hash_rank(images.select("image_id").distinct(), [], ["image_id"], seed, "k")
    names = F.array(*[F.lit(p) for p in perspectives])
    turn = images.select(
        "image_id", "k", F.element_at(names, ((F.col("k") - 1) % len(perspectives) + 1).cast("int")).alias("perspective")
    )
    asked = questions.join(turn, ["image_id", "perspective"])
    letter = F.substring(F.lit("ABCD"), F.array_position("choices", F.col("answer")).cast("int"), F.lit(1))
    return top_k(asked, ["perspective"], [F.col("k"), F.col("question_id")], per).withColumn("key", letter).drop("k")


def mc_prompt(question: Column, choices: Column, instruction: str = dims.EVAL_INSTRUCTION) -> Column:
    """VQA-14: question, lettered choices, instruction."""
    lines = F.transform(choices, lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c))
    return F.concat_ws("\n", question, F.array_join(lines, "\n"), F.lit(instruction))


def rotate_options(df: DataFrame, options: list[str]) -> DataFrame:
    """VQA-15: one row per rotation of the options before the first NULL, letters rotated along."""
    every = F.array(*[F.col(o) for o in options])
    live = F.filter(every, lambda o, i: F.forall(F.slice(every, F.lit(1), i + 1), lambda x: x.isNotNull()))
    n = F.size("_live")
    turn = lambda a: F.concat(
        F.slice(a, F.col("round_id") + 1, n), F.slice(a, F.lit(1), F.col("round_id"))
    )
    letters = F.slice(F.array(*[F.lit(c) for c in "ABCDEFGH"[: len(options)]]), F.lit(1), n)
    return (
        df.withColumn("_live", live)
        .filter(n > 0)
        .withColumn("round_id", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("options", turn(F.col("_live")))
        .withColumn("option_char", turn(letters))
        .drop("_live")
    )


# --- fixed values: benchmark prompt texts ---
CLOSED_PROMPT = "\nPlease directly answer yes or no and nothing else.Answer: "
OPEN_PROMPT = "\n Answer:"
BOXED_PROMPT = (
    'Please solve the problem and put your answer in one "\\boxed{}". '
    'If it is a multiple choice question, only one letter is allowed in the "\\boxed{}".\n'
)
FOUR_CHOICE_PROMPT = "\nA: Please directly answer A, B, C or D and nothing else."


def bench_prompt(df: DataFrame, style: str, language: str | None = None, images: DataFrame | None = None) -> DataFrame:
    """VQA-16: prompts by benchmark style: 'open_closed' (by answer_type), 'boxed' (five
    options lettered) or 'four_choice'.  Rows are filtered by language and by existing
    images before prompts are made, so nothing can shift."""
    if language is not None:
        df = df.filter(F.col("language") == language)
    if images is not None:
        df = df.join(images.select("image"), "image", "left_semi")
    q = F.col("question")
    if style == "open_closed":
        tail = F.when(F.col("answer_type") == "CLOSED", CLOSED_PROMPT).otherwise(OPEN_PROMPT)
        return df.withColumn("prompt", F.concat(F.lit("Question: "), q, tail))
    if style == "boxed":
        lines = F.transform("options", lambda o, i: F.concat(F.lit("("), F.char(i + 65), F.lit(") "), o, F.lit("\n")))
        listed = F.when(F.size("options") == 5, F.array_join(lines, "")).otherwise("")
        return df.withColumn("prompt", F.concat(F.lit(BOXED_PROMPT), q, F.lit("\n"), listed))
    if style == "four_choice":
        return df.withColumn(
            "prompt", F.concat(F.lit("Q: "), q, F.lit("\n"), F.array_join("options", "\n"), F.lit(FOUR_CHOICE_PROMPT))
        )
    raise ValueError(f"unknown prompt style: {style}")


def missing_images(df: DataFrame, images: DataFrame) -> DataFrame:
    """Rows whose image is not listed."""
    return df.join(images.select("image"), "image", "left_anti")
