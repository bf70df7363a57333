"""EVA: answer extraction and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenemark import dims
from scenemark.functions import answers as A
from scenemark.functions.numeric import rnd
from scenemark.operators import scoring as S
from scenemark.plans.fixtures import IMAGE, Spark, ctes, frame, measure_text, spelled
from scenemark.plans.registry import query
from scenemark.session import work_partitions

W = r"[^\p{L}\p{M}\p{N}_]"  # a non-word character for RE2
LAST_LETTER = rf"nullif(regexp_extract(response, '(?s)^(?:.*{W})?([ABCD])(?:{W}.*)?$', 1), '')"


def R(x: str, n: int) -> str:
    """Half-up rounding in DuckDB."""
    return f"cast(round(cast({x} as decimal(38,12)), {n}) as double)"


SCORED = f"""
SELECT *, substr('ABCD', list_position(choices, answer), 1) AS truth,
  coalesce({LAST_LETTER},
    CASE WHEN len([1 for c in choices if contains(response, c)]) = 1
         THEN substr('ABCD', [i for i in range(1, 5) if contains(response, choices[i])][1]::INT, 1) END, '-') AS pred
FROM replies"""
MODELS = ["m0", "m1", "m2", "m3"]


def scored(t):
    r = frame(t, "replies")
    return S.score_predictions(
        r.select(*S.QKEY, "choices", "answer"), r.select("model", *S.QKEY, "response", "truth_idx", "text")
    )


@query(
    "eva_01_pair_outputs",
    """WITH refs AS (SELECT doc_id // 2 AS image, max_by(md5(text), doc_id) AS reference FROM documents GROUP BY 1)
    SELECT d.doc_id AS img, lang AS question, source AS output, reference, reference IS NOT NULL AS matched
    FROM documents d LEFT JOIN refs ON d.doc_id = refs.image""",
)
def _(t):
    d = t.documents
    out = d.select(F.col("doc_id").alias("image"), F.col("lang").alias("question"), F.col("source").alias("response"))
    refs = d.select(
        F.floor(F.col("doc_id") / 2).cast("bigint").alias("image"), F.md5("text").alias("output"), F.col("doc_id").alias("ord")
    )
    pairs, lost = S.pair_outputs(out, refs)
    return pairs.withColumn("matched", F.lit(True)).unionByName(
        lost.select(
            F.col("image").alias("img"),
            "question",
            F.col("response").alias("output"),
            F.lit(None).cast("string").alias("reference"),
            F.lit(False).alias("matched"),
        )
    )


@query(
    "eva_02_find_choice",
    ctes("replies", scored=SCORED) + "SELECT model, image_id, question_id, pred FROM scored",
)
def _(t):
    return frame(t, "replies").select("model", "image_id", "question_id", A.find_choice("response", "choices").alias("pred"))


@query(
    "eva_03_truth_index",
    ctes("replies")
    + "SELECT image_id, question_id, list_position(choices, answer) - 1 AS truth, truth_idx FROM replies",
)
def _(t):
    return frame(t, "replies").select(
        "image_id", "question_id", A.truth_index("choices", "answer").cast("bigint").alias("truth"), "truth_idx"
    )


@query(
    "eva_04_accuracy_pivot",
    ctes("replies", scored=SCORED)
    + "SELECT model, "
    + ", ".join(
        R(f"avg(CASE WHEN perspective = '{p}' THEN (pred = truth)::INT END) * 100", 1) + f" AS {p}"
        for p in dims.PERSPECTIVES
    )
    + " FROM scored GROUP BY model",
)
def _(t):
    return S.accuracy_pivot(scored(t))


@query(
    "eva_05_answer_matrix",
    ctes("replies", scored=SCORED)
    + "SELECT perspective, image_id, question_id, max(truth) AS std, "
    + ", ".join(f"coalesce(max(CASE WHEN model = '{m}' THEN pred END), '-') AS {m}" for m in MODELS)
    + " FROM scored GROUP BY ALL",
)
def _(t):
    return S.answer_matrix(frame(t, "replies"), scored(t), MODELS)


NUM = r"(\d+\.?\d*)"


def _range_sql(c: str) -> str:
    """extract_range for DuckDB: list of doubles or NULL."""
    sc = f"(CASE WHEN regexp_matches({c}, 'μ|microns?') THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END)"

    def pair(p):
        return (
            f"CASE WHEN regexp_matches({c}, '{p}') THEN [regexp_extract({c}, '{p}', 1)::DOUBLE * {sc}, "
            f"regexp_extract({c}, '{p}', 2)::DOUBLE * {sc}] END"
        )

    def every(p, scaled=False):
        m = f"regexp_extract_all({c}, '{p}', 1)"
        f = f" * {sc}" if scaled else ""
        return f"CASE WHEN len({m}) > 0 THEN [x::DOUBLE{f} for x in {m}] END"

    return (
        "coalesce("
        + ", ".join(
            [
                every(f"1:{NUM}"),
                every(f"{NUM}:1"),
                pair(rf"{NUM}\s*-\s*{NUM}"),
                pair(rf"{NUM}\s+to\s+{NUM}"),
                pair(rf"{NUM}\s+or\s+{NUM}"),
                pair(rf"near\s+{NUM}.*?(?:increasing|decreasing)\s+to\s+(?:near\s+)?{NUM}"),
                every(NUM, True),
            ]
        )
        + ")"
    )


def _score_sql(r: str, p: str) -> str:
    m = f"(list_sum({p}) / len({p}))"
    err = (
        f"(CASE WHEN {m} < list_min({r}) THEN (list_min({r}) - {m}) / nullif(list_min({r}), 0) "
        f"WHEN {m} > list_max({r}) THEN ({m} - list_max({r})) / nullif(list_max({r}), 0) ELSE 0.0::DOUBLE END)"
    )
    sc = f"(CASE WHEN {err} > 0.3 THEN 1.0::DOUBLE WHEN {err} < 0.05 THEN 0.0::DOUBLE ELSE ({err} - 0.05::DOUBLE) / (0.3::DOUBLE - 0.05::DOUBLE) END)"
    return f"CASE WHEN {r} IS NULL THEN NULL WHEN {p} IS NULL THEN 0.0 ELSE round_even(10.0::DOUBLE * (1.0::DOUBLE - {sc}), 0) END"


@query(
    "eva_06_extract_range",
    ctes("measure_text", x=f"SELECT image, {_range_sql('ref_text')} AS r FROM measure_text")
    + f"SELECT image, {R('r[1]', 4)} AS lo, {R('r[len(r)]', 4)} AS hi, coalesce(len(r), 0) AS n FROM x",
)
def _(t):
    m = frame(t, "measure_text", heavy=True).select("image", A.extract_range("ref_text").alias("r"))
    return m.select(
        "image",
        rnd(F.get("r", F.lit(0)), 4).alias("lo"),
        rnd(A.last_of(F.col("r")), 4).alias("hi"),
        F.coalesce(F.size("r"), F.lit(0)).cast("bigint").alias("n"),
    )


@query(
    "eva_07_range_score",
    ctes("measure_text", x=f"SELECT image, {_range_sql('ref_text')} AS r, {_range_sql('out_text')} AS p FROM measure_text")
    + f"SELECT image, {_score_sql('r', 'p')} AS score FROM x",
)
def _(t):
    m = frame(t, "measure_text", heavy=True)
    return m.select("image", A.range_score(A.extract_range("ref_text"), A.extract_range("out_text")).alias("score"))


# descriptor texts: fixed phrases chosen by the keys of a line item
_DEV = ["chomata absent", "weakly developed", "massive", "poorly formed, tiny", "well developed", "prominent", "distinct", "indistinct"]
_HW = ["high and broad", "low, narrow", "medium height", "moderate width", "wide", "", "high", "low and wide"]
_AX = ["axis straight", "slightly convex", "concave", "irregular", "curved axis", "sinuous", "bent", ""]


def _phrases(k1: str, k2: str, duck: bool) -> str:
    a = lambda xs: ("[" if duck else "array(") + ", ".join(f"'{x}'" for x in xs) + ("]" if duck else ")")
    nth = lambda xs, k: f"({a(xs)})[({k})::INT + 1]" if duck else f"element_at({a(xs)}, cast({k} as int) + 1)"
    return f"concat({nth(_DEV, k1)}, ' ', {nth(_HW, k2)}, ', ', {nth(_AX, f'({k1} + {k2}) % 8')})"


def _phrase_pair(duck: bool) -> str:
    o = _phrases("l_partkey % 8", "(l_suppkey + l_linenumber) % 8", duck)
    r = _phrases("l_suppkey % 8", "(l_partkey + l_linenumber) % 8", duck)
    return f"{o} AS o, {r} AS r"


def _phrase_select(duck: bool) -> str:
    return f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_phrase_pair(duck)} FROM " + ("lineitem" if duck else "{lineitem}")


def phrases(t):
    return t.sql(_phrase_select(False), "lineitem", heavy=True)


def _case(word: str, table: dict) -> str:
    return "CASE " + word + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _first(c: str, table, bounded=True) -> str:
    body = "|".join(table)
    p = rf"\b({body})\b" if bounded else f"({body})"
    return f"nullif(regexp_extract({c}, '{p}', 1), '')"


def _chomata_sql(c: str, default: str) -> dict[str, str]:
    def dim(table, big, little):
        return (
            f"coalesce({_case(_first(c, table), table)}, CASE WHEN regexp_matches({c}, '\\bmassive\\b') THEN '{big}' "
            f"WHEN regexp_matches({c}, '\\b(small|tiny|minute)\\b') THEN '{little}' ELSE 'moderate' END)"
        )

    return {
        "d": f"coalesce({_case(_first(c, dims.DEVELOPMENT_WORDS, False), dims.DEVELOPMENT_WORDS)}, '{default}')",
        "h": dim(dims.HEIGHT_WORDS, "high", "low"),
        "w": dim(dims.WIDTH_WORDS, "wide", "narrow"),
    }


_LK = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_CH = (
    "WITH p AS (" + _phrase_select(True) + f"), x AS (SELECT {_LK}, "
    + ", ".join(f"{e} AS o{k}" for k, e in _chomata_sql("o", "none").items())
    + ", "
    + ", ".join(f"{e} AS r{k}" for k, e in _chomata_sql("r", "none").items())
    + " FROM p)"
)


@query(
    "eva_08_chomata_rating",
    _CH
    + f"""SELECT {_LK}, od AS development, oh AS height, ow AS width,
    (CASE WHEN od <> rd AND (od = 'absent' OR rd = 'absent') THEN 0
     ELSE (CASE WHEN od = rd OR rd = 'none' THEN 4 ELSE 0 END)
        + (CASE WHEN oh = rh THEN 3 WHEN oh = 'moderate' OR rh = 'moderate' THEN 1 ELSE 0 END)
        + (CASE WHEN ow = rw THEN 3 WHEN ow = 'moderate' OR rw = 'moderate' THEN 1 ELSE 0 END) END)::DOUBLE AS rating FROM x""",
)
def _(t):
    d = A.chomata_descriptor("o", "none")
    return phrases(t).select(
        *_LK.split(", "), d["development"].alias("development"), d["height"].alias("height"), d["width"].alias("width"),
        A.chomata_rating("o", "r").alias("rating"),
    )


@query(
    "eva_09_axis_rating",
    "WITH p AS (" + _phrase_select(True) + f"), x AS (SELECT {_LK}, coalesce({_first('o', dims.AXIS_WORDS)}, 'none') AS o, "
    f"coalesce({_first('r', dims.AXIS_WORDS)}, 'straight') AS r FROM p)"
    + f"""SELECT {_LK}, o AS axis, CASE WHEN o = r OR (o IN ('convex','concave','curved') AND r IN ('convex','concave','curved'))
    OR (o IN ('irregular','sinuous') AND r IN ('irregular','sinuous')) THEN 10.0 ELSE 0.0 END AS rating FROM x""",
)
def _(t):
    return phrases(t).select(*_LK.split(", "), A.axis_shape("o", "none").alias("axis"), A.axis_rating("o", "r").alias("rating"))


@query(
    "eva_10_tunnel_shape",
    "WITH p AS (" + _phrase_select(True) + ")"
    + f"SELECT {_LK}, coalesce({_case(_first('o', dims.HEIGHT_WORDS), dims.HEIGHT_WORDS)}, 'moderate') AS height, "
    f"coalesce({_case(_first('o', dims.WIDTH_WORDS), dims.WIDTH_WORDS)}, 'moderate') AS width FROM p",
)
def _(t):
    s = A.tunnel_shape("o")
    return phrases(t).select(*_LK.split(", "), s["height"].alias("height"), s["width"].alias("width"))


# long-form features: one image per line item, three rule features and one judged feature
_FEATS = ["length", "chomata", "axis_shape", "size"]


def _features(t):
    # the phrases follow from the key: both texts are written on the line item, where it is moved to
    key = _LK.split(", ")
    lines = t.lineitem.select(*key, "l_quantity").dropna(subset=key)
    moved = lines.repartition(work_partitions(lines), F.expr(spelled(IMAGE)))
    text = spelled(measure_text(Spark)).replace("FROM {lineitem}", f", {_phrase_pair(False)} FROM {{lineitem}}")
    m = t.spark.sql(text, lineitem=moved)
    # line items may repeat a key: one image per key
    j = m.groupBy("image").agg(*[F.min(c).alias(c) for c in ("out_text", "ref_text", "o", "r", "l_suppkey")])
    long = lambda texts: j.select(
        "image",
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(c).alias("text")) for f, c in zip(_FEATS, texts)])).alias("x"),
        F.col("l_suppkey"),
    ).select("image", "x.feature", "x.text", "l_suppkey")
    out, ref = long(["out_text", "o", "o", "o"]), long(["ref_text", "r", "r", "r"])
    ratings = out.select(
        "image", "feature", F.when(F.col("l_suppkey") % 5 > 0, (F.col("l_suppkey") % 11).cast("double")).alias("rating")
    )
    return out.drop("l_suppkey"), ref.drop("l_suppkey"), ratings


def _long_sql(texts):
    return " UNION ALL ".join(
        f"SELECT image, '{f}' AS feature, {c} AS text, l_suppkey FROM j" for f, c in zip(_FEATS, texts)
    )


_FEATURE_CTES = (
    ctes("measure_text", p=_phrase_select(True), j=f"SELECT image, min(out_text) AS out_text, min(ref_text) AS ref_text, min(o) AS o, min(r) AS r, min(l_suppkey) AS l_suppkey FROM measure_text JOIN p USING ({_LK}) GROUP BY 1")
    + ", out AS ("
    + _long_sql(["out_text", "o", "o", "o"])
    + "), ref AS ("
    + _long_sql(["ref_text", "r", "r", "r"])
    + "), both_ AS (SELECT a.image, a.feature, a.text AS o, b.text AS r, "
    "CASE WHEN a.l_suppkey % 5 > 0 THEN (a.l_suppkey % 11)::DOUBLE END AS rating "
    "FROM out a JOIN ref b USING (image, feature))"
)


def _rated_sql() -> str:
    c, d = _chomata_sql("o", "none"), _chomata_sql("r", "none")
    return (
        _FEATURE_CTES
        + f", y AS (SELECT *, {_range_sql('r')} AS rr, {_range_sql('o')} AS pr, "
        + ", ".join(f"{e} AS o{k}" for k, e in c.items())
        + ", "
        + ", ".join(f"{e} AS r{k}" for k, e in d.items())
        + f", coalesce({_first('o', dims.AXIS_WORDS)}, 'none') AS oa, coalesce({_first('r', dims.AXIS_WORDS)}, 'straight') AS ra FROM both_)"
        + f"""SELECT image, feature, CASE WHEN rating IS NULL THEN NULL
        WHEN feature = 'length' THEN {_score_sql('rr', 'pr')}
        WHEN feature = 'chomata' THEN (CASE WHEN od <> rd AND (od = 'absent' OR rd = 'absent') THEN 0
         ELSE (CASE WHEN od = rd OR rd = 'none' THEN 4 ELSE 0 END)
            + (CASE WHEN oh = rh THEN 3 WHEN oh = 'moderate' OR rh = 'moderate' THEN 1 ELSE 0 END)
            + (CASE WHEN ow = rw THEN 3 WHEN ow = 'moderate' OR rw = 'moderate' THEN 1 ELSE 0 END) END)
        WHEN feature = 'axis_shape' THEN CASE WHEN oa = ra OR (oa IN ('convex','concave','curved') AND ra IN ('convex','concave','curved'))
            OR (oa IN ('irregular','sinuous') AND ra IN ('irregular','sinuous')) THEN 10 ELSE 0 END
        ELSE rating END::DOUBLE AS rating FROM y"""
    )


@query("eva_11_apply_rule_scores", _rated_sql())
def _(t):
    out, ref, ratings = _features(t)
    return S.apply_rule_scores(ratings, out, ref)


_JUDGED = [f for f in dims.FEATURES if f not in dims.RULE_FEATURES]


@query(
    "eva_12_judge_prompt",
    _FEATURE_CTES
    + "SELECT image, md5(array_to_string(["
    + ", ".join(
        f"'- {f}\nGenerated:' || "
        + ("o" if f == "size" else "''")
        + " || '\nReference:' || "
        + ("r" if f == "size" else "''")
        for f in _JUDGED
    )
    + "], '\n')) AS prompt FROM both_ WHERE feature = 'size'",
)
def _(t):
    out, ref, _r = _features(t)
    return S.judge_prompt(out, ref).select("image", F.md5("prompt").alias("prompt"))


@query(
    "eva_13_mask_empty",
    ctes("ratings", e="SELECT image, feature, max(rating) AS rating, count(*) % 2 = 0 OR max(rating) IS NULL AS gap FROM ratings GROUP BY ALL")
    + "SELECT image, feature, CASE WHEN NOT gap THEN coalesce(rating, 0.0) END AS rating FROM e",
)
def _(t):
    e = frame(t, "ratings").groupBy("image", "feature").agg(F.max("rating").alias("rating"), F.count(F.lit(1)).alias("n"))
    gap = (F.col("n") % 2 == 0) | F.col("rating").isNull()
    ref = e.select("image", "feature", F.when(gap, "").otherwise("text").alias("text"))
    return S.mask_empty(e.drop("n"), ref)


BRANDS = [f"Brand#{i}" for i in range(1, 20)]
_BRANDS = "(SELECT unnest([" + ", ".join(f"'{b}'" for b in BRANDS) + "]) AS feature, unnest(range(0, 19))::INT AS ord)"


@query(
    "eva_14_feature_stats",
    ctes(
        "ratings",
        p=f"SELECT feature, {R('avg(rating)', 2)} AS r, count(rating) AS n FROM ratings GROUP BY 1",
        rows_=f"SELECT b.feature, coalesce(r, 0.0) AS rating, coalesce(n, 0) AS valid_count, ord FROM {_BRANDS} b LEFT JOIN p USING (feature)",
    )
    + f"SELECT * FROM rows_ UNION ALL SELECT 'Average', {R('sum(rating) / 19', 2)}, -1, -1 FROM rows_",
)
def _(t):
    return S.feature_stats(frame(t, "ratings"), BRANDS)


@query(
    "eva_15_species_stats",
    ctes(
        "ratings",
        s="SELECT *, split_part(image, '_', 1) || '_' || split_part(image, '_', 2) AS species FROM ratings",
        a=f"SELECT species, feature, {R('avg(rating)', 2)} AS r FROM s GROUP BY 1, 2",
        p=f"SELECT feature, {R('avg(r)', 2)} AS r, count(r) AS n FROM a GROUP BY 1",
        rows_=f"SELECT b.feature, coalesce(r, 0.0) AS rating, coalesce(n, 0) AS species_count, ord FROM {_BRANDS} b LEFT JOIN p USING (feature)",
    )
    + f"""SELECT * FROM rows_ UNION ALL SELECT 'Average', coalesce({R('avg(rating)', 2)}, 0.0),
      (SELECT count(DISTINCT species) FROM s), -1 FROM rows_ WHERE species_count > 0""",
)
def _(t):
    return S.species_stats(frame(t, "ratings"), BRANDS)


# numeric and textual answers from line items
_NUM_ANS = """SELECT l_orderkey, l_partkey,
  CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag ELSE CAST(CAST(l_quantity AS INT) - 5 AS {S}) END AS answer,
  CASE WHEN l_linenumber % 3 = 0 THEN concat('Flag is ', l_returnflag, l_linestatus)
       ELSE concat('about ', CAST(CAST(l_quantity AS INT) - 5 + l_partkey % 3 AS {S}), '.5 units') END AS extraction,
  l_shipdate FROM {T}"""


@query(
    "eva_16_relaxed_accuracy",
    "WITH x AS (" + _NUM_ANS.format(S="VARCHAR", T="lineitem") + r"""),
    y AS (SELECT *, try_cast(trim(answer) AS DOUBLE) AS a, try_cast(nullif(regexp_extract(extraction, '(-?\d+\.?\d*)', 1), '') AS DOUBLE) AS e FROM x)
    SELECT """
    + R(
        "avg((CASE WHEN a IS NOT NULL AND e IS NOT NULL THEN (CASE WHEN a = 0 THEN abs(e) < 1e-5 ELSE abs(a - e) / abs(a) <= 0.05 END) "
        "ELSE contains(lower(trim(extraction)), lower(trim(answer))) END)::INT)",
        4,
    )
    + " AS acc FROM y",
)
def _(t):
    return S.relaxed_accuracy(t.sql(_NUM_ANS.format(S="STRING", T="{lineitem}"), "lineitem"))


_PUNCT = r"[^\p{L}\p{M}\p{N}_\s]"


@query(
    "eva_17_anls_ref",
    rf"""WITH x AS (SELECT p_partkey, regexp_replace(trim(lower(p_name)), '{_PUNCT}', '', 'g') AS p,
       regexp_replace(trim(lower(p_name || ' ' || p_type)), '{_PUNCT}', '', 'g') AS r, p_size FROM part),
    y AS (SELECT *, CASE WHEN p_size % 4 = 0 THEN substr(p, 2) ELSE p END AS q, CASE WHEN p_size % 3 = 0 THEN p ELSE r END AS g FROM x),
    z AS (SELECT p_partkey, CASE WHEN len(g) = 0 THEN 0.0 ELSE 1.0 - levenshtein(q, g) / greatest(len(g), 1)::DOUBLE END AS s FROM y)
    SELECT p_partkey, {R('CASE WHEN s < 0.5 THEN 0.0 ELSE s END', 4)} AS anls FROM z""",
)
def _(t):
    p = F.col("p_name")
    r = F.when(F.col("p_size") % 3 == 0, p).otherwise(F.concat_ws(" ", p, "p_type"))
    q = F.when(F.col("p_size") % 4 == 0, F.substring(p, 2, 10**6)).otherwise(p)
    return t.part.select("p_partkey", rnd(A.anls_ref(q, r), 4).alias("anls"))


@query(
    "eva_18_anls_multi",
    f"""WITH x AS (SELECT p_partkey, lower(p_name) AS p, [lower(p_name || p_size::VARCHAR), lower(p_type), lower(substr(p_name, 3))] AS g FROM part),
    y AS (SELECT p_partkey, list_max([1.0 - levenshtein(p, t) / greatest(len(p), len(t))::DOUBLE for t in g]) AS s FROM x)
    SELECT p_partkey, {R('CASE WHEN s >= 0.5 THEN s ELSE 0.0 END', 4)} AS anls FROM y""",
)
def _(t):
    gts = F.array(
        F.concat("p_name", F.col("p_size").cast("string")), F.col("p_type"), F.substring("p_name", 3, 10**6)
    )
    return t.part.select("p_partkey", rnd(A.anls_multi("p_name", gts), 4).alias("anls"))


_LABELLED = """SELECT id, CASE WHEN id % 4 = 0 THEN (CASE WHEN id % 8 = 0 THEN 'Yes' ELSE 'no' END) ELSE reference END AS label,
  CASE WHEN id % 4 = 0 THEN concat((CASE WHEN id % 3 = 0 THEN 'Yes, ' ELSE 'No. ' END), prediction) ELSE prediction END AS response"""


@query(
    "eva_19_yesno_and_recall",
    ctes("pairs_text", l=_LABELLED + " FROM pairs_text")
    + rf""", toks AS (
      SELECT id, side, unnest([w for w in regexp_split_to_array(regexp_replace(trim(lower(trim(txt))), '{_PUNCT}', '', 'g'), '\s+') if w <> '']) AS w
      FROM (SELECT id, 'l' AS side, label AS txt FROM l WHERE lower(trim(label)) NOT IN ('yes','no')
            UNION ALL SELECT id, 'r', response FROM l WHERE lower(trim(label)) NOT IN ('yes','no'))),
    c AS (SELECT id, w, count(*) FILTER (side = 'l') AS lc, count(*) FILTER (side = 'r') AS rc FROM toks GROUP BY 1, 2),
    o AS (SELECT id, sum(lc) AS n, sum(least(lc, rc)) AS hit FROM c GROUP BY 1),
    s AS (SELECT l.id, lower(trim(label)) IN ('yes','no') AS closed,
      CASE WHEN lower(trim(label)) IN ('yes','no')
        THEN (coalesce([w for w in regexp_split_to_array(regexp_replace(trim(lower(trim(response))), '{_PUNCT}', '', 'g'), '\s+') if w <> ''][1], '') = lower(trim(label)))::INT::DOUBLE
        ELSE CASE WHEN coalesce(n, 0) > 0 THEN hit / n ELSE 0.0 END END AS score
      FROM l LEFT JOIN o USING (id))
    SELECT {R('coalesce(avg(score) FILTER (closed), 0)', 4)} AS closed_acc, {R('coalesce(avg(score) FILTER (NOT closed), 0)', 4)} AS open_recall,
      count(*) FILTER (closed) AS n_closed, count(*) FILTER (NOT closed) AS n_open FROM s""",
)
def _(t):
    p = frame(t, "pairs_text")
    df = t.spark.sql(_LABELLED + " FROM {p}", p=p)
    return S.yesno_and_recall_summary(S.yesno_and_recall(df))


@query(
    "eva_20_exact_accuracy",
    ctes("replies", scored=SCORED)
    + f"SELECT {R('avg((lower(trim(pred)) = lower(trim(truth)))::INT)', 4)} AS acc, count(*) AS n FROM scored",
)
def _(t):
    return S.exact_accuracy(scored(t), "pred", "truth")


_MATH = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_linenumber % 2 = 0 THEN 'multi_choice' ELSE 'free_form' END AS question_type,
  CASE WHEN l_linenumber % 4 = 1 THEN 'integer' ELSE 'float' END AS answer_type,
  CAST(l_linenumber % 3 AS {S1}) AS prec,
  CASE WHEN l_linenumber % 2 = 0 THEN (CASE WHEN l_suppkey % 3 = 0 THEN concat('(', substr('abcdef', CAST(l_partkey % 6 AS INT) + 1, 1), ') x')
            WHEN l_suppkey % 3 = 1 THEN substr('ABCDEF', CAST(l_partkey % 6 AS INT) + 1, 1) ELSE concat(' ', l_returnflag, 'ir ', l_linestatus) END)
       WHEN l_suppkey % 5 = 0 THEN 'about' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS {S2}) END AS extraction,
  {A} AS choices FROM {T}"""
_CH4 = ["RAIL F", "AIR", "NAIR O", "TRUCK"]


@query(
    "eva_21_normalise_answer",
    "WITH x AS ("
    + _MATH.format(S1="INT", S2="VARCHAR", A="[" + ", ".join(f"'{c}'" for c in _CH4) + "]", T="lineitem")
    + r"""), y AS (SELECT *, trim(extraction) AS e, coalesce(upper(nullif(regexp_extract(trim(extraction), '\(([a-zA-Z])\)', 1), '')), trim(extraction)) AS l FROM x)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
     CASE WHEN question_type = 'multi_choice' THEN
        CASE WHEN len(l) = 1 AND l BETWEEN 'A' AND 'D' THEN choices[ascii(l) - 64]
             ELSE (list_sort([{'d': levenshtein(l, choices[i]), 'i': i, 'c': choices[i]} for i in range(1, 5)])[1]).c END
      WHEN answer_type = 'integer' THEN CASE WHEN try_cast(e AS DOUBLE) IS NOT NULL THEN trunc(try_cast(e AS DOUBLE))::BIGINT::VARCHAR END
      ELSE NULL END AS v,
     CASE WHEN question_type = 'free_form' AND answer_type = 'float' THEN round_even(try_cast(e AS DOUBLE), prec) END AS num FROM y""",
)
def _(t):
    arr = "array(" + ", ".join(f"'{c}'" for c in _CH4) + ")"
    x = t.sql(_MATH.format(S1="INT", S2="STRING", A=arr, T="{lineitem}"), "lineitem")
    norm = A.normalise_answer("extraction", "choices", "question_type", "answer_type", "prec")
    fl = (F.col("question_type") == "free_form") & (F.col("answer_type") == "float")
    return x.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(~fl, norm).alias("v"), F.when(fl, norm.try_cast("double")).alias("num"),
    )


_KEYS = ["subject", "version", "level"]


@query(
    "eva_22_accuracy_by",
    ctes(
        "levels",
        e="SELECT correct::INT AS c, unnest([{'k': 'subject', 'v': subject}, {'k': 'version', 'v': version}, {'k': 'level', 'v': level::VARCHAR}, "
        "{'k': 'average', 'v': 'all'}, {'k': 'skills', 'v': subject || '/' || version}, {'k': 'skills', 'v': 'q' || (q % 3)::VARCHAR}]) AS p FROM levels",
    )
    + f"SELECT p.k AS key, p.v AS value, {R('avg(c)', 4)} AS accuracy, sum(c)::BIGINT AS correct, count(*) AS total FROM e GROUP BY 1, 2",
)
def _(t):
    lv = frame(t, "levels").withColumn(
        "skills",
        F.array(F.concat_ws("/", "subject", "version"), F.concat(F.lit("q"), (F.col("q") % 3).cast("string"))),
    )
    return S.accuracy_by(lv, _KEYS, ["skills"])


@query(
    "eva_23_split_for_judge",
    "WITH x AS ("
    + _MATH.format(S1="INT", S2="VARCHAR", A="['a']", T="lineitem")
    + r"""), y AS (SELECT *, CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE extraction END AS response FROM x),
    z AS (SELECT *, response = '' OR question_type = 'multi_choice' OR (answer_type = 'integer' AND regexp_full_match(trim(response), '[+-]?\d+'))
      OR (answer_type = 'float' AND try_cast(trim(response) AS DOUBLE) IS NOT NULL) AS usable FROM y)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN usable THEN response ELSE 'judged ' || l_partkey::VARCHAR END AS extraction FROM z""",
)
def _(t):
    x = t.sql(_MATH.format(S1="INT", S2="STRING", A="array('a')", T="{lineitem}"), "lineitem")
    key = _LK.split(", ")
    x = x.withColumn("response", F.when(F.col("l_suppkey") % 7 == 0, "").otherwise(F.col("extraction"))).drop("extraction")
    ready, queue = S.split_for_judge(x)
    judged = queue.select(*key, F.concat(F.lit("judged "), F.col("l_partkey").cast("string")).alias("extraction"))
    merged = ready.unionByName(queue.join(judged, key, "left"))
    return merged.select(*key, "extraction")


@query(
    "eva_24_final_answer",
    r"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_suppkey % 6 WHEN 0 THEN l_quantity::INT::VARCHAR WHEN 1 THEN '\frac{' || l_quantity::INT || '}{7}'
    WHEN 2 THEN substr('abcde', (l_partkey % 5)::INT + 1, 1) WHEN 3 THEN '\sqrt{' || (l_partkey % 9 + 1) || '}+\frac{1}{2}' WHEN 4 THEN '\frac{1}{2}' ELSE l_quantity::INT::VARCHAR END AS answer FROM lineitem""",
)
def _(t):
    q, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_suppkey") % 6
    letter = F.substring(F.lit("ABCDE"), (F.col("l_partkey") % 5 + 1).cast("int"), F.lit(1))
    text = (
        F.when(k == 0, F.concat(F.lit("First. The answer is "), q, F.lit(". Done")))
        .when(k == 1, F.concat(F.lit("So x = "), q, F.lit(" and \\boxed{"), q, F.lit("/7}")))
        .when(k == 2, F.concat(F.lit("we pick "), letter, F.lit(" here")))
        .when(k == 3, F.concat(F.lit("\\boxed{1} then \\boxed{\\sqrt"), (F.col("l_partkey") % 9 + 1).cast("string"), F.lit("+\\frac12}")))
        .when(k == 4, "it is .5")
        .otherwise(F.concat(F.lit("value\\approx "), q, F.lit("\\text{ km}")))
    )
    return t.heavy("lineitem").select(*_LK.split(", "), A.final_answer(text).alias("answer"))


@query(
    "eva_25_accuracy_cube",
    ctes("levels")
    + f"SELECT coalesce(level::VARCHAR, 'all') AS level, coalesce(subject, 'all') AS subject, sum(correct::INT)::BIGINT AS correct, count(*) AS total, {R('avg(correct::INT) * 100', 2)} AS pct FROM levels GROUP BY CUBE (level, subject)",
)
def _(t):
    return S.accuracy_cube(frame(t, "levels")).withColumn(
        "level", F.coalesce(F.col("level").cast("string"), F.lit("all"))
    ).fillna("all", subset=["subject"])


@query(
    "eva_26_judgement_rollup",
    ctes("levels", r="SELECT subject, subfield, (judgement = 1)::INT AS c, version FROM levels")
    + f"""SELECT 'subfield' AS scope, subject, subfield AS part, {R('avg(c)', 3)} AS acc, count(*) AS n FROM r GROUP BY subject, subfield
    UNION ALL SELECT 'subject', subject, '', {R('avg(c)', 3)}, count(*) FROM r GROUP BY subject
    UNION ALL SELECT 'total', '', '', {R('avg(c)', 3)}, count(*) FROM r
    UNION ALL SELECT 'version', '', version, {R('avg(c)', 3)}, count(*) FROM r GROUP BY version""",
)
def _(t):
    lv = frame(t, "levels").withColumn("judgement", S.judgement_of(F.col("judgement").cast("string")))
    return S.judgement_rollup(lv)


@query(
    "eva_27_binary_metrics",
    ctes(
        "yes_no",
        p="SELECT category, label, CASE WHEN len(list_intersect(string_split(replace(string_split(text, '.')[1], ',', ''), ' '), ['No','not','no'])) > 0 "
        "OR contains(text, 'the th') THEN 'no' ELSE 'yes' END AS pred FROM yes_no",
        c="SELECT category, count(*) FILTER (pred = 'yes' AND label <> 'no') AS tp, count(*) FILTER (pred = 'yes' AND label = 'no') AS fp, "
        "count(*) FILTER (pred <> 'yes' AND label = 'no') AS tn, count(*) FILTER (pred <> 'yes' AND label <> 'no') AS fn FROM p GROUP BY 1",
    )
    + f"""SELECT category, tp, fp, tn, fn, {R('(tp + tn) / nullif(tp + fp + tn + fn, 0)', 4)} AS accuracy, {R('tp / nullif(tp + fp, 0)', 4)} AS precision,
    {R('tp / nullif(tp + fn, 0)', 4)} AS recall, {R('2 * tp / nullif(2 * tp + fp + fn, 0)', 4)} AS f1, {R('(tp + fp) / nullif(tp + fp + tn + fn, 0)', 4)} AS yes_ratio FROM c""",
)
def _(t):
    y = frame(t, "yes_no").withColumn(
        "pred", F.when(F.col("text").contains("the th"), "no").otherwise(A.yes_no("text"))
    )
    return S.binary_metrics(y, ["category"])


def _sci_preds(t, salt: int, drop: int):
    r = frame(t, "replies").filter((F.col("image_id") + salt) % drop != 0)
    letter = A.letter_of((F.col("truth_idx") + F.when((F.col("image_id") + salt) % 3 == 0, 1).otherwise(0)).cast("int"))
    text = F.when((F.col("question_id") + salt) % 4 == 0, F.concat(letter, F.lit(". yes"))).otherwise(
        F.concat(F.lit("So. The answer is "), letter, F.lit("."))
    )
    pid = F.concat_ws("_", "image_id", "question_id")
    return r.select(
        pid.alias("id"),
        text.alias("text"),
        F.when(F.col("image_id") % 2 == 0, "<image> q").otherwise("q").alias("prompt"),
    )


def _problems(t):
    return frame(t, "replies").select(
        F.concat_ws("_", "image_id", "question_id").alias("id"), "choices", F.col("truth_idx").alias("answer")
    )


def _sci_sql(salt, drop):
    letter = f"substr('ABCDE', truth_idx::INT + 1 + (CASE WHEN (image_id + {salt}) % 3 = 0 THEN 1 ELSE 0 END), 1)"
    return (
        f"SELECT image_id || '_' || question_id AS id, CASE WHEN (question_id + {salt}) % 4 = 0 THEN {letter} || '. yes' "
        f"ELSE 'So. The answer is ' || {letter} || '.' END AS text, CASE WHEN image_id % 2 = 0 THEN '<image> q' ELSE 'q' END AS prompt "
        f"FROM replies WHERE (image_id + {salt}) % {drop} <> 0"
    )


_PROB_SQL = "SELECT image_id || '_' || question_id AS id, len(choices) AS n, truth_idx AS answer FROM replies"


def _said(c):
    m = f"regexp_extract_all({c}, 'The answer is ([A-Z]).', 1)"
    return f"CASE WHEN len({m}) = 1 THEN {m}[1] ELSE 'FAILED' END"


def _oidx(letter):
    return f"(CASE WHEN len({letter}) = 1 AND strpos('ABCDE', {letter}) BETWEEN 1 AND n THEN strpos('ABCDE', {letter}) - 1 ELSE -1 END)"


@query(
    "eva_28_science_accuracy",
    ctes("replies", p=_PROB_SQL, a=_sci_sql(0, 7))
    + f""", j AS (SELECT p.*, coalesce(text, 'FAILED') AS t, prompt FROM p LEFT JOIN a USING (id)),
    k AS (SELECT *, CASE WHEN t IN ('A','B','C','D','E') THEN t WHEN t[1] IN ('A','B','C','D','E') AND substr(t, 2, 2) = '. ' THEN t[1]
       ELSE {_said('t')} END AS l FROM j),
    m AS (SELECT *, {_oidx('l')} = answer AS ok FROM k)
    SELECT count(*) FILTER (ok) AS correct, count(*) AS total, {R('avg(ok::INT) * 100', 2)} AS acc,
     {R("avg(ok::INT) FILTER (contains(prompt, '<image>')) * 100", 2)} AS img_acc FROM m""",
)
def _(t):
    return S.science_accuracy(_problems(t), _sci_preds(t, 0, 7))


@query(
    "eva_29_ensemble",
    ctes("replies", p=_PROB_SQL, a=_sci_sql(0, 7), b=_sci_sql(1, 5))
    + f""", j AS (SELECT p.*, {_said('a.text')} AS al, {_said('b.text')} AS bl FROM p JOIN a USING (id) JOIN b USING (id)),
    k AS (SELECT *, {_oidx('al')} AS ai, {_oidx('bl')} AS bi FROM j), u AS (SELECT *, CASE WHEN bl = 'FAILED' THEN ai ELSE bi END AS ui FROM k)
    SELECT count(*) AS total, count(*) FILTER (ui = answer) AS correct, count(*) FILTER (ui = answer OR ai = answer) AS upper,
     count(*) FILTER (bl = 'FAILED') AS failed FROM u""",
)
def _(t):
    drop = lambda d: d.drop("prompt")
    return S.ensemble(_problems(t), drop(_sci_preds(t, 0, 7)), drop(_sci_preds(t, 1, 5)))


@query(
    "eva_29_ensemble_requery",
    ctes("replies", p=_PROB_SQL, a=_sci_sql(0, 7), b=_sci_sql(1, 5), c=_sci_sql(2, 3))
    + f""", j AS (SELECT p.*, {_said('a.text')} AS al, {_said('b.text')} AS bl, {_said("coalesce(c.text, 'MISSING')")} AS cl, c.text IS NULL AS miss
       FROM p JOIN a USING (id) JOIN b USING (id) LEFT JOIN c USING (id)),
    k AS (SELECT *, {_oidx('al')} = answer AS ao, {_oidx('bl')} = answer AS bo, {_oidx('cl')} = answer AS co, bl = 'FAILED' AS bf, cl = 'FAILED' AS cf FROM j)
    SELECT count(*) AS total, count(*) FILTER (miss) AS missing_requery, count(*) FILTER (ao) AS ours, count(*) FILTER (bo) AS other,
     count(*) FILTER (bf) AS other_failed, count(*) FILTER ((bf AND ao) OR (NOT bf AND bo)) AS other_or_ours,
     count(*) FILTER ((cf AND ao) OR (NOT cf AND co)) AS requery, count(*) FILTER (ao OR bo) AS upper FROM k""",
)
def _(t):
    drop = lambda d: d.drop("prompt")
    return S.ensemble_requery(
        _problems(t), drop(_sci_preds(t, 0, 7)), drop(_sci_preds(t, 1, 5)), drop(_sci_preds(t, 2, 3))
    )


@query(
    "eva_30_first_letter_accuracy",
    ctes(
        "replies",
        x="SELECT *, CASE question_id % 4 WHEN 0 THEN truth_idx::VARCHAR ELSE answer END AS want, "
        "CASE WHEN image_id % 5 = 0 THEN answer || ' so' WHEN image_id % 5 = 1 THEN answer WHEN image_id % 5 = 2 THEN text "
        "ELSE substr('ABCD', (image_id % 4)::INT + 1, 1) || '.' END AS resp FROM replies",
        y="SELECT *, unicode(substr(resp, 1, 1)) - 65 AS i FROM x",
    )
    + f"""SELECT count(*) AS n, {R("avg((len(resp) > 0 AND (i::VARCHAR = want OR (i BETWEEN 0 AND 3 AND coalesce(choices[i + 1] = want, false)) OR string_split(resp, ' ')[1] = want OR resp = want))::INT)", 4)} AS acc FROM y""",
)
def _(t):
    i = F.col("image_id") % 5
    r = frame(t, "replies").select(
        "choices",
        F.when(F.col("question_id") % 4 == 0, F.col("truth_idx").cast("string")).otherwise(F.col("answer")).alias("want"),
        F.when(i == 0, F.concat("answer", F.lit(" so")))
        .when(i == 1, F.col("answer"))
        .when(i == 2, F.col("text"))
        .otherwise(F.concat(A.letter_of((F.col("image_id") % 4).cast("int")), F.lit(".")))
        .alias("resp"),
    )
    ok = A.first_letter_match("resp", "choices", "want")
    return r.agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(ok.cast("double")), 4).alias("acc"))


def _norm_sql(c: str) -> str:
    """vqa_normalise for DuckDB."""
    t = f"trim(replace(replace(trim(replace(replace(replace(lower({c}), ',', ''), '?', ''), '''s', ' ''s')), chr(10), ' '), chr(9), ' '))"
    out = "s"
    for p in dims.PUNCTUATION:
        q = p.replace("'", "''")
        out = f"replace({out}, '{q}', CASE WHEN contains(s, '{q} ') OR contains(s, ' {q}') THEN '' ELSE ' ' END)"
    nums = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in dims.NUMBER_WORDS.items()) + "}"
    esc = lambda x: x.replace("'", "''")
    cons = "MAP {" + ", ".join(f"'{esc(k)}': '{esc(v)}'" for k, v in dims.CONTRACTIONS.items()) + "}"
    arts = ", ".join(f"'{a}'" for a in dims.ARTICLES)
    words = r"[w for w in regexp_split_to_array(lower(o), '\s+') if w <> '']"
    return (
        f"(SELECT array_to_string([coalesce(({cons})[w], w) for w in ws if w NOT IN ({arts})], ' ') FROM "
        f"(SELECT [coalesce(({nums})[w], w) for w in {words}] AS ws FROM "
        f"(SELECT regexp_replace(regexp_replace({out}, '\\.(\\D)', '\\1', 'g'), '\\.$', '') AS o FROM (SELECT {t} AS s))))"
    )


_ANS10 = ["two cats", "Two cat", "the two cats", "2 cats", "dont know", "a dog", "2 cats?", "dog-house", "two cats", "none"]


def _gts(d) -> str:
    pick = lambda i: f"CASE WHEN l_partkey % {i + 2} = 0 THEN '{_ANS10[i]}' ELSE '{_ANS10[(i + 3) % 10]}' END"
    a = ", ".join(pick(i) for i in range(10))
    return f"[{a}]" if d else f"array({a})"


def _soft(t):
    x = t.sql(
        f"SELECT {_LK}, element_at(array({', '.join(repr(a) for a in _ANS10)}), cast(l_suppkey % 10 as int) + 1) AS pred, {_gts(False)} AS gts FROM {{lineitem}}",
        "lineitem",
        heavy=True,
    )
    return x.select(
        *_LK.split(", "), A.vqa_normalise("pred").alias("pred"), F.transform("gts", lambda g: A.vqa_normalise(g)).alias("gts")
    )


# normalised forms of the ten phrases, written out independently of the code under test
_NORM10 = ["2 cats", "2 cat", "2 cats", "2 cats", "don''t know", "dog", "2 cats", "dog house", "2 cats", "0"]


def _gts_norm() -> str:
    return "[" + ", ".join(
        f"CASE WHEN l_partkey % {i + 2} = 0 THEN '{_NORM10[i]}' ELSE '{_NORM10[(i + 3) % 10]}' END" for i in range(10)
    ) + "]"


_SOFT_SQL = (
    f"WITH x AS (SELECT {_LK}, ([" + ", ".join(f"'{n}'" for n in _NORM10) + f"])[(l_suppkey % 10)::INT + 1] AS pred, {_gts_norm()} AS gts FROM lineitem)"
)


@query(
    "eva_31_vqa_normalise",
    "WITH c AS (SELECT conv_id, turn, text AS txt FROM conversations) SELECT conv_id, turn, md5(" + _norm_sql("txt") + ") AS norm FROM c",
)
def _(t):
    return t.heavy("conversations").select("conv_id", "turn", F.md5(A.vqa_normalise("text")).alias("norm"))


@query(
    "eva_32_soft_accuracy",
    _SOFT_SQL
    + f""", m AS (SELECT *, len([g for g in gts if g = pred]) AS m FROM x)
    SELECT {_LK}, {R('(m * least(1.0, (m - 1) / 3.0) + (10 - m) * least(1.0, m / 3.0)) / 10', 6)} AS score FROM m""",
)
def _(t):
    return _soft(t).select(*_LK.split(", "), rnd(A.soft_accuracy("pred", "gts"), 6).alias("score"))


@query("eva_33_any_match", _SOFT_SQL + f"SELECT {R('avg(list_contains(gts, pred)::INT)', 4)} AS acc FROM x")
def _(t):
    return _soft(t).agg(rnd(F.avg(A.any_match("pred", "gts").cast("double")), 4).alias("acc"))


_TOK = r"regexp_extract_all(lower({c}), '([\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\s])', 1)"


@query(
    "eva_34_bleu4",
    ctes(
        "pairs_text",
        h="SELECT id, " + _TOK.format(c="prediction") + " AS t FROM pairs_text",
        r="SELECT id, " + _TOK.format(c="reference") + " AS t FROM pairs_text",
        hg=" UNION ALL ".join(
            f"SELECT id, {n} AS n, unnest([array_to_string(t[i:i+{n - 1}], ' ') for i in range(1, len(t) - {n} + 2)]) AS g FROM h WHERE len(t) >= {n}" for n in range(1, 5)
        ),
        rg=" UNION ALL ".join(
            f"SELECT id, {n} AS n, unnest([array_to_string(t[i:i+{n - 1}], ' ') for i in range(1, len(t) - {n} + 2)]) AS g FROM r WHERE len(t) >= {n}" for n in range(1, 5)
        ),
        hc="SELECT id, n, g, count(*) AS c FROM hg GROUP BY ALL",
        rc="SELECT id, n, g, count(*) AS c FROM rg GROUP BY ALL",
        m="SELECT n, sum(least(hc.c, coalesce(rc.c, 0)))::BIGINT AS m, sum(hc.c)::BIGINT AS t FROM hc LEFT JOIN rc USING (id, n, g) GROUP BY n",
        l="SELECT sum(len(h.t))::BIGINT AS hl, sum(len(r.t))::BIGINT AS rl FROM h JOIN r USING (id)",
        w="SELECT " + ", ".join(f"max(CASE WHEN n = {n} THEN m END) AS m{n}, max(CASE WHEN n = {n} THEN t END) AS t{n}" for n in range(1, 5)) + " FROM m",
    )
    + f"""SELECT m1, m2, m3, m4, t1, t4, hl, rl, {R('CASE WHEN least(m1, m2, m3, m4) = 0 THEN 0.0 ELSE (CASE WHEN hl < rl THEN exp(1 - rl / hl) ELSE 1.0 END) * exp((ln(m1 / t1) + ln(m2 / t2) + ln(m3 / t3) + ln(m4 / t4)) / 4) END', 4)} AS bleu4 FROM w, l""",
)
def _(t):
    p = frame(t, "pairs_text").select(F.col("prediction").alias("hypothesis"), F.array("reference").alias("references"))
    out = S.bleu4(p)
    return out.select(*[F.col(c).cast("bigint") for c in ["m1", "m2", "m3", "m4", "t1", "t4", "hl", "rl"]], "bleu4")


@query(
    "eva_35_join_annotations",
    f"""SELECT p_partkey AS question_id, p_type AS answer FROM part WHERE p_size % 5 <> 4""",
)
def _(t):
    q = F.concat(F.lit("Which Part is "), F.col("p_name"), F.lit("?"))
    k = F.col("p_size") % 5
    prompt = (
        F.when(k == 0, F.concat(F.lit("OCR tokens: x, y. Question: "), q, F.lit(" Short answer:")))
        .when(k == 1, F.concat(F.lit("Reference OCR token: a\n"), q, F.lit("\nAnswer.")))
        .when(k == 2, F.concat(q, F.lit("\nReference OCR token: a\nAnswer.")))
        .when(k == 3, F.concat(q, F.lit("\nAnswer.")))
        .otherwise(F.concat(q, F.lit(" no layout")))
    )
    res = t.part.select(F.col("p_partkey").alias("question_id"), prompt.alias("prompt"))
    ann = t.part.select(F.col("p_partkey").alias("image_id"), F.upper(q).alias("question"), F.col("p_type").alias("answer"))
    return S.join_annotations(res, ann).select("question_id", "answer")


_PAIRS = ctes(
    "reviews",
    r="SELECT question_id, category, string_split(replace(review, ',', ' '), ' ') AS s FROM reviews",
    p="SELECT question_id, category, try_cast(s[1] AS DOUBLE) IS NOT NULL AND try_cast(s[2] AS DOUBLE) IS NOT NULL AND len(s) = 2 AS ok, s FROM r",
    q="SELECT question_id, category, CASE WHEN ok THEN s[1]::DOUBLE ELSE -1.0 END AS s1, CASE WHEN ok THEN s[2]::DOUBLE ELSE -1.0 END AS s2 FROM p",
)


def _pairs(t):
    p = A.parse_pair("review")
    return frame(t, "reviews").select("question_id", "category", p["s1"].alias("s1"), p["s2"].alias("s2"))


@query("eva_36_parse_pair", _PAIRS + "SELECT question_id, s1, s2 FROM q")
def _(t):
    return _pairs(t).drop("category")


@query(
    "eva_37_pairwise_summary",
    _PAIRS
    + f""", g AS (SELECT category, avg(s1) FILTER (s1 >= 0) AS a, avg(s2) FILTER (s1 >= 0) AS b, count(*) FILTER (s1 < 0) AS unparsed
      FROM q WHERE question_id NOT IN (1, 2, 3) GROUP BY ROLLUP (category)),
    h AS (SELECT coalesce(category, 'all') AS category, {R('a', 3)} AS mean1, {R('b', 3)} AS mean2, unparsed FROM g)
    SELECT category, mean1, mean2, {R('mean2 / nullif(mean1, 0) * 100', 1)} AS ratio, unparsed FROM h""",
)
def _(t):
    return S.pairwise_summary(_pairs(t), [1, 2, 3])


_RULES = [("1-URGENT", "Judge", "Be fair."), ("2-HIGH", "Assistant", "Be strict."), ("3-MEDIUM", "Assistant", "Rate both."),
          ("4-NOT SPECIFIED", "Model", "Rate."), ("5-LOW", "Model", "Compare.")]


def _orders_qa(t):
    o = t.orders
    q = o.select(
        F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("image"), F.col("o_orderpriority").alias("category"),
        F.concat(F.lit("What is order "), F.col("o_orderkey").cast("string"), F.lit("?")).alias("text"),
    )
    ctx = t.customer.select(F.col("c_custkey").alias("image"), F.col("c_name").alias("caption"), F.concat(F.col("c_mktsegment"), F.lit(": box")).alias("boxes"))
    a1 = o.select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("status "), F.col("o_orderstatus")).alias("text"))
    a2 = o.select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("year "), F.year("o_orderdate").cast("string")).alias("text"))
    return q, ctx, a1, a2


_RULE_SQL = "(VALUES " + ", ".join(f"('{c}', '{r}', '{p}')" for c, r, p in _RULES) + ") rules(category, role, prompt)"


def _prompt_sql(ctx):
    return f"""SELECT o_orderkey AS question_id, o_orderpriority AS category, md5('[Context]\n' || {ctx} || '\n\n[Question]\nWhat is order ' || o_orderkey::VARCHAR || '?\n\n[' || role
    || ' 1]\nstatus ' || o_orderstatus || '\n\n[End of ' || role || ' 1]\n\n[' || role || ' 2]\nyear ' || year(o_orderdate)::VARCHAR || '\n\n[End of ' || role || ' 2]\n\n[System]\n' || prompt || '\n\n') AS content
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN {_RULE_SQL} ON category = o_orderpriority"""


def _pairwise(t, boxes):
    q, ctx, a1, a2 = _orders_qa(t)
    rules = t.spark.createDataFrame(_RULES, "category string, role string, prompt string")
    return S.pairwise_prompt(q, ctx, a1, a2, rules, boxes).withColumn("content", F.md5("content"))


@query("eva_38_pairwise_prompt", _prompt_sql("c_name"))
def _(t):
    return _pairwise(t, False)


@query("eva_38_pairwise_prompt_boxes", _prompt_sql("c_name || '\n\n' || c_mktsegment || ': box'"))
def _(t):
    return _pairwise(t, True)


@query(
    "eva_38_rejects",
    """SELECT o_orderkey AS question_id, concat_ws(', ', CASE WHEN o_custkey % 7 = 0 THEN 'context' END, CASE WHEN o_orderkey % 5 = 0 THEN 'answer 1' END, CASE WHEN o_orderkey % 3 = 0 THEN 'answer 2' END,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'rule' END) AS missing FROM orders WHERE o_custkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 OR o_orderpriority = '1-URGENT'""",
)
def _(t):
    """Contexts, answers and rules with gaps: what no prompt is made for, and why."""
    q, ctx, a1, a2 = _orders_qa(t)
    rules = q.select("category").distinct().filter("category <> '1-URGENT'")
    ctx = q.select("image").distinct().filter("image % 7 <> 0")
    return S.pairwise_rejects(q, ctx, a1.filter("question_id % 5 <> 0"), a2.filter("question_id % 3 <> 0"), rules)


@query(
    "eva_39_review_page",
    """WITH x AS (SELECT o_orderkey AS q, *, (o_orderkey % 10)::VARCHAR || ' ' || (o_custkey % 10)::VARCHAR AS s FROM orders)
    SELECT q AS id, o_orderpriority AS category,
     'What is order ' || o_orderkey::VARCHAR || '?' AS question, 'status ' || o_orderstatus AS answer1, 'year ' || year(o_orderdate)::VARCHAR AS answer2,
     CASE WHEN o_custkey % 3 = 0 THEN '**Assistant 1** wins' ELSE 'Good: **Assistant 2** and **Assistant 1**' END AS evaluation,
     (o_orderkey % 10)::DOUBLE AS s1, (o_custkey % 10)::DOUBLE AS s2 FROM x""",
)
def _(t):
    q, _c, a1, a2 = _orders_qa(t)
    body = F.when(F.col("o_custkey") % 3 == 0, "Assistant 1 wins").otherwise("Good: Assistant 2 and Assistant 1")
    score = F.concat_ws(" ", F.col("o_orderkey") % 10, F.col("o_custkey") % 10)
    content = F.when(F.col("o_custkey") % 2 == 0, F.concat(score, F.lit("\n"), body)).otherwise(body)
    rev = t.orders.select(
        F.col("o_orderkey").alias("question_id"), content.alias("content"),
        (F.col("o_orderkey") % 10).cast("double").alias("s1"), (F.col("o_custkey") % 10).cast("double").alias("s2"),
    )
    return S.review_page(q, a1, a2, rev)


def _figures(t):
    l = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").cast("bigint").alias("q"), F.count(F.lit(1)).alias("n"))
    figs = l.select(
        F.col("l_orderkey").alias("figure_id"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.col("q") * (i + 1) + F.col("n")) % 19 + 1).cast("int")).alias("qids"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat_ws("/", F.col("n").cast("string"), i.cast("string"))).alias("answers"),
    )
    resp = l.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat_ws("_", "l_orderkey", i))).alias("resp_key"), F.col("q").cast("string").alias("response"))
    return figs, resp


_FIG = """WITH l AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY 1),
 it AS (SELECT l_orderkey || '_' || i AS resp_key, ((q * (i + 1) + n) % 19 + 1)::INT AS qid, n || '/' || i AS answer, q::VARCHAR AS response FROM l, (SELECT unnest(range(0, 4)) AS i))"""
_RUB = "CASE " + " ".join(f"WHEN qid IN ({', '.join(map(str, v))}) THEN '{k}'" for k, v in S.RUBRIC_OF.items()) + " END"


@query(
    "eva_40_grading_batches",
    _FIG
    + f""", rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY md5('grade:' || resp_key), resp_key) AS rank FROM it)
    SELECT qid, (rank - 1) // 10 AS batch, {_RUB} AS rubric, count(*) AS n, md5(string_agg(resp_key || '=' || response || '=' || answer, ';' ORDER BY rank)) AS items FROM rk GROUP BY 1, 2, 3""",
)
def _(t):
    b = S.grading_batches(*_figures(t), 10)
    return b.select(
        "qid", "batch", "rubric", F.size("items").cast("bigint").alias("n"),
        F.md5(F.array_join(F.transform("items", lambda s: F.concat_ws("=", s["resp_key"], s["response"], s["answer"])), ";")).alias("items"),
    )


@query(
    "eva_41_ungroup_grades",
    _FIG
    + """, rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY md5('grade:' || resp_key), resp_key) AS rank FROM it),
    b AS (SELECT *, (rank - 1) // 10 AS batch FROM rk)
    SELECT resp_key, CASE WHEN batch % 5 = 0 OR batch % 7 = 0 THEN 'Failed to parse response' ELSE 'ans ' || resp_key END AS extracted_answer,
      CASE WHEN batch % 5 = 0 OR batch % 7 = 0 THEN -1 ELSE (qid % 2)::INT END AS score FROM b""",
)
def _(t):
    b = S.grading_batches(*_figures(t), 10)
    # a grader's reply: valid JSON, JSON with a score of 2, or text that is not JSON
    pairs = F.array_join(
        F.transform(
            "items",
            lambda s, i: F.concat(
                F.lit('"extract_answer_T'), (i + 1).cast("string"), F.lit('": "ans '), s["resp_key"], F.lit('", "score_T'),
                (i + 1).cast("string"), F.lit('": '), F.when(F.col("batch") % 7 == 0, 2).otherwise(F.col("qid") % 2).cast("string"),
            ),
        ),
        ", ",
    )
    reply = F.when(F.col("batch") % 5 == 0, "no json").otherwise(F.concat(F.lit("{"), pairs, F.lit("}")))
    return S.ungroup_grades(b.select(F.transform("items", lambda s: s["resp_key"]).alias("resp_keys"), reply.alias("reply")))


@query(
    "eva_42_template_question",
    """WITH x AS (SELECT p_partkey, p_size % 19 + 1 AS qid, p_size % 3 AS r, p_partkey % 3 AS c, p_name, p_retailprice FROM part),
    y AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'For ' || p_name || ', ' WHEN r = 0 THEN 'For the current plot, '
       ELSE 'For the subplot at row ' || r || ' and column ' || c || ', ' END AS pre FROM x)
    SELECT p_partkey, qid, CASE WHEN qid IN (18, 19) THEN 'Template ' || qid || ' {}what?' ELSE 'Template ' || qid || ' ' || pre || 'what?' END AS question,
     CASE WHEN p_partkey % 2 = 0 THEN '* Your final answer must be an exact integer.' ELSE '* Your final answer must be a number with 2 decimal places.' END AS inst FROM y""",
)
def _(t):
    df = t.part.select(
        "p_partkey", (F.col("p_size") % 19 + 1).alias("qid"), (F.col("p_size") % 3).alias("subplot_row"),
        (F.col("p_partkey") % 3).alias("subplot_col"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).alias("subplot_name"),
        F.when(F.col("p_partkey") % 2 == 0, F.floor("p_retailprice").cast("string")).otherwise(F.col("p_retailprice").cast("decimal(18,2)").cast("string")).alias("answer"),
    )
    tm = t.spark.createDataFrame([(i, f"Template {i} {{}}what?") for i in range(1, 20)], "qid int, template string")
    return S.template_question(df, tm).select("p_partkey", "qid", "question", A.decimals_instruction("answer").alias("inst"))


@query(
    "eva_43_batch_extract_merge",
    """WITH x AS (SELECT event_id, event_type, CASE WHEN event_id % 4 = 0 THEN 'done' END AS extraction FROM events),
    rk AS (SELECT event_id, row_number() OVER (ORDER BY md5('extract:' || event_id), event_id) AS rank FROM x WHERE event_type <> 'view' AND extraction IS NULL),
    b AS (SELECT event_id, (rank - 1) // 10 AS batch FROM rk)
    SELECT event_id, coalesce(extraction, CASE WHEN batch % 3 <> 0 THEN 'v' || event_id END) AS extraction FROM x LEFT JOIN b USING (event_id)""",
)
def _(t):
    e = t.events.select(
        "event_id", F.when(F.col("event_type") == "view", "Acc+").otherwise("GPT-acc").alias("kind"),
        F.when(F.col("event_id") % 4 == 0, "done").alias("extraction"), F.col("event_type").alias("response"),
    )
    b = S.batch_extract(e, 10, "event_id")
    line = F.array_join(F.transform("items", lambda s: F.concat(F.lit("v"), s["event_id"].cast("string"))), "\n")
    replies = b.select("items", F.when(F.col("batch") % 3 == 0, F.concat(line, F.lit("\nextra"))).otherwise(line).alias("reply"))
    return S.merge_back(e, replies, "event_id").select("event_id", "extraction")
