"""VQA: question generation from scenes derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenemark import dims
from scenemark.functions import geometry as G
from scenemark.functions import wording as Wd
from scenemark.operators import questions as Q
from scenemark.plans.fixtures import ctes, frame
from scenemark.plans.registry import query


def shapes(t):
    s = frame(t, "shapes", heavy=True)
    cols = ["image_id", "shape_idx", "type", "cx", "cy", "area", "major_axis", "rotation"]
    dbl = ["cx", "cy", "area", "major_axis", "rotation", "min_x", "max_y", "max_x", "min_y"]
    s = s.select("image_id", "shape_idx", "type", *[F.col(c).cast("double").alias(c) for c in dbl])
    return s.select(*cols, G.box("min_x", "max_y", "max_x", "min_y").alias("box"))


def profile(t):
    return Q.profiles(shapes(t))


def full_profile(t):
    return Q.with_relations(profile(t), Q.relation_pairs(shapes(t), frame(t, "relations")))


def flat(df):
    """Choices joined, so that results compare as plain values."""
    return df.select(
        "perspective", "image_id", F.col("question_id").cast("bigint").alias("question_id"), "question",
        F.array_join("choices", "|").alias("choices"), "answer",
    )


# --- SQL: scenes ------------------------------------------------------------------------

_T = "[" + ", ".join(f"'{x}'" for x in dims.SHAPE_TYPES) + "]"
H = lambda seed, *k: "md5(concat_ws(':', '" + seed + "', " + ", ".join(k) + "))"
U = lambda seed, *k: f"(('0x' || substr({H(seed, *k)}, 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"


def _masks() -> str:
    out = []
    e = "0.0001::DOUBLE"
    x0, y1, x1, y0 = f"(min_x - {e})", f"(max_y + {e})", f"(max_x + {e})", f"(min_y - {e})"
    area = f"abs(({x1} - {x0}) * ({y1} - {y0}))"
    for r, (_t, a0, b1, a1, b0) in enumerate(dims.REGIONS):
        def ov(m):
            L = lambda v: f"({v!r}::DOUBLE)"
            return (
                f"(greatest(0.0, least({L(a1 + m)}, {x1}) - greatest({L(a0 - m)}, {x0})) * "
                f"greatest(0.0, least({L(b1 + m)}, {y1}) - greatest({L(b0 - m)}, {y0})) / {area})"
            )
        out.append((r, ov(0.0), ov(2 * dims.REGION_MARGIN)))
    cand = " + ".join(f"(CASE WHEN {o} >= 0.9999 AND {i} >= 0.8 THEN {1 << r} ELSE 0 END)" for r, i, o in out)
    near = " + ".join(f"(CASE WHEN {o} >= 0.5 THEN {1 << r} ELSE 0 END)" for r, i, o in out)
    far = " + ".join(f"(CASE WHEN {o} < 0.5 THEN {1 << r} ELSE 0 END)" for r, i, o in out)
    return f"{cand} AS cand, {near} AS near, {far} AS far"


_DBL = ["cx", "cy", "area", "major_axis", "min_x", "max_y", "max_x", "min_y"]
SCENE = dict(
    s="SELECT image_id, shape_idx, type, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in _DBL) + " FROM shapes",
    sm=f"SELECT *, {_masks()} FROM s",
    st=f"""SELECT image_id, type, list_position({_T}, type) AS ord, count(*) AS n, min(area) AS min_area, max(area) AS max_area,
       arg_min(shape_idx, (-major_axis, shape_idx)) AS idx, count(DISTINCT (cx, cy)) = 1 AS one_spot,
       bit_or(cand) AS cand, bit_or(near) AS near, bit_or(far) AS far FROM sm GROUP BY 1, 2""",
    ty="SELECT st.*, s.cx, s.cy, s.area, s.min_x, s.max_y, s.max_x, s.min_y FROM st JOIN s ON st.image_id = s.image_id AND st.idx = s.shape_idx",
    im=f"""SELECT image_id, list(type ORDER BY ord) AS present, list_filter({_T}, lambda t: NOT list_contains(list(type), t)) AS absent FROM ty GROUP BY 1""",
)
# absent types as rows
SCENE["ab"] = f"SELECT im.image_id, v.type, v.ord FROM im, (SELECT unnest({_T}) AS type, unnest(range(1, 15)) AS ord) v WHERE NOT list_contains(present, v.type)"


def clar(kind: str, present: str = "present", plural: bool = False) -> str:
    def descs(parent):
        kids: dict[str, list[str]] = {}
        for c, d in dims.TYPE_CHILDREN[parent]:
            kids.setdefault(d, []).append(c)
        s = "s" if plural else ""
        return "concat_ws(', ', " + ", ".join(
            f"CASE WHEN list_has_any({present}, [" + ", ".join(f"'{c}'" for c in cs) + f"]) THEN '{d}{s}' END" for d, cs in kids.items()
        ) + ")"
    whens = []
    for p in dims.TYPE_CHILDREN:
        d = descs(p)
        text = f"'{p}s (excluding ' || {d} || ')'" if plural else f"'{p} (not ' || {d} || ')'"
        plain = f"'{p}s'" if plural else f"'{p}'"
        whens.append(f"WHEN '{p}' THEN CASE WHEN {d} = '' THEN {plain} ELSE {text} END")
    return f"(CASE {kind} {' '.join(whens)} ELSE {kind}{' || ' + repr('s') if plural else ''} END)"


def pos_case(u: str, ws=dims.ANSWER_POSITION_WEIGHTS) -> str:
    run, out = 0.0, ""
    for i, w in enumerate(ws[:-1]):
        run += w / sum(ws)
        out += f" WHEN {u} < {run!r}::DOUBLE THEN {i}"
    return f"(CASE{out} ELSE {len(ws) - 1} END)"


def shuf(lst: str, seed: str, *keys: str) -> str:
    """Array shuffled by digest of (seed, keys, element)."""
    k = ", ".join(["'" + seed + "'", *keys])
    return f"[z.v for z in list_sort([{{'h': md5(concat_ws(':', {k}, x)), 'v': x}} for x in {lst}])]"


def numbered(body: str, persp: str) -> str:
    return f"SELECT '{persp}' AS perspective, image_id, row_number() OVER (PARTITION BY image_id ORDER BY slot) - 1 AS question_id, question, choices, answer FROM ({body})"


COUNTING_SQL = dict(
    cw=f"SELECT image_id, type, n, -ln(greatest({U('vqa:count', 'image_id', 'type')}, 2.0::DOUBLE ** -33)) / n AS k FROM ty",
    cs="SELECT image_id, type, n, row_number() OVER (PARTITION BY image_id ORDER BY k, type) - 1 AS slot FROM cw QUALIFY slot < 2",
    cz=f"SELECT image_id, arg_min(type, {H('vqa:zero', 'image_id', 'type')}) AS type, 0 AS n FROM ab GROUP BY 1",
    ca="SELECT image_id, type, n, slot FROM cs UNION ALL SELECT cz.image_id, cz.type, cz.n, (SELECT count(*) FROM cs WHERE cs.image_id = cz.image_id) FROM cz",
    cp=f"SELECT ca.*, present, {pos_case(U('vqa:cpos', 'image_id', 'slot', 'type'))} AS pos FROM ca JOIN im USING (image_id)",
    cc="SELECT *, [greatest(0, n + i - pos) for i in range(0, 4)] AS c FROM cp",
    qcount="SELECT 'counting' AS perspective, image_id, slot AS question_id, 'How many ' || " + clar("type", plural=True)
    + " || ' are there in the image?' AS question, CASE WHEN len(list_distinct(c)) < 4 THEN '0|1|2|3' ELSE array_to_string(c, '|') END AS choices, n::VARCHAR AS answer FROM cc",
)


@query("vqa_02_counting", ctes("shapes", **SCENE, **COUNTING_SQL) + "SELECT * FROM qcount")
def _(t):
    return flat(Q.ask(profile(t), ["counting"]))


_CANON = "CASE WHEN contains(relation, 'tangent') THEN 'tangent' WHEN contains(relation, 'circumscribed') THEN 'circumscribed' WHEN contains(relation, 'inscribed') THEN 'inscribed' WHEN relation IN ('concentric', 'similar', 'symmetric') THEN NULL ELSE relation END"
_INV = "CASE rel " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.RELATION_INVERSE.items()) + " END"
_RELS = "[" + ", ".join(f"'{r}'" for r in dims.RELATIONS) + "]"
REL_BASE = dict(
    rt=f"""SELECT r.image_id, h.type AS t1, k.type AS t2, arg_max({_CANON}, ord) FILTER ({_CANON} IS NOT NULL) AS rel FROM relations r
      JOIN s h ON r.image_id = h.image_id AND r.head = h.shape_idx JOIN s k ON r.image_id = k.image_id AND r.tail = k.shape_idx
      GROUP BY 1, 2, 3""",
)
RELATION_SQL = dict(
    si="SELECT image_id, type FROM ty WHERE n = 1",
    ru="SELECT rt.* FROM rt JOIN si a ON rt.image_id = a.image_id AND t1 = a.type JOIN si b ON rt.image_id = b.image_id AND t2 = b.type WHERE rel IS NOT NULL",
    rp=f"SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {H('vqa:rel', 'image_id', 't1', 't2')}) AS slot FROM ru QUALIFY slot <= 2",
    ro=f"""SELECT image_id, slot, CASE WHEN f THEN t2 ELSE t1 END AS t1, CASE WHEN f THEN t1 ELSE t2 END AS t2, CASE WHEN f THEN {_INV} ELSE rel END AS rel
      FROM (SELECT *, {U('vqa:flip', 'image_id', 't1', 't2')} < 0.5 AND {_INV} IS NOT NULL AS f FROM rp)""",
    rn=f"""SELECT a.image_id, 9 AS slot, a.type AS t1, b.type AS t2, 'none of the above' AS rel FROM si a JOIN si b ON a.image_id = b.image_id AND a.type <> b.type
      WHERE {U('vqa:none', 'a.image_id')} < 0.3 AND NOT EXISTS (FROM rt WHERE rt.image_id = a.image_id AND ((t1 = a.type AND t2 = b.type) OR (t1 = b.type AND t2 = a.type)))
      QUALIFY row_number() OVER (PARTITION BY a.image_id ORDER BY {H('vqa:nonepair', 'a.image_id', 'a.type', 'b.type')}) = 1""",
    ra="SELECT x.*, present FROM (FROM ro UNION ALL SELECT image_id, slot, t1, t2, rel FROM rn) x JOIN im USING (image_id)",
    qrel=numbered(
        f"""SELECT image_id, slot, 'What is the relationship of the ' || {clar('t1')} || ' to the ' || {clar('t2')} || ' in the image?' AS question,
        array_to_string(CASE WHEN rel = 'none of the above' THEN {shuf(_RELS, 'vqa:rdis', 'image_id', 't1', 't2')}[1:3]
          ELSE {shuf('list_concat([rel], ' + shuf(f'[r for r in {_RELS} if r <> rel]', 'vqa:rdis', 'image_id', 't1', 't2') + '[1:2])', 'vqa:rshuf', 'image_id', 't1', 't2')} END, '|') || '|none of the above' AS choices,
        rel AS answer FROM ra""",
        "relation",
    ),
)


@query("vqa_03_relation", ctes("shapes", "relations", **SCENE, **REL_BASE, **RELATION_SQL) + "SELECT * FROM qrel")
def _(t):
    return flat(Q.ask(full_profile(t), ["relation"]))


def _size_sql() -> dict[str, str]:
    clip = lambda c: f"greatest(0.0, least(1.0, {c}))"
    parts = []
    for slot, (dim, val, cond) in enumerate(
        [
            ("horizontal span", f"abs({clip('max_x')} - {clip('min_x')})", "n = 1"),
            ("vertical span", f"abs({clip('max_y')} - {clip('min_y')})", "n = 1"),
            ("area", "area", "n = 1 AND type <> 'line'"),
        ]
    ):
        parts.append(
            f"SELECT image_id, {slot} AS slot, '{dim}' AS dim, type, {val} AS v, {U('vqa:spos', 'image_id', repr(dim))} AS u FROM ty WHERE {cond} "
            f"QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY {H(f'vqa:size:{dim}', 'image_id', 'type')}) = 1"
        )
    w = dims.ANSWER_POSITION_WEIGHTS
    ok = lambda p: f"(CASE WHEN v + 0.15::DOUBLE * {float(0 - p)!r}::DOUBLE >= 0 AND v + 0.15::DOUBLE * {float(3 - p)!r}::DOUBLE <= 1 THEN {w[p]!r}::DOUBLE ELSE 0.0::DOUBLE END)"
    return dict(
        za=" UNION ALL ".join(f"({p})" for p in parts),
        zw="SELECT *, " + ", ".join(f"{ok(p)} AS w{p}" for p in range(4)) + " FROM za",
        zp="SELECT *, CASE WHEN w0 > 0 AND u * (w0 + w1 + w2 + w3) < w0 THEN 0 WHEN w1 > 0 AND u * (w0 + w1 + w2 + w3) < w0 + w1 THEN 1 "
        "WHEN w2 > 0 AND u * (w0 + w1 + w2 + w3) < w0 + w1 + w2 THEN 2 WHEN w3 > 0 AND u * (w0 + w1 + w2 + w3) < w0 + w1 + w2 + w3 THEN 3 END AS p FROM zw",
        zc="SELECT *, [(round_even(v + 0.15::DOUBLE * (i - p)::DOUBLE, 2) + 0.0)::DOUBLE::VARCHAR for i in range(0, 4)] AS c FROM zp WHERE p IS NOT NULL",
        qsize=numbered(
            "SELECT zc.image_id, slot, 'Suppose that the width and height of the image is 1, which of the following is closest to the ' || dim || ' of the ' || "
            + clar("type")
            + " || '?' AS question, array_to_string("
            + shuf("c", "vqa:sshuf", "image_id", "dim")
            + ", '|') AS choices, c[p + 1] AS answer FROM zc JOIN im USING (image_id)",
            "size",
        ),
    )


SIZE_SQL = _size_sql()


@query("vqa_04_size", ctes("shapes", **SCENE, **SIZE_SQL) + "SELECT * FROM qsize")
def _(t):
    return flat(Q.ask(profile(t), ["size"]))


def _quad(x, y, rx, ry):
    return (
        f"CASE WHEN least(abs({x} - {rx}), abs({y} - {ry})) >= 0.03::DOUBLE THEN (CASE WHEN {y} > {ry} THEN 'upper ' ELSE 'lower ' END) || "
        f"(CASE WHEN {x} < {rx} THEN 'left' ELSE 'right' END) END"
    )


_FOUR = "['upper left', 'upper right', 'lower left', 'lower right']"
LOCATION_SQL = dict(
    la=f"SELECT image_id, type AS t1, '' AS t2, {_quad('cx', 'cy', '0.5::DOUBLE', '0.5::DOUBLE')} AS pos FROM ty WHERE n = 1",
    lb=f"SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {H('vqa:loc', 'image_id', 't1')}) AS slot FROM la WHERE pos IS NOT NULL QUALIFY slot <= 2",
    lr=f"SELECT a.image_id, a.type AS t1, b.type AS t2, {_quad('a.cx', 'a.cy', 'b.cx', 'b.cy')} AS pos FROM ty a JOIN ty b ON a.image_id = b.image_id AND a.type <> b.type WHERE a.n = 1 AND b.n = 1",
    ls=f"SELECT *, 3 AS slot FROM lr WHERE pos IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY {H('vqa:locrel', 'image_id', 't1', 't2')}) = 1",
    lq="SELECT x.*, present FROM (FROM lb UNION ALL FROM ls) x JOIN im USING (image_id)",
    qloc=numbered(
        f"""SELECT image_id, slot, CASE WHEN t2 = '' THEN 'Considering the centroid, where is the ' || {clar('t1')} || ' located in the image?'
          ELSE 'Considering the centroid, where is the ' || {clar('t1')} || ' located relative to the ' || {clar('t2')} || '?' END AS question,
          array_to_string({shuf(_FOUR, 'vqa:locshuf', 'image_id', 't1', 't2')}, '|') AS choices, pos AS answer FROM lq""",
        "location",
    ),
)


@query("vqa_05_06_location", ctes("shapes", **SCENE, **LOCATION_SQL) + "SELECT * FROM qloc")
def _(t):
    return flat(Q.ask(profile(t), ["location"]))


def _plural(x, mark):
    return f"CASE WHEN contains({x}, ' (') THEN replace({x}, ' (', '{mark} (') ELSE {x} || '{mark}' END"


_BEATS = "CASE WHEN {u} < 0.5 THEN {a}.min_area - {b}.max_area >= 0.02::DOUBLE ELSE {b}.min_area - {a}.max_area >= 0.02::DOUBLE END"
REFSIZE_SQL = dict(
    ya=f"SELECT ty.*, {U('vqa:sattr', 'image_id')} AS su FROM ty WHERE type <> 'line'",
    yp=f"""SELECT a.image_id, a.su, a.type AS ta, b.type AS tb, b.n AS bn FROM ya a JOIN ya b ON a.image_id = b.image_id WHERE {_BEATS.format(u='a.su', a='a', b='b')}
      QUALIFY row_number() OVER (PARTITION BY a.image_id ORDER BY {H('vqa:spair', 'a.image_id', 'a.type', 'b.type')}) = 1""",
    yd=f"""SELECT yp.image_id, k.type, row_number() OVER (PARTITION BY yp.image_id ORDER BY CASE WHEN yp.su < 0.5 THEN -k.max_area ELSE k.min_area END, k.ord) AS r
      FROM yp JOIN ya b ON yp.image_id = b.image_id AND b.type = yp.tb JOIN ya k ON k.image_id = yp.image_id AND k.type NOT IN (yp.ta, yp.tb)
      WHERE {_BEATS.format(u='yp.su', a='b', b='k')}""",
    yl="SELECT yp.*, present, list_concat(coalesce((SELECT list(type ORDER BY r) FROM yd WHERE yd.image_id = yp.image_id), []), [t for t in absent if t <> 'line'])[1:3] AS o FROM yp JOIN im USING (image_id)",
    qrs=f"""SELECT image_id, 'Which of the following is presented in the image and has a ' || CASE WHEN su < 0.5 THEN 'larger' ELSE 'smaller' END || ' area than '
      || CASE WHEN bn = 1 THEN 'the ' || {clar('tb')} ELSE 'all the ' || {_plural(clar('tb'), 's')} END || '?' AS question,
      {shuf('[' + clar('t') + " for t in list_concat(o, [ta])]", 'vqa:sizeshuf', 'image_id')} AS choices, {clar('ta')} AS answer FROM yl""",
)
REFFREQ_SQL = dict(
    fa=f"SELECT ty.*, {U('vqa:fattr', 'image_id')} AS fu FROM ty",
    fo="SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN fu < 0.5 THEN -n ELSE n END, CASE WHEN fu < 0.5 THEN '' ELSE type END, type DESC) AS r FROM fa",
    fp=f"""SELECT a.image_id, a.fu, a.type AS ta, b.type AS tb, b.r AS br FROM fo a JOIN fo b ON a.image_id = b.image_id
      WHERE CASE WHEN a.fu < 0.5 THEN a.n > b.n ELSE a.n < b.n END
      QUALIFY row_number() OVER (PARTITION BY a.image_id ORDER BY {H('vqa:fpair', 'a.image_id', 'a.type', 'b.type')}) = 1""",
    fl="SELECT fp.*, present, list_concat(coalesce((SELECT list(type ORDER BY r) FROM fo WHERE fo.image_id = fp.image_id AND fo.r > fp.br), []), absent)[1:3] AS o FROM fp JOIN im USING (image_id)",
    qrf=f"""SELECT image_id, 'Which of the following is presented in the image and appears ' || CASE WHEN fu < 0.5 THEN 'more' ELSE 'less' END || ' frequently than '
      || {_plural(clar('tb'), '(s)')} || '?' AS question, {shuf('[' + clar('t') + " for t in list_concat(o, [ta])]", 'vqa:freqshuf', 'image_id')} AS choices, {clar('ta')} AS answer FROM fl""",
)
_DIRS = "(VALUES " + ", ".join(f"({i}, '{t}', {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, (t, x, y) in enumerate(dims.DIRECTIONS)) + ") dir(d, dtext, vx, vy)"
_OV = "(greatest(0.0, least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x)) * greatest(0.0, least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y)))"
_AR = "(({0}.max_x - {0}.min_x) * ({0}.max_y - {0}.min_y))"
REFDIR_SQL = dict(
    dc="SELECT *, CASE WHEN n = 1 THEN 0 WHEN type = 'circle' THEN 1 ELSE 2 END AS g FROM ty WHERE (n = 1 AND type <> 'line') OR (n > 1 AND type IN ('circle', 'ellipse') AND one_spot)",
    dl="SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY g, idx) AS i, count(*) OVER (PARTITION BY image_id) AS m FROM dc QUALIFY m >= 3",
    dp=f"SELECT dl.*, d, dtext, cx * vx + cy * vy AS para, cx * vy - cy * vx AS perp FROM dl, {_DIRS}",
    dr="SELECT *, row_number() OVER (PARTITION BY image_id, d ORDER BY para DESC, perp DESC, i) AS r FROM dp",
    da=f"""SELECT a.image_id, a.d, a.dtext, a.type AS ta, b.type AS tb FROM dr a JOIN dr b ON a.image_id = b.image_id AND a.d = b.d AND a.r = 1 AND b.r > 1
      WHERE a.para - b.para >= 0.04::DOUBLE AND atan2(abs(a.perp - b.perp), abs(a.para - b.para)) <= pi() / 9
       AND NOT EXISTS (FROM rt WHERE rt.image_id = a.image_id AND ((t1 = a.type AND t2 = b.type) OR (t1 = b.type AND t2 = a.type)))
       AND NOT EXISTS (FROM dr m WHERE m.image_id = a.image_id AND m.d = a.d AND m.r > 1 AND m.r < b.r AND atan2(abs(m.perp - b.perp), abs(m.para - b.para)) < pi() / 5)
       AND {_OV} / {_AR.format('a')} <= 0.5 AND {_OV} / {_AR.format('b')} <= 0.5
      QUALIFY row_number() OVER (PARTITION BY a.image_id, a.d ORDER BY b.r) = 1""",
    dn="SELECT image_id, list(type ORDER BY i) AS c FROM dl GROUP BY 1",
    de="SELECT da.*, present, [t for t in list_concat(c, absent)[1:5] if t <> ta AND t <> tb][1:3] AS o FROM da JOIN dn USING (image_id) JOIN im USING (image_id)",
    qrd=f"""SELECT image_id, d, 'Considering the centroid, which of the following is ' || dtext || ' the ' || {clar('tb')} || '?' AS question,
      {shuf('[' + clar('t') + " for t in list_concat(o, [ta])]", 'vqa:dirshuf', 'image_id', 'dtext')} AS choices, {clar('ta')} AS answer FROM de""",
)
_REGS = "(VALUES " + ", ".join(f"({r}, '{t[0]}')" for r, t in enumerate(dims.REGIONS)) + ") reg(r, rtext)"
REFREG_SQL = dict(
    gc=f"""SELECT image_id, r, rtext, type AS ta FROM ty, {_REGS} WHERE cand & (1 << r) > 0 AND far & (1 << r) = 0
      QUALIFY row_number() OVER (PARTITION BY image_id, r ORDER BY {H('vqa:region', 'image_id', 'rtext', 'type')}) = 1""",
    gf="SELECT gc.*, present, list_concat(coalesce((SELECT list(type ORDER BY ord) FROM ty WHERE ty.image_id = gc.image_id AND near & (1 << r) = 0), []), absent)[1:3] AS o FROM gc JOIN im USING (image_id)",
    qrg=f"""SELECT image_id, r, 'Considering the centroid, which of the following is ' || rtext || '?' AS question,
      {shuf('[' + clar('t') + " for t in list_concat(o, [ta])]", 'vqa:regshuf', 'image_id', 'rtext')} AS choices, {clar('ta')} AS answer FROM gf""",
)
_REF_ALL = {**REL_BASE, **REFSIZE_SQL, **REFFREQ_SQL, **REFDIR_SQL, **REFREG_SQL}
REFERENCE_SQL = dict(
    **_REF_ALL,
    xs="SELECT image_id, question, choices, answer FROM qrd WHERE answer <> 'line' UNION ALL SELECT image_id, question, choices, answer FROM qrg WHERE answer <> 'line'",
    xa=f"SELECT DISTINCT image_id, answer FROM xs QUALIFY dense_rank() OVER (PARTITION BY image_id ORDER BY {H('vqa:refans', 'image_id', 'answer')}) <= 2",
    xp=f"SELECT xs.* FROM xs JOIN xa USING (image_id, answer) QUALIFY row_number() OVER (PARTITION BY image_id, answer ORDER BY {H('vqa:refpick', 'image_id', 'question')}) = 1",
    xe="SELECT image_id, question, choices, answer FROM xp UNION ALL FROM qrs UNION ALL FROM qrf",
    qref=f"""SELECT 'reference' AS perspective, image_id, row_number() OVER (PARTITION BY image_id ORDER BY {H('vqa:reffinal', 'image_id', 'question')}) - 1 AS question_id,
      question, array_to_string(choices, '|') AS choices, answer FROM xe QUALIFY question_id < 3""",
)


_FLATQ = "SELECT image_id, question, array_to_string(choices, '|') AS choices, answer FROM "


@query("vqa_07a_ref_size", ctes("shapes", **SCENE, **REFSIZE_SQL) + _FLATQ + "qrs")
def _(t):
    q = Q.with_names(profile(t)).select("image_id", Q.ref_size().alias("q")).filter(F.col("q").isNotNull())
    return q.select("image_id", "q.question", F.array_join("q.choices", "|").alias("choices"), "q.answer")


@query("vqa_07b_ref_freq", ctes("shapes", **SCENE, **REFFREQ_SQL) + _FLATQ + "qrf")
def _(t):
    q = Q.with_names(profile(t)).select("image_id", Q.ref_freq().alias("q")).filter(F.col("q").isNotNull())
    return q.select("image_id", "q.question", F.array_join("q.choices", "|").alias("choices"), "q.answer")


@query("vqa_07c_ref_direction", ctes("shapes", "relations", **SCENE, **REL_BASE, **REFDIR_SQL) + _FLATQ + "qrd")
def _(t):
    q = Q.with_names(full_profile(t)).select("image_id", F.explode(Q.ref_direction()).alias("q"))
    return q.select("image_id", "q.question", F.array_join("q.choices", "|").alias("choices"), "q.answer")


@query("vqa_07d_ref_region", ctes("shapes", **SCENE, **REFREG_SQL) + _FLATQ + "qrg")
def _(t):
    q = Q.with_names(profile(t)).select("image_id", F.explode(Q.ref_region()).alias("q"))
    return q.select("image_id", "q.question", F.array_join("q.choices", "|").alias("choices"), "q.answer")


@query("vqa_07e_reference", ctes("shapes", "relations", **SCENE, **REFERENCE_SQL) + "SELECT * FROM qref")
def _(t):
    return flat(Q.ask(full_profile(t), ["reference"]))


# existence: pair questions and one multiple choice with clarified choices


def _exist_sql() -> dict[str, str]:
    p1 = shuf("present", "vqa:extt", "image_id")
    f1 = shuf("absent", "vqa:exff", "image_id")
    only = lambda t: f"('No, only the ' || {t} || ' exists.')"

    def pair(src, name, ans, slot):
        fl = f"({U(f'vqa:{name}idx', 'image_id')} < 0.5)"
        return (
            f"SELECT image_id, {slot} AS slot, 'Is there a ' || a || ' and a ' || b || ' in the image?' AS question, "
            f"'Yes, both exist.|' || CASE WHEN {fl} THEN {only('b')} ELSE {only('a')} END || '|' || CASE WHEN {fl} THEN {only('a')} ELSE {only('b')} END || '|No, neither exists.' AS choices, "
            f"{ans} AS answer FROM {src}"
        )

    out = dict(
        ek="SELECT *, " + shuf("['TT', 'TF', 'FT', 'FF']", "vqa:exkind", "image_id") + "[1:2] AS kinds, len(present) AS np, len(absent) AS na FROM im",
        e1=f"SELECT image_id, {clar('x[1]')} AS a, {clar('x[2]')} AS b FROM (SELECT *, {p1} AS x FROM ek WHERE list_contains(kinds, 'TT') AND np >= 2)",
        e2=f"SELECT image_id, {clar('x[1]')} AS a, {clar('x[2]')} AS b FROM (SELECT *, {f1} AS x FROM ek WHERE list_contains(kinds, 'FF') AND na >= 2)",
        e3=f"SELECT image_id, CASE WHEN sw THEN ac ELSE pc END AS a, CASE WHEN sw THEN pc ELSE ac END AS b, pc FROM (SELECT image_id, {U('vqa:exswap', 'image_id')} < 0.5 AS sw, {clar('p')} AS pc, {clar('q')} AS ac FROM "
        f"(SELECT *, {shuf('present', 'vqa:extfp', 'image_id')}[1] AS p, {shuf('absent', 'vqa:extfa', 'image_id')}[1] AS q FROM ek WHERE list_has_any(kinds, ['TF', 'FT']) AND np >= 1 AND na >= 1))",
        em=f"SELECT *, CASE WHEN np >= 3 AND na >= 1 AND na >= 3 THEN {U('vqa:exmc', 'image_id')} < 0.5 ELSE np >= 3 AND na >= 1 END AS miss FROM ek WHERE (np >= 3 AND na >= 1) OR (np >= 1 AND na >= 3)",
        en=f"SELECT *, {shuf('present', 'vqa:exmcp', 'image_id')} AS sp, {shuf('absent', 'vqa:exmca', 'image_id')} AS sa FROM em",
        ec0="SELECT image_id, miss, CASE WHEN miss THEN sa[1] ELSE sp[1] END AS answer, CASE WHEN miss THEN sp[1:3] ELSE present END AS around, "
        + shuf("CASE WHEN miss THEN list_concat(sp[1:3], sa[1:1]) ELSE list_concat(sa[1:3], sp[1:1]) END", "vqa:exmcshuf", "image_id")
        + " AS c FROM en",
    )
    for k, parent in enumerate(dims.TYPE_CHILDREN):
        kids: dict[str, list[str]] = {}
        for c, d in dims.TYPE_CHILDREN[parent]:
            kids.setdefault(d, []).append(c)
        ds = "concat_ws(', ', " + ", ".join(
            "CASE WHEN list_has_any(list_concat(c, around), [" + ", ".join(f"'{c}'" for c in cs) + f"]) THEN '{d}s' END" for d, cs in kids.items()
        ) + ")"
        text = f"'{parent} (' || {ds} || ' excluded)'"
        out[f"ec{k + 1}"] = (
            f"SELECT image_id, miss, around, CASE WHEN list_contains(c, '{parent}') AND {ds} <> '' AND answer = '{parent}' THEN {text} ELSE answer END AS answer, "
            f"CASE WHEN list_contains(c, '{parent}') AND {ds} <> '' THEN [CASE WHEN x = '{parent}' THEN {text} ELSE x END for x in c] ELSE c END AS c FROM ec{k}"
        )
    last = f"ec{len(dims.TYPE_CHILDREN)}"
    out["qex"] = numbered(
        " UNION ALL ".join(
            [
                pair("e1", "extt", "'Yes, both exist.'", 0),
                pair("e2", "exff", "'No, neither exists.'", 1),
                pair("e3", "extf", only("pc"), 2),
                f"SELECT image_id, 3, 'Which of the following is ' || CASE WHEN miss THEN 'absent' ELSE 'present' END || ' in the image?', array_to_string(c, '|'), answer FROM {last}",
            ]
        ),
        "existence",
    )
    return out


EXIST_SQL = _exist_sql()


@query("vqa_08_existence", ctes("shapes", **SCENE, **EXIST_SQL) + "SELECT * FROM qex")
def _(t):
    return flat(Q.ask(profile(t), ["existence"]))


_ALL = {**SCENE, **COUNTING_SQL, **REFERENCE_SQL, **RELATION_SQL, **SIZE_SQL, **LOCATION_SQL, **EXIST_SQL}
ALL_SQL = ctes("shapes", "relations", **_ALL, allq=" UNION ALL ".join(f"SELECT * FROM {q}" for q in ("qcount", "qrel", "qsize", "qloc", "qref", "qex")))


@query("vqa_01_gen_questions", ALL_SQL + "SELECT * FROM allq")
def _(t):
    return flat(Q.gen_questions(shapes(t), frame(t, "relations")))


@query(
    "vqa_09_canonical_relation",
    ctes("relations") + f"SELECT relation, coalesce({_CANON}, 'rejected') AS canonical, coalesce(CASE ({_CANON}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.RELATION_INVERSE.items()) + " END, '') AS inverse, count(*) AS n FROM relations GROUP BY ALL",
)
def _(t):
    c = Wd.canonical_relation("relation")
    return (
        frame(t, "relations")
        .groupBy("relation", F.coalesce(c, F.lit("rejected")).alias("canonical"), F.coalesce(Wd.inverse_relation(c), F.lit("")).alias("inverse"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "vqa_10_clarify",
    ctes("shapes", **SCENE) + f"SELECT ty.image_id, type, {clar('type')} AS one, {clar('type', plural=True)} AS many FROM ty JOIN im USING (image_id)",
)
def _(t):
    return profile(t).select("image_id", "present", F.explode("present").alias("type")).select(
        "image_id", "type", Wd.clarify(F.col("type"), F.col("present")).alias("one"),
        Wd.clarify(F.col("type"), F.col("present"), plural=True).alias("many"),
    )


@query(
    "vqa_11_clarify_choices",
    ctes("shapes", **SCENE, **{k: v for k, v in EXIST_SQL.items() if k in ("ek", "em", "en") or k.startswith("ec")})
    + f"SELECT image_id, answer, array_to_string(c, '|') AS choices FROM ec{len(dims.TYPE_CHILDREN)}",
)
def _(t):
    q = Q.ask(profile(t), ["existence"]).filter(F.col("question").startswith("Which of the following is"))
    return q.select("image_id", "answer", F.array_join("choices", "|").alias("choices"))


@query(
    "vqa_13_questionnaire",
    ALL_SQL
    + f""", k AS (SELECT image_id, row_number() OVER (ORDER BY md5('survey:' || image_id), image_id) AS k FROM (SELECT DISTINCT image_id FROM allq)),
    tn AS (SELECT image_id, k, (['existence','counting','size','location','reference','relation'])[(k - 1) % 6 + 1] AS perspective FROM k)
    SELECT perspective, image_id, question_id, question, answer, substr('ABCD', list_position(string_split(choices, '|'), answer), 1) AS key
    FROM allq JOIN tn USING (image_id, perspective) QUALIFY row_number() OVER (PARTITION BY perspective ORDER BY k, question_id) <= 10""",
)
def _(t):
    q = Q.questionnaire(Q.gen_questions(shapes(t), frame(t, "relations")), images=shapes(t))
    return q.select("perspective", "image_id", F.col("question_id").cast("bigint").alias("question_id"), "question", "answer", "key")


@query(
    "vqa_14_mc_prompt",
    ctes("shapes", **SCENE, **COUNTING_SQL)
    + "SELECT image_id, question_id, md5(question || chr(10) || array_to_string([chr(64 + i::INT) || '. ' || string_split(choices, '|')[i] for i in range(1, 5)], chr(10)) || chr(10) || '"
    + dims.EVAL_INSTRUCTION
    + "') AS prompt FROM qcount",
)
def _(t):
    return Q.ask(profile(t), ["counting"]).select(
        "image_id", F.col("question_id").cast("bigint").alias("question_id"),
        F.md5(Q.mc_prompt(F.col("question"), F.col("choices"))).alias("prompt"),
    )


_OPT = {
    "A": "p_name", "B": "p_type", "C": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END", "D": "CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'none' END",
}


@query(
    "vqa_15_rotate_options",
    "WITH x AS (SELECT p_partkey, " + ", ".join(f"{e} AS {c}" for c, e in _OPT.items())
    + """ FROM part), y AS (SELECT p_partkey, CASE WHEN C IS NULL THEN [A, B] WHEN D IS NULL THEN [A, B, C] ELSE [A, B, C, D] END AS o FROM x),
    z AS (SELECT *, unnest(range(0, len(o))) AS r FROM y)
    SELECT p_partkey, r::INT AS round_id, array_to_string(list_concat(o[r + 1:], o[:r]), '|') AS options,
      substr('ABCD', 1, len(o))[r + 1:] || substr('ABCD', 1, len(o))[:r] AS chars FROM z""",
)
def _(t):
    df = t.part.select("p_partkey", *[F.expr(e).alias(c) for c, e in _OPT.items()])
    return Q.rotate_options(df, ["A", "B", "C", "D"]).select(
        "p_partkey", "round_id", F.array_join("options", "|").alias("options"), F.array_join("option_char", "").alias("chars")
    )


def _bench(t):
    opts = F.when(F.col("p_size") % 2 == 0, F.array("p_name", "p_type", "p_brand", F.lit("d"), F.lit("e"))).otherwise(F.array().cast("array<string>"))
    return t.part.select(
        "p_partkey", F.col("p_brand").alias("image"), F.when(F.col("p_partkey") % 3 == 0, "zh").otherwise("en").alias("language"),
        F.when(F.col("p_size") % 2 == 0, "CLOSED").otherwise("OPEN").alias("answer_type"), F.col("p_name").alias("question"), opts.alias("options"),
    )


_BP = "md5('" + Q.BOXED_PROMPT.replace("'", "''") + "' || p_name || chr(10) || CASE WHEN p_size % 2 = 0 THEN '(A) ' || p_name || chr(10) || '(B) ' || p_type || chr(10) || '(C) ' || p_brand || chr(10) || '(D) d' || chr(10) || '(E) e' || chr(10) ELSE '' END)"


@query(
    "vqa_16_bench_prompt",
    f"""SELECT p_partkey, 'open_closed' AS style, md5('Question: ' || p_name || CASE WHEN p_size % 2 = 0 THEN '{Q.CLOSED_PROMPT}' ELSE '{Q.OPEN_PROMPT}' END) AS prompt FROM part WHERE p_partkey % 3 <> 0
    UNION ALL SELECT p_partkey, 'boxed', {_BP} FROM part WHERE p_brand <> 'Brand#7'
    UNION ALL SELECT p_partkey, 'missing', md5(p_name) FROM part WHERE p_brand = 'Brand#7'""",
)
def _(t):
    images = t.part.filter("p_brand <> 'Brand#7'").select(F.col("p_brand").alias("image")).distinct()
    b = _bench(t)
    a = Q.bench_prompt(b, "open_closed", language="en").withColumn("style", F.lit("open_closed"))
    c = Q.bench_prompt(b, "boxed", images=images).withColumn("style", F.lit("boxed"))
    m = Q.missing_images(b, images).withColumn("style", F.lit("missing")).withColumn("prompt", F.col("question"))
    cols = ["p_partkey", "style", F.md5("prompt").alias("prompt")]
    return a.select(*cols).unionByName(c.select(*cols)).unionByName(m.select(*cols))
