"""SIM, SRC, SNK, RES-2: similarity, readers and writers, incremental runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scenemark import session
from scenemark.functions import geometry as G
from scenemark.functions.numeric import rnd
from scenemark.operators import similarity as Si
from scenemark.plans.cap import shell_shapes
from scenemark.plans.fixtures import ctes, frame
from scenemark.plans.geo import R, polygons
from scenemark.plans.registry import query
from scenemark.plans.vqa import shapes as scene_shapes
from scenemark.sources import readers as Rd
from scenemark.sources import writers as Wr
from scenemark.streaming.predictions import read_sink, stream_predictions


def scratch(t) -> str:
    return session.scratch(t.spark)


# --- similarity -------------------------------------------------------------------------


def _ratios(t):
    return t.documents.select(F.col("doc_id").alias("id"), (F.col("n_chars") / 7.0 % 13 + 1).alias("ratio"))


@query(
    "sim_01_nearest_ratio",
    f"""WITH d AS (SELECT doc_id AS id, (n_chars / 7.0::DOUBLE) % 13 + 1 AS ratio FROM documents), q AS (SELECT * FROM d WHERE id % 10 = 0), p AS (SELECT * FROM d WHERE id % 10 <> 0),
    j AS (SELECT q.id, abs(q.ratio - p.ratio) AS dist FROM q, p), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist) AS k FROM j QUALIFY k <= 3)
    SELECT id, count(*) AS n, {R('sum(dist)', 6)} AS total, {R('max(dist)', 6)} AS worst FROM r GROUP BY 1""",
)
def _(t):
    r = _ratios(t)
    near = Si.nearest_ratio(r.filter("id % 10 = 0"), r.filter("id % 10 <> 0"), 3)
    return near.groupBy("id").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("distance"), 6).alias("total"), rnd(F.max("distance"), 6).alias("worst"))


_EMB = "WITH e AS (SELECT vec_id AS id, [embedding[i]::DOUBLE + 0.5::DOUBLE for i in range(1, 65)] AS v FROM embeddings), s AS (SELECT id, k, v[2 * k + 1] AS x, v[2 * k + 2] AS y FROM (SELECT *, unnest(range(0, 32)) AS k FROM e))"


@query(
    "sim_02_nearest_contour",
    _EMB
    + f""", d AS (SELECT a.id AS q, b.id AS p, a.k AS i, b.k AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM s a, s b WHERE a.id % 10 = 0 AND b.id % 10 <> 0),
    o AS (SELECT q, p, max(m) AS h FROM (SELECT q, p, i, min(d) AS m FROM d GROUP BY 1, 2, 3) GROUP BY 1, 2), w AS (SELECT q, p, max(m) AS h FROM (SELECT q, p, j, min(d) AS m FROM d GROUP BY 1, 2, 3) GROUP BY 1, 2),
    f AS (SELECT q, p, greatest(o.h, w.h) AS h FROM o JOIN w USING (q, p)), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY h, p) AS k FROM f QUALIFY k <= 3)
    SELECT q AS id, p AS match, {R('h', 6)} AS distance FROM r""",
)
def _(t):
    p = polygons(t).select(F.col("vec_id").alias("id"), "points")
    near = Si.nearest_contour(p.filter("id % 10 = 0"), p.filter("id % 10 <> 0"), 3)
    return near.select("id", "match", rnd("distance", 6).alias("distance"))


_RADII = [0.2 * 10 ** (k / 3) for k in range(4)]
_DP = ", ".join(
    f"m{k + 1} AS (SELECT q, p, mask | (1 << j) AS mask, min(m{k}.c + c.c) AS c FROM m{k} JOIN c USING (q, p) WHERE i = {k} AND mask & (1 << j) = 0 GROUP BY 1, 2, 3)"
    for k in range(8)
)


@query(
    "sim_02_shape_context",
    _EMB
    + f""", d AS (SELECT a.id, a.k, b.x - a.x AS x, b.y - a.y AS y, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM s a JOIN s b ON a.id = b.id AND a.k <> b.k),
    r AS (SELECT id, k // 4 AS l, d.d / avg(d.d) OVER (PARTITION BY id) AS r, atan2(y, x) AS t, k % 4 = 0 AS landmark FROM d),
    b AS (SELECT id, l, {" + ".join(f"(r >= {e!r}::DOUBLE)::INT" for e in _RADII)} AS ring, least(floor((CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END) * 12 / (2 * pi())), 11) AS part FROM r WHERE landmark),
    h AS (SELECT id, l, ring * 12 + part AS bin, count(*) / 31.0::DOUBLE AS h FROM b WHERE ring < 4 GROUP BY ALL),
    t AS (SELECT id, l, coalesce(sum(h), 0) AS t FROM (SELECT DISTINCT id, l FROM b) LEFT JOIN h USING (id, l) GROUP BY 1, 2),
    o AS (SELECT a.id AS q, b.id AS p, a.l AS i, b.l AS j, sum(a.h * b.h / (a.h + b.h)) AS o FROM h a JOIN h b USING (bin) WHERE a.id % 10 = 0 AND b.id % 10 <> 0 GROUP BY ALL),
    c AS (SELECT a.id AS q, b.id AS p, a.l AS i, b.l AS j, 0.5 * (a.t + b.t - 4 * coalesce(o, 0)) AS c FROM (SELECT * FROM t WHERE id % 10 = 0) a CROSS JOIN (SELECT * FROM t WHERE id % 10 <> 0) b LEFT JOIN o ON q = a.id AND p = b.id AND i = a.l AND j = b.l),
    m0 AS (SELECT DISTINCT q, p, 0 AS mask, 0.0::DOUBLE AS c FROM c), {_DP},
    f AS (SELECT q, c / 8 AS d, row_number() OVER (PARTITION BY q ORDER BY c) AS place FROM m8 QUALIFY place <= 3)
    SELECT q AS id, place::INT AS place, {R('d', 6)} AS distance FROM f""",
)
def _(t):
    """Best assignments by dynamic programming over sets of landmarks on the other side; equal
    contours tie, so places are compared, not partners."""
    at = lambda i: F.struct((F.get("embedding", 2 * i).cast("double") + 0.5).alias("x"), (F.get("embedding", 2 * i + 1).cast("double") + 0.5).alias("y"))
    p = t.embeddings.select(F.col("vec_id").alias("id"), F.transform(F.sequence(F.lit(0), (F.size("embedding") / 2).cast("int") - 1), at).alias("points"))
    near = Si.nearest_shape(p.filter("id % 10 = 0"), p.filter("id % 10 <> 0"), 3)
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "match"))
    return near.select("id", place.alias("place"), rnd("distance", 6).alias("distance"))


@query(
    "sim_03_query_shape",
    """WITH l AS (SELECT DISTINCT l_orderkey AS image_id, l_linenumber * 1000 + l_partkey % 1000 AS vi FROM lineitem WHERE l_partkey % 11 <> 0)
    SELECT image_id, 'volution ' || max(vi) AS special_info FROM l GROUP BY 1""",
)
def _(t):
    return Si.query_shape(shell_shapes(t)).select("image_id", "special_info")


def _lines(t):
    """Polylines of two to six points per line item; about a third nearly repeat another."""
    s = scene_shapes(t)
    n = (F.col("shape_idx") % 5 + 2).cast("int")
    at = lambda i: G.pt(F.floor(F.col("cx") * 4) * 250.0 + i * 20.0, F.floor(F.col("cy") * 4) * 250.0 + (F.col("shape_idx") % 3) * 10.0)
    return s.select("image_id", F.col("shape_idx").alias("seq"), F.transform(F.sequence(F.lit(0), n - 1), at).alias("points"))


_PAIRS = dict(
    s="SELECT image_id, shape_idx AS seq, floor(cx::DOUBLE * 4) * 250 AS bx, floor(cy::DOUBLE * 4) * 250 + (shape_idx % 3) * 10 AS y, (shape_idx % 5 + 2)::INT AS n FROM shapes",
    p="SELECT image_id, seq, n, bx + i * 20 AS x, y FROM (SELECT *, unnest(range(0, n)) AS i FROM s)",
    d="SELECT a.image_id, a.seq AS i, b.seq AS j, a.n AS ni, b.n AS nj, a.x AS ax, b.x AS bx, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.image_id = b.image_id AND a.seq < b.seq",
    m="SELECT image_id, i, j, ni, nj, sum(m) AS t FROM (SELECT image_id, i, j, ni, nj, ax, min(d) AS m FROM d GROUP BY ALL UNION ALL SELECT image_id, i, j, ni, nj, bx, min(d) FROM d GROUP BY ALL) GROUP BY ALL",
)


@query(
    "sim_04_dedup_polylines",
    ctes(
        "shapes",
        **_PAIRS,
        o="SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY i, j) AS k FROM m WHERE t / (ni + nj) < 100",
        g="""SELECT image_id, 0::BIGINT AS k, []::BIGINT[] AS gone FROM (SELECT DISTINCT image_id FROM o)
        UNION ALL SELECT g.image_id, o.k, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone ELSE list_append(gone, CASE WHEN ni >= nj THEN j ELSE i END) END FROM g JOIN o ON o.image_id = g.image_id AND o.k = g.k + 1""",
        f="SELECT image_id, unnest(arg_max(gone, k)) AS seq FROM g GROUP BY 1",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT image_id, seq, n AS n_points FROM s ANTI JOIN f USING (image_id, seq)",
)
def _(t):
    kept = Si.dedup_polylines(_lines(t), 100.0, 1250.0)
    return kept.select("image_id", "seq", F.size("points").alias("n_points"))


@query("sim_04_duplicate_pairs", ctes("shapes", **_PAIRS) + "SELECT image_id, i, j, ni AS len_i, nj AS len_j FROM m WHERE t / (ni + nj) < 100")
def _(t):
    return Si.duplicate_pairs(_lines(t), 100.0, 1250.0)


# --- readers and writers: tables are written out and read back -----------------------------


_EV = "event_id long, event_type string, value double"


def _events(t):
    return t.events.select("event_id", "event_type", "value")


@query("src_01_snk_01_jsonl", "SELECT event_id, event_type, value FROM events")
def _(t):
    path = scratch(t)
    Wr.write_jsonl(_events(t), path)
    return Rd.read_jsonl(t.spark, path, _EV)


@query("src_01_rejects", "SELECT event_id, event_id % 7 = 0 AS rejected FROM events")
def _(t):
    """Lines of which every seventh is cut off: good rows and rejects together."""
    path = scratch(t)
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    cut_off = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"))
    t.events.select(F.when(F.col("event_id") % 7 == 0, cut_off).otherwise(line).alias("value")).write.text(path)
    rows, rejects = Rd.read_jsonl_checked(t.spark, path, _EV)
    cut = F.regexp_extract("line", r"(\d+)$", 1).cast("long").alias("event_id")
    return rows.select("event_id", F.lit(False).alias("rejected")).unionByName(rejects.select(cut, F.lit(True).alias("rejected")))


@query("src_02_json_array", "SELECT p_partkey, p_name FROM part")
def _(t):
    path = scratch(t)
    # one array per file, a few hundred parts each
    arr = t.part.groupBy(F.floor(F.col("p_partkey") / 500).alias("g")).agg(
        F.to_json(F.collect_list(F.struct("p_partkey", "p_name"))).alias("value")
    )
    arr.select("g", "value").write.partitionBy("g").text(path)
    return Rd.read_json_array(t.spark, path, "p_partkey long, p_name string").select("p_partkey", "p_name")


@query("src_03_json_map", "SELECT p_partkey::VARCHAR AS image, p_type AS \"desc\", (p_size % 7) / 8.0::DOUBLE AS scale FROM part")
def _(t):
    path = scratch(t)
    entries = F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("k"), F.struct(F.col("p_type").alias("desc"), (F.col("p_size") % 7 / 8.0).alias("scale")).alias("v")))
    t.part.groupBy(F.floor(F.col("p_partkey") / 500).alias("g")).agg(F.to_json(F.map_from_entries(entries)).alias("value")).select("g", "value").write.partitionBy("g").text(path)
    return Rd.read_json_map(t.spark, path, "struct<desc:string,scale:double>", "image")


@query(
    "src_04_read_any",
    "SELECT p_partkey, p_name, 'json' AS kind FROM part UNION ALL SELECT p_partkey, p_name, 'jsonl' FROM part",
)
def _(t):
    base, schema = scratch(t), "p_partkey long, p_name string"
    arr = t.part.groupBy(F.floor(F.col("p_partkey") / 500).alias("g")).agg(F.to_json(F.collect_list(F.struct("p_partkey", "p_name"))).alias("value"))
    arr.select("g", "value").write.partitionBy("g").text(f"{base}/a.json")
    Wr.write_jsonl(t.part.select("p_partkey", "p_name"), f"{base}/a.jsonl")
    parts = [
        Rd.read_any(t.spark, f"{base}/a.{k}", schema).select("p_partkey", "p_name", F.lit(k).alias("kind")) for k in ("json", "jsonl")
    ]
    return parts[0].unionByName(parts[1])


@query("src_05_csv", "SELECT conv_id, turn, md5(text) AS text FROM conversations")
def _(t):
    path = scratch(t)
    t.conversations.select("conv_id", "turn", "text").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return Rd.read_csv(t.spark, path, "conv_id long, turn long, text string", multiline=True).withColumn("text", F.md5("text"))


@query(
    "src_06_options_tsv",
    "SELECT p_partkey, p_name AS A, CASE WHEN p_size % 3 > 0 THEN p_type END AS B, CASE WHEN p_size % 4 > 0 THEN p_brand END AS C FROM part",
)
def _(t):
    path = scratch(t)
    b = F.when(F.col("p_size") % 3 > 0, F.col("p_type")).otherwise("NaN")
    c = F.when(F.col("p_size") % 4 > 0, F.col("p_brand")).otherwise("None")
    t.part.select("p_partkey", F.col("p_name").alias("A"), b.alias("B"), c.alias("C")).write.option("header", True).option("sep", "\t").csv(path)
    return Rd.read_options_tsv(t.spark, path, "p_partkey long, A string, B string, C string", ["A", "B", "C"])


def _lines_of(t, sep: str):
    """Lines of which every fifth is short, long or ill-typed, with a header line per file."""
    k = F.col("event_id") % 15
    cells = [F.col("event_id").cast("string"), F.when(k == 10, "x").otherwise(F.col("value").cast("string")), F.when(k % 2 == 0, "NaN").otherwise(F.col("event_type"))]
    line = F.when(k == 0, cells[0]).when(k == 5, F.concat_ws(sep, *cells, F.lit("more"))).otherwise(F.concat_ws(sep, *cells))
    head = t.spark.createDataFrame([(sep.join(("event_id", "value", "kind")),)], "value string")
    path = scratch(t)
    # a file per hundred ids, so that each header is followed by its own lines
    rows = t.events.select(F.floor(F.col("event_id") / 1000).alias("g"), F.lit(1).alias("o"), "event_id", line.alias("value"))
    tops = rows.select("g").distinct().crossJoin(head).select("g", F.lit(0).alias("o"), F.lit(-1).cast("bigint").alias("event_id"), "value")
    rows.unionByName(tops).repartition("g").sortWithinPartitions("g", "o", "event_id").select("g", "value").write.partitionBy("g").text(path)
    return path


_BAD = "SELECT event_id, event_id % 5 = 0 AS rejected, CASE WHEN event_id % 5 > 0 THEN value END AS value, CASE WHEN event_id % 5 > 0 {more}THEN event_type END AS kind FROM events"


def _both(rows, rejects, sep: str):
    ids = F.split("line", sep)[0].cast("long").alias("event_id")
    bad = rejects.select(ids, (F.col("file") != "").alias("rejected"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("kind"))
    return rows.select("event_id", F.lit(False).alias("rejected"), "value", "kind").unionByName(bad)


_FIELDS = "event_id long, value double, kind string"


@query("src_05_rejects", _BAD.format(more="").replace("THEN event_type", "THEN CASE WHEN event_id % 15 % 2 = 0 THEN 'NaN' ELSE event_type END"))
def _(t):
    return _both(*Rd.read_csv_checked(t.spark, _lines_of(t, ","), _FIELDS), ",")


@query("src_06_rejects", _BAD.format(more="AND event_id % 15 % 2 > 0 "))
def _(t):
    return _both(*Rd.read_options_checked(t.spark, _lines_of(t, "\t"), _FIELDS, ["kind"]), "\t")


def _object():
    """A conversation turn as a JSON object with braces, quotes and escapes in its text; every
    seventh has a text where a number is due."""
    n = F.when(F.col("turn") % 7 == 6, F.lit("none")).otherwise(F.col("turn").cast("string"))
    number = F.when(F.col("turn") % 7 == 6, F.lit('"none"')).otherwise(n)
    text = F.to_json(F.struct(F.concat(F.lit('} "{ \\ '), F.coalesce("text", F.lit("")), F.lit(' ]}')).alias("t")))
    return F.concat(F.lit('{"conv_id": '), F.col("conv_id"), F.lit(', "turn": '), number, F.lit(', "inner": '), text, F.lit("}"))


def _json_files(t, entry, opens: str, closes: str):
    """Files of a hundred conversations each, all records of a file in one line."""
    path = scratch(t)
    g = F.floor(F.col("conv_id") / 100).alias("g")
    rows = t.conversations.groupBy(g).agg(F.concat(F.lit(opens), F.array_join(F.sort_array(F.collect_list(entry)), ", "), F.lit(closes)).alias("value"))
    rows.write.partitionBy("g").text(path)
    return path


_TURN = "conv_id long, turn long, inner struct<t:string>"
_TEXTS = r"""SELECT conv_id, turn % 7 = 6 AS rejected, count(*) AS n, md5(string_agg(CASE WHEN turn % 7 < 6 THEN turn || ':' || md5('} "{ \ ' || coalesce(text, '') || ' ]}') END, ',' ORDER BY turn, coalesce(text, ''))) AS texts FROM conversations GROUP BY 1, 2"""


def _turns(rows, rejects):
    found = F.concat_ws(":", F.col("turn").cast("string"), F.md5("inner.t"))
    good = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.col("inner.t").alias("t"), found.alias("f")))), lambda x: x["f"]), ",")).alias("texts"))
    conv = F.regexp_extract("line", r'"conv_id": (\d+)', 1).cast("long").alias("conv_id")
    bad = rejects.groupBy(conv).agg(F.count(F.lit(1)).alias("n")).withColumn("texts", F.lit(None).cast("string"))
    return good.withColumn("rejected", F.lit(False)).unionByName(bad.withColumn("rejected", F.lit(True)))


@query("src_02_json_records", _TEXTS)
def _(t):
    """Arrays in one line each, with rejects."""
    return _turns(*Rd.read_json_records(t.spark, _json_files(t, _object(), "[", "]"), _TURN))


@query("src_03_json_entries", _TEXTS)
def _(t):
    """Maps in one line each, with rejects."""
    entry = F.concat(F.to_json(F.struct(F.concat_ws('"', F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("k"))), F.lit(": "), _object())
    key = F.regexp_replace(entry, r'^\{"k":("(?:[^"\\]|\\.)*")\}', "$1")
    rows, rejects = Rd.read_json_entries(t.spark, _json_files(t, key, "{", "}"), _TURN, "key")
    return _turns(rows.filter(F.col("key") == F.concat_ws('"', F.col("conv_id").cast("string"), F.col("turn").cast("string"))), rejects)


@query("src_07_shards", "SELECT event_id, (event_id % 4)::INT AS shard FROM events")
def _(t):
    path = scratch(t)
    # one folder per shard, named like the shard files
    t.events.select("event_id", F.concat(F.lit("4_"), F.col("event_id") % 4, F.lit(".jsonl")).alias("name")).write.partitionBy("name").json(path)
    return Rd.read_shards(t.spark, f"{path}/name=4_*.jsonl", "event_id long").select("event_id", "shard")


@query(
    "src_08_ordered_files",
    "SELECT event_id, row_number() OVER (ORDER BY list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type), md5(event_id::VARCHAR)) - 1 AS id FROM events",
)
def _(t):
    """Lines in an order that no column of the files tells."""
    paths = []
    for kind in ("view", "click", "signup", "purchase", "error"):
        paths.append(scratch(t))
        Wr.write_jsonl(_events(t).filter(F.col("event_type") == kind).orderBy(F.md5(F.col("event_id").cast("string"))), paths[-1])
    return Rd.read_ordered(t.spark, paths, _EV)[0].select("event_id", "id")


_PRED = "model string, perspective string, image_id long, question_id long, response string"


@query("src_09_predictions", ctes("replies") + "SELECT model, perspective, image_id, question_id FROM replies WHERE model IN ('m1', 'm2')")
def _(t):
    path = scratch(t)
    frame(t, "replies").select("model", "perspective", "image_id", "question_id", "response").write.partitionBy("model", "perspective").json(path)
    p = Rd.read_predictions(t.spark, path, _PRED)
    return p.filter(F.col("model").isin("m1", "m2")).select("model", "perspective", "image_id", "question_id")


@query(
    "src_10_qa_parquet",
    "SELECT p_name AS question, p_type AS answer, p_size % 5 = 0 AS rejected, count(*) AS n FROM part WHERE p_size % 5 > 0 GROUP BY ALL UNION ALL SELECT p_name, NULL, true, count(*) FROM part WHERE p_size % 5 = 0 GROUP BY ALL",
)
def _(t):
    path = scratch(t)
    ans = F.when(F.col("p_size") % 5 > 0, F.array("p_type", "p_brand")).otherwise(F.array().cast("array<string>"))
    img = F.struct(F.col("p_name").cast("binary").alias("bytes"))
    t.part.select(img.alias("image"), F.col("p_name").alias("question"), ans.alias("answers")).write.parquet(path)
    ok, bad = Rd.read_qa_parquet(t.spark, [path])
    both = ok.withColumn("rejected", F.lit(False)).unionByName(bad.withColumn("rejected", F.lit(True)))
    return both.groupBy("question", "answer", "rejected").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snk_02_scores",
    ctes("ratings", p=f"SELECT feature, {R('avg(rating)', 2)} AS rating, count(rating) AS valid_count FROM ratings GROUP BY 1")
    + f"SELECT feature, rating, valid_count FROM p UNION ALL SELECT 'Average', {R('avg(rating)', 2)}, sum(valid_count)::BIGINT FROM p",
)
def _(t):
    path = scratch(t)
    p = frame(t, "ratings").groupBy("feature").agg(rnd(F.avg("rating"), 2).alias("rating"), F.count("rating").alias("valid_count"))
    s = p.agg(F.lit("Average").alias("feature"), rnd(F.avg("rating"), 2).alias("rating"), F.sum("valid_count").alias("valid_count"))
    Wr.write_scores(p, s, path)
    return Rd.read_csv(t.spark, path, "feature string, rating double, valid_count long")


@query("snk_03_questions", ctes("replies") + "SELECT perspective, image_id, question_id, answer FROM replies")
def _(t):
    path = scratch(t)
    Wr.write_questions(frame(t, "replies").select("perspective", "image_id", "question_id", "choices", "answer"), path)
    schema = "perspective string, image_id long, question_id long, answer string"
    return t.spark.read.schema(schema).json(path).select("perspective", "image_id", "question_id", "answer")


# --- incremental ----------------------------------------------------------------------------


@query(
    "res_02_stream_predictions",
    "SELECT event_type AS model, event_id AS image_id, value FROM events",
)
def _(t):
    """Files arrive in three runs that overlap and repeat rows; after the first the checkpoint is
    lost, and the next finds the sink filled.  Every key is appended once."""
    base = scratch(t)
    e = t.events.select(F.col("event_type").alias("model"), F.col("event_id").alias("image_id"), "value")
    schema, key = "model string, image_id long, value double", ("model", "image_id")
    parts = [e.filter("image_id % 3 = 0"), e.filter("image_id % 3 < 2"), e.filter("image_id % 3 > 0").unionByName(e.filter("image_id % 5 = 0"))]
    for k, part in enumerate(parts):
        part.write.mode("append").json(f"{base}/in")
        stream_predictions(t.spark, f"{base}/in", f"{base}/out", f"{base}/ckpt-{min(k, 1)}", schema, key, 4).awaitTermination()
    return read_sink(t.spark, f"{base}/out", schema)
