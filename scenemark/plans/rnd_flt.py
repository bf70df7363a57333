"""RND, ID, FLT, PRT: hash sampling, shuffling, numbering and slicing."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenemark import dims
from scenemark.functions import rnd as Rn
from scenemark.operators import sampling as Sm
from scenemark.plans.fixtures import ctes, frame
from scenemark.plans.registry import query
from scenemark.plans.vqa import H, U, pos_case, shuf


@query("rnd_01_u01", f"SELECT event_id, {U('seed', 'event_id', 'event_type')} AS u FROM events")
def _(t):
    return t.events.select("event_id", Rn.u01("seed", "event_id", "event_type").alias("u"))


@query(
    "rnd_02_sample_k",
    f"SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {H('s2', 'doc_id')}, doc_id) <= 5",
)
def _(t):
    return Sm.sample_k(t.documents.select("doc_id", "source"), ["source"], 5, "s2", ["doc_id"])


@query(
    "rnd_02_sample_k_large",
    f"SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY {H('s2l', 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')}) <= 2500",
)
def _(t):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return Sm.sample_k(t.lineitem.select("l_returnflag", *key), ["l_returnflag"], 2500, "s2l", key)


@query("rnd_02_sample_global", f"SELECT doc_id FROM documents ORDER BY {H('s2g', 'doc_id')} LIMIT 25")
def _(t):
    return Sm.sample_global(t.documents.select("doc_id"), 25, "s2g", ["doc_id"])


@query(
    "rnd_03_sample_weighted",
    f"SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY -ln(greatest({U('s3', 'doc_id')}, 2.0::DOUBLE ** -33)) / n_chars, doc_id) <= 5",
)
def _(t):
    d = t.documents.select("doc_id", "source", "n_chars")
    return Sm.sample_weighted(d, ["source"], "n_chars", 5, "s3", ["doc_id"]).select("source", "doc_id")


@query(
    "rnd_04_pick_weighted",
    f"SELECT {pos_case(U('s4', 'event_id'))} AS pick, count(*) AS n FROM events GROUP BY 1",
)
def _(t):
    p = Rn.pick_weighted(Rn.u01("s4", "event_id"), dims.ANSWER_POSITION_WEIGHTS)
    return t.events.groupBy(p.alias("pick")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "rnd_05_shuffle_array",
    ctes("replies") + f"SELECT image_id, question_id, array_to_string({shuf('choices', 's5', 'image_id', 'question_id')}, '|') AS choices FROM replies",
)
def _(t):
    return frame(t, "replies").select(
        "image_id", "question_id", F.array_join(Rn.shuffle_by_hash(F.col("choices"), "s5", "image_id", "question_id"), "|").alias("choices")
    )


@query(
    "rnd_06_shuffle_rows",
    f"SELECT doc_id, row_number() OVER (ORDER BY {H('s6', 'doc_id')}, doc_id) AS pos FROM documents",
)
def _(t):
    return Sm.hash_rank(t.documents.select("doc_id"), [], ["doc_id"], "s6", "pos")


@query("rnd_07_keep_prob", f"SELECT event_id FROM events WHERE {U('s7', 'event_id')} < 0.3")
def _(t):
    return t.events.filter(Rn.keep_prob(0.3, "s7", "event_id")).select("event_id")


@query(
    "rnd_08_quota_sample",
    f"""WITH q(source, target) AS (SELECT source, length(source) * 3 FROM documents GROUP BY 1)
    SELECT source, doc_id FROM documents JOIN q USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY {H('s8', 'doc_id')}, doc_id) <= any_value(target) OVER (PARTITION BY source)""",
)
def _(t):
    d = t.documents.select("doc_id", "source")
    targets = d.select("source").distinct().withColumn("target", F.length("source") * 3)
    return Sm.quota_sample(d, "source", targets, "s8", ["doc_id"])


@query(
    "rnd_09_few_shot",
    """WITH tr AS (SELECT doc_id AS demo, row_number() OVER (ORDER BY md5('s9:train:' || doc_id), doc_id) - 1 AS tid FROM documents WHERE doc_id % 4 <> 0),
    n AS (SELECT count(*) AS n FROM tr), te AS (SELECT doc_id FROM documents WHERE doc_id % 4 = 0),
    dr AS (SELECT doc_id, n, [('0x' || substr(md5(concat_ws(':', 's9', doc_id, i)), 1, 8))::BIGINT % n for i in range(0, 12)] AS d FROM te, n),
    pk AS (SELECT doc_id, list_concat(d, [(d[1] + i) % n for i in range(0, 3)]) AS d FROM dr),
    ex AS (SELECT doc_id, unnest(d) AS tid, unnest(range(0, 15)) AS ord FROM pk),
    fi AS (SELECT doc_id, tid, min(ord) AS ord FROM ex GROUP BY 1, 2),
    rk AS (SELECT doc_id, tid, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS shot FROM fi QUALIFY shot < 3)
    SELECT doc_id, shot::INT AS shot, demo FROM rk JOIN tr USING (tid)""",
)
def _(t):
    d = t.documents.select("doc_id")
    train = d.filter("doc_id % 4 <> 0").select(F.col("doc_id").alias("demo"))
    return Sm.few_shot(d.filter("doc_id % 4 = 0"), train, 3, "s9", "doc_id", ["demo"])


@query(
    "id_01_with_seq_id",
    "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS id FROM events",
)
def _(t):
    return Sm.with_seq_id(t.events.select("event_id", "ts"), ["ts", "event_id"]).drop("ts")


@query("flt_01_slice", "SELECT doc_id, n_chars FROM documents WHERE doc_id >= 100 AND doc_id < 700")
def _(t):
    return Sm.slice_ids(t.documents.select("doc_id", "n_chars"), 100, 700, "doc_id")


@query(
    "flt_02_predictions_in_range",
    ctes("replies") + "SELECT model, image_id, question_id FROM replies WHERE image_id >= 10 AND image_id < 90",
)
def _(t):
    return Sm.slice_ids(frame(t, "replies"), 10, 90, "image_id").select("model", "image_id", "question_id")


@query(
    "prt_01_chunk",
    "WITH n AS (SELECT ceil(count(*) / 7.0) AS c FROM documents), s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS id FROM documents) SELECT doc_id, id FROM s, n WHERE floor(id / c) = 3",
)
def _(t):
    return Sm.chunk(Sm.with_seq_id(t.documents.select("doc_id"), ["doc_id"]), 7, 3)
