"""TXT, TRN, RES-1/3, VQA-12: tagged text, replies and corpus assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenemark import dims
from scenemark.functions import json_blocks as J
from scenemark.functions import text as X
from scenemark.operators import corpus as C
from scenemark.operators import replies as Rp
from scenemark.plans.fixtures import ctes, frame
from scenemark.plans.registry import query
from scenemark.plans.vqa import H, shuf

_TAGS = "[" + ", ".join(f"'{x}'" for x in dims.TAGS + ["others"]) + "]"


def tagged(t):
    tags = F.array(*[F.lit(x) for x in dims.TAGS + ["others"]])
    body = F.transform(
        F.split(F.translate("text", "<>", ""), r"\. "),
        lambda s, i: F.concat(
            F.lit("<"), F.get(tags, (i * 3 + F.col("doc_id")).cast("int") % 21), F.lit("> "), s, F.lit(" </"),
            F.get(tags, (i * 3 + F.col("doc_id")).cast("int") % 21), F.lit(">"),
        ),
    )
    return t.heavy("documents").select("doc_id", F.array_join(body, " ").alias("text"))


_TAGGED = f"""WITH d AS (SELECT doc_id, string_split(translate(text, '<>', ''), '. ') AS s FROM documents),
 g AS (SELECT doc_id, {_TAGS}[((i - 1) * 3 + doc_id) % 21 + 1] AS tag, i, regexp_replace(s[i], '^\\s+|\\s+$', '', 'g') AS c FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM d)),
 m AS (SELECT doc_id, tag, string_agg(c, '' ORDER BY i) AS c FROM g GROUP BY 1, 2)"""
_ORD = "(SELECT unnest([" + ", ".join(f"'{x}'" for x in dims.TAGS) + "]) AS tag, unnest(range(0, 20)) AS o)"


@query(
    "txt_01_reorder_tags",
    _TAGGED
    + f""", r AS (SELECT doc_id, string_agg('<' || tag || '>' || c || '</' || tag || '>', ' ' ORDER BY o) AS txt FROM m JOIN {_ORD} USING (tag) WHERE c <> '' GROUP BY 1)
    SELECT d.doc_id, md5(coalesce(txt, '')) AS txt FROM d LEFT JOIN r USING (doc_id)""",
)
def _(t):
    return tagged(t).select("doc_id", F.md5(X.reorder_tags("text")).alias("txt"))


_DEF = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in dims.TAG_DEFAULTS.items()) + ") df(tag, dflt)"


@query(
    "txt_04_fill_default_tags",
    _TAGGED
    + f""", a AS (SELECT d.doc_id, o.tag, o.o, coalesce(m.c, dflt) AS c FROM d CROSS JOIN {_ORD} o LEFT JOIN m ON m.doc_id = d.doc_id AND m.tag = o.tag LEFT JOIN {_DEF} ON df.tag = o.tag),
    r AS (SELECT doc_id, string_agg('<' || tag || '>' || c || '</' || tag || '>', ' ' ORDER BY o) AS txt FROM a WHERE c <> '' GROUP BY 1)
    SELECT doc_id, md5(txt) AS txt FROM r""",
)
def _(t):
    return tagged(t).select("doc_id", F.md5(X.fill_default_tags("text")).alias("txt"))


def _json_replies(t):
    """Replies that hold an array, an object, or brackets that do not match."""
    k = F.col("event_id") % 5
    arr = F.concat(F.lit("note ["), "props", F.lit(", "), "props", F.lit("] end"))
    return t.heavy("events").select(
        "event_id", "props",
        F.when(k == 0, arr)
        .when(k == 1, F.concat(F.lit("note "), "props", F.lit(" end")))
        .when(k == 2, F.concat(F.lit("note ] "), "props"))
        .when(k == 3, F.concat(F.lit("[oops] "), F.lit("[1, 2] tail {")))
        .otherwise("no brackets").alias("response"),
    )


@query(
    "txt_02_first_json_array",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '[' || props || ', ' || props || ']' WHEN 3 THEN '[1, 2]' END AS arr FROM events",
)
def _(t):
    return _json_replies(t).select("event_id", J.first_json_array("response").alias("arr"))


@query(
    "txt_03_first_json_block",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '[' || props || ', ' || props || ']' WHEN 1 THEN props WHEN 3 THEN '[oops]' END AS block,
     CASE WHEN event_id % 5 < 2 THEN ' end' WHEN event_id % 5 = 3 THEN ' [1, 2] tail {' END AS rest,
     CASE event_id % 5 WHEN 2 THEN 'unmatched closing bracket' WHEN 4 THEN 'no block' END AS error FROM events""",
)
def _(t):
    return _json_replies(t).select("event_id", J.first_json_block("response").alias("j")).select("event_id", "j.*")


@query(
    "txt_05_fill_prompt",
    """SELECT p_partkey, md5('Describe ' || p_name || ' with rules {"size":' || p_size || ',"type":"' || p_type || '"} and ' || p_name) AS prompt FROM part""",
)
def _(t):
    rules = F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_type").alias("type")))
    p = X.fill_prompt("Describe {text} with rules {rules} and {text}", text="p_name", rules=rules)
    return t.part.select("p_partkey", F.md5(p).alias("prompt"))


@query(
    "txt_06_replace_output",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE upper(p_name) END AS output FROM part",
)
def _(t):
    df = t.part.select("p_partkey", F.col("p_name").alias("output"))
    res = t.part.filter("p_partkey % 3 <> 0").select("p_partkey", F.upper("p_name").alias("result"))
    return Rp.replace_output(df, res, "p_partkey", "output")


@query(
    "txt_07_score_table",
    "SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 4)::DOUBLE END AS score, count(*) AS n FROM events GROUP BY 1",
)
def _(t):
    reply = F.when(F.col("event_id") % 7 == 0, "cannot judge").otherwise(
        F.concat(F.lit('Here: {"reason": "'), "event_type", F.lit('", "score": '), (F.col("event_id") % 4).cast("string"), F.lit("} done"))
    )
    return Rp.score_table(t.events.select(reply.alias("reply")))


@query(
    "txt_08_degenerate",
    """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN repeat('z', 50 + (doc_id % 90)::INT) || text ELSE text END AS txt FROM documents)
    SELECT doc_id, len(regexp_extract(txt, '^z*')) >= 100 AS deg, md5(CASE WHEN len(regexp_extract(txt, '^z*')) >= 100 THEN 'FAILED' ELSE substr(txt, 1, 100) END) AS head FROM x""",
)
def _(t):
    txt = F.when(F.col("doc_id") % 5 == 0, F.concat(F.repeat(F.lit("z"), (F.col("doc_id") % 90 + 50).cast("int")), "text")).otherwise(F.col("text"))
    d = t.documents.select("doc_id", txt.alias("txt"))
    return d.select("doc_id", X.is_degenerate("txt").alias("deg"), F.md5(X.clipped_reply("txt")).alias("head"))


@query(
    "txt_09_last_words",
    "WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, md5(array_to_string(CASE WHEN len(w) > 12 THEN w[-12:] ELSE w END, ' ')) AS tail FROM w",
)
def _(t):
    return t.documents.select("doc_id", F.md5(X.last_words("text", 12)).alias("tail"))


def _written(t):
    """Questions written by a model: JSON arrays of one to five entries, some broken."""
    n = (F.col("p_size") % 5 + 1).cast("int")
    one = lambda i: F.concat(
        F.lit('{"question": "q'), i.cast("string"), F.lit('", "choices": ["'), "p_name", F.lit('", "'), "p_type", F.lit('", "'), "p_brand",
        F.when(i % 2 == 0, '", "none of these"]').otherwise('", "other"]'), F.lit(', "answer": "'), "p_type", F.lit('"}'),
    )
    arr = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), one), ", ")
    return t.part.select(
        F.col("p_partkey").alias("image_id"),
        F.when(F.col("p_partkey") % 6 == 0, "sorry").otherwise(F.concat(F.lit("Sure: ["), arr, F.lit("] ok"))).alias("response"),
    )


@query(
    "vqa_12_parse_llm_questions",
    f"""WITH w0 AS (SELECT p_partkey AS image_id, unnest(range(0, least(3, p_size % 5 + 1))) AS question_id, p_name, p_type, p_brand FROM part WHERE p_partkey % 6 <> 0)
    SELECT image_id, question_id::INT AS question_id, 'q' || question_id AS question, p_type AS answer,
     CASE WHEN question_id % 2 = 0 THEN array_to_string({shuf('[p_name, p_type, p_brand]', 'llm', 'image_id', 'question_id')}, '|') || '|none of these'
       ELSE array_to_string({shuf("[p_name, p_type, p_brand, 'other']", 'llm', 'image_id', 'question_id')}, '|') END AS choices FROM w0""",
)
def _(t):
    q, _bad = Rp.parse_llm_questions(_written(t))
    return q.withColumn("choices", F.array_join("choices", "|"))


@query("res_01_pending", "SELECT event_id, event_type FROM events WHERE NOT (ts < '2024-01-10' AND event_id % 2 = 0)")
def _(t):
    done = t.events.filter("ts < '2024-01-10' AND event_id % 2 = 0").select("event_id")
    return Rp.pending(t.events.select("event_id", "event_type"), done, ["event_id"])


@query(
    "res_03_rejects",
    "SELECT event_id AS idx, CASE event_id % 5 WHEN 2 THEN 'note ] ' || props ELSE 'no brackets' END AS output, CASE event_id % 5 WHEN 2 THEN 'unmatched closing bracket' ELSE 'no block' END AS error, 'extraction' AS mode FROM events WHERE event_id % 5 IN (2, 4)",
)
def _(t):
    return Rp.rejects(_json_replies(t), "response", "extraction", "event_id")


# --- corpus ---------------------------------------------------------------------------


def captions(t):
    return t.documents.select(
        F.col("doc_id").alias("id"), F.concat("source", F.lit(".png")).alias("image"), F.concat(F.lit("Describe "), "lang").alias("input"), F.col("text").alias("output")
    )


def turns_of(t):
    """Conversations as records of turns; one without an image for every third id."""
    role = F.when(F.col("role") == "assistant", "gpt").otherwise("human")
    rows = F.sort_array(F.collect_list(F.struct("turn", role.alias("from"), F.col("text").alias("value"))))
    return t.conversations.groupBy("conv_id").agg(rows.alias("r")).select(
        F.col("conv_id").alias("id"),
        F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("c"), "conv_id", F.lit(".jpg"))).alias("image"),
        F.transform("r", lambda s: F.struct(s["from"].alias("from"), s["value"].alias("value"))).alias("conversations"),
    )


_TURNS = """WITH tn AS (SELECT conv_id AS id, turn, CASE WHEN role = 'assistant' THEN 'gpt' ELSE 'human' END AS fr, text AS v,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"""


def _flat_conv(df):
    c = F.col("conversations")
    return df.select("id", "image", F.md5(F.get(c, 0)["value"]).alias("human"), F.md5(F.get(c, 1)["value"]).alias("gpt"))


@query(
    "trn_01_to_conversation_numbered",
    "SELECT doc_id AS id, 'fig_' || lpad(doc_id::VARCHAR, 8, '0') || '.jpg' AS image, md5('<image>\nDescribe ' || lang) AS human, md5(text) AS gpt FROM documents",
)
def _(t):
    return _flat_conv(C.to_conversation(captions(t), "numbered"))


@query(
    "trn_01_to_conversation_pretrain",
    "SELECT 'easy_' || lpad(doc_id::VARCHAR, 8, '0') AS id, 'easy/easy_' || lpad(doc_id::VARCHAR, 8, '0') || '.jpg' AS image, md5('Describe ' || lang || '\n<image>') AS human, md5(text) AS gpt FROM documents",
)
def _(t):
    return _flat_conv(C.to_conversation(captions(t), "pretrain", "easy"))


@query(
    "trn_01_to_conversation_named",
    "SELECT doc_id AS id, source || '.png' AS image, md5('<image>\nDescribe ' || lang) AS human, md5(text) AS gpt FROM documents",
)
def _(t):
    return _flat_conv(C.to_conversation(captions(t), "named"))


@query(
    "trn_02_to_eval_rows",
    "SELECT doc_id AS question_id, 'Describe ' || lang AS text, 'fig_' || lpad(doc_id::VARCHAR, 8, '0') || '.jpg' AS image FROM documents",
)
def _(t):
    return C.to_eval_rows(captions(t))


def _questions(t):
    k = F.col("question_id") % 3
    q = F.when(k == 0, "Is there one?").otherwise("What is it's name?")
    ch = F.transform("choices", lambda c, i: F.when(i == 1, F.concat(F.lit("it's "), c)).otherwise(c))
    return frame(t, "replies").select("perspective", "image_id", "question_id", q.alias("question"), ch.alias("choices"), "answer")


_QSQL = ctes(
    "replies",
    q="SELECT *, CASE WHEN question_id % 3 = 0 THEN 'Is there one?' ELSE 'What is it''s name?' END AS question FROM replies",
    o="""SELECT *, CASE WHEN perspective = 'counting' THEN '[' || choices[1] || ', it''s ' || choices[2] || ', ' || choices[3] || ', ' || choices[4] || ']'
      ELSE '[''' || choices[1] || ''', "it''s ' || choices[2] || '", ''' || choices[3] || ''', ''' || choices[4] || ''']' END AS ol FROM q""",
)


@query(
    "trn_03_vqa_to_conv_easy",
    _QSQL + "SELECT 'easy_' || perspective || '_' || image_id || '_' || question_id AS id, 'easy/easy_' || lpad(image_id::VARCHAR, 8, '0') || '.jpg' AS image, md5('<image>\n' || question || ' Select one from the following options: ' || ol) AS human, md5(answer) AS gpt FROM o",
)
def _(t):
    return _flat_conv(C.vqa_to_conv_easy(_questions(t)))


@query(
    "trn_04_vqa_to_conv_hard",
    _QSQL
    + """SELECT 'hard_' || perspective || '_' || image_id || '_' || question_id AS id, 'hard/hard_' || lpad(image_id::VARCHAR, 8, '0') || '.jpg' AS image,
     md5('<image>\n' || question || CASE WHEN perspective IN ('counting', 'location') OR (perspective = 'existence' AND lower(question) LIKE 'is%') THEN '' ELSE ' Select one from the following options: ' || ol END) AS human, md5(answer) AS gpt FROM o""",
)
def _(t):
    return _flat_conv(C.vqa_to_conv_hard(_questions(t)))


_LK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "trn_05_sample_per_category",
    f"SELECT l_returnflag, count(*) AS n, sum(l_orderkey)::BIGINT AS s FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY {H('t5', *_LK)}, l_orderkey, l_linenumber, l_partkey, l_suppkey) <= 20000) GROUP BY 1",
)
def _(t):
    s = C.sample_per_category(t.lineitem.select("l_returnflag", *_LK), 20000, "t5", "l_returnflag", _LK)
    return s.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("s"))


@query(
    "trn_06_mix",
    """WITH a AS (SELECT 'd' || doc_id AS id, source FROM documents UNION ALL SELECT 'c' || conv_id || '_' || turn, NULL FROM conversations UNION ALL SELECT 'b' || item_id, NULL FROM benchmark)
    SELECT id, source, row_number() OVER (ORDER BY md5('t6:' || id), id) AS pos FROM a""",
)
def _(t):
    base = t.documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), "source")
    parts = [
        t.conversations.select(F.concat(F.lit("c"), F.concat_ws("_", "conv_id", "turn")).alias("id")),
        t.benchmark.select(F.concat(F.lit("b"), "item_id").alias("id")),
    ]
    return C.mix(base, parts, "t6", ["id"])


_LEN = _TURNS + r""", ln AS (SELECT id, sum(len([x for x in regexp_split_to_array(v, '\s+') if x <> '']))::INT AS w FROM tn GROUP BY 1),
 le AS (SELECT id, w + CASE WHEN id % 3 > 0 THEN 128 ELSE 0 END AS length, CASE WHEN id % 3 > 0 THEN w ELSE -w END AS modality_length FROM ln)"""


@query("trn_07_lengths", _LEN + "SELECT * FROM le")
def _(t):
    return C.lengths(turns_of(t)).select("id", "length", "modality_length")


_MEGA = _LEN + """, r AS (SELECT id, length, (row_number() OVER (ORDER BY md5('t8:' || id), id) - 1) // 32 AS mega FROM le)"""


@query(
    "trn_08_length_batches",
    _MEGA
    + """, k AS (SELECT *, (row_number() OVER (PARTITION BY mega ORDER BY length DESC, id) - 1)::INT AS rank FROM r)
    SELECT id, length, mega, rank, CASE WHEN (rank // 4) % 2 = 0 THEN rank % 4 ELSE 3 - rank % 4 END AS chunk, rank // 4 AS slot FROM k""",
)
def _(t):
    return C.length_batches(C.lengths(turns_of(t)), 8, 4, "t8")


@query(
    "trn_08_modality_batches",
    _LEN
    + """, r AS (SELECT id, modality_length > 0 AS mm, abs(modality_length) AS length, (row_number() OVER (PARTITION BY modality_length > 0 ORDER BY md5('t8m:' || id), id) - 1) // 32 AS mega FROM le),
    l AS (SELECT *, mega = max(mega) OVER (PARTITION BY mm) AND (SELECT count(DISTINCT mm) > 1 FROM r) AS tail FROM r),
    f AS (SELECT mm, mega, row_number() OVER (ORDER BY md5('t8m:order:' || mm::VARCHAR || ':' || mega)) AS position FROM (SELECT DISTINCT mm, mega FROM l WHERE NOT tail)),
    p AS (SELECT id, mm, length, mega, tail, coalesce(position, (SELECT count(*) FROM f) + 1) AS position FROM l LEFT JOIN f USING (mm, mega)),
    k AS (SELECT *, (CASE WHEN tail THEN row_number() OVER (PARTITION BY tail ORDER BY id) ELSE row_number() OVER (PARTITION BY tail, mm, mega ORDER BY length DESC, id) END - 1)::INT AS rank FROM p)
    SELECT *, CASE WHEN NOT tail THEN CASE WHEN (rank // 4) % 2 = 0 THEN rank % 4 ELSE 3 - rank % 4 END END AS chunk, CASE WHEN NOT tail THEN rank // 4 END AS slot FROM k""",
)
def _(t):
    return C.modality_batches(C.lengths(turns_of(t)), 8, 4, "t8m")


@query("trn_08_greedy_batches")
def _(t):
    return C.greedy_batches(C.lengths(turns_of(t)), 8, 4, "t8")


def _imaged(t):
    """Turns with the image token somewhere inside every second human turn."""
    return turns_of(t).withColumn(
        "conversations",
        F.transform(
            "conversations",
            lambda m, i: F.struct(
                m["from"].alias("from"),
                F.when((m["from"] == "human") & (i % 4 == 0), F.concat(F.lit(" look <image> "), m["value"])).otherwise(m["value"]).alias("value"),
            ),
        ),
    )


_IMG = _TURNS + ", im AS (SELECT *, CASE WHEN fr = 'human' AND i % 4 = 0 THEN ' look <image> ' || v ELSE v END AS w FROM tn)"


@query(
    "trn_09_normalise_image_token",
    _IMG + r""", z AS (SELECT *, CASE WHEN contains(w, '<image>') THEN '<Image><s><image><e></Image>' || chr(10) || regexp_replace(replace(w, '<image>', ''), '^\s+|\s+$', '', 'g') ELSE w END AS o FROM im)
    SELECT id, md5(string_agg(o, '|' ORDER BY i)) AS txt FROM z GROUP BY 1""",
)
def _(t):
    n = C.normalise_image_token("conversations", tag=True, start_end=("<s>", "<e>"))
    return _imaged(t).select("id", F.md5(F.array_join(F.transform(n, lambda m: m["value"]), "|")).alias("txt"))


TEMPLATES = {
    "single": dict(style="single", system="Sys.", roles=("Human", "Assistant"), sep="###"),
    "two": dict(style="two", system="Sys.", roles=("USER", "ASSISTANT"), sep=" ", sep2="</s>"),
    "mpt": dict(style="mpt", system="<|s|>Sys.", roles=("<|u|>", "<|a|>"), sep="<|e|>"),
    "plain": dict(style="plain", system="", sep="\n", sep2="\n\n"),
    "llama2": dict(style="llama2", system="Sys.", sep="<s>", sep2="</s>"),
    "signal": dict(style="signal", system="Sys.", roles=("Human", "Assistant")),
}
_R10 = {
    "single": ("'Sys.###'", "(CASE WHEN j % 2 = 0 THEN 'Human' ELSE 'Assistant' END) || ': ' || v || '###'", "''"),
    "two": ("'Sys. '", "(CASE WHEN j % 2 = 0 THEN 'USER' ELSE 'ASSISTANT' END) || ': ' || v || (CASE WHEN j % 2 = 0 THEN ' ' ELSE '</s>' END)", "''"),
    "mpt": ("'<|s|>Sys.<|e|>'", "(CASE WHEN j % 2 = 0 THEN '<|u|>' ELSE '<|a|>' END) || v || '<|e|>'", "''"),
    "plain": ("''", "v || (CASE WHEN j % 2 = 0 THEN chr(10) ELSE chr(10) || chr(10) END)", "''"),
    "llama2": ("''", "CASE WHEN v = '' THEN '' WHEN j % 2 = 0 THEN '<s>[INST] ' || (CASE WHEN j = 0 THEN '<<SYS>>' || chr(10) || 'Sys.' || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END) || v || ' [/INST]' ELSE ' ' || v || ' </s>' END", "''"),
    "signal": ("'Sys.'", "'### ' || (CASE WHEN fr = 'human' THEN 'Human' ELSE 'Assistant' END) || ': ' || v || chr(10)", "'### '"),
}


@query(
    "trn_10_render",
    _TURNS
    + ", h AS (SELECT *, CASE WHEN first_value(fr) OVER (PARTITION BY id ORDER BY i) = 'human' THEN i ELSE i - 1 END AS j FROM tn) "
    + " UNION ALL ".join(
        f"SELECT id, '{k}' AS style, md5({'ltrim' if k == 'llama2' else 'concat'}({a} || string_agg({b}, '' ORDER BY i) || {c}, '{'<s>' if k == 'llama2' else ''}')) AS txt FROM h {'WHERE j >= 0' if k != 'signal' else ''} GROUP BY 1" for k, (a, b, c) in _R10.items()
    ),
)
def _(t):
    df = turns_of(t)
    arr = F.array(*[F.struct(F.lit(k).alias("style"), F.md5(C.render("conversations", v)).alias("txt")) for k, v in TEMPLATES.items()])
    return df.select("id", F.explode(arr).alias("x")).select("id", "x.style", "x.txt")


@query(
    "trn_10_alternates",
    _TURNS
    + """, h AS (SELECT *, CASE WHEN first_value(fr) OVER (PARTITION BY id ORDER BY i) = 'human' THEN i ELSE i - 1 END AS j FROM tn)
    SELECT id, coalesce(bool_and(fr = CASE WHEN j % 2 = 0 THEN 'human' ELSE 'gpt' END) FILTER (j >= 0), true) AS ok FROM h GROUP BY 1""",
)
def _(t):
    return turns_of(t).select("id", C.alternates(C.human_first(F.col("conversations"))).alias("ok"))


@query(
    "trn_11_supervised_spans",
    _TURNS
    + """, s AS (SELECT *, sum(len(v)) OVER (PARTITION BY id ORDER BY i)::INT AS e FROM tn)
    SELECT id, i::INT AS i, e - len(v) AS start, e AS "end", fr AS role, fr = 'gpt' AS supervised FROM s""",
)
def _(t):
    return turns_of(t).select("id", F.posexplode(C.supervised_spans("conversations")).alias("i", "s")).select("id", "i", "s.*")
