"""One query per training-data operator, over whole tables, and the SQL they are checked against.

Where SQL cannot express an operator the tests compare it with a brute-force version."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from scenemark.llm import exact, language, lines, lm, mix_query, mixing, phrases, pieces, resample, secrets, simhash, tokens, vectors
from scenemark.llm.rollup import Rollup, inserts, revisions
from scenemark.session import scratch, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Token totals by source, language and tokenizer version after two batches, each sent
    twice: every document is inserted with its byte-level count, then the documents of every
    language but English, unknown ones included, are recounted with the piece tokenizer."""
    docs = table(spark, folder, "documents")
    byte, piece = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    named = lambda counts, version: stored(counts.withColumn("version", F.lit(version)), "counts")
    first = named(tokens.count(docs, byte, ["source", "lang"]), "byte_bpe_50k")
    moved = "NOT lang <=> 'en'"
    again = named(tokens.count(docs.filter(moved), piece, ["source", "lang"], pieces.counts), "piece_bpe_32k")
    store = Rollup(spark, scratch(spark, "rollup"))
    for _ in range(2):
        store.commit(1, inserts(first))
        store.commit(2, revisions(first.filter(moved), again))
    return store.totals()


@query("op2_token_files")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Start, count and checksum of every document's ids, read back from the files."""
    path = scratch(spark, "token-files")
    tokens.write(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.checksums(spark, path)


@query("op3_embedding_near_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector."""
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


@query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify(table(spark, folder, "documents"))


@query("op5_source_mix", mix_query.SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Every use of a document in the mix."""
    m = mix_query
    return mixing.mix(table(spark, folder, "documents"), m.levels(), m.WEIGHTS, m.SHARE, m.EPOCHS, m.SEED)


@query(
    "op6_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
    WINDOW w AS (PARTITION BY t)""",
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Group, kept row and digest of every document."""
    return exact.duplicates(table(spark, folder, "documents"))


@query("op7_secret_scan")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan(table(spark, folder, "documents"))


@query("op8_simhash_near_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op9_sentencepiece")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Ids, decoded text and projected byte spans of every document, as digests."""
    return pieces.digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_lm_scores")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Base and model score of every document."""
    return lm.score(table(spark, folder, "documents"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_phrases",
    rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
    s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
    g1 AS (SELECT lang, w[i] AS x, count(*)::HUGEINT AS f FROM s GROUP BY ALL),
    g2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*)::HUGEINT AS f FROM s WHERE i < len(w) GROUP BY ALL HAVING count(*) >= 10),
    g3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*)::HUGEINT AS f FROM s WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10),
    c2 AS (SELECT g2.lang, g2.x || ' ' || g2.y AS phrase, g2.f AS a, a.f AS l, b.f AS r, 1 AS k FROM g2 JOIN g1 a ON g2.lang = a.lang AND g2.x = a.x JOIN g1 b ON g2.lang = b.lang AND g2.y = b.x
        WHERE NOT EXISTS (SELECT 1 FROM g3 WHERE g3.lang = g2.lang AND (g3.x = g2.x AND g3.y = g2.y OR g3.y = g2.x AND g3.z = g2.y) AND 100 * g3.f >= 50 * g2.f)),
    c3 AS (SELECT g3.lang, g3.x || ' ' || g3.y || ' ' || g3.z AS phrase, g3.f AS a, g1.f AS l, g2.f AS r, 1 AS k FROM g3 JOIN g1 ON g3.lang = g1.lang AND g3.x = g1.x JOIN g2 ON g3.lang = g2.lang AND g3.y = g2.x AND g3.z = g2.y
        UNION ALL SELECT g3.lang, g3.x || ' ' || g3.y || ' ' || g3.z, g3.f, g2.f, g1.f, 2 FROM g3 JOIN g2 ON g3.lang = g2.lang AND g3.x = g2.x AND g3.y = g2.y JOIN g1 ON g3.lang = g1.lang AND g3.z = g1.x),
    c AS (SELECT *, 1000000 * a * a // (l * r) AS score FROM (FROM c2 UNION ALL FROM c3) QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c QUALIFY rank <= 2000)
    SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM r JOIN (SELECT lang, sum(f)::BIGINT AS n FROM g1 GROUP BY 1) USING (lang)""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Best collocations of every language."""
    return phrases.collocations(table(spark, folder, "documents")).drop("before", "after")


_CRC = "list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b))"
_BYTES = "list_transform(range(0, len(hex(w)) // 2), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT)"


@query(
    "op12_resample",
    rf"""WITH t AS (SELECT {_CRC} AS crc),
    f AS (SELECT true AS raw, doc_id AS id, unnest(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
        UNION ALL SELECT false, item_id, unnest(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
    v AS (SELECT w, xor(list_reduce({_BYTES}, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT w FROM f), t),
    u AS (SELECT raw, id, bucket, count(*) AS k FROM f JOIN v USING (w) GROUP BY ALL),
    b AS (SELECT bucket, coalesce(sum(k) FILTER (raw), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (NOT raw), 0)::DOUBLE AS t FROM u GROUP BY 1),
    a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM b),
    g AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM b, a),
    d AS (SELECT id AS doc_id, sum(k)::BIGINT AS n_features, sum(k * gain)::BIGINT AS total FROM u JOIN g USING (bucket) WHERE raw GROUP BY 1),
    w AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
        ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN d USING (doc_id)),
    c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM c WHERE n_features >= 20)
    SELECT c.*, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM c LEFT JOIN r USING (doc_id)""",
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Weight, score and rank of every document towards the benchmark."""
    return resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(
    "op13_line_dedup",
    f"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM s)),
    k AS (SELECT *, {_LOW.replace("coalesce(text, '')", "trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
    g AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT k.*, coalesce(k.doc_id <> g.last, false) AS gone FROM k LEFT JOIN g USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Lines before and dropped, and the digest of what stays, of every document."""
    return lines.digests(table(spark, folder, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
