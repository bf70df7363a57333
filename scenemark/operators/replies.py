"""Tables of model replies: parsed questions, joined results, judge scores, rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenemark import dims
from scenemark.functions.json_blocks import first_json_array, first_json_block, parse_score
from scenemark.functions.rnd import shuffle_keep_none_last


def parse_llm_questions(
    responses: DataFrame, max_q: int = dims.MAX_QUESTIONS, seed: str = "llm"
) -> tuple[DataFrame, DataFrame]:
    """VQA-12: (questions, rejects) from written replies (image_id, response).

    The first JSON array of a reply, at most ``max_q`` entries, choices shuffled with a
    "none" choice kept last; replies without a usable array go to the rejects."""
    schema = "array<struct<question:string,choices:array<string>,answer:string>>"
    parsed = responses.withColumn("qs", F.from_json(first_json_array("response"), schema))
    ok = parsed.filter(F.col("qs").isNotNull()).select(
        "image_id", F.posexplode(F.slice("qs", 1, max_q)).alias("question_id", "q")
    )
    shuffled = shuffle_keep_none_last(F.col("q.choices"), seed, "image_id", "question_id")
    questions = ok.select("image_id", "question_id", "q.question", shuffled.alias("choices"), "q.answer")
    return questions, parsed.filter(F.col("qs").isNull()).drop("qs")


def replace_output(df: DataFrame, results: DataFrame, key: str, field: str) -> DataFrame:
    """TXT-6: one field replaced by the result of the same key; rows without one keep theirs."""
    new = results.select(key, F.col("result").alias("_new"))
    return df.join(new, key, "left").withColumn(field, F.coalesce("_new", field)).drop("_new")


def score_table(replies: DataFrame) -> DataFrame:
    """TXT-7: number of replies per judged score."""
    return replies.groupBy(parse_score(F.col("reply"))["score"].alias("score")).agg(F.count(F.lit(1)).alias("n"))


def rejects(df: DataFrame, text: str, mode: str, key: str) -> DataFrame:
    """RES-3: rows whose text holds no complete JSON block, with the reason."""
    found = first_json_block(text)
    bad = df.withColumn("_j", found).filter(F.col("_j.error").isNotNull())
    return bad.select(F.col(key).alias("idx"), F.col(text).alias("output"), F.col("_j.error").alias("error"), F.lit(mode).alias("mode"))


def pending(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """RES-1: rows not processed yet, by key rather than by count."""
    return todo.join(done.select(*key).distinct(), key, "left_anti")
