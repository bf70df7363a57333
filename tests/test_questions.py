"""Invariants of generated questions, on every row, and independence of partitioning."""

import pytest
from pyspark.sql import functions as F

from scenemark import dims
from scenemark.operators import questions as Q
from scenemark.plans import vqa as V
from scenemark.plans.fixtures import frame
from scenemark.plans.registry import Tables


@pytest.fixture(scope="module")
def tables(spark, small):
    return Tables(spark, small)


@pytest.fixture(scope="module")
def questions(tables):
    return Q.gen_questions(V.shapes(tables), frame(tables, "relations")).cache()


def test_answer_is_among_distinct_choices(questions):
    bad = questions.filter(
        ~F.array_contains("choices", F.col("answer")) | (F.size(F.array_distinct("choices")) < F.size("choices"))
    )
    # size choices repeat only if two of them round to the same text
    assert bad.filter("perspective <> 'size'").count() == 0
    assert bad.filter(~F.array_contains("choices", F.col("answer"))).count() == 0


def test_four_choices(questions):
    assert questions.filter(F.size("choices") != 4).filter("perspective not in ('reference')").count() == 0
    assert questions.filter(F.size("choices") > 4).count() == 0


def test_question_ids_are_dense_and_few(questions):
    g = questions.groupBy("perspective", "image_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("question_id").alias("lo"), F.max("question_id").alias("hi")
    )
    assert g.filter("lo <> 0 or hi <> n - 1 or n > 3").count() == 0


def test_all_perspectives_occur(questions):
    got = {r[0] for r in questions.select("perspective").distinct().collect()}
    assert got == set(dims.PERSPECTIVES)


def test_larger_area_answers_hold(tables, questions):
    area = V.shapes(tables).groupBy("image_id", "type").agg(F.min("area").alias("lo"), F.max("area").alias("hi"))
    q = questions.filter(F.col("question").contains("has a larger area than")).select(
        "image_id", F.regexp_replace("answer", r" \(.*", "").alias("type")
    )
    j = q.join(area, ["image_id", "type"])
    low = area.groupBy("image_id").agg(F.min("hi").alias("smallest"))
    assert j.join(low, "image_id").filter(F.col("lo") - F.col("smallest") < 0.02 - 1e-9).count() == 0


def test_counting_answers_are_counts(tables, questions):
    n = V.shapes(tables).groupBy("image_id", "type").count()
    q = questions.filter("perspective = 'counting'").select(
        "image_id", "answer", F.regexp_extract("question", r"How many (.*?)s(?: \(| are)", 1).alias("type")
    )
    j = q.join(n, ["image_id", "type"], "left").fillna(0, ["count"])
    assert j.filter(F.col("answer").cast("bigint") != F.col("count")).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_same_questions_for_any_partitioning(spark, tables, questions, parts):
    def digest(df):
        row = F.xxhash64("perspective", "image_id", "question_id", "question", F.concat_ws("|", "choices"), "answer")
        return df.agg(F.sum((row % 1000003).cast("decimal(38,0)")), F.count(F.lit(1))).first()

    shuffled = V.shapes(tables).orderBy(F.rand(parts)).repartition(parts)
    again = Q.gen_questions(shuffled, frame(tables, "relations").repartition(parts))
    assert digest(again) == digest(questions)


def test_rejected_relations_are_counted(tables):
    rej = {r["relation"] for r in Q.rejected_relations(frame(tables, "relations")).collect()}
    assert rej == {"concentric", "similar", "symmetric"}
