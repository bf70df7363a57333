"""Golden values of answer parsing, text and class expressions."""

import math

import pytest
from pyspark.sql import functions as F

from scenemark.functions import answers as A
from scenemark.functions import classes as K
from scenemark.functions import json_blocks as J
from scenemark.functions import text as X
from scenemark.operators import scoring as S


def one(spark, col, **vals):
    df = spark.createDataFrame([tuple(vals.values())], list(vals)) if vals else spark.range(1)
    return df.select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("3.1-5.5 mm", [3.1, 5.5]),
        ("120 to 340 μm", [0.12, 0.34]),
        ("2.8-3.5, more frequently 3.0", [2.8, 3.5]),
        ("near 1.5 in the first volution, increasing to near 2.5 at maturity", [1.5, 2.5]),
        ("1:2.0, 1:2.5", [2.0, 2.5]),
        ("about 22 degrees", [22.0]),
        ("27, 27, and 31 degrees", [27.0, 27.0, 31.0]),
        ("moderately large but increases at a relatively slow rate", None),
    ],
)
def test_extract_range(spark, text, want):
    got = one(spark, A.extract_range("t"), t=text)
    assert got == want if want is None else got == pytest.approx(want)


@pytest.mark.parametrize(
    "reply, want",
    [
        ("The answer is B.", "B"),
        ("A cat, so C", "C"),
        ("I see the red one", "C"),
        ("red or blue", "-"),
        ("nothing", "-"),
        ("éA is not a word, D", "D"),
    ],
)
def test_find_choice(spark, reply, want):
    df = spark.createDataFrame([(reply, ["green", "blue", "red", "black"])], "r string, c array<string>")
    assert df.select(A.find_choice("r", "c")).first()[0] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("The answer is 42.", "42"),
        ("so \\boxed{\\frac{1}{2}}", "\\frac{1}{2}"),
        ("it must be 3/4", "itmustbe3/4"),
        ("x = 3/4", "\\frac{3}{4}"),
        ("I choose (b)", "ichooseb"),
        ("Answer: E", "e"),
        ("\\boxed{2} and \\boxed{\\sqrt3}", "\\sqrt{3}"),
    ],
)
def test_final_answer(spark, text, want):
    assert one(spark, A.final_answer("t"), t=text) == want


def test_range_score_edges(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    none = F.lit(None).cast("array<double>")
    assert one(spark, A.range_score(arr(1, 2), arr(1.5))) == 10
    assert one(spark, A.range_score(arr(10), arr(20))) == 0
    assert one(spark, A.range_score(none, arr(1))) is None
    assert one(spark, A.range_score(arr(1), none)) == 0
    assert one(spark, A.range_score(arr(0), arr(1))) is None


def test_soft_accuracy_matches_leave_one_out(spark):
    for m in range(11):
        gts = ["x"] * m + ["y"] * (10 - m)
        want = sum(min(1, sum(g == "x" for j, g in enumerate(gts) if j != i) / 3) for i in range(10)) / 10
        df = spark.createDataFrame([("x", gts)], "p string, g array<string>")
        assert df.select(A.soft_accuracy("p", "g")).first()[0] == pytest.approx(want)


@pytest.mark.parametrize(
    "text, want",
    [("Two Cats?", "2 cats"), ("the dog-house", "dog house"), ("dont", "don't"), ("1,000", "1000"), ("a.b", "ab"), ("3.5", "3.5")],
)
def test_vqa_normalise(spark, text, want):
    assert one(spark, A.vqa_normalise("t"), t=text) == want


def test_json_blocks():
    assert J.block_of('x {"a": [1]} y') == ('{"a": [1]}', " y", None)
    assert J.block_of("] x")[2] == "unmatched closing bracket"
    assert J.block_of("{ ]")[2] == "mismatched brackets"
    assert J.block_of("{ [")[2] == "unclosed brackets"
    assert J.block_of("none")[2] == "no block"
    assert J.array_of("[bad] then [1, [2]] end") == "[1, [2]]"
    assert J.array_of("nothing") is None


def test_reorder_tags(spark):
    text = "<width>w</width> <size> big,</size> <other>x</other> <width> more</width> <ratio></ratio>"
    assert one(spark, X.reorder_tags("t"), t=text) == "<size>big,</size> <width>wmore</width>"


def test_py_list(spark):
    df = spark.createDataFrame([(["a", "it's", 'q"'],)], "c array<string>")
    assert df.select(X.py_list("c", F.lit(False))).first()[0] == repr(["a", "it's", 'q"'])


def test_ordinals(spark):
    got = [one(spark, K.ordinal(F.lit(i))) for i in (0, 10, 19, 20, 89, 99)]
    assert got == ["first", "eleventh", "twentieth", "twenty-first", "ninetieth", "one hundredth"]
    assert one(spark, K.ordinal(F.lit(100))) is None


def test_prompt_question_layouts(spark):
    for p in (
        "OCR tokens: a. Question: What Is it? Short answer:",
        "Reference OCR token: a\nWhat Is it?\nAnswer.",
        "What Is it?\nReference OCR token: a\nAnswer.",
        "What Is it?\nAnswer.",
    ):
        assert one(spark, A.prompt_question("p"), p=p) == "what is it?"


def test_bleu_of_equal_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e", ["a b c d e"])], "id int, hypothesis string, references array<string>")
    assert S.bleu4(df).first()["bleu4"] == 1.0


def test_median_free_rounding(spark):
    from scenemark.functions.numeric import fixed, rnd

    assert one(spark, rnd(F.lit(2.675), 2)) == 2.68
    assert one(spark, fixed(F.lit(3.0625), 3)) == "3.062"
    assert not math.isnan(one(spark, rnd(F.lit(0.0), 2)))


def test_vqa_normalise_odd_texts(spark):
    """Texts without marks or odd white space take a shorter way to the same words."""
    texts = {
        "two cats": "2 cats", " The  two\tcats ": "2 cats", "dog house": "dog house", "a dog\x0bhere": "dog here", "one.two 3.5.": "onetwo 3.5", "dog-house": "dog house",
        "dog -house": "dog house", "dont, cant?": "don't can't", "\\n[x]": "n x", "": "", "the": "", "none": "0", "cat's": "cat 's",
    }
    rows = spark.createDataFrame([*enumerate(texts), (99, None)], "id int, t string").select("t", A.vqa_normalise("t").alias("n")).collect()
    assert {r.t: r.n for r in rows} == {**texts, None: None}
