"""Scoring of model replies: joins with the truth and roll-ups."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenemark import dims
from scenemark.functions import answers as A
from scenemark.functions.ngrams import tokens
from scenemark.functions.numeric import rnd
from scenemark.functions.rnd import _c
from scenemark.operators.sampling import hash_rank
from scenemark.session import work_partitions

QKEY = ["perspective", "image_id", "question_id"]
DP = 4


def _rate(cond: Column, dp: int = DP) -> Column:
    return rnd(F.avg(cond.cast("double")), dp)


def _values(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- pairing -------------------------------------------------------------------------


def pair_outputs(outputs: DataFrame, refs: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """EVA-1: (pairs, unmatched outputs).  Of several references of an image the last wins."""
    last = refs.groupBy("image").agg(F.max_by("output", order).alias("reference"))
    joined = outputs.join(last, "image", "left")
    pairs = joined.filter(F.col("reference").isNotNull()).select(
        F.col("image").alias("img"), "question", F.col("response").alias("output"), "reference"
    )
    return pairs, joined.filter(F.col("reference").isNull()).drop("reference")


# --- benchmark accuracy --------------------------------------------------------------


def score_predictions(questions: DataFrame, preds: DataFrame) -> DataFrame:
    """Predictions with their truth letter: EVA-2 and EVA-3 over the question key."""
    truth = questions.select(*QKEY, "choices", A.letter_of(A.truth_index("choices", "answer")).alias("truth"))
    return (
        preds.join(truth, QKEY)
        .withColumn("pred", A.find_choice("response", "choices"))
        .withColumn("correct", F.coalesce(F.col("pred") == F.col("truth"), F.lit(False)))
    )


def accuracy_pivot(scored: DataFrame, perspectives: list[str] = dims.PERSPECTIVES) -> DataFrame:
    """EVA-4: accuracy % per model, one column per perspective."""
    return (
        scored.groupBy("model")
        .pivot("perspective", perspectives)
        .agg(rnd(F.avg(F.col("correct").cast("double")) * 100, 1))
    )


def answer_matrix(questions: DataFrame, preds: DataFrame, models: list[str]) -> DataFrame:
    """EVA-5: truth letter and one column per model, '-' where a model has no answer."""
    truth = questions.select(*QKEY, A.letter_of(A.truth_index("choices", "answer")).alias("std"))
    wide = preds.groupBy(*QKEY).pivot("model", models).agg(F.max("pred"))
    return truth.join(wide, QKEY, "left").fillna("-", subset=models)


# --- description scoring --------------------------------------------------------------


def rule_rating(feature, out, ref) -> Column:
    """Rating of one rule-scored feature from its two texts."""
    numeric = A.range_score(A.extract_range(ref), A.extract_range(out))
    return (
        F.when(_c(feature).isin(*dims.NUMERIC_FEATURES), numeric)
        .when(_c(feature) == "chomata", A.chomata_rating(out, ref))
        .when(_c(feature) == "axis_shape", A.axis_rating(out, ref))
    )


def apply_rule_scores(ratings: DataFrame, out: DataFrame, ref: DataFrame) -> DataFrame:
    """EVA-11: rule ratings replace the judge's for the rule features; NULL (not
    applicable) ratings stay untouched.  ``out``/``ref`` are (image, feature, text)."""
    rules = F.col("feature").isin(*dims.RULE_FEATURES)

    def packed(texts, name):
        """One row per image with its rule texts, so a text moves without its key."""
        return texts.filter(rules & F.col("image").isNotNull()).groupBy("image").agg(F.collect_list(F.struct("feature", "text")).alias(name))

    texts = packed(out, "outs").join(packed(ref, "refs"), "image")
    of = lambda side: F.filter(side, lambda x: x["feature"] == F.col("feature"))
    joined = ratings.join(texts, "image", "left").withColumn("outs", of("outs")).withColumn("refs", of("refs"))
    # texts come once each, as a rule; if not, a rating has a row for each of their pairs
    both = F.transform("outs", lambda o: F.transform("refs", lambda r: F.struct(o["text"].alias("out_text"), r["text"].alias("ref_text"))))
    paired = joined.withColumn("pair", F.explode_outer(F.flatten(both)))
    ruled = F.col("rating").isNotNull() & F.col("pair.ref_text").isNotNull()
    rated = F.when(ruled, rule_rating("feature", F.col("pair.out_text"), F.col("pair.ref_text"))).otherwise(F.col("rating"))
    rest = [c for c in ratings.columns if c not in ("image", "feature")]
    return paired.select("image", "feature", *[rated.alias(c) if c == "rating" else c for c in rest])


def judge_prompt(out: DataFrame, ref: DataFrame) -> DataFrame:
    """EVA-12: prompt per image over the features a judge scores, missing texts empty."""
    judged = [f for f in dims.FEATURES if f not in dims.RULE_FEATURES]
    both = out.withColumn("side", F.lit("o")).unionByName(ref.withColumn("side", F.lit("r")))
    cells = [
        F.max(F.when((F.col("side") == s) & (F.col("feature") == f), F.col("text"))).alias(f"{s}_{f}")
        for f in judged
        for s in "or"
    ]
    wide = both.groupBy("image").agg(*cells)
    lines = [
        F.concat(
            F.lit(f"- {f}\nGenerated:"),
            F.coalesce(F.col(f"o_{f}"), F.lit("")),
            F.lit("\nReference:"),
            F.coalesce(F.col(f"r_{f}"), F.lit("")),
        )
        for f in judged
    ]
    return wide.select("image", F.concat_ws("\n", *lines).alias("prompt"))


def mask_empty(ratings: DataFrame, ref: DataFrame) -> DataFrame:
    """EVA-13: NULL where the reference text is empty, 0 where the judge gave no rating."""
    joined = ratings.join(ref.withColumnRenamed("text", "ref_text"), ["image", "feature"], "left")
    empty = F.length(F.coalesce("ref_text", F.lit(""))) == 0
    return joined.withColumn("rating", F.when(~empty, F.coalesce("rating", F.lit(0.0)))).drop("ref_text")


def feature_stats(ratings: DataFrame, features: list[str]) -> DataFrame:
    """EVA-14: mean (2 dp) and valid count per feature plus an Average row, which divides
    by all features."""
    dim = _values(ratings.sparkSession, [(f, i) for i, f in enumerate(features)], "feature string, ord int")
    per = ratings.groupBy("feature").agg(
        rnd(F.avg("rating"), 2).alias("rating"), F.count("rating").alias("valid_count")
    )
    rows = (
        F.broadcast(dim)
        .join(per, "feature", "left")
        .select(
            "feature",
            F.coalesce("rating", F.lit(0.0)).alias("rating"),
            F.coalesce("valid_count", F.lit(0)).cast("bigint").alias("valid_count"),
            "ord",
        )
    )
    total = rows.agg(
        F.lit("Average").alias("feature"),
        rnd(F.sum("rating") / len(features), 2).alias("rating"),
        F.lit(-1).cast("bigint").alias("valid_count"),
        F.lit(-1).alias("ord"),
    )
    return total.unionByName(rows)


def species_stats(ratings: DataFrame, features: list[str], tokens: int = 2) -> DataFrame:
    """EVA-15: mean per (species, feature), then over species.  The Average row divides by
    the features that have data and counts all species."""
    sp = ratings.withColumn("species", F.substring_index("image", "_", tokens))
    per = (
        sp.groupBy("species", "feature")
        .agg(rnd(F.avg("rating"), 2).alias("r"))
        .groupBy("feature")
        .agg(rnd(F.avg("r"), 2).alias("r"), F.count("r").alias("n"))
    )
    dim = _values(ratings.sparkSession, [(f, i) for i, f in enumerate(features)], "feature string, ord int")
    rows = (
        F.broadcast(dim)
        .join(per, "feature", "left")
        .select(
            "feature",
            F.coalesce("r", F.lit(0.0)).alias("rating"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("species_count"),
            "ord",
        )
    )
    n_species = sp.agg(F.countDistinct("species").alias("n"))
    total = (
        rows.filter("species_count > 0")
        .agg(rnd(F.avg("rating"), 2).alias("rating"))
        .crossJoin(n_species)
        .select(
            F.lit("Average").alias("feature"),
            F.coalesce("rating", F.lit(0.0)).alias("rating"),
            F.col("n").cast("bigint").alias("species_count"),
            F.lit(-1).alias("ord"),
        )
    )
    return total.unionByName(rows)


# --- per-benchmark accuracies ----------------------------------------------------------


def relaxed_accuracy(df: DataFrame, tol: float = 0.05) -> DataFrame:
    """EVA-16 over the rows present."""
    return df.agg(_rate(F.coalesce(A.relaxed_match("answer", "extraction", tol), F.lit(False))).alias("acc"))


def yesno_and_recall(df: DataFrame, key: str = "id") -> DataFrame:
    """EVA-19: (id, closed, score): first-word match for yes/no labels, else multiset token
    recall.  Words are exploded once with their side and counted per (row, word), so the
    work is linear in the text and combined map-side."""
    label = F.trim(F.col("label"))
    base = df.select(
        key,
        label.alias("_label"),
        F.lower(label).isin("yes", "no").alias("closed"),
        A.words_of(A.plain_text(label)).alias("_lw"),
        A.words_of(A.plain_text(F.trim("response"))).alias("_rw"),
    )
    first = F.coalesce(F.get("_rw", F.lit(0)), F.lit(""))
    shut = base.filter("closed").select(
        key, "closed", (first == F.lower("_label")).cast("double").alias("score")
    )
    side = lambda c, s: F.transform(c, lambda w: F.struct(w.alias("w"), F.lit(s).alias("s")))
    counted = (
        base.filter(~F.col("closed"))
        .select(key, F.explode_outer(F.concat(side(F.col("_lw"), "l"), side(F.col("_rw"), "r"))).alias("t"))
        .groupBy(key, F.col("t.w").alias("w"))
        .agg(F.count_if(F.col("t.s") == "l").alias("l"), F.count_if(F.col("t.s") == "r").alias("r"))
        .groupBy(key)
        .agg(F.sum("l").alias("l"), F.sum(F.least("l", "r")).alias("hit"))
    )
    open_ = counted.select(
        key, F.lit(False).alias("closed"), F.when(F.col("l") > 0, F.col("hit") / F.col("l")).otherwise(0.0).alias("score")
    )
    return shut.unionByName(open_)


def yesno_and_recall_summary(scored: DataFrame) -> DataFrame:
    """Closed accuracy and open recall."""
    return scored.agg(
        rnd(F.coalesce(F.avg(F.when(F.col("closed"), F.col("score"))), F.lit(0.0)), DP).alias("closed_acc"),
        rnd(F.coalesce(F.avg(F.when(~F.col("closed"), F.col("score"))), F.lit(0.0)), DP).alias("open_recall"),
        F.count_if(F.col("closed")).alias("n_closed"),
        F.count_if(~F.col("closed")).alias("n_open"),
    )


def exact_accuracy(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """EVA-20."""
    same = F.lower(F.trim(F.col(pred))) == F.lower(F.trim(F.col(label)))
    return df.agg(_rate(F.coalesce(same, F.lit(False))).alias("acc"), F.count(F.lit(1)).alias("n"))


def _keyed(name: str) -> Column:
    """Distinct elements of a list column as (key, value) pairs."""
    return F.transform(
        F.array_distinct(F.col(name)), lambda v: F.struct(F.lit(name).alias("key"), v.cast("string").alias("value"))
    )


def accuracy_by(df: DataFrame, keys: list[str], list_keys: list[str] = (), correct: str = "correct") -> DataFrame:
    """EVA-22: accuracy overall and per value of every key; list-valued keys are exploded.

    One pass: each row is expanded to its (key, value) pairs and pre-aggregated map-side."""
    pairs = [F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]
    pairs.append(F.struct(F.lit("average").alias("key"), F.lit("all").alias("value")))
    arr = F.array(*pairs)
    for k in list_keys:
        arr = F.concat(arr, _keyed(k))
    return (
        df.select(F.col(correct).cast("int").alias("_c"), F.explode(arr).alias("p"))
        .groupBy("p.key", "p.value")
        .agg(
            rnd(F.avg("_c"), DP).alias("accuracy"),
            F.sum("_c").cast("bigint").alias("correct"),
            F.count(F.lit(1)).alias("total"),
        )
    )


def split_for_judge(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EVA-23: (rows whose reply is usable as it is, judge queue)."""
    r = F.col("response")
    usable = (
        (r == "")
        | (F.col("question_type") == "multi_choice")
        | ((F.col("answer_type") == "integer") & F.trim(r).rlike(r"^[+-]?\d+$"))
        | ((F.col("answer_type") == "float") & F.trim(r).try_cast("double").isNotNull())
    )
    usable = F.coalesce(usable, F.lit(False))
    return df.filter(usable).withColumn("extraction", r), df.filter(~usable)


def merge_judged(ready: DataFrame, queue: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Ready rows plus queued rows with the judge's extraction."""
    return ready.unionByName(queue.join(judged.select(key, "extraction"), key, "left"))


def accuracy_cube(df: DataFrame, level: str = "level", subject: str = "subject") -> DataFrame:
    """EVA-25: all / level / subject / subject and level."""
    return df.cube(level, subject).agg(
        F.sum(F.col("correct").cast("int")).cast("bigint").alias("correct"),
        F.count(F.lit(1)).alias("total"),
        rnd(F.avg(F.col("correct").cast("double")) * 100, 2).alias("pct"),
    )


def judgement_of(text) -> Column:
    """'0'/'1' replies as numbers, −1 otherwise."""
    t = F.trim(_c(text))
    return F.when(t.isin("0", "1"), t.cast("int")).otherwise(-1)


def judgement_rollup(df: DataFrame) -> DataFrame:
    """EVA-26: accuracy per subfield, subject, total and problem version; −1 counts as wrong."""
    right = (F.col("judgement") == 1).cast("double")
    aggs = [rnd(F.avg(right), 3).alias("acc"), F.count(F.lit(1)).alias("n")]
    tree = (
        df.rollup("subject", "subfield")
        .agg(*aggs, F.grouping_id().alias("g"))
        .select(
            F.element_at(F.array(F.lit("subfield"), F.lit("subject"), F.lit("version"), F.lit("total")), (F.col("g") + 1).cast("int")).alias("scope"),
            F.coalesce("subject", F.lit("")).alias("subject"),
            F.coalesce("subfield", F.lit("")).alias("part"),
            "acc",
            "n",
        )
    )
    version = df.groupBy("version").agg(*aggs).select(
        F.lit("version").alias("scope"), F.lit("").alias("subject"), F.col("version").alias("part"), "acc", "n"
    )
    return tree.unionByName(version)


def binary_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """EVA-27: confusion counts and rates of yes/no predictions (columns pred, label)."""
    p, t = F.col("pred") == "yes", F.col("label") != "no"
    c = df.groupBy(*by).agg(
        F.count_if(p & t).alias("tp"),
        F.count_if(p & ~t).alias("fp"),
        F.count_if(~p & ~t).alias("tn"),
        F.count_if(~p & t).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    return c.select(
        *by,
        "tp",
        "fp",
        "tn",
        "fn",
        rnd(F.try_divide(tp + tn, n), DP).alias("accuracy"),
        rnd(F.try_divide(tp, tp + fp), DP).alias("precision"),
        rnd(F.try_divide(tp, tp + fn), DP).alias("recall"),
        rnd(F.try_divide(2 * tp, 2 * tp + fp + fn), DP).alias("f1"),
        rnd(F.try_divide(tp + fp, n), DP).alias("yes_ratio"),
    )


def science_accuracy(problems: DataFrame, preds: DataFrame, options: str = "ABCDE") -> DataFrame:
    """EVA-28: accuracy over all problems (a missing prediction is FAILED) and over those
    whose prompt has an image."""
    j = problems.join(preds, "id", "left")
    parsed = A.science_letter(F.coalesce("text", F.lit("FAILED")), options)
    ok = A.option_index(parsed, F.size("choices"), options) == F.col("answer")
    img = F.coalesce(F.col("prompt").contains("<image>"), F.lit(False))
    return j.agg(
        F.count_if(ok).alias("correct"),
        F.count(F.lit(1)).alias("total"),
        rnd(F.avg(ok.cast("double")) * 100, 2).alias("acc"),
        rnd(F.avg(F.when(img, ok.cast("double"))) * 100, 2).alias("img_acc"),
    )


def _indexed(j: DataFrame, names: list[str], options: str) -> DataFrame:
    for n in names:
        j = j.withColumn(f"{n}_l", A.answer_is_letter(F.coalesce(F.col(n), F.lit("MISSING")))).withColumn(
            f"{n}_i", A.option_index(F.col(f"{n}_l"), F.size("choices"), options)
        )
    return j


def ensemble(problems: DataFrame, ours: DataFrame, other: DataFrame, options: str = "ABCDE") -> DataFrame:
    """EVA-29: the other model with ours as fallback, and the upper bound of both."""
    j = problems.join(ours.withColumnRenamed("text", "a"), "id").join(other.withColumnRenamed("text", "b"), "id")
    j = _indexed(j, ["a", "b"], options)
    used = F.when(F.col("b_l") == "FAILED", F.col("a_i")).otherwise(F.col("b_i"))
    y = F.col("answer")
    return j.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(used == y).alias("correct"),
        F.count_if((used == y) | (F.col("a_i") == y)).alias("upper"),
        F.count_if(F.col("b_l") == "FAILED").alias("failed"),
    )


def ensemble_requery(
    problems: DataFrame, ours: DataFrame, other: DataFrame, again: DataFrame, options: str = "ABCDE"
) -> DataFrame:
    """EVA-29, three-model variant: re-query answers with ours as fallback."""
    j = (
        problems.join(ours.withColumnRenamed("text", "a"), "id")
        .join(other.withColumnRenamed("text", "b"), "id")
        .join(again.withColumnRenamed("text", "c"), "id", "left")
    )
    j = _indexed(j, ["a", "b", "c"], options)
    y, a, b, c = F.col("answer"), F.col("a_i"), F.col("b_i"), F.col("c_i")
    b_failed, c_failed = F.col("b_l") == "FAILED", F.col("c_l") == "FAILED"
    return j.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("c").isNull()).alias("missing_requery"),
        F.count_if(a == y).alias("ours"),
        F.count_if(b == y).alias("other"),
        F.count_if(b_failed).alias("other_failed"),
        F.count_if((b_failed & (a == y)) | (~b_failed & (b == y))).alias("other_or_ours"),
        F.count_if((c_failed & (a == y)) | (~c_failed & (c == y))).alias("requery"),
        F.count_if((a == y) | (b == y)).alias("upper"),
    )


def _shared_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch of (own text, its references, lengths) the sums that BLEU-4 takes: shared
    and own n-grams of one to four tokens, and lengths.  One row's n-grams are held at a time."""

    def grams(words: list[str], n: int) -> Counter:
        return Counter(zip(*[words[k:] for k in range(n)]))

    for batch in batches:
        met, total = [0] * 4, [0] * 4
        for texts in batch.column("texts").to_pylist():
            own, *others = [t.split(" ") if t else [] for t in texts or [None]]
            for n in range(1, 5):
                have = grams(own, n)
                if not have:
                    break
                total[n - 1] += len(own) - n + 1
                most: dict = {}
                for other in others:
                    for g, c in grams(other, n).items():
                        if g in have and c > most.get(g, 0):
                            most[g] = c
                met[n - 1] += sum(min(c, have[g]) for g, c in most.items())
        sizes = [sum(x or 0 for x in batch.column(c).to_pylist()) for c in ("hl", "rl")]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in [*met, *total, *sizes]], names=_BLEU_SUMS)


_BLEU_SUMS = [*[f"m{n}" for n in range(1, 5)], *[f"t{n}" for n in range(1, 5)], "hl", "rl"]


def bleu4(df: DataFrame) -> DataFrame:
    """EVA-34: corpus BLEU-4 with brevity penalty; references is an array of texts.

    Texts move once, by row number; the n-grams of a row are then counted where they are, and
    only sums leave the tasks."""
    moved = df.select(F.monotonically_increasing_id().alias("_row"), "hypothesis", "references").repartition(work_partitions(df), "_row")
    rows = moved.select(F.concat(F.array(tokens(F.col("hypothesis"))), F.transform("references", tokens)).alias("_t"))
    sizes = F.transform("_t", lambda t: F.size(t))
    own = F.get(sizes, 0)
    near = F.array_min(F.transform(F.slice(sizes, F.lit(2), F.size(sizes)), lambda k: F.struct(F.abs(k - own).alias("gap"), k.alias("size"))))
    # no token holds a blank
    texts = rows.select(F.transform("_t", lambda t: F.array_join(t, " ")).alias("texts"), own.alias("hl"), near["size"].alias("rl"))
    parts = texts.mapInArrow(_shared_grams, ", ".join(f"{c} long" for c in _BLEU_SUMS))
    sums = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _BLEU_SUMS])
    logs = reduce(lambda a, b: a + b, [F.log(F.try_divide(F.col(f"m{k}"), F.col(f"t{k}"))) for k in range(1, 5)])
    dead = reduce(lambda a, b: a | b, [F.col(f"m{k}") == 0 for k in range(1, 5)])
    bp = F.when(F.col("hl") < F.col("rl"), F.exp(1 - F.try_divide(F.col("rl"), F.col("hl")))).otherwise(1.0)
    return sums.withColumn("bleu4", rnd(F.when(dead, 0.0).otherwise(bp * F.exp(logs / 4)), DP))


def join_annotations(results: DataFrame, annotations: DataFrame) -> DataFrame:
    """EVA-35: replies with the annotation of the same image and question."""
    r = results.withColumn("_q", A.prompt_question("prompt"))
    a = annotations.withColumn("_q", F.lower("question")).drop("question")
    return r.join(a, (r["question_id"] == a["image_id"]) & (r["_q"] == a["_q"])).drop("_q", "image_id")


def pairwise_summary(reviews: DataFrame, ignore: list[int] = ()) -> DataFrame:
    """EVA-37: mean pair and ratio % per category and 'all'; unparsed pairs are counted apart."""
    kept = reviews.filter(~F.col("question_id").isin(*ignore)) if ignore else reviews
    ok = (F.col("s1") >= 0) & (F.col("s2") >= 0)
    return (
        kept.rollup("category")
        .agg(
            rnd(F.avg(F.when(ok, F.col("s1"))), 3).alias("mean1"),
            rnd(F.avg(F.when(ok, F.col("s2"))), 3).alias("mean2"),
            F.count_if(~ok).alias("unparsed"),
        )
        .select(
            F.coalesce("category", F.lit("all")).alias("category"),
            "mean1",
            "mean2",
            rnd(F.try_divide(F.col("mean2"), F.col("mean1")) * 100, 1).alias("ratio"),
            "unparsed",
        )
    )


def missing_parts(questions: DataFrame, parts: dict[str, tuple[DataFrame, str]], key: str = "question_id") -> DataFrame:
    """RES-3 beside the joins of review tables: (``key``, missing) of every question that lacks
    some part; ``parts`` names each part's table and the column it is joined on."""
    marked = questions
    for i, (table, on) in enumerate(parts.values()):
        marked = marked.join(table.select(on).distinct().withColumn(f"_has{i}", F.lit(True)), on, "left")
    lacks = F.array_compact(F.array(*[F.when(F.col(f"_has{i}").isNull(), name) for i, name in enumerate(parts)]))
    return marked.select(key, F.array_join(lacks, ", ").alias("missing")).filter("missing <> ''")


def pairwise_rejects(questions: DataFrame, context: DataFrame, ans1: DataFrame, ans2: DataFrame, rules: DataFrame) -> DataFrame:
    """Questions that pairwise_prompt leaves out, with the reason."""
    answers = {"answer 1": (ans1, "question_id"), "answer 2": (ans2, "question_id")}
    return missing_parts(questions, {"context": (context, "image"), **answers, "rule": (rules, "category")})


def review_rejects(questions: DataFrame, ans1: DataFrame, ans2: DataFrame, reviews: DataFrame) -> DataFrame:
    """Questions that review_page leaves out, with the reason."""
    return missing_parts(questions, {n: (t, "question_id") for n, t in (("answer 1", ans1), ("answer 2", ans2), ("review", reviews))})


def pairwise_prompt(
    questions: DataFrame, context: DataFrame, ans1: DataFrame, ans2: DataFrame, rules: DataFrame, boxes: bool = False
) -> DataFrame:
    """EVA-38: judge prompt of every question that has all parts (see pairwise_rejects).  With ``boxes`` the context carries a ``boxes`` text."""
    q = (
        questions.join(context, "image")
        .join(ans1.select("question_id", F.col("text").alias("a1")), "question_id")
        .join(ans2.select("question_id", F.col("text").alias("a2")), "question_id")
        .join(rules, "category")
    )
    ctx = F.concat_ws("\n\n", "caption", "boxes") if boxes else F.col("caption")
    return q.select(
        "question_id",
        "category",
        F.concat(
            F.lit("[Context]\n"), ctx, F.lit("\n\n[Question]\n"), "text", F.lit("\n\n["), "role", F.lit(" 1]\n"), "a1",
            F.lit("\n\n[End of "), "role", F.lit(" 1]\n\n["), "role", F.lit(" 2]\n"), "a2", F.lit("\n\n[End of "), "role",
            F.lit(" 2]\n\n[System]\n"), "prompt", F.lit("\n\n"),
        ).alias("content"),
    )


def review_page(questions: DataFrame, ans1: DataFrame, ans2: DataFrame, reviews: DataFrame) -> DataFrame:
    """EVA-39: one row per question with answers and the review without its score line, in the
    order of the question ids; questions without a part are in review_rejects."""
    text = F.trim(F.col("content"))
    body = F.regexp_replace(text, r"^\d+[, ]+\d+[^\n]*(\n|$)", "")
    body = F.regexp_replace(body, r"(Assistant [12])", "**$1**")
    return (
        questions.join(ans1.select("question_id", F.col("text").alias("answer1")), "question_id")
        .join(ans2.select("question_id", F.col("text").alias("answer2")), "question_id")
        .join(reviews.select("question_id", "content", "s1", "s2"), "question_id")
        .select(
            F.col("question_id").alias("id"), "category", F.col("text").alias("question"),
            "answer1", "answer2", body.alias("evaluation"), "s1", "s2",
        )
        .orderBy("id")
    )


# --- fixed values: grading rubric class of each template id ---
RUBRIC_OF = {
    "title": [1],
    "ocr": [2, 3, 4, 5, 6, 7],
    "quant": [8, 9, 10, 12, 14, 15, 17, 19],
    "bool": [11],
    "enum": [13],
    "trend": [16],
    "layout": [18],
}


def rubric(qid) -> Column:
    out = None
    for name, ids in RUBRIC_OF.items():
        cond = _c(qid).isin(*ids)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def grading_batches(figures: DataFrame, responses: DataFrame, n: int, seed: str = "grade") -> DataFrame:
    """EVA-40: (qid, batch, rubric, items) with at most ``n`` items per batch.

    ``figures(figure_id, qids, answers)``, ``responses(resp_key, response)``.  Batches are
    numbered by hash rank, so a template holding a third of all rows is still spread."""
    items = figures.select("figure_id", F.posexplode(F.arrays_zip("qids", "answers")).alias("i", "z")).select(
        F.concat_ws("_", "figure_id", "i").alias("resp_key"),
        F.col("z.qids").alias("qid"),
        F.col("z.answers").alias("answer"),
    )
    ranked = hash_rank(items.join(responses, "resp_key"), ["qid"], ["resp_key"], seed, "rank")
    return (
        ranked.withColumn("batch", F.floor((F.col("rank") - 1) / n).cast("bigint"))
        .groupBy("qid", "batch")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "resp_key", "response", "answer"))).alias("items"))
        .withColumn("rubric", rubric("qid"))
    )


def ungroup_grades(batches: DataFrame) -> DataFrame:
    """EVA-41: one row per response from graded batches (resp_keys, reply JSON).

    A batch counts only if every item has an answer and a 0/1 score; else all −1."""
    g = batches.withColumn("_m", F.from_json("reply", "map<string,string>"))
    n = F.size("resp_keys")

    def good(i):
        k = (i + 1).cast("string")
        return F.try_element_at("_m", F.concat(F.lit("extract_answer_T"), k)).isNotNull() & F.coalesce(
            F.try_element_at("_m", F.concat(F.lit("score_T"), k)).isin("0", "1"), F.lit(False)
        )

    valid = F.coalesce(F.forall(F.sequence(F.lit(0), n - 1), good), F.lit(False))
    k = (F.col("i") + 1).cast("string")
    return (
        g.filter(n > 0)
        .withColumn("_ok", valid)
        .select("_m", "_ok", F.posexplode("resp_keys").alias("i", "resp_key"))
        .select(
            "resp_key",
            F.when(F.col("_ok"), F.try_element_at("_m", F.concat(F.lit("extract_answer_T"), k)))
            .otherwise("Failed to parse response")
            .alias("extracted_answer"),
            F.when(F.col("_ok"), F.try_element_at("_m", F.concat(F.lit("score_T"), k)).cast("int"))
            .otherwise(-1)
            .alias("score"),
        )
    )


def template_question(df: DataFrame, templates: DataFrame) -> DataFrame:
    """EVA-42: question text from a template, the subplot position and the answer.

    ``templates(qid, template)`` holds one '{}' placeholder; 18 and 19 take no prefix."""
    prefix = (
        F.when(F.col("subplot_name").isNotNull(), F.concat(F.lit("For "), "subplot_name", F.lit(", ")))
        .when(F.col("subplot_row") == 0, "For the current plot, ")
        .otherwise(
            F.concat(
                F.lit("For the subplot at row "), F.col("subplot_row").cast("string"), F.lit(" and column "),
                F.col("subplot_col").cast("string"), F.lit(", "),
            )
        )
    )
    text = F.when(F.col("qid").isin(18, 19), F.col("template")).otherwise(
        F.replace(F.col("template"), F.lit("{}"), prefix)
    )
    return df.join(templates, "qid").withColumn("question", text).drop("template")


def batch_extract(df: DataFrame, n: int, key: str, seed: str = "extract") -> DataFrame:
    """EVA-43: rows without an extraction in batches of ``n`` for a judge (items ordered)."""
    todo = df.filter((F.col("kind") != "Acc+") & F.col("extraction").isNull())
    ranked = hash_rank(todo, [], [key], seed, "rank")
    return (
        ranked.withColumn("batch", F.floor((F.col("rank") - 1) / n).cast("bigint"))
        .groupBy("batch")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rank", key, "response"))),
                lambda s: F.struct(s[key].alias(key), s["response"].alias("response")),
            ).alias("items")
        )
    )


def merge_back(df: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """EVA-43: ``replies(items, reply)`` counts only if it has one line per item."""
    lines = F.split("reply", "\n")
    got = (
        replies.filter(F.size(lines) == F.size("items"))
        .select(F.explode(F.arrays_zip(F.col("items"), lines.alias("lines"))).alias("z"))
        .select(F.col(f"z.items.{key}").alias(key), F.col("z.lines").alias("_new"))
    )
    return df.join(got, key, "left").withColumn("extraction", F.coalesce("extraction", "_new")).drop("_new")
