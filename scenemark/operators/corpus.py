"""Training-corpus assembly: conversations, mixing, batching, rendering."""

from __future__ import annotations

import heapq

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenemark.functions.answers import words_of
from scenemark.functions.rnd import _c
from scenemark.functions.text import py_list, strip
from scenemark.operators.sampling import hash_rank, sample_k
from scenemark.session import stored

IMAGE = "<image>"
IMAGE_TOKENS = 128


def turn(role: str, value: Column) -> Column:
    return F.struct(F.lit(role).alias("from"), value.alias("value"))


def pair(human: Column, gpt: Column) -> Column:
    return F.array(turn("human", human), turn("gpt", gpt))


# --- conversion ----------------------------------------------------------------------


def image_name(prefix: str, idx) -> Column:
    return F.format_string(f"{prefix}_%08d.jpg", _c(idx))


def to_conversation(captions: DataFrame, style: str, prefix: str = "fig") -> DataFrame:
    """TRN-1: caption rows (id, input, output[, image]) to conversations.

    'numbered': numeric id, image named by id, image token first; 'named': the row's own
    image; 'pretrain': text id and image folder, image token last."""
    first = F.concat(F.lit(IMAGE + "\n"), "input")
    if style == "numbered":
        return captions.select("id", image_name(prefix, "id").alias("image"), pair(first, F.col("output")).alias("conversations"))
    if style == "named":
        return captions.select("id", "image", pair(first, F.col("output")).alias("conversations"))
    if style == "pretrain":
        name = F.format_string(f"{prefix}_%08d", "id")
        return captions.select(
            name.alias("id"),
            F.concat(F.lit(prefix + "/"), name, F.lit(".jpg")).alias("image"),
            pair(F.concat("input", F.lit("\n" + IMAGE)), F.col("output")).alias("conversations"),
        )
    raise ValueError(f"unknown style: {style}")


def to_eval_rows(captions: DataFrame, prefix: str = "fig") -> DataFrame:
    """TRN-2."""
    return captions.select(F.col("id").alias("question_id"), F.col("input").alias("text"), image_name(prefix, "id").alias("image"))


def _with_options() -> Column:
    return F.concat(
        F.lit(IMAGE + "\n"), "question", F.lit(" Select one from the following options: "),
        py_list("choices", F.col("perspective") == "counting"),
    )


def _question_rows(questions: DataFrame, prefix: str, human: Column) -> DataFrame:
    return questions.select(
        F.concat_ws("_", F.lit(prefix), "perspective", "image_id", "question_id").alias("id"),
        "perspective",
        F.concat(F.lit(prefix + "/"), image_name(prefix, "image_id")).alias("image"),
        pair(human, F.col("answer").cast("string")).alias("conversations"),
    )


def vqa_to_conv_easy(questions: DataFrame, prefix: str = "easy") -> DataFrame:
    """TRN-3: options always appended."""
    return _question_rows(questions, prefix, _with_options())


def vqa_to_conv_hard(questions: DataFrame, prefix: str = "hard") -> DataFrame:
    """TRN-4: no options for counting, location and "Is …" existence questions."""
    bare = F.concat(F.lit(IMAGE + "\n"), "question")
    plain = F.col("perspective").isin("counting", "location") | (
        (F.col("perspective") == "existence") & F.lower("question").startswith("is")
    )
    return _question_rows(questions, prefix, F.when(plain, bare).otherwise(_with_options()))


def sample_per_category(df: DataFrame, n: int, seed: str, category: str, keys: list[str]) -> DataFrame:
    """TRN-5: at most ``n`` rows of each category."""
    return sample_k(df, [category], n, seed, keys)


def mix(base: DataFrame, parts: list[DataFrame], seed: str, keys: list[str]) -> DataFrame:
    """TRN-6: base and parts together in random order (``pos``, dense)."""
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, base)
    return hash_rank(all_, [], keys, seed, "pos")


# --- lengths and batches ----------------------------------------------------------------


def n_words(turns: Column) -> Column:
    return F.aggregate(turns, F.lit(0), lambda a, t: a + F.size(words_of(t["value"])))


def lengths(df: DataFrame) -> DataFrame:
    """TRN-7: words over all turns, plus 128 if the sample has an image; and the length
    signed by modality."""
    w = n_words(F.col("conversations"))
    img = F.col("image").isNotNull()
    return df.withColumn("_w", w).withColumn("length", F.col("_w") + F.when(img, IMAGE_TOKENS).otherwise(0)).withColumn(
        "modality_length", F.when(img, F.col("_w")).otherwise(-F.col("_w"))
    ).drop("_w")


def _megabatches(df: DataFrame, group: list[str], size: int, seed: str, key: str) -> DataFrame:
    """Random megabatches: ``mega`` numbers consecutive runs of ``size`` rows in hash order."""
    return hash_rank(df, group, [key], seed, "_r").withColumn("mega", F.floor((F.col("_r") - 1) / size).cast("bigint")).drop("_r")


def length_batches(df: DataFrame, batch: int, world: int, seed: str, key: str = "id", length: str = "length") -> DataFrame:
    """TRN-8: (mega, rank, chunk, slot).  Inside a megabatch rows are sorted by length and
    dealt to the ``world`` chunks in snake order, which evens out the chunk lengths."""
    m = _megabatches(df.select(key, length), [], batch * world, seed, key)
    w = Window.partitionBy("mega").orderBy(F.col(length).desc(), key)
    return (
        m.withColumn("rank", F.row_number().over(w) - 1)
        .withColumn("chunk", _snake(F.col("rank"), world))
        .withColumn("slot", F.floor(F.col("rank") / world).cast("int"))
    )


def _snake(rank: Column, world: int) -> Column:
    """Chunk of a rank: rows of ``world`` are dealt forwards and backwards in turn."""
    at = (rank % world).cast("int")
    return F.when(F.floor(rank / world) % 2 == 0, at).otherwise(world - 1 - at)


def modality_batches(df: DataFrame, batch: int, world: int, seed: str, key: str = "id") -> DataFrame:
    """TRN-8 with images and text: megabatches per modality, each dealt to chunks by length as
    in length_batches.  Full ones come in random order; the last ones of both modalities come
    together at the end, in the order of the key and without chunks.  A corpus of one modality
    has no such end.  Adds ``position``, the order of the megabatch."""
    size = batch * world
    side = df.select(key, (F.col("modality_length") > 0).alias("mm"), F.abs("modality_length").alias("length"))
    m = _megabatches(side, ["mm"], size, seed, key)
    last = m.groupBy("mm").agg(F.max("mega").alias("_last"))
    kinds = last.agg(F.count(F.lit(1)).alias("_kinds"))
    tail = (F.col("mega") == F.col("_last")) & (F.col("_kinds") > 1)
    m = stored(m.join(last, "mm").crossJoin(kinds).withColumn("tail", tail).drop("_last", "_kinds"), "megabatches")
    full = m.filter(~F.col("tail")).select("mm", "mega").distinct()
    order = hash_rank(full, [], ["mm", "mega"], seed + ":order", "position")
    n_full = order.agg(F.count(F.lit(1)).alias("_n"))
    placed = m.join(order, ["mm", "mega"], "left").crossJoin(n_full)
    placed = placed.withColumn("position", F.coalesce("position", F.col("_n") + 1)).drop("_n")
    # the end is one position of at most two megabatches
    by_length = Window.partitionBy("position").orderBy(F.when(F.col("tail"), 0).otherwise(-F.col("length")), key)
    ranked = placed.withColumn("rank", F.row_number().over(by_length) - 1)
    return ranked.withColumn("chunk", F.when(~F.col("tail"), _snake(F.col("rank"), world))).withColumn(
        "slot", F.when(~F.col("tail"), F.floor(F.col("rank") / world).cast("int"))
    )


def greedy_batches(df: DataFrame, batch: int, world: int, seed: str, key: str = "id", length: str = "length") -> DataFrame:
    """TRN-8, greedy fill: each row goes to the shortest chunk that is not full.  Sequential
    by nature, so it runs per megabatch (at most batch × world rows) in applyInPandas."""
    m = _megabatches(df.select(key, length), [], batch * world, seed, key)
    kind = m.schema[key].dataType.simpleString()

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([length, key], ascending=[False, True], ignore_index=True)
        room = len(rows) // world
        if room * world != len(rows):  # an incomplete megabatch is dealt in turn
            return rows.assign(chunk=np.arange(len(rows)) % world)[[key, "mega", "chunk"]]
        chunks, heap = [], [(0, c, room) for c in range(world)]  # (total length, chunk, free places)
        for more in rows[length].tolist():
            total, chunk, free = heapq.heappop(heap)
            chunks.append(chunk)
            if free > 1:
                heapq.heappush(heap, (total + more, chunk, free - 1))
        return rows.assign(chunk=chunks)[[key, "mega", "chunk"]]

    return m.groupBy("mega").applyInPandas(deal, f"{key} {kind}, mega long, chunk int")


# --- turns ------------------------------------------------------------------------------


def normalise_image_token(turns, tag: bool = False, start_end: tuple[str, str] | None = None) -> Column:
    """TRN-9: the image token moves to the front of its turn, optionally wrapped."""

    def one(t):
        v = t["value"]
        moved = strip(F.concat(F.lit(IMAGE + "\n"), strip(F.replace(v, F.lit(IMAGE), F.lit("")))))
        out = F.when(v.contains(IMAGE), F.replace(moved, F.lit(IMAGE), F.lit(f"<Image>{IMAGE}</Image>")) if tag else moved).otherwise(v)
        if start_end:
            out = F.replace(out, F.lit(IMAGE), F.lit(start_end[0] + IMAGE + start_end[1]))
        return F.struct(t["from"].alias("from"), out.alias("value"))

    return F.transform(_c(turns), one)


def human_first(turns: Column) -> Column:
    """Drop a leading turn that is not the human's."""
    return F.when(F.get(turns, 0)["from"] != "human", F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0)))).otherwise(turns)


def alternates(turns: Column) -> Column:
    """Roles alternate human, gpt, …"""
    ok = F.transform(turns, lambda t, i: t["from"] == F.when(i % 2 == 0, "human").otherwise("gpt"))
    return F.forall(ok, lambda x: x)


#: Per style what stands before and after a message of the user and of the bot, what stands for
#: an empty message, and what opens the text.
FRAMES = {
    "single": {"user": ("{role}: ", "{sep}"), "bot": ("{role}: ", "{sep}"), "bare": "{role}:", "head": "{system}{sep}"},
    "two": {"user": ("{role}: ", "{sep}"), "bot": ("{role}: ", "{sep2}"), "bare": "{role}:", "head": "{system}{sep}"},
    "mpt": {"user": ("{role}", "{sep}"), "bot": ("{role}", "{sep}"), "bare": "{role}", "head": "{system}{sep}"},
    "plain": {"user": ("", "{sep}"), "bot": ("", "{sep2}"), "bare": "", "head": "{system}"},
    "llama2": {"user": ("{sep}[INST] ", " [/INST]"), "bot": (" ", " {sep2}"), "bare": "", "head": ""},
}


def render(turns, template: dict) -> Column:
    """TRN-10: text of a conversation; template = style, system, roles, sep, sep2.

    Styles: those of ``FRAMES`` and signal, which names the speaker of every turn."""
    style, system, sep = template["style"], template.get("system", ""), template.get("sep", "")
    user, bot = template.get("roles", ("USER", "ASSISTANT"))
    if style == "signal":
        names = F.create_map(F.lit("human"), F.lit(user), F.lit("gpt"), F.lit(bot))
        said = lambda m: F.concat(F.lit("### "), F.coalesce(F.try_element_at(names, F.lower(m["from"])), F.lit("unknown")), F.lit(": "), m["value"], F.lit("\n"))
        return F.concat(F.lit(system), F.array_join(F.transform(_c(turns), said), ""), F.lit("### "))
    if style not in FRAMES:
        raise ValueError(f"unknown style: {style}")
    frame = FRAMES[style]
    fill = lambda text, role: F.lit(text.format(role=role, sep=sep, sep2=template.get("sep2") or "", system=system))
    lead = F.lit(f"<<SYS>>\n{system}\n<</SYS>>\n\n" if style == "llama2" and system else "")

    def part(m, i):
        by_turn = lambda text: F.when(i % 2 == 0, text("user", user)).otherwise(text("bot", bot))
        before = by_turn(lambda side, role: fill(frame[side][0], role))
        after = by_turn(lambda side, role: fill(frame[side][1], role))
        bare = by_turn(lambda _, role: fill(frame["bare"], role))
        return F.when(F.length(m["value"]) > 0, F.concat(before, F.when(i == 0, lead).otherwise(""), m["value"], after)).otherwise(bare)

    text = F.concat(fill(frame["head"], ""), F.array_join(F.transform(human_first(_c(turns)), part), ""))
    return F.ltrim(text, F.lit(sep)) if style == "llama2" and sep else text


def render_plain_pair(turns, sep: str) -> Column:
    """TRN-10, pretraining pair: image token, answer and separator; NULL unless it is a
    pair whose first turn has the image."""
    t = _c(turns)
    ok = (F.size(t) == 2) & F.get(t, 0)["value"].contains(IMAGE)
    return F.when(ok, F.concat(F.lit(IMAGE), F.get(t, 1)["value"], F.lit(sep)))


def supervised_spans(turns) -> Column:
    """TRN-11: character spans [start, end) of the concatenated turns; only assistant text
    is supervised."""
    empty = F.array().cast("array<struct<start:int,end:int,role:string,supervised:boolean>>")

    def step(acc, t):
        end = acc["pos"] + F.length(t["value"])
        span = F.struct(
            acc["pos"].alias("start"), end.alias("end"), t["from"].alias("role"), (t["from"] == "gpt").alias("supervised")
        )
        return F.struct(end.alias("pos"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    start = F.struct(F.lit(0).alias("pos"), empty.alias("spans"))
    return F.aggregate(_c(turns), start, step, lambda a: a["spans"])
