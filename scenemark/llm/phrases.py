"""Collocations from an FM-index per shard, enumerated by bidirectional interval extension.

A shard is some 1.5 million words and separators of one language, as ids of its own dictionary.
Its index holds two depth-limited Burrows-Wheeler transforms: rows sorted by the next words, with
the word behind each (``behind``), and rows sorted by the words before, with the word ahead of each
(``ahead``).  A phrase is an interval in both; reading ``ahead`` over the second extends it to the
right by every word that follows, with counts, and counting smaller words moves the first.

Counts are summed across shards one length at a time, and only what is frequent over all shards is
extended further: no phrase is more frequent than its parts, so nothing is lost, and the phrases
that occur once, by far the most, never leave their shard."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenemark.operators.sampling import with_seq_id
from scenemark.session import scratch, stored, work_partitions

LEAST = 10
TOP = 2000
#: A phrase goes where a longer one holds this percentage of its occurrences.
COVER = 50
DEPTH = 3
#: Words and separators at which a shard is closed.  With up to a third more it stays whole, and ids
#: fit in 21 bits, three of them in 63; only a text longer than that is cut.
SHARD = 1_500_000
#: Words and separators per bucket in which the pairs of all shards meet.
BUCKET = 3_000_000
#: Bytes of a text that are cut into words at a time.
WINDOW = 1 << 20

#: What ends a piece, and A-Z; a tab is a space.
_ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(10 if b in _ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Words(dict):
    """Word -> id from 1; a separator is 0, and nothing between two spaces -1."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = made = len(self) - 1
        return made


def sequence(raw: bytes, words: Words, size: int = WINDOW) -> np.ndarray:
    """Ids of a text's words, with one 0 at the end of every piece and none at the start."""
    text, at, found = raw.translate(TABLE), 0, []
    while at < len(text):
        end = len(text)
        if end - at > size:
            end = max(text.rfind(b" ", at + 1, at + size), text.rfind(b"\n", at + 1, at + size))
            if end < 0:
                nexts = [x for x in (text.find(b" ", at + size), text.find(b"\n", at + size)) if x >= 0]
                end = min(nexts, default=len(text))
        tokens = text[at:end].replace(b"\n", b" \n ").split(b" ")
        found.append(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
        at = end
    ids = np.concatenate([*found, np.zeros(1, np.int32)])
    ids = ids[ids >= 0]
    return ids[(ids > 0) | np.concatenate(([False], ids[:-1] > 0))]


# --- index ----------------------------------------------------------------------------------


def _pack(ids: np.ndarray) -> bytes:
    """Ids below 2^24, byte by byte of equal weight, compressed."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3])
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 3 * n, codec="zstd", asbytes=True), np.uint8).reshape(3, n).astype(np.int64)
    return planes[0] | planes[1] << 8 | planes[2] << 16


def transforms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(behind, ahead) of a cyclic sequence that ends in 0: rows sorted by three words onwards
    with the word before, and by three words backwards with the word after."""
    here = ids.astype(np.int64)
    after, before = np.roll(here, -1), np.roll(here, 1)
    onwards = np.argsort(here << 42 | after << 21 | np.roll(here, -2))
    backwards = np.argsort(here << 42 | before << 21 | np.roll(here, 2))
    return before[onwards], after[backwards]


class Index:
    """Both transforms of a shard and the first row of each word."""

    def __init__(self, counts: np.ndarray, ahead: np.ndarray, behind: np.ndarray | None = None):
        self.ahead, self.behind, self.n = ahead, behind, len(ahead)
        self.first = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        #: (word, row) of ``ahead`` in order: the rank of a word before a row is a search
        self.ranks = np.sort(ahead * self.n + np.arange(self.n))

    def words(self):
        """Intervals of all words: (rows onwards, rows backwards, size)."""
        return self.first[:-1], self.first[:-1], np.diff(self.first)

    def extend(self, onwards: np.ndarray, backwards: np.ndarray, size: np.ndarray):
        """All extensions to the right of intervals: (which, word, onwards, backwards, size), by
        interval and word.  Separators extend nothing but are counted as smaller words."""
        which = np.repeat(np.arange(len(size)), size)
        rows = np.repeat(backwards - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(len(which))
        found, count = np.unique(which << 21 | self.ahead[rows], return_counts=True)
        which, word = found >> 21, found & ((1 << 21) - 1)
        smaller = np.cumsum(count) - count
        start = np.concatenate(([0], np.cumsum(size)[:-1]))[which]
        real = word > 0
        which, word, count, smaller = which[real], word[real], count[real], (smaller - start)[real]
        return which, word, onwards[which] + smaller, np.searchsorted(self.ranks, word * self.n + backwards[which]), count

    def joined(self, left: np.ndarray, right: np.ndarray):
        """Intervals of pairs of words, by a step backwards in both transforms."""
        steps = np.sort(self.behind * self.n + np.arange(self.n))
        low, high = (np.searchsorted(self.ranks, right * self.n + self.first[left + i]) for i in (0, 1))
        return np.searchsorted(steps, left * self.n + self.first[right]), low, high - low

    def sides(self, onwards: np.ndarray, backwards: np.ndarray, size: np.ndarray):
        """Occurrences with a word before them, and with a word after them, in their piece."""
        before = np.concatenate(([0], np.cumsum(self.behind > 0)))
        after = np.concatenate(([0], np.cumsum(self.ahead > 0)))
        return before[onwards + size] - before[onwards], after[backwards + size] - after[backwards]


# --- shards ----------------------------------------------------------------------------------

_INDEX = "shard bigint, lang string, sign int, n int, words array<string>, counts array<int>, behind binary, ahead binary"


def _row(shard: int, lang: str, sign: int, ids: np.ndarray, names: list[bytes]) -> dict:
    counts = np.bincount(ids, minlength=len(names))
    behind, ahead = transforms(ids)
    return {
        "shard": shard, "lang": lang, "sign": sign, "n": len(ids), "words": [w.decode() for w in names[1:]],
        "counts": counts.astype(np.int32), "behind": _pack(behind), "ahead": _pack(ahead),
    }


class _Open:
    """The shard of a language that is being filled."""

    def __init__(self):
        self.words, self.parts, self.size = Words(), [], 0

    def add(self, raw: bytes):
        ids = sequence(raw, self.words)
        self.parts.append(ids)
        self.size += len(ids)

    def close(self, limit: int):
        """(sign, ids, dictionary) of what was added, if any.  What is too long is cut with an
        overlap of DEPTH; a shard of the overlap alone, counted negatively, makes sums exact."""
        ids = np.concatenate(self.parts)
        names = [b"\n", *[w for w in self.words if w not in (b"\n", b"")]]
        if len(ids) <= limit + limit // 3:
            if len(ids):
                yield 1, ids, names
            return
        for at in range(0, len(ids), limit):
            cuts = [(1, ids[max(0, at - DEPTH) : at + limit])] + ([(-1, ids[at - DEPTH : at])] if at else [])
            for sign, part in cuts:
                used, own = np.unique(np.concatenate(([0], part, [0])), return_inverse=True)
                yield sign, own[1:], [names[i] for i in used]


def _shards(limit: int):
    def run(batches):
        from pyspark import TaskContext

        kinds = {"words": pa.list_(pa.string()), "counts": pa.list_(pa.int32()), "sign": pa.int32(), "n": pa.int32(), "shard": pa.int64(), "lang": pa.string()}
        number, open_ = TaskContext.get().partitionId() << 24, {}

        def closed(lang):
            nonlocal number
            for sign, ids, names in open_.pop(lang).close(limit):
                row = _row(number, lang, sign, ids, names)
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], names=list(row))

        for batch in batches:
            for raw, lang in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                open_.setdefault(lang, _Open()).add(raw or b"")
                if open_[lang].size >= limit:
                    yield from closed(lang)
                elif sum(o.size for o in open_.values()) >= 2 * limit:  # many languages at once
                    yield from closed(max(open_, key=lambda x: open_[x].size))
        for lang in list(open_):
            yield from closed(lang)

    return run


def indexed(docs: DataFrame, path: str, name: str, shard: int = SHARD) -> DataFrame:
    """The index of every shard, written by the tasks that read the texts, bucketed by shard so that
    facts about shards come to it and it never moves again."""
    given = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    made = given.mapInArrow(_shards(shard), _INDEX)
    made.write.bucketBy(work_partitions(docs), "shard").option("path", path).saveAsTable(name)
    return docs.sparkSession.table(name)


# --- lengths ----------------------------------------------------------------------------------


def _squeeze(*columns: np.ndarray) -> bytes:
    """Equally long integer columns in one string, byte by byte of equal weight, compressed."""
    planes = np.stack(columns).astype("<i8").view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _columns(packed: bytes, k: int, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * k * n, codec="zstd", asbytes=True), np.uint8).reshape(k, 8, n)
    return np.array(planes.transpose(0, 2, 1), order="C").view("<i8").reshape(k, n)


def _frame(schema: str, rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return pd.DataFrame(rows, columns=names) if rows else pd.DataFrame({c: pd.Series([], dtype=object) for c in names})


def _index(s: pd.Series) -> Index:
    return Index(np.asarray(s["counts"], np.int64), _unpack(s["ahead"], s["n"]), _unpack(s["behind"], s["n"]))


def _dealt(shard: pd.Series, kind: int, buckets: int, keys: list[np.ndarray], *columns: np.ndarray) -> list[tuple]:
    """Rows (bucket, kind, shard, sign, n, packed) of phrases in the order of their keys; the first
    key is packed as differences."""
    mixed = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        mixed = (mixed ^ k.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (mixed >> np.uint64(32)).astype(np.int64) % buckets
    order = np.lexsort((*keys[::-1], bucket))
    bucket, first, *rest = bucket[order], *[c[order] for c in (*keys, *columns)]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    return [
        (bucket[a], kind, shard["shard"], shard["sign"], b - a, _squeeze(np.diff(first[a:b], prepend=0), *[c[a:b] for c in rest]))
        for a, b in zip(cuts[:-1], cuts[1:])
    ]


def _summed(rows: pd.DataFrame, keys: int, least: int):
    """Phrases of a bucket over all shards: (packed columns by shard, keys, sums, which are
    frequent, the sums' row of every phrase).  Sums are occurrences, and those that a word of
    the piece extends before and after; the latter travel as what they lack."""
    parts = [_columns(p, keys + 3, n) for p, n in zip(rows["packed"], rows["n"])]
    for p in parts:
        p[0] = np.cumsum(p[0])
    every = np.concatenate(parts, axis=1)
    order = np.lexsort(every[:keys][::-1])
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(every[:keys, order], axis=1) != 0).any(0)
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    sign = np.repeat(rows["sign"].to_numpy(np.int64), rows["n"].to_numpy())
    sums = np.zeros((3, int(new.sum())), np.int64)
    count, first, last = every[keys:]
    for total, column in zip(sums, (count, count - first, count - last)):
        np.add.at(total, where, column * sign)
    return parts, every[:keys, order[new]], sums, sums[0] >= least, where


_DEALT = "bucket bigint, kind int, shard bigint, sign int, n int, packed binary"


def _pairs(buckets: int):
    """Extensions of a shard's frequent words by frequent words (kind 0), by bucket; and the
    words' numbers (kind 1), which come back with the pairs that stay."""

    def run(index: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(kept):
            return _frame(_DEALT, [])
        s = index.iloc[0]
        at = _index(s)
        frequent = np.sort(kept["local"].to_numpy())
        number = np.full(len(s["counts"]), -1, np.int64)
        number[kept["local"].to_numpy()] = kept["number"].to_numpy()
        which, word, *place = at.extend(*[x[frequent] for x in at.words()])
        use = number[word] >= 0
        pair = number[frequent[which[use]]] << 32 | number[word[use]]
        place = [x[use] for x in place]
        before, after = at.sides(*place)
        own = (s["shard"] % buckets, 1, s["shard"], s["sign"], len(frequent), _squeeze(np.diff(frequent, prepend=0), number[frequent]))
        return _frame(_DEALT, [own, *_dealt(s, 0, buckets, [pair], place[2], place[2] - before, place[2] - after)])

    return run


_KEPT = "kind int, shard bigint, n int, packed binary, totals array<struct<pair:bigint,f:bigint,before:bigint,after:bigint>>"


def _frequent(least: int):
    """A bucket's pairs of all shards -> each shard's frequent ones, and (kind 2) their sums."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(1, shard, n, packed, None) for shard, n, packed in rows.loc[rows["kind"] == 1, ["shard", "n", "packed"]].itertuples(index=False)]
        rows = rows[rows["kind"] == 0]
        if len(rows):
            parts, (pair,), sums, often, where = _summed(rows, 1, least)
            out.append((2, -1, 0, b"", [dict(zip(("pair", "f", "before", "after"), t)) for t in zip(pair[often].tolist(), *sums[:, often].tolist())]))
            at = 0
            for shard, p in zip(rows["shard"], parts):
                mine = p[0, often[where[at : at + p.shape[1]]]]
                at += p.shape[1]
                if len(mine):
                    out.append((0, shard, len(mine), _squeeze(np.diff(mine, prepend=0)), None))
        return _frame(_KEPT, out)

    return run


def _triples(buckets: int):
    """A shard's frequent pairs extended where the last two words are a frequent pair too."""

    def run(index: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        names, pairs = kept[kept["kind"] == 1], kept[kept["kind"] == 0]
        if not len(index) or not len(pairs):
            return _frame(_DEALT, [])
        s = index.iloc[0]
        at = _index(s)
        local, numbers = _columns(names["packed"].iloc[0], 2, names["n"].iloc[0])
        number = np.full(len(s["counts"]), -1, np.int64)
        number[np.cumsum(local)] = numbers
        order = np.argsort(numbers)
        place = lambda x: np.cumsum(local)[order[np.searchsorted(numbers, x, sorter=order)]]
        pair = np.sort(np.concatenate([np.cumsum(_columns(p, 1, n)[0]) for p, n in zip(pairs["packed"], pairs["n"])]))
        which, word, *found = at.extend(*at.joined(place(pair >> 32), place(pair & 0xFFFFFFFF)))
        tail = (pair[which] & 0xFFFFFFFF) << 32 | np.maximum(number[word], 0)
        use = (number[word] >= 0) & (pair[np.minimum(np.searchsorted(pair, tail), len(pair) - 1)] == tail)
        found = [x[use] for x in found]
        before, after = at.sides(*found)
        return _frame(_DEALT, _dealt(s, 0, buckets, [pair[which[use]], number[word[use]]], found[2], found[2] - before, found[2] - after))

    return run


_TRIPLES = "pair bigint, word bigint, f bigint, before bigint, after bigint"


def _totals(least: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        _, keys, sums, often, _ = _summed(rows, 2, least)
        return pd.DataFrame(dict(zip([c.split()[0] for c in _TRIPLES.split(", ")], (*keys[:, often], *sums[:, often]))))

    return run


class Counts:
    """Frequent phrases of a table, summed across shards.

    ``words``: (number, lang, word, f); ``totals``: (lang, n); ``pairs``: (pair, f, before, after);
    ``triples``: (pair, word, f, before, after); a pair is two numbers in one.  ``before`` and ``after`` are the
    occurrences that a word of the same piece extends on that side."""

    def __init__(self, docs: DataFrame, least: int = LEAST, shard: int = SHARD):
        spark = docs.sparkSession
        name = f"phrases_{uuid.uuid4().hex}"
        try:
            index = indexed(docs, scratch(spark, "index"), name, shard)
            entry = F.posexplode(F.arrays_zip("words", F.slice("counts", 2, F.size("words")).alias("counts")))
            words = index.select("shard", "lang", "sign", entry.alias("at", "w")).select(
                "shard", "lang", (F.col("at") + 1).alias("local"), F.col("w.words").alias("word"), (F.col("sign") * F.col("w.counts")).cast("bigint").alias("count")
            )
            sums = stored(words.groupBy("lang", "word").agg(F.sum("count").alias("f")), "words")
            self.totals = sums.groupBy("lang").agg(F.sum("f").alias("n"))
            frequent = with_seq_id(sums.filter(F.col("f") >= least), [F.desc("f"), "lang", "word"], "number")
            self.words = stored(frequent, "frequent")
            kept = words.join(self.words.hint("merge"), ["lang", "word"]).select(F.col("shard").alias("of"), "local", "number")
            buckets = max(work_partitions(docs), -(-(index.agg(F.sum("n")).first()[0] or 0) // BUCKET))
            facts = index.drop("lang", "words")
            dealt = facts.groupBy("shard").cogroup(kept.groupBy("of")).applyInPandas(_pairs(buckets), _DEALT)
            pairs = stored(dealt.groupBy("bucket").applyInPandas(_frequent(least), _KEPT), "pairs")
            self.pairs = pairs.filter("kind = 2").select(F.explode("totals").alias("t")).select("t.*")
            mine = pairs.filter("kind < 2").select("kind", F.col("shard").alias("of"), "n", "packed")
            dealt = facts.groupBy("shard").cogroup(mine.groupBy("of")).applyInPandas(_triples(buckets), _DEALT)
            self.triples = stored(dealt.groupBy("bucket").applyInPandas(_totals(least), _TRIPLES), "triples")
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


# --- scores -----------------------------------------------------------------------------------


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact to 14 digits of each count."""
    wide = lambda c: c.cast("decimal(14,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a), wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, before, after): each language's best phrases of 2 to 3 words.

    A-Z are lower-cased; texts are cut into pieces at ``.,;:!?`` and line breaks, pieces into words
    at spaces and tabs.  ``a`` counts a phrase's occurrences within pieces, at least ``least``; its
    score is that of its worst cut (ties: the earlier) into parts of ``l`` and ``r`` occurrences.  A
    phrase goes where a longer frequent one around it has ``cover`` percent of its occurrences.
    Ties of score go to the larger ``a``, then to the smaller phrase by bytes.  A NULL text has no
    words, a NULL language is ``und``; repeated rows count each; other columns are not read; an
    empty table gives no rows."""
    c = Counts(docs, least, shard)
    word = lambda i: c.words.select(F.col("number").alias(f"w{i}"), F.col("word").alias(f"t{i}"), F.col("f").alias(f"f{i}"), *(["lang"] if i == 1 else []))
    high = lambda p: F.shiftright(p, 32)
    low = lambda p: F.col(p).bitwiseAND(F.lit(0xFFFFFFFF))
    sizes = c.pairs.select("pair", F.col("f").alias("fp"))
    triples = c.triples.withColumn("tail", F.shiftleft(low("pair"), 32).bitwiseOR(F.col("word")))
    around = triples.select("pair", "f").unionByName(triples.select(F.col("tail").alias("pair"), "f")).groupBy("pair").agg(F.max("f").alias("longer"))
    free = c.pairs.join(around, "pair", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("f")))
    twos = free.select(high("pair").alias("w1"), low("pair").alias("w2"), "f", "before", "after").join(word(1), "w1").join(word(2), "w2").select(
        "lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), F.col("f").alias("a"),
        F.array(F.struct(score(F.col("f"), F.col("f1"), F.col("f2")).alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f2").alias("r"))).alias("cuts"), "before", "after",
    )
    cut = lambda k, left, right: F.struct(score(F.col("f"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    threes = (
        triples.select("pair", "tail", high("pair").alias("w1"), low("pair").alias("w2"), F.col("word").alias("w3"), "f", "before", "after")
        .join(sizes.withColumnRenamed("fp", "f12"), "pair")
        .join(sizes.select(F.col("pair").alias("tail"), F.col("fp").alias("f23")), "tail")
        .join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
        .select(
            "lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), F.col("f").alias("a"),
            F.array(cut(1, "f1", "f23"), cut(2, "f12", "f3")).alias("cuts"), "before", "after",
        )
    )
    best = twos.unionByName(threes).withColumn("cut", F.array_min("cuts"))
    order = [F.col("cut.score").desc(), F.col("a").desc(), "phrase"]
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return first.join(c.totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").cast("bigint").alias("score"), "before", "after",
    )
