"""Scores of a hierarchical Pitman-Yor language model.

Tokens are words and one end per text.  A token's context is the whole word before it, hashed to
as many restaurants as the root of the text's bytes, so they grow with the input as a vocabulary
does.  Restaurants of words of one class (a hash of the last two bytes) share a parent, and the
parents share one root over the whole vocabulary, whose base is uniform over the known words and
one unknown.  Customers are training tokens; a dish's tables are customers of the parent.  Seating
is sampled by blocked Gibbs steps: the number of tables of each dish in each restaurant is drawn
given all others, from the exact conditional up to ``EXACT`` customers and by drawing the further
customers in order beyond it.  A token's probability is the mean of the predictive probabilities
of several samples.

A word and all its restaurants lie in one bucket, so a sweep moves nothing; between rounds only
the totals of the restaurants (two numbers each) are brought up to date.  Texts are read once:
a chunk of documents becomes its distinct (word, context) pairs, sorted, with training counts,
and the pairs of each document.  Pairs travel to their buckets and come back as scores, as packed
columns of numbers.  A frequent word's pairs come from every chunk: where a bucket would get more
than ``ENTRIES``, its chunks are merged in parts, the parts' distinct pairs are united for the
sweeps, and scores are looked up part by part.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenemark.session import small_batches, stored

#: Classes of the word before.
NEAR = 8
#: Bytes of text per bucket of words.
BUCKET_BYTES = 6 << 20
CHUNK_TOKENS = 1_000_000
#: Texts that reach Python at once.
TEXTS = 250
#: Pairs of chunks that are merged at once, on average at most.
ENTRIES = 1_000_000
#: Parts of a bucket whose scores are looked up by one task.
TOGETHER = 4
#: Customers of a dish up to which the number of its tables is drawn exactly.
EXACT = 64
BURN, SAMPLES = 2, 3
STRENGTH = 1.0
SEED = 7
END = xxhash.xxh64_intdigest(b"end of text") & ~15  # holds spaces, so no word has these bytes
WORDS = 200_000


# --- packing --------------------------------------------------------------------------------


def _pack(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers as planes of their bytes, which compress well where high bytes are zero."""
    numbers = np.ascontiguousarray(numbers, kind)
    return numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def _unpack(data: bytes, kind: str = "<u4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _steps(numbers: np.ndarray) -> np.ndarray:
    """Differences of an ascending array, from zero."""
    return np.diff(numbers, prepend=numbers.dtype.type(0))


# --- chunks of documents ----------------------------------------------------------------------


class _Ids(dict):
    """Word -> 60 bits of its hash and four bits of its class."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        found = self[word] = (xxhash.xxh64_intdigest(word) & ~15) | (zlib.crc32(word[-2:]) & 15)
        return found


_IDS = _Ids()


def word_ids(text: bytes) -> np.ndarray:
    """Ids of the words of a text and of its end."""
    words = text.lower().split()  # bytes: A-Z only, split at \x20 and \x09-\x0D
    return np.array([*map(_IDS.__getitem__, words), END], np.uint64)


def restaurants(size: int) -> int:
    """Number of leaf restaurants for so many bytes of text: the power of two from their root up."""
    return max(2 * NEAR, 1 << math.isqrt(size).bit_length())


def contexts(ids: np.ndarray, first: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf restaurant of every token, from the word before; those of a class lie together.
    ``first`` marks positions where texts begin."""
    before = np.concatenate((ids[:1], ids[:-1]))
    before[first] = 0
    hashed = (before >> np.uint64(4) & np.uint64(0xFFFFFFF)).astype(np.int64)
    return (before & np.uint64(15)).astype(np.int64) % NEAR * (leaves // NEAR) + hashed % (leaves // NEAR)


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((ids >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _chunk(texts: list[np.ndarray], train: np.ndarray, buckets: int, leaves: int) -> dict:
    """Pairs of a chunk cut by bucket, and the pairs of its documents (in order within each)."""
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    ids = np.concatenate(texts)
    words, word = np.unique(ids, return_inverse=True)
    word *= leaves
    word += contexts(ids, starts[:-1], leaves)
    del ids  # arrays as long as the chunk go as soon as they can
    pairs, pair = np.unique(word, return_inverse=True)
    del word
    doc = np.repeat(np.arange(len(sizes)), sizes)
    count = np.bincount(pair[train[doc]], minlength=len(pairs))
    doc *= len(pairs)
    pair += doc
    pair.sort()
    within = pair
    within -= doc
    del doc
    move = _steps(within)
    move[starts[:-1]] = within[starts[:-1]]  # every document starts anew
    at = pairs // leaves
    home = _bucket(words, buckets)
    slices = []
    for b in np.unique(home):
        lo, hi = np.searchsorted(home, [b, b + 1])
        p, q = np.searchsorted(at, [lo, hi])
        slices.append({"bucket": int(b), "word": _pack(_steps(words[lo:hi]), "<u8"), "pair": _pack(_steps(pairs[p:q] - lo * leaves)), "count": _pack(count[p:q])})
    homes, entries = np.unique(home[at], return_counts=True)
    return {"sizes": sizes.astype(np.int64), "pairs": _pack(move), "slices": slices, "homes": homes, "entries": entries}


def _chunks(buckets: int, leaves: int):
    slice_type = pa.struct([("bucket", pa.int32()), ("word", pa.binary()), ("pair", pa.binary()), ("count", pa.binary())])

    def row(number, held, texts):
        keys = pa.concat_arrays([h[0] for h in held])
        train = np.concatenate([h[1] for h in held])
        made = _chunk(texts, train, buckets, leaves)
        whole = pa.array([0, len(keys)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), pa.ListArray.from_arrays(whole, keys), pa.ListArray.from_arrays(whole, pa.array(~train)),
                pa.ListArray.from_arrays(whole, pa.array(made["sizes"])), pa.array([made["pairs"]]), pa.array([made["slices"]], pa.list_(slice_type)),
                *[pa.array([made[k].tolist()], pa.list_(pa.int32())) for k in ("homes", "entries")],
            ],
            names=["chunk", "keys", "held", "sizes", "pairs", "slices", "homes", "entries"],
        )

    def run(batches):
        from pyspark import TaskContext

        number, held, texts, tokens = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            begin = 0
            for k, text in enumerate(batch.column(0).cast(pa.binary())):
                texts.append(word_ids(text.as_py() or b""))
                tokens += len(texts[-1])
                if tokens >= CHUNK_TOKENS:
                    held.append((batch.column(1)[begin : k + 1], train[begin : k + 1]))
                    yield row(number, held, texts)
                    number, held, texts, tokens, begin = number + 1, [], [], 0, k + 1
            if begin < len(batch):
                held.append((batch.column(1)[begin:], train[begin:]))
        if texts:
            yield row(number, held, texts)

    return run


# --- buckets ----------------------------------------------------------------------------------


def _merge(leaves: int):
    """One row per bucket, or part of one: its pairs over all its chunks, their counts and totals,
    and for every chunk where its pairs are among them.  A part has its words, and no totals."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for r in rows.itertuples():
            pairs = np.cumsum(_unpack(r.pair), dtype=np.int64)
            words = np.cumsum(_unpack(r.word, "<u8"), dtype=np.uint64)
            parts.append((words[pairs // leaves], (pairs % leaves).astype(np.uint32), _unpack(r.count)))
        bucket, part, of = (int(rows[k].iloc[0]) for k in ("bucket", "part", "of"))
        chunks = rows["chunk"].tolist()
        ends = np.cumsum([len(p[0]) for p in parts])
        leaf, count = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        words, word = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        del parts
        pairs, pair = np.unique(word * leaves + leaf, return_inverse=True)
        count = np.bincount(pair, count, len(pairs)).astype(np.int64)
        places = [_pack(_steps(found)) for found in np.split(pair, ends[:-1])]
        del word, leaf, pair
        known = _pack(_steps(words), "<u8") if of > 1 else None
        totals = (None, None) if of > 1 else _sparse(Seating(pairs, count, leaves).totals())
        made = (bucket, part, of, known, _pack(_steps(pairs)), _pack(count, "<i8"), *totals, chunks, places)
        return pd.DataFrame([made], columns=["bucket", "part", "of", "words", "pairs", "count", "at", "x", "chunks", "places"])

    return run


MERGED = "bucket int, part int, of int, words binary, pairs binary, count binary, at binary, x binary, chunks array<bigint>, places array<binary>"
UNITED = "bucket int, of int, words binary, pairs binary, count binary, at binary, x binary"


def _unite(leaves: int):
    """Parts, sorted by bucket, to one row per bucket; one part at a time is added."""

    def row(bucket, of, words, pairs, count):
        at, x = _sparse(Seating(pairs, count, leaves).totals())
        values = [bucket], [of], [_pack(_steps(words), "<u8")], [_pack(_steps(pairs))], [_pack(count, "<i8")], [at], [x]
        kinds = pa.int32(), pa.int32(), *[pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=["bucket", "of", "words", "pairs", "count", "at", "x"])

    def run(batches):
        own, of, words, pairs, count = None, 0, None, None, None
        for batch in batches:
            for k in range(len(batch)):
                bucket, parts, *packed = (batch.column(c)[k].as_py() for c in ("bucket", "of", "words", "pairs", "count"))
                more, new, add = (np.cumsum(_unpack(packed[0], "<u8"), dtype=np.uint64), np.cumsum(_unpack(packed[1]), dtype=np.int64), _unpack(packed[2], "<i8"))
                if bucket != own:
                    if own is not None:
                        yield row(own, of, words, pairs, count)
                    own, of, words, pairs, count = bucket, parts, more, new, add
                    continue
                both = np.union1d(words, more)
                pairs = np.concatenate([np.searchsorted(both, w)[p // leaves] * leaves + p % leaves for w, p in ((words, pairs), (more, new))])
                pairs, at = np.unique(pairs, return_inverse=True)
                words, count = both, np.bincount(at, np.concatenate([count, add]), len(pairs)).astype(np.int64)
        if own is not None:
            yield row(own, of, words, pairs, count)

    return run


def _sparse(totals: np.ndarray) -> tuple[bytes, bytes]:
    """Places and values of what is not zero."""
    at = np.flatnonzero(totals)
    return _pack(_steps(at)), _pack(totals[at], "<i8")


class Globals:
    """Totals over all buckets: training tokens, vocabulary, customers and tables of every
    restaurant, and the discount of each level from its counts of ones and twos."""

    def __init__(self, sums: np.ndarray, discounts: list[float] | None = None):
        self.n, self.v = sums[0], sums[1]
        customers, tables = np.split(sums[8:], 2)
        self.customers = np.split(customers, [1, 1 + NEAR])
        self.tables = np.split(tables, [1, 1 + NEAR])
        ones, twos = sums[2:5], sums[5:8]
        self.discounts = discounts or [float(np.clip(a / max(a + 2 * b, 1), 0.05, 0.95)) for a, b in zip(ones, twos)]
        self.base = 1.0 / (self.v + 1)


def stirling(most: int, d: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers: seatings of c customers at t tables."""
    log = np.full((most + 1, most + 1), -np.inf)
    log[1, 1] = 0.0
    t = np.arange(most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore"):
            stay = np.where(c - d * t > 0, np.log(np.maximum(c - d * t, 1e-300)), -np.inf) + log[c]
        log[c + 1] = np.logaddexp(stay, np.concatenate(([-np.inf], log[c, :-1])))
    return log


def draw_tables(c, p, other, theta: float, d: float, log: np.ndarray, rng) -> np.ndarray:
    """Number of tables of dishes with c customers, given the parent's probability p of each
    dish and the other tables of its restaurant."""
    t = np.ones(len(c), np.int64)
    short = np.minimum(c, len(log) - 1)
    order = np.argsort(short, kind="stable")
    cuts = np.flatnonzero(np.diff(short[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        n = int(short[order[a]])
        if n < 2:
            continue
        for at in range(a, b, max(1, 2_000_000 // n)):
            rows = order[at : min(b, at + max(1, 2_000_000 // n))]
            grow = np.cumsum(np.log((theta + d * (other[rows][:, None] + np.arange(n))) * p[rows][:, None]), axis=1)
            t[rows] = 1 + np.argmax(grow + log[n, 1 : n + 1] + rng.gumbel(size=grow.shape), axis=1)
    rows = np.flatnonzero(c > short)
    seated = short[rows].astype(np.int64)
    while len(rows):
        step = np.minimum(c[rows] - seated, np.maximum(1, seated // 16))
        new = (theta + d * (other[rows] + t[rows])) * p[rows]
        t[rows] += rng.binomial(step, new / (new + seated - d * t[rows]))
        seated += step
        more = seated < c[rows]
        rows, seated = rows[more], seated[more]
    return t


class Seating:
    """Customers and tables of a bucket's words in the root, the near and the leaf restaurants.
    ``pairs`` are word * leaves + leaf, ascending, with words from 0 and none left out."""

    def __init__(self, pairs: np.ndarray, count: np.ndarray, leaves: int, tables: list[np.ndarray] | None = None):
        self.word, self.leaf, self.count, self.leaves = pairs // leaves, pairs % leaves, count, leaves
        mids = pairs // (leaves // NEAR)  # word * NEAR + class
        self.mid = np.cumsum(np.diff(mids, prepend=mids[:1]) > 0)
        mids = np.unique(mids)
        self.mid_word, self.near = mids // NEAR, mids % NEAR
        self.words = int(self.word[-1]) + 1
        self.t2 = (count > 0).astype(np.int64) if tables is None else tables[2]
        self._seat_parents()
        self.t1 = (self.c1 > 0).astype(np.int64) if tables is None else tables[1]
        self._seat_parents()
        self.t0 = (self.c0 > 0).astype(np.int64) if tables is None else tables[0]

    def _seat_parents(self) -> None:
        self.c1 = np.bincount(self.mid, self.t2, len(self.near)).astype(np.int64)
        self.c0 = np.bincount(self.mid_word, getattr(self, "t1", self.c1 > 0), self.words).astype(np.int64)

    def totals(self) -> np.ndarray:
        """Sums for ``Globals``."""
        by = lambda at, x, n: np.bincount(at, x, n)
        level = [self.c0, self.c1, self.count]
        head = [self.count.sum(), (np.bincount(self.word, self.count, self.words) > 0).sum()]
        head += [(x == 1).sum() for x in level] + [(x == 2).sum() for x in level]
        customers = [self.c0.sum(), *by(self.near, self.c1, NEAR), *by(self.leaf, self.count, self.leaves)]
        tables = [self.t0.sum(), *by(self.near, self.t1, NEAR), *by(self.leaf, self.t2, self.leaves)]
        return np.array([*head, *customers, *tables], np.float64)

    @staticmethod
    def _blend(c, t, customers, tables, d, parent):
        total = STRENGTH + customers
        return (c - d * t) / total + (STRENGTH + d * tables) / total * parent

    def predictive(self, g: Globals) -> np.ndarray:
        """Probability of every pair's word in its leaf restaurant."""
        root = self._blend(self.c0, self.t0, g.customers[0][0], g.tables[0][0], g.discounts[0], g.base)
        mid = self._blend(self.c1, self.t1, g.customers[1][self.near], g.tables[1][self.near], g.discounts[1], root[self.mid_word])
        return self._blend(self.count, self.t2, g.customers[2][self.leaf], g.tables[2][self.leaf], g.discounts[2], mid[self.mid])

    def sweep(self, g: Globals, logs: list[np.ndarray], rng) -> None:
        """One Gibbs step for every dish of every restaurant, leaves first; ``g`` follows the
        changes made here.  Dishes of one level are drawn side by side, each given the others
        as they were."""
        (d0, d1, d2), old = g.discounts, self.t2.copy()
        root = self._blend(self.c0, self.t0, g.customers[0][0], g.tables[0][0], d0, g.base)
        live = np.flatnonzero(self.count > 0)
        own, m = self.t2[live], self.mid[live]
        c, near = self.c1[m] - own, self.near[m]
        p = self._blend(c, np.minimum(self.t1[m], c), g.customers[1][near] - own, g.tables[1][near], d1, root[self.mid_word[m]])
        self.t2[live] = draw_tables(self.count[live], p, g.tables[2][self.leaf[live]] - own, STRENGTH, d2, logs[2], rng)
        g.tables[2] = g.tables[2] + np.bincount(self.leaf, self.t2 - old, self.leaves)
        before = self.c1
        self.c1 = np.bincount(self.mid, self.t2, len(self.near)).astype(np.int64)
        g.customers[1] = g.customers[1] + np.bincount(self.near, self.c1 - before, NEAR)

        live, old = np.flatnonzero(self.c1 > 0), self.t1.copy()
        own, w = self.t1[live], self.mid_word[live]
        c = self.c0[w] - own
        p = self._blend(c, np.minimum(self.t0[w], c), g.customers[0][0] - own, g.tables[0][0], d0, g.base)
        self.t1[live] = draw_tables(self.c1[live], p, g.tables[1][self.near[live]] - own, STRENGTH, d1, logs[1], rng)
        g.tables[1] = g.tables[1] + np.bincount(self.near, self.t1 - old, NEAR)
        before = self.c0.sum()
        self.c0 = np.bincount(self.mid_word, self.t1, self.words).astype(np.int64)
        g.customers[0] = g.customers[0] + (self.c0.sum() - before)

        live, before = np.flatnonzero(self.c0 > 0), self.t0.sum()
        p = np.full(len(live), g.base)
        self.t0[live] = draw_tables(self.c0[live], p, g.tables[0][0] - self.t0[live], STRENGTH, d0, logs[0], rng)
        g.tables[0] = g.tables[0] + (self.t0.sum() - before)


def _burnt(batch: pa.RecordBatch, k: int, sums: np.ndarray, leaves: int, seed: int):
    """Seating of a batch's bucket after the first sweeps, always the same, and its discounts."""
    bucket, pairs, count = (batch.column(c)[k].as_py() for c in ("bucket", "pairs", "count"))
    state, g = Seating(np.cumsum(_unpack(pairs), dtype=np.int64), _unpack(count, "<i8"), leaves), Globals(sums)
    logs, rng = [stirling(EXACT, d) for d in g.discounts], np.random.default_rng([seed, 1, bucket])
    for _ in range(BURN):
        state.sweep(g, logs, rng)
    return bucket, state, g.discounts, logs


def _burn(sums: np.ndarray, leaves: int, seed: int):
    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                _, state, _, _ = _burnt(batch, k, sums, leaves, seed)
                at, x = _sparse(state.totals())
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([x])], names=["at", "x"])

    return run


ANSWERS = "chunk long, bucket int, score binary, known binary, each binary"


def _scores(start: np.ndarray, now: np.ndarray, leaves: int, samples: int, seed: int):
    """Scores of the pairs of a batch's bucket, and counts and places of their words.  The first
    sweeps are repeated, which is cheaper than moving the tables that they left; ``now`` has the
    totals after them."""

    def bucket_scores(batch: pa.RecordBatch, k: int):
        bucket, state, discounts, logs = _burnt(batch, k, start, leaves, seed)
        g, rng = Globals(now, discounts), np.random.default_rng([seed, 2, bucket])
        mean = np.zeros(len(state.count))
        for _ in range(samples):
            state.sweep(g, logs, rng)
            mean += state.predictive(g) / samples
        known = np.bincount(state.word, state.count, state.words).astype(np.int64)
        return bucket, np.log10(mean), known, state.word

    return bucket_scores


def _rows(batch: pa.RecordBatch, k: int, bucket: int, score: np.ndarray, known: np.ndarray, word: np.ndarray):
    """What a bucket's scores are to each of its chunks."""
    for chunk, place in zip(batch.column("chunks")[k].as_py(), batch.column("places")[k]):
        at = np.cumsum(_unpack(place.as_py()), dtype=np.int64)
        words, each = np.unique(word[at], return_counts=True)
        row = [chunk], [bucket], [_pack(score[at], "<f8")], [_pack(known[words], "<i8")], [_pack(each)]
        kinds = pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=["chunk", "bucket", "score", "known", "each"])


def _answer(bucket_scores):
    """Scores for every chunk of whole buckets."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                yield from _rows(batch, k, *bucket_scores(batch, k))

    return run


HELD = "bucket int, of int, words binary, pairs binary, score binary, known binary"


def _held(bucket_scores):
    """Scores of buckets that came in parts, for ``_looked_up``."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                _, score, known, _ = bucket_scores(batch, k)
                same = [batch.column(c).slice(k, 1) for c in ("bucket", "of", "words", "pairs")]
                yield pa.RecordBatch.from_arrays([*same, pa.array([_pack(score, "<f8")]), pa.array([_pack(known, "<i8")])], names=["bucket", "of", "words", "pairs", "score", "known"])

    return run


def _looked_up(leaves: int):
    """Scores for every chunk of a bucket's parts; the row of side 0 has the bucket's scores, and
    its parts follow."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                bucket = batch.column("bucket")[k].as_py()
                words, pairs = np.cumsum(_unpack(batch.column("words")[k].as_py(), "<u8"), dtype=np.uint64), np.cumsum(_unpack(batch.column("pairs")[k].as_py()), dtype=np.int64)
                if batch.column("side")[k].as_py() == 0:
                    every, all_pairs = words, pairs
                    score, known = _unpack(batch.column("score")[k].as_py(), "<f8"), _unpack(batch.column("known")[k].as_py(), "<i8")
                    continue
                own = np.searchsorted(every, words)
                at = np.searchsorted(all_pairs, own[pairs // leaves] * leaves + pairs % leaves)
                yield from _rows(batch, k, bucket, score[at], known[own], pairs // leaves)

    return run


def _finish(n: float, v: float):
    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row, answers = chunk.iloc[0], answers.sort_values("bucket")
        score = np.concatenate([_unpack(s, "<f8") for s in answers["score"]])
        known = np.concatenate([np.repeat(_unpack(k, "<i8"), _unpack(e)) for k, e in zip(answers["known"], answers["each"])])
        base = np.log10((known + 0.1) / (n + 0.1 * (v + 1)))
        sizes = np.asarray(row["sizes"])
        starts = np.cumsum(sizes) - sizes
        move = np.cumsum(_unpack(row["pairs"]), dtype=np.int64)  # steps begin anew in every document
        pairs = move - np.repeat(np.concatenate(([0], move))[starts], sizes)
        total = lambda x: np.add.reduceat(x[pairs], starts)
        return pd.DataFrame(
            {
                "k": row["keys"], "held_out": row["held"], "n_tokens": sizes, "n_known": total((known > 0).astype(np.int64)),
                "train_tokens": int(n), "base_score": total(base), "score": total(score),
            }
        )

    return run


def _added(size: int):
    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for at, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[np.cumsum(_unpack(at), dtype=np.int64)] += _unpack(x, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["at", "x"])

    return run


def _summed(rows: DataFrame, leaves: int) -> np.ndarray:
    """Totals over all buckets; tasks add theirs up first, two numbers a restaurant reach the driver."""
    out = np.zeros(8 + 2 * (1 + NEAR + leaves))
    sums = rows.select("at", "x").mapInArrow(_added(len(out)), "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x"))
    with small_batches(rows.sparkSession, 1):  # a row is a whole bucket
        sums = stored(sums, "sums")
    sums = sums.toArrow()
    out[sums["at"].to_numpy()] = sums["x"].to_numpy()
    return out


def trained_on(key: str) -> Column:
    """Whether a row is learned from: the key's checksum modulo ten is not zero."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(10)) != 0


def _parted(parts: DataFrame, chunks: DataFrame, entries: int) -> tuple[DataFrame, int]:
    """Slices with the part of their bucket that their chunk is in, and how many more rows than
    buckets there will be.  Reaches the driver: a row per bucket that is cut."""
    homes = chunks.select(F.explode(F.arrays_zip("homes", "entries")).alias("h"))
    n = homes.groupBy(F.col("h.homes").alias("bucket")).agg(F.sum("h.entries").alias("n")).filter(F.col("n") > entries)
    cut = [(r.bucket, -(-r.n // entries)) for r in n.collect()]
    if not cut:
        return parts.select("*", F.lit(0).alias("part"), F.lit(1).alias("of")), 0
    sizes = F.broadcast(parts.sparkSession.createDataFrame(cut, "bucket int, of int"))
    known = parts.join(sizes, "bucket", "left").withColumn("of", F.coalesce("of", F.lit(1)))
    return known.withColumn("part", F.pmod(F.xxhash64("chunk"), F.col("of")).cast("int")), sum(of - 1 for _, of in cut)


def merged_rows(chunks: DataFrame, buckets: int, leaves: int, entries: int) -> tuple[DataFrame, bool]:
    """The stored rows of ``_merge``, and whether any bucket came in parts."""
    parts, more = _parted(chunks.select("chunk", F.explode("slices").alias("s")).select("chunk", "s.*"), chunks, entries)
    grouped = parts.repartition(buckets + more, "bucket", "part").groupBy("bucket", "part")
    return stored(grouped.applyInPandas(_merge(leaves), MERGED), "merged", heavy=True), more > 0


def _chunked(docs: DataFrame, key: str, train: Column | None, buckets: int, leaves: int) -> DataFrame:
    """The stored rows of ``_chunks``."""
    kind = dict(docs.dtypes)[key]
    given = docs.select("text", F.col(key).alias("k"), (trained_on(key) if train is None else train).alias("train"))
    slices = "slices array<struct<bucket:int,word:binary,pair:binary,count:binary>>, homes array<int>, entries array<int>"
    fields = f"chunk long, keys array<{kind}>, held array<boolean>, sizes array<bigint>, pairs binary, {slices}"
    with small_batches(docs.sparkSession, TEXTS):
        return stored(given.mapInArrow(_chunks(buckets, leaves), fields), "chunks", heavy=True)


def score(
    docs: DataFrame, key: str = "doc_id", train: Column | None = None, buckets: int | None = None, leaves: int | None = None, entries: int = ENTRIES
) -> DataFrame:
    """(``key``, held_out, n_tokens, n_known, train_tokens, base_score, score) per document.

    ``score`` is the model's log10 probability of the text's tokens, ``base_score`` that of
    smoothed single words.  ``leaves`` (a multiple of ``NEAR``) and ``buckets`` follow from the
    bytes of all texts unless given; ``entries`` bounds memory and changes no result.  NULL counts
    as empty: one token, the end.  Repeated rows are documents of their own; without training rows
    all words are unknown; other columns are not read; an empty table gives no rows."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = buckets or max(docs.sparkSession.sparkContext.defaultParallelism, size // BUCKET_BYTES)
    leaves = leaves or restaurants(size)
    kind = dict(docs.dtypes)[key]
    chunks = _chunked(docs, key, train, buckets, leaves)
    merged, cut = merged_rows(chunks, buckets, leaves, entries)
    whole = states = merged.filter("of = 1")
    if cut:
        in_parts = merged.filter("of > 1").select("bucket", "part", "of", "words", "pairs", "count").repartition(buckets, "bucket").sortWithinPartitions("bucket", "part")
        with small_batches(docs.sparkSession, 1):
            united = stored(in_parts.drop("part").mapInArrow(_unite(leaves), UNITED), "united", heavy=True)
        states = whole.select("bucket", "pairs", "count", "at", "x").unionByName(united.drop("of", "words"))
    start = _summed(states, leaves)
    now = _summed(states.select("bucket", "pairs", "count").mapInArrow(_burn(start, leaves, SEED), "at binary, x binary"), leaves)
    g, scores = Globals(start), _scores(start, now, leaves, SAMPLES, SEED)
    answers = whole.select("bucket", "pairs", "count", "chunks", "places").mapInArrow(_answer(scores), ANSWERS)
    if cut:
        held = united.drop("at", "x").mapInArrow(_held(scores), HELD)
        each = F.explode(F.sequence(F.lit(0), F.floor((F.col("of") - 1) / TOGETHER).cast("int"))).alias("group")
        held = held.select("bucket", each, F.lit(0).alias("side"), F.lit(0).alias("part"), "words", "pairs", "score", "known")
        asked = merged.filter("of > 1").select("bucket", F.floor(F.col("part") / TOGETHER).cast("int").alias("group"), F.lit(1).alias("side"), "part", "words", "pairs", "chunks", "places")
        rows = held.unionByName(asked, allowMissingColumns=True).repartition(buckets, "bucket", "group").sortWithinPartitions("bucket", "group", "side", "part")
        answers = answers.unionByName(rows.mapInArrow(_looked_up(leaves), ANSWERS))
    out = f"k {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    halves = chunks.select("chunk", "keys", "held", "sizes", "pairs").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return halves.applyInPandas(_finish(g.n, g.v), out).withColumnRenamed("k", key)
