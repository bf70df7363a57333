"""Language identification by nearest centroids.

A text is the vector of its hashed byte n-grams (orders 1 to 3, letters lower-cased, all else a
space), sublinear term frequency times inverse document frequency, of length one.  Each
language has several centroids, clustered on a bounded sample of its labelled texts; the
nearest by cosine names the language, and a text farther away than its language's reach is
rejected.  The reach depends on the text's length: single words are far from every centroid, so it
is taken from beginnings of 1, 2, 4, ... words of the fitted texts, by classes of length.  Document frequencies are counted over all training texts.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenemark.session import stored

BUCKETS = 1 << 14
CENTROIDS = 4
#: Labelled texts per language that the centroids are clustered on, at most.
FIT_DOCS = 1000
#: A language reaches down to this share of the cosine that all but one in a hundred of its
#: fitted texts of that length have.
SLACK = 0.25
#: Length classes: powers of two of the text's bytes; the last one has no upper end.
LENGTHS = 12
#: Words of the pieces of fitted texts that give the reach of short texts.
PIECES = (1, 2, 4, 8, 16, 32)
STEP = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.full(256, 32, np.int64)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def length_class(text: str) -> int:
    return min(len(text.encode()).bit_length(), LENGTHS) - 1


def pieces(text: str, draw: int) -> list[str]:
    """Runs of a few words of a text; where they lie follows from the number drawn."""
    words = text.split()
    return [" ".join(words[at : at + n]) for n in PIECES if n < len(words) for at in [draw % (len(words) - n + 1)]]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the text's n-grams, in pieces that overlap by two bytes."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw), STEP):
        a = _KEEP[raw[max(0, at - 2) : at + STEP]]
        new = min(at, 2)  # bytes that belong to the piece before
        two = a[:-1] * 256 + a[1:]
        three = two[:-1] * 256 + a[2:]
        for order, code in ((1, a[new:]), (2, two[max(0, new - 1) :]), (3, three)):
            code = code[code != (32, 8224, 2105376)[order - 1]]  # white space alone tells nothing
            spot = ((code * 3 + order) * 0x9E3779B1 & 0xFFFFFFFF) >> 18
            total += np.bincount(spot, minlength=BUCKETS)
    where = np.flatnonzero(total)
    return where, total[where]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of length one."""
    where, n = grams(text)
    weight = (1 + np.log(n)) * idf[where]
    return where, weight / (np.linalg.norm(weight) or 1.0)


def _frequencies(batches):
    seen, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if has_letter(text):
                seen[grams(text)[0]] += 1
                n += 1
    if n:
        where = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(where, -1)), pa.array(np.append(seen[where], n))], names=["bucket", "n"])


def _sample_vectors(idf: np.ndarray):
    def run(batches):
        for batch in batches:
            langs, texts, order = (batch.column(i).to_pylist() for i in range(3))
            given = [(g, h, t, True) for g, t, h in zip(langs, texts, order)]
            given += [(g, h, t, False) for g, whole, h in zip(langs, texts, order) for t in pieces(whole, h)]
            rows = [(g, h, *vector(t, idf), length_class(t), whole) for g, h, t, whole in given if has_letter(t)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[3].astype(np.float32) for r in rows], pa.list_(pa.float32())),
                        pa.array([r[4] for r in rows], pa.int32()), pa.array([r[5] for r in rows], pa.bool_()),
                    ],
                    names=["lang", "h", "at", "w", "length", "whole"],
                )

    return run


def _cluster(k: int, most: int):
    """Spherical k-means on one language's sample; first seeds are the farthest from those
    before.  Rows: centroid, reach."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = rows[~rows["whole"]]
        rows = rows[rows["whole"]].sort_values("h", kind="stable").head(most)
        parts = parts[parts["h"].isin(rows["h"])]
        points = np.zeros((len(rows), BUCKETS), np.float32)
        for i, (at, w) in enumerate(zip(rows["at"], rows["w"])):
            points[i, at] = w
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        seeds = [int(np.argmax(points @ unit(points.mean(0, keepdims=True))[0]))]
        while len(seeds) < min(k, len(points)):
            seeds.append(int(np.argmin((points @ points[seeds].T).max(1))))
        centres = points[seeds]
        for _ in range(10):
            own = np.argmax(points @ centres.T, axis=1)
            centres = unit(np.stack([points[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))]))
        near = np.array([*(points @ centres.T).max(1), *((np.asarray(w) @ centres.T[at]).max() for at, w in zip(parts["at"], parts["w"]))])
        length = np.concatenate((rows["length"], parts["length"]))
        reach = [float(np.quantile(near[length == k], 0.01)) if (length == k).any() else np.inf for k in range(LENGTHS)]
        reach = np.minimum.accumulate(reach[::-1])[::-1]  # a longer text is never nearer by right
        reach = np.where(np.isfinite(reach), reach, near.min()) * SLACK
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centre": [c.tobytes() for c in centres.astype(np.float32)], "reach": [reach.tolist()] * len(centres)})

    return run


class Model:
    """Languages in order, their centroids (one per row) and reach by length class, and the frequencies."""

    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, reach: np.ndarray):
        self.idf, self.langs, self.centres, self.reach = idf, langs, np.ascontiguousarray(centres.T), reach

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, accepted); ties go to the first language by name."""
        if not has_letter(text) or not self.langs:
            return "und", 0.0, False
        where, weight = vector(text, self.idf)
        near = weight @ self.centres[where]
        best = int(np.argmax(near))
        return self.langs[best], float(min(1.0, max(0.0, near[best]))), bool(near[best] >= self.reach[best][length_class(text)])


def fit(labelled: DataFrame, centroids: int = CENTROIDS, fit_docs: int = FIT_DOCS, key: str = "doc_id") -> Model:
    """Model of the rows of ``labelled`` (text, lang, key) that have a language and a letter.

    The driver gets 2**14 frequencies and the centroids, a few per language."""
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", key)
    sums = rows.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = {r.bucket: r.n for r in sums}
    n = seen.pop(-1, 0)
    df = np.zeros(BUCKETS)
    df[list(seen)] = list(seen.values())
    idf = np.log((1 + n) / (1 + df)) + 1
    # rows are drawn by digest, so the draw does not depend on their order or partitions
    have = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    h = F.xxhash64(F.lit("fit"), F.col(key), "text").bitwiseAND((1 << 62) - 1)
    table = F.create_map(*[F.lit(x) for lang, m in sorted(have.items()) for x in (lang, int(min(1.0, 1.2 * fit_docs / m) * 2.0**62))]) if have else None
    if table is None:
        return Model(idf, [], np.zeros((0, BUCKETS), np.float32), np.zeros((0, LENGTHS)))
    drawn = rows.select("lang", "text", h.alias("h")).filter(F.col("h") < F.element_at(table, F.col("lang")))
    vectors = drawn.mapInArrow(_sample_vectors(idf), "lang string, h long, at array<int>, w array<float>, length int, whole boolean")
    found = vectors.groupBy("lang").applyInPandas(_cluster(centroids, fit_docs), "lang string, centre binary, reach array<double>")
    rows = sorted(found.collect(), key=lambda r: (r.lang, bytes(r.centre)))
    centres = np.array([np.frombuffer(r.centre, np.float32) for r in rows]).reshape(len(rows), BUCKETS)
    return Model(idf, [r.lang for r in rows], centres, np.array([r.reach for r in rows]))


def _predict(model, at: int, columns: int):
    def run(batches):
        for batch in batches:
            found = [model.value.predict(t.as_py()) for t in batch.column(at)]
            made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[:columns]], names=["lang_pred", "score", "accepted", *batch.schema.names[:columns]])

    return run


def _held_out(key: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(3)) == 1


def predict(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` as c0, c1, ... with (lang_pred, score, accepted) of every whole text."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 64 KB per centroid, a few per language
    sent = columns if "text" in columns else [*columns, "text"]  # texts travel once
    given = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(sent)])
    fields = ["lang_pred string", "score double", "accepted boolean", *(f"c{i} {kinds[c]}" for i, c in enumerate(columns))]
    return given.mapInArrow(_predict(shared, sent.index("text"), len(columns)), ", ".join(fields))


def identify(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(``key``, held_out, lang_pred, score, accepted): learned from labelled rows that are not held
    out, predicted for all rows from the text alone.

    NULL texts and texts without a letter are ``und`` with score 0 and not accepted, as is every
    text where nothing could be learned; repeated rows repeat; rows without a language are
    predicted but not learned from; other columns are not read."""
    model = fit(docs.filter(~_held_out(key)), key=key)
    return predict(docs, model, [key]).select(F.col("c0").alias(key), _held_out("c0").alias("held_out"), "lang_pred", "score", "accepted")


def keep_known(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` whose language is accepted; columns as given.  Learned as in ``identify``."""
    model = fit(docs.filter(~_held_out(key)), key=key)
    names = docs.columns
    return predict(docs, model, names).filter("accepted").select([F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
