"""Token ids in Parquet files that allow selective reads.

A file row is a document: its id, the block (write task) it lies in, tokens before it in the
block, its token count and the list of its ids.  Rows are in ascending order of the id, so row
group and page statistics find a range of documents; counts are read without touching ids.
Ids are dictionary or delta encoded."""

from __future__ import annotations

import json
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenemark.llm.segments import Cache, pack, parts, slices
from scenemark.session import work_partitions

#: Fixed value: the split of the byte-level pre-tokenizer.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space and what follows it; the separators \x1c-\x1f are not white space to the split.
RUN = regex.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: Byte -> character of a byte-level model: printable Latin-1 stands for itself, the other bytes
#: in order for the characters from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in _PLAIN]
BYTE_CHARS = [chr(b) if b in _PLAIN else chr(256 + _OTHER.index(b)) for b in range(256)]
#: Two characters in a row that Python calls white space, as ``DOUBLE`` has it.
SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
#: Distinct words that a worker keeps with their ids.
WORDS = 600_000
#: Bytes of text that are looked up together.
TOGETHER = 6 << 20
ROW_GROUP = 64 << 20
PAGE_ROWS = 1000


class Lookup:
    """Words -> ids for a batch of distinct words at once, kept as Arrow columns: less than a
    dictionary's memory, and only new words are Python's.  When over ``most`` are held, or over 64
    bytes of columns for each of so many, the half that came in the most batches stays; what goes costs time only."""

    def __init__(self, encode, most: int = WORDS):
        self.encode, self.most = encode, most
        self.words, self.ids, self.uses = pa.array([], pa.string()), _lists([]), np.zeros(0, np.int32)

    def __call__(self, found: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
        """(at, ids): word i has the ids ids[at[i]], none where ``encode`` has none."""
        found = found.cast(pa.string())
        if len(self.words) > self.most or self.words.nbytes + self.ids.nbytes > 64 * self.most:
            keep = np.sort(np.argsort(-self.uses, kind="stable")[: len(self.words) // 2])
            self.words, self.ids, self.uses = self.words.take(pa.array(keep)), self.ids.take(pa.array(keep)), self.uses[keep] // 2
        held = pc.index_in(found, self.words)
        new = found.filter(held.is_null())
        at = held.fill_null(0).to_numpy().copy()
        at[np.asarray(held.is_null())] = len(self.words) + np.arange(len(new))
        self.ids = pa.concat_arrays([self.ids, _lists(list(map(self.encode, _strings(new))))])
        self.words, self.uses = pa.concat_arrays([self.words, new]), np.concatenate((self.uses, np.zeros(len(new), np.int32)))
        self.uses[at] += 1
        return at, self.ids


class ByteTokens:
    """A byte-level BPE tokenizer of the tokenizers library, with cached segments."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        before = spec.get("pre_tokenizer") or {}
        self.cuts = (
            spec.get("normalizer") is None
            and spec["model"].get("type", "BPE") == "BPE"
            and not spec["model"].get("dropout")
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
        )
        self.split = regex.compile(SPLIT).findall
        self.model = self.library.model
        self.tokens = Cache(self._token, 100_000)
        self.runs = Cache(self._run, 50_000)
        self.words = Cache(self._word, 50_000)
        self.lookup = Lookup(lambda stem: self._word(stem) if stem.isalpha() else b"")
        self.after = Cache(self._part, 50_000)

    def whole(self, text: str) -> bytes:
        return pack(self.library.encode(text, add_special_tokens=False).ids)

    def _ids(self, mapped: str) -> bytes:
        return pack([t.id for t in self.model.tokenize(mapped)])

    def _token(self, token: str) -> bytes:
        """Ids of one pre-token: its bytes as the model's characters, straight to the model."""
        return self._ids("".join(map(BYTE_CHARS.__getitem__, token.encode())))

    def _word(self, word: str) -> bytes:
        """Ids of a space and a word of letters."""
        if word.isascii():
            return self._ids(BYTE_CHARS[32] + word)
        return self._token(" " + word) if max(word) < "ɐ" else self.whole(" " + word)

    def _part(self, part: str) -> bytes:
        """Ids of what follows a cut.  A word of letters is one pre-token, and so are the marks
        after it, if any; they are most of all parts."""
        word = part.rstrip(string.punctuation)
        if word.isalpha():
            marks = part[len(word) :]
            return self.words[word] + self.tokens[marks] if marks else self.words[word]
        return self._run(part if part[:1] == "\n" else " " + part)

    def _run(self, run: str) -> bytes:
        """A run by its pre-tokens; letters beyond Latin are left to the library's own tables."""
        if run.isascii() or max(run) < "ɐ":
            return b"".join(map(self.tokens.__getitem__, self.split(run)))
        return self.whole(run)

    def encode(self, text: str) -> bytes:
        """The library's ids of the whole text, packed."""
        if not self.cuts or any(s in text for s in self.special):
            return self.whole(text)
        cut = parts(text)
        if cut is None:
            return b"".join(map(self.runs.__getitem__, RUN.findall(text)))
        return self.runs[cut[0]] + b"".join(map(self.after.__getitem__, cut[1:])) if cut[0] else b"".join(map(self.after.__getitem__, cut[1:]))

    def looked_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
        """(offsets, codes, ids): text i is the lists of ids at codes[offsets[i]:offsets[i + 1]] in a row.

        Every distinct part of the texts is looked up once; a text's first part, or the whole text
        where it cannot be cut, has an entry of its own."""
        sound = pc.invert(pc.match_substring_regex(texts, SPACES))
        for special in self.special:
            sound = pc.and_not(sound, pc.match_substring(texts, special))
        if not self.cuts:
            sound = pa.array(np.zeros(len(texts), bool))
        cut = pc.split_pattern(pc.replace_substring(pc.if_else(sound, texts, ""), "\n", " \n"), " ")
        offsets = np.asarray(cut.offsets).astype(np.int64)
        flat = cut.values
        first = [self.runs[f] if f else b"" for f in flat.take(pa.array(offsets[:-1])).to_pylist()]
        for i in np.flatnonzero(~np.asarray(sound)).tolist():
            first[i] = self.encode(texts[i].as_py())
        coded = flat.dictionary_encode()
        codes = np.array(coded.indices)
        ids = self._distinct(coded.dictionary)
        codes[offsets[:-1]] = len(ids) + np.arange(len(texts))
        return offsets, codes, pa.concat_arrays([ids, _lists(first)])

    def _distinct(self, found: pa.Array) -> pa.ListArray:
        """Ids of distinct parts: of their words, each looked up once, and of the marks after them."""
        stems = pc.utf8_rtrim(found, string.punctuation).dictionary_encode()
        at, held = self.lookup(stems.dictionary)
        at = at[stems.indices.to_numpy()]
        size = np.asarray(pc.binary_length(found)) - np.asarray(pc.binary_length(stems.dictionary))[stems.indices.to_numpy()]
        other = np.diff(held.offsets)[at] == 0
        marked = np.flatnonzero((size > 0) & ~other)
        made, codes = [b""], {}
        after = np.zeros(len(found), np.int32)
        for i, part, n in zip(marked.tolist(), _strings(found.take(pa.array(marked))), size[marked].tolist()):
            marks = part[-n:]
            if marks not in codes:
                codes[marks] = len(made)
                made.append(self.tokens[marks])
            after[i] = codes[marks]
        after[other] = len(made) + np.arange(other.sum())
        made += map(self.after.__getitem__, _strings(found.filter(pa.array(other))))
        pairs = np.stack([at, after + len(held)], axis=1).ravel()
        taken = pa.concat_arrays([held, _lists(made)]).take(pa.array(pairs))
        return pa.ListArray.from_arrays(taken.offsets.take(pa.array(np.arange(0, len(pairs) + 1, 2))), taken.values)

    def sizes(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of every text."""
        offsets, codes, ids = self.looked_up(texts)
        return np.add.reduceat(np.diff(ids.offsets).astype(np.int64)[codes], offsets[:-1])

    def encode_all(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids): the ids of every text followed by ``end``, one text after the other."""
        offsets, codes, ids = self.looked_up(texts)
        codes = np.insert(codes, offsets[1:], len(ids))
        offsets += np.arange(len(offsets))
        taken = pa.concat_arrays([ids, _lists([end])]).take(pa.array(codes))
        return np.diff(np.asarray(taken.offsets)[offsets].astype(np.int64)), np.asarray(taken.values)


def _strings(found: pa.Array) -> list[str]:
    return found.to_numpy(zero_copy_only=False).tolist()


def _lists(ids: list[bytes]) -> pa.ListArray:
    """Packed ids as an Arrow list of ids each."""
    ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // 4
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def give_back() -> None:
    """Arrow's free memory goes back to the system: a worker lives on beside the next stages."""
    pa.default_memory_pool().release_unused()


_LOADED: dict[str, ByteTokens] = {}


def load(path: str) -> ByteTokens:
    """The tokenizer of a worker, read once; the file must be on every executor."""
    if path not in _LOADED:
        _LOADED[path] = ByteTokens(path)
    return _LOADED[path]


def _counts(path: str):
    def run(batches):
        model = load(path)
        for batch in batches:
            n = [model.sizes(texts) for texts in slices(batch.column(0), TOGETHER)]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), *batch.columns[1:]], names=["n", *batch.schema.names[1:]])

    return run


def count(docs: DataFrame, path: str, columns: list[str], make=_counts) -> DataFrame:
    """``columns`` of ``docs`` and ``tokens``, the token count of ``text`` (NULL: none)."""
    kinds = dict(docs.dtypes)
    given = docs.select("text", *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    made = given.mapInArrow(make(path), ", ".join(["n bigint", *(f"c{i} {kinds[c]}" for i, c in enumerate(columns))]))
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("n").alias("tokens"))


def _rows(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        block, at, end = TaskContext.get().partitionId(), 0, pack([end_id])
        model = load(path)
        for batch in batches:
            done = 0
            for texts in slices(batch.column(0), TOGETHER):
                n, ids = model.encode_all(texts, end)
                offsets = np.concatenate(([0], np.cumsum(n)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(done, len(n)),
                        pa.array(np.full(len(n), block, np.int32)),
                        pa.array(at + offsets[:-1]),
                        pa.array(n),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)),
                    ],
                    names=["doc_id", "block", "at", "n_tokens", "ids"],
                )
                at, done = at + int(offsets[-1]), done + len(n)
            give_back()

    return run


def write(
    docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", end_id: int = 0,
    encoding: str = "dictionary", row_group: int = ROW_GROUP, page_rows: int = PAGE_ROWS,
) -> None:
    """Encode every whole text, append ``end_id``, write in ascending order of ``key``.

    NULL counts as empty (one id).  NULL keys come first, equal keys in the order of their
    texts, repeated rows one after the other; other columns are not read.  An empty table
    gives files without rows."""
    kind = dict(docs.dtypes)[key]
    given = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col(key).alias("doc_id"))
    ordered = given.repartitionByRange(work_partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(_rows(tokenizer, end_id), f"doc_id {kind}, block int, at bigint, n_tokens bigint, ids array<int>")
    out = made.write.option("parquet.block.size", row_group).option("parquet.page.row.count.limit", page_rows).option("compression", "zstd")
    if encoding == "delta":  # version 2 pages without dictionary pack integers as deltas
        out = out.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false")
    elif encoding != "dictionary":
        raise ValueError("encoding is dictionary or delta")
    out.parquet(folder)


def read(spark: SparkSession, folder: str, first=None, last=None, ids: bool = True) -> DataFrame:
    """Rows of the files, as (doc_id, block, at, n_tokens[, ids]); a range of documents reaches the
    scan as row-group and page filters, and without ``ids`` their pages are not read."""
    rows = spark.read.parquet(folder)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows if ids else rows.drop("ids")


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """(block, start): ids before each block; one row per write task."""
    sizes = read(spark, folder, ids=False).groupBy("block").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def _crc(batches):
    for batch in batches:
        lists = batch.column(0)
        values, at = np.asarray(lists.values), np.asarray(lists.offsets)
        sums = [zlib.crc32(values[a:b].astype("<i4", copy=False).tobytes()) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()), *batch.columns[1:]], names=["crc", *batch.schema.names[1:]])
        give_back()


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""
    rows = read(spark, folder)
    kind = dict(rows.dtypes)["doc_id"]
    summed = rows.select("ids", "doc_id", "block", "at", "n_tokens").mapInArrow(_crc, f"crc bigint, doc_id {kind}, block int, at bigint, n_tokens bigint")
    return summed.join(starts(spark, folder), "block").select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32")
    )
