"""SentencePiece encoding that keeps byte offsets, and decoding.

Normalisation walks a text by longest prefix through the model's compiled character map (a
double-array trie of replacements) and notes, for every byte it puts out, the source byte it
comes from.  Piece boundaries in the normalised text are then projected to byte spans of the
original.  Ids are exactly those of the library."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenemark.llm.segments import Cache, pack, slices

#: Bytes of text whose ids and bounds are held at once.
TOGETHER = 4 << 20
MARK = "▁".encode()
BROKEN = "�".encode()


class CharMap:
    """The compiled character map of a model: a little-endian length, the units of a
    double-array trie, and zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes, replacement) of the longest entry that starts at ``at``."""
        if not self.units:
            return None
        units, node, found = self.units, 0, None
        node ^= units[0] >> 10 << ((units[0] & 512) >> 6)
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.texts[value : self.texts.index(0, value)]
        return found


def _utf8(text: bytes, at: int) -> tuple[int, bytes]:
    """(source bytes, output) of one character; a broken byte becomes the replacement mark."""
    first = text[at]
    size = 1 if first < 0x80 else 2 if first >> 5 == 6 else 3 if first >> 4 == 14 else 4 if first >> 3 == 30 else 0
    piece = text[at : at + size]
    try:
        piece.decode()
    except UnicodeDecodeError:
        return 1, BROKEN
    return (size, piece) if size else (1, BROKEN)


class Normaliser:
    """A model's normalisation with alignment: ``(normalised, source)`` where ``source[i]`` is
    the original byte that normalised byte i comes from; one more entry ends the last span."""

    def __init__(self, spec, suffix: bool = False):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix
        self.plain = not self.map.units and not self.squeeze and self.escape and self.prefix and not suffix

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Without map or squeezing only spaces change: all positions at once."""
        if not text:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(text, np.uint8)
        width = np.where(raw == 32, len(MARK), 1)
        source = np.repeat(np.arange(len(raw)), width)
        return MARK + text.replace(b" ", MARK), np.concatenate((np.zeros(len(MARK), np.int64), source, [len(raw)]))

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if self.plain:
            return self._plain(text)
        space = MARK if self.escape else b" "
        steps, at = [], 0
        while at < len(text):
            size, new = self.map.longest(text, at) or _utf8(text, at)
            steps.append((at, new))
            at += size
        start, end = 0, len(steps)
        if self.squeeze:
            while start < end and steps[start][1] == b" ":
                start += 1
            while end > start and steps[end - 1][1].strip(b" ") == b"" and steps[end - 1][1]:
                end -= 1
        if start >= end:
            return b"", np.array([len(text)])
        last = steps[end][0] if end < len(steps) else len(text)
        out, source = bytearray(), []
        put = lambda new, where: (out.extend(new), source.extend([where] * len(new)))
        if self.prefix and not self.suffix:
            put(space, steps[start][0])
        blank = self.squeeze
        for where, new in steps[start:end]:
            if self.squeeze and blank:
                new = new.lstrip(b" ")
            if new:
                put(new.replace(b" ", space), where)
                blank = self.squeeze and new.endswith(b" ")
        while self.squeeze and out.endswith(space):
            del out[-len(space) :]
            del source[-len(space) :]
        if self.prefix and self.suffix:
            put(space, last)
        return bytes(out), np.array([*source, last])


class Pieces:
    """A SentencePiece model: ids, byte spans and decoding."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            blob = f.read()
        model.ParseFromString(blob)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.normalise = Normaliser(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix)
        #: Bytes of normalised text per id: control ids none, byte ids one.
        self.size = np.array([0 if p.type == 3 else 1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces])
        self.unknown = model.trainer_spec.unk_id if not model.trainer_spec.byte_fallback else -1
        names = [p.piece for p in model.pieces]
        inner = any("▁" in n.lstrip("▁") or "\n" in n for n in names)
        self.cuts = self.normalise.plain and model.trainer_spec.model_type == 2 and not inner and not any(p.type == 4 for p in model.pieces)
        self.cache = Cache(self._segment)

    def _segment(self, part: str) -> bytes:
        """Ids of a part with its word mark; a part after a line feed has none."""
        ids = self.sp.encode(part)
        return pack(ids[1:] if part[:1] == "\n" else ids)

    def encode(self, text: str) -> bytes:
        """Ids without begin and end, packed.  Cuts before single spaces and line feeds are
        exact where no piece has a word mark or line feed inside; other texts go whole."""
        clean = self.cuts and text and text[0] not in " \n" and text[-1] != " " and "▁" not in text and "  " not in text and " \n" not in text
        if not clean:
            return pack(self.sp.encode(text))
        return b"".join(map(self.cache.__getitem__, text.replace("\n", " \n").split(" ")))

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Original byte bounds of the pieces: piece i covers [bounds[i], bounds[i + 1])."""
        normal, source = self.normalise(text.encode())
        width = self.size[ids]
        bounds = np.concatenate(([0], np.cumsum(width)))
        if self.unknown >= 0 and (ids == self.unknown).any():
            bounds = self._located(normal, ids)
        if bounds[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        return source[bounds]

    def _located(self, normal: bytes, ids: np.ndarray) -> np.ndarray:
        """Bounds where unknown characters stand for themselves: up to the next known piece."""
        at, bounds = 0, [0]
        names = [self.sp.id_to_piece(int(i)).encode() for i in ids]
        for k, i in enumerate(ids):
            if i != self.unknown:
                at += len(names[k])
            else:
                after = next((names[j] for j in range(k + 1, len(ids)) if ids[j] != self.unknown), None)
                at = normal.index(after, at) if after is not None and k + 1 < len(ids) and ids[k + 1] != self.unknown else len(normal)
            bounds.append(at)
        return np.array(bounds)


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """The model of a worker, read once; the file must be on every executor."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _encode(path: str, bos: int, eos: int):
    def run(batches):
        model = load(path)
        begin, end = pack([bos]), pack([eos])
        for batch in batches:
            done = 0
            for some in slices(batch.column(0), TOGETHER):
                texts = some.to_pylist()
                ids = [np.frombuffer(model.encode(t), "<u4") for t in texts]
                bounds = [model.spans(t, i) for t, i in zip(texts, ids)]
                whole = [begin + i.tobytes() + end for i in ids]
                decoded = [hashlib.sha256(model.sp.decode(np.frombuffer(i, "<u4").tolist()).encode()).hexdigest() for i in whole]
                offsets = np.cumsum([0, *(len(b) // 4 for b in whole)])
                stops = np.cumsum([0, *map(len, bounds)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(whole), "<u4").view(np.int32))),
                        pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.concatenate(bounds).astype(np.int64))),
                        pa.array(decoded, pa.string()),
                        *(c.slice(done, len(texts)) for c in batch.columns[1:]),
                    ],
                    names=["ids", "bounds", "decoded_sha256", *batch.schema.names[1:]],
                )
                done += len(texts)

    return run


def _digest(path: str, bos: int, eos: int):
    """Like ``_encode``, then decoding, with only sizes and digests kept."""

    def run(batches):
        model = load(path)
        begin, end = pack([bos]), pack([eos])
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            rows = {name: [] for name in ("n_tokens", "ids_sha256", "decoded_sha256", "bounds_sha256")}
            for text in batch.column(0).to_pylist():
                text = text or ""
                body = model.encode(text)
                bounds = model.spans(text, np.frombuffer(body, "<u4"))
                ids = begin + body + end
                rows["n_tokens"].append(len(ids) // 4)
                rows["ids_sha256"].append(sha(ids))
                rows["decoded_sha256"].append(sha(model.sp.decode(np.frombuffer(ids, "<u4").tolist()).encode()))
                rows["bounds_sha256"].append(sha(bounds.astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows.values()), *batch.columns[1:]], names=[*rows, *batch.schema.names[1:]])

    return run


def counts(path: str):
    """Batches with the number of ids in place of the text, without begin and end."""

    def run(batches):
        encode = load(path).encode
        for batch in batches:
            n = [len(encode(t or "")) // 4 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), *batch.columns[1:]], names=["n", *batch.schema.names[1:]])

    return run


def _run(docs: DataFrame, key: str, make, path: str, fields: str) -> DataFrame:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = dict(docs.dtypes)[key]
    given = docs.select("text", F.col(key).alias("k"))
    return given.mapInArrow(make(path, sp.bos_id(), sp.eos_id()), f"{fields}, k {kind}").withColumnRenamed("k", key)


def encode(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(ids, bounds, decoded_sha256, ``key``): ids with begin and end, and the byte bounds of the pieces between
    them: piece i covers original bytes [bounds[i], bounds[i + 1]); the digest is that of the text the ids decode to.

    NULL counts as empty and has begin and end only.  Rows are independent, so repeated rows
    and NULL keys pass through; other columns are not read."""
    return _run(docs, key, _encode, path, "ids array<int>, bounds array<bigint>, decoded_sha256 string")


def digests(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(``key``, n_tokens, ids_sha256, decoded_sha256, bounds_sha256) of encoding, projecting and
    decoding every whole text, without keeping the ids.  Rules as in ``encode``."""
    made = _run(docs, key, _digest, path, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, bounds_sha256 string")
    return made.select(key, "n_tokens", "ids_sha256", "decoded_sha256", "bounds_sha256")


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the decoded text of an id column in place of it; NULL stays NULL."""

    def run(batches):
        model = load(path)
        for batch in batches:
            words = [None if i is None else model.sp.decode(i) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *batch.columns[1:]], names=["t", *batch.schema.names[1:]])

    rest = [c for c in encoded.columns if c != ids]
    kinds = dict(encoded.dtypes)
    given = encoded.select(F.col(ids), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    made = given.mapInArrow(run, ", ".join(["t string", *(f"c{i} {kinds[c]}" for i, c in enumerate(rest))]))
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col("t").alias(text))
