"""Encoding of whole texts from cached segments.

A cut before a white-space run is never crossed by a pre-token of a byte-level tokenizer nor by
a merge of a piece vocabulary without inner word marks, so a text's ids are the ids of its
segments in a row.  Segments repeat far more than texts: each distinct one goes through the
tokenizer library once per worker, and a text becomes a join of cached bytes.  Texts that do
not split cleanly take the library's whole-text path."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cached segments per worker and generation; what goes out of use costs time only.
CACHE = 100_000
#: Bytes of text that are encoded together.
TOGETHER = 16 << 20
DOUBLE = re.compile(r"\s\s")


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()


class Cache(dict):
    """Segment -> packed ids, in two generations: a full one becomes the old one, and what is
    still in use comes back from there."""

    def __init__(self, encode, most: int = CACHE):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, segment: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        found = self.old.get(segment)
        if found is None:
            found = self.encode(segment)
        self[segment] = found
        return found


def parts(text: str) -> list[str] | None:
    """``text`` cut before every space and line feed; the space is taken off, the line feed
    stays.  None where white space comes in runs, which need other cuts."""
    if DOUBLE.search(text):
        return None
    return text.replace("\n", " \n").split(" ")


def slices(texts: pa.Array, most: int = TOGETHER) -> list[pa.Array]:
    """``texts`` in slices of about ``most`` bytes; NULL becomes the empty text."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return []
    ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]
