"""Texts cut into chunks, each distinct chunk of a block coded once: what the two byte-level BPE operators share.

A cut lies only where white space follows another character. No match of a byte-level BPE pattern spans such a place,
whatever the white space is, so the ids of the chunks one after another are the ids of the text. Splitting,
telling chunks apart and laying out the ids are done by Arrow and numpy over a whole block; Python sees a chunk only
when it is new to the task. What is kept is bounded by a number of chunks, none of them long, so memory doesn't
grow with the input.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stands before a chunk that has no space before it.
FIRST = "\0"
#: A space that doesn't begin a chunk of its own: between white space, or the last character after white space.
ODD = re.compile(r"\s \s|\s \Z")
#: Where a text with odd spaces is cut.
RUN = re.compile(r"(?<=\S)(?=[ \t\n\r])")
#: Chunks of more bytes are coded anew each time.
LONG = 256


def chunks(text: str, special: tuple[str, ...] = ()) -> list[str]:
    """The text cut at its spaces, each of which belongs to the chunk after it; the first chunk has FIRST instead.

    With odd spaces or FIRST itself the text is cut where white space begins, and each chunk
    stands whole after FIRST. A text that holds one of ``special`` is one chunk. An empty one has none.
    """
    if not text:
        return []
    if any(s in text for s in special):
        return [FIRST + text]
    if FIRST in text or ODD.search(text):
        return [FIRST + c for c in RUN.split(text)]
    return (FIRST + text).split(" ")


def plain(chunk: str) -> str:
    """What the chunk stands for in the text."""
    return chunk[1:] if chunk[:1] == FIRST else " " + chunk


def blocks(texts: pa.Array, most: int = 4 << 20):
    """Slices of the array with about ``most`` bytes, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        yield texts.slice(low, high - low)
        low = high


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places from each first on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Memo:
    """Codes blocks of texts by a function from new chunks to (ids of all, number of each), which a subclass gives as ``code``.

    The known chunks are an Arrow array, their ids lie one after the other in another. Beyond ``kept`` chunks, those of
    the block at hand stay and about half as many as are kept, which came in most blocks; chunks of over LONG bytes never do.
    """

    special: tuple[str, ...] = ()

    def __init__(self, kept: int):
        self.kept = kept
        self.known = pa.array([], pa.string())
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.came = np.zeros(0, np.int64)  # the blocks that each chunk came in

    def code(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _only(self, stay: np.ndarray) -> None:
        """Forgets the chunks at all other places."""
        self.flat = self.flat[ranges((np.cumsum(self.sizes) - self.sizes)[stay], self.sizes[stay])]
        self.known, self.sizes, self.came = self.known.take(pa.array(stay)), self.sizes[stay], self.came[stay]

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The block's distinct chunks, which of them stand where, and how many each text has."""
        listed = texts.to_pylist()
        odd = any(FIRST in t or ODD.search(t) or any(s in t for s in self.special) for t in listed)
        if odd:
            cut = [chunks(t, self.special) for t in listed]
            counts, flat = np.array([len(x) for x in cut], np.int64), pa.array(chain.from_iterable(cut), pa.string())
        else:
            del listed
            filled = pc.greater(pc.binary_length(texts), 0)
            split = pc.split_pattern(pc.binary_join_element_wise(FIRST, texts.filter(filled), ""), " ")
            counts = np.zeros(len(texts), np.int64)
            counts[filled.to_numpy(zero_copy_only=False)] = split.value_lengths().to_numpy(zero_copy_only=False)
            flat = split.flatten()
        coded = flat.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), counts

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        distinct, which, counts = self._cut(texts)
        place = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        old = place[place >= 0]
        self.came[old] += 1
        if len(self.known) + np.count_nonzero(place < 0) > self.kept:
            least = 2
            while np.count_nonzero(self.came >= least) > self.kept // 2:
                least += 1
            stays = self.came >= least
            stays[old] = True
            moved = np.cumsum(stays) - 1
            self._only(np.flatnonzero(stays))
            place[place >= 0] = moved[old]
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = np.arange(len(self.known), len(self.known) + len(new))
            found = distinct.take(pa.array(new))
            ids, sizes = self.code(found.to_pylist())
            self.known, self.came = pa.concat_arrays([self.known, found]), np.concatenate([self.came, np.ones(len(new), np.int64)])
            self.flat, self.sizes = np.concatenate([self.flat, ids.astype(np.int32)]), np.concatenate([self.sizes, sizes.astype(np.int64)])
        size, start = self.sizes[place][which], (np.cumsum(self.sizes) - self.sizes)[place][which]
        ids = self.flat[ranges(start, size)]
        stops = np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)]
        short = pc.binary_length(self.known).to_numpy(zero_copy_only=False) <= LONG
        if not short.all():
            self._only(np.flatnonzero(short))
        return ids, np.diff(stops, prepend=0)

    def lists(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """Arrow lists of the ids of each text, null texts as empty ones, ``end`` after each."""
        out = []
        for block in blocks(pc.fill_null(texts, "")):
            ids, sizes = self.encode_block(block)
            if end is not None:
                ids, sizes = np.insert(ids, np.cumsum(sizes), np.int32(end)), sizes + 1
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids, pa.int32())))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        if not texts:
            return []
        ids, sizes = self.encode_block(pa.array(texts, pa.string()))
        data, cuts = ids.astype("<i4").tobytes(), (4 * np.concatenate([[0], np.cumsum(sizes)])).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]
