"""Byte-level BPE by corpus-level merge replay.

The distinct words of a block of documents are laid out side by side as bytes. An inverted index leads from the
ranks of token pairs (in spans of SPAN ranks) to the positions where such pairs stand, over all words. The merges are
applied in rank order: span after span, and within a span each word's next merge in rank order, all words at once;
merges of different words don't touch, so this is the order that each word alone would see. A merge updates only its
two neighbours. A word's ids are then laid out wherever it occurs. Blocks are slices of a task's Arrow batches, the known
words are kept up to a fixed number and words are merged some at a time, so memory is bounded and tasks need no shuffle
and no state of each other: a lost executor costs its tasks only.
"""

from __future__ import annotations

import base64
import functools
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm.chunking import Memo, plain, ranges
from mnemos.llm.common import small_batches, text_of

#: Chunks whose ids a task keeps; beyond that only those of the block at hand stay.
KEPT = 400_000
#: Ranks in a span of the index.
SPAN = 1024
#: Bytes of words that are merged together, about.
TOGETHER = 512 << 10
NONE = 1 << 31


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Replay(Memo):
    """Encodes texts by the ranks; ``pattern`` cuts text into words, none of which may span a place where white space begins."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__(KEPT)
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.vocab = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.width = len(self.vocab)
        found = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    found[a * self.width + b] = rank
        self.pairs = np.array(sorted(found), dtype=np.int64)
        self.pair_rank = np.array([found[k] for k in self.pairs.tolist()], dtype=np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's token, NONE where there is none."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another and how many each has; about TOGETHER bytes of words merged at a time in rank order."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        sizes = (whole >= 0).astype(np.int64)
        rest = np.flatnonzero([r < 0 and len(w) > 0 for r, w in zip(whole.tolist(), words, strict=True)])
        parts, low = [], 0
        ends = np.cumsum([len(words[i]) for i in rest.tolist()])
        while low < len(rest):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TOGETHER, "right")))
            flat, own = self._merge([words[i] for i in rest[low:high].tolist()])
            parts.append(flat)
            sizes[rest[low:high]] = own
            low = high
        ids = np.empty(int(sizes.sum()), np.int64)
        merged = np.ones(len(words), bool)
        merged[whole >= 0] = False
        of_merged = np.repeat(merged, sizes)
        ids[~of_merged] = whole[whole >= 0]
        ids[of_merged] = np.concatenate(parts) if parts else []
        return ids, sizes

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        sym = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(sym)
        word = np.repeat(np.arange(len(words)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        now = np.where(after >= 0, self.rank(sym, np.append(sym[1:], 0)), NONE)  # the rank of the pair that begins here
        index: list[list[np.ndarray]] = [[] for _ in range(self.width // SPAN + 1)]

        def note(places: np.ndarray, least: int) -> None:
            """Into the index with pairs of rank ``least`` or more."""
            ranks = now[places]
            places = places[(ranks >= least) & (ranks < NONE)]
            span = now[places] // SPAN
            order = np.argsort(span, kind="stable")
            places, span = places[order], span[order]
            cuts = np.flatnonzero(np.diff(span)) + 1
            for own in np.split(places, cuts) if len(places) else []:
                index[now[own[0]] // SPAN].append(own)

        note(np.arange(n), 0)
        for span, listed in enumerate(index):
            if not listed:
                continue
            top = (span + 1) * SPAN
            here = np.sort(np.concatenate(listed))
            listed.clear()
            here = here[(now[here] < top) & np.append(True, here[1:] != here[:-1])]
            while len(here):
                # each word's next merge: the lowest rank, then the leftmost place
                first = np.flatnonzero(np.append(True, np.diff(word[here]) != 0))
                p = np.minimum.reduceat(now[here] * n + here, first) % n
                r, q = now[p], after[p]
                far, near = after[q], before[p]
                sym[p], sym[q], now[q], after[p] = r, -1, NONE, far
                has = far >= 0
                before[far[has]] = p[has]
                now[p] = NONE
                now[p[has]] = self.rank(r[has], sym[far[has]])
                has = near >= 0
                near = near[has]
                was = now[near]
                now[near] = self.rank(sym[near], r[has])
                note(np.concatenate([p, near]), top)
                here = here[now[here] < top]
                came = near[(was >= top) & (now[near] < top)]
                if len(came):
                    here = np.sort(np.concatenate([here, came]), kind="stable")
        alive = sym >= 0
        return sym[alive], np.add.reduceat(alive.astype(np.int64), ends - sizes)

    def code(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks: letters after a space are one word, the pattern cuts the others; each distinct word is merged once."""
        cut = [[" " + c] if c.isalpha() else self.pattern.findall(plain(c)) for c in new]
        words = pa.array(chain.from_iterable(cut), pa.string()).dictionary_encode()
        which, counts = words.indices.to_numpy(zero_copy_only=False), np.array([len(x) for x in cut], np.int64)
        ids, sizes = self.replay([w.encode() for w in words.dictionary.to_pylist()])
        first, own = (np.cumsum(sizes) - sizes)[which], sizes[which]
        stops = np.concatenate([[0], np.cumsum(own)])[np.cumsum(counts)]
        return ids[ranges(first, own)], np.diff(stops, prepend=0)


@functools.cache
def replay_of(path: str, pattern: str) -> Replay:
    """One for each Python worker."""
    return Replay(read_ranks(path), pattern)


@functools.cache
def vocab_of(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' bytes one after the other, and where each begins."""
    ranks = read_ranks(path)
    vocab = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        vocab[rank] = token
    return np.frombuffer(b"".join(vocab), dtype=np.uint8), np.cumsum([0, *map(len, vocab)])


def _joined(lists: pa.Array, path: str) -> pa.Array:
    """The bytes of each list's ids."""
    data, place = vocab_of(path)
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat, ends, out = lists.flatten().to_numpy(), np.cumsum(sizes), []
    for own, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        parts = []
        for at in range(end - own, end, 1 << 18):
            ids = flat[at : min(end, at + (1 << 18))]
            parts.append(data[ranges(place[ids], place[ids + 1] - place[ids])].tobytes())
        out.append(b"".join(parts))
    return pa.array(out, pa.binary())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the column ``ids`` (array of int): the whole text's token ids, without special tokens.

    With ``decoded`` also that column (binary), the bytes that decode() makes of the ids, from the same Python worker.
    A null or empty text has no ids. Rows, other columns, ties and repeated rows pass unchanged; an empty table gives
    an empty table; columns that already have the names ``ids`` or ``decoded`` are replaced. ``path`` is a .tiktoken
    file of ranks with one for each byte.
    """

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        return replay_of(path, pattern).lists(texts)

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def both(texts: pa.Array) -> pa.Array:
        lists = replay_of(path, pattern).lists(texts)
        return pa.StructArray.from_arrays([lists, _joined(lists, path)], names=["ids", "decoded"])

    small_batches(df.sparkSession)
    if decoded is None:
        return df.withColumn(ids, encoded.asNondeterministic()(text_of(text)))
    held = "__coded"
    while held in df.columns:
        held += "_"
    coded = df.withColumn(held, both.asNondeterministic()(text_of(text)))
    return coded.withColumn(ids, F.col(held)["ids"]).withColumn(decoded, F.col(held)["decoded"]).drop(held)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the column ``decoded`` (binary): the bytes of the ids.

    Null and empty lists give empty bytes; unknown and null ids fail; a column of that name is replaced; rows, ties and
    repeated rows pass unchanged. Long lists are joined some 262,144 ids at a time.
    """

    @F.arrow_udf("binary")
    def joined(lists: pa.Array) -> pa.Array:
        return _joined(lists, path)

    return df.withColumn(decoded, joined.asNondeterministic()(F.col(ids)))


def op7_bpe_merge_replay(spark, sf_dir) -> DataFrame:
    import public_tokenizers
    from mnemos.llm.common import table

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
