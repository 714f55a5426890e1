"""Encoding of a corpus with a public byte-level BPE vocabulary.

Two tiers: a minimal perfect hash resolves every pre-token that is itself in the vocabulary, all distinct pre-tokens of a
batch at once; the others are merged by a heap over linked bytes, each distinct one once. Cutting into pre-tokens,
hashing and assembling run on whole batches of bytes, not on Python strings. Each row is encoded where it is read, so the
operator has no shuffle; the vocabulary, of fixed size, is sent to the executors once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loadstone.llm import spans

TOKENIZERS = "/opt/tokenizers"
#: Distinct merged pre-tokens that a worker remembers, and the longest of them in bytes.
REMEMBERED, REMEMBERED_BYTES = 300_000, 256

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3

# The code points of Unicode white space, and the letters that follow an apostrophe as a token of their own.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = SPACE
    return table


def pretoken_starts(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The positions at which a pre-token begins, in the code points of several texts; `rows` has the texts' offsets.

    A token is a run of letters, of numbers or of others, with one blank before it if there is one; contractions at the
    beginning of a run stand alone; of white space before a run, the last character is left for it.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[rows] = True
    first = first[:n]
    last = np.append(first[1:], True)
    before = np.concatenate([[9], kind[:-1]]).astype(np.uint8)
    before[first] = 9
    after_blank = np.concatenate([[False], points[:-1] == 32]) & ~first
    space = kind == SPACE
    space_next = np.append(space[1:], False)
    start = np.where(space, (before != SPACE) | (~space_next & ~last), (before != kind) & ~after_blank) | first
    marks = np.flatnonzero((points == 39) & start & ~last)
    if len(marks):
        for tail in CONTRACTIONS:
            at = marks[marks + len(tail) < n]
            for k, c in enumerate(tail, 1):
                at = at[(points[at + k] == ord(c)) & ~first[at + k]]
            for k in range(1, len(tail) + 1):
                start[at + k] = False
            end = at + len(tail) + 1
            end = end[end < n]
            start[end[(kind[end] == LETTER) & ~first[end]]] = True
    return np.flatnonzero(start)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit hashes by displacement: as many slots as keys.

    Buckets of several keys, largest first, look for a displacement that sends all of them to free slots; buckets of one
    key are given a free slot directly (stored as a negative displacement).
    """

    def __init__(self, hashes: np.ndarray, per_bucket: int = 4) -> None:
        n = len(hashes)
        self.n, self.m = n, max(1, n // per_bucket)
        bucket = (hashes % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        firsts = np.searchsorted(bucket[order], np.arange(self.m + 1))
        sizes = np.diff(firsts)
        self.displacement = np.zeros(self.m, np.int64)
        taken = np.zeros(n, bool)
        self.slots = np.zeros(n, np.int64)  # key at each slot
        for b in np.argsort(-sizes, kind="stable"):
            keys = order[firsts[b] : firsts[b + 1]]
            if len(keys) < 2:
                break
            d = 1
            while True:
                tries = np.arange(d, d + 64, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    at = (spans.mix(hashes[keys][None, :] + tries[:, None] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)
                ok = ~taken[at].any(axis=1)
                for i in np.flatnonzero(ok):
                    if len(set(at[i].tolist())) == len(keys):
                        break
                else:
                    d += 64
                    continue
                break
            self.displacement[b] = d + i
            taken[at[i]] = True
            self.slots[at[i]] = keys
        free = iter(np.flatnonzero(~taken))
        for b in np.flatnonzero(sizes == 1):
            slot = next(free)
            self.displacement[b] = -slot - 1
            self.slots[slot] = order[firsts[b]]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The index of the only key that each hash may belong to."""
        d = self.displacement[(hashes % np.uint64(self.m)).astype(np.int64)]
        with np.errstate(over="ignore"):
            at = (spans.mix(hashes + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)
        return self.slots[np.where(d < 0, -d - 1, at)]


class Vocabulary:
    """A vocabulary of byte strings and ids, compiled for both tiers."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        words = list(ranks)
        self.ids = np.fromiter(ranks.values(), np.int32, len(words))
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.lengths)
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.key = hashlib.md5(self.data.tobytes() + self.lengths.tobytes() + self.ids.tobytes()).hexdigest()
        self.hash = PerfectHash(spans.span_hashes(self.data, self.ends - self.lengths, self.ends))

    @staticmethod
    def load(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Vocabulary:
        """Read the rank file `name`.tiktoken: a base64 string and an id on each line."""
        lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)})

    def ranks(self) -> dict[bytes, int]:
        raw = self.data.tobytes()
        return {raw[e - n : e]: i for e, n, i in zip(self.ends.tolist(), self.lengths.tolist(), self.ids.tolist(), strict=True)}


class Encoder:
    """Encodes batches of texts; one per worker and vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.ranks = vocabulary, vocabulary.ranks()
        self.known: dict[bytes, list[int]] = {}

    def merged(self, word: bytes) -> list[int]:
        """The ids of a pre-token that isn't in the vocabulary: lowest rank first, leftmost of equals."""
        if (found := self.known.get(word)) is not None:
            return found
        ranks, n = self.ranks, len(word)
        get, push, pop = ranks.get, heapq.heappush, heapq.heappop
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry: rank, start and end of the merged piece, in one integer that a machine word holds for usual lengths
        bits = 20 if n < 1 << 20 else 48
        low = (1 << bits) - 1
        heap = [(((r << bits) | i) << bits) | (i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            end, i = entry & low, (entry >> bits) & low
            j = following[i]
            if j < 0 or j >= n or following[j] != end:
                continue
            following[i], following[j] = end, -1
            if end < n:
                previous[end] = i
                if (r := get(word[i : (k := following[end])])) is not None:
                    push(heap, (((r << bits) | i) << bits) | k)
            if (p := previous[i]) >= 0 and (r := get(word[p:end])) is not None:
                push(heap, (((r << bits) | p) << bits) | end)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[word[i : (k := following[i])]])
            i = k
        if n <= REMEMBERED_BYTES:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of several texts, given as UTF-8 bytes with row offsets: all ids, and the number of each text."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        import pandas as pd  # on workers only

        points, at_byte, row_points = spans.code_points(data, offsets)
        first = pretoken_starts(points, row_points)
        starts = at_byte[first]
        ends = np.append(starts[1:], len(data))
        lengths = ends - starts
        hashes = spans.span_hashes(data, starts, ends)
        codes, unique = pd.factorize(hashes)
        example = np.empty(len(unique), np.int64)
        example[codes[::-1]] = np.arange(len(codes))[::-1]
        if (lengths != lengths[example][codes]).any() or not spans.same_spans(data, starts, data, starts[example][codes], lengths).all():
            raw = data.tobytes()  # two contents share a hash: tell them apart by the contents themselves
            codes, _ = pd.factorize(np.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], object))
            example = np.empty(codes.max() + 1, np.int64)
            example[codes[::-1]] = np.arange(len(codes))[::-1]
            unique = hashes[example]
        v, s, n = self.vocabulary, starts[example], lengths[example]
        key = v.hash.find(unique)
        hit = v.lengths[key] == n
        hit[hit] = spans.same_spans(data, s[hit], v.data, (v.ends - v.lengths)[key[hit]], n[hit])
        counts = np.ones(len(s), np.int64)
        missing = np.flatnonzero(~hit)
        raw = data.tobytes() if len(missing) else b""
        merged = [self.merged(raw[a : a + k]) for a, k in zip(s[missing].tolist(), n[missing].tolist(), strict=True)]
        counts[missing] = [len(x) for x in merged]
        begin = np.cumsum(counts) - counts
        pool = np.empty(int(counts.sum()), np.int32)
        pool[begin[hit]] = v.ids[key[hit]]
        if merged:
            pool[spans.ranges(begin[missing], counts[missing])] = np.fromiter(chain.from_iterable(merged), np.int32)
        per_token = counts[codes]
        ids = pool[spans.ranges(begin[codes], per_token)]
        upto = np.concatenate([[0], np.cumsum(per_token)])
        edges = upto[np.searchsorted(starts, offsets)]
        return ids, np.diff(edges)


_encoders: dict[str, Encoder] = {}


def worker_encoder(key: str, shared) -> Encoder:  # noqa: ANN001
    """The worker's encoder for a broadcast vocabulary, made once; `key` is the vocabulary's."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


@lru_cache(1)
def _default() -> Vocabulary:
    """The default vocabulary with its hash, built once a process."""
    return Vocabulary.load()


def share(df: DataFrame, vocabulary: Vocabulary | None = None) -> Callable[[], Encoder]:
    """Send a vocabulary to the executors; its size is that of the public file, whatever the corpus."""
    vocabulary = vocabulary or _default()
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    return partial(worker_encoder, vocabulary.key, shared)


def _over_texts(df: DataFrame, text: str, column: T.StructField, make) -> DataFrame:  # noqa: ANN001
    kept = [f for f in df.schema.fields if f.name != text]
    if any(f.name == column.name for f in kept):
        raise ValueError(f"the input already has a column {column.name}")
    schema = T.StructType([*kept, column])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.names.index(text)
            rest = [i for i in range(batch.num_columns) if i != place]
            for a, b, data, offsets in spans.slices(batch.column(place)):
                columns = [batch.column(i).slice(a, b - a) for i in rest]
                yield pa.RecordBatch.from_arrays([*columns, make(data, offsets)], names=schema.names)

    return df.mapInArrow(run, schema)


def encode_texts(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: Vocabulary | None = None) -> DataFrame:
    """Replace the column `text` by `ids`, its list of token ids without special tokens; other columns stay.

    Strings of special tokens in a text are ordinary text. An empty or null text gives an empty list. Repeated rows stay
    repeated; an empty table gives no rows; a text of any length is encoded whole. A column named as `ids` raises
    ValueError.
    """
    encoder = share(df, vocabulary)

    def make(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
        values, counts = encoder().encode(data, offsets)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))

    return _over_texts(df, text, T.StructField(ids, T.ArrayType(T.IntegerType())), make)


def count_tokens(df: DataFrame, text: str = "text", count: str = "n_tokens", vocabulary: Vocabulary | None = None) -> DataFrame:
    """Replace the column `text` by `count`, its number of tokens (0 for an empty or null text)."""
    encoder = share(df, vocabulary)

    def make(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
        return pa.array(encoder().encode(data, offsets)[1])

    return _over_texts(df, text, T.StructField(count, T.LongType()), make)
