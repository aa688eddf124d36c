"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash (hash and displace, one key in every slot) resolves a whole pre-token that is a
vocabulary entry. Tier two: the other pre-tokens are merged by rank with a heap over a linked list of bytes.

The vocabulary is a bounded table (one row per rank of the given file), read on the driver and broadcast; no row of
the corpus leaves its partition, so the operator has no shuffle at all and an executor that is lost costs only its tasks.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrays import mix, prefix_hash, range_hash
from larkspur.llm.columns import boxed, mapped, quoted

#: Entries of a worker's memo of pre-tokens. A full one is set aside, and what is met again comes over from it: this costs time and changes nothing else.
MEMO = 250_000
#: Bytes of text whose new pre-tokens are looked up at once.
TOGETHER = 1 << 18


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file in order of their ranks, which must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(b): base64.b64decode(a) for a, b in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks aren't 0 to {len(ranks) - 1}")
    return [ranks[i] for i in range(len(ranks))]


def flat(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All items' bytes after each other, and their bounds."""
    return np.frombuffer(b"".join(items), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in items], dtype=np.int64)])


def hashes(items: list[bytes]) -> np.ndarray:
    data, bounds = flat(items)
    return range_hash(prefix_hash(data), bounds[:-1], bounds[1:])
#: Characters of a pre-token past which it isn't remembered.
LONGEST = 64


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: each key's bucket has a seed that sends all its keys to free slots."""

    def __init__(self, keys: list[bytes], per_bucket: int = 3):
        n, h = len(keys), hashes(keys)
        if len(set(h.tolist())) < n:
            raise ValueError("two keys have the same 64-bit hash")
        self.n, self.buckets = n, n // per_bucket + 1
        self.seeds, self.slot_key = np.zeros(self.buckets, np.uint64), np.zeros(n, np.int64)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        first = np.concatenate([[0], np.cumsum(size)])
        free = np.ones(n, bool)
        trials = np.arange(64, dtype=np.uint64)
        for b in np.argsort(-size, kind="stable").tolist():
            if not size[b]:
                break
            own = order[first[b] : first[b + 1]]
            base = np.uint64(0)
            while True:
                at = self.slots(h[own][None, :], (base + trials)[:, None])
                good = free[at].all(1)
                for t in np.flatnonzero(good).tolist():
                    if len(set(at[t].tolist())) == len(own):
                        self.seeds[b] = base + np.uint64(t)
                        free[at[t]] = False
                        self.slot_key[at[t]] = own
                        break
                else:
                    base += np.uint64(64)
                    continue
                break
        data, self.bounds = flat(keys)
        self.raw, self.check = data.tobytes(), h[self.slot_key]

    def slots(self, h: np.ndarray, seed: np.ndarray) -> np.ndarray:
        return (mix(h + seed * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def find(self, items: list[bytes]) -> np.ndarray:
        """Each item's key number, or -1; the bytes are compared, so a hash alone never decides."""
        if not items or not self.n:
            return np.full(len(items), -1, np.int64)
        h = hashes(items)
        slot = self.slots(h, self.seeds[(h % np.uint64(self.buckets)).astype(np.int64)])
        key = np.where(self.check[slot] == h, self.slot_key[slot], -1)
        raw, at = self.raw, self.bounds
        for i in np.flatnonzero(key >= 0).tolist():
            if raw[at[key[i]] : at[key[i] + 1]] != items[i]:
                key[i] = -1
        return key


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: the pair of the lowest rank (leftmost among equals) is merged until none is left.

    A part begins at i and ends where the next one begins, at end[i], which is 0 once the part has gone into another. A heap entry
    is a rank, where the pair begins and where it ends; it is stale if no two parts have those bounds any more.
    """
    n = len(piece)
    end, before, find = list(range(1, n + 1)), list(range(-1, n - 1)), ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := find(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != e:
            continue
        end[i], end[j] = e, 0
        if e < n:
            before[e] = i
            if (r := find(piece[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if i and (r := find(piece[before[i] : e])) is not None:
            heapq.heappush(heap, (r, before[i], e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder for one vocabulary and pre-token pattern."""

    def __init__(self, vocabulary: list[bytes], pattern: str, memo: int = MEMO, index: PerfectHash | None = None):
        self.vocabulary, self.pattern, self.limit = vocabulary, regex.compile(pattern), memo
        self.index = index or PerfectHash(vocabulary)
        self.ranks = {x: i for i, x in enumerate(vocabulary)}
        self.data, self.bounds = flat(vocabulary)
        self.memo: dict[str, str] = {}
        self.aside: dict[str, str] = {}

    def resolve(self, tokens: Iterable[str]) -> None:
        """Puts the ids of pre-tokens that the memo lacks into it."""
        new = []
        for t in tokens:
            if t not in self.memo:
                known = self.aside.get(t)
                if known is None:
                    new.append(t)
                else:
                    self.memo[t] = known
        raw = [t.encode() for t in new]
        for t, piece, key in zip(new, raw, self.index.find(raw).tolist(), strict=True):
            self.memo[t] = str(key) if key >= 0 else " ".join(map(str, merge(piece, self.ranks)))

    def encode_texts(self, texts: list[str]) -> list[str]:
        """The decimal ids of each text, joined by spaces."""
        tokens = [self.pattern.findall(t) for t in texts]
        distinct = set().union(*tokens)
        if len(self.memo) + len(distinct) > self.limit:
            self.memo, self.aside = {}, self.memo
        self.resolve(distinct)
        out = [" ".join(map(self.memo.__getitem__, t)) for t in tokens]
        for t in distinct:
            # Long ones hardly come again, and would fill the memory that a number of entries is to bound.
            if len(t) > LONGEST:
                del self.memo[t]
        return out

    def encode_text(self, text: str) -> str:
        return self.encode_texts([text])[0]

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_text(text).split()]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, gathered from the flat vocabulary in pieces of bounded size."""
        out = []
        for i in range(0, len(ids), 1 << 18):
            part = ids[i : i + (1 << 18)]
            start, length = self.bounds[part], self.bounds[part + 1] - self.bounds[part]
            end = np.cumsum(length)
            out.append(self.data[np.arange(end[-1]) + np.repeat(start - end + length, length)].tobytes())
        return b"".join(out)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 (and the ids themselves, with ids=True) to each row.

    Null text is empty: no tokens, the digests of nothing. Rows are independent, so repeated rows and ids, and null in any
    other column, change nothing; columns of the input that bear one of the new names, in any case, are replaced, and others stay whatever their names.
    """
    vocabulary = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, pattern, PerfectHash(vocabulary)))
    added = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if ids else {})
    source = boxed(docs, added, F.col(quoted(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        words, split, index = shared.value
        codec = Codec(words, split, index=index)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
            i = 0
            while i < batch.num_rows:
                # Rows of about TOGETHER bytes of text, one at least.
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + TOGETHER, "right")))
                part, i = batch.slice(i, j - i), j
                n, coded, plain, lists = [], [], [], []
                for joined in codec.encode_texts([x or "" for x in part.column(at).to_pylist()]):
                    numbers = np.fromstring(joined, np.int64, sep=" ") if joined else np.zeros(0, np.int64)
                    n.append(len(numbers))
                    coded.append(hashlib.sha256(joined.encode()).hexdigest())
                    plain.append(hashlib.sha256(codec.decode(numbers) if len(numbers) else b"").hexdigest())
                    if ids:
                        lists.append(numbers.astype(np.int32))
                columns = [pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())]
                if ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                yield part, columns

    return mapped(source, docs, added, run)
