"""Exact removal of long repeated byte strings, by a column-wise construction over a collection of strings.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Every start position with LENGTH bytes ahead of it is
assigned to its anchor, the least of the GRAM-byte hashes in those LENGTH bytes (leftmost of equals): equal strings have equal anchors at
equal distances. Consecutive starts with one anchor are a span.

1. Grams that anchor one span only are done: nothing else can equal their strings.
2. Spans are compared as wholes by digest: equal spans at two places repeat at all their starts.
3. The distinct spans that are left in a gram's group, bytes aligned at the anchor, go through a column-wise construction: from the last
   column to the first each round inserts one symbol in front of every string, and updates the collection's order (a stable sort
   by the new symbol: its column is that round's part of the Burrows-Wheeler transform) and the common prefix lengths of neighbours (one more
   than the least length between them in the old order, 0 for different symbols). A start is repeated if its neighbour before or after shares
   LENGTH symbols or more. Strings are aligned, so a round costs as much as there are strings, not as there are suffixes.

Inserting one byte of every whole document per round, over as many rounds as the longest document has bytes, would rewrite the transform
hundreds of thousands of times; spans are at most 2 * LENGTH - GRAM bytes, which bounds the rounds. The columns of a task are held in
memory, not in external files, as a task's strings are bounded: a group of more than `hot` spans goes another exact way, by
digest of each of its strings of LENGTH bytes, which spreads one group over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrays import prefix_hash, range_hash, utf8
from larkspur.llm.columns import boxed, mapped
from larkspur.llm.store import cut, drop

LENGTH, GRAM = 400, 64
SEGMENT = 1 << 20
HOT = 50_000
#: Bytes of spans that a task of the column-wise construction gets, about.
TASK_BYTES = 12 << 20


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values, by running minima of blocks from both ends."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, 1).reshape(-1)
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def spans(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The spans of all texts: text number, gram hash, anchor, first start and last start, as places in data."""
    none = tuple(np.zeros(0, np.uint64 if k == 1 else np.int64) for k in range(5))
    if len(data) < length:
        return none
    rows = np.diff(bounds)
    ends = np.repeat(bounds[1:], rows)
    at = np.arange(len(data) - gram + 1)
    hashes = range_hash(prefix_hash(data), at, at + gram)
    # Fixed, so that equal strings have equal anchors wherever they stand: place bits for twice a segment and more.
    bits = np.uint64(SEGMENT.bit_length() + 1)
    least = sliding_least((hashes >> bits << bits) | at.astype(np.uint64), length - gram + 1)
    starts = np.flatnonzero(np.arange(len(least)) + length <= ends[: len(least)])
    if not len(starts):
        return none
    anchor = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    anchor, first, last = anchor[first], starts[first], starts[last]
    return np.searchsorted(bounds, first, "right") - 1, hashes[anchor], anchor, first, last


def segments(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes and bounds of about SEGMENT bytes of texts, with each text's row and where in the row it begins; long texts come in overlapping pieces."""
    data, bounds = utf8(batch.column(batch.schema.get_field_index("text")))
    rows, starts, ends = [], [], []
    size = 0
    for i in range(batch.num_rows):
        for a in range(int(bounds[i]), max(int(bounds[i]) + 1, int(bounds[i + 1]) - length + 1), SEGMENT):
            b = min(int(bounds[i + 1]), a + SEGMENT + length - 1)
            if b - a < length:
                continue
            rows.append(i)
            starts.append(a)
            ends.append(b)
            size += b - a
            if size >= SEGMENT:
                yield joined(data, bounds, rows, starts, ends)
                rows, starts, ends, size = [], [], [], 0
    if rows:
        yield joined(data, bounds, rows, starts, ends)


def joined(data, bounds, rows, starts, ends):
    parts = [data[a:b] for a, b in zip(starts, ends, strict=True)]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.array(rows), np.array(starts) - bounds[np.array(rows)]


def identity(text: Column) -> Column:
    """128 bits of a text's digest: all results depend on the text alone, so it stands for every row with that text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def grams(texts: DataFrame, length: int, gram: int, whole: bool) -> DataFrame:
    """The spans of each text, one task's repeated texts once: the gram and a hash of the place, and if whole also all else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for full in batches:
            for k in range(0, full.num_rows, 512):
                part = full.slice(k, 512)
                own = part.column(part.schema.get_field_index("cls"))
                fresh = []
                for i, c in enumerate(own.to_pylist()):
                    if c not in seen:
                        seen.add(c)
                        fresh.append(i)
                if len(seen) > 500_000:
                    seen.clear()
                batch = part.take(pa.array(fresh, pa.int64()))
                own = batch.column(batch.schema.get_field_index("cls")).to_pylist()
                keys = np.array([int.from_bytes(c[:8], "little") for c in own], np.uint64)
                for data, bounds, rows, offset in segments(batch, length):
                    text, g, anchor, first, last = spans(data, bounds, length, gram)
                    shift = offset[text] - bounds[text]
                    pid = signed((keys[rows[text]] ^ ((anchor + shift).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) + (first + shift).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                    columns = [pa.array(signed(g)), pa.array(pid)]
                    if whole:
                        raw = data.tobytes()
                        digest = [hashlib.blake2b(raw[a : b + length], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                        columns += [pa.array(digest, pa.binary()), pa.array([own[i] for i in rows[text].tolist()], pa.binary()), pa.array(anchor + shift), pa.array(first + shift), pa.array(last + shift)]
                    yield pa.RecordBatch.from_arrays(columns, names=["g", "pid", "s", "cls", "a", "p0", "p1"][: len(columns)])

    return texts.mapInArrow(run, "g bigint, pid bigint" + ", s binary, cls binary, a bigint, p0 bigint, p1 bigint" * whole)


def repeated(strings: list[bytes], left: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each string and each distance to its anchor (0 to length - gram) whether the `length` bytes that begin there are also in another of the strings.

    left: each string's anchor. Strings are aligned at it; a string whose bytes end earlier shares nothing beyond.
    """
    m, reach = len(strings), length - gram
    columns = reach + length
    table, size = np.full((columns, m), 256, np.uint16), np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    owner = np.repeat(np.arange(m), size)
    table[np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(reach - left, size), owner] = data
    out = np.zeros((m, reach + 1), bool)
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    for c in range(columns - 1, -1, -1):
        symbol = table[c, order]
        step = np.argsort(symbol, kind="stable")
        symbol, fresh = symbol[step], np.zeros(m + 1, np.int32)
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] < 256)) + 1
        p, q = step[same - 1], step[same]
        least = common[q]
        far = np.flatnonzero(q > p + 1)
        if len(far):
            # Of the old neighbours from p + 1 to q; every second result is that of a gap and unused.
            least[far] = np.minimum.reduceat(common, np.stack([p[far] + 1, q[far] + 1], 1).reshape(-1))[::2]
        fresh[same] = np.minimum(least, length) + 1
        order, common = order[step], fresh
        if c <= reach:
            out[order, reach - c] = (common[:-1] >= length) | (common[1:] >= length)
    return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def repeated_starts(docs: DataFrame, length: int, gram: int, hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (cls, s, e): the strings that begin at s to e in the text cls also start elsewhere. And the tables that they're made from."""
    spark = docs.sparkSession
    texts = docs.select(identity(F.col("text")).alias("cls"), "text").filter(F.octet_length("text") >= length)
    # Written, so that the join has plain exchanges, and a gram that very many texts share can be split.
    shared = cut(grams(texts, length, gram, False).groupBy("g").agg(F.min("pid").alias("x"), F.max("pid").alias("y")).filter("x < y").select("g"))
    found = cut(grams(texts, length, gram, True).join(shared, "g").distinct())
    distinct = found.groupBy("s").agg(F.min("pid").alias("pid"), (F.max("pid") > F.min("pid")).alias("again"), F.min("g").alias("g"))
    # Groups with a span that isn't settled and another one to compare it with.
    groups = distinct.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.when(F.col("again"), 0).otherwise(1)).alias("open")).filter("n > 1 and open > 0").select("g", "n")
    marked = cut(distinct.join(groups, "g", "left").filter("again or n is not null").select("s", F.col("pid").alias("first"), "again", "n"))
    placed = found.join(marked, "s")
    whole = placed.filter("again").select("cls", F.col("p0").alias("s"), F.col("p1").alias("e"))

    # The bytes of one span of each kind.
    chosen = placed.filter("n is not null and pid = first")
    wanted = cut(chosen.groupBy("cls").agg(F.collect_list(F.struct("g", "a", "p0", "p1", "again", (F.col("n") > hot).alias("hot"))).alias("want")))
    once = texts.join(wanted, "cls").select("cls", "text", "want")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "cls", "a", "p0", "again", "hot", "b"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
        seen: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["cls"] in seen:
                    continue
                seen.add(row["cls"])
                raw = row["text"].encode()
                out += [(w["g"], row["cls"], w["a"], w["p0"], w["again"], w["hot"], raw[w["p0"] : w["p1"] + length]) for w in row["want"]]
                if len(out) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            if len(seen) > 500_000:
                seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    strings = cut(once.mapInArrow(cut_out, "g bigint, cls binary, a bigint, p0 bigint, again boolean, hot boolean, b binary").dropDuplicates(["g", "cls", "p0"]))
    total = strings.filter("not hot").agg(F.sum(F.octet_length("b"))).collect()[0][0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // TASK_BYTES) + 1)

    def construct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        cls, a, p0, again, b = (table.column(k).to_pylist() for k in ("cls", "a", "p0", "again", "b"))
        flags = repeated(b, np.array(a) - np.array(p0), length, gram)
        rows: list[tuple] = []
        for i in range(len(b)):
            if not again[i]:
                rows += [(cls[i], a[i] - int(y), a[i] - int(x)) for x, y in zip(*runs(flags[i]), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["cls", "s", "e"])

    constructed = strings.filter("not hot").repartition(parts, "g").mapInArrow(construct, "cls binary, s bigint, e bigint")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                digests, cls, places = [], [], []
                for row in batch.slice(k, 256).to_pylist():
                    n = len(row["b"]) - length + 1
                    digests += [hashlib.blake2b(row["b"][i : i + length], digest_size=16).digest() for i in range(n)]
                    cls += [row["cls"]] * n
                    places += range(row["p0"], row["p0"] + n)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(cls, pa.binary()), pa.array(places, pa.int64())], names=["d", "cls", "p"])

    single = strings.filter("hot").mapInArrow(each, "d binary, cls binary, p bigint")
    place = F.xxhash64("cls", "p")
    twice = single.groupBy("d").agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x < y").select("d")
    hot_rows = single.join(twice, "d").select("cls", F.col("p").alias("s"), F.col("p").alias("e"))
    # Rows with equal texts are one text above; all their strings are repeated.
    sizes = texts.groupBy("cls").agg(F.count("*").alias("rows"), F.max(F.octet_length("text")).cast("bigint").alias("size"))
    copies = sizes.filter("rows > 1").select("cls", F.lit(0).cast("bigint").alias("s"), (F.col("size") - length).alias("e"))
    return whole.unionByName(constructed).unionByName(hot_rows).unionByName(copies), [shared, found, marked, wanted, strings]


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, kept: bool = False) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, kept_sha256, n_kept_chars (characters that begin in what is left), repeats (whether anything
    was removed) and, with kept=True, the kept bytes to each row.

    Null text is empty; texts shorter than `length` keep all. Rows with equal texts repeat each other and, from `length` bytes on, keep nothing.
    Ids aren't looked at, so null and repeated ones change nothing. An empty table gives no rows. Columns that bear one of the new
    names, in any case, are replaced, and others stay whatever their names. Kept bytes may be cut inside a character.
    """
    added = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string", "n_kept_chars": "bigint", "repeats": "boolean"} | ({"kept": "binary"} if kept else {})
    starts, scratch = repeated_starts(docs, length, gram, hot)
    # One row per text; written, so that the join below has plain exchanges and can split a text with very many rows.
    found = starts.groupBy("cls").agg(F.collect_set(F.struct("s", "e")).alias("found"))
    lists = cut(found.select(F.col("cls").alias("c"), F.transform("found", lambda x: x["s"]).alias("s"), F.transform("found", lambda x: x["e"]).alias("e")))
    drop(*scratch)
    source = boxed(docs, added, F.col("text").alias("text"), identity(F.col("text")).alias("k"))
    source = source.join(lists, F.col("k") == F.col("c"), "left").select("row", "text", "s", "e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for k in range(0, full.num_rows, 512):
                batch = full.slice(k, 512)
                text, first, last = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "s", "e"))
                rows = []
                for t, s, e in zip(text, first, last, strict=True):
                    raw = (t.as_py() or "").encode()
                    if s.is_valid:
                        edge = np.zeros(len(raw) + 1, np.int32)
                        np.add.at(edge, s.values.to_numpy(), 1)
                        np.add.at(edge, e.values.to_numpy() + length, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                        n = len(runs(gone)[0])
                    else:
                        left, n = raw, 0
                    rows.append((len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest(), int(((np.frombuffer(left, np.uint8) & 0xC0) != 0x80).sum()), len(left) < len(raw), left)[: len(added)])
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
                yield batch, [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(added))]

    return mapped(source, docs, added, run)
