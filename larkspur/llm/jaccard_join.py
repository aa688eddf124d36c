"""N-gram Jaccard join by chosen paths.

A document's set is that of its word shingles. In each run every set picks, by a hash of the run and the token, its tokens under a
bound of CHILDREN / (similarity * size): a pair at the similarity has CHILDREN picks in common on average. The sets that picked a token form a
bucket. Buckets of up to SMALL sets are compared by brute force; sets of larger ones pick again, by a hash of the path so far, and so on to
DEPTH. A bucket of sets that pick alike (those of one large group of near copies) stays whole, since it wouldn't come apart. RUNS repeats make the chance to miss a pair at the similarity less than 1 - recall (`runs_for`).

Equal sets are one class from the start, with a weight. In a bucket, sketches drop pairs that are far from similar, and a pair counts only in
the least bucket the two have in common, so that it is counted once although no pair is ever listed: a task gives each set's number of links
and a spanning forest. The exact sets are then compared (an intersection of hashed shingles of 48 bits). Buckets that stay large are cut into
tiles, whose pairs are dealt to different tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrays import chunks, mix, shingles, word_hashes
from larkspur.llm.graph import Forest, by_group, components, grouped, spread, tiled
from larkspur.llm.store import cut, drop

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
CHILDREN, DEPTH, SMALL, TILE = 1.5, 4, 2048, 2048
BITS = np.uint64(48)
#: Bins of a sketch; the number of filled ones from which it is asked at all; standard deviations that a pair at the similarity may fall short of it.
SKETCH, SKETCH_FROM, SKETCH_SLACK = 64, 48, 6.0
#: Tokens that a split handles at once, and rows of a batch that it gives.
SPLIT_TOKENS, OUT_ROWS = 1 << 20, 1 << 14
#: Prefixes of digests that a broadcast table may hold, one long each: a proven bound, whatever the number of documents.
PREFIXES = 1 << 19
#: A bucket stays whole if this share of its sets' picks leads to buckets of half its size or more.
ALIKE = 0.6


def runs_for(recall: float, depth: int, children: float = CHILDREN) -> int:
    """Repeats after which a pair at the similarity is missed by less than 1 - recall: a run finds it if a branching process survives to the depth."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-children * alive)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - alive)))


def least_agreement(similarity: float) -> float:
    """Share of equal bins below which no pair is compared: a pair at the similarity has it in each bin with that chance, in SKETCH_FROM bins at least, so it falls
    SKETCH_SLACK deviations short with a chance of some 1e-9. 0 (no pair is dropped) where the similarity is too low for that."""
    return max(0.0, similarity - SKETCH_SLACK * math.sqrt(similarity * (1 - similarity) / SKETCH_FROM))


def token_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles, sorted, and each row's first one's number."""
    hashes, first = shingles(*word_hashes(data, bounds), k)
    hashes = hashes >> (np.uint64(64) - BITS)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(len(bounds)))


def picks(tokens: np.ndarray, size: np.ndarray, path: np.ndarray, children: float, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are picked under their paths, and the paths that they lead to."""
    h = mix(tokens ^ path)
    bound = np.minimum(children / (similarity * np.maximum(size, 1)), 1.0) * float(2**63)
    at = np.flatnonzero((h >> np.uint64(1)).astype(np.float64) < bound)
    return at, mix(h[at] + path[at] * np.uint64(0xD6E8FEB86659FD93))


def sketch(tokens: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """One-permutation sketch: a byte for each of SKETCH bins, 0 for one without tokens."""
    h = mix(tokens ^ np.uint64(0x51ED270B))
    bins = (h >> np.uint64(58)).astype(np.int64)
    out = np.full(rows * SKETCH, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, row * SKETCH + bins, h & np.uint64((1 << 58) - 1))
    return np.where(out == np.iinfo(np.uint64).max, 0, out % np.uint64(255) + np.uint64(1)).astype(np.uint8).reshape(rows, SKETCH)


def pack(x: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def described(docs: DataFrame, k: int, runs: int, children: float, similarity: float) -> DataFrame:
    """For each row: digest of its set (null: no shingle), the set's size, first paths of all runs, and sketch."""
    seeds = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in chunks(batches, "text", 1 << 19):
            tokens, first = token_sets(data, bounds, k)
            size = np.diff(first)
            row = np.repeat(np.arange(part.num_rows), size)
            found = [picks(tokens, size[row], np.full(len(tokens), s), children, similarity) for s in seeds]
            rows, paths = np.concatenate([row[at] for at, _ in found]), np.concatenate([p for _, p in found])
            order = np.argsort(rows, kind="stable")
            ends = np.searchsorted(rows[order], np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(paths[order].view(np.int64)))
            brief = sketch(tokens, row, part.num_rows)
            digest = [hashlib.blake2b(tokens[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            columns = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "th")]
            columns += [pa.array(digest, pa.binary()), pa.array(size, pa.int32()), lists, pa.array([x.tobytes() for x in brief], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "fp", "n", "paths", "sketch"])

    return docs.mapInArrow(run, "doc_id bigint, th bigint, fp binary, n int, paths array<bigint>, sketch binary")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Rows (id, n, set) of the documents (doc_id, th) in wanted; rows that repeat one come as often as they are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in chunks(batches, "text"):
            tokens, first = token_sets(data, bounds, k)
            packed = [pack(tokens[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("id")), pa.array(np.diff(first), pa.int32()), pa.array(packed, pa.binary())], names=["id", "n", "set"])

    # A bounded table of digests' prefixes is broadcast first, so that texts which aren't wanted stay out of the shuffle.
    prefix = lambda c: F.pmod(F.col(c), F.lit(PREFIXES)).cast("int")
    keys = wanted.select(F.col("doc_id").alias("wd"), F.col("th").alias("wt"), "id")
    some = docs.withColumn("prefix", prefix("th")).join(F.broadcast(keys.select(prefix("wt").alias("prefix")).distinct()), "prefix", "left_semi")
    texts = some.join(keys, F.col("doc_id").eqNullSafe(F.col("wd")) & (F.col("th") == F.col("wt"))).select("id", "text")
    return texts.mapInArrow(run, "id bigint, n int, set binary")


def split(nodes: DataFrame, sets: DataFrame, children: float, similarity: float) -> DataFrame:
    """The next level of paths: rows (id, parent, whole, node) of the sets in the nodes; whole is the parent's size."""

    names = ["id", "parent", "whole", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows = [], 0
            for i, n, packed, nodes in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("id", "n", "set", "nodes")), strict=True):
                tokens, nodes = unpack(packed.as_py()), nodes.as_py()
                parents, whole = np.array([x["node"] for x in nodes], np.int64), np.array([x["size"] for x in nodes], np.int64)
                # So many nodes at a time that a long text's copies of its tokens stay bounded.
                for part in np.array_split(np.arange(len(nodes)), max(1, len(nodes) * len(tokens) // SPLIT_TOKENS)):
                    if not len(part):
                        continue
                    path = np.repeat(parents[part].view(np.uint64), len(tokens))
                    at, more = picks(np.tile(tokens, len(part)), np.full(len(path), n.as_py()), path, children, similarity)
                    node = part[at // max(1, len(tokens))]
                    held.append((np.full(len(at), i.as_py(), np.int64), parents[node], whole[node], more.view(np.int64)))
                    rows += len(at)
                    if rows >= OUT_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
                        held, rows = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)

    lists = nodes.groupBy("id").agg(F.collect_list(F.struct("node", "size")).alias("nodes"))
    return lists.join(sets, "id").select("id", "n", "set", "nodes").mapInArrow(run, "id bigint, parent bigint, whole bigint, node bigint")


def possible(size: np.ndarray, brief: np.ndarray, less: list[np.ndarray], tile: np.ndarray, cross: bool, similarity: float) -> np.ndarray:
    """Pairs of a bucket that may be similar, lie in different tiles if cross, and have no lesser bucket in common."""
    m = len(size)
    ok = np.minimum(size[:, None], size[None]) >= similarity * np.maximum(size[:, None], size[None]) - 1e-9
    np.fill_diagonal(ok, False)
    if cross:
        ok &= tile[:, None] != tile[None]
    equal, either = np.zeros((m, m), np.uint8), np.zeros((m, m), np.uint8)
    for b in range(SKETCH):
        x = brief[:, b]
        there = x > 0
        equal += (x[:, None] == x[None]) & there[:, None]
        either += there[:, None] | there[None]
    ok &= (equal >= least_agreement(similarity) * either) | (either < SKETCH_FROM)
    if not ok.any():
        return ok
    # less: each row's lesser buckets. Those that at least two of the rows are in:
    names, column, times = np.unique(np.concatenate(less), return_inverse=True, return_counts=True)
    if len(names):
        row = np.repeat(np.arange(m), [len(x) for x in less])
        use = times[column] > 1
        renamed = np.cumsum(times > 1) - 1
        for a in range(0, int((times > 1).sum()), 4096):
            in_block = use & (renamed[column] >= a) & (renamed[column] < a + 4096)
            has = np.zeros((m, min(4096, int((times > 1).sum()) - a)), np.float32)
            has[row[in_block], renamed[column[in_block]] - a] = 1
            ok &= (has @ has.T) == 0
    return ok


def similar(ok: np.ndarray, sets: list[np.ndarray], size: np.ndarray, similarity: float) -> np.ndarray:
    """Of the possible pairs those whose sets are similar."""
    out = np.zeros_like(ok)

    def enough(common, a, b):
        return common >= similarity * (a + b - common) - 1e-9

    label = spread(ok)
    for part in (np.flatnonzero(label == k) for k in np.unique(label)):
        if len(part) < 2:
            continue
        if len(part) <= 24:
            for x in range(len(part)):
                for y in range(x + 1, len(part)):
                    i, j = part[x], part[y]
                    if ok[i, j]:
                        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        out[i, j] = out[j, i] = enough(common, size[i], size[j])
            continue
        tokens = np.concatenate([sets[i] for i in part])
        row = np.repeat(np.arange(len(part)), [len(sets[i]) for i in part])
        _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
        several = times > 1
        renamed, use = np.cumsum(several) - 1, several[column]
        row, column = row[use], renamed[column[use]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(part), len(part)), np.float32)
        for a in range(0, int(several.sum()), 2048):
            lo, hi = np.searchsorted(column, [a, a + 2048])
            has = np.zeros((len(part), 2048), np.float32)
            has[row[lo:hi], column[lo:hi] - a] = 1
            common += has @ has.T
        own = size[part]
        at = np.ix_(part, part)
        out[at] = ok[at] & enough(common.astype(np.float64), own[:, None], own[None])
    return out


def jaccard_join(docs: DataFrame, k: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, children: float = CHILDREN, depth: int = DEPTH, small: int = SMALL, tile: int = TILE) -> DataFrame:
    """One row per row of docs: doc_id, th (digest of the text), class_id, n_links, component_id, kept.

    Two rows link if the Jaccard similarity of their sets of k-word shingles is `similarity` or more; a text of 1 to k - 1 words has one
    shingle, of all its words; null and empty texts and those without words link with nothing. class_id is the least doc_id of rows with the
    same set, n_links the number of other rows linked (repeated rows included), component_id the least doc_id that links lead to, and kept
    whether that is the row's own (of rows of that id with different texts, one text's). Null ids count as rows and are nobody's least id unless all are null. An empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    runs = runs_for(recall, depth, children)
    rows = described(own, k, runs, children, similarity)
    all_rows = cut(rows.select("doc_id", "th", "fp", "n", "paths", "sketch"))
    members = cut(all_rows.select("doc_id", "th", "fp"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("th").alias("t"))).alias("o")
    grouped_sets = all_rows.filter("fp is not null").groupBy("fp").agg(least, F.count("*").alias("w"), F.first("n").alias("n"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
    classes = cut(grouped_sets.select("fp", F.col("o.d").alias("doc_id"), F.col("o.t").alias("th"), "w", "n", "paths", "sketch").withColumn("id", F.monotonically_increasing_id()))
    drop(all_rows)

    def shared(nodes: DataFrame) -> DataFrame:
        # Written, so that the join has plain exchanges, whose large partitions can be split.
        sizes = kept(nodes.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"))
        return kept(nodes.join(sizes, "node").select("id", "node", "size"))

    # Whether rows repeat both id and text: only then do sets have to be told apart from their copies, which shuffles them.
    repeated = not members.filter("fp is not null").groupBy("doc_id", "th").agg(F.count("*").alias("rows")).filter("rows > 1").isEmpty()

    scratch: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        scratch.append(cut(df))
        return scratch[-1]

    def sets_for(ids: DataFrame) -> DataFrame:
        found = sets_of(own, classes.join(ids.select("id").distinct(), "id").select("doc_id", "th", "id"), k)
        return kept(found.dropDuplicates(["id"]) if repeated else found)

    level = shared(classes.select("id", F.explode("paths").alias("node")))
    sets = None
    leaves = level.filter(F.col("size") <= small)
    for step in range(2, depth + 1):
        large = level.filter(F.col("size") > small)
        if large.isEmpty():
            break
        sets = sets_for(large) if sets is None else sets
        found = kept(split(large, sets, children, similarity))
        sizes = kept(found.groupBy("parent", "whole", "node").agg(F.count("*").alias("size")))
        alike = sizes.groupBy("parent").agg((F.sum(F.when(2 * F.col("size") >= F.col("whole"), F.col("size")).otherwise(0)) / F.sum("size")).alias("share")).filter(F.col("share") >= ALIKE)
        alike = kept(alike.select(F.col("parent").alias("node")))
        leaves = leaves.unionByName(large.join(alike, "node", "left_semi").select("id", "node", "size"))
        apart = kept(sizes.filter("size > 1").join(alike, F.col("parent") == alike["node"], "left_anti").select("node", "size"))
        level = kept(found.select("id", "node").join(apart, "node").select("id", "node", "size"))
        leaves = leaves.unionByName(level if step == depth else level.filter(F.col("size") <= small))
    leaves = kept(leaves.select("id", F.col("node").alias("leaf"), "size"))

    # Each set's leaves in order; a row of a leaf carries those before it, which are all that it is compared by.
    lists = kept(leaves.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("leaf", "size"))).alias("at")))
    facts = kept(classes.select("id", "n", "sketch").join(lists, "id"))
    drop(lists, leaves)
    in_leaves = facts.select("id", "n", "sketch", F.col("at.leaf").alias("all"), F.posexplode("at").alias("p", "here"))
    in_leaves = in_leaves.select("id", "n", "sketch", F.col("here.leaf").alias("leaf"), F.col("here.size").alias("size"), F.slice("all", F.lit(1), F.col("p")).alias("before"))
    keys = ["leaf", "ti", "tj"]

    def bucket(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        size = np.array(table.column("n").to_pylist(), np.int64)
        brief = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        before = table.column("before").combine_chunks()
        before = np.split(before.flatten().to_numpy(), np.cumsum(before.value_lengths().to_numpy())[:-1])
        cross = table.column("ti")[0].as_py() != table.column("tj")[0].as_py()
        return size, possible(size, brief, before, np.array(table.column("t").to_pylist()), cross, similarity)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, keys):
            if table.num_rows > 1:
                _, ok = bucket(table)
                yield from table.select(["leaf", "ti", "tj", "t", "id"]).filter(pa.array(ok.any(1))).combine_chunks().to_batches()

    tiles = tiled(in_leaves, "leaf", tile, "id").select("leaf", "ti", "tj", "t", "id", "n", "sketch", "before")
    flagged = kept(by_group(tiles, keys).mapInArrow(candidates, "leaf bigint, ti bigint, tj bigint, t bigint, id bigint"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, keys):
            if table.num_rows < 2:
                continue
            size, ok = bucket(table)
            links = similar(ok, [unpack(x) for x in table.column("set").to_pylist()], size, similarity)
            hit = np.flatnonzero(links.any(1))
            if not len(hit):
                continue
            ids, weight = np.array(table.column("id").to_pylist()), np.array(table.column("w").to_pylist())
            label = spread(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64) @ weight), pa.array(ids[label[hit]])], names=["id", "links", "near"])

    # Only what has a possible partner is compared as a whole set.
    again = flagged.join(in_leaves.drop("size"), ["id", "leaf"]).join(classes.select("id", "w"), "id")
    full = again.join(sets_for(flagged).select("id", "set"), "id").select("leaf", "ti", "tj", "t", "id", "w", "n", "sketch", "before", "set")
    linked = kept(by_group(full, keys).mapInArrow(verified, "id bigint, links bigint, near bigint"))
    counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("id").alias("a"), F.col("near").alias("b"))).withColumnRenamed("node", "id")
    named = classes.select("id", "fp", "w", "th", F.col("doc_id").alias("class_id")).join(counts, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = kept(named)
    first = F.min(F.struct(F.col("class_id").isNull().alias("z"), F.col("class_id").alias("d"), F.col("th").alias("t"))).alias("o")
    firsts = named.groupBy("root").agg(first).select("root", F.col("o.d").alias("component_id"), F.col("o.t").alias("keeper"))
    final = cut(named.join(firsts, "root").select("fp", "class_id", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", "keeper"))
    drop(classes, *scratch)
    # members and final are read by the caller's plan, and stay until the session ends.
    out = members.join(final.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f"), "left")
    class_id, component = F.when(F.col("f").isNull(), F.col("doc_id")).otherwise(F.col("class_id")), F.when(F.col("f").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "th", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("doc_id").eqNullSafe(component) & F.coalesce(F.col("th") == F.col("keeper"), F.lit(True))).alias("kept"))


__all__ = ["Forest", "jaccard_join", "runs_for"]
