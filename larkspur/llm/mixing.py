"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points are mapped through the cumulative numbers of slots that the targets come to, so that each point is a slot of one source and
every stretch of the schedule has the sources in near their target shares. A source's slots are ranked, and the slot of rank r takes block r (modulo
the number of blocks) of the source's documents, shuffled by a digest and cut into blocks of equal numbers of words. The points decide: they give a
source a few slots more or less than its target comes to, so its words are near the target, by some blocks. The slot in which a source's
target ends takes only the words still due then. No block is taken more than `cap` times: slots past that stay empty.

A source may hold any share of the rows: offsets are summed in levels over buckets of a source and over chunks of the schedule, so that no
task has all of either, and blocks are joined on source and block number. On the driver there is one row per source.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.columns import quoted
from larkspur.llm.store import cut

#: Words of a block; documents of a bucket, on average; slots of a chunk; chunks or buckets that are summed up at once; chunks that a task draws.
BLOCK_WORDS, BUCKET_ROWS, CHUNK_SLOTS, TOGETHER, TASK_CHUNKS = 64, 4096, 16384, 1024, 64
CAP = 3
#: Bits of the golden ratio's fraction, as a step of 64-bit points.
GOLDEN = 0x9E3779B97F4A7C15
#: Up to this many sources the table of sources is broadcast; past it, it is joined by shuffle.
BROADCAST_SOURCES = 100_000
SEED = 7

SEPARATORS = r"[\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    """Number of words `[^\\x20\\x09-\\x0D]+` of a text; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SEPARATORS), "")), F.lit(0)).cast("bigint")


def digest(key, text, seed: int = SEED) -> F.Column:
    """A row's place in the shuffled order of its source."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), text))


def targets(sizes: list[int], weights: list[int], cap: int = CAP) -> list[Fraction]:
    """Each source's target: all words shared by weight, none above cap times its size, the excess shared again by weight."""
    out, open_ = [Fraction(0)] * len(sizes), set(range(len(sizes)))
    left = Fraction(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] > cap * sizes[i] * total]
        for i in over or open_:
            out[i] = Fraction(cap * sizes[i]) if over else left * weights[i] / total
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def plan(sources: list[tuple[str | None, int, int]], block: int, cap: int = CAP) -> pd.DataFrame:
    """One row per source (name, words, rows), by code point with null last: its target, words to take, blocks, slots and last slot's words."""
    sources = sorted(sources, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    goal = targets([x[1] for x in sources], [i % 3 + 1 for i in range(len(sources))], cap)
    rows = []
    for i, ((name, size, n), t) in enumerate(zip(sources, goal, strict=True)):
        take, blocks = int(t), -(-size // block)
        epochs, rest = divmod(take, size) if size else (0, 0)
        slots = epochs * blocks + -(-rest // block)
        # The last slot takes what is left of the target: a block's share in an epoch that isn't whole, a whole block else.
        rows.append((i, name, size, float(t), take, blocks, slots, rest % block if rest else 0, max(1, -(-n // BUCKET_ROWS))))
    return pd.DataFrame(rows, columns=["s", "known", "source_size", "target", "take", "blocks", "slots", "part", "buckets"])


def running(counts: DataFrame, order: str) -> DataFrame:
    """Rows (s, order, off): off is the sum of n over the source's earlier rows, in two levels: no window has all rows of a source."""
    parts = counts.withColumn("g", F.floor(F.col(order) / TOGETHER))
    earlier = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    groups = parts.groupBy("s", "g").agg(F.sum("n").alias("n")).select("s", "g", before(earlier("s", by="g")).alias("base"))
    own = parts.select("s", "g", order, before(earlier("s", "g", by=order)).alias("own"))
    return own.join(groups, ["s", "g"]).select("s", order, (F.col("base") + F.col("own")).alias("off"))


def schedule(spark, table: pd.DataFrame, step: int = GOLDEN) -> DataFrame:
    """Rows (s, r, i): each slot's source, its rank in the source, and its place in the schedule. step: of the 64-bit points."""
    slots = table["slots"].to_numpy(np.int64)
    total = int(slots.sum())
    bounds = np.array([max(0, (int(x) << 64) // max(total, 1) - 1) for x in np.cumsum(slots)], dtype=np.uint64)
    chunks = -(-total // CHUNK_SLOTS)
    used = np.flatnonzero(slots > 0)

    def points(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for c in part["id"].tolist():
                i = np.arange(c * CHUNK_SLOTS, min(total, (c + 1) * CHUNK_SLOTS), dtype=np.uint64)
                s = used[np.minimum(np.searchsorted(bounds[used], i * np.uint64(step), "left"), len(used) - 1)]
                order = np.argsort(s, kind="stable")
                ordered = s[order]
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                rank = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
                yield pd.DataFrame({"s": ordered, "chunk": c, "own": rank, "i": i[order].astype(np.int64)})

    tasks = max(1, min(chunks, max(spark.sparkContext.defaultParallelism, chunks // TASK_CHUNKS)))
    drawn = cut(spark.range(0, chunks, 1, tasks).mapInPandas(points, "s bigint, chunk bigint, own bigint, i bigint"))
    offsets = running(drawn.groupBy("s", "chunk").agg(F.count("*").alias("n")), "chunk")
    # Both sides grow with the schedule, however well they compress: neither may be broadcast.
    return drawn.hint("merge").join(offsets, ["s", "chunk"]).select("s", (F.col("off") + F.col("own")).alias("r"), "i")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", block: int = BLOCK_WORDS, seed: int = SEED, cap: int = CAP, step: int = GOLDEN) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), first_slot (the first place in the
    schedule that takes some of it, null if none does), n_slots (how many do), row_digest.

    Sources by code point, null last, weigh 1, 2, 3, repeating. A null source is a source. Null and empty texts have size 0 and give 0
    words. Rows that repeat key and text stand side by side in the shuffled order, each with an offset of its own. An empty table
    gives no rows. The same rows give the same mix however they are partitioned. Columns of other names aren't looked at.
    """
    spark = docs.sparkSession
    sized = cut(
        docs.select(
            F.col(quoted(key)).cast("bigint").alias("doc_id"),
            F.col(quoted(source)).cast("string").alias("name"),
            word_count(F.col(quoted(text))).alias("size"),
            digest(F.col(quoted(key)), F.col(quoted(text)), seed).alias("h"),
        )
    )
    found = sized.groupBy("name").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    table = plan([(r["name"], int(r["words"]), int(r["n"])) for r in found], block, cap)
    sources = spark.createDataFrame(table, "s bigint, known string, source_size bigint, target double, take bigint, blocks bigint, slots bigint, part bigint, buckets bigint")
    small = F.broadcast if len(table) <= BROADCAST_SOURCES else lambda df: df

    bucket = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * F.col("buckets") / F.lit(1 << 32)).cast("bigint")
    placed = sized.join(small(sources), F.col("name").eqNullSafe(F.col("known"))).select("doc_id", "size", "h", "s", bucket.alias("bucket"))
    offsets = running(placed.groupBy("s", "bucket").agg(F.sum("size").alias("n")), "bucket")
    order = Window.partitionBy("s", "bucket").orderBy("h", "doc_id")
    spread = placed.hint("merge").join(offsets, ["s", "bucket"])
    spread = spread.withColumn("rn", F.row_number().over(order)).withColumn("hi", F.col("off") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spread = spread.withColumn("lo", F.col("hi") - F.col("size"))

    # Slots to takes of a block: whole ones, and the words of the slot in which the source's target ends.
    due = sources.select("s", "blocks", "slots", "part")
    slots = schedule(spark, table, step).join(small(due), "s").filter(F.col("r") < cap * F.col("blocks"))
    ends = (F.col("r") == F.col("slots") - 1) & (F.col("part") > 0)
    takes = slots.groupBy("s", (F.col("r") % F.col("blocks")).alias("b")).agg(
        F.sum(F.when(ends, 0).otherwise(1)).alias("whole"), F.min(F.when(~ends, F.col("i"))).alias("at"), F.sum(F.when(ends, F.col("part")).otherwise(0)).alias("words"), F.min(F.when(ends, F.col("i"))).alias("end")
    )
    # Documents without words are in no block; their numbers below 0 are spread, so that no task has them all.
    none = F.array(F.pmod(F.xxhash64("h"), F.lit(4096)) - 4096)
    pieces = spread.withColumn("b", F.explode(F.when(F.col("size") > 0, F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))).otherwise(none)))
    start, low = F.col("b") * block, F.greatest(F.col("lo"), F.col("b") * block)
    full = F.coalesce("whole", F.lit(0)) * F.greatest(F.lit(0), F.least(F.col("hi"), start + block) - low)
    part = F.greatest(F.lit(0), F.least(F.col("hi"), start + F.coalesce("words", F.lit(0))) - low)
    joined = pieces.hint("merge").join(takes, ["s", "b"], "left").withColumn("full", F.when(F.col("b") < 0, 0).otherwise(full)).withColumn("cut", F.when(F.col("b") < 0, 0).otherwise(part))
    summed = joined.groupBy("s", "bucket", "rn", "doc_id", "size", "h").agg(
        F.sum(F.col("full") + F.col("cut")).cast("bigint").alias("taken"),
        F.min(F.least("at", F.when(F.col("cut") > 0, F.col("end")))).alias("first_slot"),
        F.sum(F.coalesce("whole", F.lit(0)) + F.when(F.col("cut") > 0, 1).otherwise(0)).cast("bigint").alias("n_slots"),
    )
    named = sources.select("s", "source_size", "target")
    return summed.join(small(named), "s").select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots", F.col("h").alias("row_digest"))
