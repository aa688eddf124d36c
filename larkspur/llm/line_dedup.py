"""Near-duplicate lines by a deletion neighbourhood, in DataFrame functions only.

A line is the sequence of its words, and two lines of MIN_WORDS words or more are near if one edit of a word (substituted, inserted or deleted)
makes them equal. The bound is one edit whatever the length, not a share of the words: longer lines with two or more edits aren't near, even
where four fifths of their words agree. Shorter lines are near only if equal; lines without words are never compared. A line goes if an earlier one (by doc_id, then line number) is near to it, whether that one is kept or not.

1. Equal lines come together by digest, and of each set the earliest is remembered; from here on there are distinct lines only.
2. One edit leaves a line's first or its second half alone, so lines that share neither half with another are done.
3. Every other line emits its deletion variants: the digest of the line without word i, with i, and that of the whole line.
4. Equal variants are joined. Two lines that lack the same word i differ in that word at most; a line that equals another's variant
   lacks one word. Equality with the edit's place is what verifies the distance: variants with different i don't count. Digests have 128
   bits (two sums of independent 64-bit hashes, one with the words' places), so no pair needs to be listed: of a group of
   near lines each is compared with the earliest alone, and a group's size only ever goes into a minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.columns import boxed, carried
from larkspur.llm.quality_rules import let, split_words
from larkspur.llm.store import cut, drop

MIN_WORDS = 5


def fold(x: Column) -> Column:
    """All values of an array of longs, combined by exclusive or."""
    return F.aggregate(x, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b))


def prefix_fold(x: Column) -> Column:
    """For each place of an array the fold of all values before it; in blocks of the root of its length, so a long line costs little more a word."""

    def blocks(width: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int")), lambda b: F.slice(x, b * width + 1, width))

        def placed(p: Column) -> Column:
            def inner(before: Column) -> Column:
                return F.flatten(F.transform(p, lambda part, b: let(fold(F.slice(before, 1, b)), lambda s: F.transform(part, lambda _, j: s.bitwiseXOR(fold(F.slice(part, 1, j)))))))

            return let(F.transform(p, fold), inner)

        return let(parts, placed)

    return let(F.ceil(F.sqrt(F.size(x))).cast("int"), blocks)


def placed_hashes(words: Column, shift: int = 0) -> Column:
    """Each word hash with its place."""
    return F.transform(words, lambda g, j: F.xxhash64(g, j - shift))


def word_hashes(line: Column) -> Column:
    return F.transform(split_words(line), lambda w: F.xxhash64(w))


def halves(g: Column) -> Column:
    """Digests of a line's first and last k words, for both k that a line of this length and one of a word more or less have in common."""

    def keys(n: Column) -> Column:
        ks = F.array_distinct(F.array(F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")))
        first = F.transform(ks, lambda k: F.xxhash64(F.slice(g, 1, k), F.lit(0)))
        last = F.transform(ks, lambda k: F.xxhash64(F.slice(g, n - k + 1, k), F.lit(1)))
        return F.concat(first, last)

    return F.when(F.size(g) >= MIN_WORDS, let(F.size(g), keys)).otherwise(F.expr("cast(array() as array<bigint>)"))


def variants(g: Column, first: Column, last: Column) -> Column:
    """(k1, k2, n, at) of the whole line (at -1) and of the line without word `at`.

    Where only first halves are shared, the edit is in the rest, and the other way round: other places aren't emitted.
    """

    def emit(v: Column) -> Column:
        n, a, b, before_a, before_b, all_b, bag = (v[k] for k in ("n", "a", "b", "pa", "pb", "tb", "bag"))
        half = F.floor((n - 1) / 2).cast("int")
        places = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (first & (i >= half)) | (last & (i < n - half)))
        one = lambda i: F.struct(before_a[i].bitwiseXOR(all_b).bitwiseXOR(before_b[i]).bitwiseXOR(b[i]).alias("k1"), bag.bitwiseXOR(g[i]).alias("k2"), (n - 1).alias("n"), i.alias("at"))
        whole = F.array(F.struct(fold(a).alias("k1"), bag.alias("k2"), n.alias("n"), F.lit(-1).alias("at")))
        return F.concat(whole, F.transform(places, one))

    def sums(v: Column) -> Column:
        return let(F.struct(v["a"].alias("a"), v["b"].alias("b"), prefix_fold(v["a"]).alias("pa"), prefix_fold(v["b"]).alias("pb"), fold(v["b"]).alias("tb"), fold(g).alias("bag"), F.size(g).alias("n")), emit)

    return let(F.struct(placed_hashes(g).alias("a"), placed_hashes(g, 1).alias("b")), sums)


def identified(docs: DataFrame) -> DataFrame:
    """The rows with `__d` and `__t`, id and digest of the text: rows that have both in common get the same result."""
    return docs.withColumn("__d", F.col("doc_id").cast("bigint")).withColumn("__t", F.xxhash64("text"))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """One row per document with lines to drop: __d, __t, dropped (line numbers from 0)."""
    own = identified(docs.select("doc_id", "text"))
    each = own.select("__d", "__t", F.posexplode(F.transform(split_lines(F.col("text")), word_hashes)).alias("ln", "g")).filter(F.size("g") > 0)
    order = F.struct(F.col("__d").isNull().alias("z"), F.col("__d").alias("d"), F.col("__t").alias("t"), F.col("ln").alias("l"))
    # Here a line's digest is that of its word hashes, forwards and backwards: cheaper than the sums, which only variants need.
    lines = cut(each.select(order.alias("o"), F.xxhash64("g").alias("k1"), F.xxhash64(F.reverse("g")).alias("k2"), F.size("g").alias("n"), halves(F.col("g")).alias("hk")))

    # Distinct lines, each with its earliest place; and the other places of equal lines.
    distinct = cut(lines.groupBy("k1", "k2", "n", "hk").agg(F.min("o").alias("o"), (F.max("o") > F.min("o")).alias("again")))
    # A half that distinct lines share has different whole digests.
    half = distinct.select("k1", "k2", "n", F.posexplode("hk").alias("i", "half")).select("k1", "k2", "n", "half", (F.col("i") * 2 < F.when(F.col("n") % 2 == 0, 4).otherwise(2)).alias("is_first"))
    shared = half.groupBy("half").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.min("k2").alias("c"), F.max("k2").alias("d")).filter("a < b or c < d").select("half")
    candidates = half.join(shared, "half").groupBy("k1", "k2", "n").agg(F.max("is_first").alias("first"), F.max(~F.col("is_first")).alias("last"))
    placed = candidates.join(distinct.select("k1", "k2", "n", "o"), ["k1", "k2", "n"]).select("o", "k1", "k2", "first", "last")
    # After a global sort the running ids keep the order of the lines in one long.
    numbered = cut(placed.orderBy("o").withColumn("id", F.monotonically_increasing_id()))
    wanted = numbered.groupBy(F.col("o.d").alias("wd"), F.col("o.t").alias("wt")).agg(F.collect_list(F.struct(F.col("o.l").alias("l"), "id", "first", "last")).alias("want"))
    found = own.join(wanted, F.col("__d").eqNullSafe(F.col("wd")) & (F.col("__t") == F.col("wt")))
    picked = found.select(F.explode(let(split_lines(F.col("text")), lambda x: F.transform(F.col("want"), lambda w: F.struct(w["id"].alias("id"), w["first"].alias("first"), w["last"].alias("last"), word_hashes(x[w["l"]]).alias("g"))))).alias("w"))
    emitted = cut(picked.select(F.col("w.id").alias("id"), F.inline(variants(F.col("w.g"), F.col("w.first"), F.col("w.last")))))

    key = ["k1", "k2", "n"]
    several = emitted.groupBy(*key).agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x < y").select(*key)
    hits = emitted.join(several, key)
    same = hits.groupBy(*key, "at").agg(F.min("id").alias("m"))
    other = same.groupBy(*key).agg(F.min(F.when(F.col("at") < 0, F.col("m"))).alias("whole"), F.min(F.when(F.col("at") >= 0, F.col("m"))).alias("part"))
    earlier = F.least("m", F.when(F.col("at") < 0, F.col("part")).otherwise(F.col("whole")))
    near = hits.join(same, [*key, "at"]).join(other, key).filter(F.col("id") > earlier).select("id").distinct()

    # Of each set of equal lines: all go if the line is near to an earlier one, else all but the earliest.
    near_lines = numbered.join(near, "id").select("k1", "k2", F.lit(True).alias("near"))
    bad = distinct.join(near_lines, ["k1", "k2"], "left").filter("near or again").select("k1", "k2", "n", F.col("o").alias("earliest"), "near")
    gone = lines.join(bad, key).filter(F.coalesce(F.col("near"), F.lit(False)) | (F.col("o") > F.col("earliest")))
    out = cut(gone.groupBy(F.col("o.d").alias("__d"), F.col("o.t").alias("__t")).agg(F.collect_set("o.l").alias("dropped")))
    drop(lines, distinct, numbered, emitted)
    return out


def line_dedup(docs: DataFrame) -> DataFrame:
    """The rows with their duplicate lines left out of text, and n_lines and n_dropped added.

    Documents stay even if no line is left; null text stays null, with one empty line. Lines are split at \\n; lines without words stay.
    Order is by doc_id (null last), then digest of the text, then line number, so ties are settled alike on every run. Rows that repeat id
    and text are one document, and each gets that document's result. An empty table gives no rows. Columns that bear the new names,
    in any case, are replaced, and columns of other names pass through.
    """
    added = ["n_lines", "n_dropped"]
    gone = dropped_lines(docs).select(F.col("__d").alias("dd"), F.col("__t").alias("dt"), "dropped")
    own = boxed(docs, added, F.col("text").alias("text"), F.col("doc_id").cast("bigint").alias("d"), F.xxhash64("text").alias("t"))
    joined = own.join(gone, F.col("d").eqNullSafe(F.col("dd")) & (F.col("t") == F.col("dt")), "left")
    lines = split_lines(F.col("text"))
    left = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("dropped")), lambda i: x[i]), "\n"))
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(left)
    values = {"n_lines": F.size(lines).cast("bigint"), "n_dropped": F.greatest(F.coalesce(F.size("dropped"), F.lit(0)), F.lit(0)).cast("bigint")}
    named = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in carried(docs, added)]
    return joined.select(*named, *(v.alias(k) for k, v in values.items()))
