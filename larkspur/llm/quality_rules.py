"""Quality rules by distribution divergence, in DataFrame functions only.

Each language's reference is two histograms over all its documents of 50 words or more: shares of character classes, and shares of
the language's most frequent words (and of all other words). A document is compared with its own language's reference, or the nearest where its
language is null, by Jensen-Shannon distance (base 2, so 0 to 1) and fails where it is beyond a threshold; texts below a guard's length and
texts of languages without enough texts for a reference aren't compared, and short texts may stray further by their common words.

One pass over the documents counts words by language (partial sums before the shuffle); what comes to the driver is
`common` words and one histogram per language. The verdict itself is a projection: no shuffle, no join. Past INLINE_LANGUAGES languages the references
stay in a table of one row, which is broadcast; the distances are the same, and no language is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.columns import boxed, unboxed
from larkspur.llm.store import cut, drop

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: The character classes of the histograms.
CLASSES = ("capital", "other letter", "digit", "space", "stop", "other")

#: Bits of a position in a text, where it shares a long with a hash.
PLACE_BITS = 20
#: Up to this many languages the references are constants of the plan; past it, a broadcast row.
INLINE_LANGUAGES = 200
COMMON, MIN_WORDS, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 40, 50, 0.23, 0.36
#: Texts under so many words may be this far by their common words.
SHORT_WORDS, MAX_SHORT_WORD_DISTANCE = 100, 0.45
#: A language has a reference from so many texts on.
REFERENCE_DOCUMENTS = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: a lambda's variable is never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column more, evaluated once: a generator's output is never inlined, and what stands on it can be compiled."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def with_windows(df: DataFrame) -> DataFrame:
    """df with words `w` gets `s`: for a text with three-word windows that come twice or more, its windows in order, as longs of the hash's upper bits
    and the position; and `v`, all windows' hashes by position. s is null where no window comes twice, and where the text is too long for such longs.

    Each step stands on a generator's column, so that the sort, over plain longs, is compiled.
    """
    several = F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0)))
    # Written with a slice, so that no window is partial.
    df = bound(df, "v", F.transform(several, lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))))
    twice = (F.size(F.array_distinct("v")) < F.size("v")) & (F.size("v") < 1 << PLACE_BITS)
    df = bound(df, "s", F.when(twice, F.transform("v", lambda x, i: x.bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(i.cast("bigint")))))
    return df.withColumn("s", F.sort_array("s"))


def repeated_words() -> Column:
    """Words inside three-word windows that the text has twice or more, from the columns of with_windows().

    Where two hashes agree in the upper bits alone, and in texts too long for with_windows(), windows are sorted by whole hash and position.
    """

    def by_pair(v: Column) -> Column:
        def again(s: Column) -> Column:
            same = lambda i, x: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
            return F.transform(F.filter(s, lambda x, i: same(i - 1, x) | same(i + 1, x)), lambda x: x["p"])

        return let(F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), again)

    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    upper = lambda x: F.shiftright(x, PLACE_BITS)

    def by_long(s: Column, v: Column) -> Column:
        # The first of each two neighbours whose upper bits agree.
        firsts = F.filter(F.sequence(F.lit(0), F.size(s) - 2), lambda i: upper(F.get(s, i)) == upper(F.get(s, i + 1)))

        def settled(k: Column) -> Column:
            clash = F.exists(k, lambda i: F.get(v, place(F.get(s, i))) != F.get(v, place(F.get(s, i + 1))))
            both = F.concat(F.transform(k, lambda i: place(F.get(s, i))), F.transform(k, lambda i: place(F.get(s, i + 1))))
            return F.when(clash, by_pair(v)).otherwise(F.array_distinct(both))

        return let(firsts, settled)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    s, v = F.col("s"), F.col("v")
    places = F.when(s.isNotNull(), by_long(s, v)).when(F.size(v) >= 1 << PLACE_BITS, by_pair(v))
    return F.coalesce(let(F.sort_array(places), lambda p: F.when(p.isNotNull(), covered(p))), F.lit(0)).cast("bigint")


def base() -> dict[str, Column]:
    """The base counts, from the columns t (the text), x (the text without spaces and small Latin letters), w, s and v."""
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size("w").cast("bigint"),
        "word_chars": F.length(F.array_join("w", "")).cast("bigint"),
        "n_symbols": (F.length("x") - F.length(F.regexp_replace("x", f"[{SYMBOLS}]+", ""))).cast("bigint"),
        "n_dup_lines": F.when(F.instr("t", "\n") > 0, let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0).cast("bigint"),
        "n_repeat_words": repeated_words(),
    }


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def stripped(text: Column) -> Column:
    """The text without spaces and small Latin letters, which are most of it and in no class by themselves that isn't counted otherwise."""
    return F.regexp_replace(text, "[a-z ]+", "")


def class_counts(chars: Column, word_chars: Column, rest: Column) -> Column:
    """Characters of each class, in order, as an array of doubles. chars: the text's length; word_chars: the length of its words; rest: stripped().

    Separators of words are the white space, so words' lengths give the spaces; each step takes a class out of what is left.
    """

    def without(x: Column, pattern: str) -> Column:
        return F.regexp_replace(x, pattern, "")

    def classes(r: Column) -> Column:
        # Lengths of the text's rest without small letters, then capitals, other letters, digits, space and stops; letters that are gone from chars are small.
        left = let(F.array(r, without(r, r"\p{Lu}+"), without(r, r"\p{L}+")), lambda x: let(without(x[2], r"\p{Nd}+"), lambda y: let(without(y, r"\s+"), lambda z: F.array(*(F.length(i) for i in (r, x[1], x[2], y, z, without(z, "[.,;:!?]+")))))))
        spaces = chars - word_chars

        def counts(n: Column) -> Column:
            # The rest has all of a text's characters but blanks and a to z.
            capital, digit, stop, other = n[0] - n[1], n[2] - n[3], n[4] - n[5], n[5]
            return F.array(*(x.cast("double") for x in (capital, word_chars - capital - digit - stop - other, digit, spaces, stop, other)))

        return let(left, counts)

    return let(rest, classes)


def normalised(counts: Column) -> Column:
    def shares(c: Column) -> Column:
        return let(F.aggregate(c, F.lit(0.0), lambda a, b: a + b), lambda t: F.transform(c, lambda x: F.when(t > 0, x / t).otherwise(0.0)))

    return let(counts, shares)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares: the root of the divergence in bits."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    parts = F.zip_with(p, q, lambda x, y: let((x + y) / 2, lambda m: (term(x, m) + term(y, m)) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)))


def references(docs: DataFrame, common: int, inline: int = INLINE_LANGUAGES, min_documents: int = REFERENCE_DOCUMENTS) -> list[dict] | DataFrame:
    """For each language: its most frequent words (ties by code point), their shares and that of the others, and shares of character classes.

    All texts of a language of at least the base rules' 50 words count, in one pass that counts each language's words (partially before the shuffle); the
    classes follow from the counted words, and spaces from one further entry for each text. No task ranks a language's whole vocabulary. Every language
    with `min_documents` such texts has a reference: a list of up to `inline`, which bounds what comes to the driver, else one row with the array `refs`.
    """
    use = docs.select("lang", "text").filter("lang is not null and text is not null")
    split = bound(use, "w", split_words(F.col("text"))).filter(F.size("w") >= 50)
    # Words have no space; the number of a text's spaces goes under a name that has one.
    spaces = F.concat(F.lit(" "), (F.length("text") - F.length(F.array_join("w", ""))).cast("string"))
    counts = cut(split.select("lang", F.explode(F.array_append("w", spaces)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")))
    is_word = ~F.col("word").startswith(" ")
    rest = counts.withColumn("x", F.when(is_word, stripped(F.col("word"))).otherwise(""))
    n, x, some = F.col("n"), F.col("x"), F.col("x") != ""
    of = lambda pattern: F.sum(F.when(some, n * (F.length(x) - F.length(F.regexp_replace(x, pattern, ""))))).alias(pattern)
    words, spaces = F.when(is_word, n), F.when(~is_word, n)
    sums = rest.groupBy("lang").agg(
        F.sum(words).alias("total"), F.sum(spaces).alias("documents"), F.sum(words * F.length("word")).alias("chars"), F.sum(spaces * F.expr("bigint(substring(word, 2))")).alias("space"),
        F.sum(n * F.length(x)).alias("rest"), *(of(k) for k in (r"\p{Lu}+", r"\p{L}+", r"\p{Nd}+", "[.,;:!?]+")),
    )
    capital, letter, digit, stop = (F.coalesce(F.col(f"`{k}`"), F.lit(0)) for k in (r"\p{Lu}+", r"\p{L}+", r"\p{Nd}+", "[.,;:!?]+"))
    other = F.col("rest") - letter - digit - stop
    classes = F.array(*(c.cast("double") for c in (capital, F.col("chars") - capital - digit - stop - other, digit, F.col("space"), stop, other)))
    totals = cut(sums.filter(F.col("documents") >= min_documents).select("lang", "total", normalised(classes).alias("classes")))
    ranked = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "word"))
    top = counts.filter(is_word).withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(64))).withColumn("k", ranked(["lang", "salt"])).filter(F.col("k") <= common)
    top = top.withColumn("k", ranked(["lang"])).filter(F.col("k") <= common).select("lang", "word", "n")
    found = totals.limit(inline + 1).collect()
    if len(found) > inline:
        out = cut(reference_row(top, totals))
        drop(counts, totals)
        return out
    top = top.collect()
    drop(counts, totals)
    out = []
    for t in sorted(found, key=lambda r: r["lang"]):
        own = sorted((-r["n"], r["word"].encode(), r["word"]) for r in top if r["lang"] == t["lang"])
        p = [-n / t["total"] for n, _, _ in own]
        out.append({"lang": t["lang"], "words": [w for _, _, w in own], "shares": [*p, max(0.0, 1 - sum(p))], "classes": list(t["classes"])})
    return out


def reference_row(top: DataFrame, totals: DataFrame) -> DataFrame:
    """The references of all languages as one row: the array `refs` of (lang, words, shares, classes)."""
    own = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "word"))).alias("own"))
    shares = lambda c, t: let(F.transform(c, lambda x: -x["m"] / t), lambda p: F.concat(p, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(p, F.lit(0.0), lambda a, b: a + b)))))
    each = own.join(totals, "lang").select("lang", F.col("own.word").alias("words"), shares(F.col("own"), F.col("total")).alias("shares"), "classes")
    return each.agg(F.collect_list(F.struct("lang", "words", "shares", "classes")).alias("refs"))


def literal(values: list, kind: str) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>") if values else F.expr(f"cast(array() as array<{kind}>)")


def literal_references(refs: list[dict]) -> Column:
    """The references as a constant of the plan, like reference_row()'s column."""
    kind = "array<struct<lang:string,words:array<string>,shares:array<double>,classes:array<double>>>"
    if not refs:
        return F.expr(f"cast(array() as {kind})")
    return F.array(*(F.struct(F.lit(r["lang"]).alias("lang"), literal(r["words"], "string").alias("words"), literal(r["shares"], "double").alias("shares"), literal(r["classes"], "double").alias("classes")) for r in refs))


def compared(refs: Column, lang: Column, classes: Column, own: Column, n_words: Column, max_class: Column, max_word: Column) -> Column:
    """The distances (class_distance, word_distance) to the language's reference, or to the nearest one of all where the language is null; null if there is none.

    classes: the text's counts by class; own: its words, of which those that are in no reference may be left out.
    """

    def to(r: Column, p: Column) -> Column:
        count = lambda w: F.size(own) - F.size(F.array_remove(own, w))
        found = let(F.array_intersect(own, r["words"]), lambda here: F.map_from_arrays(here, F.transform(here, count)))
        shares = let(found, lambda c: F.transform(r["words"], lambda w: F.coalesce(F.try_element_at(c, w), F.lit(0)) / n_words))
        full = let(shares, lambda s: F.concat(s, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(s, F.lit(0.0), lambda a, b: a + b)))))
        pair = F.struct(distance(p, r["classes"]).alias("c"), distance(full, r["shares"]).alias("w"))
        return let(pair, lambda x: F.struct(F.greatest(x["c"] / max_class, x["w"] / max_word).alias("worst"), x["c"].alias("c"), x["w"].alias("w")))

    mine = F.filter(refs, lambda r: lang.isNull() | (r["lang"] == lang))
    return F.array_min(let(normalised(classes), lambda p: F.transform(mine, lambda r: to(r, p))))


def quality_rules(
    docs: DataFrame,
    common: int = COMMON,
    min_words: int = MIN_WORDS,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    short_words: int = SHORT_WORDS,
    max_short_word_distance: float = MAX_SHORT_WORD_DISTANCE,
    min_documents: int = REFERENCE_DOCUMENTS,
    refs: list[dict] | DataFrame | None = None,
    inline: int = INLINE_LANGUAGES,
) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance and kept to each row.

    A text is compared with the reference of its own language; where that is null, with the one it is nearest to. Guards: texts under `min_words` words, and texts
    of a language with fewer than `min_documents` texts, aren't compared, and have null distances; texts under `short_words` words may be at max_short_word_distance.

    Null and empty texts have no words and fail the base rules. Rows are judged each by itself, so repeated rows and ids get equal verdicts; a null language
    keeps a row out of the references. An empty table has no references and gives no rows. Columns of the input that bear one of the new names, in any case,
    are replaced; all others stay, whatever their names. A text of any length is one row's work.
    """
    refs = references(docs, common, inline, min_documents) if refs is None else refs
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
    df = boxed(docs, added, F.coalesce(F.col("text"), F.lit("")).alias("t"), F.col("lang").cast("string").alias("lang"))
    # A generator keeps the words from being split anew wherever they are used.
    df = with_windows(bound(df, "w", split_words(F.col("t")))).withColumn("x", stripped(F.col("t")))
    if isinstance(refs, DataFrame):
        df, own = df.crossJoin(F.broadcast(refs)), F.col("w")
    else:
        vocabulary = sorted({w for r in refs for w in r["words"]})
        df, own = df.withColumn("refs", literal_references(refs)), F.filter("w", lambda x: x.isin(vocabulary))
    # Bound, so that a filter on the verdict stays above the counts and doesn't work them out once more.
    df = bound(df, "counts", F.struct(*(v.alias(k) for k, v in base().items())))
    df = df.select("row", "t", "lang", "w", "x", "refs", "counts.*")
    df = df.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    judged = ~F.col("base_failed") & (F.col("n_words") >= min_words)
    max_word = F.when(F.col("n_words") < short_words, max_short_word_distance).otherwise(max_word_distance)
    classes = class_counts(F.length("t"), F.col("word_chars"), F.col("x"))
    near = let(own, lambda o: compared(F.col("refs"), F.col("lang"), classes, o, F.col("n_words").cast("double"), F.lit(max_class_distance), max_word))
    df = bound(df, "near", F.when(judged, near))
    within = F.coalesce((F.col("near.c") <= max_class_distance) & (F.col("near.w") <= max_word), F.lit(True))
    values = {a: F.col(a) for a in added[:6]} | {"class_distance": F.col("near.c"), "word_distance": F.col("near.w"), "kept": ~F.col("base_failed") & within}
    return unboxed(df, docs, values)
