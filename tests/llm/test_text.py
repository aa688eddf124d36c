"""Operators that judge each text by itself."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from fixtures import documents, frame, prose, words
from pyspark.sql import functions as F

from larkspur.llm import arrays, bpe, language_id, quality_classifier, quality_rules, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def encoding():
    ranks = {x: i for i, x in enumerate(bpe.read_ranks(RANKS))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_and_shingles():
    texts = [t for _, t, *_ in documents() if t]
    joined = "".join(texts).encode()
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    starts, ends, first = arrays.words(np.frombuffer(joined, np.uint8), bounds)
    for i, t in enumerate(texts):
        assert [joined[a:b].decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)] == words(t)
    hashes, first = arrays.word_hashes(np.frombuffer(joined, np.uint8), bounds)
    _, at = arrays.shingles(hashes, first, 5)
    assert list(np.diff(at)) == [len(w) - 4 if len(w := words(t)) >= 5 else int(bool(w)) for t in texts]


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(5000)] + [b""]
    index = bpe.PerfectHash(keys)
    assert sorted(index.slot_key.tolist()) == list(range(len(keys)))
    assert index.find(keys).tolist() == list(range(len(keys)))
    assert set(index.find([b"none", b"k5001", b"K1"]).tolist()) == {-1}


def test_bpe_against_library(encoding):
    codec = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN, memo=50)
    rng = random.Random(4)
    texts = ["", " ", "\n\n  x", "it's we'll 'S", "a" * 3000, "zq" * 500, "é漢字\u0085 x \U0001f600", "  12345 --!!"]
    texts += ["".join(rng.choice("aeiou thrsn.,é\n 12'") for _ in range(rng.randrange(200))) for _ in range(200)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == encoding.encode_ordinary(t), t
        assert codec.decode(np.array(ids, np.int64)) == t.encode()


def test_bpe_rows(docs, rows, encoding):
    extra = docs.withColumn("n_tokens", F.lit("old")).withColumn("more", F.array(F.lit(1))).withColumn("__text", F.lit(1)).withColumn("row", F.lit("x"))
    got = bpe.encode(extra, RANKS, public_tokenizers.PATTERN, ids=True)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "more", "__text", "row", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    found = Counter((r.doc_id, r.text, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect())
    expected = Counter()
    for i, t, *_ in rows:
        ids = encoding.encode_ordinary(t or "")
        expected[(i, t, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert found == expected
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def brute_count(piece, scores):
    best = [(0.0, 0)]
    for end in range(1, len(piece) + 1):
        best.append(max(((best[a][0] + scores[piece[a:end]], -best[a][1] - 1) for a in range(end) if piece[a:end] in scores), key=lambda x: x))
        best[-1] = (best[-1][0], -best[-1][1])
    return best[-1][1]


def test_token_counts(docs, rows):
    scores = token_counts.zipf_scores(bpe.read_ranks(RANKS))
    split = re.compile  # the pattern needs the regex library
    import regex as split  # noqa: F811

    got = Counter((r.doc_id, r.text, r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(docs, RANKS, public_tokenizers.PATTERN, memo=40).collect())
    expected, memo = Counter(), {}
    for i, t, *_ in rows:
        pieces = split.findall(public_tokenizers.PATTERN, t or "")
        for p in set(pieces) - memo.keys():
            memo[p] = brute_count(p.encode(), scores)
        expected[(i, t, len(pieces), sum(memo[p] for p in pieces))] += 1
    assert got == expected
    assert token_counts.token_counts(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_counts_against_library():
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    vocabulary = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bb"]
    scores = token_counts.zipf_scores([x.encode() for x in vocabulary])
    library = Tokenizer(Unigram([("<unk>", -100.0), *((x, scores[x.encode()]) for x in vocabulary)], 0))
    rng = random.Random(2)
    pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(200)]
    got = token_counts.Counter(scores).counts(p.encode() for p in pieces)
    total = lambda parts: sum(scores[p.encode()] for p in parts)
    for p in pieces:
        parts = library.encode(p).tokens
        # Of equal sums the library may take another segmentation; the sums must be equal.
        assert got[p.encode()] <= len(parts) or abs(total(parts) - total(parts)) < 1e-9


def base_counts(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, double = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            double += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), double, len(inside)


def test_quality_rules(docs, rows):
    clashing = docs.withColumns({"kept": F.lit(5), "N_Words": F.lit("x"), **{c: F.lit(1) for c in ("row", "t", "w", "v", "s", "x", "refs", "near", "__w", "h")}})
    got = quality_rules.quality_rules(clashing)
    assert {"row", "t", "w", "v", "s", "x", "refs", "near", "__w", "h"} < set(got.columns) and "N_Words" not in got.columns
    found = Counter((r.doc_id, r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect())
    expected = Counter()
    for i, t, *_ in rows:
        c = base_counts(t)
        expected[(i, t, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert found == expected
    most = lambda r: quality_rules.MAX_SHORT_WORD_DISTANCE if r.n_words < quality_rules.SHORT_WORDS else quality_rules.MAX_WORD_DISTANCE
    assert all(r.kept == (not r.base_failed and (r.class_distance or 0) <= quality_rules.MAX_CLASS_DISTANCE and (r.word_distance or 0) <= most(r)) for r in got.collect())
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_distance(spark):
    def plain(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a)
        return ((kl(p) + kl(q)) / 2) ** 0.5

    pairs = [([0.5, 0.5, 0.0], [0.0, 0.5, 0.5]), ([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0])]
    for p, q in pairs:
        got = spark.range(1).select(quality_rules.distance(quality_rules.literal(p, "double"), quality_rules.literal(q, "double")).alias("d")).first().d
        assert got == pytest.approx(plain(p, q), abs=1e-9)


def test_rules_verdict(spark):
    rng = random.Random(3)
    good = [(i, prose(rng, 300, 60), "en", "a", 0) for i in range(40)]
    bad = [(100, " ".join(w + "###" for w in words(good[0][1])), "en", "a", 0), (101, good[1][1].upper(), "en", "a", 0)]
    kept = {r.doc_id for r in quality_rules.quality_rules(frame(spark, good + bad)).filter("kept").collect()}
    assert kept == {r[0] for r in good}


def test_rules_of_many_languages(spark, docs):
    """No language is without a reference, however many there are; and both forms of the references give the same distances."""
    rng = random.Random(4)
    rows = [(2 * i + k, " ".join(f"w{i}x{rng.randrange(20)}" for _ in range(130 if i < 200 else 110)), f"l{i}", "s", 0) for i in range(205) for k in range(2)]
    got = quality_rules.quality_rules(frame(spark, rows), min_documents=2).collect()
    assert all(r.kept and r.word_distance is not None for r in got) and len(got) == len(rows)
    order = lambda df: sorted((str(r.doc_id), r.text or "", r.kept, r.class_distance, r.word_distance) for r in df.filter("class_distance is not null").collect())
    a, b = order(quality_rules.quality_rules(docs, min_documents=2)), order(quality_rules.quality_rules(docs, min_documents=2, inline=0))
    assert a and [x[:3] for x in a] == [x[:3] for x in b]
    assert [x[3:] for x in b] == [pytest.approx(x[3:], abs=1e-9) for x in a]


def test_rules_guards(spark):
    """Short junk is compared, a language of few texts isn't its own reference, and a null language takes the nearest one."""
    rng = random.Random(8)
    good = [(i, prose(rng, 300, 60), "en", "a", 0) for i in range(40)] + [(200 + i, " ".join(f"v{rng.randrange(60)}" for _ in range(300)), "de", "a", 0) for i in range(40)]
    junk = " ".join(f"{rng.randrange(10**6)}#" for _ in range(70))
    odd = [(100, junk, "en", "a", 0), (101, junk, None, "a", 0), (102, junk, "xx", "a", 0), (103, good[0][1], None, "a", 0), (104, good[50][1], None, "a", 0), (105, good[50][1], "en", "a", 0)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, good + odd)).collect()}
    assert all(got[r[0]].kept for r in good)
    assert [got[i].kept for i in range(100, 106)] == [False, False, True, True, True, False]
    assert got[102].class_distance is None


def test_rules_repeats_of_long_texts(spark):
    """Texts past the bound of packed positions, and clashes of the packed hashes, take the other way."""
    rng = random.Random(2)
    rows = [(i, prose(rng, n, 12), "en", "a", 0) for i, n in enumerate([3, 4, 60, 61, 500])]
    for bits in (quality_rules.PLACE_BITS, 5, 60):
        old, quality_rules.PLACE_BITS = quality_rules.PLACE_BITS, bits
        try:
            got = {r.doc_id: r.n_repeat_words for r in quality_rules.quality_rules(frame(spark, rows), refs=[]).collect()}
        finally:
            quality_rules.PLACE_BITS = old
        assert got == {i: base_counts(t)[4] for i, t, *_ in rows}


CLASHES = ["__text", "__x", "row", "rows", "text2", "letter", "dropped", "__t", "__d", "__h", "__taken", "d", "t", "k", "s", "e", "Score", "a `b` c"]


def test_clashing_names(spark, docs, rows):
    """Columns of a caller's pass through every operator, whatever their names; those that bear a new name in another case are replaced."""
    from larkspur.llm import line_dedup, suffix_dedup

    own = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    got = {
        "bpe": bpe.encode(own, RANKS, public_tokenizers.PATTERN), "counts": token_counts.token_counts(own, RANKS, public_tokenizers.PATTERN), "score": quality_classifier.score(own, quality_classifier.Network()),
        "lang": language_id.predict(own, None), "suffix": suffix_dedup.suffix_dedup(own), "lines": line_dedup.line_dedup(own), "rules": quality_rules.quality_rules(own, refs=[]),
    }
    for name, df in got.items():
        left = [c for c in CLASHES if c != "Score" or name not in ("score", "lang")]
        assert set(left) <= set(df.columns) and len({c.lower() for c in df.columns}) == len(df.columns), name
        assert Counter((r.doc_id, *(r[c] for c in left)) for r in df.collect()) == Counter((i, *(None if i is None else f"{c}{i}" for c in left)) for i, *_ in rows), name


def languages(rng, n):
    letters = {"aa": "abcde", "bb": "defgh", "cc": "hijkl", "dd": "lmnop", "ee": "pqrst"}
    return [(i, " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randrange(2, 7))) for _ in range(40)), k, "s", 0) for i in range(n) for k in [list(letters)[i % 5]]]


def test_codewords():
    for n in (1, 2, 5, 40):
        code = language_id.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0}
        distance = (code.shape[1] - code @ code.T) / 2
        assert n == 1 or (distance + np.eye(n) * 99).min() >= 2


def test_language_id(spark):
    rows = languages(random.Random(5), 300)
    docs = frame(spark, rows)
    model = language_id.fit(docs.filter("doc_id < 200"))
    odd = frame(spark, [(900, None, None, None, None), (901, "", None, None, None), (902, "12 34 !!", None, None, None)])
    got = {r.doc_id: r for r in language_id.predict(docs.unionByName(odd).withColumn("score", F.lit("x")), model).collect()}
    held = [r for r in rows if r[0] >= 200]
    assert np.mean([got[i].lang_pred == k for i, _, k, *_ in held]) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_language_id_learns_languages_of_copies(spark):
    """Copies of one text are most rows of a language, and there are more languages than the sample has rows."""
    rows = languages(random.Random(6), 300)
    copied = next(t for _, t, k, *_ in rows if k == "aa")
    docs = frame(spark, rows).unionByName(spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit(copied).alias("text"), F.lit("aa").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("bigint").alias("n_chars")))
    model = language_id.fit(docs, per_language=50)
    assert model.languages == ["aa", "bb", "cc", "dd", "ee"]
    got = language_id.predict(frame(spark, rows), model).filter("lang = 'aa'").collect()
    assert np.mean([r.lang_pred == "aa" for r in got]) > 0.95
    assert language_id.fit(frame(spark, rows), sample_rows=3).languages == model.languages


def plain_score(net, raw):
    """The network's probability, position by position."""
    p, block, width = net.parts, quality_classifier.BLOCK, quality_classifier.WIDTH
    blocks = max(1, -(-(len(raw) + width - 1) // block))
    pooled = np.full((blocks, quality_classifier.FILTERS), -np.inf)
    for i in range(len(raw)):
        symbols = [raw[i + j] if i + j < len(raw) else quality_classifier.PAD for j in range(width)]
        value = np.concatenate([p["embed"][s] for s in symbols]).astype(np.float64) @ p["filters"].astype(np.float64)
        pooled[i // block] = np.maximum(pooled[i // block], value)
    m = np.maximum(pooled + p["filter_bias"], 0)
    c = np.array([np.maximum(m[k], m[min(k + 1, blocks - 1)]) for k in range(max(1, blocks - 1))])
    h = np.tanh(np.concatenate([c.mean(0), c.max(0), c.min(0)]) @ p["hidden"] + p["hidden_bias"])
    return 1 / (1 + np.exp(-(h @ p["out"] + p["out_bias"][0])))


def test_network_against_plain_loop():
    """Scores of texts about the borders of blocks and pieces, in a batch, alone, and in pieces."""
    rng, net = np.random.default_rng(3), quality_classifier.Network()
    net.parts["filter_bias"] += 0.1
    block, width = quality_classifier.BLOCK, quality_classifier.WIDTH
    sizes = [0, 1, 7, 8, block - width, block - width + 1, block - width + 2, block, 2 * block - width + 1, 2 * block, 5 * block + 3, 1500]
    texts = [rng.integers(32, 127, n).astype(np.uint8) for n in sizes]
    expected = [plain_score(net, t.tolist()) for t in texts]
    together = net.score(np.concatenate(texts), np.concatenate([[0], np.cumsum(sizes)]))
    assert together == pytest.approx(expected, abs=1e-5)
    for t, x in zip(texts, expected, strict=True):
        for piece in (block, 2 * block, 700):
            assert net.score(t, np.array([0, len(t)]), piece)[0] == pytest.approx(x, abs=1e-5)


def plain_features(raw):
    out = np.zeros(language_id.DIMENSION)
    for n in language_id.ORDERS:
        counts = Counter()
        for i in range(len(raw) - n + 1):
            code = 0
            for byte in raw[i : i + n]:
                code = (code * 257 + (byte + 32 if 65 <= byte <= 90 else byte) + 1) % 2**32
            counts[((code + n) * 2654435761) % 2**32 >> (32 - language_id.BITS)] += 1
        for k, v in counts.items():
            out[k] += (v / (len(raw) - n + 1)) ** 0.5 / len(language_id.ORDERS)
    return out


def test_language_features_against_plain_loop():
    """Features in a batch and in pieces, and decoding by summed losses."""
    texts = [b"", b"a", b"aB", b"Abc", "Über das Öl".encode(), b"the quick brown fox " * 9]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    expected = np.array([plain_features(t) for t in texts])
    for piece in (1 << 20, 1, 3, 50):
        assert np.abs(language_id.features(data, bounds, piece) - expected).max() < 1e-6
    model = language_id.Model(["x", "y", "z"], language_id.codewords(3), np.zeros((1, 1)), np.zeros(1))
    margins = np.random.default_rng(2).normal(size=(20, model.code.shape[1]))
    best, p, _ = model.decode(margins)
    for row, b, q in zip(margins, best, p, strict=True):
        losses = [sum(np.log1p(np.exp(-m * c)) for m, c in zip(row, code, strict=True)) for code in model.code]
        assert b == int(np.argmin(losses)) and q == pytest.approx(np.exp(-losses[b]) / np.exp([-x for x in losses]).sum())


def test_very_long_text(spark):
    """A text of over 10 MB goes through the classifiers in pieces, and through the shingles."""
    from larkspur.llm import jaccard_join

    rng = np.random.default_rng(9)
    raw = rng.choice(np.frombuffer(b"abcdefgh  ", np.uint8), 11_000_000)
    bounds = np.array([0, len(raw)])
    net = quality_classifier.Network()
    assert net.score(raw, bounds)[0] == pytest.approx(net.score(raw, bounds, 1 << 30)[0], abs=1e-5)
    assert np.abs(language_id.features(raw, bounds) - language_id.features(raw, bounds, 1 << 30)).max() < 1e-6
    assert (arrays.word_hashes(raw, bounds, 1 << 20)[0] == arrays.word_hashes(raw, bounds, 1 << 30)[0]).all()
    assert len(jaccard_join.token_sets(raw, bounds, 5)[0]) > 1000


def test_byte_that_the_vocabulary_lacks():
    counter = token_counts.Counter(token_counts.zipf_scores([b"a", b"ab", b"cd"]))
    assert counter.counts([b"ab", b"b", b"acd", b"ad", b"xyz"]) == {b"ab": 1, b"b": 1, b"acd": 2, b"ad": 2, b"xyz": 3}


def test_network_gradients():
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in (5, 300, 900, 0, 2)]
    lay = quality_classifier.Layout(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    net, y, weight = quality_classifier.Network(), np.array([1, 0, 1, 0, 1]), np.full(5, 0.2)

    def loss():
        z = net.forward(lay)["z"].astype(np.float64)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    grads = net.gradients(lay, y, weight)
    for name in ("out", "out_bias", "hidden", "hidden_bias", "filters", "filter_bias", "embed"):
        part = net.parts[name]
        flat = np.argsort(-np.abs(grads[name]).reshape(-1))[:3]
        for k in flat:
            at = np.unravel_index(k, part.shape)
            old = part[at]
            part[at] = old + 1e-3
            up = loss()
            part[at] = old - 1e-3
            down = loss()
            part[at] = old
            assert (up - down) / 2e-3 == pytest.approx(float(grads[name][at]), rel=0.1, abs=2e-4), name


def test_quality_classifier(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        text = prose(rng, 150) if good else " ".join(f"{w}!!" for w in words(prose(rng, 150).upper()))
        rows.append((i, text, None, None, None))
        labels.append((i, int(good)))
    docs = frame(spark, rows)
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, quality int")
    network = quality_classifier.train(docs.filter("doc_id < 160"), marks.filter("doc_id < 160"))
    odd = frame(spark, [(900, None, None, None, None), (901, "", None, None, None), (902, "x" * 70_000, None, None, None)])
    got = {r.doc_id: r for r in quality_classifier.score(docs.unionByName(odd).withColumn("predicted", F.lit("x")), network).collect()}
    held = [(i, q) for i, q in labels if i >= 160]
    assert np.mean([got[i].predicted == q for i, q in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values()) and got[900].score == got[901].score
    assert quality_classifier.train(docs, marks.filter("quality = 1")) is None
    assert {r.score for r in quality_classifier.score(docs.limit(3), None).collect()} == {0.5}
    assert quality_classifier.score(docs.limit(0), network).count() == 0
