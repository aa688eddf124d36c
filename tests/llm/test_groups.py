"""Operators that compare rows, against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import documents, frame, prose, words
from pyspark.sql import functions as F

from larkspur.llm import embedding_dedup, graph, jaccard_join, line_dedup, mixing, suffix_dedup


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def roots(n, pairs):
    forest = graph.Forest(n)
    for a, b in pairs:
        forest.join(a, b)
    return [forest.find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    names = sorted({x for e in edges for x in e})
    number = {x: i for i, x in enumerate(names)}
    expected = roots(len(names), [(number[a], number[b]) for a, b in edges])
    assert {x: got.get(x, x) for x in names} == {x: names[expected[number[x]]] for x in names}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Line dedup


def near(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < line_dedup.MIN_WORDS or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_lines(spark, rows):
    """Dropped lines of each (id, text), by comparing every line with all earlier ones."""
    digest = dict(spark.createDataFrame([(t,) for t in {r[1] for r in rows}], "t string").select("t", F.xxhash64("t")).collect())
    names = sorted({(i is None, i or 0, digest[t], t or "", t is None) for i, t, *_ in rows})
    before, dropped = [], {}
    for none, i, _, t, null in names:
        out = []
        for n, line in enumerate(t.split("\n")):
            w = words(line)
            if w:
                if any(near(w, x) for x in before):
                    out.append(n)
                before.append(w)
        dropped[(None if none else i, None if null else t)] = out
    return dropped


def test_line_dedup(spark, docs, rows):
    dropped = brute_lines(spark, rows)
    got = line_dedup.line_dedup(docs.withColumn("n_lines", F.lit("x")).withColumn("more", F.lit(1)))
    expected = Counter()
    for i, t, *_ in rows:
        d = dropped[(i, t)]
        lines = (t or "").split("\n")
        left = None if t is None else "\n".join(x for n, x in enumerate(lines) if n not in d)
        expected[(i, left, len(lines), len(d))] += 1
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == expected
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_many_variants(spark):
    """A large group of lines that differ in one word, words that repeat, and one very long line."""
    rng = random.Random(9)
    base = words(prose(rng, 12))
    lines = [" ".join(base[:4] + [f"x{k}"] + base[5:]) for k in range(60)]
    lines += ["a a a a a a", "a a a a a", "b a a a a a", "a a a a a b", "a a b a a a", " ".join(base[::-1]), "one two", "one two", "one three"]
    long = words(prose(rng, 2500))
    lines += [" ".join(long), " ".join(long[:1200] + long[1201:]), " ".join(long[:7] + ["new"] + long[7:])]
    rng.shuffle(lines)
    rows = [(k, "\n".join(lines[k::7]), None, None, None) for k in range(7)]
    dropped = brute_lines(spark, rows)
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got == {i: len(dropped[(i, t)]) for i, t, *_ in rows}


# Jaccard join


def brute_jaccard(rows, k=5, similarity=0.8):
    sets = []
    for _, t, *_ in rows:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    n = len(rows)
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9]
    links = Counter(x for p in pairs for x in p)
    group = roots(n, pairs)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[group[i]].append(r[0])
    lowest = lambda ids: min((x for x in ids if x is not None), default=None)
    same = [lowest([rows[j][0] for j in range(n) if sets[j] == sets[i]]) if sets[i] else rows[i][0] for i in range(n)]
    return Counter((rows[i][0], same[i], links[i], lowest(least[group[i]])) for i in range(n)), group


@pytest.mark.parametrize("options", [{}, {"small": 2, "tile": 3}, {"small": 4, "tile": 8, "depth": 2}])
def test_jaccard_join(spark, rows, options):
    rng = random.Random(8)
    base = words(prose(rng, 150))
    group = [(500 + i, " ".join(base[: 3 * i] + [f"v{i}"] + base[3 * i + 1 :]), None, None, None) for i in range(25)]
    more = rows + group
    expected, groups = brute_jaccard(more)
    got = jaccard_join.jaccard_join(frame(spark, more), **options).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.component_id) for r in got) == expected
    kept = Counter(r.component_id for r in got if r.kept and r.n_links)
    assert set(kept) == {r.component_id for r in got if r.n_links}


def test_jaccard_empty(docs):
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0
    assert jaccard_join.runs_for(0.9999, 4) > jaccard_join.runs_for(0.9, 4) >= 1


def test_sets():
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 1 << 48, 500).astype(np.uint64))
    assert (jaccard_join.unpack(jaccard_join.pack(x)) == x).all()


# Embeddings


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(260):
        if i % 3 == 0 and rows:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(0, 0.03, 16)
        else:
            v = rng.normal(0, 1, 16)
        rows.append((i, v.tolist(), i % 4))
    rows = [(i, v, label) for i, v, label in rows]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], None), (303, None, 0), (304, [], 0), (305, [0.0] * 16, 0), (306, [float("nan")] * 16, 0), (307, [1.0, None] * 8, 0), (308, [float("inf")] + [1.0] * 15, 0), (None, rows[1][1], 1), (310, rows[0][1][:5], 0), rows[0]]
    return rows


@pytest.mark.parametrize("tile", [8, 2048])
def test_embedding_dedup(spark, tile):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    data = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in data]
    n, pairs = len(data), []
    for a in range(n):
        for b in range(a + 1, n):
            if ok[a] and ok[b] and data[a][2] == data[b][2] and len(data[a][1]) == len(data[b][1]):
                x, y = np.array(data[a][1], float), np.array(data[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    pairs.append((a, b))
    links, group = Counter(x for p in pairs for x in p), roots(n, pairs)
    least = defaultdict(list)
    for i in range(n):
        if data[i][0] is not None:
            least[group[i]].append(data[i][0])
    expected = Counter((data[i][0], links[i], min(least[group[i]], default=None)) for i in range(n))
    got = embedding_dedup.embedding_dedup(df, tile=tile).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_collisions():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(30, 9)), rng.normal(size=(50, 9))
    expected = (np.abs(a[:, None] - b[None]) <= 0.4).sum(2)
    assert (embedding_dedup.collisions(a, b, 0.4) == expected).all()


# Suffix dedup


def brute_suffix(rows, length):
    raw = [(t or "").encode() for _, t, *_ in rows]
    times = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = Counter()
    for (i, *_), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if times[b[p : p + length]] > 1:
                gone[p : p + length] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left)] += 1
    return out


@pytest.mark.parametrize(("length", "gram", "hot"), [(400, 64, 50_000), (50, 16, 50_000), (60, 20, 2)])
def test_suffix_dedup(spark, rows, length, gram, hot):
    more = [*rows, (700, "ab" * 600, None, None, None), (701, "x" + "ab" * 450, None, None, None), (702, "é" * 500, None, None, None)]
    df = frame(spark, more).withColumn("n_bytes", F.lit("x"))
    got = suffix_dedup.suffix_dedup(df, length=length, gram=gram, hot=hot, kept=True)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got.collect()) == brute_suffix(more, length)
    assert all(r.repeats == (r.n_removed > 0) and (r.repeats or r.n_kept_chars == len(r.text or "")) for r in got.collect())


def test_suffix_segments(spark, monkeypatch):
    """A text longer than a segment gives what it would in one piece."""
    rng = random.Random(6)
    long, part = prose(rng, 900), prose(rng, 100)
    rows = [(1, long[:2000] + part + long[2000:], None, None, None), (2, prose(rng, 30) + part, None, None, None)]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    data = np.frombuffer(rows[0][1].encode(), np.uint8)
    whole = suffix_dedup.spans(data, np.array([0, len(data)]), 100, 20)
    assert len(whole[0]) > 3
    got = suffix_dedup.suffix_dedup(frame(spark, rows), length=100, gram=20, kept=True)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got.collect()) == brute_suffix(rows, 100)


def test_suffix_empty(docs):
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


def test_column_wise():
    rng = random.Random(2)
    strings, left = [], []
    for _ in range(60):
        n = rng.randrange(5, 9)
        body = "".join(rng.choice("ab") for _ in range(n)) + "GG" + "".join(rng.choice("ab") for _ in range(rng.randrange(5, 9)))
        strings.append(body.encode())
        left.append(n)
    got = suffix_dedup.repeated(strings, np.array(left), 10, 2)
    for i, (s, a) in enumerate(zip(strings, left, strict=True)):
        for d in range(9):
            p = a - d
            part = s[p : p + 10] if p >= 0 and p + 10 <= len(s) else None
            expected = part is not None and any(j != i and left[j] >= d and strings[j][left[j] - d : left[j] - d + 10] == part for j in range(len(strings)))
            assert got[i, d] == expected


# Mixing


def test_targets():
    from fractions import Fraction

    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [Fraction(5), Fraction(10), Fraction(15)]
    got = mixing.targets([1, 1000, 0, 10], [1, 2, 3, 1])
    assert got[0] == 3 and got[2] == 0 and got[3] == 30 and sum(got) == 1011
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []


def brute_mix(rows, block, step=mixing.GOLDEN):
    """Each row's (id, size, taken, first slot, slots), by walking the schedule slot by slot; and the sources' names, sizes and targets."""
    groups = defaultdict(list)
    for i, t, _, s, _ in rows:
        groups[s].append((hashlib.md5("|".join([str(mixing.SEED), *([] if i is None else [str(i)]), *([] if t is None else [t])]).encode()).hexdigest(), i, len(words(t))))
    names = sorted((s for s in groups if s is not None), key=str.encode) + [None] * (None in groups)
    sizes = [sum(x[2] for x in groups[s]) for s in names]
    goal = mixing.targets(sizes, [k % 3 + 1 for k in range(len(names))])
    blocks, due, part = [], [], []
    for z, g in zip(sizes, goal, strict=True):
        take, n = int(g), -(-z // block)
        blocks.append(n)
        due.append(take // z * n + -(-(take % z) // block) if z else 0)
        part.append(take % z % block if z else 0)
    total, tops = sum(due), []
    for k in range(len(names)):
        tops.append((sum(due[: k + 1]) << 64) // max(1, total))
    order, seen = [], Counter()
    for i in range(total):
        k = next(k for k, top in enumerate(tops) if i * step % 2**64 < top)
        order.append(k)
        r, seen[k] = seen[k], seen[k] + 1
        if r < 3 * blocks[k]:
            groups.setdefault((k, "slots"), []).append((r % blocks[k], part[k] if r == due[k] - 1 and part[k] else block, i))
    out = Counter()
    for k, s in enumerate(names):
        at = 0
        for h, i, n in sorted(groups[s], key=lambda x: (x[0], x[1] if x[1] is not None else -1)):
            hits = [(min(at + n, b * block + w) - max(at, b * block), place) for b, w, place in groups.get((k, "slots"), [])]
            hits = [x for x in hits if x[0] > 0 and n]
            out[(i, n, sum(x[0] for x in hits), min((x[1] for x in hits), default=None), len(hits))] += 1
            at += n
    return out, names, sizes, goal, order, due


@pytest.mark.parametrize(("block", "step"), [(4, mixing.GOLDEN), (64, mixing.GOLDEN), (8, 0x5851F42D4C957F2D)])
def test_mixing(docs, rows, block, step):
    expected, names, sizes, goal, _, _ = brute_mix(rows, block, step)
    got = mixing.mix(docs, block=block, step=step).collect()
    assert Counter((r.doc_id, r.size, r.taken, r.first_slot, r.n_slots) for r in got) == expected
    of = dict(zip(names, zip(sizes, map(float, goal), strict=True), strict=True))
    assert Counter((r.doc_id, r.source_size, r.target) for r in got) == Counter((i, *of[s]) for i, _, _, s, _ in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    again = mixing.mix(docs.repartition(7), block=block, step=step).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixing_follows_the_schedule(docs, rows):
    """Another sequence takes other words; the golden ratio's are near each target, and near the shares in every stretch."""
    mine, names, sizes, goal, order, due = brute_mix(rows, 8)
    other = brute_mix(rows, 8, 0x5851F42D4C957F2D)[0]
    assert mine != other
    assert Counter((r.doc_id, r.size, r.taken, r.first_slot, r.n_slots) for r in mixing.mix(docs, block=8).collect()) == mine
    taken = defaultdict(int)
    for r in mixing.mix(docs, block=8).collect():
        taken[r.source_size, r.target] += r.taken
    assert all(abs(taken[z, float(g)] - g) <= 4 * 8 for z, g in zip(sizes, goal, strict=True))
    total = sum(due)
    for width in (50, 200):
        for a in range(0, total - width, 37):
            counts = Counter(order[a : a + width])
            assert all(abs(counts[k] - width * due[k] / total) <= 4 for k in range(len(names)))


def test_running(spark):
    rng = random.Random(3)
    data = [(s, i, rng.randrange(9)) for s in range(3) for i in range(0, 5000, 1 + s)]
    got = {(r.s, r.i): r.off for r in mixing.running(spark.createDataFrame(data, "s bigint, i bigint, n bigint"), "i").collect()}
    before = Counter()
    for s, i, n in data:
        assert got[s, i] == before[s]
        before[s] += n


def test_mixing_empty(docs):
    assert mixing.mix(docs.limit(0)).count() == 0
