"""Small documents with every odd case: nulls, empty texts, copies, near copies, long lines, other scripts."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))


def documents(n=60, seed=1):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(20, 160)) for _ in range(n)]
    texts[3] = texts[2]
    near = words(texts[5])
    near[len(near) // 2] = "changed"
    texts[6] = " ".join(near)
    texts += [None, "", "  \n\t ", "one", "one two three", "a b c d e", "a b c d e", "é漢字 Ünï\u0085code \U0001f600 tést " * 30]
    lines = [prose(rng, 8) for _ in range(6)]
    texts += ["\n".join(lines), "\n".join([lines[2], lines[0] + " more", "", lines[1].replace("w1", "w9", 1), lines[3]]), "\n".join(lines[4:] + lines[4:])]
    passage = prose(rng, 120)
    texts += [prose(rng, 60) + " " + passage + " " + prose(rng, 60) for _ in range(6)]
    texts += ["spam " * 300, "repeat me now " * 80, prose(rng, 3000)]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4], None) for i, t in enumerate(texts)]
    # Repeated rows, a repeated id with another text, and a null id.
    rows += [rows[2], rows[2], (1, "another text for an id that is there already " * 4, "en", "a", 1), (None, texts[10], None, None, None)]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)
