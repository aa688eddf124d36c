"""Language identification by error-correcting output codes.

Each language has a codeword of bits; one binary classifier per bit (logistic regression on hashed byte n-gram frequencies) predicts
whether a text's language has that bit set. Decoding adds each bit's logistic loss under every codeword and chooses the language of
least loss, so that wrong bits are outvoted; a text whose two best codewords are near is flagged as ambiguous.

The classifiers are fitted on a bounded sample, the `per_language` different texts of least digest of each language within `sample_rows` in all,
whose features (not texts) come to the driver. Prediction is one pass over the rows, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.arrays import chunks, utf8
from larkspur.llm.columns import boxed, mapped, quoted
from larkspur.llm.store import cut, drop

ORDERS, BITS = (2, 3, 4), 12
DIMENSION = 1 << BITS
PER_LANGUAGE, SAMPLE_ROWS = 1000, 12_000
AMBIGUOUS = 0.2
#: Bytes that are counted at once.
PIECE = 1 << 20
LOWER = np.arange(256, dtype=np.uint32)
LOWER[65:91] += 32


def features(data: np.ndarray, bounds: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Rows of root n-gram frequencies (unit length for each order), hashed to DIMENSION columns; n-grams never cross rows.

    Bytes are taken in pieces, which share max(ORDERS) - 1 bytes with the next: an n-gram counts where it begins.
    """
    rows, reach = len(bounds) - 1, max(ORDERS) - 1
    length = np.diff(bounds)
    counts = {n: np.zeros((rows, DIMENSION), np.int64) for n in ORDERS}
    for a in range(0, len(data), piece):
        b = min(len(data), a + piece)
        low = LOWER[data[a : b + reach]]
        row = np.searchsorted(bounds, np.arange(a, b), "right") - 1
        to_end = bounds[1:][row] - np.arange(a, b)
        code = np.zeros(b - a, np.uint32)
        for n in range(1, reach + 2):
            m = min(b - a, len(low) - n + 1)
            if m <= 0:
                break
            code[:m] = code[:m] * np.uint32(257) + low[n - 1 : n - 1 + m] + np.uint32(1)
            if n in ORDERS:
                ok = to_end >= n
                bucket = ((code[ok] + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
                counts[n] += np.bincount(row[ok] * DIMENSION + bucket, minlength=rows * DIMENSION).reshape(rows, DIMENSION)
    out = np.zeros((rows, DIMENSION), np.float32)
    for n in ORDERS:
        out += np.sqrt(counts[n] / np.maximum(length - n + 1, 1)[:, None]).astype(np.float32)
    return out / np.float32(len(ORDERS))


def codewords(languages: int, bits: int | None = None, seed: int = 11, draws: int = 200) -> np.ndarray:
    """A matrix of +1 and -1, a row per language: of seeded draws, the one whose nearest rows (and columns, which must split the languages) differ most."""
    bits = bits or max(8, int(np.ceil(10 * np.log2(max(languages, 2)))))
    rng, best, found = np.random.default_rng(seed), -1, None
    for _ in range(draws):
        m = rng.choice([-1.0, 1.0], (languages, bits))
        if languages > 1:
            flat = np.abs(m.sum(0)) == languages
            m[rng.integers(languages), flat] *= -1
        apart = bits if languages < 2 else int(((bits - m @ m.T) / 2 + bits * np.eye(languages)).min())
        if apart > best:
            best, found = apart, m
    return found


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its probability and whether the runner-up is near, for rows of bit margins."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        ordered = np.sort(p, 1)
        near = ordered[:, -1] - ordered[:, -2] < AMBIGUOUS if p.shape[1] > 1 else np.zeros(len(p), bool)
        return best, p[np.arange(len(p)), best], near

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.decode(x @ self.weights + self.bias)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 150, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Fits all bits' classifiers at once by Adam on the whole sample; each language weighs the same."""
    code = codewords(len(languages))
    target = (code[y] > 0).astype(np.float32)
    weight = (1 / np.bincount(y, minlength=len(languages)).clip(1))[y][:, None].astype(np.float32)
    weight /= weight.sum()
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    moments = [np.zeros_like(v) for v in (w, b, w, b)]
    for t in range(1, steps + 1):
        error = (1 / (1 + np.exp(-(x @ w + b))) - target) * weight
        for k, (value, grad) in enumerate(((w, x.T @ error + decay * w), (b, error.sum(0)))):
            moments[k] = 0.9 * moments[k] + 0.1 * grad
            moments[k + 2] = 0.999 * moments[k + 2] + 0.001 * grad * grad
            value -= rate * (moments[k] / (1 - 0.9**t)) / (np.sqrt(moments[k + 2] / (1 - 0.999**t)) + 1e-8)
    return Model(languages, code, w, b)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of the rows with text and language; None without such rows. The sample is by digest of the text, so it's the same for the same rows.

    Copies of a text count once, so a language has all its different texts in the sample, or the `most` of least digest, however often one of them
    is repeated. On the driver there are a digest for each language and the sample's features: languages are a closed list, each with a codeword.
    """
    rows = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang is not null and text is not null and text <> ''")
    keys = cut(rows.select("lang", F.xxhash64("text").alias("h")).distinct())
    found = keys.select("lang").distinct().count()
    if not found:
        drop(keys)
        return None
    most = max(1, min(per_language, sample_rows // found))
    # No task ranks all texts of a language: the least of each salt first, then the least of those.
    least = lambda df, *by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("k") <= most)
    limits = least(least(keys.withColumn("salt", F.pmod("h", F.lit(64))), "lang", "salt"), "lang").groupBy("lang").agg(F.max("h").alias("h")).collect()
    drop(keys)
    limit = F.element_at(F.create_map(*(F.lit(v) for r in limits for v in (r["lang"], r["h"]))), F.col("lang"))
    sample = rows.filter(F.xxhash64("text") <= limit).distinct()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in chunks(batches, "text"):
            x = features(data, bounds)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("lang")), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], names=["lang", "x"])

    got = sorted(((r["lang"], bytes(r["x"])) for r in sample.mapInArrow(vectors, "lang string, x binary").collect()))
    languages = sorted({r[0] for r in got})
    if not languages:
        return None
    x = np.stack([np.frombuffer(r[1], np.float16) for r in got]).astype(np.float32)
    return train(x, np.array([languages.index(r[0]) for r in got]), languages)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1) and ambiguous to each row, from its whole text.

    Text that is null or has no letter is `und` with score 0, not ambiguous; so is every text if there was nothing to learn from. Rows are
    independent, so repeated rows and ids, and null in any other column, change nothing; columns that bear one of the new names, in any case, are replaced, and
    others stay whatever their names. A very long text is counted in pieces of PIECE bytes.
    """
    added = {"lang_pred": "string", "score": "double", "ambiguous": "boolean"}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = boxed(docs, added, F.col(quoted(text)).alias("text"), F.coalesce(F.col(quoted(text)).rlike(r"\p{L}"), F.lit(False)).alias("letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        own = shared.value
        for part, data, bounds in chunks(batches, "text", 1 << 19):
            for i in range(0, part.num_rows, 1024):
                rows = part.slice(i, 1024)
                at = bounds[i : i + rows.num_rows + 1]
                known = rows.column(rows.schema.get_field_index("letter")).to_numpy(zero_copy_only=False).astype(bool)
                if own is None:
                    names, score, near = ["und"] * rows.num_rows, np.zeros(rows.num_rows), np.zeros(rows.num_rows, bool)
                else:
                    best, score, near = own.predict(features(data[at[0] : at[-1]], at - at[0]))
                    names = [own.languages[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
                yield rows, [pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64()), pa.array(near & known, pa.bool_())]

    return mapped(source, docs, added, run)


__all__ = ["Model", "codewords", "features", "fit", "predict", "train", "utf8"]
