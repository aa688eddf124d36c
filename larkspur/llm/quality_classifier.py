"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded and convolved with learned filters at every position, so the whole text is seen whatever its length. The
filters' outputs (rectified) are max-pooled over blocks of BLOCK positions, and neighbouring blocks form the overlapping chunks;
the mean, greatest and least pooled value of each filter over a text's chunks go through one hidden layer to one probability.

The network is fitted on the driver on a bounded sample of labelled rows, whole texts: about `per_class` of each label by digest order, and of those as many
as come to `sample_bytes` in the same order; scoring is one pass over whole texts without a shuffle, in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from larkspur.llm.arrays import chunks
from larkspur.llm.columns import boxed, mapped, quoted

WIDTH, EMBEDDING, FILTERS, HIDDEN, BLOCK = 8, 6, 24, 16, 256
#: Labelled rows of each label that the network is fitted on at most, and bytes of texts that come to the driver at most.
PER_CLASS, SAMPLE_BYTES = 1500, 64 << 20
PAD = 256
#: Positions that are convolved at once.
STEP = 1 << 15
#: Bytes of one text that are laid out at once.
PIECE = 1 << 22


class Layout:
    """Texts of a batch, each padded to whole blocks with room for the filters' width, and its blocks and chunks."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, blocks: int | None = None):
        """blocks: of a piece of one text, whose bytes past them are only what the last block's filters reach into."""
        length = np.diff(bounds)
        self.blocks = (length + WIDTH - 1 + BLOCK - 1) // BLOCK if blocks is None else np.array([blocks])
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])
        self.symbols = np.full(self.first[-1] * BLOCK + WIDTH, PAD, np.int16)
        at = np.arange(len(data)) + np.repeat(self.first[:-1] * BLOCK - bounds[:-1], length)
        self.symbols[at] = data
        self.inside = np.zeros(self.first[-1] * BLOCK, bool)
        self.inside[at[at < len(self.inside)]] = True
        self.chunks = np.maximum(self.blocks - 1, 1)
        self.first_chunk = np.concatenate([[0], np.cumsum(self.chunks)])
        self.left = np.arange(self.first_chunk[-1]) + np.repeat(self.first[:-1] - self.first_chunk[:-1], self.chunks)
        self.right = self.left + np.repeat(self.blocks > 1, self.chunks)


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.parts = {
            "embed": normal(257, EMBEDDING, by=0.5),
            "filters": normal(WIDTH * EMBEDDING, FILTERS, by=(WIDTH * EMBEDDING) ** -0.5),
            "filter_bias": np.zeros(FILTERS, np.float32),
            "hidden": normal(3 * FILTERS, HIDDEN, by=(3 * FILTERS) ** -0.5),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, by=HIDDEN**-0.5),
            "out_bias": np.zeros(1, np.float32),
        }
        self.parts["embed"][PAD] = 0

    def pooled(self, lay: Layout, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each block's greatest output of each filter and, if asked for, its place in the block."""
        p, n = self.parts, lay.first[-1]
        values, places = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if where else None
        for a in range(0, n, STEP // BLOCK):
            b = min(n, a + STEP // BLOCK)
            x = p["embed"][lay.symbols[a * BLOCK : b * BLOCK + WIDTH - 1]].reshape(-1)
            rows = (b - a) * BLOCK
            windows = np.lib.stride_tricks.as_strided(x, (rows, WIDTH * EMBEDDING), (EMBEDDING * 4, 4))
            y = np.ascontiguousarray(windows) @ p["filters"]
            y[~lay.inside[a * BLOCK : b * BLOCK]] = -np.inf
            y = y.reshape(b - a, BLOCK, FILTERS)
            if where:
                places[a:b] = y.argmax(1)
                values[a:b] = np.take_along_axis(y, places[a:b, None], 1)[:, 0]
            else:
                values[a:b] = y.max(1)
        return np.maximum(values + p["filter_bias"], 0), places

    def forward(self, lay: Layout, where: bool = False) -> dict[str, np.ndarray]:
        p = self.parts
        m, places = self.pooled(lay, where)
        c = np.maximum(m[lay.left], m[lay.right])
        at, n = lay.first_chunk[:-1], lay.chunks[:, None].astype(np.float32)
        top, low = np.maximum.reduceat(c, at), np.minimum.reduceat(c, at)
        x = np.concatenate([np.add.reduceat(c, at) / n, top, low], 1)
        h = np.tanh(x @ p["hidden"] + p["hidden_bias"])
        return {"m": m, "places": places, "c": c, "x": x, "h": h, "z": h @ p["out"] + p["out_bias"][0]}

    def score(self, data: np.ndarray, bounds: np.ndarray, piece: int = PIECE) -> np.ndarray:
        if len(bounds) < 2:
            return np.zeros(0)
        if len(bounds) == 2 and len(data) > piece:
            return self.score_long(data, piece)
        return 1 / (1 + np.exp(-self.forward(Layout(data, bounds))["z"].astype(np.float64)))

    def score_long(self, data: np.ndarray, piece: int) -> np.ndarray:
        """One text's score from pieces of whole blocks, whose layouts are bounded: a piece ends with the bytes that its last block's filters reach into, and
        with one block more, for the chunk that spans the border; what is kept of a piece are its chunks' sums and extremes."""
        size = max(1, piece // BLOCK)
        blocks = (len(data) + WIDTH - 1 + BLOCK - 1) // BLOCK
        total, top, low, chunks_ = np.zeros(FILTERS, np.float64), np.full(FILTERS, -np.inf, np.float32), np.full(FILTERS, np.inf, np.float32), 0
        for a in range(0, blocks - 1, size):
            b = min(blocks, a + size + 1)
            part = data[a * BLOCK : min(len(data), b * BLOCK + WIDTH - 1)]
            m, _ = self.pooled(Layout(part, np.array([0, len(part)]), blocks=b - a))
            c = np.maximum(m[:-1], m[1:])
            total += c.sum(0, dtype=np.float64)
            top, low, chunks_ = np.maximum(top, c.max(0)), np.minimum(low, c.min(0)), chunks_ + len(c)
        x = np.concatenate([total / chunks_, top, low])[None].astype(np.float32)
        h = np.tanh(x @ self.parts["hidden"] + self.parts["hidden_bias"])
        return 1 / (1 + np.exp(-(h @ self.parts["out"] + self.parts["out_bias"][0]).astype(np.float64)))

    def gradients(self, lay: Layout, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.parts, self.forward(lay, True)
        g: dict[str, np.ndarray] = {}
        dz = ((1 / (1 + np.exp(-f["z"])) - y) * weight).astype(np.float32)
        g["out"], g["out_bias"] = f["h"].T @ dz, dz.sum(keepdims=True)
        dh = dz[:, None] * p["out"] * (1 - f["h"] ** 2)
        g["hidden"], g["hidden_bias"] = f["x"].T @ dh, dh.sum(0)
        dx = dh @ p["hidden"].T
        doc = np.repeat(np.arange(len(y)), lay.chunks)
        dc = dx[doc, :FILTERS] / lay.chunks[doc, None]
        for k in (1, 2):
            hit = (f["c"] == f["x"][doc, k * FILTERS : (k + 1) * FILTERS]).astype(np.float32)
            hit /= np.maximum(np.add.reduceat(hit, lay.first_chunk[:-1]), 1)[doc]
            dc += dx[doc, k * FILTERS : (k + 1) * FILTERS] * hit
        dm = np.zeros_like(f["m"])
        block = np.where(f["m"][lay.left] >= f["m"][lay.right], lay.left[:, None], lay.right[:, None])
        np.add.at(dm, (block, np.arange(FILTERS)[None]), dc)
        dm *= f["m"] > 0
        g["filter_bias"] = dm.sum(0)
        symbols = lay.symbols[(np.arange(len(dm)) * BLOCK)[:, None, None] + f["places"][..., None] + np.arange(WIDTH)]
        x = p["embed"][symbols].reshape(len(dm), FILTERS, WIDTH * EMBEDDING)
        g["filters"] = np.einsum("bf,bfk->kf", dm, x)
        de = (dm[..., None] * p["filters"].T[None]).reshape(-1, EMBEDDING)
        g["embed"] = np.stack([np.bincount(symbols.reshape(-1), de[:, k], 257) for k in range(EMBEDDING)], 1).astype(np.float32)
        g["embed"][PAD] = 0
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 6, steps: int = 400, batch: int = 32, rate: float = 0.01, seed: int = 3) -> Network:
        """Adam over shuffled batches, for `epochs` and `steps` at least; both labels weigh the same in all."""
        rng, t = np.random.default_rng(seed), 0
        epochs = max(epochs, -(-steps * batch // max(1, len(texts))))
        share = np.bincount(labels, minlength=2).clip(1) / len(labels)
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.parts.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                own, t = order[i : i + batch], t + 1
                joined = np.frombuffer(b"".join(texts[k] for k in own), np.uint8)
                bounds = np.concatenate([[0], np.cumsum([len(texts[k]) for k in own])])
                y = labels[own]
                grads = self.gradients(Layout(joined, bounds), y, 0.5 / share[y] / len(own))
                step = rate * (0.3 if epoch >= epochs - 2 else 1)
                for k, g in grads.items():
                    a, b = moments[k]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    self.parts[k] -= step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Network | None:
    """The network fitted on rows whose label is 0 or 1; None if either is missing.

    Rows with a null label, key or text take no part. A key gives a row for each of its labels; of its texts it has the shortest. The sample is at
    most some 2 * per_class rows and sample_bytes bytes; a text that is longer than what is left of the bound of its label is passed over, never cut.
    """
    marked = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).filter("y in (0, 1) and k is not null").distinct()
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    rank = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))
    # About per_class rows of each label: that bounds what is broadcast.
    sample = marked.filter(rank < share)
    texts = docs.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).alias("text")).filter("text is not null")
    found = texts.join(F.broadcast(sample), "k")
    # Whole texts, but no more of them than the driver may hold: sizes first, then the rows under the bound, of either label in the same order.
    sizes = sorted((r["o"], r["y"], r["k"], r["b"]) for r in found.groupBy("k", "y").agg(F.min(F.octet_length("text")).alias("b"), F.min(F.xxhash64("k")).alias("o")).collect())
    use, left = [], {0: sample_bytes // 2, 1: sample_bytes // 2}
    for _, y, k, b in sizes:
        if b <= left[y]:
            left[y] -= b
            use.append(k)
    chosen = docs.sparkSession.createDataFrame([(k,) for k in sorted(set(use))], StructType([StructField("k", sample.schema["k"].dataType)]))
    least = F.min(F.struct(F.octet_length("text").alias("n"), F.encode("text", "utf-8").alias("b")))
    got = found.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(least.alias("t")).collect()
    rows = sorted((r["k"], r["y"], bytes(r["t"]["b"])) for r in got)
    y = np.array([r[1] for r in rows], np.int64)
    return Network().fit([r[2] for r in rows], y) if len(set(y.tolist())) == 2 else None


def score(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """Adds score (probability of label 1) and predicted (1 from 0.5) to each row, from its whole text.

    Null text is empty; an empty text has a score like any other. Without a network every score is 0.5. Rows are independent, so repeated rows
    and ids, and null in any other column, change nothing; columns that bear one of the new names, in any case, are replaced, and others stay whatever their
    names. A text of more than PIECE bytes goes through in pieces that share the bytes at their borders: its score is what it would be in one piece.
    """
    added = {"score": "double", "predicted": "int"}
    shared = docs.sparkSession.sparkContext.broadcast(network)
    source = boxed(docs, added, F.col(quoted(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        own = shared.value
        for part, data, bounds in chunks(batches, "text"):
            p = own.score(data, bounds) if own else np.full(part.num_rows, 0.5)
            yield part, [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())]

    return mapped(source, docs, added, run)
