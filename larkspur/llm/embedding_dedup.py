"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Unit vectors are projected on PROJECTIONS random directions. Along each the vectors are sorted, and a query's window holds those whose
projection is within WINDOW deviations of a pair at the similarity. Two vectors at the similarity are in one another's windows with a known
probability, so the count of common windows that all but 1 - recall of such pairs reach is a binomial quantile (`least_count`); pairs that reach it are
verified by their cosine in double precision.

Equal vectors of a label are one class with a weight. The first GRID projections also deal the vectors to cells as wide as nearly all pairs at the
similarity differ by, so that a pair is in one cell or two adjacent ones. Cells of more than `tile` vectors are cut into tiles; each pair of tiles
is compared in one task, which gives each vector's number of links and a spanning forest, never a list of pairs. The vectors of a label
that aren't spread out along the grid's directions still meet in a few cells, where the comparisons grow with the square of their number.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.graph import by_group, components, grouped, spread
from larkspur.llm.store import cut, drop

SIMILARITY, RECALL = 0.93, 0.9999
PROJECTIONS, WINDOW, GRID, GRID_WIDTH = 64, 1.5, 2, 4.2
TILE = 2048


def least_count(projections: int, window: float, recall: float) -> int:
    """The greatest number of collisions that a pair at the similarity reaches with a probability of `recall` or more."""
    p, below = math.erf(window / math.sqrt(2)), 0.0
    for k in range(projections + 1):
        below += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > 1 - recall:
            return k
    return projections


def directions(dimension: int, projections: int, seed: int = 23) -> np.ndarray:
    """Random unit directions, scaled so that random unit vectors' projections have deviation 1."""
    x = np.random.default_rng([seed, dimension]).standard_normal((projections, dimension))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * math.sqrt(dimension)


def collisions(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    """For all rows of a and b in how many projections b is in a's window: by ranks in each sorted projection."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for k in range(a.shape[1]):
        order = np.argsort(b[:, k])
        ranks = np.empty(len(b), np.uint16)
        ranks[order] = np.arange(len(b), dtype=np.uint16)
        ordered = b[order, k]
        low = np.searchsorted(ordered, a[:, k] - width, "left")
        high = np.searchsorted(ordered, a[:, k] + width, "right")
        out += (ranks[None] - low[:, None].astype(np.uint16)) < (high - low)[:, None].astype(np.uint16)
    return out


def prepared(vectors: DataFrame, similarity: float) -> DataFrame:
    """Rows (vec_id, label, dim, fp, unit, cell); fp is null for a vector that links with nothing."""
    width = GRID_WIDTH * math.sqrt(max(0.0, 2 - 2 * similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = []
            for label, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                v = np.array(x.as_py(), np.float64) if label is not None and x.is_valid and not x.values.null_count else np.zeros(0)
                with np.errstate(all="ignore"):
                    top = np.abs(v).max() if len(v) else 0.0
                    unit = v / top if np.isfinite(top) and top > 0 else np.zeros(0)
                if not len(unit):
                    rows.append((None, None, None, None))
                    continue
                unit = unit / np.linalg.norm(unit)
                grid = known.setdefault(len(v), directions(len(v), PROJECTIONS)[:GRID])
                cell = np.floor(grid @ unit / max(width, 1e-9)).astype(np.int64)
                rows.append((len(v), hashlib.blake2b(v.tobytes(), digest_size=16).digest(), unit.tobytes(), cell.tolist()))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            columns = [pa.array([r[i] for r in rows], kinds[i]) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["vec_id", "label", "dim", "fp", "unit", "cell"])

    return vectors.mapInArrow(run, "vec_id bigint, label bigint, dim bigint, fp binary, unit binary, cell array<bigint>")


def jobs(rows: DataFrame, tile: int) -> DataFrame:
    """The rows dealt to comparisons: of each pair of adjacent cells (a cell with itself first), every pair of tiles."""
    cell = ["label", "dim", *(f"c{i}" for i in range(GRID))]
    own = rows.select("*", *(F.col("cell")[i].alias(f"c{i}") for i in range(GRID)))
    sizes = cut(own.groupBy(*cell).agg(F.ceil(F.count("*") / tile).alias("tiles")))
    # Of each two opposite neighbours one, so that no two cells meet twice.
    offsets = [o for o in product((0, 1, -1), repeat=GRID) if o >= (0,) * GRID]
    listed = sizes.withColumn("o", F.explode(F.array(*(F.struct(F.lit(k).cast("bigint").alias("k"), *(F.lit(x).cast("bigint").alias(f"d{i}") for i, x in enumerate(o))) for k, o in enumerate(offsets)))))
    ahead = listed.select(*cell, "tiles", F.col("o.k").alias("o"), *((F.col(f"c{i}") + F.col(f"o.d{i}")).alias(f"n{i}") for i in range(GRID)))
    there = sizes.select("label", "dim", *(F.col(f"c{i}").alias(f"n{i}") for i in range(GRID)), F.col("tiles").alias("more"))
    pairs = cut(ahead.join(there, ["label", "dim", *(f"n{i}" for i in range(GRID))]))
    span = lambda column: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(column) - 1))
    home = own.join(pairs, cell).withColumn("t", F.pmod(F.xxhash64("id", F.lit(17)), F.col("tiles")))
    same = home.filter("o = 0").withColumn("x", span("tiles")).withColumn("ti", F.least("t", "x")).withColumn("tj", F.greatest("t", "x")).withColumn("side", F.when(F.col("t") == F.col("ti"), 0).otherwise(1))
    first = home.filter("o > 0").withColumn("ti", F.col("t")).withColumn("tj", span("more")).withColumn("side", F.lit(0))
    away = own.join(pairs.filter("o > 0").select("label", "dim", *(F.col(f"n{i}").alias(f"c{i}") for i in range(GRID)), *(F.col(f"c{i}").alias(f"h{i}") for i in range(GRID)), "tiles", "more", "o"), cell)
    second = away.withColumn("tj", F.pmod(F.xxhash64("id", F.lit(17)), F.col("more"))).withColumn("ti", span("tiles")).withColumn("side", F.lit(1))
    columns = ["o", "ti", "tj", "side", "id", "w", "unit"]
    near = [x.select("label", "dim", *(F.col(f"c{i}") for i in range(GRID)), *columns) for x in (same, first)]
    return near[0].unionByName(near[1]).unionByName(second.select("label", "dim", *(F.col(f"h{i}").alias(f"c{i}") for i in range(GRID)), *columns))


def embedding_dedup(vectors: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """One row per row of vectors (vec_id, label, embedding): vec_id, n_links, component_id, kept.

    Vectors link if labels are equal and not null, dimensions are equal and the cosine is `similarity` or more; vectors that are null, empty or zero or hold
    null or non-finite components link with nothing. Repeated rows count as other vectors. component_id is the least vec_id that links lead to. Null
    ids count as rows and are nobody's least id unless all are null. An empty table gives no rows.
    """
    rows = cut(prepared(vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("embedding").cast("array<double>")), similarity))
    known = rows.filter("fp is not null")
    classes = known.groupBy("label", "dim", "fp").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"), F.first("unit").alias("unit"), F.first("cell").alias("cell"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    keys = ["label", "dim", *(f"c{i}" for i in range(GRID)), "o", "ti", "tj"]
    width, least = WINDOW * math.sqrt(max(0.0, 2 - 2 * similarity)), least_count(PROJECTIONS, WINDOW, recall)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, keys):
            side = np.array(table.column("side").to_pylist())
            ids, weight = np.array(table.column("id").to_pylist()), np.array(table.column("w").to_pylist())
            o, ti, tj = (table.column(k)[0].as_py() for k in ("o", "ti", "tj"))
            single = o == 0 and ti == tj
            a = np.arange(len(ids)) if single else np.flatnonzero(side == 0)
            b = a if single else np.flatnonzero(side == 1)
            if not len(a) or not len(b) or len(ids) < 2:
                continue
            unit = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(len(ids), -1)
            along = unit @ directions(unit.shape[1], PROJECTIONS).T
            links = np.zeros((len(ids), len(ids)), bool)
            for i in range(0, len(a), 256):
                x, y = np.nonzero(collisions(along[a[i : i + 256]], along[b], width) >= least)
                x, y = a[i + x], b[y]
                x, y = (x[x != y], y[x != y])
                for k in range(0, len(x), 1 << 16):
                    u, v = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                    good = np.einsum("ij,ij->i", unit[u], unit[v]) >= similarity
                    links[u[good], v[good]] = links[v[good], u[good]] = True
            hit = np.flatnonzero(links.any(1))
            if len(hit):
                label = spread(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64) @ weight), pa.array(ids[label[hit]])], names=["id", "links", "near"])

    dealt = by_group(jobs(classes.select("label", "dim", "cell", "id", "w", "unit"), tile), keys)
    linked = cut(dealt.mapInArrow(compared, "id bigint, links bigint, near bigint"))
    roots = components(linked.select(F.col("id").alias("a"), F.col("near").alias("b"))).withColumnRenamed("node", "id")
    named = classes.select("id", "label", "dim", "fp", "w", "least").join(linked.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(roots, "id", "left")
    named = cut(named.withColumn("root", F.coalesce("root", "id")))
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = cut(named.join(firsts, "root").select("label", "dim", "fp", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("known")))
    drop(classes, linked, named)
    out = rows.select("vec_id", "label", "dim", "fp").join(final, ["label", "dim", "fp"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
