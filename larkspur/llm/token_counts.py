"""Unigram token counts by dynamic programming that shares the work of common prefixes.

The vocabulary is a rank file; its tokens get the Zipf probabilities of their ranks, p(r) = 1 / ((r + 1) * H). A pre-token's
segmentation is the one with the greatest sum of log-probabilities (of equal sums, the fewest tokens). Distinct pre-tokens are
put in a trie; the best score of a node is the best over the vocabulary entries that end there, from scores of nodes above
it, and so is computed once for all pre-tokens that share the prefix. The trie is visited in sorted order, so only the path to the
current node is held. Nodes that end a pre-token give its count. Documents never leave their partition: there is no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.bpe import LONGEST, MEMO, read_ranks
from larkspur.llm.columns import boxed, mapped, quoted


def zipf_scores(vocabulary: list[bytes]) -> dict[bytes, float]:
    total = math.log(math.fsum(1 / (r + 1) for r in range(len(vocabulary)))) if vocabulary else 0.0
    return {x: -math.log(r + 1) - total for r, x in enumerate(vocabulary)}


class Counter:
    """Counts of unigram tokens for one vocabulary."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=0)
        # Of a byte that is no entry: less than any entry has.
        self.unknown = min(scores.values(), default=0.0) - 10.0
        # For each last two bytes of an entry, the lengths it can have: most suffixes need no lookup.
        lengths: dict[bytes, set[int]] = {}
        for x in scores:
            lengths.setdefault(x[-2:], set()).add(len(x))
        self.lengths = {k: sorted(v) for k, v in lengths.items()}

    def counts(self, pieces: Iterable[bytes]) -> dict[bytes, int]:
        """The number of tokens of each distinct piece, in one walk over their trie."""
        out: dict[bytes, int] = {}
        path, before = [(0.0, 0)], b""
        scores, none, unknown = self.scores, [], self.unknown
        for piece in sorted(set(pieces)):
            shared = 0
            top = min(len(before), len(piece), len(path) - 1)
            while shared < top and before[shared] == piece[shared]:
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(piece) + 1):
                best, count = -math.inf, 0
                pair = piece[max(0, end - 2) : end]
                for n in (1, *(self.lengths.get(pair, none) if len(pair) == 2 else none)):
                    if n > end:
                        break
                    score = scores.get(piece[end - n : end], unknown if n == 1 else None)
                    if score is not None:
                        s, c = path[end - n]
                        if (s := s + score) > best or s == best and c + 1 < count:
                            best, count = s, c + 1
                path.append((best, count))
            out[piece] = path[-1][1]
            before = piece
        return out


def token_counts(docs: DataFrame, path: str, pattern: str, text: str = "text", memo: int = MEMO) -> DataFrame:
    """Adds n_pretokens and n_tokens to each row, over the whole text.

    Null or empty text has none of either. Rows are independent, so repeated rows and ids, and null in any other column, change
    nothing; columns of the input that bear one of the new names, in any case, are replaced, and others stay whatever their names. A byte that the
    vocabulary lacks counts as a token, of less than any entry's score.
    """
    shared = docs.sparkSession.sparkContext.broadcast((zipf_scores(read_ranks(path)), pattern))
    added = {"n_pretokens": "bigint", "n_tokens": "bigint"}
    source = boxed(docs, added, F.col(quoted(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        scores, split = shared.value
        counter, find, known = Counter(scores), regex.compile(split).findall, {}
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                tokens = [find(x.as_py() or "") for x in part.column(at)]
                fresh = set().union(*tokens)
                if len(known) + len(fresh) > memo:
                    known.clear()
                fresh = {x.encode(): x for x in fresh if x not in known}
                known.update((fresh[k], n) for k, n in counter.counts(fresh).items())
                yield part, [pa.array([len(x) for x in tokens], pa.int64()), pa.array([sum(map(known.__getitem__, x)) for x in tokens], pa.int64())]
                for x in {x for t in tokens for x in t if len(x) > LONGEST}:
                    # Long ones hardly come again, and would fill the memory that a number of entries is to bound.
                    known.pop(x, None)

    return mapped(source, docs, added, run)
