"""A caller's columns, carried through an operator as one struct, so that no name of theirs meets one of the operator's."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The struct's name; what an operator adds beside it bears other names.
ROW = "row"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(docs: DataFrame, added: Iterable[str]) -> list[str]:
    """The caller's columns that stay: all but those that bear one of the new names, in any case."""
    new = {a.lower() for a in added}
    return [c for c in docs.columns if c.lower() not in new]


def boxed(docs: DataFrame, added: Iterable[str], *extra: Column) -> DataFrame:
    """The columns that stay as the struct `row` (one null field where none stay), and the extra columns."""
    keep = [F.col(quoted(c)) for c in carried(docs, added)] or [F.lit(None).cast("int").alias("none")]
    return docs.select(F.struct(*keep).alias(ROW), *extra)


def unboxed(df: DataFrame, docs: DataFrame, added: dict[str, Column] | Iterable[str]) -> DataFrame:
    """The caller's columns again, with the added ones after them."""
    new = added if isinstance(added, dict) else {a: F.col(a) for a in added}
    return df.select(*(F.col(ROW).getField(c).alias(c) for c in carried(docs, new)), *(v.alias(k) for k, v in new.items()))


def mapped(boxes: DataFrame, docs: DataFrame, added: dict[str, str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]]) -> DataFrame:
    """The caller's columns and new ones of the given types, which run() gives for parts of the batches of boxes (from boxed(), with columns more)."""
    schema = StructType([boxes.schema[ROW], *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in added.items())).fields])
    names = [ROW, *added]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, columns in run(batches):
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(ROW)), *columns], names=names)

    return unboxed(boxes.mapInArrow(whole, schema), docs, list(added))
