"""Helpers shared by the operators: row keys, Arrow maps, shared-folder tables, bounded filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..shared import drop, shared_folder, stored

#: Key of a row: its doc_id and a hash of its text.  Rows equal in both get equal results from every operator here.
KEY = ["_id", "_th"]
#: Bytes of an Arrow batch, or one row if that is longer.
BATCH_BYTES = 4 << 20


def keyed(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Only (_id, _th, _text): other columns, whatever their names, take no part.  A null text counts as empty."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(body).alias("_th"), body.alias("_text"))


def free_name(name: str, own: tuple[str, ...]) -> str:
    """The name under which a kept column is returned: its own, with ``_in`` after it where the operator has a column of that name."""
    return f"{name}_in" if name.lower() in own else name


def whole_row(df: DataFrame, keep: list[str]) -> Column:
    """Some columns, whatever their names, as one struct."""
    return F.struct(*[df[f"`{c}`"] for c in keep])


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["_id"].eqNullSafe(right["_id"]) & (left["_th"] == right["_th"])


def fields(schema: str, *first: StructField) -> StructType:
    """Some fields, whatever their names, and those of a DDL text."""
    return StructType([*first, *_parse_datatype_string(schema).fields])


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict]], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function from a batch to dicts of numpy arrays, Arrow arrays or lists."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = fields(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in function(batch):
                yield as_batch(found, target)
        pa.default_memory_pool().release_unused()

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def bound_batches(spark: SparkSession) -> None:
    """Batches end at ``BATCH_BYTES`` at most, so long texts don't fill a worker; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def as_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    made = []
    for field in target:
        x = columns[field.name]
        if isinstance(x, np.ndarray) and x.dtype == np.uint64:
            x = x.view(np.int64)
        made.append(x.cast(field.type) if isinstance(x, pa.Array) else pa.array(x, type=field.type, from_pandas=False))
    return pa.RecordBatch.from_arrays(made, schema=target)


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


FILTER_BITS = 26


def key_filter(keys: DataFrame, column: str | None) -> np.ndarray:
    """A bitmap of 2**``FILTER_BITS`` slots with those of all keys set, as bytes; ``keys`` may be ``key_bits`` (no column).

    Its size is fixed, so it may be broadcast.  A key that was never added may pass; callers treat a
    pass as a candidate only, so a full bitmap costs time and never changes a result.
    """
    if column is not None:
        slot = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        keys = keys.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63L as int))").alias("b"))
    words = keys.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.view(np.uint8)


def key_bits(keys: np.ndarray) -> dict:
    """The bitmap's words that some keys set, as columns w and b."""
    slot = np.unique(keys.astype(np.uint64, copy=False) & np.uint64((1 << FILTER_BITS) - 1))
    word = (slot >> np.uint64(6)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else word
    bit = np.uint64(1) << (slot & np.uint64(63))
    return {"w": word[at].astype(np.int32), "b": np.bitwise_or.reduceat(bit, at) if len(at) else bit}


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.astype(np.uint64, copy=False) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
