"""Keys that recur, found and answered in packed shards.

A key is two 64-bit numbers, such as a phrase and a window of it.  Batches combine their keys, pack them by a
hash of the key and send one row to each shard, so no number of equal keys fills a shard, and no row is made
for a key.  A shard keeps the keys with two different owners and the smallest; asked for keys by bucket, it
answers by bucket, with its table first in the stream, so it holds its table and one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map, key_bits, key_filter
from ._text import mix

#: Rows that a task holds before it combines them or hands them on.
HELD = 1 << 20
PACKED = "p long, rows binary"


def joint(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h.view(np.uint64) ^ mix(w.view(np.uint64), 5), 6)


def rows_of(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, np.int64).reshape(-1, width)


def packed(table: np.ndarray, shards: int) -> dict:
    """Rows of a key and two or fewer numbers, packed by shard."""
    shard = ((joint(table[:, 0].copy(), table[:, 1].copy()) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    table, shard = table[order], shard[order]
    at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
    return {"p": shard[at], "rows": [x.tobytes() for x in np.split(table, at[1:])] if len(at) else []}


def combined(table: np.ndarray) -> np.ndarray:
    """(key, smallest owner, largest owner), one row of each key."""
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    at = np.flatnonzero(np.r_[True, (table[1:, :2] != table[:-1, :2]).any(axis=1)]) if len(table) else np.zeros(0, np.int64)
    if not len(at):
        return table
    return np.column_stack((table[at, :2], np.minimum.reduceat(table[:, 2], at), np.maximum.reduceat(table[:, 3], at)))


def _recurring(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(key, smallest owner) of a partition's shards; what is held is bounded by their different keys."""
    held: dict[int, list[np.ndarray]] = {}
    size: dict[int, int] = {}
    for batch in batches:
        for p, blob in zip(batch.column("p").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            part = held.setdefault(p, [])
            part.append(rows_of(blob, 4))
            size[p] = size.get(p, 0) + len(part[-1])
            if size[p] > most and len(part) > 1:
                part[:] = [combined(np.concatenate(part))]
                size[p] = len(part[0]) // 2  # what is left may be different windows all
    for p, part in held.items():
        table = combined(np.concatenate(part))
        table = table[table[:, 2] < table[:, 3], :3]
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([table.tobytes()], pa.binary())], names=["p", "rows"])


def _bits(batch: pa.RecordBatch) -> Iterator[dict]:
    for blob in batch.column("rows").to_pylist():
        table = rows_of(blob, 3)
        yield key_bits(joint(table[:, 0].copy(), table[:, 1].copy()))


class Known:
    """A table of (key, smallest owner) that is looked up."""

    def __init__(self, table: np.ndarray):
        self.joint = joint(table[:, 0].copy(), table[:, 1].copy())
        order = np.argsort(self.joint, kind="stable")
        self.joint, self.table = self.joint[order], table[order]
        self.phrases = np.unique(table[:, 0])

    def find(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Rows of (h, w), -1 where there is none."""
        if not len(self.joint):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.joint, joint(h, w)), len(self.joint) - 1)
        return np.where((self.table[at, 0] == h.view(np.int64)) & (self.table[at, 1] == w.view(np.int64)), at, -1)


def _answers(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (shard, kind): a shard's table first, then what is asked of it; the answers by bucket."""
    shard, parts, table = None, [], None
    found, held = [], 0

    def dealt() -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(found)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        at = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        blobs = [x[:, 1:].tobytes() for x in np.split(rows, at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(rows[at, 0]), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

    for batch in batches:
        for p, kind, blob in zip(*(batch.column(k).to_pylist() for k in ("p", "kind", "rows")), strict=True):
            if p != shard:
                shard, parts, table = p, [], None
            if kind == 0:
                parts.append(rows_of(blob, 3))
                continue
            if table is None:
                table = Known(np.concatenate([np.zeros((0, 3), np.int64), *parts]))
            asked = rows_of(blob, 3)
            at = table.find(asked[:, 0].copy(), asked[:, 1].copy())
            hit = at >= 0
            found.append(np.column_stack((asked[hit, 2], table.table[at[hit]])))
            held += int(hit.sum())
            if held > most:
                yield from dealt()
                found, held = [], 0
    if held:
        yield from dealt()


def recurring(keys: DataFrame, shards: int, most: int = HELD) -> DataFrame:
    """Of packed (key, smallest owner, largest owner) those with two owners, as packed (key, smallest owner)."""
    return keys.repartition(shards, "p").mapInArrow(lambda b: _recurring(b, most), PACKED)


def bitmap(found: DataFrame) -> np.ndarray:
    """The bitmap of the keys of packed rows."""
    return key_filter(arrow_map(found, _bits, "w int, b long"), None)


def answers(found: DataFrame, asked: DataFrame, shards: int, most: int = HELD) -> DataFrame:
    """(bucket, rows of (key, smallest owner)) for packed ``asked`` (key, bucket); a key asked for twice is answered twice."""
    both = found.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)))
    return both.repartition(shards, "p").sortWithinPartitions("p", "kind").mapInArrow(lambda b: _answers(b, most), "bucket long, rows binary")
