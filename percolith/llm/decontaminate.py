"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``window`` words (a shorter item is one window).  A window is the set
of its shingles of ``shingle`` words.  A document that contains the window contains every one of these
shingles, so with shingles ordered by rarity a prefix of one, the rarest in the documents, is necessary:
only that token is joined.  A match fixes where the window would stand; bounds on length and position
discard those that would leave the document, and the rest are verified word by word.

The items are the query set.  They are taken in blocks of ``BLOCK_ITEMS_BYTES`` of text, each indexed
once and broadcast; every block meets all documents, so the broadcast never grows with the input.
Documents are not shuffled.

Edge cases: null or empty texts have no words, no hit and the digest of the empty string; a null item_id
is shown as the empty string; items that share an id count once; repeated rows are judged each for itself.
Of equally rare shingles the first is the prefix.  Empty documents give an empty table, an empty benchmark no
hit; a text of any length is read whole.  A kept column with the name of a column of the result has ``_in``
after it; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map, fields, free_name, whole_row
from ._text import LOWER, Words, blocks, merged, spans_hash

WINDOW, SHINGLE = 10, 5
#: Bytes of item text that are indexed and broadcast at once.
BLOCK_ITEMS_BYTES = 4 << 20
_MAP_BITS = 22
COLUMNS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")


class ItemIndex:
    """The distinct windows of a block of items and, once rarities are known, their prefix tokens."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int, shingle: int):
        self.shingle, self.ids = shingle, ids
        self.texts: list[bytes] = []
        self.items: list[list[int]] = []
        self.length: list[int] = []
        tokens: list[np.ndarray] = []
        known: dict[bytes, int] = {}
        for block in blocks(texts):
            words = Words(block, "alnum")
            lower = block.buf.tobytes().translate(LOWER)
            for i in range(len(block)):
                a, b = int(words.first[i]), int(words.first[i + 1])
                m = min(window, b - a)
                for s in range(a, b - m + 1) if m else ():
                    body = b" ".join(lower[x:y] for x, y in zip(words.starts[s : s + m], words.ends[s : s + m], strict=True))
                    if body not in known:
                        known[body] = len(self.texts)
                        self.texts.append(body)
                        self.length.append(m)
                        self.items.append([])
                        k = min(shingle, m)
                        at = np.arange(s, s + m - k + 1)
                        tokens.append(spans_hash(words.hash, at, at + k))
                    mine = self.items[known[body]]
                    if not mine or mine[-1] != block.first + i:
                        mine.append(block.first + i)
        self.lengths = np.array(self.length, np.int64)
        self.sizes = sorted({min(shingle, m) for m in self.length})
        self.tokens = tokens
        self.all = np.unique(np.concatenate([np.zeros(0, np.uint64), *tokens]))
        self.map = _slots(self.all)

    def choose(self, counts: np.ndarray) -> None:
        """Keep for each window the rarest token, the leftmost of equals, and its offset."""
        prefix, offset = np.zeros(len(self.texts), np.uint64), np.zeros(len(self.texts), np.int64)
        for i, t in enumerate(self.tokens):
            k = int(np.argmin(counts[np.searchsorted(self.all, t)]))
            prefix[i], offset[i] = t[k], k
        order = np.argsort(prefix, kind="stable")
        self.of, self.offset = order, offset[order]
        self.prefix, self.starts = np.unique(prefix[order], return_index=True)
        self.starts = np.r_[self.starts, len(order)]
        self.map = _slots(self.prefix)
        self.tokens, self.all = [], np.zeros(0, np.uint64)


def _slots(tokens: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _MAP_BITS, bool)
    out[(tokens & np.uint64((1 << _MAP_BITS) - 1)).astype(np.int64)] = True
    return out


def _found(words: Words, k: int, keys: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the shingles of k words whose hash is among ``keys``, and where it is."""
    at, h = words.windows(k)
    near = np.flatnonzero(slots[(h & np.uint64((1 << _MAP_BITS) - 1)).astype(np.int64)])
    at, h = at[near], h[near]
    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = keys[place] == h
    return at[hit], place[hit]


def _occurrences(index: ItemIndex, words: Words, lower: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and window of each verified occurrence in a block."""
    got: list[tuple[int, int, int]] = []
    doc_of = words.documents()
    for k in index.sizes:
        at, place = _found(words, k, index.prefix, index.map)
        for p, j in zip(at.tolist(), place.tolist(), strict=True):
            i = doc_of[p]
            lo, hi = words.first[i], words.first[i + 1]
            for e in range(index.starts[j], index.starts[j + 1]):
                w = index.of[e]
                m = index.length[w]
                s = p - int(index.offset[e])
                if min(index.shingle, m) != k or s < lo or s + m > hi:
                    continue
                if b" ".join(lower[x:y] for x, y in zip(words.starts[s : s + m].tolist(), words.ends[s : s + m].tolist(), strict=True)) == index.texts[w]:
                    got.append((s, s + m, int(w)))
    out = np.array(got, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def _count_tokens(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    index: ItemIndex = shared.value
    counts = np.zeros(len(index.all), np.int64)
    for batch in batches:
        for block in blocks(batch.column("_text")):
            words = Words(block, "alnum")
            for k in index.sizes:
                counts += np.bincount(_found(words, k, index.all, index.map)[1], minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["token", "n"])


def _marked(batch: pa.RecordBatch, shared) -> tuple[list[bytes], list[list[str]], np.ndarray]:
    """Per document: hit spans and items, those of earlier blocks of items included, and its words."""
    index: ItemIndex = shared.value
    spans, items = batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()
    n = np.zeros(batch.num_rows, np.int64)
    for block in blocks(batch.column("_text")):
        words = Words(block, "alnum")
        n[block.first : block.first + len(block)] = np.diff(words.first)
        start, end, window = _occurrences(index, words, block.buf.tobytes().translate(LOWER))
        doc = np.searchsorted(words.first, start, side="right") - 1
        for i in np.unique(doc):
            mine, row = doc == i, block.first + int(i)
            found = {index.ids[x] for w in np.unique(window[mine]) for x in index.items[w]}
            old = np.frombuffer(spans[row], np.int64).reshape(-1, 2)
            a, b = merged(np.r_[old[:, 0], start[mine] - words.first[i]], np.r_[old[:, 1], end[mine] - words.first[i]])
            spans[row] = np.stack((a, b), axis=1).tobytes()
            items[row] = sorted(found.union(items[row]))
    return spans, items, n


def _hits(batch: pa.RecordBatch, shared) -> Iterator[dict]:
    spans, items, _ = _marked(batch, shared)
    yield {"_row": batch.column("_row"), "_text": batch.column("_text"), "_spans": spans, "_items": items}


def _said(batch: pa.RecordBatch, shared) -> Iterator[dict]:
    """The last block of items, and what all have found."""
    packed, items, n = _marked(batch, shared)
    spans = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in packed]
    yield {
        "_row": batch.column("_row"),
        "n_words": n,
        "n_hit": np.array([int((x[:, 1] - x[:, 0]).sum()) for x in spans], np.int64),
        "n_items": np.array([len(x) for x in items], np.int64),
        "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
        "items": items,
        "spans": [x.ravel().tolist() for x in spans],
    }


def find(docs: DataFrame, benchmark: DataFrame, *, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns with n_words, n_hit, n_items, items_sha256, contaminated, items and the hit spans (word numbers)."""
    spark = docs.sparkSession
    chosen = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    size = chosen.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = int(size // BLOCK_ITEMS_BYTES) + 1
    rows = docs.select(whole_row(docs, keep).alias("_row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    kind = rows.schema["_row"]
    out = rows.withColumns({"_spans": F.lit(b""), "_items": F.array().cast("array<string>")})
    for part in range(parts):
        block = chosen.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).toArrow()
        index = ItemIndex(block["id"].to_pylist(), block["text"].combine_chunks(), window, shingle)
        if index.texts:
            first = spark.sparkContext.broadcast(index)
            counts = np.zeros(len(index.all), np.int64)
            seen = rows.select("_text").mapInArrow(lambda b, s=first: _count_tokens(b, s), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
            counts[seen["token"].to_numpy()] = seen["n"].to_numpy()
            first.unpersist()
            index.choose(counts)
        second = spark.sparkContext.broadcast(index)
        if part + 1 < parts:
            out = arrow_map(out, lambda b, s=second: _hits(b, s), fields("_text string, _spans binary, _items array<string>", kind))
    out = arrow_map(out, lambda b, s=second: _said(b, s), fields("n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, spans array<long>", kind))
    found = out.select(*[F.col("_row").getField(c).alias(free_name(c, COLUMNS)) for c in keep], "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "items", "spans")
    return found
