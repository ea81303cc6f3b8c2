"""Removal of repeated byte strings through a run-compressed Burrows-Wheeler index.

Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same document
or another, is removed; matches never cross documents.

1. A string's anchor is its least gram of ``GRAM`` bytes, so equal strings have equal anchors at equal
   offsets.  Consecutive strings with one anchor form a run, its bytes a *context*.  Anchors are counted;
   a bitmap of fixed size lets through the contexts whose anchor recurs.
2. Contexts are counted by (anchor, digest).  A context found twice is repeated throughout.
3. The others may be repeated in part.  Contexts are dealt to shards by anchor, so all places that could
   match meet in one shard of bounded size.  The shard's contexts are indexed: suffixes are sorted, the
   Burrows-Wheeler transform is run-compressed, and the places and common-prefix lengths at the ends of
   its runs are sampled.  Between samples these lengths fall by one a byte, so streaming the text over
   the samples gives every place's matching statistic; those of ``length`` or more are marked.
   An anchor with over ``HOT`` different contexts would overfill its shard.  Its strings are closed in on
   instead: those whose offset from the anchor falls in one range share a core; cores are combined within a
   batch, packed by shard (a hash of the core), and only ranges whose core is in two contexts are cut into
   finer ones, down to single strings, which are confirmed exactly.  No key can skew this.
4. Marks go back to the documents that hold the context, and the bytes left are joined.

Edge cases: null counts as empty; a document under ``length`` bytes is kept whole, and an empty table gives an
empty table.  Repeated rows count as documents of their own, so both lose what they share; there are no ties,
as every copy goes.  A text of any length is one row, read as a block of its own.  Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shards import PACKED, Known, answers, bitmap, combined, joint, packed, recurring, rows_of
from ._spark import arrow_map, key_filter, keyed, partitions, passes, same_row, stored
from ._text import Block, anchored_runs, as_letters, blocks, byte_grams, merged, mix, ranges, spans_hash

LENGTH = 200
GRAM = 24
#: Contexts of one anchor that a shard takes.
HOT = 1024
#: Bytes of contexts in a shard.
SHARD_BYTES = 1 << 19


def _gram_key(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(buf[at[:, None] + np.arange(GRAM)]).view(np.uint64)
    h = np.zeros(len(at), np.uint64)
    for k in range(GRAM // 8):
        h = mix(h + words[:, k], k + 1)
    return h


def _runs(block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor key, first byte, end and anchor's first byte of each context of a block."""
    at, lo, hi = anchored_runs(byte_grams(block.buf, GRAM), block.off, length, GRAM, 15)
    return _gram_key(block.buf, at), lo, hi + length, at


def _anchors(batch: pa.RecordBatch, length: int) -> Iterator[dict]:
    keys = [np.zeros(0, np.uint64), *(_runs(block, length)[0] for block in blocks(batch.column("_text")))]
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    yield {"h": key, "n": n}


def _contexts(batch: pa.RecordBatch, length: int, bitmap) -> Iterator[dict]:
    """Distinct contexts of a batch, each with how often it occurs."""
    seen: dict[tuple[int, int], list] = {}
    for block in blocks(batch.column("_text")):
        key, lo, end, at = _runs(block, length)
        keep = passes(bitmap.value, key)
        key, lo, end, at = key[keep], lo[keep], end[keep], at[keep]
        c = spans_hash(as_letters(block.buf.tobytes()), lo, end)
        for h, d, a, b, p in zip(key.view(np.int64).tolist(), c.view(np.int64).tolist(), lo.tolist(), end.tolist(), (at - lo).tolist(), strict=True):
            if (had := seen.get((h, d))) is None:
                seen[h, d] = [block.buf[a:b].tobytes(), 1, p]
            else:
                had[1] += 1
    keys = np.array(list(seen), np.int64).reshape(-1, 2)
    yield {"h": keys[:, 0], "c": keys[:, 1], "n": [x[1] for x in seen.values()], "ctx": [x[0] for x in seen.values()], "p": [x[2] for x in seen.values()]}


def _places(batch: pa.RecordBatch, length: int, bitmap) -> Iterator[dict]:
    ids, th = batch.column("_id"), batch.column("_th").to_numpy()
    for block in blocks(batch.column("_text"), 1 << 22):
        key, lo, end, _ = _runs(block, length)
        keep = passes(bitmap.value, key)
        key, lo, end = key[keep], lo[keep], end[keep]
        doc = block.doc_of(lo)
        row = block.first + doc
        yield {"_id": ids.take(pa.array(row)), "_th": th[row], "h": key, "c": spans_hash(as_letters(block.buf.tobytes()), lo, end), "lo": lo - block.off[doc], "n": end - lo}


class RunIndex:
    """Run-compressed Burrows-Wheeler index of a set of texts, each with an end of its own.

    Kept are the runs' letters and lengths, and at each run's first and last suffix its place and the
    length it has in common with the suffix before or after it.
    """

    def __init__(self, texts: list[bytes]):
        self.data = data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(x) for x in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.n = n = len(data)
        text = np.repeat(np.arange(len(texts)), sizes)
        self.left = self.ends[text] - np.arange(n)
        order, self.levels = self._sort(text, len(texts))
        # letters before each suffix; a text's first letter is preceded by an end, unlike any letter
        before = np.where(order > 0, data[order - 1].astype(np.int64), -1)
        first = np.isin(order, np.r_[0, self.ends[:-1]])
        before[first] = -1 - order[first]
        new = np.r_[True, before[1:] != before[:-1]]
        heads = np.flatnonzero(new)
        tails = np.r_[heads[1:] - 1, n - 1]
        self.letters, self.lengths = before[heads], np.diff(np.r_[heads, n])
        up, down = heads[heads > 0], tails[tails < n - 1]
        self.head_at, self.head_common = order[up], self._common(order[up], order[up - 1])
        self.tail_at, self.tail_common = order[down], self._common(order[down], order[down + 1])

    def _sort(self, text: np.ndarray, texts: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix order by prefix doubling, from ranks by as many bytes as fit a word; ends are least, and in
        the order of the texts.  Later rounds sort (rank, rank after, place) packed into one number."""
        n, left = self.n, self.left
        letters, code = np.unique(self.data, return_inverse=True)
        bits, tie = int(len(letters)).bit_length(), int(texts + 1).bit_length()
        size = max(1, (63 - tie) // bits)
        padded = np.r_[code.astype(np.int64) + 1, np.zeros(size, np.int64)]
        key = np.zeros(n, np.int64)
        for k in range(size):
            key = (key << bits) | np.where(left > k, padded[k : n + k], 0)
        key = (key << tie) | np.where(left < size, text, texts)
        order = np.argsort(key)
        levels, place = [], max(1, int(n - 1).bit_length())
        k = key[order]
        while True:
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[False, k[1:] != k[:-1]])
            levels.append((size, rank.astype(np.int32)))
            if rank.max(initial=-1) == n - 1:
                return order, levels
            after = np.where(left > size, texts + np.r_[rank, np.zeros(size, np.int64)][size : size + n], text)
            wide = int(n + texts).bit_length()
            if 2 * place + wide <= 63:
                packed = np.sort((((rank << wide) | after) << place) | np.arange(n))
                order, k = packed & ((1 << place) - 1), packed >> place
            else:
                both = rank * (n + texts) + after
                order = np.argsort(both)
                k = both[order]
            size *= 2

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length in common of the suffixes at a and b: by descent through the ranks, then by bytes."""
        out = np.zeros(len(a), np.int64)
        last = self.n - 1
        for size, rank in reversed(self.levels):
            x, y = np.minimum(a + out, last), np.minimum(b + out, last)
            out += size * ((self.left[a] - out >= size) & (self.left[b] - out >= size) & (rank[x] == rank[y]))
        for _ in range(self.levels[0][0] - 1):
            x, y = np.minimum(a + out, last), np.minimum(b + out, last)
            out += (self.left[a] > out) & (self.left[b] > out) & (self.data[x] == self.data[y])
        return out

    def matching(self) -> np.ndarray:
        """For every place, the length matched by some other place.

        Samples hold at run ends; from each the length falls by one a byte until the next sample.
        """
        out = np.zeros(self.n, np.int64)
        for at, common in ((self.head_at, self.head_common), (self.tail_at, self.tail_common)):
            reach = np.zeros(self.n, np.int64)
            reach[at] = at + common
            out = np.maximum(out, np.maximum.accumulate(reach) - np.arange(self.n))
        return np.maximum(out, 0)


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, the starts of its strings of ``length`` bytes that start elsewhere among the texts."""
    index = RunIndex(texts)
    hit = (index.matching() >= length) & (index.left >= length)
    at = np.flatnonzero(hit)
    text = np.searchsorted(index.ends, at, side="right")
    begin = np.r_[0, index.ends[:-1]]
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [at[cuts[i] : cuts[i + 1]] - begin[i] for i in range(len(texts))]


def _spans(starts: np.ndarray, length: int) -> bytes:
    a, b = merged(starts, starts + length)
    return np.stack((a, b), axis=1).astype("<i4").tobytes()


def _shard(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The contexts of one partition, whole; its size is bounded by the number of partitions."""
    rows = [(h, c, n, x) for b in batches for h, c, n, x in zip(*(b.column(k).to_pylist() for k in ("h", "c", "n", "ctx")), strict=True)]
    rows.sort(key=lambda r: r[0])
    i, out = 0, []
    while i < len(rows):
        j, size = i, 0
        while j < len(rows) and (size < SHARD_BYTES or rows[j][0] == rows[j - 1][0]):
            size += len(rows[j][3])
            j += 1
        part = rows[i:j]
        for (h, c, n, x), starts in zip(part, repeated_windows([r[3] for r in part], length), strict=True):
            if n == 1 and len(starts):
                out.append((h, c, _spans(starts, length)))
        i = j
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], names=["h", "c", "spans"])


#: Bytes of contexts in a group.
CROWD_BYTES = 1 << 20


def _widths(length: int) -> list[int]:
    """Widths of the ranges of offsets, each a part of the one before, down to single strings; all have cores."""
    return [w for w in (64, 8, 1) if w <= length - GRAM + 1]


def _cores(block: Block, h: np.ndarray, p: np.ndarray, length: int, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of offsets of each context of a block, of the width after those that have filters: context, range, and key.

    Offsets count from a string's start to the anchor, so equal strings have equal ranges.  Only ranges that lie
    in ranges whose cores passed go on.
    """
    # strings of a context start at 0 .. size - length, so their offsets are p - (size - length) .. p
    size = np.diff(block.off)
    least, most = np.maximum(0, p - (size - length)), p
    letters = as_letters(block.buf.tobytes())
    widths = _widths(length)
    width = widths[0]
    first, count = least // width, most // width - least // width + 1
    doc, part = np.repeat(np.arange(len(p)), count), ranges(first, count)
    for level, width in enumerate(widths):
        at = block.off[:-1][doc] + p[doc] - part * width  # the first of the range's strings starts here, its last ends at
        end = at - width + 1 + length
        one, two = spans_hash(letters, at, end), spans_hash(letters, at, end, 1)
        keys = np.column_stack((mix(one ^ mix(h.view(np.uint64)[doc], 7) ^ part.astype(np.uint64), width), two)).view(np.int64)
        if level == len(filters):
            return doc, part, keys[:, 0], keys[:, 1]
        keep = passes(filters[level], joint(keys[:, 0].copy(), keys[:, 1].copy()))
        doc, part = doc[keep], part[keep]
        finer = width // widths[level + 1]
        first, last = np.maximum(part * finer, least[doc] // widths[level + 1]), np.minimum(part * finer + finer - 1, most[doc] // widths[level + 1])
        count = np.maximum(last - first + 1, 0)
        doc, part = np.repeat(doc, count), ranges(first, count)
    raise ValueError("more filters than widths")


def _cored(batch: pa.RecordBatch, length: int, shared, shards: int) -> Iterator[dict]:
    """The cores of a batch, once each; owners are contexts, and one found twice has two."""
    h, c, n, p = (batch.column(k).to_numpy() for k in ("h", "c", "n", "p"))
    found = [np.zeros((0, 4), np.int64)]
    for block in blocks(batch.column("ctx"), 1 << 20):
        mine = slice(block.first, block.first + len(block))
        doc, _, one, two = _cores(block, h[mine], p[mine], length, [x.value for x in shared])
        own, again = c[mine][doc], n[mine][doc] > 1
        other = np.where(again, own ^ 1, own)
        found.append(np.column_stack((one, two, np.minimum(own, other), np.maximum(own, other))))
    yield packed(combined(np.concatenate(found)), shards)


def _strings(batch: pa.RecordBatch, length: int, shared, shards: int) -> Iterator[dict]:
    """The strings to be confirmed, each once for a group of contexts."""
    h, n, p, group = (batch.column(k).to_numpy() for k in ("h", "n", "p", "g"))
    found = [np.zeros((0, 3), np.int64)]
    for block in blocks(batch.column("ctx"), 1 << 20):
        mine = slice(block.first, block.first + len(block))
        doc, _, one, two = _cores(block, h[mine], p[mine], length, [x.value for x in shared])
        ask = n[mine][doc] == 1
        found.append(np.column_stack((one, two, group[mine][doc]))[ask])
    yield packed(np.unique(np.concatenate(found), axis=0), shards)


def _settled(contexts: pa.Table, found: pa.Table, length: int, shared) -> pa.Table:
    """Spans of a group's contexts from its confirmed strings."""
    known = Known(np.concatenate([np.zeros((0, 3), np.int64), *(rows_of(x, 3) for x in found.column("rows").to_pylist())]))
    out: list[tuple[int, int, bytes]] = []
    h, c, n, p = (contexts.column(k).to_numpy() for k in ("h", "c", "n", "p"))
    for block in blocks(contexts.column("ctx"), 1 << 20):
        mine = slice(block.first, block.first + len(block))
        doc, offset, one, two = _cores(block, h[mine], p[mine], length, [x.value for x in shared])
        keep = (n[mine][doc] == 1) & (known.find(one, two) >= 0)
        doc, start = doc[keep], p[mine][doc[keep]] - offset[keep]
        for i in np.unique(doc).tolist():
            out.append((int(h[mine][i]), int(c[mine][i]), _spans(np.sort(start[doc == i]), length)))
    return pa.table({"h": pa.array([x[0] for x in out], pa.int64()), "c": pa.array([x[1] for x in out], pa.int64()), "spans": pa.array([x[2] for x in out], pa.binary())})


def _crowded(crowd: DataFrame, length: int) -> DataFrame:
    """(h, c, spans) of contexts that share strings with others of a crowded anchor; a round for each width."""
    spark = crowd.sparkSession
    size = crowd.agg(F.sum(F.octet_length("ctx")).alias("b")).first()["b"] or 0
    groups = F.lit(int(size // CROWD_BYTES) + 1)
    crowd = crowd.select("h", "c", "n", "p", F.pmod(F.xxhash64("h", "c"), groups).alias("g"), "ctx")
    shards = partitions(spark, int(size // (4 * CROWD_BYTES)) + 1)
    shared: list = []
    for _ in _widths(length)[1:]:
        cores = arrow_map(crowd, lambda b, s=list(shared): _cored(b, length, s, shards), PACKED)
        shared.append(spark.sparkContext.broadcast(bitmap(recurring(cores, shards))))
    found = recurring(arrow_map(crowd, lambda b: _cored(b, length, shared, shards), PACKED), shards)
    asked = arrow_map(crowd, lambda b: _strings(b, length, shared, shards), PACKED)
    dealt = answers(found, asked, shards).withColumnRenamed("bucket", "g")
    return crowd.groupBy("g").cogroup(dealt.groupBy("g")).applyInArrow(lambda a, b: _settled(a, b, length, shared), "h long, c long, spans binary")


def _cut(batch: pa.RecordBatch) -> Iterator[dict]:
    n = batch.num_rows
    size, removed, count, kept, texts = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n, [b""] * n
    found = batch.column("found").to_pylist()
    for block in blocks(batch.column("_text")):
        for i in range(len(block)):
            row, body = block.first + i, block.document(i)
            size[row] = len(body)
            spans = [np.frombuffer(x["spans"], "<i4").reshape(-1, 2).astype(np.int64) + x["lo"] for x in found[row] or ()]
            if spans:
                both = np.concatenate(spans)
                a, b = merged(both[:, 0], both[:, 1])
                removed[row], count[row] = int((b - a).sum()), len(a)
                body = b"".join(body[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(body)], strict=True))
            kept[row], texts[row] = hashlib.sha256(body).hexdigest(), body
    yield {"doc_id": batch.column("_id"), "n_bytes": size, "n_removed": removed, "n_spans": count, "kept_sha256": kept, "kept": texts}


def deduplicate(docs: DataFrame, *, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", outputs: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes kept if ``outputs``."""
    spark = docs.sparkSession
    rows = keyed(docs, text=text, doc_id=doc_id)
    anchors = arrow_map(rows.select("_text"), lambda b: _anchors(b, length), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    bitmap = spark.sparkContext.broadcast(key_filter(anchors.where("n > 1"), "h"))

    found = arrow_map(rows.select("_text"), lambda b: _contexts(b, length, bitmap), "h long, c long, n long, ctx binary, p long")
    contexts = stored(found.groupBy("h", "c").agg(F.sum("n").alias("n"), F.first("ctx").alias("ctx"), F.first("p").alias("p")))
    per_anchor = contexts.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("least"))
    hot = per_anchor.where(F.col("k") > HOT).select("h")
    mixed = per_anchor.where(F.col("k").between(2, HOT) & (F.col("least") == 1)).select("h")
    total = contexts.agg(F.sum(F.octet_length("ctx")).alias("b")).first()["b"] or 0
    shards = partitions(spark, int(total // (8 * SHARD_BYTES)) + 1)

    whole = F.lit(np.array([0, -1], "<i4").tobytes())
    twice = contexts.where("n > 1").select("h", "c", whole.alias("spans"))
    once = contexts.join(mixed, "h", "left_semi").select("h", "c", "n", "ctx").repartition(shards, "h").mapInArrow(lambda b: _shard(b, length), "h long, c long, spans binary")
    marks = twice.unionByName(once).unionByName(_crowded(stored(contexts.join(hot, "h", "left_semi")), length))

    places = arrow_map(rows, lambda b: _places(b, length, bitmap), "_id long, _th long, h long, c long, lo long, n long")
    covered = places.join(marks, ["h", "c"]).select("_id", "_th", "lo", F.when(F.col("spans") == whole, F.concat(F.lit(np.array([0], "<i4").tobytes()), _le(F.col("n")))).otherwise(F.col("spans")).alias("spans"))
    by_doc = covered.groupBy("_id", "_th").agg(F.collect_list(F.struct("lo", "spans")).alias("found"))
    joined = rows.join(by_doc, same_row(rows, by_doc), "left").select(rows["_id"], "_text", "found")
    out = arrow_map(joined, _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumnRenamed("doc_id", doc_id)
    return out if outputs else out.drop("kept")


def _le(n):
    """A number under 2**31 as four bytes, least first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)]))
