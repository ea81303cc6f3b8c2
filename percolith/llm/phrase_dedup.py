"""Removal of repeated passages, located by sharded Aho-Corasick automata.

Every word covered by a window of ``length`` words whose sequence also starts in a document with a
smaller doc_id is removed.

1. A window's anchor phrase is its least run of ``PHRASE`` words, so equal windows have equal anchor
   phrases at equal offsets; consecutive windows with one anchor form a run, its words a *passage*.
   For every phrase the smallest and largest doc_id and passage digest are partial aggregates.
2. Phrases of two documents or more are confirmed.  If all passages of a phrase are one, its smallest
   doc_id holds for all windows.  Otherwise the windows are confirmed one by one: windows are combined
   within a batch, packed by shard (a hash of phrase and window, so no phrase or passage can fill a
   shard), and a shard keeps those of two documents with the smallest.  All phrases go this way, whatever
   their number of passages.
3. Documents are dealt to buckets of about ``BUCKET_BYTES``.  Every bucket asks the shards for what its
   documents hold, a window once a batch.  The confirmed passages (stretches of confirmed windows) are
   compiled into the bucket's automaton by their phrases, its documents are streamed through it, and at
   every occurrence of a phrase the passages are compared in full; the words of windows that an earlier
   document has are removed.

Windows are told apart by 64 bits of phrase and 64 bits of window.

Edge cases: null has no words; a document under ``length`` words is kept whole, and an empty table gives
an empty table.  A row without doc_id has no earlier document and is earlier than none.  Rows that share a
doc_id, or are equal, are not earlier than each other.  A text of any length is one row of one bucket.
Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shards import HELD, PACKED, Known, answers, bitmap, combined, joint, packed, recurring, rows_of
from ._spark import arrow_map, key_filter, keyed, partitions, passes, stored
from ._text import Block, Words, anchored_runs, blocks, ranges, spans_hash

LENGTH = 50
PHRASE = 8
#: Bytes of documents in a bucket, and windows of a shard.
BUCKET_BYTES = 2 << 20
SHARD_WINDOWS = 1 << 20


class Runs:
    """The runs of a block: phrase key, phrase's first word, first word and end of the passage, document."""

    def __init__(self, block: Block, length: int, bitmap: np.ndarray | None = None):
        self.words = words = Words(block, "plain")
        n = max(0, len(words.hash) - PHRASE + 1)
        grams = spans_hash(words.hash, np.arange(n), np.arange(n) + PHRASE)
        at, lo, hi = anchored_runs(grams, words.first, length, PHRASE, 3)
        key = grams[at]
        if bitmap is not None:
            keep = passes(bitmap, key)
            at, lo, hi, key = at[keep], lo[keep], hi[keep], key[keep]
        self.key, self.at, self.lo, self.end = key, at, lo, hi + length
        self.doc = np.searchsorted(words.first, lo, side="right") - 1
        self.digest = spans_hash(words.hash, lo, self.end, 1)

    def windows(self, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows of some runs: the run and the hash of each."""
        n = (self.end - self.lo - length + 1)[which]
        first = ranges(self.lo[which], n)
        return np.repeat(which, n), spans_hash(self.words.hash, first, first + length, 2)


def _phrases(batch: pa.RecordBatch, length: int) -> Iterator[dict]:
    """Per phrase of a batch: smallest and largest doc_id, least and greatest digest of a passage, windows."""
    ids = batch.column("_id").to_numpy()
    found = [(np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)]
    for block in blocks(batch.column("_text")):
        runs = Runs(block, length)
        found.append((runs.key, ids[block.first + runs.doc], runs.digest.view(np.int64), runs.end - runs.lo - length + 1))
    key, doc, digest, n = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    key, doc, digest, n = key[order], doc[order], digest[order], n[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    yield {"h": key[at], "lo": np.minimum.reduceat(doc, at), "hi": np.maximum.reduceat(doc, at), "c": np.minimum.reduceat(digest, at), "d": np.maximum.reduceat(digest, at), "m": np.add.reduceat(n, at)}


def _windows(batch: pa.RecordBatch, length: int, several, shards: int) -> Iterator[dict]:
    """The windows of phrases that have more than one passage, once a batch."""
    ids = batch.column("_id").to_numpy()
    found = [np.zeros((0, 4), np.int64)]
    for block in blocks(batch.column("_text")):
        runs = Runs(block, length, several.value)
        run, w = runs.windows(np.arange(len(runs.key)), length)
        doc = ids[block.first + runs.doc[run]]
        found.append(np.column_stack((runs.key.view(np.int64)[run], w.view(np.int64), doc, doc)))
    yield packed(combined(np.concatenate(found)), shards)


def _lone(batch: pa.RecordBatch, shards: int) -> Iterator[dict]:
    yield packed(np.column_stack([batch.column(k).to_numpy() for k in ("h", "c", "lo")]), shards)


def _asked(batch: pa.RecordBatch, length: int, known, several, kept, shards: int) -> Iterator[dict]:
    """What a batch's documents hold: passages of phrases that have only one, else windows; each with its bucket."""
    bucket = batch.column("bucket").to_numpy()
    found = [np.zeros((0, 3), np.int64)]
    for block in blocks(batch.column("_text")):
        runs = Runs(block, length, known.value)
        many = passes(several.value, runs.key)
        one = np.flatnonzero(~many)
        key, at = runs.key.view(np.int64), bucket[block.first + runs.doc]
        found.append(np.column_stack((key[one], runs.digest.view(np.int64)[one], at[one])))
        run, w = runs.windows(np.flatnonzero(many), length)
        again = passes(kept.value, joint(runs.key[run], w))
        found.append(np.column_stack((key[run[again]], w.view(np.int64)[again], at[run[again]])))
    table = np.concatenate(found)
    table = table[np.lexsort((table[:, 2], table[:, 1], table[:, 0]))]
    if len(table):
        table = table[np.r_[True, (table[1:] != table[:-1]).any(axis=1)]]
    yield packed(table, shards)


def _passages(runs: Runs, known: Known, length: int) -> Iterator[tuple[int, int, int, list[list[int]]]]:
    """Confirmed passages of a block: run, first word, end, and the smallest doc_id of each range of its windows."""
    whole = known.find(runs.key, runs.digest)
    for i in np.flatnonzero(whole >= 0).tolist():
        yield i, int(runs.lo[i]), int(runs.end[i]), [[0, int(runs.end[i] - runs.lo[i]) - length + 1, int(known.table[whole[i], 2])]]
    run, w = runs.windows(np.flatnonzero((whole < 0) & np.isin(runs.key.view(np.int64), known.phrases)), length)
    at = known.find(runs.key[run], w)
    place = np.arange(len(run)) - np.searchsorted(run, run) + runs.lo[run]
    hit = at >= 0
    run, place, least = run[hit], place[hit], known.table[at[hit], 2]
    joined = (run[1:] == run[:-1]) & (place[1:] == place[:-1] + 1)
    heads = np.flatnonzero(np.r_[True, ~joined]) if len(run) else np.zeros(0, np.int64)
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(run)], strict=False):
        mine = least[a:b]
        cuts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        yield int(run[a]), int(place[a]), int(place[b - 1]) + length, [[x, y, v] for x, y, v in zip(cuts.tolist(), [*cuts[1:].tolist(), len(mine)], mine[cuts].tolist(), strict=True)]


def _automaton(docs: pa.Table, known: Known, length: int):
    """The automaton of a bucket's confirmed phrases; each leads to its passages."""
    import ahocorasick

    automaton, seen = ahocorasick.Automaton(), set()
    for block in blocks(docs.column("_text"), 1 << 20) if len(known.table) else ():
        runs = Runs(block, length)
        raw = block.buf.tobytes()
        starts, ends = runs.words.starts, runs.words.ends
        for i, lo, end, firsts in _passages(runs, known, length):
            words = raw[starts[lo] : ends[end - 1]].split()
            passage = " " + b" ".join(words).decode("latin-1") + " "
            at = int(runs.at[i]) - lo
            if (passage, at) in seen:
                continue
            seen.add((passage, at))
            phrase = " " + b" ".join(words[at : at + PHRASE]).decode("latin-1") + " "
            entry = (passage, sum(len(w) + 1 for w in words[:at]) + len(phrase), firsts)
            if phrase in automaton:
                automaton.get(phrase).append(entry)
            else:
                automaton.add_word(phrase, [entry])
    if len(automaton):
        automaton.make_automaton()
    return automaton


def _locate(docs: pa.Table, found: pa.Table, length: int) -> pa.Table:
    """One bucket: compile its phrases, stream its documents, remove what earlier documents have."""
    known = Known(np.concatenate([np.zeros((0, 3), np.int64), *(rows_of(x, 3) for x in found.column("rows").to_pylist())]))
    automaton = _automaton(docs, known, length)
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")}
    for doc_id, text in zip(docs.column("_id").to_pylist(), docs.column("_text").cast(pa.binary()).to_pylist(), strict=True):
        words = text.split()
        line = b" ".join(words)
        gone = None
        if len(automaton) and doc_id is not None and len(words) >= length:
            stream, number = " " + line.decode("latin-1") + " ", None
            for end, entries in automaton.iter(stream):
                for passage, back, firsts in entries:
                    start = end + 1 - back
                    if start >= 0 and stream.startswith(passage, start):
                        if number is None:
                            number = np.cumsum(np.frombuffer(stream.encode("latin-1"), np.uint8) == 32) - 1
                            gone = np.zeros(len(words) + 1, np.int64)
                        first = int(number[start])
                        for a, b, least in firsts:
                            if least < doc_id:
                                gone[first + a] += 1
                                gone[first + b - 1 + length] -= 1
        removed = 0
        if gone is not None:
            mask = np.cumsum(gone)[:-1] > 0
            removed = int(mask.sum())
            line = b" ".join([w for w, g in zip(words, mask.tolist(), strict=True) if not g])
        for name, x in (("doc_id", doc_id), ("n_words", len(words)), ("n_removed", removed), ("kept_sha256", hashlib.sha256(line).hexdigest()), ("kept", line)):
            out[name].append(x)
    return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept": pa.array(out["kept"], pa.binary())})


def deduplicate(docs: DataFrame, *, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", outputs: bool = False, held: int = HELD) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and the text kept (UTF-8) if ``outputs``."""
    spark = docs.sparkSession
    rows = keyed(docs, text=text, doc_id=doc_id)
    known = rows.where(F.col("_id").isNotNull()).select("_id", "_th", "_text")
    size = rows.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    buckets = int(size // BUCKET_BYTES) + 1
    bucket = F.pmod(F.xxhash64("_id", "_th"), F.lit(buckets))

    counted = arrow_map(known.select("_id", "_text"), lambda b: _phrases(b, length), "h long, lo long, hi long, c long, d long, m long")
    counted = counted.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("c").alias("c"), F.max("d").alias("d"), F.sum("m").alias("m"))
    phrases = stored(counted.where("lo < hi"))
    windows = phrases.where("c <> d").agg(F.sum("m")).first()[0] or 0
    shards = partitions(spark, int(windows // SHARD_WINDOWS) + 1)
    again = spark.sparkContext.broadcast(key_filter(phrases, "h"))
    several = spark.sparkContext.broadcast(key_filter(phrases.where("c <> d"), "h"))

    opened = arrow_map(known.select("_id", "_text"), lambda b: _windows(b, length, several, shards), PACKED)
    confirmed = stored(recurring(opened, shards, held))
    kept = spark.sparkContext.broadcast(bitmap(confirmed))
    lone = arrow_map(phrases.where("c = d").select("h", "c", "lo"), lambda b: _lone(b, shards), PACKED)
    asked = arrow_map(known.select(bucket.alias("bucket"), "_text"), lambda b: _asked(b, length, again, several, kept, shards), PACKED)
    dealt = answers(confirmed.unionByName(lone), asked, shards, held)
    left = rows.select(bucket.alias("bucket"), "_id", "_text").groupBy("bucket")
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
    out = left.cogroup(dealt.groupBy("bucket")).applyInArrow(lambda a, b: _locate(a, b, length), kind).withColumnRenamed("doc_id", doc_id)
    return out if outputs else out.drop("kept")
