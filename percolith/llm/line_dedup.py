"""Line dedup by a suffix array over line-ID sequences, made by distributed prefix doubling.

Every document is a sequence of line IDs.  Lines that two doc_ids have are found first; what takes part are
stretches of such lines, as a run with a copy in another document lies in one.  Prefix doubling ranks the
suffixes from every place of them by their first 8, 64, 512, .. lines (three doublings a round) until every class
is one place, or ends with its stretch: the ranks are the suffix array.  Common prefixes of neighbours are counted
from the doubling's depth on; a place with the same line before as its neighbour isn't counted, as it has one line
less in common than the place before.  A scan of the array in ranges keeps the open intervals of common prefixes with the smallest doc_id of
each; the innermost one with a smaller doc_id gives the longest run from a place that has an earlier copy.
Repeats within a document are found likewise by a suffix array of its own; there the earlier place is further up.
Runs that cannot be longer on either side are maximal, and are deleted.  A run has ``min_lines`` or more, or is
a single line of ``min_chars`` code points or more.  ``n_runs`` counts the stretches deleted.

Nothing is grouped by a line in one task: classes are counted by partial aggregates and sorted in ranges, as the
array is, and what ranges need of each other is a few numbers each.  Lines are told apart by two 64-bit hashes.

Edge cases: null counts as empty; an empty text has no lines.  Lines end at \n; blank lines are lines, but
``min_lines`` of only blank lines are no run, and of more blank lines than that within a run the inner ones
stay.  A row without doc_id has no earlier document and is earlier than none; rows that share a doc_id, or are
equal, are not earlier than each other.  What is deleted takes its line end with it.  An empty table gives an
empty table; a text of any length is one row.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map, drop, fields, free_name, key_filter, keyed, passes, same_row, stored, whole_row
from ._text import as_letters, blocks, mix, ranges, spans_hash

MIN_LINES = 2
MIN_CHARS = 40
COLUMNS = ("n_lines", "n_removed", "n_runs", "kept_sha256", "kept")


def _lines(batch: pa.RecordBatch) -> Iterator[dict]:
    """Per document: two hashes of each line and its length in code points (0: blank)."""
    a, b, size = ([None] * batch.num_rows for _ in range(3))
    for block in blocks(batch.column("_text")):
        buf, off = block.buf, block.off
        raw = buf.tobytes()
        breaks = np.flatnonzero(buf == 10)
        starts = np.unique(np.r_[off[:-1], breaks + 1])
        starts = starts[starts < len(buf)]
        ends = np.r_[starts[1:], len(buf)]
        ends = ends - ((ends > starts) & (buf[ends - 1] == 10)) if len(starts) else ends
        letters = as_letters(raw)
        one, two = spans_hash(letters, starts, ends), spans_hash(letters, starts, ends, 1)
        heads = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
        solid = np.r_[0, np.cumsum(~np.isin(buf, np.array([9, 11, 12, 13, 32, 10], np.uint8)))]
        chars = np.where(solid[ends] > solid[starts], heads[ends] - heads[starts], 0)
        cut = np.searchsorted(starts, off)
        for i in range(len(block)):
            s, row = slice(cut[i], cut[i + 1]), block.first + i
            a[row], b[row], size[row] = one[s].view(np.int64), two[s].view(np.int64), chars[s]
    yield {k: batch.column(k) for k in ("_id", "_th", "_r") if k in batch.schema.names} | {"a": a, "b": b, "size": size}


class Sequences:
    """The line sequences of a batch in one piece: two hashes and the length of each line, the row that it is of, and its place there."""

    def __init__(self, a, b, size):
        parts = [(x.flatten().to_numpy(), np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)) for x in (a, b, size)] if isinstance(a, pa.Array) else [(np.concatenate([np.zeros(0, np.int64), *(np.asarray(v).view(np.int64) for v in x)]), np.array([len(v) for v in x], np.int64)) for x in (a, b, size)]
        (self.a, counts), (self.b, _), (self.size, _) = parts
        self.a, self.b = self.a.view(np.uint64), self.b.view(np.uint64)
        self.first = np.r_[0, np.cumsum(counts)]
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(self.a)) - self.first[self.row]


def _named(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's lines, each with the smallest and largest doc_id that has it."""
    s = Sequences(*(batch.column(k) for k in ("a", "b", "size")))
    if not len(s.a):
        return
    d = batch.column("_id").to_numpy()[s.row]
    order = np.lexsort((s.b, s.a))
    d, x, y = d[order], s.a[order], s.b[order]
    at = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    yield {"x": x[at], "y": y[at], "lo": np.minimum.reduceat(d, at), "hi": np.maximum.reduceat(d, at)}


#: Prefix doubling makes three doublings a round: a key has the ranks of this many parts.
PARTS = 8


def _places(batch: pa.RecordBatch, min_lines: int, min_chars: int, bitmap) -> Iterator[dict]:
    """The places of stretches of lines that all recur: lines of the stretch before (``off``) and from the place on (``left``), the line
    before (``q``, 0: none), and the first lines as ``key``, two hashes each.

    A repeated run lies in one stretch.  Stretches too short for a run and without a line of ``min_chars`` are left out.
    """
    s = Sequences(*(batch.column(k) for k in ("a", "b", "size")))
    n = len(s.a)
    if not n:
        return
    at, ok = np.arange(n), passes(bitmap.value, s.a)
    end = np.minimum(np.minimum.accumulate(np.where(ok, n, at)[::-1])[::-1], s.first[s.row + 1])
    begin = np.maximum(np.maximum.accumulate(np.where(ok, 0, at + 1)), s.first[s.row])
    long = np.r_[0, np.cumsum(s.size >= min_chars)]
    at = at[ok]
    at = at[(end[at] - begin[at] >= min_lines) | (long[end[at]] > long[begin[at]])]
    row, off, left = s.row[at], at - begin[at], end[at] - at
    q = np.where(off > 0, mix(s.a[at - 1], 7) ^ s.b[at - 1], np.uint64(0))
    lines = np.minimum(left, PARTS)
    flat = np.column_stack((s.a, s.b)).view(np.int64)[ranges(at, lines)].reshape(-1)
    key = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(2 * lines)].astype(np.int32)), pa.array(flat))
    yield {"r": batch.column("_r").to_numpy()[row], "d": batch.column("_id").to_numpy()[row], "th": batch.column("_th").to_numpy()[row], "p": s.place[at].astype(np.int32), "off": off.astype(np.int32), "left": left.astype(np.int32), "q": q, "key": key}


def _padded(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    size = keys.value_lengths().to_numpy().astype(np.int64)
    out = np.zeros((len(size), 2 * PARTS), np.int64)
    out[np.arange(2 * PARTS) < size[:, None]] = keys.flatten().to_numpy()
    return out, size


def common_parts(keys: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers that a key has in common with the key before it; the first has none before it."""
    unlike = np.c_[keys[1:] != keys[:-1], np.ones(max(len(keys) - 1, 0), bool)]
    return np.r_[0, np.minimum(unlike.argmax(axis=1), np.minimum(size[1:], size[:-1]))]


def _counted(batches: Iterator[pa.RecordBatch], full: int) -> Iterator[pa.RecordBatch]:
    """Sorted classes of a range: how many places of the same old rank the range has before each, what keys have in common with the
    one before, and on the range's first and last row what the ranges need of each other."""
    part, last, total, old, held = TaskContext.get().partitionId(), None, 0, None, None
    more = False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield held
        rank, n = batch.column("rank").to_numpy(), batch.column("n").to_numpy()
        new = np.r_[rank[0] != last, rank[1:] != rank[:-1]]
        before = np.cumsum(n) - n
        start = np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))
        off = before - before[start] + np.where(np.cumsum(new) == 0, total, 0)
        keys, size = _padded(batch.column("key"))
        both = common_parts(keys, size) if old is None else common_parts(np.vstack((old[0], keys)), np.r_[old[1], size])[1:]
        edge = np.zeros(len(n), np.int32)
        edge[0] = 1 if last is None else 0
        more |= bool(((n > 1) & (size == full)).any())
        last, total, old = rank[-1], int(off[-1] + n[-1]), (keys[-1:], size[-1:])
        extra = {"off": pa.array(off), "both": pa.array(both.astype(np.int32)), "part": pa.array(np.full(len(n), part, np.int32)), "edge": pa.array(edge)}
        held = pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], names=[*batch.schema.names, *extra])
    if held is not None:
        edge = held.column("edge").to_numpy().copy()
        edge[-1] |= 2 | 4 * more
        yield held.set_column(held.schema.get_field_index("edge"), "edge", pa.array(edge))


def _by_part(values: dict[int, int], otherwise: Column) -> Column:
    """A number for some ranges' first rows."""
    if not values:
        return otherwise
    return F.coalesce(F.when(F.col("edge").bitwiseAND(1) > 0, F.element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), F.col("part"))), otherwise)


def ranked(places: DataFrame, depth: int) -> tuple[DataFrame, bool]:
    """Places get the ``rank`` by their key, which refines the rank by ``depth`` lines (0: the key is lines), and whether any place goes on.

    A rank is the number of suffixes before the class in the suffix array.  A class that left the one before it has ``low`` lines in
    common with that, and under ``span`` more.  ``more``: other places are in the class, and lines may follow.
    """
    full = 2 * PARTS if depth == 0 else PARTS
    classes = places.groupBy("rank", "key").agg(F.count("*").alias("n")).repartitionByRange("rank", "key").sortWithinPartitions("rank", "key")
    classes = stored(classes.mapInArrow(lambda b: _counted(b, full), "rank long, key array<long>, n long, off long, both int, part int, edge int"))
    # a rank's classes may lie in several ranges: what the ranges before hold of a range's first rank, and its last key
    ends, more = {}, False
    for x in classes.where("edge > 0").collect():
        ends.setdefault(x.part, [None, None])
        if x.edge & 1:
            ends[x.part][0] = x
        if x.edge & 2:
            ends[x.part][1] = x
        more |= x.edge >= 4
    ahead, both, last, held = {}, {}, None, 0
    for part, (a, b) in sorted(ends.items()):
        before = 0
        if last is not None and last.rank == a.rank:
            before = ahead[part] = held
            both[part] = next((k for k, (x, y) in enumerate(zip(last.key, a.key)) if x != y), min(len(last.key), len(a.key)))
        held = b.off + b.n + (before if a.rank == b.rank else 0)
        last = b
    # rows of the range's first rank also lie after its first row
    first = {part: a.rank for part, (a, _) in ends.items() if part in ahead}
    add = F.lit(0).cast("long")
    if ahead:
        pick = lambda m: F.element_at(F.create_map(*[F.lit(v).cast("long") for kv in m.items() for v in kv]), F.col("part").cast("long"))
        add = F.when(F.col("rank") == pick(first), pick(ahead)).otherwise(0)
    new = classes.select("rank", "key", "n", (F.col("rank") + F.col("off") + add).alias("new"), _by_part(both, F.col("both")).alias("both"))
    left_it = F.col("new") > F.col("rank")
    lines = F.col("both") * depth if depth else F.floor(F.col("both") / 2)
    low = F.when(left_it, lines.cast("int")).otherwise(F.col("low")).alias("low")
    span = F.when(left_it, F.lit(depth)).otherwise(F.col("span")).alias("span")
    on = ((F.col("n") > 1) & (F.size("key") == full)).alias("more")
    out = stored(places.join(new, ["rank", "key"]).select("r", "p", "off", "left", "d", "th", "q", F.col("new").alias("rank"), low, span, on))
    drop(classes)
    return out, more


def suffix_array(places: DataFrame) -> list[DataFrame]:
    """The places with their final ``rank``, ``low`` and ``span``, in parts; places whose rank is final take no part in later rounds."""
    zero = F.lit(0)
    state, more = ranked(places.withColumns({"rank": zero.cast("long"), "low": zero, "span": zero}), 0)
    depth, parts = PARTS, [state]
    fixed = ["left", "d", "th", "q", "low", "span", "off"]
    while more:
        ranks = state.select("r", "p", "off", "rank")
        for x in parts[:-1]:
            ranks = ranks.unionByName(x.where("not more").select("r", "p", "off", "rank"))
        shifts = F.explode(F.sequence(F.lit(1), F.least(F.lit(PARTS - 1), F.floor(F.col("off") / depth)).cast("int"))).alias("k")
        ranks = ranks.where(F.col("off") >= depth).select("r", "p", "rank", shifts).select("r", (F.col("p") - F.col("k") * depth).alias("p"), "k", "rank")
        now = state.where("more").withColumn("k", F.lit(0)).select("r", "p", "k", "rank", *fixed)
        both = now.unionByName(ranks, allowMissingColumns=True).groupBy("r", "p")
        both = both.agg(*[F.max(F.when(F.col("k") == k, F.col("rank"))).alias(f"k{k}") for k in range(PARTS)], *[F.max(c).alias(c) for c in fixed])
        key = F.array_compact(F.array(*[f"k{k}" for k in range(PARTS)])).alias("key")
        step = stored(both.where("k0 is not null").select("r", "p", *fixed, F.col("k0").alias("rank"), key))
        state, more = ranked(step, depth)
        parts.append(state)
        drop(step)
        depth *= PARTS
    return parts


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of the suffix array: its rows with their number in it, the row before each, and which row is the last."""
    part, at, tail = TaskContext.get().partitionId(), 0, None
    names = ["rank", "r", "p", "q"]
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield held
        n = batch.num_rows
        before = [pa.concat_arrays([pa.array([None if tail is None else tail[k]], batch.column(k).type), batch.column(k).slice(0, n - 1)]) for k in names]
        tail = {k: batch.column(k)[n - 1].as_py() for k in names}
        extra = [*before, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(np.zeros(n, bool))]
        held = pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *[f"{k}0" for k in names], "part", "idx", "end"])
        at += n
    if held is not None:
        end = np.zeros(held.num_rows, bool)
        end[-1] = True
        yield held.set_column(held.schema.get_field_index("end"), "end", pa.array(end))


def _blocks(batch: pa.RecordBatch) -> Iterator[dict]:
    """The ``span`` lines from ``low`` on after a place, for each that is asked for."""
    out = {k: [] for k in ("r", "p", "side", "low", "lines")}
    s = Sequences(batch.column("a"), batch.column("b"), batch.column("a"))
    both = np.column_stack((s.a, s.b))
    for i, asked in enumerate(batch.column("asked").to_pylist()):
        for x in asked:
            at = s.first[i] + x["p"] + x["low"]
            out["lines"].append(both[at : min(at + x["span"], s.first[i + 1])].tobytes())
            out["r"].append(x["pr"])
            out["p"].append(x["pp"])
            out["side"].append(x["side"])
            out["low"].append(x["low"])
    yield out


def _common(batch: pa.RecordBatch) -> Iterator[dict]:
    """Common prefixes of pairs whose lines from ``low`` on are given."""
    lcp = []
    for low, one, two in zip(*(batch.column(k).to_pylist() for k in ("low", "one", "two")), strict=True):
        n = min(len(one), len(two))
        x, y = (np.frombuffer(v[:n], np.int64).reshape(-1, 2) for v in (one, two))
        other = np.flatnonzero((x != y).any(axis=1))
        lcp.append(low + (int(other[0]) if len(other) else len(x)))
    yield {"r": batch.column("r"), "p": batch.column("p"), "lcp": pa.array(lcp, pa.int32())}


def _followed(batch: pa.RecordBatch) -> Iterator[dict]:
    """Common prefixes along a document: a place whose line before is also before its neighbour (-1) has one line less than the place
    before; a place that was measured (-2) has another row."""
    count = np.nan_to_num(batch.column("rows").value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = batch.column("rows").flatten()
    row = np.repeat(np.arange(len(count)), count)
    p, lcp = flat.field("p").to_numpy().astype(np.int64), flat.field("lcp").to_numpy().astype(np.int64)
    own = flat.field("own").to_numpy(zero_copy_only=False)
    order = np.lexsort((own, p, row))  # what was measured before the place's own row
    p, lcp, own = p[order], lcp[order], own[order]
    lcp[1:] = np.where(lcp[1:] == -2, lcp[:-1], lcp[1:])
    known = np.maximum.accumulate(np.where(lcp >= 0, np.arange(len(lcp)), 0))
    lcp = np.where(lcp >= 0, lcp, lcp[known] - (p - p[known]))
    order, p, lcp = order[own], p[own], lcp[own]
    yield {"r": batch.column("r").to_numpy()[row[order]], "p": p.astype(np.int32), "lcp": lcp.astype(np.int32)} | {k: flat.field(k).to_numpy()[order] for k in ("rank", "d", "th")}


class Intervals:
    """The open LCP intervals at a row of the suffix array, each with its first owner; intervals without an owner of their own are left out.

    From the outermost to the innermost, common prefixes and owners rise.
    """

    def __init__(self, lcp=(), owner=()):
        self.lcp, self.owner = list(lcp), list(owner)

    def close(self, lcp: int) -> None:
        """On to a row that has ``lcp`` lines in common with the last."""
        first = None
        while self.lcp and self.lcp[-1] > lcp:
            self.lcp.pop()
            first = self.owner.pop()
        if first is not None and lcp > 0 and not (self.lcp and self.lcp[-1] == lcp):
            self.lcp.append(lcp)
            self.owner.append(first)

    def add(self, lcp: int, owner: int) -> None:
        while self.owner and self.owner[-1] >= owner:
            self.lcp.pop()
            self.owner.pop()
        self.lcp.append(lcp)
        self.owner.append(owner)

    def longest(self, owner: int) -> int:
        """The lines in common with an earlier owner: the innermost interval that has one."""
        k = bisect_left(self.owner, owner)
        return self.lcp[k - 1] if k else 0

    def with_outer(self, other: Intervals, lcp: int) -> Intervals:
        """These and the intervals of the rows beyond, with which the row has ``lcp`` lines in common at most."""
        pairs = sorted([*zip(self.lcp, self.owner), *((min(x, lcp), o) for x, o in zip(other.lcp, other.owner))], key=lambda x: (-x[0], x[1]))
        out, least = [], None
        for x, o in pairs:
            if x > 0 and (least is None or o < least):
                out.append((x, o))
                least = o
        out.reverse()
        return Intervals([x for x, _ in out], [o for _, o in out])


WHOLE = 1 << 30


def earlier_copies(lcp: list[int], owner: list[int]) -> tuple[list[int], Intervals, Intervals]:
    """For rows of a suffix array and their common prefixes with the row before: the lines in common with an earlier owner's
    row, the intervals open after the last row, and those open before the first."""
    n = len(lcp)
    best = [0] * n
    after = Intervals()
    for i in range(n):
        after.close(lcp[i])
        best[i] = after.longest(owner[i])
        after.add(WHOLE, owner[i])
    before = Intervals()
    for i in range(n - 1, -1, -1):
        if i < n - 1:
            before.close(lcp[i + 1])
        best[i] = max(best[i], before.longest(owner[i]))
        before.add(WHOLE, owner[i])
    return best, after, before


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of the suffix array: the longest earlier copy in it from each place, how many lines a place has in common with the
    ranges before and after, at most, and what the other ranges need of this one."""
    part = TaskContext.get().partitionId()
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found).combine_chunks()
    lcp = table["lcp"].to_numpy().astype(np.int64)
    n = len(lcp)
    best, after, before = earlier_copies(lcp.tolist(), table["d"].to_numpy().tolist())
    to_first = np.minimum.accumulate(lcp)
    to_last = np.r_[np.minimum.accumulate(lcp[1:][::-1])[::-1], WHOLE]
    ends = json.dumps([int(lcp[0]), int(to_last[0]), after.lcp, after.owner, before.lcp, before.owner])
    out = {"r": table["r"], "p": table["p"], "d": table["d"], "th": table["th"], "best": np.array(best, np.int64), "to_first": to_first, "to_last": to_last, "part": np.full(n, part, np.int32), "ends": [ends, *[None] * (n - 1)]}
    whole = pa.table({k: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else pa.array(v, pa.string()) if k == "ends" else pa.array(v) for k, v in out.items()})
    yield from whole.to_batches(max_chunksize=1 << 16)


def _joined_ranges(ends: list[tuple[int, str]]) -> dict[int, tuple[Intervals, Intervals]]:
    """By range: the intervals of all rows before its first and after its last."""
    made = [(part, *json.loads(x)) for part, x in sorted(ends)]
    ahead, behind = {}, {}
    now = Intervals()
    for part, first, inner, a, b, _, _ in made:
        ahead[part] = now
        now = Intervals(a, b).with_outer(now, min(first, inner))
    now = Intervals()
    for part, first, inner, _, _, a, b in reversed(made):
        behind[part] = now
        now = Intervals().with_outer(Intervals(a, b).with_outer(now, inner), first)
    return {part: (ahead[part], behind[part]) for part in ahead}


def _completed(batch: pa.RecordBatch, beyond) -> Iterator[dict]:
    """Longest earlier copies over all ranges; places without one are dropped."""
    best = batch.column("best").to_numpy().copy()
    d, part = batch.column("d").to_numpy(), batch.column("part").to_numpy()
    for side, name in enumerate(("to_first", "to_last")):
        most = batch.column(name).to_numpy()
        for i in np.flatnonzero(most > best).tolist():
            best[i] = max(best[i], min(int(most[i]), beyond.value[int(part[i])][side].longest(int(d[i]))))
    at = np.flatnonzero(best > 0)
    yield {"_id": d[at], "_th": batch.column("th").to_numpy()[at], "at": batch.column("p").to_numpy()[at], "n": best[at].astype(np.int32)}


def copies(table: DataFrame, min_lines: int, min_chars: int) -> DataFrame:
    """(_id, _th, at, n): places from which ``n`` lines, and no more, have a copy in a document of a smaller doc_id."""
    spark = table.sparkSession
    lines = arrow_map(table, _named, "x long, y long, lo long, hi long")
    lines = lines.groupBy("x", "y").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("x")
    again = spark.sparkContext.broadcast(key_filter(lines, "x"))
    kind = "r long, d long, th long, p int, off int, left int, q long, key array<long>"
    parts = suffix_array(arrow_map(table, lambda t: _places(t, min_lines, min_chars, again), kind))
    columns = ["rank", "r", "p", "q", "d", "th", "left", "low", "span"]
    array = parts[0].where("not more").select(columns)
    for x in parts[1:]:
        array = array.unionByName(x.where("not more").select(columns))
    array = array.repartitionByRange("rank", "r", "p").sortWithinPartitions("rank", "r", "p")
    kind = "rank long, r long, p int, q long, d long, th long, left int, low int, span int"
    array = stored(array.mapInArrow(_ordered, kind + ", rank0 long, r0 long, p0 int, q0 long, part int, idx long, end boolean"))
    drop(*parts)
    # the row before a range's first is the last of the range before
    last, tails = (None,) * 4, []
    for x in sorted(array.where("end").select("part", "rank", "r", "p", "q").collect()):
        tails.append((x.part, *last))
        last = tuple(x[1:])
    tails = spark.createDataFrame(tails, "part int, rank1 long, r1 long, p1 int, q1 long")
    before = ["rank0", "r0", "p0", "q0"]
    first = array.where("idx = 0").join(F.broadcast(tails), "part").select(*columns, *[F.col(k.replace("0", "1")).alias(k) for k in before])
    lcp = F.when(F.col("rank0").isNull(), 0).when(F.col("rank0") == F.col("rank"), F.col("left")).when(F.col("span") == 0, F.col("low"))
    lcp = lcp.when((F.col("q") != 0) & (F.col("q") == F.col("q0")), -1).otherwise(-2).alias("lcp")
    pairs = stored(array.where("idx > 0").select(*columns, *before).unionByName(first).select("rank", "r", "p", "d", "th", "r0", "p0", "low", "span", lcp))
    drop(array)
    open_ = pairs.where("lcp = -2")
    ask = "struct({p} as p, low, span, r as pr, p as pp, {side} as side) as x"
    asked = open_.selectExpr("r as _r", ask.format(p="p", side=0)).unionByName(open_.selectExpr("r0 as _r", ask.format(p="p0", side=1)))
    asked = asked.groupBy("_r").agg(F.collect_list("x").alias("asked")).join(table.select("_r", "a", "b"), "_r")
    got = arrow_map(asked, _blocks, "r long, p int, side int, low int, lines binary").groupBy("r", "p")
    got = got.agg(F.max("low").alias("low"), *[F.max(F.when(F.col("side") == k, F.col("lines"))).alias(v) for k, v in enumerate(("one", "two"))])
    measured = arrow_map(got, _common, "r long, p int, lcp int")
    none = F.lit(0).cast("long")
    rows = pairs.select("r", F.struct("p", "lcp", F.lit(True).alias("own"), "rank", "d", "th").alias("x"))
    rows = rows.unionByName(measured.select("r", F.struct("p", "lcp", F.lit(False).alias("own"), none.alias("rank"), none.alias("d"), none.alias("th")).alias("x")))
    rows = rows.groupBy("r").agg(F.collect_list("x").alias("rows"))
    whole = arrow_map(rows, _followed, "r long, p int, lcp int, rank long, d long, th long")
    whole = whole.repartitionByRange("rank", "r", "p").sortWithinPartitions("rank", "r", "p")
    scanned = stored(whole.mapInArrow(_scanned, "r long, p int, d long, th long, best long, to_first long, to_last long, part int, ends string"))
    drop(pairs)
    beyond = spark.sparkContext.broadcast(_joined_ranges([tuple(x) for x in scanned.where("ends is not null").select("part", "ends").collect()]))
    return arrow_map(scanned, lambda t: _completed(t, beyond), "_id long, _th long, at int, n int")


def own_copies(s: Sequences) -> tuple[np.ndarray, np.ndarray]:
    """Places from which lines have a copy further up in the same document, and how many; by the suffix array of the lines that recur there."""
    n = len(s.a)
    order = np.lexsort((s.b, s.a, s.row))
    same = (s.row[order[1:]] == s.row[order[:-1]]) & (s.a[order[1:]] == s.a[order[:-1]]) & (s.b[order[1:]] == s.b[order[:-1]])
    if not same.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = np.zeros(n, np.int64)
    line[order] = np.cumsum(np.r_[True, ~same])
    again = np.zeros(n, bool)
    again[order] = np.r_[False, same] | np.r_[same, False]
    at = np.arange(n)
    left = np.minimum(np.minimum.accumulate(np.where(again, n, at)[::-1])[::-1], s.first[s.row + 1]) - at
    at = np.flatnonzero(again)
    ranks, depth = [line], 1  # the ranks by 1, 2, 4, .. lines; a run that its stretch cuts short has the rank of what is there
    while True:
        rank = ranks[-1]
        then = np.where(left[at] > depth, rank[np.minimum(at + depth, n - 1)], -1)
        order = np.lexsort((then, rank[at]))
        new = np.r_[True, (rank[at][order[1:]] != rank[at][order[:-1]]) | (then[order[1:]] != then[order[:-1]])]
        made = np.zeros(n, np.int64)
        made[at[order]] = np.cumsum(new)
        ranks.append(made)
        depth *= 2
        if not ((then[order] >= 0) & ~(new & np.r_[new[1:], True])).any():
            break
    array = at[np.lexsort((at, ranks[-1][at]))]
    i, j = array[1:], array[:-1]
    common = np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        room = (left[i] - common >= 1 << k) & (left[j] - common >= 1 << k)
        x, y = np.minimum(i + common, n - 1), np.minimum(j + common, n - 1)
        common += np.where(room & (ranks[k][x] == ranks[k][y]), 1 << k, 0)
    best = np.array(earlier_copies([0, *common.tolist()], array.tolist())[0], np.int64)
    return array[best > 0], best[best > 0]


def maximal(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of the longest runs with earlier copies, in order of place, are not the rest of the one before."""
    return np.r_[True, (at[1:] != at[:-1] + 1) | (n[1:] != n[:-1] - 1)] if len(at) else np.zeros(0, bool)


def _delete(batch: pa.RecordBatch, min_lines: int, min_chars: int, outputs: bool) -> Iterator[dict]:
    n, spans = batch.num_rows, None
    removed, runs = np.zeros(n, np.int64), np.zeros(n, np.int64)
    body = batch.column("_text").to_pylist()
    texts = list(body)
    for part in _lines(batch):
        s = Sequences(part["a"], part["b"], part["size"])
        total = len(s.a)
        found = batch.column("found")
        inner = found.flatten()
        row = np.repeat(np.arange(n), np.nan_to_num(found.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
        longest = np.zeros(total, np.int64)
        for at, length in (s.first[row] + inner.field("at").to_numpy().astype(np.int64), inner.field("n").to_numpy()), own_copies(s):
            np.maximum.at(longest, at, length)
        at = np.flatnonzero(longest)
        at = at[maximal(at, longest[at])]
        length = longest[at]
        inside = np.bincount(at, minlength=total + 1) - np.bincount(at + length, minlength=total + 1)
        mask = (np.cumsum(inside)[:-1] > 0) & (s.size >= min_chars)
        long = length >= min_lines
        if min_lines > 1 and long.any():  # all of such a run but what no ``min_lines`` cover without being blank
            inside = np.bincount(at[long], minlength=total + 1) - np.bincount(at[long] + length[long] - min_lines + 1, minlength=total + 1)
            solid = np.r_[0, np.cumsum(s.size > 0)]
            start = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
            start = start[solid[start + min_lines] > solid[start]]
            gone = np.bincount(start, minlength=total + 1) - np.bincount(start + min_lines, minlength=total + 1)
            mask |= np.cumsum(gone)[:-1] > 0
        if outputs:
            many = np.r_[0, np.cumsum(s.size >= min_chars)]
            listed = long | (many[at + length] > many[at])
            at, length = at[listed], length[listed]
            cut = np.searchsorted(at, s.first)
            spans = [[{"at": int(x), "n": int(y)} for x, y in zip(s.place[at[a:b]], length[a:b], strict=True)] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        sums = np.r_[0, np.cumsum(mask)]
        removed = sums[s.first[1:]] - sums[s.first[:-1]]
        for i in np.flatnonzero(removed).tolist():
            mine = mask[s.first[i] : s.first[i + 1]]
            runs[i] = int((np.diff(np.r_[0, mine.astype(np.int8)]) == 1).sum())
            left = [x for x, g in zip(body[i].split("\n"), [*mine.tolist(), False], strict=False) if not g]
            texts[i] = "" if mine.all() else "\n".join(left)
        lines = np.diff(s.first)
    kept = [hashlib.sha256(x.encode()).hexdigest() for x in texts]
    yield {"_id": batch.column("_id"), "_th": batch.column("_th"), "n_lines": lines, "n_removed": removed, "n_runs": runs, "kept_sha256": kept, "kept": texts, "runs": spans}


def deduplicate(docs: DataFrame, *, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None, outputs: bool = False) -> DataFrame:
    """One row per document: the ``carry`` columns (doc_id), n_lines, n_removed, n_runs, kept_sha256 and kept (the text left);
    with ``outputs`` also runs, the maximal runs that have an earlier copy: first line (from 0) and lines of each."""
    rows = keyed(docs, text=text, doc_id=doc_id)
    named = rows.where(F.col("_id").isNotNull()).withColumn("_r", F.monotonically_increasing_id())
    table = stored(arrow_map(named, _lines, "_id long, _th long, _r long, a array<long>, b array<long>, size array<long>"))
    found = copies(table, min_lines, min_chars).groupBy("_id", "_th").agg(F.collect_list(F.struct("at", "n")).alias("found"))
    drop(table)
    keep = [doc_id] if carry is None else carry
    body = keyed(docs, text=text, doc_id=doc_id)
    if keep != [doc_id]:
        whole = docs.select(whole_row(docs, keep).alias("_row"), F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
        body = whole.withColumn("_th", F.xxhash64("_text"))
    joined = body.join(found, same_row(body, found), "left").drop(found["_id"]).drop(found["_th"])
    row = [] if keep == [doc_id] else [body.schema["_row"]]

    def last(batch: pa.RecordBatch) -> Iterator[dict]:
        for out in _delete(batch, min_lines, min_chars, outputs):
            yield out | ({"_row": batch.column("_row")} if row else {})

    out = arrow_map(joined, last, fields("_id long, n_lines long, n_removed long, n_runs long, kept_sha256 string, kept string" + (", runs array<struct<at: int, n: int>>" if outputs else ""), *row))
    first = [F.col("_row").getField(c).alias(free_name(c, COLUMNS)) for c in keep] if row else [F.col("_id").alias(doc_id)]
    return out.select(*first, *COLUMNS, *(["runs"] if outputs else []))
