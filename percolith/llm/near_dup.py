"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Every document is its set of distinct word shingles.  Equal sets are one class, so copies are never
paired.  A set is sketched with ``bands * rows`` coordinates: in each round every element is hashed to a
coordinate and a value, and a coordinate keeps the least value of the first round that reaches it; after
as many rounds as coordinates, one more round each sends all elements to a coordinate still empty, so
all fill.  Coordinates of two sets agree with probability equal to their similarity, concentrated about
it.  A band is ``rows`` coordinates; classes that agree on a band share a bucket.

Pairs of a bucket are not listed.  First every class is compared with one centre, the least class it shares
a bucket with, and links are merged into components.  A bucket whose members are one component is settled.
In the others every class outside the bucket's largest component names the classes of other components whose
sketches agree best with its own: one in the first round, ``MORE`` times as many in each that follows, until
no class has more to name; those not yet compared are, on the full sets.  A pair that shares several buckets is
named in the first of them only, so a group of copies isn't named once a band.  A bucket of any size is read in
chunks of ``CHUNK`` members, through which the classes outside its largest component are streamed, so no task
holds a whole bucket.

A pair is passed over only where sizes rule it out, or where sketches of ``FINE`` coordinates agree less than
at the threshold by ``DEVIATIONS`` standard deviations: a chance of 4e-6 for a pair at the threshold, far less
above it, and then only if no other link joins its components.  All other pairs that share a bucket and are of
different components are compared in full, so no other link is lost.

The chance that a pair of similarity s shares no bucket is (1 - s**rows)**bands: 2e-7 at 0.85 with 7 rows
and 40 bands, 2e-6 at 0.8 with 7 and 56; for lower thresholds rows and bands are chosen for 1e-5 at most.  Classes are told apart by a 64-bit digest of the set.

Edge cases: a null text or one without words has the empty set and is linked with nothing; fewer words
than a shingle make one shingle.  A null doc_id is no smallest doc_id: a component of nothing else has a
null component_id and is kept.  Rows that share doc_id and text get equal results; ties in agreement go to
the smaller digest.  An empty table gives an empty table, a text of any length is one set, and other columns
take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map, as_batch, bound_batches, drop, key_filter, keyed, partitions, passes, stored
from ._text import Block, Words, blocks, mix, spans_hash

SHINGLE = 5
#: Greatest chance of missing a pair at the threshold, and most coordinates of a sketch for it.
MISS, COORDINATES = 1e-5, 400
#: Members of a bucket that are held at once; how many times as many classes are named in each round.
CHUNK, MORE = 4096, 32
#: Coordinates of the sketch that pairs are passed over by, two bits each, and how many deviations below.
FINE, DEVIATIONS = 1024, 4.5
#: Members that are verified against a centre in one group.
GROUP = 128
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def banding(similarity: float) -> tuple[int, int]:
    """(bands, rows) for a threshold, at which a pair is missed with a chance of ``MISS`` at most.

    Under 0.8 the most rows that do with ``COORDINATES``; thresholds that one row does not do for are refused.
    """
    if similarity >= 0.8:
        return (40, 7) if similarity >= 0.85 else (56, 7)
    for rows in range(6, 0, -1):
        share = similarity**rows
        if share > 0 and (bands := math.ceil(math.log(MISS) / math.log1p(-share))) * rows <= COORDINATES:
            return bands, rows
    raise ValueError(f"no banding finds pairs of similarity {similarity}")


def shingle_sets(block: Block, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each document of a block, as 64-bit hashes."""
    words = Words(block, "folded")
    at, h = words.windows(k)
    cuts = np.searchsorted(at, words.first)
    out = []
    for i in range(len(block)):
        a, b = int(words.first[i]), int(words.first[i + 1])
        if 0 < b - a < k:
            out.append(spans_hash(words.hash, np.array([a]), np.array([b])))
        else:
            out.append(np.unique(h[cuts[i] : cuts[i + 1]]))
    return out


def sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch of a set that isn't empty: each coordinate is (round, value) in one number."""
    out = np.full(size, _EMPTY)
    low, done = np.uint64((1 << 52) - 1), 0
    while done < size and (out == _EMPTY).any():
        n = min(size - done, max(1, 2 * size // len(elements)))
        rounds = np.arange(done, done + n, dtype=np.uint64)[:, None]
        h = mix(elements[None, :] + (rounds + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        place = ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        np.minimum.at(out, place.astype(np.int64).ravel(), ((mix(h, 3) & low) | (rounds << np.uint64(52))).ravel())
        done += n
    for i in np.flatnonzero(out == _EMPTY):
        out[i] = (mix(elements, 1000 + int(i)).min() & low) | np.uint64(0xFFF << 52)
    return out


def _digest(elements: np.ndarray) -> int:
    total = mix(elements, 11)
    return int(mix(np.array([total.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(mix(elements, 12))]), 13).view(np.int64)[0]) if len(elements) else 0


def _signatures(batch: pa.RecordBatch, k: int, bands: int, rows: int) -> Iterator[dict]:
    n = np.zeros(batch.num_rows, np.int64)
    node, keys, seen = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, set()
    salts = np.arange(bands, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for block in blocks(batch.column("_text")):
        for i, elements in enumerate(shingle_sets(block, k), block.first):
            n[i] = len(elements)
            if len(elements):
                node[i] = _digest(elements)
                if node[i] not in seen:  # once a batch is enough
                    seen.add(int(node[i]))
                    parts, h = sketch(elements, bands * rows).reshape(bands, rows), salts
                    for r in range(rows):
                        h = mix(h + parts[:, r], r + 1)
                    keys[i] = h.view(np.int64).tolist()
    yield {"_id": batch.column("_id"), "_th": batch.column("_th"), "n": n, "node": node, "keys": keys}


def _members(batch: pa.RecordBatch, bitmap) -> Iterator[dict]:
    column = batch.column("keys")
    keys = column.flatten().to_numpy()
    row = np.repeat(np.arange(batch.num_rows), np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    at = np.flatnonzero(passes(bitmap.value, keys))
    yield {"key": keys[at], "node": batch.column("node").to_numpy()[row[at]]}


def _bits(elements: np.ndarray) -> bytes:
    """Two bits of each coordinate of a sketch, four to a byte."""
    low = (mix(sketch(elements, FINE)) & np.uint64(3)).astype(np.uint8).reshape(-1, 4)
    return (low << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many coordinates agree, of rows of packed bits."""
    x = a ^ b
    return FINE - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)


def _unpacked(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), FINE // 32)


def least_agreement(percent: int) -> float:
    """Coordinates that agree, under which a pair is passed over; unlike ones agree in two bits by chance of a quarter."""
    q = percent / 100 + (1 - percent / 100) / 4
    return FINE * q - DEVIATIONS * (FINE * q * (1 - q)) ** 0.5


def _pool(batch: pa.RecordBatch, k: int, bitmap) -> Iterator[dict]:
    """Sets of the classes that share a bucket, each with the bits of its sketch."""
    seen: dict[int, tuple[bytes, bytes]] = {}
    for block in blocks(batch.column("_text")):
        for elements in shingle_sets(block, k):
            if len(elements) and (node := _digest(elements)) not in seen and passes(bitmap.value, np.array([node], np.int64))[0]:
                seen[node] = elements.tobytes(), _bits(elements)
    yield {"node": list(seen), "elements": [x[0] for x in seen.values()], "bits": [x[1] for x in seen.values()]}


def _asked(batch: pa.RecordBatch, bitmap) -> Iterator[dict]:
    keep = pa.array(passes(bitmap.value, batch.column("node").to_numpy()))
    yield {"node": batch.column("node").filter(keep), "elements": batch.column("elements").filter(keep)}


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (centre, part), the centre's own set first: the members linked with it."""
    centre, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b = [], []
        for c, node, elements in zip(batch.column("centre").to_pylist(), batch.column("node").to_pylist(), batch.column("elements").to_pylist(), strict=True):
            if c == node:
                centre, own = c, np.frombuffer(elements, np.uint64)
                continue
            mine = np.frombuffer(elements, np.uint64)
            if c != centre or 100 * min(len(own), len(mine)) < percent * max(len(own), len(mine)):
                continue
            at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
            both = int((own[at] == mine).sum())
            if 100 * both >= percent * (len(own) + len(mine) - both):
                a.append(c)
                b.append(node)
        yield as_batch({"a": a, "b": b}, _LINKS)


def _few(df: DataFrame) -> DataFrame:
    """Stored in an eighth of the usual number of files: for tables that hold a few numbers a class, which need fewer tasks."""
    return stored(df.coalesce(max(8, partitions(df.sparkSession) // 8)))


def links(pool: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (centre, node), those similar enough on their full sets, as (a, b).

    Sets travel once to their centre; a centre of many is repeated for every ``GROUP`` of them.
    """
    spark = pool.sparkSession
    size = pairs.groupBy("centre").agg(F.count("*").alias("m"))
    parts = (F.col("m") / GROUP).cast("int") + 1
    dealt = pairs.join(size, "centre").select("centre", F.pmod(F.xxhash64("node"), parts).cast("long").alias("part"), "node")
    own = size.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("part"), F.col("centre").alias("node"))
    asked = _few(dealt.unionByName(own))
    bitmap = spark.sparkContext.broadcast(key_filter(asked.select("node"), "node"))
    sets = arrow_map(pool.select("node", "elements"), lambda b: _asked(b, bitmap), "node long, elements binary")
    ready = asked.join(sets, "node").select("centre", "part", "node", "elements")
    placed = ready.repartition(partitions(spark), "centre", "part").sortWithinPartitions("centre", "part", F.col("node") != F.col("centre"))
    bound_batches(spark)
    out = stored(placed.mapInArrow(lambda b: _verify(b, percent), "a long, b long"))
    drop(asked)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label), the least node reachable, for every node of ``edges`` (a, b).

    Labels spread along edges and then jump to their label's label, so rounds grow with the logarithm of
    the longest path.  All rounds are joins; only a count reaches the driver.
    """
    both = _few(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = _few(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = _few(step.join(up, "label", "left").select("node", "old", F.least("label", "up").alias("label")))
        drop(labels)
        labels = new
        if not new.where("old <> label").limit(1).count():
            drop(both)
            return new


class _Named:
    """The pairs that classes name in one task; ``more`` if any had more to name."""

    def __init__(self, percent: int, most: int):
        self.percent, self.most, self.least = percent, most, least_agreement(percent)
        self.pairs: set[tuple[int, int]] = set()
        self.more = False

    def add(self, key: int, row: tuple, bits: np.ndarray, others: tuple) -> None:
        """``row`` and ``others`` have node, size of the set, label and buckets; the others as arrays, with their bits."""
        node, n, label, own = row
        nodes, sizes, labels, buckets, theirs = others
        j = np.flatnonzero((labels != label) & (100 * np.minimum(sizes, n) >= self.percent * np.maximum(sizes, n)))
        if not len(j):
            return
        same = _agreement(theirs[j], bits)
        j, same = j[same >= self.least], same[same >= self.least]
        left = self.most
        for q in j[np.lexsort((nodes[j], -same))].tolist():
            if not left:
                self.more = True  # perhaps; the next round will tell
                break
            if min(own & buckets[q]) == key:
                other = int(nodes[q])
                self.pairs.add((min(node, other), max(node, other)))
                left -= 1

    def taken(self) -> pa.RecordBatch:
        rows, self.pairs = list(self.pairs), set()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in rows], pa.int64()), pa.array([p[1] for p in rows], pa.int64())], names=["centre", "node"])


def _listed(batches: Iterator[pa.RecordBatch], percent: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, chunk, guest): a chunk's members, held, then the classes that are streamed through it.

    A class outside the bucket's largest component names its best partners among a chunk's members.
    """
    named, at, members = _Named(percent, most), None, []
    held: tuple | None = None

    def settle() -> tuple:
        found = (*(np.array([m[k] for m in members], np.int64) for k in range(3)), [m[3] for m in members], _unpacked([m[4] for m in members]))
        for i in np.flatnonzero([m[5] for m in members]).tolist():
            named.add(at[0], members[i][:4], found[4][i], found)
        return found

    for batch in batches:
        for key, chunk, guest, node, n, label, own, bits, minor in zip(*(batch.column(k).to_pylist() for k in ("key", "chunk", "guest", "node", "n", "label", "own", "bits", "minor")), strict=True):
            if (key, chunk) != at:
                if members and held is None:
                    settle()
                at, members, held = (key, chunk), [], None
            if not guest:
                members.append((node, n, label, set(own), bits, minor))
                continue
            if held is None:
                held = settle()
            named.add(key, (node, n, label, set(own)), _unpacked([bits])[0], held)
        if len(named.pairs) > 1 << 16:
            yield named.taken()
    if members and held is None:
        settle()
    yield named.taken()
    if named.more:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64())], names=["centre", "node"])


def _agreeing(batch: pa.RecordBatch, percent: int) -> Iterator[dict]:
    """Pairs whose sketches agree well enough."""
    a, b = (_unpacked(batch.column(k).to_pylist()) for k in ("bits", "others"))
    same = pa.array(_agreement(a, b) >= least_agreement(percent))
    yield {"centre": batch.column("centre").filter(same), "node": batch.column("node").filter(same)}


def _merge(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels of all nodes after new links: components of the labels that links join, then one look-up."""
    named = edges.join(labels.withColumnsRenamed({"node": "a", "label": "la"}), "a").join(labels.withColumnsRenamed({"node": "b", "label": "lb"}), "b")
    joined = _few(named.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    out = labels
    if joined.limit(1).count():
        found = components(joined)
        top = found.select(F.col("node").alias("label"), F.col("label").alias("top"))
        out = _few(labels.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")))
        drop(labels, found)
    drop(joined, edges)
    return out


def _candidates(members: DataFrame, labels: DataFrame, known: DataFrame, percent: int, most: int) -> DataFrame:
    """Pairs (centre, node) of different components that classes name; a row of nulls says that there are more."""
    named = members.join(labels, "node")
    counts = named.groupBy("key", "label").agg(F.count("*").alias("c"))
    shape = counts.groupBy("key").agg(F.sum("c").alias("m"), F.count("*").alias("labels"), F.max(F.struct("c", "label")).alias("top")).where("labels > 1")
    chunks = (F.col("m") / CHUNK).cast("int") + 1
    placed = named.join(shape.select("key", chunks.alias("chunks"), F.col("top.label").alias("top")), "key").join(known, "node")
    minor, home = F.col("label") != F.col("top"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    visits = F.when(minor & (F.col("chunks") > 1), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(home))
    rows = placed.select("key", "node", "n", "label", "own", "bits", minor.alias("minor"), home.alias("home"), F.explode(visits).alias("chunk")).withColumn("guest", F.col("chunk") != F.col("home"))
    ordered = rows.drop("home").repartition(partitions(members.sparkSession), "key", "chunk").sortWithinPartitions("key", "chunk", "guest")
    bound_batches(members.sparkSession)
    return ordered.mapInArrow(lambda b: _listed(b, percent, most), "centre long, node long").distinct()


def near_duplicates(docs: DataFrame, *, similarity: float = 0.8, shingle: int = SHINGLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(_id, _th, n_shingles, component_id, component, kept) for every row of ``docs``.

    _th is xxhash64 of its text; component names its component, and is null for the empty set.
    """
    spark = docs.sparkSession
    percent, (bands, width) = round(100 * similarity), banding(similarity)
    rows = keyed(docs, text=text, doc_id=doc_id)
    signed = stored(arrow_map(rows, lambda b: _signatures(b, shingle, bands, width), "_id long, _th long, n long, node long, keys array<long>"))
    banded = signed.where("keys is not null").select("node", "keys")
    crowded = banded.select("node", F.explode("keys").alias("key")).groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    crowded = stored(crowded.select("key"))
    bitmap = spark.sparkContext.broadcast(key_filter(crowded, "key"))
    # what passes the bitmap by chance is left out by the join, so the classes that follow are those that share a bucket
    passed = arrow_map(banded, lambda b: _members(b, bitmap), "key long, node long").distinct()
    members = stored(passed.join(crowded, "key", "left_semi"))
    placed = stored(signed.select("_id", "_th", "n", "node"))
    drop(signed, crowded)
    wanted = spark.sparkContext.broadcast(key_filter(members.select("node"), "node"))
    found = arrow_map(rows.select("_text"), lambda b: _pool(b, shingle, wanted), "node long, elements binary, bits binary")
    pool = stored(found.groupBy("node").agg(F.first("elements").alias("elements"), F.first("bits").alias("bits")))
    own = members.groupBy("node").agg(F.collect_list("key").alias("own"))
    known = stored(pool.select("node", (F.octet_length("elements") / 8).cast("long").alias("n"), "bits").join(own, "node"))
    bits = known.select("node", "bits")
    least = members.groupBy("key").agg(F.min("node").alias("centre"))
    stars = members.join(least, "key").groupBy("node").agg(F.min("centre").alias("centre")).where("centre < node")
    stars = stars.join(bits, "node").join(bits.withColumnsRenamed({"node": "centre", "bits": "others"}), "centre")
    fresh = _few(arrow_map(stars, lambda b: _agreeing(b, percent), "centre long, node long"))
    tested, labels, most = [fresh], _few(known.select("node", F.col("node").alias("label"))), 1
    while True:
        labels = _merge(labels, links(pool, fresh.where("centre is not null"), percent))
        while True:  # until there is something to compare, or nothing left to name
            listed, before = _candidates(members, labels, known, percent, most), tested[0]
            for x in tested[1:]:
                before = before.union(x)
            fresh = _few(listed.join(before, ["centre", "node"], "left_anti"))
            state = fresh.agg(F.count("centre").alias("pairs"), F.count_if(F.col("centre").isNull()).alias("more")).first()
            most *= MORE
            if state["pairs"] or not state["more"]:
                break
        if not state["pairs"]:
            break
        tested.append(fresh)
    drop(members, pool, known, fresh, *tested)
    label = F.when(F.col("n") > 0, F.coalesce("label", "node"))
    placed = placed.join(labels, "node", "left").select("_id", "_th", F.col("n").alias("n_shingles"), label.alias("label"))
    first = placed.where("label is not null").groupBy("label").agg(F.min("_id").alias("first"))
    out = placed.join(first, "label", "left").select("_id", "_th", "n_shingles", F.coalesce("first", "_id").alias("component_id"), F.col("label").alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("_id") == F.col("component_id"), F.col("component_id").isNull()))
