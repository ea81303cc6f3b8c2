"""Approximate nearest neighbours by inner product: a navigable small-world hierarchy for each shard.

Vectors that are equal are one point with the smallest ids that share it (one more than are asked for,
as a query leaves itself out), so a vector that many rows share is a point like any other.  Points are
dealt to shards of about ``SHARD`` by a hash.  Each shard's graph is built by insertion in batches: a new
batch is searched for in the graph so far, among its own members too, and linked to near points in
different directions: of the nearest first, one that is nearer to a link than to the point itself is passed
over, and those passed over only fill places that are left.  Links are pruned by the same rule, so a tight
group keeps links that lead out of it.  A layer is searched from the best ``STARTS`` points of the layer
above.  Layers are flat arrays of neighbour numbers, -1 where there is none.  One more coordinate makes
nearness by inner product nearness in space.

Queries are taken in blocks; a shard's index stays in its task and the blocks, half a megabyte each, are
streamed past it, and the shards' best are merged.  Every row is indexed.  Found scores are inner products of the original vectors in double precision.

Edge cases: vectors that are null, zero, or hold null or non-finite components, and rows without id,
take no part; vectors of different lengths are apart; ties go to the smaller id.  Rows of
one id are one row's own.  Empty tables give an empty table; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import arrow_map, bound_batches, partitions, stored

#: Points in a shard, links of a point (twice that on the lowest layer), beam in building and in search.
SHARD, LINKS, BUILD_BEAM, BEAM = 8192, 16, 64, 128
#: Query vectors in a block, and blocks that a copy of an index takes.
QUERIES, BLOCKS = 1024, 64
#: Points that a search of a layer starts from.
STARTS = 32
_STEP = 4


def _spread(between: np.ndarray, far: np.ndarray, width: int) -> np.ndarray:
    """Up to ``width`` places of candidates (m, c), nearest first: those in new directions, then the nearest of the rest.

    ``between`` (m, c, c) are the distances among candidates and ``far`` (m, c) to the point, inf where there is none.
    """
    m, c = far.shape
    taken, shut = np.zeros((m, c), bool), ~np.isfinite(far)
    full = np.zeros(m, int)
    for i in range(c):
        pick = ~shut[:, i] & (full < width)
        taken[:, i] = pick
        full += pick
        # a candidate further on that is nearer to this link than to the point
        shut |= pick[:, None] & (between[:, i] < far)
    rank = np.where(taken, 0, np.where(np.isfinite(far), 1, 2))
    return np.argsort(rank, axis=1, kind="stable")[:, :width]


class Graph:
    """A hierarchy over points ``x`` (n, d); ``layers[l]`` are (numbers of points, neighbours (m, links))."""

    def __init__(self, x: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM):
        self.n, self.links, self.beam = len(x), links, beam
        norm = (x * x).sum(axis=1)
        self.x = np.concatenate([x, np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))[:, None]], axis=1).astype(np.float32)
        rng = np.random.default_rng(12345)
        top = np.minimum((-np.log(1 - rng.random(self.n)) / np.log(links)).astype(int), 6)
        order = np.argsort(-top, kind="stable")
        self.layers: list[np.ndarray] = [np.full((self.n, links * (2 if level == 0 else 1)), -1, np.int32) for level in range(int(top.max(initial=0)) + 1)]
        self.entry = int(order[0]) if self.n else -1
        done = 0
        while done < self.n:
            size = min(max(32, done // 4), 512)
            batch = order[done : done + size]
            for level in range(int(top[batch].max()), -1, -1):
                mine = batch[top[batch] >= level]
                self._insert(level, mine, order[:done][top[order[:done]] >= level])
            done += size

    def _distances(self, q: np.ndarray, points: np.ndarray) -> np.ndarray:
        y = self.x[points]
        return ((y - q[:, None, :]) ** 2).sum(axis=2)

    def _insert(self, level: int, new: np.ndarray, old: np.ndarray) -> None:
        table = self.layers[level]
        width = table.shape[1]
        own = ((self.x[new][:, None, :] - self.x[new][None, :, :]) ** 2).sum(axis=2)
        np.fill_diagonal(own, np.inf)
        if len(old):
            found, far = self._beam(level, self.x[new], self._descend(self.x[new], level), self.beam)
        else:
            found, far = np.full((len(new), 0), -1), np.zeros((len(new), 0), np.float32)
        ids = np.concatenate([found, np.broadcast_to(new, own.shape)], axis=1)
        dist = np.concatenate([np.where(found >= 0, far, np.inf), own], axis=1)
        take = min(width // 2 if level == 0 else width, dist.shape[1])
        best = np.argsort(dist, axis=1)[:, : max(self.beam, take)]
        near = np.take_along_axis(dist, best, 1)
        pick, near = self._chosen(np.where(np.isfinite(near), np.take_along_axis(ids, best, 1), -1), near, take)
        table[new, :take] = pick
        # links back, each point keeping near ones in different directions
        a = np.repeat(new, take)
        b = pick.ravel()
        a, b = a[b >= 0], b[b >= 0]
        targets = np.unique(b)
        if not len(targets):
            return
        slot = np.searchsorted(targets, b)
        by = np.argsort(slot, kind="stable")
        count = np.bincount(slot, minlength=len(targets))
        more = np.full((len(targets), int(count.max())), -1, np.int64)
        more[slot[by], np.arange(len(by)) - np.repeat(np.cumsum(count) - count, count)] = a[by]
        both = np.sort(np.concatenate([table[targets], more], axis=1), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        size = (both >= 0).sum(axis=1)
        both = -np.sort(-both, axis=1)
        order = np.argsort(size, kind="stable")
        for i in range(0, len(order), 256):  # of like sizes
            rows = order[i : i + 256]
            some = both[rows, : max(int(size[rows].max()), 1)]
            far = np.where(some >= 0, self._distances(self.x[targets[rows]], np.maximum(some, 0)), np.inf)
            by = np.argsort(far, axis=1)
            some, far = np.take_along_axis(some, by, 1), np.take_along_axis(far, by, 1)
            if some.shape[1] > width:
                some, far = self._chosen(some, far, width)
            table[targets[rows]] = -1
            table[targets[rows], : some.shape[1]] = np.where(np.isfinite(far), some, -1)

    def _chosen(self, ids: np.ndarray, far: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """``width`` of each row's candidates, which come nearest first, by ``_spread``."""
        out = np.empty((len(ids), min(width, ids.shape[1])), np.int64)
        step = max(1, (1 << 24) // (ids.shape[1] * max(ids.shape[1], self.x.shape[1])))
        for i in range(0, len(ids), step):
            y = self.x[np.maximum(ids[i : i + step], 0)]
            norm = (y * y).sum(axis=2)
            between = norm[:, :, None] + norm[:, None, :] - 2 * (y @ y.transpose(0, 2, 1))
            out[i : i + step] = _spread(between, far[i : i + step], width)
        return np.where(np.isfinite(np.take_along_axis(far, out, 1)), np.take_along_axis(ids, out, 1), -1), np.take_along_axis(far, out, 1)

    def _descend(self, q: np.ndarray, level: int) -> np.ndarray:
        """Points to start from on ``level`` (m, starts): the best found on the layer above, from its best, and so on."""
        at = np.full((len(q), 1), self.entry)
        for upper in range(len(self.layers) - 1, level, -1):
            at = self._beam(upper, q, at, STARTS)[0]
            at = at[:, : max(int((at >= 0).sum(axis=1).max(initial=0)), 1)]
        return at

    def _beam(self, level: int, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of one layer for all queries at once: ids (-1: none) and distances, nearest first."""
        m, table = len(q), self.layers[level]
        ids, dist = np.full((m, beam), -1), np.full((m, beam), np.inf, np.float32)
        opened = np.ones((m, beam), bool)
        start = start[:, :beam]
        s, known = start.shape[1], start >= 0
        ids[:, :s], opened[:, :s] = start, ~known
        dist[:, :s] = np.where(known, self._distances(q, np.maximum(start, 0)), np.inf)
        seen = np.zeros((m, self.n), bool)
        seen[np.nonzero(known)[0], start[known]] = True
        live = np.arange(m)
        while len(live):
            score = np.where(opened[live], np.inf, dist[live])
            step = np.argpartition(score, min(_STEP, beam) - 1, axis=1)[:, : min(_STEP, beam)]
            ok = np.isfinite(np.take_along_axis(score, step, 1))
            going = ok.any(axis=1)
            live, step, ok = live[going], step[going], ok[going]
            if not len(live):
                break
            r = live[:, None]
            opened[r, step] = True
            near = table[np.where(ok, ids[r, step], 0)]
            near = np.where(ok[:, :, None], near, -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[r, np.maximum(near, 0)]
            width = int(fresh.sum(axis=1).max(initial=0))
            if not width:
                continue
            first = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            near, fresh = np.take_along_axis(near, first, 1), np.take_along_axis(fresh, first, 1)
            points = np.where(fresh, near, 0)
            far = np.where(fresh, self._distances(q[live], points), np.inf).astype(np.float32)
            at, col = np.nonzero(fresh)
            seen[live[at], near[at, col]] = True
            all_ids, all_dist = np.concatenate([ids[live], near], 1), np.concatenate([dist[live], far], 1)
            all_open = np.concatenate([opened[live], ~fresh], 1)
            keep = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
            ids[live], dist[live], opened[live] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_dist, all_open))
        order = np.argsort(dist, axis=1)
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        return np.where(np.isfinite(dist), ids, -1), dist

    def search(self, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Numbers of the points nearest to each query by inner product, nearest first, -1 where there are no more."""
        q = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        out = [self._beam(0, q[i : i + 256], self._descend(q[i : i + 256], 0), max(1, min(beam, self.n)))[0] for i in range(0, len(q), 256)]
        return np.concatenate(out) if out else np.zeros((0, beam), np.int64)


def _points(batch: pa.RecordBatch, most: int, every: int) -> Iterator[dict]:
    """Different vectors of a batch with their smallest ids."""
    seen: dict[bytes, list[int]] = {}
    column = batch.column("v")
    flat, off = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    for i, row in zip(range(batch.num_rows), batch.column("id").to_pylist(), strict=True):
        seen.setdefault(np.ascontiguousarray(flat[off[i] : off[i + 1]] + 0.0).tobytes(), []).append(row)
    yield {
        "vec": list(seen),
        "ids": [sorted(x)[:most] for x in seen.values()],
        "asks": [any(i % every == 0 for i in x) for x in seen.values()],
    }


def _build(table: pa.Table, links: int, beam: int) -> pa.Table:
    shard, dim = table.column("shard")[0].as_py(), table.column("dim")[0].as_py()
    x = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float64).reshape(-1, dim)
    ids = table.column("ids").to_pylist()
    graph = Graph(x, links, beam)
    lists = np.concatenate([np.array(i, np.int64) for i in ids])
    cuts = np.cumsum([0, *map(len, ids)])
    flat = np.concatenate([layer.ravel() for layer in graph.layers]).astype(np.int32)
    blobs = [x.tobytes(), flat.tobytes(), lists.tobytes(), cuts.tobytes()]
    return pa.table({"shard": pa.array([shard], pa.int64()), "dim": pa.array([dim], pa.int32()), **{k: pa.array([b], pa.binary()) for k, b in zip(("x", "flat", "lists", "cuts"), blobs, strict=True)}, "entry": pa.array([graph.entry], pa.int64())})


def _restored(x: np.ndarray, flat: np.ndarray, entry: int, links: int) -> Graph:
    graph = Graph.__new__(Graph)
    graph.n, graph.links, graph.entry = len(x), links, entry
    norm = (x * x).sum(axis=1)
    graph.x = np.concatenate([x, np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))[:, None]], axis=1).astype(np.float32)
    low = graph.n * links * 2
    graph.layers = [flat[:low].reshape(graph.n, -1), *(flat[low + i : low + i + graph.n * links].reshape(graph.n, links) for i in range(0, len(flat) - low, graph.n * links))]
    return graph


def _search(batches: Iterator[pa.RecordBatch], k: int, links: int, beam: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (dim, shard, copy, part): a shard's index first, then the blocks of queries that are streamed
    past it; for each block the best ids by exact score, ``k`` + 1 a query vector."""
    graph = None
    for batch in batches:
        for row in batch.to_pylist():
            dim = row["dim"]
            if row["part"] < 0:
                x = np.frombuffer(row["x"], np.float64).reshape(-1, dim)
                lists, cuts = np.frombuffer(row["lists"], np.int64), np.frombuffer(row["cuts"], np.int64)
                graph = _restored(x, np.frombuffer(row["flat"], np.int32), row["entry"], links)
                continue
            q, keys = np.frombuffer(row["q"], np.float64).reshape(-1, dim), np.frombuffer(row["keys"], np.int64)
            out_q, out_id, out_score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for i, found in enumerate(graph.search(q, beam)):
                found = found[found >= 0]
                score = (x[found] * q[i]).sum(axis=1)
                count = cuts[found + 1] - cuts[found]
                ids = np.concatenate([np.zeros(0, np.int64), *(lists[cuts[p] : cuts[p + 1]] for p in found)])
                score = np.repeat(score, count)
                best = np.lexsort((ids, -score))[: k + 1]
                out_q.append(np.full(len(best), keys[i]))
                out_id.append(ids[best])
                out_score.append(score[best])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (out_q, out_id, out_score)], names=["point", "vec_id", "score"])


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD, links: int = LINKS, build_beam: int = BUILD_BEAM, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``every``."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & sound).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))
    found = arrow_map(rows, lambda b: _points(b, k + 1, every), "vec binary, ids array<long>, asks boolean").groupBy("vec")
    points = found.agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.bool_or("asks").alias("asks"))
    points = stored(points.select("vec", "ids", "asks", (F.octet_length("vec") / 8).cast("int").alias("dim"), F.xxhash64("vec").alias("h"), F.element_at("ids", 1).alias("point")))
    total, asked = points.agg(F.count("*"), F.count_if("asks")).first()
    shards, parts = int(total // shard) + 1, int(asked // QUERIES) + 1
    dealt = points.select("dim", F.pmod("h", F.lit(shards)).alias("shard"), "vec", "ids")
    index = stored(dealt.groupBy("dim", "shard").applyInArrow(lambda t: _build(t, links, build_beam), "shard long, dim int, x binary, flat binary, lists binary, cuts binary, entry long"))
    block = F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(parts))
    lists = points.where("asks").groupBy("dim", block.alias("part")).agg(F.collect_list(F.struct("point", "vec")).alias("found"))
    asks = arrow_map(lists, _packed, "dim int, part long, q binary, keys binary")
    # an index stays in its task while blocks are streamed past it; a few copies of it share many blocks
    copies = parts // BLOCKS + 1
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    shard_of = index.select("dim", "shard").join(asks, "dim").withColumn("copy", F.pmod("part", F.lit(copies)).cast("int"))
    rows_ = index.withColumn("copy", copy).withColumn("part", F.lit(-1).cast("long")).unionByName(shard_of, allowMissingColumns=True)
    placed = rows_.repartition(partitions(vectors.sparkSession, shards * copies), "dim", "shard", "copy").sortWithinPartitions("dim", "shard", "copy", "part")
    bound_batches(vectors.sparkSession)
    hits = placed.mapInArrow(lambda t: _search(t, k, links, beam), "point long, vec_id long, score double")
    order = Window.partitionBy("point").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("point").agg(F.collect_list(F.struct("r", "vec_id", "score")).alias("best"))
    encoded = arrow_map(rows.where(F.col("id") % every == 0), _as_bytes, "id long, vec binary")
    queries = encoded.join(points.where("asks").select("vec", "point"), "vec").select("id", "point").join(best, "point")
    others = F.filter(F.array_sort("best"), lambda x: x["vec_id"] != F.col("id"))
    each = queries.select("id", F.posexplode(F.slice(others, 1, k)).alias("rank", "b"))
    return each.select(F.col("id").alias("query_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def _packed(batch: pa.RecordBatch) -> Iterator[dict]:
    found = [sorted(x, key=lambda y: y["point"]) for x in batch.column("found").to_pylist()]
    yield {"dim": batch.column("dim"), "part": batch.column("part"), "q": [b"".join(y["vec"] for y in x) for x in found], "keys": [np.array([y["point"] for y in x], np.int64).tobytes() for x in found]}


def _as_bytes(batch: pa.RecordBatch) -> Iterator[dict]:
    column = batch.column("v")
    flat, off = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    yield {"id": batch.column("id"), "vec": [np.ascontiguousarray(flat[off[i] : off[i + 1]] + 0.0).tobytes() for i in range(batch.num_rows)]}
