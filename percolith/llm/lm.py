"""Language-model scores from a log-bilinear neural model trained with noise-contrastive estimation.

The model predicts a token in two steps, P(class | two classes before) P(token | class).  The most
frequent tokens are classes of their own, as is the end of a document; all others share classes by their
last two bytes.  The first factor is the log-bilinear network: the context's class vectors, scaled by
place, are multiplied with every class's output vector.  It is trained in numpy by noise-contrastive
estimation on ``STEPS`` times ``BATCH`` draws, with replacement, from the histogram of the class triples of
all training documents: a fixed number, whatever the corpus.  Then one batched matrix product over all
contexts and a log-softmax give normalised log-probabilities, which scoring looks up.  The second factor
is (c + 1) / (N_k + V_k + 1) over the counts of all training documents, one place left for unseen tokens.

Counts of words grow with the corpus and stay distributed.  The most frequent ``TOP`` at most, a bounded
table, are broadcast; the rest of a document's words meet their counts in a shuffled join.  Words are
told apart by 64-bit hashes.

Edge cases: null counts as empty; an empty text is one token, the end.  Without training documents
every count is 0 and the classes are equally likely.  A null doc_id counts as the empty text in the
checksum.  Repeated rows are scored each, and each counts in training.  An empty table gives an empty table; a
text of any length is scored whole; words as frequent as each other go by their hash.  Other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map, stored
from ._text import Words, blocks, mix

#: Classes of single words, and of shared words; with the end these are all classes.
SINGLE, SHARED = 63, 32
#: Words whose counts are broadcast, at most.
TOP = 1 << 19
DIM, STEPS, BATCH, NOISE = 24, 1200, 4096, 20
END = np.int64(-(1 << 63))


def shared_class(buf: np.ndarray, words: Words) -> np.ndarray:
    """0 .. SHARED-1 from a word's last two bytes (as they count: A-Z lowered)."""
    def letter(at: np.ndarray) -> np.ndarray:
        x = buf[at].astype(np.uint64)
        return x + np.uint64(32) * ((x >= 65) & (x <= 90))

    last = letter(words.ends - 1)
    before = np.where(words.ends - words.starts > 1, letter(np.maximum(words.ends - 2, 0)), np.uint64(0))
    return (mix(last * np.uint64(256) + before) % np.uint64(SHARED)).astype(np.int64)


def _count(batch: pa.RecordBatch) -> Iterator[dict]:
    h, k = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for block in blocks(batch.column("_text")):
        words = Words(block, "folded")
        u, at = np.unique(words.hash.view(np.int64), return_index=True)
        n = np.bincount(np.searchsorted(u, words.hash.view(np.int64)), minlength=len(u))
        h.append(u)
        k.append(shared_class(block.buf, words)[at] + (n << 8))
    h, k = np.concatenate(h), np.concatenate(k)
    order = np.argsort(h, kind="stable")
    h, k = h[order], k[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    yield {"h": np.r_[h[at], END], "k": np.r_[k[at] & 255, -1], "n": np.r_[np.add.reduceat(k >> 8, at) if len(at) else at, batch.num_rows]}


class Vocabulary:
    """Bounded: the counts of the most frequent words, and which of them are classes of their own."""

    def __init__(self, h: np.ndarray, n: np.ndarray, k: np.ndarray, totals: np.ndarray, types: np.ndarray, ends: int):
        order = np.lexsort((h, -n))
        h, n, k = h[order], n[order], k[order]
        single = min(SINGLE, len(h))
        self.ends, self.classes = ends, 1 + SINGLE + SHARED
        totals, types = totals.astype(np.int64).copy(), types.astype(np.int64).copy()
        self.tokens, self.types = int(totals.sum()) + ends, int(types.sum()) + (ends > 0)
        np.subtract.at(totals, k[:single], n[:single])
        np.subtract.at(types, k[:single], 1)
        of = np.r_[np.arange(1, single + 1), 1 + SINGLE + k[single:]]
        by = np.argsort(h)
        self.h, self.n, self.of = h[by], n[by], of[by].astype(np.int16)
        self.class_tokens = np.r_[ends, np.zeros(SINGLE, np.int64), totals]
        self.class_tokens[1 : 1 + single] = n[:single]
        self.possible = np.r_[True, np.arange(SINGLE) < single, np.ones(SHARED, bool)]
        self.within = np.log10(np.r_[np.ones(1 + SINGLE), totals + types + 1.0])

    def look_up(self, words: Words, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and its count, -1 where it isn't among the broadcast ones."""
        h = words.hash.view(np.int64)
        if not len(self.h):
            return 1 + SINGLE + shared_class(buf, words), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = self.h[at] == h
        return np.where(hit, self.of[at], 1 + SINGLE + shared_class(buf, words)), np.where(hit, self.n[at], -1)


def _sequence(classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a block's documents, each with an end, and the position of every document's first token."""
    size = np.diff(first)
    begin = np.r_[0, np.cumsum(size + 1)]
    out = np.zeros(begin[-1], np.int64)
    out[np.arange(len(classes)) + np.repeat(np.arange(len(size)), size)] = classes
    return out, begin


def _cells(sequence: np.ndarray, begin: np.ndarray, classes: int) -> np.ndarray:
    """(two before, one before, class) of every token as one number; before a document stands the end."""
    one, two = np.r_[0, sequence[:-1]], np.r_[0, 0, sequence[:-2]][: len(sequence)]
    one[begin[:-1]] = 0
    two[begin[:-1]] = 0
    second = begin[:-1] + 1
    two[second[second < begin[1:]]] = 0
    return (two * classes + one) * classes + sequence


def _triples(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    vocabulary: Vocabulary = shared.value
    c = vocabulary.classes
    counts = np.zeros(c**3, np.int64)
    for batch in batches:
        for block in blocks(batch.column("_text")):
            words = Words(block, "folded")
            sequence, begin = _sequence(vocabulary.look_up(words, block.buf)[0], words.first)
            cells, n = np.unique(_cells(sequence, begin, c), return_counts=True)
            counts[cells] += n
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["cell", "n"])


class LogBilinear:
    """Scores (scale1 * R[one] + scale2 * R[two]) . Q[k] + b[k]."""

    def __init__(self, unigram: np.ndarray, possible: np.ndarray, dim: int = DIM, seed: int = 7):
        self.possible = possible
        self.rng = np.random.default_rng(seed)
        c = len(unigram)
        self.noise = (unigram + 1.0) / (unigram.sum() + c)
        self.p = {"r": self.rng.normal(0, 0.1, (c, dim)), "q": self.rng.normal(0, 0.1, (c, dim)), "s": np.ones((2, dim)), "b": np.log(self.noise)}

    def fit(self, cells: np.ndarray, counts: np.ndarray, steps: int = STEPS, batch: int = BATCH, noise: int = NOISE, rate: float = 0.02) -> LogBilinear:
        """Noise-contrastive estimation by Adam: tell each triple's class from ``noise`` drawn by frequency."""
        c, p = len(self.noise), self.p
        if not len(cells):
            return self
        cdf = np.cumsum(counts) / counts.sum()
        drawn = np.cumsum(self.noise)
        log_noise = np.log(noise * self.noise)
        m1, m2 = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            cell = cells[np.minimum(np.searchsorted(cdf, self.rng.random(batch)), len(cells) - 1)]
            two, one = cell // (c * c), cell // c % c
            ks = np.concatenate([(cell % c)[:, None], np.minimum(np.searchsorted(drawn, self.rng.random((batch // 8, noise))), c - 1).repeat(8, axis=0)[:batch]], axis=1)
            h = p["s"][0] * p["r"][one] + p["s"][1] * p["r"][two]
            whole = h @ p["q"].T + p["b"]
            delta = np.take_along_axis(whole, ks, 1) - log_noise[ks]
            g = -1 / (1 + np.exp(-np.clip(delta, -30, 30)))
            g[:, 0] += 1
            dense = np.bincount((np.arange(batch)[:, None] * c + ks).ravel(), g.ravel(), batch * c).reshape(batch, c)
            gh = dense @ p["q"]
            grad = {"b": dense.sum(0), "q": dense.T @ h, "s": np.stack([(gh * p["r"][one]).sum(0), (gh * p["r"][two]).sum(0)]), "r": np.zeros_like(p["r"])}
            np.add.at(grad["r"], one, gh * p["s"][0])
            np.add.at(grad["r"], two, gh * p["s"][1])
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, x in p.items():
                d = grad[k] / batch
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                x += now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def table(self) -> np.ndarray:
        """log10 P(class | two, one) for all contexts, in one batched product and a log-softmax."""
        c, p = len(self.noise), self.p
        h = (p["s"][1] * p["r"])[:, None, :] + (p["s"][0] * p["r"])[None, :, :]
        x = h.reshape(c * c, -1) @ p["q"].T + np.where(self.possible, p["b"], -np.inf)
        x -= x.max(axis=1, keepdims=True)
        x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
        return (x / math.log(10)).ravel()


def _score(batch: pa.RecordBatch, shared, offset: float) -> Iterator[dict]:
    vocabulary, table = shared.value
    n = batch.num_rows
    tokens, known, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    rare, times = [None] * n, [None] * n
    single = 1 + SINGLE
    for block in blocks(batch.column("_text")):
        words = Words(block, "folded")
        classes, counts = vocabulary.look_up(words, block.buf)
        sequence, begin = _sequence(classes, words.first)
        gain = np.log10(np.maximum(counts, 0) + 1.0)
        inside = np.r_[0, np.cumsum(np.where(classes >= single, gain - vocabulary.within[classes], 0.0))]
        total = np.r_[0, np.cumsum(gain)]
        seen = np.r_[0, np.cumsum(counts > 0)]
        path = np.r_[0, np.cumsum(table[_cells(sequence, begin, vocabulary.classes)])]
        a, b, s = words.first[:-1], words.first[1:], slice(block.first, block.first + len(block))
        tokens[s] = b - a + 1
        known[s] = seen[b] - seen[a] + (vocabulary.ends > 0)
        base[s] = total[b] - total[a] + np.log10(vocabulary.ends + 1.0) - tokens[s] * offset
        score[s] = path[begin[1:]] - path[begin[:-1]] + inside[b] - inside[a]
        h = words.hash.view(np.int64)
        for i in range(len(block)):
            mine = slice(int(a[i]), int(b[i]))
            rare[block.first + i], times[block.first + i] = np.unique(h[mine][counts[mine] < 0], return_counts=True)
    yield {"doc_id": batch.column("_id"), "held_out": batch.column("held_out"), "row": batch.column("row"), "n_tokens": tokens, "n_known": known, "base": base, "score": score, "rare": rare, "times": times}


def _threshold(words: DataFrame, top: int) -> tuple[int, int]:
    """(n, h) so that some ``top`` words, and hardly more, have a greater count, or that count and a smaller hash.

    Counts of words per count reach the driver; counts from 2**20 on go together, so they are a million at most.
    """
    most = 1 << 20
    found = words.groupBy(F.least("n", F.lit(most)).alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("n")).toArrow().to_pydict()
    above = 0
    for n, c in zip(found["n"], found["c"], strict=True):
        if above + c > top and n < most:
            return n, int((top - above) / c * 2**64) - 2**63
        above += c
    return 0, 0


def score(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", folds: int = 7, held_out: int = 2, top: int = TOP, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), (fold == held_out).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    train = rows.where("not held_out").select("_text")
    counts = stored(arrow_map(train, _count, "h long, k int, n long").groupBy("h").agg(F.max("k").alias("k"), F.sum("n").alias("n")))
    words = counts.where("k >= 0")
    least, cut = _threshold(words, top)
    frequent = (F.col("n") > least) | ((F.col("n") == least) & (F.col("h") < cut))
    often = words.where(frequent).select("h", "k", "n").toArrow()
    by_class = words.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow().to_pydict()
    totals, types = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
    totals[by_class["k"]], types[by_class["k"]] = by_class["n"], by_class["v"]
    ends = counts.where("k < 0").agg(F.sum("n")).first()[0] or 0
    vocabulary = Vocabulary(often["h"].to_numpy(), often["n"].to_numpy(), often["k"].to_numpy().astype(np.int64), totals, types, int(ends))

    shared = spark.sparkContext.broadcast(vocabulary)
    triples = train.mapInArrow(lambda b: _triples(b, shared), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()
    model = LogBilinear(vocabulary.class_tokens.astype(float), vocabulary.possible).fit(triples["cell"].to_numpy().astype(np.int64), triples["n"].to_numpy().astype(float), steps)
    both = spark.sparkContext.broadcast((vocabulary, model.table()))
    offset = math.log10(vocabulary.tokens + vocabulary.types + 1)

    kind = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, score double, rare array<long>, times array<long>"
    scored = stored(arrow_map(rows.withColumn("row", F.monotonically_increasing_id()), lambda b: _score(b, both, offset), kind))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("m"))
    found = rare.join(words.where(~frequent).select("h", F.log10(F.col("n") + F.lit(1.0)).alias("g")), "h")
    more = found.groupBy("row").agg(F.sum(F.col("m") * F.col("g")).alias("g"), F.sum("m").alias("m"))
    out = scored.drop("rare", "times").join(more, "row", "left")
    gain = F.coalesce("g", F.lit(0.0))
    return out.select(
        F.col("doc_id").alias(doc_id), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("m", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base") + gain).alias("base_score"), (F.col("score") + gain).alias("score"),
    )
