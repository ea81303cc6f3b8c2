"""Language identification by rank-order profiles.

A profile is a language's ``size`` most frequent letter n-grams (n from 1 to 3, words padded with one
space), most frequent first.  A document is ranked the same way over its whole text; its distance to a
profile is the sum over its n-grams of how far each is out of place, ``size`` for one the profile lacks.

Edge cases: a text that is null or has no letter is ``und`` with score 0, as is every text when nothing
could be learned.  Ties in frequency go to the smaller n-gram, ties in distance to the first language.
Rows without language teach nothing.  Repeated rows each count.  An empty table gives an empty table; a text
of any length is ranked whole.  A kept column with the name of a column of the result has ``_in`` after it;
other columns take no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map, bound_batches, free_name
from ._text import text_buffers

#: N-grams of a profile.
PROFILE = 400
_SALTS = 16


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> np.ndarray:
    """Packed letter n-grams (21 bits a character) of a lower-cased text, in no order of use."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    x = np.concatenate(([32], x, [32])).astype(np.uint32)
    letter = _letters()[np.minimum(x, 0x10FFFF)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:] & ~letter[:-1]
    y = np.where(letter, x, np.uint32(32))[keep]
    if not len(y):
        return np.zeros(0, np.uint64)
    # one space between words: two in a row are left where a run of other characters was longer
    space = y == 32
    once = np.ones(len(y), bool)
    once[1:] = ~(space[1:] & space[:-1])
    y = y[once].astype(np.uint64)
    space = y == 32
    two = (y[:-1] << np.uint64(21)) | y[1:]
    three = ((y[:-2] << np.uint64(42)) | (y[1:-1] << np.uint64(21)) | y[2:])[~space[1:-1]]
    return np.concatenate((y[~space], two, three))


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(codes)
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return s[at], np.diff(np.r_[at, len(s)])


def _texts(column: pa.Array) -> Iterator[str | None]:
    buf, off = text_buffers(column)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(off) - 1):
        yield buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace") if valid[i] else None


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[at], np.add.reduceat(n, at) if len(at) else n


def _count_batch(batch: pa.RecordBatch) -> Iterator[dict]:
    parts: dict[str, list] = {}
    held: dict[str, int] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), _texts(batch.column("text")), strict=True):
        if text:
            mine = parts.setdefault(lang, [])
            mine.append(counted(ngrams(text)))
            held[lang] = held.get(lang, 0) + len(mine[-1][0])
            if held[lang] > 1 << 19:  # what is held stays small, however many documents a batch has
                mine[:] = [_summed(mine)]
                held[lang] = 0
    for lang, found in parts.items():
        codes, n = _summed(found)
        if len(codes):
            yield {"lang": pa.array([lang] * len(codes)), "code": codes.view(np.int64), "n": n}


def fit(train: DataFrame, *, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles from all rows of ``train``; what reaches the driver is bounded by languages times ``size``.

    Counts are summed by (language, n-gram); the best ``size`` are first found in each of 16 shares of a
    language's n-grams, so no task sees all n-grams of one.
    """
    rows = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    counts = arrow_map(rows, _count_batch, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            codes, n = batch.column("code").to_numpy(), batch.column("n").to_numpy()
            names = batch.column("lang").dictionary_encode()
            which = names.indices.to_numpy()
            for k, name in enumerate(names.dictionary.to_pylist()):
                old = kept.get(name, (np.zeros(0, np.int64),) * 2)
                c, m = np.r_[old[0], codes[which == k]], np.r_[old[1], n[which == k]]
                top = np.lexsort((c, -m))[:size]
                kept[name] = c[top], m[top]
        for name, (c, m) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(c), pa.string()), pa.array(c), pa.array(m)], names=["lang", "code", "n"])

    shares = counts.repartition(_SALTS, F.pmod(F.xxhash64("code"), F.lit(_SALTS)))
    found = shares.mapInArrow(best, "lang string, code long, n long").toPandas()
    return {
        str(name): part.sort_values(["n", "code"], ascending=[False, True])["code"].to_numpy()[:size].astype(np.uint64)
        for name, part in sorted(found.groupby("lang"), key=lambda x: str(x[0]))
    }


class Profiles:
    """Profiles in the form that prediction uses: all their n-grams sorted, and the rank of each in every language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = list(profiles), size
        self.codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *profiles.values()]))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int32)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, profiles[name]), k] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, n = counted(ngrams(text)) if text else (np.zeros(0, np.uint64), None)
        if not len(codes) or not self.names:
            return "und", 0.0
        top = codes[np.argsort(-n, kind="stable")[: self.size]]
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        ranks = self.ranks[np.where(self.codes[at] == top, at, len(self.codes))]
        off = np.where(ranks >= 0, np.abs(ranks - np.arange(len(top), dtype=np.int32)[:, None]), self.size).sum(axis=0)
        k = int(np.argmin(off))
        return self.names[k], 1.0 - float(off[k]) / (self.size * len(top))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], *, text: str = "text", keep: list[str] | None = None, size: int = PROFILE) -> DataFrame:
    """``keep`` columns of every row with lang_pred and score; no shuffle.  The profiles are a bounded broadcast."""
    keep = list(docs.columns if keep is None else keep)
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, size))
    inner = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(keep)], docs[f"`{text}`"].cast("string").alias("_text"))
    at = len(keep)
    if text in keep and inner.schema[keep.index(text)].dataType == inner.schema["_text"].dataType:
        inner, at = inner.drop("_text"), keep.index(text)  # a text that is kept travels once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            said = [model.predict(x) for x in _texts(batch.column(at))]
            columns = batch.columns[: len(keep)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], names=[*batch.schema.names[: len(keep)], "lang_pred", "score"])
        pa.default_memory_pool().release_unused()

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    bound_batches(docs.sparkSession)
    out = inner.mapInArrow(run, StructType([*inner.schema.fields[: len(keep)], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    return out.select(*[F.col(f"c{i}").alias(free_name(c, ("lang_pred", "score"))) for i, c in enumerate(keep)], "lang_pred", "score")


def identify(docs: DataFrame, *, size: int = PROFILE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", folds: int = 4, held_out: int = 2) -> DataFrame:
    """Learn from the rows whose crc32(doc_id as text) mod ``folds`` isn't ``held_out``, predict all rows.

    A null doc_id counts as the empty text in that checksum.
    """
    fold = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)
    profiles = fit(docs.where(fold != held_out), text=text, lang=lang, size=size)
    out = predict(docs, profiles, text=text, keep=[doc_id], size=size)
    return out.select(F.col(doc_id), (fold == held_out).alias("held_out"), "lang_pred", "score")
