"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over 16 bytes cuts every text where its low bits are zero, so equal passages are cut
alike in whatever documents they stand.  Chunks are counted over all documents by a 128-bit digest; the
``DICTIONARY`` chunks whose reuse saves most bytes are encoded once and broadcast (their number and
length are bounded, so their size is).  A document then takes a known chunk's ids from the dictionary,
and its remaining text from a bounded memo of words, which are independent under a vocabulary that
drops white space.  Both are gathered from flat arrays, a block of documents at a time.

Joins are repaired by re-encoding.  Of a known chunk only the inner part, from its first to its last
white space, is reused; what lies between inner parts is encoded anew.  Then each join is checked: the
text around it, one word on either side, goes through the tokenizer in one piece and must give the ids
that were joined.  Where it doesn't, the window doubles, until both agree or the whole document has been
re-encoded.

Edge cases: null counts as empty; an empty text has no ids and decodes to the empty string.  Repeated
rows get equal results.  The ids are those of the tokenizers library over the whole text, of any length; ties
among chunks go to the smaller digest.  An empty table gives an empty table.  A kept column with the name of
a column of the result has ``_in`` after it; other columns take no part.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map, fields, free_name, whole_row
from ._text import Block, Words, as_letters, blocks, byte_grams, mix, ranges, spans_hash

#: Mean chunk length in bytes (a power of two), longest chunk that is shared, chunks in the dictionary.
MEAN_CHUNK, MAX_CHUNK, DICTIONARY = 1024, 8192, 4096
#: Words in a worker's memo, at most; they take some 40 MB.
MEMO = 1 << 19
#: Most words either side of a join that are encoded again; where they don't agree, the whole document is.
WINDOW = 64
_GRAM = 16
COLUMNS = ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
_WHITE = frozenset(b" \t\n\r\x0b\x0c")


@functools.cache
def tokenizer(path: str):
    """The library's tokenizer, single-threaded as Spark runs one task a core, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.cache
def splits_on_white_space(path: str) -> bool:
    """Whether the tokenizer drops white space: only then may words be encoded one by one."""
    t = tokenizer(path)
    one = [t.encode(x, add_special_tokens=False).ids for x in ("ab", "c", "ab c", "ab\n c ", " ab\tc")]
    return all(x == one[0] + one[1] for x in one[2:])


class Buffer:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(1024, kind), 0

    def append(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(max(len(self.held), 2 * len(x)), self.held.dtype)])
        self.held[self.n : self.n + len(x)] = x
        self.n += len(x)

    def array(self) -> np.ndarray:
        return self.held[: self.n]


class Memo:
    """Ids of words and of known chunk parts in flat arrays, without a Python object for any.

    A word is found by a 64-bit hash of its bytes together with its length and first eight bytes.  At ``MEMO`` words
    the half that was used least is forgotten, so frequent words stay.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.plain = self.tokenizer.decoder is None
        texts = [(self.tokenizer.id_to_token(i) or "").encode() + b" " for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))] if self.plain else []
        self.token_text, self.token_size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts], np.int64)
        self.token_at = np.r_[0, np.cumsum(self.token_size)]
        self.reset()

    def reset(self) -> None:
        #: Words in order of their keys, and the entry of each; entries' places in the flat ids, sizes and uses.
        self.key, self.check, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.size, self.uses, self.flat = Buffer(np.int64), Buffer(np.int64), Buffer(np.int64), Buffer("<u4")
        self.parts: dict[tuple[str, int], int] = {}

    def add(self, ids: list[list[int]] | list[np.ndarray]) -> np.ndarray:
        """New entries; their numbers."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        first = self.at.n
        self.at.append(self.flat.n + np.cumsum(sizes) - sizes)
        self.size.append(sizes)
        self.uses.append(np.zeros(len(ids), np.int64))
        self.flat.append(np.fromiter(itertools.chain.from_iterable(ids), "<u4", int(sizes.sum())))
        return np.arange(first, first + len(ids))

    def encoded(self, words: list[bytes]) -> list[list[int]]:
        out = []
        for i in range(0, len(words), 4096):
            out += [e.ids for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in words[i : i + 4096]], add_special_tokens=False)]
        return out

    def forget(self) -> None:
        """Keep the words that were used most, half of ``MEMO``; their uses count half from now on."""
        uses = self.uses.array()[self.entry]
        stay = np.sort(np.argsort(-uses, kind="stable")[: MEMO // 2])
        key, check, entry = self.key[stay], self.check[stay], self.entry[stay]
        at, size, flat = self.at.array()[entry], self.size.array()[entry], self.flat.array()
        kept = flat[ranges(at, size)]
        self.reset()
        self.key, self.check, self.entry = key, check, np.arange(len(key))
        self.at.append(np.cumsum(size) - size)
        self.size.append(size)
        self.uses.append(uses[stay] // 2)
        self.flat.append(kept)

    def numbers(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The entry of each word; words that aren't there are encoded, each once."""
        if not len(starts):
            return np.zeros(0, np.int64)
        padded = np.frombuffer(raw + b"\0" * 8, np.uint8)
        length = ends - starts
        head = np.zeros(len(starts), np.uint64)
        for k in range(8):
            head |= np.where(length > k, padded[starts + k], np.uint8(0)).astype(np.uint64) << np.uint64(8 * k)
        check = mix(head) ^ length.astype(np.uint64)
        keys, first, inverse, times = np.unique(hashes ^ mix(check, 21), return_index=True, return_inverse=True, return_counts=True)
        check = check[first]
        if len(self.key) + len(keys) > MEMO:
            self.forget()
        place = np.searchsorted(self.key, keys)
        near = np.minimum(place, max(len(self.key) - 1, 0))
        hit = (self.key[near] == keys) & (self.check[near] == check) if len(self.key) else np.zeros(len(keys), bool)
        found = np.zeros(len(keys), np.int64)
        found[hit] = self.entry[near[hit]]
        missing = np.flatnonzero(~hit)
        if len(missing):
            at = first[missing]
            found[missing] = self.add(self.encoded([raw[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
            self.key, self.check, self.entry = (np.insert(old, place[missing], new) for old, new in ((self.key, keys[missing]), (self.check, check[missing]), (self.entry, found[missing])))
        self.uses.array()[found] += times
        return found[inverse]

    def gathered(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some entries one after another, and where each begins."""
        n = self.size.array()[entries]
        return self.flat.array()[ranges(self.at.array()[entries], n)], np.r_[0, np.cumsum(n)]

    def decoded(self, ids: np.ndarray) -> bytes:
        """The text of some ids in UTF-8."""
        if not self.plain:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()
        return self.token_text[ranges(self.token_at[ids], self.token_size[ids])][:-1].tobytes()


@functools.cache
def _memo(path: str) -> Memo:
    return Memo(path)


def chunks(block: Block, mean: int = MEAN_CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and two digests of the chunks of a block's documents; together they cover every byte."""
    buf, off = block.buf, block.off
    h = byte_grams(buf, _GRAM)
    cut = np.flatnonzero((h & np.uint32(mean - 1)) == 0)
    if len(cut):
        near = np.r_[False, np.diff(cut) < 64]  # in a text of one repeated letter every place would be cut
        cut = cut[~near] + _GRAM
        cut = cut[cut < len(buf)]
        for _ in range(3):  # not inside a character
            cut = cut + ((buf[np.minimum(cut, len(buf) - 1)] & 0xC0) == 0x80)
    bounds = np.unique(np.r_[off, cut[cut < len(buf)]])
    starts, ends = bounds[:-1], bounds[1:]
    letters = as_letters(buf.tobytes())
    return starts, ends, spans_hash(letters, starts, ends), spans_hash(letters, starts, ends, 1)


def inner(text: bytes) -> tuple[int, int]:
    """From the first to after the last white space; empty where there are not two apart."""
    white = [i for i in (text.find(b" "), text.find(b"\n")) if i >= 0]
    return (min(white), max(text.rfind(b" "), text.rfind(b"\n")) + 1) if white else (0, 0)


def _count(batches: Iterator[pa.RecordBatch], mean: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        th = batch.column("_th").to_numpy()
        found = []
        for block in blocks(batch.column("_text")):
            s, e, h1, h2 = chunks(block, mean)
            keep = (e - s > 64) & (e - s <= MAX_CHUNK)
            found.append((h1[keep].view(np.int64), h2[keep].view(np.int64), (e - s)[keep], th[block.first + block.doc_of(s[keep])]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in found])) for i in range(4)], names=["h1", "h2", "n", "th"])


def shared_chunks(rows: DataFrame, mean: int = MEAN_CHUNK, most: int = DICTIONARY) -> DataFrame:
    """The chunks that save most: (h1, h2, th), th the hash of one text that holds it."""
    found = rows.mapInArrow(lambda b: _count(b, mean), "h1 long, h2 long, n long, th long")
    counts = found.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.min("th").alias("th"))
    return counts.where("c > 1").orderBy(F.desc(F.expr("(c - 1) * n")), "h1", "h2").limit(most).select("h1", "h2", "th")


def _extract(batches: Iterator[pa.RecordBatch], shared, mean: int) -> Iterator[pa.RecordBatch]:
    wanted, texts = shared.value
    done: set[tuple[int, int]] = set()
    for batch in batches:
        mine = np.isin(batch.column("_th").to_numpy(), texts)
        if not mine.any():
            continue
        for block in blocks(batch.column("_text").filter(pa.array(mine))):
            s, e, h1, h2 = chunks(block, mean)
            for a, b, key in zip(s.tolist(), e.tolist(), zip(h1.view(np.int64).tolist(), h2.view(np.int64).tolist(), strict=True), strict=True):
                if key in wanted and key not in done:
                    done.add(key)
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([block.buf[a:b].tobytes()], pa.binary())], names=["h1", "h2", "chunk"])


def _encode_chunks(batch: pa.RecordBatch, path: str) -> Iterator[dict]:
    memo = _memo(path)
    ids = []
    for chunk in batch.column("chunk").to_pylist():
        a, b = inner(chunk)
        ids.append(np.array(memo.tokenizer.encode(chunk[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes())
    yield {"h1": batch.column("h1"), "h2": batch.column("h2"), "chunk": batch.column("chunk"), "ids": ids}


def dictionary(rows: DataFrame, path: str, mean: int = MEAN_CHUNK, most: int = DICTIONARY) -> dict[tuple[int, int], tuple[bytes, bytes]]:
    """Shared chunks encoded once: digest to (chunk, ids of the inner part).  At most ``most`` entries."""
    chosen = shared_chunks(rows, mean, most).toArrow().to_pydict()
    wanted = set(zip(chosen["h1"], chosen["h2"], strict=True))
    if not wanted:
        return {}
    shared = rows.sparkSession.sparkContext.broadcast((wanted, np.unique(np.array(chosen["th"], np.int64))))
    texts = rows.mapInArrow(lambda b: _extract(b, shared, mean), "h1 long, h2 long, chunk binary").groupBy("h1", "h2").agg(F.min("chunk").alias("chunk"))
    found = arrow_map(texts, lambda b: _encode_chunks(b, path), "h1 long, h2 long, chunk binary, ids binary").toArrow().to_pydict()
    return {(a, b): (c, i) for a, b, c, i in zip(*found.values(), strict=True)}


class Known:
    """The dictionary as a worker uses it: digests in order, and the chunks with their parts' ids."""

    def __init__(self, entries: dict[tuple[int, int], tuple[bytes, bytes]]):
        self.name = uuid.uuid4().hex
        keys = sorted(entries)
        self.first = np.array([k[0] for k in keys], np.int64)
        self.second = np.array([k[1] for k in keys], np.int64)
        self.entries = [entries[k] for k in keys]
        self.agreed: dict[tuple[int, int, int], bool] = {}

    def find(self, block: Block, mean: int) -> list[tuple[int, int, int]]:
        """(start, end, entry) of the inner parts of known chunks of a block, in order; chunks are compared in full."""
        if not len(self.first):
            return []
        s, e, h1, h2 = chunks(block, mean)
        h1, h2 = h1.view(np.int64), h2.view(np.int64)
        at = np.minimum(np.searchsorted(self.first, h1), len(self.first) - 1)
        out = []
        for c in np.flatnonzero((self.first[at] == h1) & (self.second[at] == h2)).tolist():
            chunk = self.entries[at[c]][0]
            a, b = inner(chunk)
            if b > a and chunk == block.buf[s[c] : e[c]].tobytes():
                out.append((int(s[c]) + a, int(s[c]) + b, int(at[c])))
        return out


def joins(memo: Memo, words: list[bytes], other: list[bytes], side: int) -> bool:
    """Whether a part joins its neighbour's words as the tokenizer does; ``side`` -1: they stand before it.

    The window is one word either side at first and doubles until the ids in its middle agree, or the words end.
    """
    near = 1
    while True:
        left, right = (other[-near:], words[:near]) if side < 0 else (words[-near:], other[:near])
        whole = memo.tokenizer.encode(b" ".join([*left, *right]).decode("utf-8", "replace"), add_special_tokens=False).ids
        if whole == list(itertools.chain.from_iterable(memo.encoded([*left, *right]))):
            return True
        if near >= max(len(other), len(words)):
            return False
        near *= 2


def _items(block: Block, raw: bytes, memo: Memo, known: Known, mean: int) -> tuple[np.ndarray, np.ndarray, set[int]]:
    """A block as entries of the memo, words and inner parts of known chunks; the first of each document; and documents
    where a join doesn't agree, which are encoded as a whole."""
    words = Words(block, "plain")
    parts = known.find(block, mean)
    if not parts:
        return memo.numbers(raw, words.starts, words.ends, words.hash), words.first, set()
    begin, end = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    # parts begin and end at white space, so a word is in one part or in none
    inside = np.zeros(len(words.starts) + 1, np.int64)
    lo, hi = np.searchsorted(words.starts, begin), np.searchsorted(words.starts, end)
    np.add.at(inside, lo, 1)
    np.add.at(inside, hi, -1)
    out = np.flatnonzero(np.cumsum(inside)[:-1] == 0)
    number = memo.numbers(raw, words.starts[out], words.ends[out], words.hash[out])
    place = np.r_[words.starts[out], begin]
    order = np.argsort(place, kind="stable")
    used = np.unique([p[2] for p in parts])
    if new := [k for k in used.tolist() if (known.name, k) not in memo.parts]:
        memo.parts.update(zip([(known.name, k) for k in new], memo.add([np.frombuffer(known.entries[k][1], "<u4") for k in new]).tolist(), strict=True))
    items = np.r_[number, [memo.parts[known.name, p[2]] for p in parts]][order]
    first = np.searchsorted(place[order], block.off)
    broken: set[int] = set()
    doc = block.doc_of(begin)
    text = lambda i, j: [raw[x:y] for x, y in zip(words.starts[i:j].tolist(), words.ends[i:j].tolist(), strict=True)]
    for q, (_, _, k) in enumerate(parts):
        d, a, b = int(doc[q]), int(lo[q]), int(hi[q])
        if d in broken or a == b:
            continue
        for side, beside, other in ((-1, a - 1, (max(int(words.first[d]), a - WINDOW), a)), (1, b, (b, min(int(words.first[d + 1]), b + WINDOW)))):
            if other[0] >= other[1]:
                continue
            key = (k, side, int(words.hash[beside]))
            if key not in known.agreed:
                mine = text(a, min(b, a + WINDOW)) if side < 0 else text(max(a, b - WINDOW), b)
                known.agreed[key] = joins(memo, mine, text(*other), side)
            if not known.agreed[key]:
                broken.add(d)
                break
    return items, first, broken


def _encode(batch: pa.RecordBatch, path: str, mean: int, shared, outputs: bool) -> Iterator[dict]:
    memo, known = _memo(path), shared.value
    n = batch.num_rows
    tokens, id_sha, text_sha = np.zeros(n, np.int64), [""] * n, [""] * n
    ids_out, text_out = [b""] * n, [""] * n
    by_word = splits_on_white_space(path)
    for block in blocks(batch.column("_text")):
        whole = set(range(len(block)))
        if by_word:
            items, first, whole = _items(block, block.buf.tobytes(), memo, known, mean)
            flat, at = memo.gathered(items)
        for i in range(len(block)):
            row = block.first + i
            if i in whole:
                ids = np.array(memo.tokenizer.encode(block.document(i).decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")
            else:
                ids = flat[at[first[i]] : at[first[i + 1]]]
            tokens[row] = len(ids)
            packed, decoded = ids.tobytes(), memo.decoded(ids)
            id_sha[row], text_sha[row] = hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()
            if outputs:
                ids_out[row], text_out[row] = packed, decoded.decode()
    out = {"_row": batch.column("_row"), "n_tokens": tokens, "ids_sha256": id_sha, "decoded_sha256": text_sha}
    yield out | ({"ids": ids_out, "decoded": text_out} if outputs else {})


def encode(docs: DataFrame, *, keep: list[str], text: str = "text", vocabulary: str | None = None, mean: int = MEAN_CHUNK, most: int = DICTIONARY, outputs: bool = False) -> DataFrame:
    """``keep`` columns with n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    With ``outputs``, also ids (binary, little-endian unsigned 32-bit integers) and decoded.

    Three passes over the documents (count chunks, fetch the chosen ones, encode); texts are never shuffled.
    """
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(whole_row(docs, keep).alias("_row"), body.alias("_text"))
    known = dictionary(docs.select(F.xxhash64(body).alias("_th"), body.alias("_text")), path, mean, most)
    shared = docs.sparkSession.sparkContext.broadcast(Known(known))
    more = ["ids", "decoded"] if outputs else []
    schema = fields("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * outputs, rows.schema["_row"])
    out = arrow_map(rows, lambda b: _encode(b, path, mean, shared, outputs), schema)
    return out.select(*[F.col("_row").getField(c).alias(free_name(c, COLUMNS)) for c in keep], "n_tokens", "ids_sha256", "decoded_sha256", *more)
