"""Secret scans: fixed patterns, and a token-efficiency test.

Text that a vocabulary was made for takes few tokens; a random string takes many.  Runs of the
characters that keys are written in, of ``MIN_RUN`` or more, are encoded under a public tiktoken
vocabulary, and those with fewer than ``MAX_RATIO`` characters a token are reported as ``dense``, after
excluding known digests (hexadecimal of a digest's length), UUIDs, runs without a letter, and identifiers
(parts that look like words, with a few digits after, or short numbers).  Runs without a digit must be under
``LETTERS_RATIO``, as words of languages that the vocabulary was not made for take many tokens too.  A run
of which base spans leave fewer than ``REST`` characters is not reported again.

Edge cases: null counts as empty; an empty text has no span and the digest of the empty string.
Repeated rows are scanned each for itself.  Spans count code points of the text as it stands, of any length;
spans that start together come in the order of their kinds.  An empty table gives an empty table; other
columns take no part.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map
from ._text import Block, blocks

KINDS = ("assign", "access", "hex", "dense")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NEEDLES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_VALUE = 12

MIN_RUN = 16
MAX_RATIO, LETTERS_RATIO = 2.3, 1.95
REST = 4
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_RUN)
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.I)
_UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z", re.I)
_PART = re.compile(r"([A-Za-z]*)\d{0,4}\Z")
#: Letters of a part that may be anything, such as those of versions; numbers, dates and times.
SHORT_PART = 4
_NUMBER = re.compile(r"\d{1,8}([A-Za-z]\d{1,6})?[A-Za-z]?\Z")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_HEX_CLASS = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_RUN_CLASS = bytes(1 if re.match(r"[A-Za-z0-9+/_.=-]", chr(b)) and b < 128 else 0 for b in range(256))


@functools.cache
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_identifier(run: str) -> bool:
    """Words, dotted or joined names, versions, dates and paths: parts are short, or numbers, or words with a few digits after."""
    long = [p for p in re.split(r"[+/_.=-]+", run) if len(p) > SHORT_PART and not _NUMBER.match(p)]
    parts = [_PART.match(p) for p in long]
    if not all(parts) or re.search(r"[a-z][A-Z]{2,}[a-z]|[A-Z]{3,}\d", run):
        return False
    words = [w for m in parts for w in _WORD.findall(m[1])]
    # random letters change case every few places, or have long pieces, or pieces without a vowel
    return 3 * len(words) <= sum(map(len, words)) and all(len(w) < 14 and (len(w) < 4 or re.search("(?i)[aeiouy]", w)) for w in words)


def dense_runs(text: str, path: str) -> Iterator[tuple[int, int]]:
    for m in _RUN.finditer(text):
        run = m[0]
        if _DIGEST.match(run) or _UUID.match(run) or not re.search(r"[A-Za-z]", run) or is_identifier(run):
            continue
        ratio = MAX_RATIO if re.search(r"\d", run) else LETTERS_RATIO
        if len(run) < ratio * len(_encoding(path).encode_ordinary(run)):
            yield m.start(), m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str, base: list[tuple[int, int, int]], path: str) -> list[tuple[int, int, int]]:
    covered = lambda a, b: len({i for s, _, e in base for i in range(max(a, s), min(b, e))})
    more = [(a, 3, b) for a, b in dense_runs(text, path) if b - a - covered(a, b) >= REST]
    return sorted([*base, *more])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _with_runs(block: Block, table: bytes, least: int) -> np.ndarray:
    """Which documents have a run of that class of ``least`` bytes (runs across documents may add some)."""
    x = np.frombuffer(b"\0" + block.buf.tobytes().translate(table) + b"\0", np.int8)
    d = np.diff(x)
    start, end = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    keep = end - start >= least
    out = np.zeros(len(block) + 1, np.int64)
    np.add.at(out, block.doc_of(start[keep]), 1)
    np.add.at(out, np.minimum(block.doc_of(end[keep]) + 1, len(block)), -1)
    return np.cumsum(out)[:-1] > 0


def _scan(batch: pa.RecordBatch, path: str) -> Iterator[dict]:
    empty = hashlib.sha256(b"").hexdigest()
    n = batch.num_rows
    counts, digest, spans = np.zeros((n, 3), np.int64), [empty] * n, [""] * n
    for block in blocks(batch.column("_text")):
        lower = block.buf.tobytes().lower()
        worth = _with_runs(block, _RUN_CLASS, MIN_RUN) | _with_runs(block, _HEX_CLASS, 16)
        for needle in (*_NEEDLES, b"akia"):
            at = lower.find(needle)
            while at >= 0:
                i = int(block.doc_of(np.int64(at)))
                worth[i] = True
                at = lower.find(needle, int(block.off[i + 1]))
        for i in np.flatnonzero(worth):
            text = block.document(i).decode("utf-8", "replace")
            base = base_spans(text)
            row = block.first + int(i)
            for _, k, _ in base:
                counts[row, k] += 1
            digest[row] = hashlib.sha256(joined(base).encode()).hexdigest()
            spans[row] = joined(all_spans(text, base, path))
    yield {"_id": batch.column("_id"), "n_assign": counts[:, 0], "n_access": counts[:, 1], "n_hex": counts[:, 2], "base_sha256": digest, "spans": spans}


def scan(docs: DataFrame, *, vocabulary: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document with counts, digest and spans; no shuffle, memory bounded by one batch."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = arrow_map(rows, lambda batch: _scan(batch, path), f"_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("_id", doc_id)
