"""Plain single-process versions of the operators, straight from their contracts."""

import hashlib
import re
from collections import defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def op1(rows, length=200):
    starts = defaultdict(int)
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for _, b in bodies:
        for k in range(len(b) - length + 1):
            starts[b[k : k + length]] += 1
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if starts[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(kept)))
    return out


def op5(rows, percent=85, k=5):
    sets = []
    for i, t in rows:
        w = SPACE_WORD.findall((t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for e in s:
            where[e].append(n)
    for n, (_, s) in enumerate(sets):
        common = defaultdict(int)
        for e in s:
            for m in where[e]:
                if m < n:
                    common[m] += 1
        for m, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[m][1]) - c):
                a, b = root(n), root(m)
                if sets[a][0] < sets[b][0]:
                    a, b = b, a
                parent[a] = b
    return [(i, len(s), sets[root(n)][0], sets[root(n)][0] == i) for n, (i, s) in enumerate(sets)]


def op9(rows, items, window=10):
    wins = defaultdict(set)
    for i, t in items:
        w = ALNUM_WORD.findall((t or "").translate(LOWER))
        m = min(window, len(w))
        for j in range(len(w) - m + 1) if m else ():
            wins[tuple(w[j : j + m])].add(str(i))
    sizes = {len(x) for x in wins}
    out = []
    for i, t in rows:
        w = ALNUM_WORD.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for m in sizes:
            for j in range(len(w) - m + 1):
                if (x := tuple(w[j : j + m])) in wins:
                    found |= wins[x]
                    hit[j : j + m] = [True] * m
        out.append((i, len(w), sum(hit), len(found), sha(",".join(sorted(found))), any(hit)))
    return out


def op10(rows, length=50):
    first = {}
    words = [(i, SPACE_WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for j in range(len(w) - length + 1):
            k = tuple(w[j : j + length])
            if i is not None and (k not in first or i < first[k]):
                first[k] = i
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if i is not None and first[tuple(w[j : j + length])] < i:
                gone[j : j + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), sha(kept)))
    return out


def op8(rows, min_lines=2, min_chars=40):
    """Later copies of runs: an earlier place is in a smaller doc_id, or further up in the same row."""
    def split(t):
        x = (t or "").split("\n")
        return x[:-1] if x and x[-1] == "" else x

    docs = [(i, split(t), t or "") for i, t in rows]

    def runs(lines):
        for length in {1, min_lines}:
            for j in range(len(lines) - length + 1):
                part = tuple(lines[j : j + length])
                if length == 1 and len(part[0]) >= min_chars and part[0].strip(" \t\x0b\x0c\r"):
                    yield j, part
                elif length > 1 and any(x.strip(" \t\x0b\x0c\r") for x in part):
                    yield j, part

    first = {}
    for i, lines, _ in docs:
        if i is not None:
            for _, part in runs(lines):
                first[part] = min(first.get(part, i), i)
    out = []
    for i, lines, text in docs:
        gone, seen = [False] * len(lines), set()
        for j, part in sorted(runs(lines), key=lambda x: (x[0], len(x[1]))):
            if part in seen or (i is not None and first[part] < i):
                gone[j : j + len(part)] = [True] * len(part)
            seen.add(part)
        kept = text
        if any(gone):
            tail = text.split("\n")[len(lines) :]
            kept = "" if all(gone) else "\n".join([x for x, g in zip(lines, gone) if not g] + tail)
        starts = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(lines), sum(gone), starts, sha(kept)))
    return out


def op3_base(rows, folds=7, held=2):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score by plain counting."""
    import math
    import zlib
    from collections import Counter

    def fold(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % folds == held

    toks = [(i, SPACE_WORD.findall((t or "").translate(LOWER)) + [None]) for i, t in rows]
    counts = Counter(w for i, ws in toks if not fold(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(i, fold(i), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in toks]


def _fold(i, folds, held):
    import zlib

    return zlib.crc32(("" if i is None else str(i)).encode()) % folds == held


def _letter_ngrams(text):
    """Letter n-grams of 1 to 3 in a lower-cased text; words are padded with one blank."""
    from collections import Counter

    plain = "".join(c if c.isalpha() else " " for c in text.lower())
    out = Counter()
    for word in plain.split():
        padded = f" {word} "
        out.update(word)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def op6(rows, size=400, folds=4, held=2):
    """(doc_id, held_out, lang_pred, score): out-of-place distance to each language's most frequent n-grams."""
    from collections import Counter

    def _code(g):
        return tuple([0] * (3 - len(g)) + list(map(ord, g)))

    def ranked(counts):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], _code(x[0])))][:size]

    learned = {}
    for i, text, lang in rows:
        if lang is not None and text and not _fold(i, folds, held):
            learned.setdefault(lang, Counter()).update(_letter_ngrams(text))
    profiles = {lang: {g: r for r, g in enumerate(ranked(c))} for lang, c in sorted(learned.items()) if c}
    out = []
    for i, text, _ in rows:
        mine = ranked(_letter_ngrams(text or ""))
        if not mine or not profiles:
            out.append((i, _fold(i, folds, held), "und", 0.0))
            continue
        far = {lang: sum(abs(p[g] - r) if g in p else size for r, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        out.append((i, _fold(i, folds, held), best, 1.0 - far[best] / (size * len(mine))))
    return out


def op7_base(rows):
    """(doc_id, n_assign, n_access, n_hex, base_sha256), scanned letter by letter without the patterns."""
    import string

    value = set(string.ascii_letters + string.digits + "+/_.=-")
    keys = ("password", "passwd", "secret", "token", "api_key", "apikey")

    def assigns(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        i = 0
        while i < len(t):
            hit = None
            for k in keys:  # no key is the start of another that also fits
                if low.startswith(k, i):
                    j = i + len(k)
                    j += j < len(t) and t[j] in "\"'"
                    while j < len(t) and t[j] == " ":
                        j += 1
                    if j < len(t) and t[j] in ":=":
                        j += 1
                        while j < len(t) and t[j] == " ":
                            j += 1
                        j += j < len(t) and t[j] in "\"'"
                        e = j
                        while e < len(t) and t[e] in value:
                            e += 1
                        if e > j:
                            hit = (i, j, e)
                            break
            if hit:
                if hit[2] - hit[1] >= 12:
                    yield hit[0], 0, hit[2]
                i = hit[2]
            else:
                i += 1

    def runs(t, kind, head, letters, least):
        i = 0
        while i < len(t):
            if t.startswith(head, i) and i + len(head) < len(t) + (not head) and (i + len(head) < len(t)) and t[i + len(head)] in letters:
                e = i + len(head)
                while e < len(t) and t[e] in letters:
                    e += 1
                if e - i >= least:
                    yield i, kind, e
                i = e
            else:
                i += 1

    names = ("assign", "access", "hex")
    out = []
    for i, t in rows:
        t = t or ""
        found = sorted([*assigns(t), *runs(t, 1, "AKIA", set(string.ascii_uppercase + string.digits), 18), *runs(t, 2, "", set("0123456789abcdef"), 16)])
        n = [sum(k == kind for _, k, _ in found) for kind in range(3)]
        out.append((i, *n, sha(",".join(f"{names[k]}:{s}:{e}" for s, k, e in found))))
    return out
