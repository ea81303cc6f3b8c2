"""The suffix array of line_dedup: maximal runs with earlier copies against a plain search, over ranges and within documents."""

import random

import brute
import numpy as np

from percolith.llm import line_dedup
from percolith.llm.line_dedup import Sequences, _joined_ranges, earlier_copies, own_copies


def maximal_runs(rows, min_lines, min_chars):
    """Per row: (first line, lines) of the runs with an earlier copy that can't be longer on either side."""
    split = [(i, (t or "").removesuffix("\n").split("\n") if t else []) for i, t in rows]
    out = []
    for k, (i, x) in enumerate(split):
        longest = [0] * (len(x) + 1)
        for m, (d, y) in enumerate(split):
            if k == m or (i is not None and d is not None and d < i):
                common = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
                for a in range(len(x) - 1, -1, -1):
                    for b in range(len(y) - 1, -1, -1):
                        if x[a] == y[b] and (k != m or b < a):
                            common[a][b] = common[a + 1][b + 1] + 1
                    longest[a] = max(longest[a], *common[a])
        runs = [(a, n) for a, n in enumerate(longest) if n and not (a and longest[a - 1] - 1 == n)]
        out.append((i, [(a, n) for a, n in runs if n >= min_lines or any(len(z) >= min_chars and z.strip() for z in x[a : a + n])]))
    return out


def texts():
    rng = random.Random(4)
    lines = ["", " ", "a", "b", "c", "a line of more than forty characters, which counts alone", *(f"line {k}" for k in range(60))]
    base = [rng.choice(lines) for _ in range(150)]
    out = []
    for _ in range(70):
        x = []
        while len(x) < rng.randint(1, 30):
            a = rng.randrange(len(base))
            x += rng.choice([base[a : a + rng.randint(1, 20)], [rng.choice(lines)], [f"own {rng.random()}"]])
        out.append("\n".join(x) + rng.choice(["", "\n"]))
    out += ["\n".join(base), "\n".join(base), "x\n" + "\n".join(base[3:140]) + "\ny", "a\n" * 40, "a\n" * 23 + "b", "x\n\n\n\n\ny", "x\n\n\n\n\ny"]
    rng.shuffle(out)
    return [*enumerate(out), (5, out[9]), (None, out[3]), (None, "k\nl\nk\nl\nm"), (300, None), (301, "")]


def test_maximal_runs(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    for coalesce in ("true", "false"):  # few ranges, and as many as there are partitions
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        try:
            out = line_dedup.deduplicate(docs, outputs=True).collect()
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        key = lambda r: (str(r[0]), r[1])
        assert sorted(((r.doc_id, [tuple(x) for x in r.runs]) for r in out), key=key) == sorted(maximal_runs(rows, 2, 40), key=key)
        kept = sorted((tuple(r)[:5] for r in out), key=str)
        assert kept == sorted(brute.op8(rows), key=str)


def test_ranges_are_joined():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 25))
        lcp, owner = rng.integers(0, 5, n).tolist(), rng.integers(0, 8, n).tolist()
        lcp[0] = 0
        whole = [max([min(lcp[min(i, j) + 1 : max(i, j) + 1]) for j in range(n) if j != i and owner[j] < owner[i]], default=0) for i in range(n)]
        assert earlier_copies(lcp, owner)[0] == whole
        cuts = [0, *sorted(set(rng.integers(0, n, 4).tolist()) - {0}), n]
        parts = [(lcp[a:b], owner[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        found, ends = [], []
        for k, (x, o) in enumerate(parts):
            best, after, before = earlier_copies(x, o)
            found.append(best)
            ends.append((k, line_dedup.json.dumps([x[0], min(x[1:], default=line_dedup.WHOLE), after.lcp, after.owner, before.lcp, before.owner])))
        beyond, got = _joined_ranges(ends), []
        for k, (x, o) in enumerate(parts):
            for i in range(len(x)):
                first, last = min(x[: i + 1]), min(x[i + 1 :], default=line_dedup.WHOLE)
                got.append(max(found[k][i], min(first, beyond[k][0].longest(o[i])), min(last, beyond[k][1].longest(o[i]))))
        assert got == whole


def test_copies_within_a_document():
    rng = np.random.default_rng(5)
    for _ in range(100):
        seqs = [rng.integers(0, int(rng.choice([1, 2, 6])) + 1, int(rng.integers(0, 30))) for _ in range(3)]
        s = Sequences(seqs, seqs, seqs)
        got = np.zeros(len(s.a), np.int64)
        at, n = own_copies(s)
        got[at] = n
        expected = []
        for x in seqs:
            for i in range(len(x)):
                expected.append(max((next((k for k in range(len(x) - i) if x[i + k] != x[j + k]), len(x) - i) for j in range(i)), default=0))
        assert got.tolist() == expected
