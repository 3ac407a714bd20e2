"""Periodic runs against a brute-force version, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from gavel.llm import periodic_runs
from gavel.llm.periodic_runs import Extensions, collapse_runs, run_report, runs_of
from gavel.llm.queries import QUERIES


def brute_runs(words):
    """Every stretch that a period fits and no neighbour extends, with its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(24, 3 * q):
                found.setdefault((start, length), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha(listed), sha(kept))


def made(rng):
    """Words with runs of all kinds: of one word, long periods, runs in runs, runs that end at the ends."""
    words = []
    for _ in range(rng.randrange(1, 6)):
        unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 17, 40]))]
        words += (unit * rng.randrange(1, 40))[: rng.randrange(1, 160)]
        words += [rng.randrange(60) for _ in range(rng.choice([0, 0, 1, 7, 30]))]
    return np.array(words, np.int64)


def test_runs_match_brute_force(monkeypatch):
    rng = random.Random(5)
    texts = [made(rng) for _ in range(400)] + [np.zeros(k, np.int64) for k in (0, 1, 23, 24, 25, 300)]
    want = [brute_runs(x.tolist()) for x in texts]
    assert runs_of(texts) == want
    assert sum(map(len, want)) > 400
    monkeypatch.setattr(periodic_runs, "POINTS", 7)
    assert runs_of(texts[:20]) == want[:20]


def test_extensions_match_brute_force():
    rng = random.Random(3)
    ids = np.array([rng.randrange(2) for _ in range(500)] + [0, 1] * 60 + [9], np.int64)
    pairs = [(i, j) for i in range(0, len(ids), 7) for j in range(i + 1, len(ids), 5)]
    i, j = (np.array(x) for x in zip(*pairs, strict=True))
    got = Extensions(ids)(i, j).tolist()
    for (a, b), n in zip(pairs, got, strict=True):
        k = 0
        while b + k < len(ids) and ids[a + k] == ids[b + k]:
            k += 1
        assert n == k


def test_query_matches_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect())
    want = sorted((brute_row(*r) for r in rows), key=lambda r: r[0])
    assert got == want
    assert sum(r[1] > 0 for r in got) > 10


@pytest.mark.parametrize("slice_words", [1 << 17, 5])
def test_odd_rows(spark, slice_words, monkeypatch):
    monkeypatch.setattr(periodic_runs, "SLICE_WORDS", slice_words)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b " * 30), (4, "a b " * 30), (None, "x " * 24), (None, None), (5, "é ü " * 40), (6, " ".join(map(str, range(3000))) + " q" * 30_000)]
    rows += [(k, f"one two three four five six {k} " * 9) for k in range(100, 140)]
    odd = spark.createDataFrame([(*r, "clash", 7, "c") for r in rows], "doc_id bigint, text string, h string, n_runs int, start string")
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256")
    got = [(r.doc_id, *(r[c] for c in columns), hashlib.sha256(r.collapsed.encode()).hexdigest()) for r in run_report(odd).collect()]
    quick = [brute_row(*r) if r[0] != 6 else (6, 1, 3000, 30_000, 1, 30_000_000) for r in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for g, w in zip(sorted(got, key=key), sorted(quick, key=key), strict=True):
        assert g[: len(w)] == w
    kept = collapse_runs(odd)
    assert kept.columns == odd.columns
    assert {tuple(r[2:]) for r in kept.collect()} == {("clash", 7, "c")}
    assert [r.text for r in kept.where("doc_id = 4").collect()] == ["a b", "a b"]
    assert run_report(odd.where("false")).count() == 0
